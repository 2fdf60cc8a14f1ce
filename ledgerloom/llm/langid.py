"""Language identification by a blended-spectrum string kernel with Nyström landmarks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, remainder, slices

ORDERS = (2, 3, 4)
SLOT_BITS = 20
UNKNOWN = "und"


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with three zeros after each, and the text each belongs to (-1: zeros)."""
    parts = [t.lower() for t in texts]
    joined = "\0\0\0".join([*parts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.repeat(np.arange(len(parts), dtype=np.int32), 2), np.column_stack((sizes, np.full(len(parts), 3))).ravel())
    owner[codes == 0] = -1
    return codes, owner


def _slots(codes: np.ndarray):
    """For each order the hash slot of the n-gram that starts at each code point."""
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ (codes[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
        if n in ORDERS:
            yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SLOT_BITS)


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


@dataclass
class Model:
    """slot -> column of the landmarks' n-grams, landmark presences (columns x landmarks), their norms, dual weights.

    least: the share of a text's n-grams that some landmark has, below which it is in no learned language.
    """

    langs: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    least: float = 0.0

    @property
    def block(self) -> int:
        """Texts whose presences are held at once."""
        return max(8, min(256, (8 << 20) // max(1, self.landmarks.shape[0])))

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """texts x columns: 1 where the text has the n-gram; and how many distinct n-grams each text has in all.

        A table by slot keeps the last place of each n-gram of a text, so that one place of each is counted.
        """
        width = self.landmarks.shape[0]
        out, total = np.zeros((len(texts), width), np.uint8), np.zeros(len(texts))
        codes, _ = _codes(texts)
        orders, at = list(_slots(codes)), 0
        last = np.empty(1 << SLOT_BITS, np.int32)
        for i, t in enumerate(texts):
            size = len(t.lower())
            own = np.concatenate([x[at : at + size] for x in orders])
            at += size + 3
            places = np.arange(len(own), dtype=np.int32)
            last[own] = places
            own = own[last[own] == places]
            total[i] = len(own)
            columns = self.column[own]
            out[i, columns[columns < width]] = 1
        return out, total

    def kernel(self, presence: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Normalised presence kernel with every landmark, as one matrix product."""
        held, total = presence
        return (held.astype(np.float32) @ self.landmarks) / np.sqrt(np.maximum(total, 1))[:, None] / self.norms

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of the evidence, and the share of n-grams that some landmark has, of each text."""
        langs, scores, known = [], [np.zeros(0)], [np.zeros(0)]
        for k in range(0, len(texts), self.block):
            held, total = self.presence(texts[k : k + self.block])
            raw = self.kernel((held, total)) @ self.weights
            raw = np.exp(4 * (raw - raw.max(1, keepdims=True)))
            share = raw / raw.sum(1, keepdims=True)
            langs += [self.langs[i] for i in share.argmax(1)]
            scores.append(share.max(1).astype(float))
            known.append(held.sum(1) / np.maximum(total, 1))
        return langs, np.concatenate(scores), np.concatenate(known)


def fit(texts: list[str], langs: list[str], n_landmarks: int = 96, ridge: float = 1e-2, short: int = 4000) -> Model | None:
    """Nyström features of a presence kernel, then one-versus-rest kernel ridge regression.

    All n-grams of a text count; those of the landmarks are the columns of the products, as no other can be
    shared with one. Landmarks are spread evenly over the languages, texts of up to `short` characters first, else in
    sample order. None without texts.
    """
    names = sorted(set(langs))
    if not names:
        return None
    by_lang = {x: sorted((i for i, y in enumerate(langs) if y == x), key=lambda i: (len(texts[i]) > short, i)) for x in names}
    turn = sorted((k, x, i) for x in names for k, i in enumerate(by_lang[x]))
    chosen = [i for _, _, i in turn[: max(n_landmarks, len(names))]]
    slots = np.unique(np.concatenate([x[: len(texts[i].lower())] for i in chosen for x in _slots(_codes([texts[i]])[0])]))
    column = np.full(1 << SLOT_BITS, len(slots), np.int32)
    column[slots] = np.arange(len(slots))
    model = Model(names, column, np.zeros((len(slots), 1), np.float32), np.ones(1), np.zeros((1, 1)))
    z, total = model.presence([texts[i] for i in chosen])
    model.landmarks, model.norms = np.ascontiguousarray(z.T.astype(np.float32)), np.sqrt(np.maximum(total, 1))
    values, vectors = np.linalg.eigh(model.kernel((z, total)).astype(float))
    root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0) @ vectors.T
    k, known = [], []
    for i in range(0, len(texts), model.block):
        held, total = model.presence(texts[i : i + model.block])
        k.append(model.kernel((held, total)).astype(float))
        known.append(held.sum(1) / np.maximum(total, 1))
    features = np.concatenate(k) @ root
    counts = np.array([len(by_lang[x]) for x in names], float)
    weight = (1 / counts)[[names.index(y) for y in langs]] * len(langs) / len(names)
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    gram = features.T @ (features * weight[:, None]) + ridge * len(langs) * np.eye(features.shape[1]) / features.shape[1]
    model.weights = (root @ np.linalg.solve(gram, features.T @ (target * weight[:, None]))).astype(np.float32)
    model.least = float(np.quantile(np.concatenate(known), 0.01)) / 3
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn, rows: int, longest: int) -> tuple[list[str], list[str]]:
    """About `rows` labelled texts, evenly over the languages, by a hash of id and text; never over twice as many.

    Texts of up to `longest` characters, but of a language that has fewer than two such the longer ones too.
    Rows that repeat count once.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.char_length(text_col) <= longest).alias("short"))
    counts = {r["lang"]: (r["n"], r["short"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("short").alias("short")).collect()}
    each = max(2, rows // max(1, len(counts)))
    wide = [x for x, (_, short) in counts.items() if short < 2]
    share = F.element_at(F.create_map(*[F.lit(x) for lang, (n, short) in counts.items() for x in (lang, each / (n if lang in wide else short))]), F.col("lang")) if counts else F.lit(0.0)
    spot = F.xxhash64(F.lit(5), "id", "text").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    allowed = F.col("short") | F.col("lang").isin(wide) if wide else F.col("short")
    drawn = known.where(allowed).withColumn("spot", spot).where(F.col("spot") < share).groupBy("lang", "spot").agg(F.min(F.struct("text", "id")).alias("x"))
    found = drawn.orderBy("spot", "lang").limit(2 * rows).select("spot", "lang", "x.*").collect()
    found = sorted((r for r in found if _has_letter(r["text"])), key=lambda r: (r["spot"], str(r["id"]), r["text"]))
    return [r["text"] for r in found], [r["lang"] for r in found]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 1600, longest: int = 20_000) -> Model | None:
    """A model from a bounded sample (`rows`, `longest`) of the rows that are not held out (crc32 mod 4 is 2)."""
    return fit(*sample(docs, id_col, text_col, lang_col, remainder(F.col(id_col), 4) != 2, rows, longest))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score and known (0 to 1) of each whole text, besides the columns `keep` of docs.

    A text that is null or has no letter is `und` with score and known 0, as is all without a model. score is the
    language's share among those learned; known, the share of the text's n-grams that some landmark has, tells
    texts of none of them (below the model's `least`). Repeated rows, and rows without an id, count like others;
    ties go to the first language. The text alone decides. Texts are read in blocks of bounded size; a row's result depends on that row only.
    """

    def run(batches):
        for batch in slices(batches, 2 << 20):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pc.fill_null(part.column("_text"), "").to_pylist()
                lettered = [i for i, t in enumerate(texts) if _has_letter(t)]
                langs, scores, known = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                if model is not None and lettered:
                    names, scores[lettered], known[lettered] = model.predict([texts[i] for i in lettered])
                    for i, x in zip(lettered, names):
                        langs[i] = x
                columns = [c for n, c in zip(part.schema.names, part.columns) if n != "_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(scores), pa.array(known)], names_out)

    lean(docs.sparkSession)
    chosen = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], F.col(text_col).alias("_text"))
    fields = [f for f in chosen.schema.fields if f.name != "_text"]
    names_out = [*(f.name for f in fields), "lang_pred", "score", "known"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, known double"
    return chosen.mapInArrow(run, schema)


def op3_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "known")
