"""Best-fit packing: length patterns fitted by non-negative least squares, the rest packed into what is left."""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, lean, lookup, slices
from .pieces import Cache

#: Classes of lengths that patterns are made of, and documents of a pattern at most.
CLASSES, DEPTH = 128, 3
#: Shares of the fitted numbers that are tried; the one that ends with the fewest sequences is kept.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1)
#: Pieces of one length that are numbered together.
PER_BUCKET = 1 << 16


@functools.lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _chunks(text: bytes, most: int = 1 << 20):
    """Lists of the text's runs without ASCII space, of about `most` bytes each."""
    at = 0
    while len(text) - at > most:
        to = at + most
        while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        yield text[at:to].split()
        at = to
    yield text[at:].split() if at else text.split()


#: Letters that are letters in every version of Unicode, without combining marks, and marks around them: a word of that
#: form is one run of the tokenizer's for each group that isn't empty.
PLAIN = re.compile("([(\"\\[]*)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?)\\]\"-]*)")
BATCH = 1 << 14


class Encoder:
    """Ids of whole texts. No token spans ASCII space, and its kind and number don't matter, so each distinct word is encoded once.

    Plain words are encoded together, parted by spaces; where a word ends in the ids is told by the tokens that end a run.
    Once more than `cached` words are known, those met least are forgotten.
    """

    def __init__(self, path: str, cached: int = 700_000):
        self.path, self.cached, self.cache, self.met = path, cached, Cache(), np.zeros(0, np.int64)
        words = _tokenizer(path).get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in _tokenizer(self.path).encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(itertools.chain.from_iterable(ids), np.int32)

    def _together(self, words: list[str], runs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(_tokenizer(self.path).encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != sum(runs):  # not a tokenizer whose runs end so
            return self._each(words)
        return np.diff(ends[np.cumsum(runs, dtype=np.int64) - 1] + 1, prepend=0), ids

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word start, how many they are, and the ids; those of plain words come first."""
        match = PLAIN.fullmatch
        forms = [match(w) for w in words]
        plain = [k for k, m in enumerate(forms) if m]
        runs = [1 + (forms[k][1] != "") + (forms[k][3] != "") for k in plain]
        rest = [k for k, m in enumerate(forms) if not m]
        sizes, ids = zip(self._together([words[k] for k in plain], runs), self._each([words[k] for k in rest]))
        size, order = np.concatenate(sizes), np.array(plain + rest, np.int64)
        starts = np.empty((2, len(words)), np.int64)
        starts[0, order], starts[1, order] = np.cumsum(size) - size, size
        return starts[0], starts[1], np.concatenate(ids)

    def _forget(self) -> None:
        least = 2
        while (self.met >= least).sum() > self.cached // 2:
            least *= 2
        kept, old = np.flatnonzero(self.met >= least), self.cache
        words = list(old.place)
        self.cache, size = Cache(), old.sizes[kept]
        for k in kept.tolist():
            self.cache.place[words[k]]  # noqa: B018 - asking for a word gives it its place
        self.cache.starts, self.cache.sizes, self.met = np.cumsum(size) - size, size, np.ones(len(kept), np.int64)
        self.cache.ids = old.ids[np.repeat(old.starts[kept] - self.cache.starts, size) + np.arange(size.sum())]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.cache.place) > self.cached:
            self._forget()
        known, cache = len(self.cache.starts), self.cache
        places = []
        for text in texts:
            parts = [np.fromiter(map(cache.place.__getitem__, c), np.int32, len(c)) for c in _chunks(text)]
            places.append(np.concatenate(parts))
        new = [w.decode() for w in itertools.islice(cache.place, known, None)]
        for i in range(0, len(new), BATCH):
            starts, sizes, ids = self.segment(new[i : i + BATCH])
            cache.starts, cache.sizes = np.concatenate((cache.starts, len(cache.ids) + starts)), np.concatenate((cache.sizes, sizes))
            cache.ids = np.concatenate((cache.ids, ids))
        self.met = np.concatenate((self.met, np.zeros(len(cache.starts) - len(self.met), np.int64)))
        for p in places:
            np.add.at(self.met, p, 1)
        out = []
        for p in places:
            size = cache.sizes[p]
            out.append(cache.ids[np.repeat(cache.starts[p] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        return out


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """Lives on in the worker from task to task; its cache is bounded."""
    return Encoder(path)


def tokenise(docs: DataFrame, path: str | None = None, limit: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `limit` tokens: id, piece (from 0), start (tokens of the document before it), length and
    ids (little-endian unsigned 32 bits).

    A document is the ids of its whole text and then `end`; a null or empty text is `end` alone. Only longer documents
    are cut, and only their last piece may be shorter than `limit`. Rows without an id and repeated rows are documents
    like others. path names a tokenizer file that splits at white space and drops it.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    schema = f"{id_col} long, piece int, start long, length long, ids binary"
    names = [id_col, "piece", "start", "length", "ids"]

    def run(batches):
        encode = _encoder(path)
        for batch in slices(batches, 2 << 20):
            ids = encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            rows = [[], [], [], [], []]
            for doc, found in zip(batch.column(0).to_pylist(), ids):
                found = np.append(found, end).astype("<u4")
                for piece, start in enumerate(range(0, len(found), limit)):
                    part = found[start : start + limit]
                    for to, value in zip(rows, (doc, piece, start, len(part), part.tobytes())):
                        to.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names)

    lean(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def patterns(classes: int = CLASSES, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of at most `depth` classes, falling, that sum to `classes`."""

    def parts(left: int, most: int, depth: int):
        if left == 0:
            yield ()
        elif depth:
            for c in range(min(left, most), 0, -1):
                for rest in parts(left - c, c, depth - 1):
                    yield (c, *rest)

    return list(parts(classes, classes, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets: the column with the steepest gain enters, columns that the
    least-squares solution makes negative leave."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        enters = int(gain.argmax())
        if gain[enters] <= slack:
            break
        free[enters] = True
        while free.any():
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            falls = s <= 0
            step = (x[at][falls] / np.maximum(x[at][falls] - s[falls], 1e-300)).min()
            x[at] += step * (s - x[at])
            free[at[(x[at] <= 1e-15) & falls]] = False
            x[~free] = 0
    return x


@dataclass
class Plan:
    """Sequences by runs of equal content: n sequences, each holding `parts` of (length, how many)."""

    runs: list[tuple[int, tuple]]

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.runs)

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, how many a sequence, first sequence, offset), sorted: where the pieces of a length go by rank."""
        taken: dict[int, int] = {}
        rows, base = [], 0
        for n, parts in self.runs:
            offset = 0
            for length, m in parts:
                rows.append((length, taken.get(length, 0), m, base, offset))
                taken[length] = taken.get(length, 0) + n * m
                offset += length * m
            base += n
        return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _unwind(parts) -> tuple:
    out = []
    while parts is not None:
        parts, length, m = parts
        out.append((length, m))
    return tuple(out[::-1])


def plan(counts: np.ndarray, classes: int = CLASSES, depth: int = DEPTH) -> Plan:
    """Packs counts[l] pieces of each length l into sequences of len(counts) - 1 tokens.

    Lengths are rounded up to classes, and the numbers of sequences of each pattern of few classes are fitted to the
    histogram of classes by non-negative least squares, a class weighing as much as it is long, since short pieces
    find a place anyway. The numbers are rounded, and no pattern takes more pieces than there are. Where
    a class is fitted more often than it occurs, its patterns are also tried in proportion, and of both SHARES, as a fit that
    leaves no short pieces may end worse; the fewest sequences win. What then remains goes, longest first, where it leaves
    least room, in the sequences begun so far or in new ones. All steps work on runs of equal sequences, so the
    time depends on the number of lengths, not of pieces.
    """
    limit = len(counts) - 1
    step = -(-limit // classes)
    left = {l: int(n) for l, n in enumerate(counts.tolist()) if l and n}
    shape = patterns(-(-limit // step), depth)
    have = np.zeros(-(-limit // step) + 1)
    for l, n in left.items():
        have[-(-l // step)] += n
    a = np.zeros((len(have), len(shape)))
    for k, p in enumerate(shape):
        for c in p:
            a[c, k] += 1
    # A pattern with a class that no piece has can't be used.
    usable = np.flatnonzero((a[have == 0] == 0).all(0))
    weight = np.arange(len(have))[:, None] / len(have)
    total = max(have.sum(), 1.0)
    fit = nnls(weight * a[:, usable], weight[:, 0] * have / total) * total if len(usable) else np.zeros(0)
    over = np.maximum(a[:, usable] @ fit / np.maximum(have, 1), 1)
    dealt = np.array([x / over[list(shape[k])].max() for x, k in zip(fit.tolist(), usable.tolist())])
    names = [shape[k] for k in usable.tolist()]
    tried = [_fill(left, list(zip(names, (x * share).tolist())), limit, step) for x in (fit, dealt) for share in SHARES]
    return min(tried, key=lambda p: p.sequences)


def _fill(left: dict[int, int], fit: list[tuple[tuple[int, ...], float]], limit: int, step: int) -> Plan:
    """Sequences of each pattern as often as it was fitted, rounded, and what remains by best fit."""
    left, begun = dict(left), {}

    def add(n: int, parts, free: int) -> None:
        if n:
            if free not in begun:
                bisect.insort(rooms, free)
            begun.setdefault(free, []).append([n, parts])

    rooms: list[int] = []
    known = sorted(left)

    def take(low: int, most: int) -> int:
        """The longest length that is left from above low to most; 0 if there is none."""
        at = bisect.bisect_right(known, most)
        return known[at - 1] if at and known[at - 1] > low else 0

    for p, times in sorted(fit, key=lambda x: -x[1]):
        wanted = int(times + 0.5)
        while wanted > 0:
            # The last of a pattern is the longest that fits, so that classes cost no room.
            drawn, room = [], limit
            for c in p:
                low, most = (c - 1) * step, min(c * step, room)
                l = take(low, most) if len(drawn) < len(p) - 1 else take(low - step, room)
                if not l:
                    break
                drawn.append(l)
                room -= l
            need = {l: drawn.count(l) for l in drawn}
            n = min([wanted] + [left[l] // m for l, m in need.items()])
            if len(drawn) < len(p):
                break
            if n == 0:  # the last piece of a length can't be taken twice
                n, drawn = 1, drawn[:1]
                need, room = {drawn[0]: 1}, limit - drawn[0]
            parts = None
            for l in drawn:
                parts = (parts, l, 1)
            for l, m in need.items():
                left[l] -= n * m
                if not left[l]:
                    del left[l]
                    known.remove(l)
            add(n, parts, room)
            wanted -= n
    for l in sorted(left, reverse=True):
        n = left[l]
        while n:
            at = bisect.bisect_left(rooms, l)
            if at == len(rooms):
                m = limit // l
                if n >= m:
                    add(n // m, (None, l, m), limit - m * l)
                if n % m:
                    add(1, (None, l, n % m), limit - n % m * l)
                break
            free = rooms[at]
            size, parts = begun[free].pop()
            if not begun[free]:
                del begun[free], rooms[at]
            m = free // l
            full = min(size, n // m)
            add(full, (parts, l, m), free - m * l)
            n, size = n - full * m, size - full
            if size and n:
                add(1, (parts, l, n), free - n * l)
                n, size = 0, size - 1
            add(size, parts, free)
    return Plan([(n, _unwind(parts)) for free in sorted(begun) for n, parts in begun[free]])


def place(pieces: DataFrame, limit: int = 4096, length_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset: every row has its place in a sequence of at most `limit` tokens, without gaps from 0.

    The driver sees only the histogram of lengths, at most `limit` rows, and plans by it; pieces of one length are
    interchangeable, so each gets a rank among them and the slot of that rank. Ranks are counted by
    buckets of about PER_BUCKET rows of a length, so that a length which most pieces share is many tasks' work; the plan is broadcast, and
    its size is bounded by the number of lengths and patterns. Rows whose length is null, under 1 or over `limit` are
    refused by an error. No rows give no rows; repeated rows have each its own place.
    """
    spark, names = pieces.sparkSession, pieces.columns
    rows = cut(pieces).withColumn("_key", F.monotonically_increasing_id())
    rows = rows.withColumn("_length", F.when(F.col(length_col).between(1, limit), F.col(length_col).cast("int")).otherwise(F.raise_error(F.lit("length out of range")).cast("int")))
    found = rows.groupBy("_length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(limit + 1, np.int64)
    for r in found:
        counts[r["_length"]] = r["n"]
    slots = spark.sparkContext.broadcast(plan(counts).slots())
    # Buckets of a length, by its count; at most `limit` rows.
    many = spark.createDataFrame([(r["_length"], int(-(-r["n"] // PER_BUCKET))) for r in found], "_length int, _buckets int")
    rows = rows.join(F.broadcast(many), "_length").withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.col("_buckets")).cast("int"))
    sizes = rows.groupBy("_length", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_length").orderBy("_bucket")) - F.col("n")
    base = cut(sizes.select("_length", "_bucket", before.alias("_base")))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_length", "_bucket").orderBy("_key")) - 1)
    ranked = lookup(ranked, base, ["_length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    def run(batches):
        table = slots.value
        starts = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0]]) if len(table) else np.zeros(0, int)
        first = dict(zip(table[starts, 0].tolist(), zip(starts.tolist(), np.append(starts[1:], len(table)).tolist()))) if len(table) else {}
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            slot = np.zeros(len(lengths), np.int64)
            for l in np.unique(lengths).tolist():
                at, (a, b) = np.flatnonzero(lengths == l), first[l]
                slot[at] = a + np.searchsorted(table[a:b, 1], ranks[at], side="right") - 1
            _, begin, m, sequence, offset = table[slot].T
            nth = ranks - begin
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence + nth // m), pa.array(offset + nth % m * lengths)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select("_length", "_rank", *names).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian unsigned 32 bits) and ends (the offset after each piece), of placed pieces that still have their ids."""
    rows = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("x", lambda p: p["offset"] + p["length"]).alias("ends"))


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents; null texts, nulls and repeated rows as tokenise() has them. Ids are summed up
    before rows move, so only narrow rows are shuffled."""
    pieces = tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
