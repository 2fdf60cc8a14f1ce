"""SentencePiece encoding by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def log_scores(told: np.ndarray) -> np.ndarray:
    """Log probabilities of normal pieces, in the order of their file.

    A unigram file has them. A BPE file has merge ranks instead, whole numbers, which no path may add up; there
    the pieces stand by falling frequency, and the n-th gets Zipf's share 1 / n of all.
    """
    if not len(told) or (told != np.rint(told)).any():
        return told
    ranks = np.arange(1, len(told) + 1)
    return -np.log(ranks) - np.log((1 / ranks).sum())


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a double-array trie; value is the key's place or -1.

    The child of state s by byte b is t = base[s] + b if check[t] == s. The root is state 0.
    """
    root: dict = {}
    for i, key in enumerate(keys):
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = i
    size = 1024 + 4 * sum(map(len, keys))
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    # Nodes of as many children look for a place from where the last such one found it.
    since = [1] * 257
    queue = [(0, root)]
    for state, node in queue:
        value[state] = node.get(-1, -1)
        kids = sorted(b for b in node if b >= 0)
        if not kids:
            continue
        at = max(since[len(kids)], kids[0] + 1)
        while taken[at] or any(taken[at - kids[0] + b] for b in kids[1:]):
            at += 1
        since[len(kids)] = at
        base[state] = at - kids[0]
        for b in kids:
            child = at - kids[0] + b
            taken[child], check[child] = 1, state
            queue.append((child, node[b]))
    used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    return base[:used], check[:used], value[:used]


class _Places(dict):
    """A unit's place, in the order in which units were first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Cache:
    """Units met so far and their ids, end to end."""

    def __init__(self):
        self.place = _Places()
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.ids) + offsets[:-1]))
        self.sizes = np.concatenate((self.sizes, np.diff(offsets)))
        self.ids = np.concatenate((self.ids, ids))


@dataclass
class Vocabulary:
    """Pieces with log scores; normal ones in the trie, byte pieces as fallback."""

    pieces: list[bytes]
    scores: np.ndarray
    bytes_at: np.ndarray
    ids: np.ndarray
    trie: tuple[np.ndarray, np.ndarray, np.ndarray]
    unknown: float
    newline_apart: bool

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[str]) -> Vocabulary:
        """kinds: normal, byte, or anything else for pieces that no text is encoded to."""
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        raw = [bytes([int(p[3:5], 16)]) if k == "byte" else p.encode() if k == "normal" else b"" for p, k in zip(pieces, kinds)]
        bytes_at = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == "byte":
                bytes_at[raw[i][0]] = i
        if (bytes_at < 0).any():
            raise ValueError("byte fallback needs all 256 byte pieces")
        if any(MARK in pieces[i].lstrip(MARK) or pieces[i].startswith(MARK * 2) and pieces[i].strip(MARK) for i in normal):
            raise ValueError("a piece spans a whitespace mark; words can't be encoded apart")
        found = np.array([scores[i] for i in normal], float)
        return cls(raw, found, bytes_at, np.array(normal, np.int32), double_array([raw[i] for i in normal]), float(found.min(initial=0)) - 10, not any("\n" in pieces[i] for i in normal))

    @classmethod
    def load(cls, path: str = MODEL_PATH, ranks: bool = True) -> Vocabulary:
        """The pieces of a model file with their log scores; ranks=False keeps the scores of a BPE file as they are."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
        n = range(sp.get_piece_size())
        kinds, scores = [kind(i) for i in n], np.array([sp.get_score(i) for i in n], float)
        normal = np.flatnonzero(np.array(kinds) == "normal")
        if ranks:
            scores[normal] = log_scores(scores[normal])
        return cls.of([sp.id_to_piece(i) for i in n], scores.tolist(), kinds)

    def units(self, text: str) -> list[str]:
        """Parts that no piece crosses: runs of marks with the word after them, and newlines."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return (APART if self.newline_apart else WHOLE).findall(marked)

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the best pieces of each unit; of equal scores the one with the longer last piece.

        Viterbi over all units at once: edges from the trie are relaxed by their start within the
        unit, so that each step is one numpy operation. A character that is no piece itself may be
        its bytes, at the lowest score less ten.
        """
        base, check, value = self.trie
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # each unit has one place more than bytes
        flat = np.frombuffer(b"\xff".join([*raw, b""]), np.uint8)
        offset = np.arange(len(flat)) - np.repeat(begin, sizes + 1)
        is_end = np.zeros(len(flat) + 1, bool)
        is_end[begin + sizes] = True
        starts = np.flatnonzero(((flat & 0xC0) != 0x80) & ~is_end[:-1])
        width = np.diff(np.append(starts, len(flat)))
        # A character ends at the next start, or at the unit's end.
        width = np.minimum(width, np.repeat(begin + sizes, sizes + 1)[starts] - starts)
        edge_from, edge_to, edge_id = [], [], []
        single = np.zeros(len(starts), bool)
        live, state, at = np.arange(len(starts)), np.zeros(len(starts), np.int64), starts.copy()
        while len(live):
            target = base[state] + flat[at]
            ok = check[target] == state
            live, state, at = live[ok], target[ok], at[ok] + 1
            hit = value[state] >= 0
            edge_from.append(starts[live[hit]])
            edge_to.append(at[hit])
            edge_id.append(value[state[hit]])
            single[live[hit]] |= at[hit] - starts[live[hit]] == width[live[hit]]
            on = ~is_end[at]
            live, state, at = live[on], state[on], at[on]
        lone = ~single
        a = np.concatenate([*edge_from, starts[lone]])
        b = np.concatenate([*edge_to, starts[lone] + width[lone]])
        piece = np.concatenate([*edge_id, np.full(lone.sum(), -1)]).astype(np.int64)
        gain = np.where(piece >= 0, self.scores[piece], self.unknown) if len(self.scores) else np.full(len(piece), self.unknown)
        order = np.argsort(offset[a], kind="stable")
        a, b, piece, gain = a[order], b[order], piece[order], gain[order]
        cuts = np.searchsorted(offset[a], np.arange(sizes.max(initial=0) + 1))
        best = np.full(len(flat) + 1, -np.inf)
        best[begin] = 0
        back = np.full(len(flat) + 1, -1, np.int64)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            total = best[a[s:e]] + gain[s:e]
            better = np.flatnonzero(total > best[b[s:e]])
            best[b[s:e][better]] = total[better]
            back[b[s:e][better]] = s + better
        steps = []
        place, unit = (begin + sizes)[sizes > 0], np.flatnonzero(sizes > 0)
        while len(unit):
            edge = back[place]
            steps.append((unit, edge))
            place = a[edge]
            on = place > begin[unit]
            place, unit = place[on], unit[on]
        if not steps:
            return np.zeros(len(units) + 1, np.int64), np.zeros(0, np.int32)
        unit, edge = (np.concatenate(x[::-1]) for x in zip(*steps))  # leftmost pieces first
        order = np.argsort(unit, kind="stable")
        unit, edge = unit[order], edge[order]
        # A piece is one id; a lone character is one id for each of its bytes.
        long = np.where(piece[edge] >= 0, 1, b[edge] - a[edge])
        owner = np.repeat(np.arange(len(edge)), long)
        byte = a[edge][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long)
        ids = np.where(piece[edge][owner] >= 0, self.ids[np.maximum(piece[edge][owner], 0)] if len(self.ids) else 0, self.bytes_at[flat[np.minimum(byte, len(flat) - 1)]])
        return np.concatenate(([0], np.cumsum(np.bincount(unit, long, len(units)).astype(np.int64)))), ids.astype(np.int32)

    def encode_all(self, texts: list[str], cache: Cache) -> list[np.ndarray]:
        known = len(cache.starts)
        parts = [self.units(t) for t in texts]
        places = [np.fromiter(map(cache.place.__getitem__, p), np.int32, len(p)) for p in parts]
        new = list(itertools.islice(cache.place, known, None))
        for i in range(0, len(new), 1 << 14):
            cache.add(*self.segment(new[i : i + (1 << 14)]))
        out = []
        for p in places:
            size = cache.sizes[p]
            out.append(cache.ids[np.repeat(cache.starts[p] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text], Cache())[0].tolist()

    def decode(self, ids) -> str:
        """Text of the pieces: bytes joined, marks as spaces, the first space dropped."""
        text = b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


APART = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
WHOLE = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", cached: int = 120_000) -> DataFrame:
    """One row per row of docs: id, token_ids, n_tokens, n_fallback (byte pieces) and round_trip.

    round_trip: decoding gives the text back. It is false only for texts that hold the mark U+2581
    itself. A null text has null ids, no tokens and a null round_trip; an empty one has no ids.
    Units are cached per task, at most `cached` of them and those of one block.
    """

    def run(batches):
        cache = Cache()
        is_byte = np.zeros(len(vocabulary.pieces), bool)
        is_byte[vocabulary.bytes_at] = True
        for batch in slices(batches, 2 << 20):
            texts = batch.column(1).to_pylist()
            if len(cache.place) > cached:
                cache = Cache()
            ids = vocabulary.encode_all([t or "" for t in texts], cache)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            fell = np.concatenate(([0], np.cumsum(is_byte[flat])))[offsets]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append([t is None for t in texts], False)), pa.array(flat))
            same = [None if t is None else vocabulary.decode(x.tolist()) == t for t, x in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(np.diff(fell)), pa.array(same, pa.bool_())], names)

    lean(docs.sparkSession)
    names = [id_col, "token_ids", "n_tokens", "n_fallback", "round_trip"]
    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"{id_col} long, token_ids array<int>, n_tokens long, n_fallback long, round_trip boolean")


def decode(tokens: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id and text of token ids; null ids give a null text, no ids an empty one."""

    def run(batches):
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"{id_col} long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all whole documents, decoded again; null texts, repeated rows and null ids as encode() has them."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.load())
