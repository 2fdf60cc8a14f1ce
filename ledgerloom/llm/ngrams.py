"""Language-model scores from a sharded Elias-Fano trie of trigrams.

The model is a trigram model with interpolated absolute discounting; its lowest order is the add-one
unigram of the base score. Words are 64-bit hashes. The trie is sharded by the middle word v of a
trigram (u, v, w), so that what P(w | u, v) needs of v stands in one shard. A frequent v is split by a
hash of u into parts of about BUCKET training tokens. What a shard's own trigrams can't tell is counted apart and
sent to it: the counts of its words w that the list of frequent words lacks, and, of a split v, how often
each of its w follows v anywhere. So splits and lists are matters of transport, and no probability depends on them.

Training n-grams and queries travel in one shuffle, packed by (block of texts, shard); each shard
builds its levels in a memory-mapped file, answers its distinct queries and returns sums by text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, lean, remainder, scratch_path, slices, texts_of
from .eliasfano import EliasFano, Quantised, Store

LISTED = 1 << 18
BUCKET = 1 << 22
SHARD = 1_200_000
BLOCK = 12 << 20
LEVELS = 250_000
D2, D3 = 0.8, 0.9
SEED = 42

#: Marks that no word can be, as words hold no space.
START, END = (xxhash.xxh64_intdigest(x, SEED) for x in (b" start", b" end"))


def _hashes(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, SEED) for w in words), np.uint64)


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (a >> np.uint64(32))


@dataclass
class Unigrams:
    """Training totals, and hash, count and rank of the most frequent words, by hash."""

    tokens: int
    types: int
    texts: int
    top: np.ndarray
    counts: np.ndarray
    bucket: int = BUCKET
    #: Of words that are split: how many words follow them in training, by hash.
    followers: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.by_rank = np.lexsort((self.top, -self.counts))
        self.rank = np.empty(len(self.top), np.int64)
        self.rank[self.by_rank] = np.arange(len(self.top))

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of frequent words, -1 for others."""
        if not len(self.top):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        return np.where(self.top[at] == hashes, self.rank[at], -1)

    def pack(self, ranks: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes]:
        """Words as gaps between ascending ranks, and hashes of the others."""
        return _shrink(np.diff(ranks, prepend=0)), hashes.tobytes()

    def unpack(self, frequent: bytes, others: bytes) -> np.ndarray:
        ranks = np.cumsum(_grow(frequent), dtype=np.int64)
        return np.concatenate((self.top[self.by_rank[ranks]], np.frombuffer(others, np.uint64)))

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        if not len(self.top):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        return np.where(self.top[at] == hashes, self.counts[at], 0)

    def contexts(self, hashes: np.ndarray) -> np.ndarray:
        """How often frequent words, and a text's start, are a context."""
        return np.where(hashes == np.uint64(START), self.texts, self.count(hashes))

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        """Into how many parts each context word is split."""
        return np.maximum(1, -(-self.contexts(hashes) // self.bucket))

    @property
    def any_split(self) -> bool:
        return max(self.texts, int(self.counts.max(initial=0))) > self.bucket

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.types + 1)


def _count_words(batches):
    """(h, c) of the words and ends of training texts, summed within the task as memory allows."""
    counts: Counter[bytes] = Counter()
    texts = 0

    def flush():
        words = list(counts)
        h = np.append(_hashes(words), np.uint64(END))
        c = np.append(np.fromiter(counts.values(), np.int64, len(words)), texts)
        keep = c > 0
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(c[keep])], ["h", "c"])

    for batch in slices(batches, 4 << 20):
        for text in texts_of(batch.column(0)):
            counts.update(text.lower().split())
            texts += 1
        if len(counts) > 300_000:
            yield flush()
            counts, texts = Counter(), 0
    yield flush()


def unigrams(training: DataFrame, exact: int = LISTED, bucket: int = BUCKET) -> Unigrams:
    """Totals over all training texts, and the words whose count is at least the one that `exact` words reach."""
    spark = training.sparkSession
    path = scratch_path(spark, "words")
    training.mapInArrow(_count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).write.parquet(path)
    words = spark.read.parquet(path)
    # Counts below 2^10 one by one, above in steps of a 1024th: a few thousand rows at any size.
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(F.expr("cast(shiftleft(shiftright(c, greatest(0, length(bin(c)) - 11)), greatest(0, length(bin(c)) - 11)) as bigint)"))
    shape = sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect(), reverse=True)
    tokens, types = sum(r["c"] for r in shape), sum(r["n"] for r in shape)
    least, held = None, 0
    for r in shape:
        held += r["n"]
        if held > exact:
            break
        least = r["s"]
    texts = words.where(F.col("h") == np.uint64(END).astype(np.int64).item()).agg(F.sum("c")).first()[0] or 0
    top = words.where(F.col("c") >= least).toArrow() if least is not None else None
    h = top.column("h").to_numpy().view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    c = top.column("c").to_numpy() if top is not None else np.zeros(0, np.int64)
    order = np.argsort(h)
    forget(spark, path)
    return Unigrams(tokens, types, texts, h[order], c[order], bucket)


def _shrink(a: np.ndarray) -> bytes:
    """Integers from 0 to 2^31 - 1 as four byte planes, compressed."""
    a = a.astype(np.uint32)
    return zstandard.compress(b"".join((a >> np.uint32(8 * p)).astype(np.uint8).tobytes() for p in range(4)), 1)


def _grow(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).astype(np.int32)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


class _Places(dict):
    """A word's place, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_PACKED = "block long, shard int, ids array<long>, train binary, frequent binary, others binary, v binary, part binary, runs binary, u binary, w binary, doc binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 9]


@dataclass
class _Block:
    """The trigrams of a block of texts: places in `hashes` of u, v and w, text, part and shard of each token.

    Frequent words come first in `hashes`, by rank, so that small numbers are the common ones.
    """

    hashes: np.ndarray
    ranks: np.ndarray
    sizes: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    doc: np.ndarray
    part: np.ndarray
    split: np.ndarray
    shard: np.ndarray


def _block(known: Unigrams, shards: int, texts: list[bytes]) -> _Block:
    local = _Places()
    place = local.__getitem__
    docs = [np.fromiter(map(place, t.lower().split()), np.int32) for t in texts]
    hashes = np.append(_hashes(local), np.array([START, END], np.uint64))
    start, end = len(local), len(local) + 1
    del local, place
    ranks = known.ranks(hashes)
    better = np.lexsort((hashes, ranks, ranks < 0))
    hashes, ranks = hashes[better], ranks[better]
    turned = np.empty(len(better), np.int32)
    turned[better] = np.arange(len(better))
    docs = [turned[d] for d in docs]
    start, end = int(turned[start]), int(turned[end])
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    first = np.cumsum(sizes + 3) - (sizes + 3)  # of each text: two starts, its words, one end
    flat = np.full(int((sizes + 3).sum()), start, np.int32)
    is_token = np.ones(len(flat), bool)
    is_token[first] = is_token[first + 1] = False
    is_token[first + sizes + 2] = False
    flat[is_token] = np.concatenate(docs)
    is_token[first + sizes + 2] = True
    flat[first + sizes + 2] = end
    at = np.flatnonzero(is_token)
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), sizes + 1)
    u, v, w = flat[at - 2], flat[at - 1], flat[at]
    buckets = known.buckets(hashes)
    part = np.zeros(len(v), np.uint16)
    split = np.flatnonzero(buckets[v] > 1)
    # Before a text's first word stands nothing that could tell its parts apart, so there the word itself does.
    left = np.where(v[split] == start, w[split], u[split])
    part[split] = _mix(hashes[left]) % buckets[v[split]].astype(np.uint64)
    shard = (_mix(hashes) % np.uint64(shards)).astype(np.int64)[v]
    shard[split] = (_mix(_mix(hashes[v[split]]) + part[split]) % np.uint64(shards)).astype(np.int64)
    return _Block(hashes, ranks, sizes, u, v, w, doc, part, split, shard)


def _trained(column: pa.Array) -> np.ndarray:
    return np.array(column.to_numpy(zero_copy_only=False), bool)


def _pack(known: Unigrams, shards: int):
    """Over (id, train, text): for each block of texts a row for every shard that it has trigrams of,
    and one with its ids, training marks and token counts (v is null there)."""

    def block_rows(block: int, ids, train: np.ndarray, texts: list[bytes]):
        b = _block(known, shards, texts)
        hashes, ranks, sizes, u, v, w, doc, part, shard = b.hashes, b.ranks, b.sizes, b.u, b.v, b.w, b.doc, b.part, b.shard
        n_frequent = int((ranks >= 0).sum())
        # By shard, then v and its part; the place in the block keeps texts in order.
        tied = (v.astype(np.int64) << 32) | np.arange(len(v))
        home = int(_mix(np.array([block], np.uint64))[0] % np.uint64(shards))
        yield (block, home, ids, np.packbits(train).tobytes(), sizes.tobytes(), *[None] * 7)
        by_shard = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        cuts = np.searchsorted(shard[by_shard], np.arange(shards + 1))
        del shard, b
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            pick = np.sort(tied[by_shard[cuts[s] : cuts[s + 1]]]) & ((1 << 32) - 1)
            if part[pick].any():
                pick = pick[np.lexsort((part[pick], v[pick]))]
            a, m, c, p = u[pick], v[pick], w[pick], part[pick]
            heads = np.concatenate(([0], np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1])) + 1))
            used = np.zeros(len(hashes), bool)
            used[a] = used[m] = used[c] = True
            narrow = np.cumsum(used, dtype=np.int32) - 1
            yield (
                block, s, None, np.packbits(train[doc[pick]]).tobytes(),
                *known.pack(ranks[:n_frequent][used[:n_frequent]], hashes[n_frequent:][used[n_frequent:]]), _shrink(narrow[m[heads]]), _shrink(p[heads]),
                _shrink(np.diff(np.append(heads, len(pick)))), _shrink(narrow[a]), _shrink(narrow[c]), _shrink(doc[pick]),
            )

    def run(batches):
        n = 0
        task = TaskContext.get().partitionId()
        for batch in slices(batches, BLOCK):
            rows = block_rows((task << 32) + n, batch.column(0).to_pylist(), _trained(batch.column(1)), texts_of(batch.column(2)))
            n += 1
            yield from _packed(rows)

    return run


def _packed(rows, most: int = 8):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TYPES)], _NAMES)


_ASKED = "v long, w long, shard int, n long"


def _ask(known: Unigrams, shards: int):
    """Over (id, train, text): what shards need to be told, as (v, w, shard, n) with n training tokens of this block.

    v is null for the words w that aren't listed, else it is split and w follows it. A shard asks for
    all its tokens, training or not, so n may be zero; the n of all rows of (v, w) add up to its count.
    """

    def run(batches):
        for batch in slices(batches, BLOCK):
            train = _trained(batch.column(1))
            b = _block(known, shards, texts_of(batch.column(2)))
            n = train[b.doc].astype(np.int64)
            for on, head in ((np.flatnonzero(b.ranks[b.w] < 0), None), (b.split, b.v)):
                if not len(on):
                    continue
                key = b.w[on].astype(np.int64) * shards + b.shard[on]
                key, again = np.unique(key, return_inverse=True)
                if head is not None:
                    key, again = np.unique(head[on].astype(np.int64) * len(key) + again, return_inverse=True)
                first = np.empty(len(key), np.int64)  # a token of each key
                first[again] = on
                total = np.bincount(again, n[on], len(key)).astype(np.int64)
                v = pa.nulls(len(key), pa.int64()) if head is None else pa.array(b.hashes[b.v[first]].view(np.int64))
                yield pa.RecordBatch.from_arrays([v, pa.array(b.hashes[b.w[first]].view(np.int64)), pa.array(b.shard[first].astype(np.int32)), pa.array(total)], ["v", "w", "shard", "n"])

    return run


def _answer(batches):
    """Over all rows of some (v, w): packed rows for each shard that asked, with the counts over all shards."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    pair = np.asarray(table.column("v").is_valid())
    v, w, shard, n = (table.column(c).fill_null(0).to_numpy() for c in ("v", "w", "shard", "n"))
    order = np.lexsort((w, v, pair))
    pair, v, w, shard, n = pair[order], v[order], w[order], shard[order], n[order]
    s = _starts(pair, v, w)
    total = np.repeat(np.add.reduceat(n, s), np.diff(np.append(s, len(v))))
    order = np.lexsort((w, v, pair, shard))
    pair, v, w, shard, total = pair[order], v[order], w[order], shard[order], total[order]
    keep = _starts(shard, pair, v, w)
    pair, v, w, shard, total = pair[keep], v[keep], w[keep], shard[keep], total[keep]
    s = _starts(shard)
    rows = (
        (-1, int(shard[a]), None, np.packbits(pair[a:b]).tobytes(), None, w[a:b].tobytes(), v[a:b][pair[a:b]].tobytes(), zstandard.compress(total[a:b].tobytes(), 1), *[None] * 4)
        for a, b in zip(s.tolist(), np.append(s[1:], len(v)).tolist())
    )
    yield from _packed(rows, 64)


def _told(rows: list[dict]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(w, n) of single words and (v, w, n) of pairs, each sorted, from what _answer() packed for a shard."""
    one, two = [], []
    for r in rows:
        w = np.frombuffer(r["others"], np.uint64)
        pair = np.unpackbits(np.frombuffer(r["train"], np.uint8), count=len(w)).astype(bool)
        n = np.frombuffer(zstandard.decompress(r["part"]), np.int64)
        one.append((w[~pair], n[~pair]))
        two.append((np.frombuffer(r["v"], np.uint64), w[pair], n[pair]))
    whole = lambda parts, k: tuple(np.concatenate([np.zeros(0, np.uint64 if i < k - 1 else np.int64), *(p[i] for p in parts)]) for i in range(k))
    w, n = whole(one, 2)
    order = np.argsort(w)
    pv, pw, pn = whole(two, 3)
    by = np.lexsort((pw, pv))
    return (w[order], n[order]), (pv[by], pw[by], pn[by])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before; the first row does."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    other = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        other |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(other) + 1))


def _order(v: np.ndarray, u: np.ndarray, w: np.ndarray, contexts: int, words: int) -> np.ndarray:
    """Sorts by v, u, w: by one 64-bit key where it has room for them."""
    if contexts * words * words < 1 << 62:
        return np.argsort((v.astype(np.int64) * words + u) * words + w)
    return np.lexsort((w, u, v))


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n rows, from where groups start."""
    mark = np.zeros(n, np.int64)
    mark[starts[1:]] = 1
    return np.cumsum(mark)


class Trie:
    """Levels over one shard's training trigrams: contexts v, words w after v, contexts u before v, words w after u v.

    Contexts that are `alone` have no u before them: a text's start, after which a word is as likely as after v.
    Every level is an Elias-Fano sequence of context-relative keys: a child's word, moved by its
    context's place times the number of words, or, below u v, its rank among the words after v, moved
    by a running sum of such ranks. Probabilities and back-off weights are one-byte codes.
    """

    def __init__(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, contexts: int, words: int, unigram: np.ndarray, split: tuple[np.ndarray, ...] | None = None, alone: np.ndarray | None = None):
        """v, u, w: distinct trigrams, sorted; n: their counts.

        split: of contexts whose trigrams are elsewhere too, sorted: which, their counts and numbers of followers
        over all shards, and (v, w, n) of the pairs that this shard asks for, sorted; a pair's n is not zero.
        """
        self.store, self.words = Store(), words
        put, size = self.store, len(v)
        add = lambda x, starts: np.add.reduceat(x, starts) if len(x) else np.zeros(0, np.int64)
        whole, whole_n, whole_types, pv, pw, pn = split or [np.zeros(0, np.int64)] * 6
        heads = np.union1d(v, whole).astype(np.int64)
        of_v = np.searchsorted(heads, v)
        is_split = np.zeros(len(heads), bool)
        is_split[np.searchsorted(heads, whole)] = True
        n_v = np.bincount(of_v, n, len(heads)).astype(np.int64)
        n_v[is_split] = whole_n
        third = np.flatnonzero(~alone[v]) if alone is not None else np.arange(size)
        s = _starts(v[third], u[third])
        of_uv, n_uv, types_uv = _spread(s, len(third)), add(n[third], s), np.diff(np.append(s, len(third)))
        context, above = of_v[third][s] * words + u[third][s], of_v[third][s]
        own = ~is_split[of_v]
        key, key_n = of_v[own] * words + w[own], n[own]
        order = np.argsort(key)
        key, key_n = key[order], key_n[order]
        s = _starts(key)
        pair, n_vw = np.concatenate((key[s], np.searchsorted(heads, pv) * words + pw)), np.concatenate((add(key_n, s), pn))
        order = np.argsort(pair)
        pair, n_vw = pair[order], n_vw[order]
        of_v, n = of_v[third], n[third]
        of_vw = np.searchsorted(pair, of_v * words + w[third])
        del key, key_n, order, own
        up = pair // words
        held_v = np.bincount(up, minlength=len(heads))
        types_v = held_v.copy()
        types_v[is_split] = whole_types
        first = np.concatenate(([0], np.cumsum(held_v)))
        weight_v = D2 * types_v / n_v
        p2 = (n_vw - D2) / n_v[up] + weight_v[up] * unigram[pair - up * words]
        moved = np.concatenate(([0], np.cumsum(held_v[above])))
        weight_uv = D3 * types_uv / n_uv
        p3 = (n - D3) / n_uv[of_uv] + weight_uv[of_uv] * p2[of_vw]
        self.heads = EliasFano(put, heads, contexts)
        self.pairs = EliasFano(put, pair, len(heads) * words)
        self.first = EliasFano(put, first, len(pair) + 1)
        self.contexts = EliasFano(put, context, len(heads) * words)
        self.moved = EliasFano(put, moved, int(moved[-1]) + 1)
        self.triples = EliasFano(put, moved[of_uv] + of_vw - first[of_v], int(moved[-1]) + 1)
        self.weight_v, self.p2 = Quantised(put, np.log10(weight_v)), Quantised(put, np.log10(p2))
        self.weight_uv, self.p3 = Quantised(put, np.log10(weight_uv)), Quantised(put, np.log10(p3))
        put.seal()

    def score(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 P(w | u, v) of distinct queries, sorted; unigram: log10 by word."""
        out = unigram[w]
        s = _starts(v)
        r_of, of_v = self.heads.find(v[s].astype(np.int64)), _spread(s, len(v))
        s = _starts(v, u)
        r_at, of_uv = r_of[of_v[s]], _spread(s, len(v))
        c_of = np.full(len(s), -1, np.int64)
        seen = np.flatnonzero(r_at >= 0)
        c_of[seen] = self.contexts.find(r_at[seen] * self.words + u[s[seen]])
        on = np.flatnonzero(r_of[of_v] >= 0)
        if not len(on):
            return out
        r = r_of[of_v[on]]
        pair = self.pairs.find(r * self.words + w[on])
        out[on] = np.where(pair >= 0, self.p2[np.maximum(pair, 0)], self.weight_v[r] + out[on])
        # From here on, contexts u v that were seen.
        inside = np.flatnonzero(c_of[of_uv[on]] >= 0)
        if not len(inside):
            return out
        known = np.flatnonzero(c_of >= 0)
        base = np.zeros(len(c_of), np.int64)
        base[known] = self.moved.access(c_of[known]) - self.first.access(r_at[known])
        on, pair = on[inside], pair[inside]
        c = of_uv[on]
        triple = np.full(len(on), -1, np.int64)
        both = np.flatnonzero(pair >= 0)
        triple[both] = self.triples.find(base[c[both]] + pair[both])
        out[on] = np.where(triple >= 0, self.p3[np.maximum(triple, 0)], self.weight_uv[c_of[c]] + out[on])
        return out


_SUMS = "block long, ids array<long>, train binary, sizes binary, doc binary, score binary, base binary, known binary"


def _score_shards(known: Unigrams, levels: int = LEVELS):
    """Over all packed rows of some shards: the sums by text of each packed row; rows with ids pass through."""
    names, types = [x.split()[0] for x in _SUMS.split(", ")], [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 6]

    def one(rows: list[dict], told: list[dict]):
        dictionaries = [known.unpack(r["frequent"], r["others"]) for r in rows]
        words = np.sort(np.concatenate(dictionaries))
        words = words[_starts(words)]
        u, w, heads, runs, text, train, texts = [], [], [], [], [], [], 0
        for r, d in zip(rows, dictionaries):
            place = np.searchsorted(words, d).astype(np.int32)
            u.append(place[_grow(r["u"])])
            w.append(place[_grow(r["w"])])
            runs.append(_grow(r["runs"]))
            heads.append(place[_grow(r["v"])].astype(np.int64) << 16 | _grow(r["part"]))
            doc = _grow(r["doc"])
            train.append(np.unpackbits(np.frombuffer(r["train"], np.uint8), count=len(doc)).astype(bool))
            text.append(doc + texts)
            r["texts"] = (texts, texts := texts + int(doc.max()) + 1)
            for name in ("u", "w", "v", "runs", "part", "doc", "frequent", "others", "train"):
                r[name] = None
        del dictionaries
        u, w, text, train = map(np.concatenate, (u, w, text, train))
        # A context is a word and its part; contexts are numbered within the shard.
        word, back = np.unique(np.concatenate(heads), return_inverse=True)
        v = np.repeat(back.astype(np.int32), np.concatenate(runs))
        hash_of = words[word >> 16]
        del heads, runs, back
        (single, single_n), (pair_v, pair_w, pair_n) = _told(told)
        told.clear()
        word_n = known.count(words)
        if len(single):
            at = np.minimum(np.searchsorted(single, words), len(single) - 1)
            word_n = np.where(single[at] == words, single_n[at], word_n)
        unigram = known.probability(word_n)
        log_unigram = np.log10(unigram)
        # Counts of v as a word: those of its trigrams, or the global one where it has parts.
        counts = np.bincount(v[train], minlength=len(word))
        is_split = known.buckets(hash_of) > 1
        counts = np.where(is_split, known.count(hash_of), counts)
        is_word = hash_of != np.uint64(START)
        base = np.where(is_word, np.log10(counts + 1.0), 0.0)
        n_known = np.where(is_word & (counts > 0), 1, 0)
        sums = [np.zeros(texts), np.bincount(text, base[v], texts), np.bincount(text, n_known[v], texts)]

        def whole(j: int, k: int):
            """What the j-th of k tries must be told of its split contexts that were seen in training."""
            ids = np.flatnonzero(is_split)
            ids = ids[ids % k == j]
            if not len(ids):
                return None
            a, b = np.searchsorted(pair_v, hash_of[ids]), np.searchsorted(pair_v, hash_of[ids], side="right")
            rows = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
            rows_of = np.repeat(ids // k, b - a)
            places = np.searchsorted(words, pair_w[rows])
            here = (pair_n[rows] > 0) & (places < len(words))
            here[here] &= words[places[here]] == pair_w[rows][here]
            return ids // k, known.contexts(hash_of[ids]), np.array([known.followers[int(h)] for h in hash_of[ids]], np.int64), rows_of[here], places[here], pair_n[rows][here]

        # A trie for every k-th context: its arrays stay in the processor's caches.
        k = max(1, len(v) // levels)
        share = v % k
        is_start = np.flatnonzero(~is_word)
        for j in range(k):
            own = np.flatnonzero(share == j)
            su, sv, sw = u[own], v[own] // k, w[own]
            order = _order(sv, su, sw, len(word) // k + 1, len(words))
            su, sv, sw, own = su[order], sv[order], sw[order], own[order]
            s = _starts(sv, su, sw)
            if not len(s):
                continue
            copies = np.diff(np.append(s, len(sv)))
            n = np.add.reduceat(train[own].astype(np.int64), s)
            qv, qu, qw = sv[s], su[s], sw[s]
            t = np.flatnonzero(n)
            alone = np.zeros(len(word) // k + 1, bool)
            alone[is_start[is_start % k == j] // k] = True
            trie = Trie(qv[t], qu[t], qw[t], n[t], len(word) // k + 1, len(words), unigram, whole(j, k), alone)
            sums[0] += np.bincount(text[own], np.repeat(trie.score(qv, qu, qw, log_unigram), copies), texts)
        some = np.bincount(text, minlength=texts) > 0
        for r in rows:
            a, b = r["texts"]
            docs = np.flatnonzero(some[a:b])
            yield (r["block"], None, None, None, _shrink(docs), sums[0][a:b][docs].tobytes(), sums[1][a:b][docs].tobytes(), _shrink(sums[2][a:b][docs].astype(np.int64)))

    def run(batches):
        held: dict[int, list[dict]] = {}
        told: dict[int, list[dict]] = {}
        out = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] == -1:
                    told.setdefault(r["shard"], []).append(r)
                elif r["v"] is None:
                    out.append((r["block"], r["ids"], r["train"], r["frequent"], *[None] * 4))
                else:
                    held.setdefault(r["shard"], []).append(r)
        for i in range(0, len(out), 4):
            yield batch_of(out[i : i + 4])
        for shard in list(held):
            yield batch_of(list(one(held.pop(shard), told.pop(shard, []))))

    return run


def _assemble(log_total: float, texts: int):
    """Over the rows of one block: a row for each text."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        n = len(head["ids"])
        sizes = np.frombuffer(head["sizes"], np.int64) + 1
        score, base, known = np.zeros(n), np.full(n, np.log10(texts + 1.0)), np.full(n, int(texts > 0), np.int64)
        for r in rows:
            if r["doc"] is None:
                continue
            doc = _grow(r["doc"])
            score[doc] += np.frombuffer(r["score"], np.float64)
            base[doc] += np.frombuffer(r["base"], np.float64)
            known[doc] += _grow(r["known"])
        train = np.unpackbits(np.frombuffer(head["train"], np.uint8), count=n).astype(bool)
        return pa.table({
            "id": pa.array(head["ids"], pa.int64()), "held_out": pa.array(~train), "n_tokens": sizes, "n_known": known,
            "base_score": base - sizes * log_total, "score": score,
        })

    return run


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", exact: int = LISTED, bucket: int = BUCKET, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    `training` is a condition on docs; the model learns from the texts of its rows and scores all. A
    null text is empty: one token, its end. n_known counts tokens seen in training, base_score is the
    add-one unigram log10 probability, score the trie's. Without training rows all is unseen. Repeated
    rows and rows without an id are scored like others.

    docs must give the same rows in the same partitions when it is read again, as a table or a checkpoint
    does. Every n-gram of every training text counts, nothing is pruned, and `exact`, `bucket`, `shard` and
    `levels` change only what travels where. Memory of a task is one block of texts (BLOCK bytes, a longer text alone)
    or one shard: about `shard` tokens, and those of a context word that is not split (`bucket`, or the last listed
    word's count). A pair (u, v) is not split further; a text's first word has no pair before it, only the start, whose words are dealt out by themselves.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    lean(docs.sparkSession)
    known = unigrams(chosen.where("train").select("text"), exact, bucket)
    total = chosen.count()
    shards = max(1, -(-int(known.tokens * max(1, total) / max(1, known.texts)) // shard)) if known.texts else 1
    asked = chosen.mapInArrow(_ask(known, shards), _ASKED)
    if known.any_split:
        # Of frequent words' followers: counts by shard first, so that a common pair is no hot key.
        pairs = cut(asked.where("v is not null").groupBy("v", "w", "shard").agg(F.sum("n").alias("n")))
        followers = pairs.where("n > 0").select("v", "w").distinct().groupBy("v").agg(F.count("*").alias("n")).collect()
        known.followers = {r["v"] % (1 << 64): r["n"] for r in followers}
        asked = asked.where("v is null").unionByName(pairs)
    answers = asked.repartition(shards, "v", "w").mapInArrow(_answer, _PACKED)
    packed = chosen.mapInArrow(_pack(known, shards), _PACKED).unionByName(answers)
    sums = packed.repartitionById(shards, "shard").mapInArrow(_score_shards(known, levels), _SUMS)
    fields = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = sums.groupBy("block").applyInArrow(_assemble(float(np.log10(known.tokens + known.types + 1)), known.texts), fields)
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Null texts are empty; repeated rows, null ids and very long texts are scored like
    others; an empty table gives no rows."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(F.col("doc_id"), 7) != 2)
