"""Secret scans: probabilistic automata inferred from labelled credentials score all candidates."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices

# The base patterns of the contract. Letters of assign match in either case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones fail as a whole
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")

CANDIDATE = re.compile(r"[A-Za-z0-9_+/-]{16,}(?:\.[A-Za-z0-9_+/-]{4,})*")
DELIMITER = re.compile(r"[/_+.-]")

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = UPPER + LOWER + DIGIT

#: Public credential formats as (literal or (alphabet, counts) parts); labelled samples are drawn from them.
FORMATS = {
    "github": ("gh", ("pousr", 1), "_", (ALNUM, 36)),
    "slack": ("xox", ("bpars", 1), "-", (DIGIT, 10, 11, 12, 13), "-", (DIGIT, 10, 11, 12, 13), "-", (ALNUM, 24)),
    "google": ("AIza", (ALNUM + "-_", 35)),
    "stripe": (("sr", 1), "k_live_", (ALNUM, 24)),
    "npm": ("npm_", (ALNUM, 36)),
    "gitlab": ("glpat-", (ALNUM + "-_", 20)),
    "session": ("ASIA", (UPPER + "234567", 16)),
    "jwt": ("eyJ", (ALNUM + "-_", 17, 33, 48, 80), ".eyJ", (ALNUM + "-_", 30, 60, 120, 240), ".", (ALNUM + "-_", 43, 64, 86, 342)),
}


def labelled(seed: int = 7, each: int = 240) -> dict[str, list[str]]:
    """`each` seeded sample credentials of each format."""
    rng = random.Random(seed)
    draw = lambda part: part if isinstance(part, str) else "".join(rng.choices(part[0], k=part[1] if len(part) == 2 else rng.choice(part[1:])))
    return {kind: ["".join(map(draw, parts)) for _ in range(each)] for kind, parts in FORMATS.items()}


class Automaton:
    """A probabilistic automaton by merging prefix-tree states whose statistics agree.

    States of the prefix tree next to kept ones are met by falling sample count. Of the kept states
    that a Hoeffding bound at level alpha can't tell from it (ends, following symbols and,
    recursively, successors), a state is merged into the one under which its symbols are likeliest;
    if there is none, it is kept itself.
    """

    def __init__(self, samples: list[str], alpha: float = 0.001):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.lengths: dict[int, int] = {}
        for s in samples:
            at = 0
            for c in s:
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.taken.append({})
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] += 1
            self.lengths[len(s)] = self.lengths.get(len(s), 0) + 1
        self.samples = len(samples)
        self._merge()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.taken[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 < n2 and abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if self._differ(self.taken[a].get(c, 0), n, self.taken[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, q: int) -> None:
        todo = [(into, q)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.taken[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _fit(self, into: int, q: int) -> float:
        """Mean log-likelihood of q's symbols and ends under the state `into`."""
        n, m = self._total(q), self._total(into)
        likely = lambda k: math.log(max(k, 1e-3) / m)
        return (self.ends[q] * likely(self.ends[into]) + sum(k * likely(self.taken[into].get(c, 0)) for c, k in self.taken[q].items())) / n

    def _merge(self) -> None:
        kept, known = [0], {0}
        while True:
            fringe = {self.next[r][c]: (r, c) for r in kept for c in self.next[r] if self.next[r][c] not in known}
            if not fringe:
                break
            q = max(fringe, key=lambda x: (self._total(x), -x))
            r, c = fringe[q]
            fits = [k for k in kept if self._compatible(k, q)]
            if not fits:
                kept.append(q)
                known.add(q)
            else:
                into = max(fits, key=lambda k: (self._fit(k, q), -k))
                self.next[r][c] = into
                self._fold(into, q)
        self.states = kept

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Next state and log-probability by state and byte, end log-probability, length log-probability.

        Samples of one length bind to it; of several, only the end probability decides (one entry, 0)."""
        place = {q: i for i, q in enumerate(self.states)}
        go = np.full((len(place) + 1, 128), len(place), np.int32)
        cost = np.full((len(place) + 1, 128), -np.inf)
        end = np.full(len(place) + 1, -np.inf)
        for q, i in place.items():
            taken, onward = dict(self.taken[q]), dict(self.next[q])
            for kind in (UPPER, LOWER, DIGIT):  # three of a class seen: half a sample for each one unseen
                seen = [c for c in kind if c in taken]
                if len(seen) >= 3:
                    taken |= {c: 0.5 for c in kind if c not in taken}
                    onward = {c: onward[seen[0]] for c in kind} | onward
            n = self.ends[q] + sum(taken.values())
            for c, k in taken.items():
                go[i, ord(c)], cost[i, ord(c)] = place[onward[c]], math.log(k / n)
            if self.ends[q]:
                end[i] = math.log(self.ends[q] / n)
        if len(self.lengths) > 1:
            return go, cost, end, np.zeros(1)
        longest = max(self.lengths)
        length = np.full(longest + 2, -np.inf)
        for n, k in self.lengths.items():
            length[n] = math.log(k / self.samples)
        return go, cost, end, length


@lru_cache(maxsize=2)
def model(seed: int = 7, each: int = 240) -> dict[str, tuple]:
    return {kind: Automaton(found).tables() for kind, found in labelled(seed, each).items()}


def matches(text: str, automata: dict[str, tuple], least: float) -> list[tuple[int, int, int]]:
    """(start, format index, end) of the parts of a candidate that some format scores `least` or more, apart from each other.

    A part starts at the candidate's start or after a delimiter, and ends at its end or before one. Its
    score is its log-likelihood under the format, less that under 64 even symbols. From the left, the
    longest part is taken, under the format that scores best.
    """
    starts = [0, *(m.end() for m in DELIMITER.finditer(text))]
    stops = {*(m.start() for m in DELIMITER.finditer(text)), len(text)}
    codes, found, after = text.encode("ascii"), [], 0
    for a in starts:
        if a < after or len(text) - a < 16:
            continue
        best = None
        for k, (go, cost, end, length) in enumerate(automata.values()):
            state, total = 0, 0.0
            for p in range(a, len(text)):
                step = cost[state, codes[p]]
                if step == -math.inf:
                    break
                total += step + math.log(64)
                state = go[state, codes[p]]
                if p + 1 in stops and p + 1 - a >= 16:
                    value = total + end[state] + length[min(p + 1 - a, len(length) - 1)]
                    if value >= least:
                        best = max(best or (0,), (p + 1, value, -k))
        if best:
            after = best[0]
            found.append((a, -best[2], after))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(texts: list[str], automata: dict[str, tuple], least: float) -> list[tuple[list, list]]:
    """Base and added spans of each text. Added: parts of candidates that a format scores `least`
    or more and that no base span covers."""
    kinds = (*BASE_KINDS, *automata)
    base = [base_spans(t) for t in texts]
    reach = [np.maximum.accumulate([b for _, _, b in spans]) if spans else None for spans in base]  # sorted by start: how far those up to here go
    more: list[list] = [[] for _ in texts]
    known: dict[str, list] = {}
    for i, t in enumerate(texts):
        for m in CANDIDATE.finditer(t):
            if m.group() not in known:
                known[m.group()] = matches(m.group(), automata, least)
            for a, k, b in known[m.group()]:
                a, b = a + m.start(), b + m.start()
                before = bisect.bisect_right(base[i], a, key=lambda x: x[0])
                if not before or reach[i][before - 1] < b:
                    more[i].append((a, len(BASE_KINDS) + k, b))
    show = lambda spans: [(kinds[k], a, b) for a, k, b in spans]
    return [(show(b), show(sorted(b + m))) for b, m in zip(base, more)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 2.0, redacted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id, n_assign, n_access, n_hex, base_sha256, spans and n_added.

    A null text is empty: no span, the digest of an empty string. Offsets are code points, end
    exclusive. `least` is the log-likelihood ratio, in nats, from which a candidate is added.
    redacted=True adds `redacted`, the text with every span replaced (null stays null); the columns
    `keep` of docs follow the id. Nothing depends on other rows, so hot keys don't matter.
    """
    lean(docs.sparkSession)
    automata = model()

    def run(batches):
        for batch in slices(batches):
            whole = batch.column("_text")
            texts = pc.fill_null(whole, "").to_pylist()
            found = scan(texts, automata, least)
            counts = [[sum(k == kind for k, _, _ in b) for b, _ in found] for kind in BASE_KINDS]
            columns = [*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in counts],
                       pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()),
                       pa.array([joined(s) for _, s in found], pa.string()),
                       pa.array([len(s) - len(b) for b, s in found], pa.int64())]
            if redacted:
                columns.append(pa.array([None if x is None else redact(x, s) for x, (_, s) in zip(whole.to_pylist(), found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    fields = [*kept, "n_assign long", "n_access long", "n_hex long", "base_sha256 string", "spans string", "n_added long", *["redacted string"] * redacted]
    names = [*chosen.columns[:-1], *(x.split()[0] for x in fields[len(kept) :])]
    return chosen.mapInArrow(run, ", ".join(fields))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many base matches of each kind the scan finds in each document."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_assign", "n_access", "n_hex")


COUNTS_SQL = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex
FROM documents
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all whole documents. Repeated rows and rows without an id are scanned like others."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
