"""Conversation structure repair: signatures of roles and faults, each solved once, joined back and replayed."""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW, SPACE, cut, forget, lean, lookup, scratch_path

#: Rows and bytes of a segment: a longer conversation is several, so that no row of a table and no signature is a whole hot conversation.
ROWS, BYTES = 512, 4 << 20
#: A solved signature is sent so many times where the signatures are too many to broadcast, as many rows may share one.
SALTS = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: A row's character in a signature: 4 x role (s, u, a, other) + fault (none, blank, duplicate, truncated).
CODES = "ABCDEFGHIJKLMNOP"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Roles so far: none, the system's alone, ends with the user's, ends with the assistant's; the first and last are complete.
STATES = range(4)
ASKS = {0: 2, 1: 2, 3: 2, 2: 3}  # the next turn of the user or the assistant leads there


def _row(code: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest edits of one row by (state before, state after), ties ASCII-least, insertions before it included."""
    role, fault = divmod(CODES.index(code), 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(a: int, b: int, cost: int, edits: str) -> None:
        if (a, b) not in best or (cost, edits) < best[a, b]:
            best[a, b] = (cost, edits)

    for a in STATES:
        for before, at, paid in (("", a, 0), ("I", ASKS[a], INSERT)):
            offer(a, at, paid + DELETE, before + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            extra = paid + (TRUNCATED if fault == CUT else 0)
            to = ASKS[at]
            offer(a, to, extra + REROLE, before + "R")
            if role == to - 1:  # u where the user's turn is, a where the assistant's
                offer(a, to, extra + KEEP, before + "K")
            if role == 0 and at == 0 and not before:
                offer(a, 1, extra + KEEP, "K")
    return best


def _compose(x: dict, y: dict) -> dict:
    """Cheapest edits over two parts, ties ASCII-least. Edits fix the state and the cost, so of two cheapest edits of a part between
    the same states neither is the other's beginning, and the least whole is made of the least parts."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for (a, m), (cost, edits) in x.items():
        for b in STATES:
            if (m, b) in y:
                found = (cost + y[m, b][0], edits + y[m, b][1])
                if (a, b) not in best or found < best[a, b]:
                    best[a, b] = found
    return best


@functools.lru_cache(1 << 14)
def _solve(signature: str) -> dict:
    """Memoised recursion over halves: a run of equal rows is halved into equal parts."""
    if len(signature) == 1:
        return _row(signature)
    half = 1 << (len(signature) - 1).bit_length() - 1
    return _compose(_solve(signature[:half]), _solve(signature[half:]))


def _finish(a: int, table: dict) -> tuple[int, str]:
    """Cheapest edits from state a to a complete sequence, with an insertion at the end if need be."""
    ends = [table[a, b] for b in (0, 3) if (a, b) in table]
    if (a, 2) in table:
        ends.append((table[a, 2][0] + INSERT, table[a, 2][1] + "I"))
    return min(ends)


#: Of an empty conversation, and of none of its rows.
EMPTY = {(a, a): (0, "") for a in STATES}
LEGAL = {"su", "ua", "au"}


def facts(signature: str) -> tuple[int, int, int, int]:
    """Rows blank, duplicate, truncated, and adjacent roles that may not be."""
    places = [divmod(CODES.index(c), 4) for c in signature]
    roles = ["suao"[r] for r, _ in places]
    return (*(sum(f == k for _, f in places) for k in (BLANK, DUPLICATE, CUT)), sum(x + y not in LEGAL for x, y in zip(roles, roles[1:])))


SOLVED = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, steps array<struct<a:int,b:int,cost:long,edits:string>>"


def _solved(batches):
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            table = _solve(signature) if signature else EMPTY
            cost, audit = _finish(0, table)
            names = ("blank", "duplicate", "truncated", "illegal")
            steps = [{"a": a, "b": b, "cost": c, "edits": e} for (a, b), (c, e) in sorted(table.items())]
            rows.append({"signature": signature, **dict(zip(names, facts(signature))), "cost": cost, "audit": audit, "steps": steps})
        _solve.cache_clear()
        yield pa.RecordBatch.from_pylist(rows, schema=_SOLVED)


_SOLVED = pa.schema([("signature", pa.string()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("steps", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))])


def solve(signatures: DataFrame) -> DataFrame:
    """Each distinct signature once: its counts of faults, the cheapest edits of a whole conversation of that signature, and
    those between any two states, for conversations of several segments. An empty signature costs nothing."""
    return signatures.select("signature").distinct().mapInArrow(_solved, SOLVED)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: the row is dropped, 2: repeated) after seeded faults; null roles and texts are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


SEGMENT = "conv_id long, part int, place long, signature string, first long, last long, turns long, roles array<string>, texts array<string>, runs array<long>"
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("signature", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("turns", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("runs", pa.list_(pa.int64()))])


def _segments(batches, most: int):
    """Cuts sorted rows (conv_id, turn, role, text, code, again, copies) into segments of one conversation."""
    part, place, held, size = TaskContext.get().partitionId(), 0, [], 0

    def close():
        turns = [r["turn"] for r in held if r["copies"] and r["turn"] is not None]
        live = [r for r in held if r["copies"]]
        signature = "".join(r["code"] + r["again"] * (r["copies"] - 1) for r in live)
        row = {"conv_id": held[0]["conv_id"], "part": part, "place": place, "signature": signature, "first": turns[0] if turns else None, "last": turns[-1] if turns else None, "turns": len(set(turns))}
        row |= {"roles": [r["role"] for r in live], "texts": [r["text"] for r in live], "runs": [r["copies"] for r in live]}
        return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["conv_id"] != held[0]["conv_id"] or len(held) >= most or size >= BYTES):
                yield close()
                place, held, size = place + 1, [], 0
            held.append(r)
            size += len(r["text"] or "") + len(r["role"] or "")
    if held:
        yield close()


def segments(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """Conversations in order, cut into segments of at most `most` different rows; a conversation's order is (part, place).

    Rows equal in conversation, turn, role and text are one with a count before they move. A row is a duplicate unless
    its turn is the first with its role and text there, or it is a copy after the first; turns are told apart by the key of the join, so that a role and
    text which a conversation repeats without end is no one task's. The order is a range partitioning
    by conversation, turn, role and text, so a hot conversation is many tasks' work.
    """
    # Keys without nulls, so that the join finds rows where the grouping has put them.
    keys = ["no_conv", "conv", "no_turn", "at", "said", "digest"]
    gone = F.col("copies") == 0  # a dropped row only says that its conversation exists
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    full = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), *[F.when(gone, "").otherwise(F.coalesce(c, F.lit(" "))).alias(c) for c in ("role", "text")], "copies")
    hashed = full.select(F.col("conv_id").isNull().alias("no_conv"), zero("conv_id").alias("conv"), F.col("turn").isNull().alias("no_turn"), zero("turn").alias("at"), F.col("role").alias("said"), F.when(gone, "").otherwise(F.sha2("text", 256)).alias("digest"), "text", "copies")
    known = hashed.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    first = known.where("copies > 0").groupBy("no_conv", "conv", "said", "digest").agg(F.min(F.struct(~F.col("no_turn"), "at", "no_turn")).alias("x"))
    first = first.select("no_conv", "conv", F.col("x.no_turn").alias("no_turn"), F.col("x.at").alias("at"), "said", "digest", F.lit(True).alias("is_first"))
    given = lambda no, c, name: F.when(~F.col(no), F.col(c)).alias(name)
    marked = known.join(first, keys, "left").select(given("no_conv", "conv", "conv_id"), given("no_turn", "at", "turn"), F.col("said").alias("role"), "text", "copies", F.coalesce("is_first", F.lit(False)).alias("is_first"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    ends = F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    fault = F.when(blank, BLANK).when(~F.col("is_first"), DUPLICATE).when(~ends, CUT).otherwise(NONE)
    code = lambda f: F.substring(F.lit(CODES), 4 * role + f + 1, F.lit(1))
    coded = marked.select("conv_id", "turn", "role", "text", code(fault).alias("code"), code(F.when(blank, BLANK).otherwise(DUPLICATE)).alias("again"), "copies")
    by = ["conv_id", "turn", "role", "text"]
    return coded.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: _segments(batches, most), SEGMENT)


class _Runs:
    """Tables of adjacent parts, merged like the digits of a counter, so that long strings are copied a logarithmic number of times."""

    def __init__(self):
        self.parts: list[tuple[int, dict]] = []

    def add(self, table: dict) -> None:
        n = 1
        while self.parts and self.parts[-1][0] == n:
            table, n = _compose(self.parts.pop()[1], table), 2 * n
        self.parts.append((n, table))

    def whole(self) -> dict:
        return functools.reduce(lambda x, y: _compose(x, y), (t for _, t in self.parts), EMPTY)


PATH = "conv_id long, part int, place long, state int, audit string, whole boolean, head boolean, blank long, duplicate long, truncated long, illegal long, cost long"
_PATH = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("state", pa.int32()), ("audit", pa.string()), ("whole", pa.bool_()), ("head", pa.bool_()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost"))])


def _advance(state: int, code: str, edit: str) -> int:
    if edit == "K" and state == 0 and CODES.index(code) < 4:
        return 1
    return state if edit == "D" else ASKS[state]


def _paths(batches):
    """Of conversations of several segments, sorted: the edits of each segment and the state in which it starts."""

    def close(held: list[dict]):
        runs = _Runs()
        for r in held:
            if r["signature"]:
                runs.add({(s["a"], s["b"]): (s["cost"], s["edits"]) for s in r["steps"]})
        cost, audit = _finish(0, runs.whole())
        totals = {n: sum(r[n] for r in held) for n in ("blank", "duplicate", "truncated", "illegal")}
        roles = [r["signature"] for r in held if r["signature"]]
        initial = lambda c: "suao"[CODES.index(c) // 4]
        totals["illegal"] += sum(initial(x[-1]) + initial(y[0]) not in LEGAL for x, y in zip(roles, roles[1:]))
        at, state, rows = 0, 0, []
        for k, r in enumerate(held):
            start, begin = at, state
            for code in r["signature"]:
                while audit[at] == "I":
                    state, at = ASKS[state], at + 1
                state, at = _advance(state, code, audit[at]), at + 1
            if k == len(held) - 1:
                at = len(audit)
            rows.append({"conv_id": r["conv_id"], "part": r["part"], "place": r["place"], "state": begin, "audit": audit[start:at], "whole": False, "head": k == 0, **(totals if k == 0 else dict.fromkeys(totals, 0)), "cost": cost if k == 0 else 0})
        return pa.RecordBatch.from_pylist(rows, schema=_PATH)

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield close(held)
                held = []
            held.append(r)
    if held:
        yield close(held)


def replay(signature: str, audit: str, state: int, roles: list[str], texts: list[str], runs: list[int]) -> list[dict]:
    """The rows that edits leave; copies after a row's first are always deleted, and so have no row of their own here."""
    out, at, row, left = [], 0, -1, 0
    for code in signature:
        while audit[at] == "I":
            state, at = ASKS[state], at + 1
            out.append({"role": "user" if state == 2 else "assistant", "text": ""})
        if not left:
            row += 1
            left = runs[row]
        left -= 1
        edit, at = audit[at], at + 1
        state = _advance(state, code, edit)
        if edit == "K":
            out.append({"role": roles[row], "text": texts[row]})
        elif edit == "R":
            out.append({"role": "user" if state == 2 else "assistant", "text": texts[row]})
    for _ in audit[at:]:
        state = ASKS[state]
        out.append({"role": "user" if state == 2 else "assistant", "text": ""})
    return out


TOTALS = ["blank", "duplicate", "truncated", "illegal", "cost"]
NARROW = ["conv_id", "part", "place", "audit", "whole", "head", "first", "last", "turns", *TOTALS]
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _replayed(batches):
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("signature", "audit", "state", "roles", "texts", "runs")]
        repaired = pa.array([replay(*r) for r in zip(*columns)], _MESSAGES)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NARROW), repaired], [*NARROW, "repaired"])


def _with_solutions(rows: DataFrame, solved: DataFrame, bounded: int = 1 << 17) -> DataFrame:
    """rows joined with what their signatures cost: broadcast while few, else with a salt, as one signature may have many rows."""
    if solved.count() <= bounded:
        return rows.join(F.broadcast(solved), "signature")
    salted = solved.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("part", "place"), F.lit(SALTS)).cast("int")).join(salted, ["signature", "_salt"]).drop("_salt")


def repair(conversations: DataFrame, path: str | None = None, most: int = ROWS) -> DataFrame:
    """Of rows conv_id, turn, role, text and copies, one row a segment in the order of (part, place): what the conversation's cheapest
    edits make of it, as `repaired` rows of role and text, with their `audit`. The counts and the cost of the whole conversation stand in
    its `head` segment and are 0 in others; `whole` says that there is but one segment.

    A conversation is its rows by turn (nulls first), then role and text; null roles and texts are one space. Each
    distinct signature of a segment is solved once; a conversation of one segment takes its solution as it is, and those
    of several compose the tables of their segments. Rows of no copies only keep their conversation, with
    an empty signature, in the result. A null conv_id is a conversation like others. No rows give no rows.
    A conversation's audit is one value, so it must fit one; everything else of it is cut into segments. path: where the
    segments are written, for callers that delete them.
    """
    spark = conversations.sparkSession
    lean(spark)
    path = path or scratch_path(spark, "segments")
    segments(conversations, most).write.parquet(path)
    held = spark.read.parquet(path)
    narrow = held.select("conv_id", "part", "place", "signature")
    solved = cut(solve(narrow))
    # Conversations of several segments: segments, not rows, are counted.
    several = cut(narrow.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("conv"), F.lit(True).alias("several")))
    told = narrow.join(F.broadcast(several) if several.count() <= FEW else several, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    alone = _with_solutions(told.where("several is null"), solved.drop("steps"))
    alone = alone.select("conv_id", "part", "place", F.lit(0).alias("state"), "audit", F.lit(True).alias("whole"), F.lit(True).alias("head"), *TOTALS)
    rest = _with_solutions(told.where("several"), solved).select("conv_id", "part", "place", "signature", "steps", *TOTALS[:4])
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_paths, PATH)
    paths = cut(alone.unionByName(rest)).drop("conv_id")
    schema = "conv_id long, part int, place long, audit string, whole boolean, head boolean, first long, last long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, repaired array<struct<role:string,text:string>>"
    return lookup(held, paths, ["part", "place"]).select(*NARROW, "signature", "state", "roles", "texts", "runs").mapInArrow(_replayed, schema)


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches):
    """Digests of conversations of several segments, sorted; texts are hashed as they stream by."""
    now = None

    def close():
        row = {n: [now[n]] for n in ("conv_id", *TOTALS)}
        row |= {"gaps": [now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0], "audit": ["".join(now["audit"])], "repaired_sha256": [now["hash"].hexdigest()]}
        kinds = {"conv_id": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
        names = [c.split()[0] for c in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(row[n], kinds.get(n, pa.int64())) for n in names], names)

    for batch in batches:
        for r in batch.to_pylist():
            if r["head"]:
                if now:
                    yield close()
                now = {n: 0 for n in TOTALS} | {"conv_id": r["conv_id"], "first": None, "last": None, "turns": 0, "audit": [], "hash": hashlib.sha256(), "said": False}
            for n in TOTALS:
                now[n] += r[n]
            now["audit"].append(r["audit"])
            if r["turns"]:
                now["turns"] += r["turns"] - (now["last"] == r["first"])
                now["first"], now["last"] = r["first"] if now["first"] is None else now["first"], r["last"]
            if r["lines"] is not None:
                now["hash"].update((b"\n" if now["said"] else b"") + r["lines"].encode())
                now["said"] = True
    if now:
        yield close()


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation: gaps between its turns, counts of faults, cost, audit, and the hash of its repaired `role:text` lines.

    Conversations of one segment stay where they are; the segments of others are hashed in order, one after the other, as the hash demands."""
    lines = F.concat_ws("\n", F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"])))
    rows = repaired.withColumn("lines", F.when(F.size("repaired") > 0, lines)).drop("repaired")
    gaps = F.when(F.col("turns") > 0, F.col("last") - F.col("first") + 1 - F.col("turns")).otherwise(0).cast("long")
    alone = rows.where("whole").select("conv_id", gaps.alias("gaps"), *TOTALS, "audit", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))
    rest = rows.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_joined, DIGEST)
    return alone.unionByName(rest)


def op13_signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages and repairs all conversations; the segments are deleted once the digests, which are small, are kept."""
    path = scratch_path(spark, "segments")
    found = cut(digests(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), path)))
    forget(spark, path)
    return found


OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT),
      lambda a, b: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c),
o AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM o),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au') AS wrong
  FROM g),
s AS (
  SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM f GROUP BY conv_id),
w AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s1,
    {'c': 5::BIGINT, 'a': 'I', 't': ['user:']} AS s2, {'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s3
  FROM s
  UNION ALL
  SELECT conv_id, n, n0, n1,
    list_min([n2, {'c': n0.c + 5, 'a': n0.a || 'I', 't': list_append(n0.t, 'user:')}, {'c': n1.c + 5, 'a': n1.a || 'I', 't': list_append(n1.t, 'user:')}, {'c': n3.c + 5, 'a': n3.a || 'I', 't': list_append(n3.t, 'user:')}]),
    list_min([n3, {'c': n2.c + 5, 'a': n2.a || 'I', 't': list_append(n2.t, 'assistant:')}])
  FROM (
    SELECT w.conv_id, f.n, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS n0,
      list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + keep + CASE i WHEN 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 't': list_append(s0.t, f.role || ':' || f.text)}]) AS n1,
      list_min(list_concat([{'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t}], flatten(list_transform([s0, s1, s3], lambda q: [
        {'c': q.c + keep + 1, 'a': q.a || 'R', 't': list_append(q.t, 'user:' || f.text)}, {'c': q.c + keep + CASE i WHEN 'u' THEN 0 ELSE 1000000000 END, 'a': q.a || 'K', 't': list_append(q.t, f.role || ':' || f.text)}])))) AS n2,
      list_min([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}, {'c': s2.c + keep + 1, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || f.text)},
        {'c': s2.c + keep + CASE i WHEN 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K', 't': list_append(s2.t, f.role || ':' || f.text)}]) AS n3
    FROM w JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS keep FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1)),
e AS (SELECT s.*, list_min([w.s0, w.s3]) AS best FROM s JOIN w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.n = s.n)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN e ON k.conv_id IS NOT DISTINCT FROM e.conv_id
"""
