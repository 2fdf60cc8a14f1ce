import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import dialogues

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """Plain damage: (conv_id, turn, role, text) rows."""
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = text.strip(SPACES)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits_of(rows, marks):
    """Every way to edit a short conversation, with up to two insertions in each gap: (cost, audit, lines)."""
    gaps = [("", 0, []), *[("I", 5, [r]) for r in ("user", "assistant")], *[("II", 10, list(p)) for p in itertools.product(("user", "assistant"), repeat=2)]]
    choices = []
    for (_, _, role, text), mark in zip(rows, marks):
        extra = 5 if mark == "truncated" else 0
        some = [("D", 2, [])]
        if mark not in ("blank", "duplicate"):
            some += [("K", extra, [(role, text)]), ("R", 1 + extra, [("user", text)]), ("R", 1 + extra, [("assistant", text)])]
        choices.append(some)
    steps = [gaps] + [x for c in choices for x in (c, gaps)]
    for way in itertools.product(*steps):
        lines = [(x, "") if isinstance(x, str) else x for _, _, found in way for x in found]
        if GRAMMAR.match("".join(role[:1] or "-" for role, _ in lines)):
            yield sum(c for _, c, _ in way), "".join(a for a, _, _ in way), lines


def plain(rows):
    """conv_id -> all columns, with the cheapest edits found by a walk over rows and states, insertions as moves of their own."""
    out = {}
    convs = {r[0] for r in rows}
    all_rows = list(damaged(rows))
    for conv in convs:
        mine = sorted((r for r in all_rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks = faults(mine)
        front = {"": (0, "", [])}  # the last two roles matter only as: none, s, u, a

        def insert(front):
            found = dict(front)
            for state, (c, a, t) in front.items():
                to = "a" if state == "u" else "u"
                new = (c + 5, a + "I", t + [("user" if to == "u" else "assistant", "")])
                found[to] = min(found.get(to, new), new)
            return found

        for (_, _, role, text), mark in zip(mine, marks):
            extra, after = 5 if mark == "truncated" else 0, {}
            for state, (c, a, t) in insert(front).items():
                moves = [(state, c + 2, a + "D", t)]
                if mark not in ("blank", "duplicate"):
                    to = "a" if state == "u" else "u"
                    moves.append((to, c + 1 + extra, a + "R", t + [("user" if to == "u" else "assistant", text)]))
                    if role[:1] == to or (role[:1] == "s" and state == ""):
                        moves.append((role[:1], c + extra, a + "K", t + [(role, text)]))
                for to, *rest in moves:
                    after[to] = min(after.get(to, tuple(rest)), tuple(rest))
            front = after
        cost, audit, lines = min(v for k, v in insert(front).items() if k in ("", "a"))
        turns = [r[1] for r in mine if r[1] is not None]
        roles = [r[2][:1] for r in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return out


def got(spark, rows, most=dialogues.ROWS):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(n) for n in ("part", "place", "signature", "copies", "n", "conv", "digest")]).repartition(3)
    found = dialogues.digests(dialogues.repair(dialogues.damage(df), most=most)).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r)[1:] for r in found}


def random_rows(n, seed, long=0):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "Yes.", "etc. ", "a.b", "ü.\n", "...", "x" * 50]
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(0, 9) if conv or not long else long):
            rows.append((conv, r.choice([turn, turn, turn + 3, turn // 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(texts) + (str(turn) + "." if r.random() < 0.5 else "")))
    return rows


def test_against_a_plain_walk(spark):
    rows = random_rows(300, 1)
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (1, None, "user", "a."), (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 5, None, "x."), (3, 1, "user", None), (4, 1, "", "y.")]
    rows += [(5, 2**62, "user", "far."), (5, -(2**61), "assistant", "near."), (6, 0, "user", "long " * 50_000 + "."), (6, 1, "assistant", "ok.")]
    rows += [(7 + k, 0, "user", "dropped?") for k in range(60)] + [(100, k % 4, "user", "Same.") for k in range(40)]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert dialogues.digests(dialogues.repair(dialogues.damage(spark.createDataFrame([], SCHEMA)))).collect() == []


@pytest.mark.parametrize("most", [1, 3, 512])
def test_long_conversations_in_segments(spark, most):
    rows = random_rows(25, most, long=700)
    assert got(spark, rows, most) == plain(rows)


def test_one_row_repeated_without_end(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Again."), *[(1, 2, "user", "Same.")] * 3000, (1, 3, "assistant", "End.")]
    assert got(spark, rows, 2) == plain(rows)


def test_signatures_against_every_edit():
    r = random.Random(4)
    for _ in range(60):
        rows = [(1, k, r.choice(["system", "user", "assistant", "tool"]), r.choice(["A.", "B", "", "C?"])) for k in range(r.randrange(0, 4))]
        marks = faults(rows)
        signature = "".join(dialogues.CODES[4 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + ["", "blank", "duplicate", "truncated"].index(m)] for (_, _, role, _), m in zip(rows, marks))
        table = dialogues._solve(signature) if signature else dialogues.EMPTY
        cost, audit, lines = min(edits_of(rows, marks))
        assert dialogues._finish(0, table) == (cost, audit)
        assert [tuple(m.values()) for m in dialogues.replay(signature, audit, 0, [x[2] for x in rows], [x[3] for x in rows], [1] * len(rows))] == lines


def test_halves_are_solved_once():
    dialogues._solve.cache_clear()
    cost, audit = dialogues._finish(0, dialogues._solve("G" * 4096))  # user rows that are duplicates
    assert (cost, audit) == (8192, "D" * 4096) and dialogues._solve.cache_info().misses == 13


def test_signatures_too_many_to_broadcast(spark):
    rows = spark.createDataFrame([(k % 5, k, "E" * (k % 7 + 1)) for k in range(60)], "part int, place long, signature string")
    solved = dialogues.solve(rows)
    few, many = dialogues._with_solutions(rows, solved), dialogues._with_solutions(rows, solved, bounded=0)
    assert sorted(map(str, few.select("part", "place", "audit").collect())) == sorted(map(str, many.select("part", "place", "audit").collect())) and solved.count() == 7
