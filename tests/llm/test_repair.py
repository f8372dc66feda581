"""Repaired conversations against enumeration and a plain search."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from clusterloom.llm import queries, repair

GRAMMAR = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def flags(rows):
    """(initial, must go, truncated) and the counts of ``(role, text)`` rows, literally."""
    out, seen = [], set()
    counts = dict.fromkeys(repair.FAULTS, 0)
    for role, text in rows:
        said = text.rstrip(SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        if fault:
            counts[fault] += 1
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        seen.add((role, text))
    letters = [r[:1] for r, _ in rows]
    counts["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return out, counts


def enumerated(turns):
    """The cheapest audit of all edits with up to two inserts in each place."""
    inserts = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    options = [
        [("D", "", 3)] + ([] if gone else [("K", c, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)])
        for c, gone, cut in turns
    ]
    for gaps in itertools.product(inserts, repeat=len(turns) + 1):
        for edits in itertools.product(*options):
            letters = "".join(g + e[1] for g, e in zip(gaps, edits)) + gaps[-1]
            if GRAMMAR.fullmatch(letters):
                audit = "".join("I" * len(g) + e[0] for g, e in zip(gaps, edits)) + "I" * len(gaps[-1])
                found = sum(2 * len(g) for g in gaps) + sum(e[2] for e in edits), audit
                best = found if best is None or found < best else best
    return best


def searched(turns):
    """The same by a search from the end over (cost, audit), inserts up to two in a row."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def rest(i, state, inserted):
        ways = []
        if i == len(turns) and state in ("", "a"):
            ways.append((0, ""))
        if inserted < 2:
            for c in "ua":
                if (state, c) in after and (more := rest(i, after[state, c], inserted + 1)):
                    ways.append((2 + more[0], "I" + more[1]))
        if i < len(turns):
            c, gone, cut = turns[i]
            for letter, to, cost in [("D", state, 3)] + ([] if gone else [
                ("K", after.get((state, c)), cut), ("R", after.get((state, "u")), 2 + cut), ("R", after.get((state, "a")), 2 + cut)
            ]):
                if to is not None and (more := rest(i + 1, to, 0)):
                    ways.append((cost + more[0], letter + more[1]))
        return min(ways, default=None)

    return rest(0, "", 0)


def replayed(rows, audit):
    lines, state, at = [], "", iter(rows)
    following = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for letter in audit:
        if letter == "I":
            lines.append((following[state], ""))
        else:
            role, text = next(at)
            if letter == "D":
                continue
            lines.append((role if letter == "K" else following[state], text))
        state = lines[-1][0][0]
    return "\n".join(f"{r}:{t}" for r, t in lines)


def expected(rows):
    """The contract's row for one conversation's damaged ``(turn, role, text)`` rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    said = [r[1:] for r in rows]
    numbers = {t for t, *_ in rows if t is not None}
    turns, counts = flags(said)
    cost, audit = searched(tuple(turns))
    digest = hashlib.sha256(replayed(said, audit).encode()).hexdigest()
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), cost, audit, digest)


def test_edges_against_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        turns = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
        cost, places = repair.cheapest([(*t, 0) for t in turns])
        assert (cost, places.translate(repair.LETTERS)) == enumerated(turns) == searched(tuple(turns))


def test_longer_ones_against_search():
    rng = random.Random(6)
    for _ in range(300):
        turns = [(rng.choice("ssuuuaaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(30))]
        cost, places = repair.cheapest([(*t, 0) for t in turns])
        assert (cost, places.translate(repair.LETTERS)) == searched(tuple(turns))


def made_up(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "well", "", " \t", "Why?  ", "é", "a\nb."]
    return [
        (
            rng.choice([None, 1, 2, 2, 2, rng.randrange(3, 30)]), rng.choice([None, *range(12)]),
            rng.choice([None, "user", "user", "assistant", "assistant", "system", "tool", ""]),
            rng.choice([None, *texts, f"text {rng.randrange(40)}."]),
        )
        for _ in range(n)
    ]


def by_conversation(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return groups


@pytest.mark.parametrize("long_rows", [1, 3, 7, 4096])
def test_all_rows(spark, long_rows):
    rows = made_up(1, 250)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_digests(df, long_rows=long_rows).collect()}
    assert got == {conv: expected(group) for conv, group in by_conversation(rows).items()}
    again = repair.repair_conversations(df, long_rows=long_rows)
    lines = {}
    for r in sorted(again.collect(), key=lambda r: r["segment"]):
        lines.setdefault(r["conv_id"], []).extend(f"{t['role']}:{t['text']}" for t in r["turns"])
    for conv, (*_, digest) in got.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == digest


def test_many_copies_of_one_turn(spark):
    rows = [(1, 1, "user", "Go.")] * 40 + [(1, 2, "assistant", "Gone.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for long_rows in (10, 4096):
        row = repair.repair_digests(df, long_rows=long_rows).first()
        assert (row["audit"], row["cost"], row["duplicate"]) == ("K" + "D" * 39 + "K", 117, 39)
        assert row["illegal"] == 39


def damaged_rows(rows):
    out = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        group = out.setdefault(conv, [])
        row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
        group += [row] * {0: 0, 3: 2}.get(code, 1)
    return out


def test_query(spark, tmp_path):
    rows = made_up(2, 400)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumns({"key": F.lit(1), "copies": F.lit(9), "Segment": F.lit("x")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    want = {}
    for conv, group in damaged_rows(rows).items():
        want[conv] = expected(group)
    assert got == want


def test_all_rows_gone(spark):
    df = spark.createDataFrame([(5, 1, "user", "Yes.")], "conv_id long, turn int, role string, text string")
    row = repair.repair_digests(df, F.lit(0)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table_and_ill_formed_bytes(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair_digests(df).count() == 0
    odd = spark.sql("SELECT '' AS conv_id, 1 AS turn, 'user' AS role, CAST(X'FF2E' AS string) AS text")
    row = repair.repair_digests(odd).first()
    assert row["conv_id"] == "" and row["audit"] == "KI"
    assert row["repaired_sha256"] == hashlib.sha256(b"user:\xff.\nassistant:").hexdigest()
