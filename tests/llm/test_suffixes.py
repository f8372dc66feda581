import random
from collections import defaultdict

import pytest

from clusterloom.llm.suffixes import deduplicated, repeated_passages, row_hash, without

SCHEMA = "doc_id long, text string, n_chars long, row string, extra string"


def spans(positions):
    out = []
    for p in sorted(positions):
        if out and p == out[-1][1]:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(s) for s in out]


def brute(keyed, n):
    """By the row hash: all and extra spans, from a table of every run."""
    texts = {row: (text or "").encode().split() for row, text in keyed}
    runs = defaultdict(list)
    for row, words in texts.items():
        for i in range(len(words) - n + 1):
            runs[tuple(words[i : i + n])].append((row, i))
    every, extra = defaultdict(set), defaultdict(set)
    for places in runs.values():
        if len(places) > 1:
            for k, (row, i) in enumerate(sorted(places)):
                every[row].update(range(i, i + n))
                if k:
                    extra[row].update(range(i, i + n))
    return {row: (spans(every[row]), spans(extra[row])) for row in every}


def corpus(seed, n_words):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[draw.choice(words) for _ in range(draw.choice([n_words, n_words + 1, 3 * n_words]))] for _ in range(6)]
    rows = []
    for i in range(150):
        text = [draw.choice(words) for _ in range(draw.randrange(4 * n_words))]
        for _ in range(draw.randrange(3)):
            at, p = draw.randrange(len(text) + 1), draw.choice(passages)
            cut = draw.choice([0, 0, 1, 5])
            text[at:at] = p[cut:]
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(text)))
    rows += [(1000, None), (1001, ""), (1002, "a " * (3 * n_words)), (5, rows[5][1]), (5, "other text"), (None, rows[7][1]), (None, rows[7][1])]
    return rows


@pytest.mark.parametrize(("n_words", "head", "per_part"), [(50, 18, 100_000), (12, 5, 100_000), (12, 5, 3), (8, 8, 1), (5, 1, 100_000)])
def test_matches_every_run(spark, n_words, head, per_part):
    table = spark.createDataFrame([(d, t, 0, "r", "e") for d, t in corpus(n_words, n_words)], SCHEMA)
    keyed = [(r.h, r.text) for r in table.select(row_hash().alias("h"), "text").collect()]
    found = repeated_passages(table, min_words=n_words, head_words=head, rows_per_part=per_part).collect()
    got = {r.row: ([tuple(s) for s in r.passages], [tuple(s) for s in r.extra]) for r in found}
    assert len(got) == len(found)
    assert got == brute(keyed, n_words)


def test_cutting_leaves_one_copy(spark):
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [" ".join(f"u{draw.random()}" for _ in range(30)) for _ in range(12)]
    rows = [(i, f"{t}\n{passage} {t[::-1]}") for i, t in enumerate(texts)] + [(20 + i, passage) for i in range(5)]
    rows += [(50, "short and clean"), (51, None), (52, " ")]
    table = spark.createDataFrame([(d, t, 1, "r", "e") for d, t in rows], SCHEMA)
    clean = deduplicated(table)
    assert clean.columns == table.columns
    got = {r.doc_id: r for r in clean.collect()}
    assert sum(passage in (r.text or "") for r in got.values()) == 1
    assert all(t in got[i].text and t[::-1] in got[i].text for i, t in enumerate(texts))
    assert got[50].text == "short and clean" and got[51].text is None and got[52].text == " "
    assert all(r.n_chars == len(r.text or "") and r.row == "r" for r in got.values())
    assert len([d for d in got if 20 <= d < 25]) <= 1


def test_without_and_empty_table(spark):
    assert without(b" a b\tc  d\n", [{"lo": 1, "hi": 3}]) == b" a d\n"
    assert without(b"a b", [{"lo": 0, "hi": 2}]) == b""
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
    assert deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []
