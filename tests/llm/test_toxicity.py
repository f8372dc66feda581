import random
import zlib

import numpy as np
import pytest

from clusterloom.llm import toxicity as t

DOCS = "doc_id long, text string, score string, toxic string"
INSULTS = ["idiot", "moron", "scumbag", "worthless", "pathetic"]


def corpus(n, seed=1):
    draw = random.Random(seed)
    parts = ["ba", "co", "di", "fu", "ga", "ho", "ji", "ka", "lu", "mo", "na", "po"]
    vocabulary = ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 5))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([20, 60, 200]))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(draw.randrange(2, 6)):
                words.insert(draw.randrange(len(words)), draw.choice(INSULTS))
        docs.append((i, " ".join(words).capitalize() + ".", "s", "x"))
        if i % 5 < 4:
            labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus(2400)
    docs += [(9000, None, "s", "x"), (9001, "", "s", "x"), (9002, "You IDIOT! Pathetic, worthless moron.", "s", "x"),
             (None, "ba co di", "s", "x"), (5, docs[5][1], "s", "x"), (9003, "ba co " * 20_000 + "moron " * 3000, "s", "x")]
    labels = spark.createDataFrame([*labels, (None, 1), (7, None), (7, 1 if 7 % 6 == 0 else 0)], "doc_id long, toxic int")
    table = spark.createDataFrame(docs, DOCS)
    return table, labels, t.toxicity(table, labels).collect()


def test_held_out_accuracy(scored):
    _, _, rows = scored
    held = [r for r in rows if r.held_out and r.doc_id < 2400]
    assert len(held) > 400
    truth = np.array([r.doc_id % 6 == 0 for r in held])
    said = np.array([r.predicted == 1 for r in held])
    assert (said & truth).sum() / truth.sum() >= 0.9
    assert (said & ~truth).sum() / (~truth).sum() <= 0.03


def test_every_row_has_its_score(scored):
    table, labels, rows = scored
    assert len(rows) == table.count()
    got = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert got[9000].score == got[9001].score < 0.3 and got[9002].predicted == got[9003].predicted == 1
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    again = sorted((r.doc_id or -1, r.score) for r in t.toxicity(table.repartition(7), labels).collect())
    assert again == sorted((r.doc_id or -1, r.score) for r in rows)
    kept = t.ordinary_documents(table, labels)
    assert kept.columns == table.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)


def test_labels_of_held_out_rows_are_not_used(spark, scored):
    table, labels, rows = scored
    wrong = labels.withColumn("toxic", t.F.when(t.held_out("doc_id"), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    again = t.toxicity(table, wrong).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_without_labels_or_rows(spark):
    table = spark.createDataFrame([(1, "a b c", "s", "x"), (2, None, "s", "x")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in t.toxicity(table, none).collect()] == [0.0, 0.0]
    assert t.toxicity(table.limit(0), none).collect() == []
    few = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in t.toxicity(table, few).collect())


def plain_score(model, text):
    """The score by the words of the method: one window after the other, one feature after the other."""
    import math
    import re

    words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
    windows = [words[i:i + 6] for i in range(0, len(words), 6)]
    ordinary, both = t._compressor(model.ordinary), t._compressor(model.ordinary + model.toxic)
    saved = []
    for window in windows:
        line = b" " + b" ".join(window) + b" "
        saved.append(len(ordinary.compress(line)) - len(both.compress(line)))
    saved = sorted(saved or [0], reverse=True)
    striking = [s for s in saved if s >= 3]
    features = [
        saved[0], sum(saved[:3]), math.log(1 + len(striking)), 10 * len(striking) / len(saved),
        10 * sum(saved) / len(saved), math.log(len(saved)),
    ]
    x = model.base + sum(w * (f - c) / s for w, f, c, s in zip(model.weights, features, model.centre, model.spread))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def test_scores_are_those_of_a_plain_version(scored):
    table, labels, rows = scored
    model = t.fit(table, labels)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.score)
    texts = {r.doc_id: r.text for r in table.collect()}
    for doc_id in [*range(0, 2400, 7), 9000, 9001, 9002, 9003, None]:
        assert got[doc_id][0] == pytest.approx(plain_score(model, texts[doc_id]), abs=1e-9)
