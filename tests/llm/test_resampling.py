"""Importance resampling against runs of words put together as text."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.llm import queries, resampling
from tests.conftest import SF_DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(ASCII))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def literal(documents, targets, percent=5):
    """(n_features, weight, score, rank) of each document, by the contract's words."""
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in documents]), (t, targets)):
        for text in texts:
            for feature in features(text)[1]:
                counts[bucket(feature)] += 1
    all_s, all_t = sum(s), sum(t)
    gains = [
        math.floor(1000 * math.log(float(t[b] + 1) * (all_s + 10000) / (float(s[b] + 1) * (all_t + 10000))))
        for b in range(10000)
    ]
    out, long_enough = [], []
    for doc_id, text in documents:
        words, runs = features(text)
        weight = sum(gains[bucket(f)] for f in runs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        row = [doc_id, len(runs), weight, score, None]
        out.append(row)
        if len(words) >= 20:
            long_enough.append(row)
    long_enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, row in enumerate(long_enough[:percent * len(long_enough) // 100], 1):
        row[4] = n
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def shift():
    return resampling.CrcShift()


def test_moved_checksums(shift):
    rng = random.Random(1)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(n)) for n in (0, 1, 2, 7, 256, 257, 258, 5000, 70000)]
    crc = np.array([zlib.crc32(a) for a, _ in pairs], dtype=np.uint32)
    moved = shift.moved(crc, np.array([len(b) for _, b in pairs], dtype=np.uint32))
    assert (moved ^ [zlib.crc32(b) for _, b in pairs]).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def awkward_texts(seed):
    rng = random.Random(seed)
    words = ["a", "ab", "b", "Ab", "É", "é", "x" * 300, "中文" * 200, "1", "Z9", "\u2028", "don't", "a\x00b", "\n", "\x01" + "0", "0"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(60)]
    return [*texts, "", None, " ... ", "\n", "one", texts[0], texts[0]]


@pytest.mark.parametrize("block, portion", [(1, 1), (50, 400), (1 << 21, 1 << 22)])
def test_buckets_of_awkward_texts(shift, monkeypatch, block, portion):
    monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
    texts = awkward_texts(2)
    gains = np.arange(10000) - 5000
    runs = resampling.TextRuns([t and t.encode() for t in texts], shift)
    words, n, weights = runs.weights(gains)
    assert words.tolist() == [len(features(t)[0]) for t in texts]
    assert n.tolist() == [len(features(t)[1]) for t in texts]
    assert weights.tolist() == [sum(bucket(f) - 5000 for f in features(t)[1]) for t in texts]
    counts = np.bincount([bucket(f) for t in texts for f in features(t)[1]], minlength=10000)
    assert (runs.counts() == counts).all()


def test_drawn_rows_with_nulls_copies_and_clashing_names(spark, tmp_path):
    rng = random.Random(3)
    texts = awkward_texts(4) + [" ".join(rng.choices("the cat sat on a mat".split(), k=25)) for _ in range(200)]
    documents = [(None if i == 7 else i // 2 if i < 20 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    names = {c: F.lit("x") for c in ("n", "score", "short", "below", "unknown", "__copies0", "rank", "weight")}
    df.withColumns(names).write.parquet(f"{tmp_path}/documents.parquet")
    targets = ["the mat sat on the cat", None, "a mat"]
    spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = queries.op12_resampling(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == literal(documents, targets)
    assert sum(r["rank"] is not None for r in got) == len([t for t in texts if len(features(t)[0]) >= 20]) * 5 // 100


def test_given_tables(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    targets = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = queries.op12_resampling(spark, SF_DIR).collect()
    assert sorted(map(tuple, got), key=repr) == literal([tuple(d) for d in documents], targets)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "word")], "doc_id long, text string")
    assert resampling.importance_resample(empty, one).count() == 0
    row = resampling.importance_resample(one, empty).first()
    assert row["n_features"] == 1 and row["rank"] is None
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'FF20FE' AS string) AS text")
    assert resampling.importance_resample(odd, one).first()["n_features"] == 3
