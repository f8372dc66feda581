import hashlib

import numpy as np
import pytest

from clusterloom.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, range string, tie string"


def brute_hash(data: bytes) -> int:
    mask, h = 2**64 - 1, 0
    for b in data:
        h = (h * 0x9E3779B97F4A7C15 + b + 1) & mask
    h = (h + len(data)) & mask
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return h ^ h >> 31


def brute_sketch(text, fraction=fp.FRACTION, width=fp.WIDTH):
    data = text.encode()
    if not data:
        return []
    runs = {data[i : i + width] for i in range(max(1, len(data) - width + 1))}
    hashes = sorted({brute_hash(r) for r in runs})
    return [h for h in hashes if h < fraction * 2**64] or hashes[:1]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 12, 13])
def test_hashes_match_one_by_one(width):
    for text in ("", "a", "abc", "été" * 40, "The quick brown fox " * 30):
        assert list(fp.sketch(text, width=width)) == brute_sketch(text, width=width)


def test_sketch_of_a_union_is_the_union():
    draw = np.random.default_rng(1)
    a, b = ("".join(map(chr, draw.integers(97, 123, 5000))) for _ in range(2))
    both = fp.sketch(a + "\n" * 20 + b)
    assert set(fp.sketch(a)) | set(fp.sketch(b)) <= set(both)
    assert fp.containment(fp.sketch(a[:600]), both) == 1.0
    assert fp.resemblance(fp.sketch(a), fp.sketch(b)) == 0.0
    assert list(fp.from_text(fp.as_text(both))) == list(both)


def test_edited_texts_match_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), "".join(map(chr, draw.integers(97, 123, int(draw.integers(0, 900))))), "r", "t") for i in draw.permutation(500)]
    rows += [(1000, None, "", ""), (1001, "", "", ""), (1002, "é" * 31, "", ""), (1003, "x" * 100_000, "", ""), (-5, "a", "", "")]
    got = {r.doc_id: r for r in fp.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    order = sorted((r[0], r[1] or "") for r in rows)
    for (key, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r, own, new, near = got[key], brute_sketch(text), brute_sketch(changed), brute_sketch(after)
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h:016x}" for h in own)
        assert r.edited_fingerprint == "".join(f"{h:016x}" for h in new)
        for value, other in ((r.near_edited, new), (r.near_next, near)):
            union = len(set(own) | set(other))
            assert value == (len(set(own) & set(other)) / union if union else 1.0)


def test_ties_nulls_single_and_empty(spark):
    same = [(7, "the very same text", "", "")] * 40 + [(None, "no key at all", "", "")] * 3 + [(7, "other text", "", "")]
    got = fp.edited_fingerprints(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == len(same)
    one = fp.edited_fingerprints(spark.createDataFrame(same[:1], SCHEMA)).first()
    assert (one.near_next, one.doc_id) == (1.0, 7)
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    plain = fp.fingerprints(spark.createDataFrame([(1, None, "", ""), (2, "abc", "", "")], SCHEMA)).collect()
    assert [r.fingerprint for r in plain] == ["", fp.as_text(fp.sketch("abc"))]
