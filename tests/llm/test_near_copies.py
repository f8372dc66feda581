import random

import corpus_pipeline
from clusterloom.llm import simhash

SCHEMA = "doc_id long, text string, bits string, component_id long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest id that links of five-word Jaccard similarity 0.8 reach, by row."""
    sets = [shingles(t) for _, t in rows]
    label = [d for d, _ in rows]
    links = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if a == b or len(a & b) >= 0.8 * len(a | b)
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def made():
    """Copies with from none to a third of their shingles changed, also of short texts, and a common line."""
    draw = random.Random(5)
    line = " ".join(f"common{i}" for i in range(14))
    rows = [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE"), (9004, "one two three four five six")]
    for i in range(60):
        text = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([8, 60, 300, 1500]))]
        for k in range(4):
            copy = list(text)
            for _ in range(round(len(text) * draw.random() * 0.04)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(5000)}"
            rows.append((i * 4 + k, " ".join(copy) + (" " + line if i % 2 else "")))
    base = [f"b{i}" for i in range(80)]
    for i in range(60):  # one bunch of near copies
        copy = list(base)
        copy[draw.randrange(80)] = f"y{i}"
        rows.append((1000 + i, " ".join(copy)))
    return rows


def test_groups_match_brute_force_jaccard(spark):
    rows = made()
    label = brute(rows)
    want = sorted(zip((d for d, _ in rows), label))
    assert 60 < len(set(label)) < 200
    table = spark.createDataFrame([(d, t, "b", 7) for d, t in rows], SCHEMA)
    for size in (2048, 16):  # the second crowds the shards of the line and of the bunch
        found = simhash.near_copies(table, shard_size=size).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == want
    assert simhash.near_copies(table.limit(0)).collect() == []


def test_pipeline_keeps_what_is_less_alike_than_asked(spark):
    rows = made()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.simhash_stage(spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows)))


def test_classes_that_share_one_crowded_key_meet_by_a_further_one(spark):
    import numpy as np

    draw = random.Random(11)
    crowd = 40  # classes that share the smallest key and nothing else
    rows = []
    for i in range(crowd):
        own = sorted(draw.getrandbits(62) + 2**40 for _ in range(400))
        rows.append((i, [7, *own]))
    base = [7, *sorted(draw.getrandbits(62) + 2**40 for _ in range(399))]
    for i in (100, 101):  # alike, but each of the first keys after the crowded one is their own
        own = [8 + 10 * k + (i - 100) for k in range(7)]
        rows.append((i, [7, *own, *base[1:]]))

    def packed(hashes):
        return (np.array(hashes, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes()

    sets = [(n, 0, h[:simhash.COPY_KEYS + simhash.MORE_KEYS], bytearray(packed([x << 1 for x in h]))) for n, h in rows]
    classes = spark.createDataFrame(sets, "node long, bits long, keys array<long>, shingles binary")
    for size in (2048, 16):
        found = {tuple(sorted(map(int, r))) for r in simhash.copy_links(classes, shard_size=size).collect()}
        assert found == {(100, 101)}
