import random

import numpy as np
import xxhash

from clusterloom.llm import simhash
from clusterloom.llm.simhash import BKTree, close_links, near_duplicates

SCHEMA = "doc_id long, text string, bits string, component_id long"


def brute_fingerprint(text):
    words = [w for w in (text or "").translate(
        {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {i: " " for i in range(9, 14)}
    ).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, radius):
    """By the smallest position, over all pairs."""
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            for j, b in enumerate(codes[:i]):
                if (a ^ b).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_bk_tree_finds_what_all_pairs_find():
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(20)]
    codes = list({b ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for b in base * 10} | set(base))
    tree = BKTree(codes)
    for code in codes:
        assert {codes[i] for i in tree.within(code, 3)} == {c for c in codes if (c ^ code).bit_count() <= 3}


def test_spark_hash_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c') h").first().h == np.uint64(
        xxhash.xxh64_intdigest(b"a b c", 42)
    ).astype(np.int64)


def test_groups_match_all_pairs(spark):
    draw = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "two words"),
            (1006, "é ".join("abc")), (1006, "again again"), (1007, "x\u00a0y\x1cz"), (1008, "İ ß Σ")]
    for i in range(60):
        text = [draw.choice(words) for _ in range(draw.choice([30, 300, 3000]))]
        rows.append((i * 3, " ".join(text)))
        rows.append((i * 3 + 1, " ".join(text[:-1])))
        rows.append((i * 3 + 2, " ".join(text).upper()))
    rows += [(5000 + i, "the same again") for i in range(300)]
    codes = [brute_fingerprint(t) for _, t in rows]
    label = components(codes, 3)
    least = {}
    for (doc, _), l in zip(rows, label):
        least[l] = min(doc, least.get(l, doc))
    want = sorted((d, c, least[l]) for (d, _), c, l in zip(rows, codes, label))
    table = spark.createDataFrame([(d, t, "b", 7) for d, t in rows], SCHEMA)
    for size in (2048, 8):
        found = near_duplicates(table, shard_size=size)
        got = sorted((r.doc_id, r.bits % 2**64, r.component_id) for r in found.collect())
        assert got == want


def test_crowded_shards_split_and_lose_no_link(spark):
    draw = random.Random(3)
    # all codes share 58 bits, so every block is crowded
    codes = sorted({sum(1 << b for b in draw.sample(range(6), draw.randrange(7))) << 5 for _ in range(200)})
    codes += [1 << 63, (1 << 63) | 7, (1 << 62) | (1 << 61)]
    table = spark.createDataFrame([(c - 2**64 if c >= 2**63 else c,) for c in codes], "bits long")
    links = close_links(table, 3, 4).collect()
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in links)
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a % 2**64), find(b % 2**64)))
        parent[b] = a
    label = components(codes, 3)
    assert [find(c) for c in codes] == [codes[l] for l in label]


def test_null_ids_and_empty_table(spark):
    table = spark.createDataFrame([(None, "a b c d", "", 1), (3, "a b c d", "", 1), (None, "z", "", 1)], SCHEMA)
    got = {(r.doc_id, r.bits == simhash.fingerprint("z")): r.component_id for r in near_duplicates(table).collect()}
    assert got == {(None, False): 3, (3, False): 3, (None, True): None}
    assert near_duplicates(table.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    draw = random.Random(4)
    text = " ".join(f"w{draw.randrange(500)}" for _ in range(2000))
    rows = [(9, text), (3, text + " more"), (5, "clean and short"), (None, text), (None, "nothing like it"),
            (7, ""), (6, None), (8, "same row"), (8, "same row"), (11, " ".join(f"x{draw.random()}" for _ in range(50)))]
    table = spark.createDataFrame([(d, t, f"b{d}", 7) for d, t in rows], SCHEMA)
    kept = simhash.one_of_each_group(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.bits) for r in kept.collect()), key=str)
    assert got == sorted([(3, "b3"), (5, "b5"), (None, "bNone"), (6, "b6"), (8, "b8"), (11, "b11")], key=str)
    assert simhash.one_of_each_group(table.limit(0)).collect() == []
