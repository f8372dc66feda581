"""SimHash near-dedup with BK-trees.

Texts become 64-bit fingerprints; equal fingerprints are one class. Fingerprints
that differ in at most ``radius`` bits agree in at least one of ``radius + 1``
blocks of bits, so each class goes to one shard for each block, named by the
block's value. The classes of a shard form a BK-tree: a child hangs on its
parent under their Hamming distance, and a search follows only the edges within
the radius of its own distance.

A shard with too many classes is split in the same way by the bits outside its
block, and then again, so that no shard outgrows a task however often a block's
value occurs. When no bits are left to split by, the shard's trees are cut into
parts, and each part is sent to every slice of the shard's queries. Of the links
of a shard only those that join two groups leave it; copies cost nothing.

``near_copies`` asks for a least Jaccard similarity of shingles instead. Copies
of 0.8 differ by about ten bits and sometimes by twenty, for which blocks of bits
name no useful shards; there the shards are named by the smallest shingle hashes
of a text, and each link is checked on all shingles before it joins two groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage, new_folder, remove_folder
from clusterloom.llm.common import connected_components, partitions

SEED = 42
BITS = 64
SHINGLE = 3
RADIUS = 3
#: Classes of which one task builds a tree.
SHARD_SIZE = 2048
#: Of near copies: words of a shingle and the least Jaccard similarity.
COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
#: Bits by which fingerprints of near copies may differ. At a similarity of 0.8 a
#: bit of long texts differs with probability acos(8/9)/pi, of texts of five
#: shingles with 0.19: 26 bits are more than four deviations off.
COPY_RADIUS = 26
#: Smallest shingle hashes that name a text's shards. Texts of similarity J have
#: none in common with probability (1 - J) ** 8 at most: 3e-6 at 0.8.
COPY_KEYS = 8
#: Further keys, with which a key of very many texts is taken together: each makes
#: (1 - J) of the pairs that are lost there, and adds eight searches for a crowded text.
MORE_KEYS = 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it.

    A-Z are lower-cased; words are runs without ASCII white space. A text with
    fewer words than a shingle is one shingle, one without words is 0.
    """
    return _majority(_shingle_hashes(text, shingle))


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, SEED) for g in grams], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            shingle: int = SHINGLE) -> DataFrame:
    """``(id, bits)`` with the fingerprint of each whole text as a long."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "bits"]
            )

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, bits long")


class _Groups:
    """Disjoint sets, to pass on only links that join two groups."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


class BKTree:
    """Nodes in arrays; ``children[i]`` has the child of node i by distance.

    With ``groups``, nodes that meet within the radius while the tree is built are
    joined, and a search can leave out branches whose nodes all are in the group
    that asks: in a dense bunch of copies that is nearly all of it. ``names`` are
    what groups hold in place of the codes; ``alike``, of two positions, has the
    last word on a link.
    """

    def __init__(self, codes: list[int], radius: int = -1, groups: _Groups | None = None,
                 names: list[int] | None = None, alike: Callable[[int, int], bool] | None = None):
        self.codes = codes
        self.names = codes if names is None else names
        self.children: list[dict[int, int]] = [{} for _ in codes]
        self.links: list[tuple[int, int]] = []
        self.branches: list[int] = []
        for new in range(1, len(codes)):
            at, code = 0, codes[new]
            while True:
                distance = (code ^ codes[at]).bit_count()
                if distance <= radius and (alike is None or self._apart(new, at, groups) and alike(new, at)):
                    if groups.join(self.names[new], self.names[at]):
                        self.links.append((self.names[new], self.names[at]))
                child = self.children[at].get(distance)
                if child is None:
                    self.children[at][distance] = new
                    break
                at = child

    def _apart(self, a: int, b: int, groups: _Groups) -> bool:
        return groups.find(self.names[a]) != groups.find(self.names[b])

    def name_branches(self, groups: _Groups) -> None:
        """For each node the group that its whole branch is in, or -1."""
        named = [groups.find(name) for name in self.names]
        for at in range(len(named) - 1, -1, -1):  # a child comes after its parent
            own = named[at]
            if any(named[child] != own for child in self.children[at].values()):
                named[at] = -1
        self.branches = named

    def within(self, code: int, radius: int, groups: _Groups | None = None, name: int | None = None) -> Iterator[int]:
        """The nodes at most ``radius`` bits away; with ``groups``, of other groups at least."""
        name = code if name is None else name
        codes, children, branches = self.codes, self.children, self.branches
        stack = [0] if codes else []
        while stack:
            at = stack.pop()
            if groups is not None and branches[at] >= 0 and groups.find(branches[at]) == groups.find(name):
                continue
            distance = (code ^ codes[at]).bit_count()
            if distance <= radius:
                yield at
            edges = children[at]
            if edges:
                for d in range(distance - radius, distance + radius + 1):
                    child = edges.get(d)
                    if child is not None:
                        stack.append(child)


def _tree_links(codes: np.ndarray, in_tree: np.ndarray, asks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one shard part: its tree is searched by the shard's queries."""
    groups = _Groups()
    tree = BKTree(codes[in_tree].tolist(), radius, groups)
    out, named_at = tree.links, -1
    for n, code in enumerate(codes[asks].tolist()):
        if n % 256 == 0 and len(out) != named_at:
            tree.name_branches(groups)
            named_at = len(out)
        for at in tree.within(code, radius, groups):
            if groups.join(code, tree.codes[at]):
                out.append((code, tree.codes[at]))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[at] == b).sum())
    return common / (len(a) + len(b) - common)


def _copy_links(names: list[int], codes: list[int], sets: list[np.ndarray], in_tree: np.ndarray,
                asks: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """As ``_tree_links``, of classes whose shingles are similar enough."""
    groups = _Groups()
    nodes = np.flatnonzero(in_tree).tolist()

    def alike(a: int, b: int) -> bool:
        few, many = sorted((len(sets[a]), len(sets[b])))
        return few >= similarity * many and jaccard(sets[a], sets[b]) >= similarity

    tree = BKTree([codes[i] for i in nodes], radius, groups, [names[i] for i in nodes],
                  lambda a, b: alike(nodes[a], nodes[b]))
    out, named_at = tree.links, -1
    for n, i in enumerate(np.flatnonzero(asks).tolist()):
        if n % 256 == 0 and len(out) != named_at:
            tree.name_branches(groups)
            named_at = len(out)
        for at in tree.within(codes[i], radius, groups, names[i]):
            if groups.find(names[i]) != groups.find(tree.names[at]) and alike(i, nodes[at]):
                groups.join(names[i], tree.names[at])
                out.append((names[i], tree.names[at]))
    return out


def _search_shards(radius: int, similarity: float | None = None):
    """Over rows sorted by shard; a shard that goes on in the next batch waits for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            shard, bits, in_tree, asks, *checked = columns
            cuts = np.flatnonzero(np.diff(shard)) + 1
            codes, out = bits.view(np.uint64), []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if similarity is None:
                    out += _tree_links(codes[lo:hi], in_tree[lo:hi], asks[lo:hi], radius)
                    continue
                names, sets = (c[lo:hi] for c in checked)
                out += _copy_links(
                    names.view(np.uint64).tolist(), codes[lo:hi].tolist(),
                    [np.frombuffer(s, np.uint32) for s in sets], in_tree[lo:hi], asks[lo:hi], radius, similarity,
                )
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate(pair) for pair in zip(held, columns)] if held else columns
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield links([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held:
            yield links(held)

    return run


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in n runs of about equal length."""
    return [list(map(int, part)) for part in np.array_split(np.array(bits, dtype=np.int64), n)]


def _value(code: Column, bits: list[int]) -> Column:
    """The given bits of the code, all others 0."""
    mask = sum(1 << b for b in bits)
    return code.bitwiseAND(F.lit(mask - 2**BITS if mask >= 2 ** (BITS - 1) else mask))


def _visits(shards: DataFrame, key: str, shard_size: int) -> DataFrame:
    """Each row of a shard once for each pair of tree part and query slice that it is in."""
    # a shard within the bound has one part and one slice
    n_parts = F.ceil(F.col("size") / shard_size).cast("int")
    own = F.pmod(F.xxhash64(key), n_parts).cast("int")
    numbers = F.sequence(F.lit(0), n_parts - 1)
    # the tree of part p meets the queries of slice q: p <= q is enough for each pair
    return shards.withColumn("own", own).withColumn(
        "visit",
        F.explode(
            F.transform(
                numbers,
                lambda other: F.struct(
                    F.least("own", other).alias("part"), F.greatest("own", other).alias("slice"),
                ),
            )
        ),
    )


def close_links(codes: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``(a, b)``: links that connect all distinct ``bits`` at most ``radius`` bits apart.

    Not each close pair is listed, but every close pair is connected by links, and
    each link is a close pair.
    """
    n = radius + 1
    # a shard's name: which bits it has in common, as a path, and their values
    level = codes.select("bits", F.lit("").alias("path"), F.lit(0).cast("long").alias("same"))
    free = {"": list(range(BITS))}
    parts = []
    while True:
        split = [
            F.struct(
                F.lit(f"{path}/{i}").alias("path"),
                F.col("same").bitwiseOR(_value(F.col("bits"), block)).alias("same"),
                F.lit(path).alias("of"),
            )
            for path, bits in free.items()
            for i, block in enumerate(_blocks(bits, n))
        ]
        fanned = F.filter(F.array(*split), lambda s: s["of"] == F.col("path"))
        level = level.select("bits", F.explode(fanned).alias("s")).select("bits", "s.path", "s.same")
        free = {
            f"{path}/{i}": [b for b in bits if b not in block]
            for path, bits in free.items()
            for i, block in enumerate(_blocks(bits, n))
        }
        level = cut_lineage(level)
        sizes = level.groupBy("path", "same").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = level.join(sizes, ["path", "same"])
        deepest = min(map(len, free.values())) < 4 * n
        small = sized if deepest else sized.filter(F.col("size") <= shard_size)
        parts.append(small.select("bits", "path", "same", "size"))
        if deepest:
            break
        level = cut_lineage(sized.filter(F.col("size") > shard_size).select("bits", "path", "same"))
        if level.isEmpty():
            break
        paths = {r.path for r in level.select("path").distinct().collect()}
        free = {path: bits for path, bits in free.items() if path in paths}

    shards = parts[0]
    for part in parts[1:]:
        shards = shards.unionByName(part)
    rows = _visits(shards, "bits", shard_size)
    # a hash names the shard; two that share one are merged, which adds no false link
    rows = rows.select(
        F.xxhash64("path", "same", "visit.part", "visit.slice").alias("shard"), "bits",
        (F.col("own") == F.col("visit.part")).alias("in_tree"),
        (F.col("own") == F.col("visit.slice")).alias("asks"),
    )
    dealt = rows.repartition(partitions(codes), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_search_shards(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS, shingle: int = SHINGLE,
                    shard_size: int = SHARD_SIZE) -> DataFrame:
    """``(id, bits, component_id)``: groups of texts linked by close fingerprints.

    ``component_id`` is the smallest id that links reach, the row's own included.
    Null and empty texts have fingerprint 0 and link like any other. Rows with a
    null id are in a group, but name it only if all its ids are null. Repeated
    rows are one class; an empty table gives none.
    """
    prints = cut_lineage(simhash(docs, id_col, text_col, shingle))
    classes = prints.groupBy("bits").agg(F.min(id_col).alias("least"))
    links = close_links(classes.select("bits"), radius, shard_size)
    groups = connected_components(links, "a", "b")
    named = classes.join(groups, classes["bits"] == groups["node"], "left").select(
        "bits", "least", F.coalesce("component", "bits").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_bits = named.join(least, "component").select("bits", "component_id")
    return prints.join(by_bits, "bits").select(id_col, "bits", "component_id")


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_keys: int) -> DataFrame:
    """``(id, node, bits, keys, shingles)`` of each text; ``node`` names its set of shingles.

    ``shingles`` are the upper 32 bits of the hashes.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, bits, keys, sets = [], [], [], []
            for text in batch.column(1):
                hashes = np.unique(_shingle_hashes(text.as_py(), shingle))
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                bits.append(_majority(hashes))
                keys.append(hashes[:n_keys + MORE_KEYS].view(np.int64))
                sets.append((hashes >> np.uint64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (nodes, bits)),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                names=[id_col, "node", "bits", "keys", "shingles"],
            )

    return rows.mapInArrow(
        run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, node long, bits long, keys array<long>, shingles binary"
    )


def copy_links(classes: DataFrame, similarity: float = COPY_SIMILARITY, radius: int = COPY_RADIUS,
               shard_size: int = SHARD_SIZE, n_keys: int = COPY_KEYS) -> DataFrame:
    """``(a, b)``: links that connect the distinct ``node``s of similar shingle sets.

    Classes meet in the shards of the first ``n_keys`` keys that they share. Keys of
    more than ``shard_size`` classes are taken together with each other such key of the
    class and with each of its further keys, so that classes which share one such key and
    no other of the first ones meet by a further one; where such a pair is common too, the
    shard's trees are cut into parts. Each key is shared with a probability of at least ``similarity``, so of
    similar classes all but about one pair in 60,000 meet at 0.8 where keys are crowded, and
    all but one in 300,000 elsewhere.
    """
    keyed = classes.select("node", F.explode(F.slice("keys", 1, n_keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sized = cut_lineage(keyed.join(sizes, "key").select("node", "key", "size"))
    shards = sized.filter(F.col("size") <= shard_size)
    crowded = sized.filter(F.col("size") > shard_size)
    if not crowded.isEmpty():
        further = classes.select("node", F.slice("keys", n_keys + 1, MORE_KEYS).alias("further"))
        held = crowded.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")).join(further, "node")
        pairs = F.flatten(F.transform("keys", lambda a: F.transform(
            F.concat(F.filter("keys", lambda b: b > a), F.col("further")),
            lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b)),
        )))
        paired = cut_lineage(held.select("node", F.explode(F.array_distinct(pairs)).alias("key")))
        sizes = paired.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shards = shards.unionByName(paired.join(sizes, "key").select("node", "key", "size"))
    rows = _visits(shards, "node", shard_size).select(
        "node", F.xxhash64("key", "visit.part", "visit.slice").alias("shard"),
        (F.col("own") == F.col("visit.part")).alias("in_tree"),
        (F.col("own") == F.col("visit.slice")).alias("asks"),
    )
    rows = rows.join(classes.select("node", "bits", "shingles"), "node").select(
        "shard", "bits", "in_tree", "asks", "node", "shingles"
    )
    dealt = rows.repartition(partitions(classes), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_search_shards(radius, similarity), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                similarity: float = COPY_SIMILARITY, shingle: int = COPY_SHINGLE, radius: int = COPY_RADIUS,
                shard_size: int = SHARD_SIZE, n_keys: int = COPY_KEYS) -> DataFrame:
    """``(id, bits, component_id)``: groups of texts linked by similar shingle sets.

    Similarity is the Jaccard similarity of the sets of shingles; ``bits`` is the
    fingerprint of the set. Else as ``near_duplicates``.
    """
    spark = docs.sparkSession
    # shingle sets are as large as the texts: they are kept in tables that go when the links are known
    all_sets, class_sets = new_folder(spark, "shingles"), new_folder(spark, "classes")
    _shingle_sets(docs, id_col, text_col, shingle, n_keys).write.parquet(all_sets)
    sets = spark.read.parquet(all_sets)
    prints = cut_lineage(sets.select(id_col, "node", "bits"))
    held = F.first(F.struct("bits", "keys", "shingles")).alias("held")  # the same for a node
    sets.groupBy("node").agg(F.min(id_col).alias("least"), held).select("node", "least", "held.*").write.parquet(class_sets)
    remove_folder(spark, all_sets)
    classes = spark.read.parquet(class_sets)
    names = cut_lineage(classes.select("node", "least"))
    links = copy_links(classes, similarity, radius, shard_size, n_keys)
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "of")
    remove_folder(spark, class_sets)
    named = names.join(groups, names["node"] == groups["of"], "left").select(
        "node", "least", F.coalesce("component", "node").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(least, "component").select("node", "component_id")
    return prints.select(id_col, "bits", "node").join(by_node, "node").select(id_col, "bits", "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      groups: Callable[..., DataFrame] = near_duplicates, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one of the smallest id.

    ``groups`` is ``near_duplicates`` or ``near_copies``.

    Of rows that share this id, the one with the smallest hash of id and text
    stays; a null id is the largest. Rows equal in id and text are one row; where
    they differ elsewhere, the one with the smallest hash of all columns stays. Null
    texts are like empty ones. An empty table gives none, and all columns of ``docs``
    stay, whatever their names.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    key = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), row.alias("row"))
    keyed = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    found = groups(keyed, "key", "text", **options)
    stays = found.filter(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("row")).distinct()
    named = docs.select(row.alias("row"), F.struct(*docs.columns).alias("held"))
    kept = named.join(stays, "row", "left_semi")
    least = kept.groupBy("row").agg(F.min_by("held", F.xxhash64("held")).alias("held"))
    return least.select(*[F.col("held").getField(c).alias(c) for c in docs.columns])


def as_hex(bits: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
