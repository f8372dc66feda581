"""Tanimoto similarity and kNN scores of bit fingerprints.

Both tables have an id column and a column of equally long word arrays.  The
score compares each database item with every query, so the work is their
product; what scales is how the queries reach the tasks.

* few query words: written into the expression, generated code, no shuffle;
* queries within ``MAX_SHIPPED_BYTES`` (checked): numpy inside Arrow batches;
* more: both tables in the order of their bits, cut into blocks, of which only
  those meet whose numbers of bits allow a similarity among the best k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.bits import WORD_MASK, tanimoto_sql, word_count
from clusterloom.lineage import stored
from clusterloom.operators.ordered import global_row_number, quoted

# Largest (queries x words) written out as generated code.
UNROLL_LIMIT = 64
# Largest query table shipped whole to every task.
MAX_SHIPPED_BYTES = 32 << 20
# Beyond that: queries in one row of their table, and items in one row of theirs.
QUERIES_PER_CHUNK = 512
ITEMS_PER_BLOCK = 8192
# Similarities in one numpy block of a task: few enough to stay in the CPU cache.
BLOCK_CELLS = 1 << 16


def _checked(words: str, n_words: int) -> Column:
    error = F.raise_error(F.lit(f"fingerprints must have {n_words} words, none of them null"))
    valid = (F.size(words) == n_words) & F.forall(words, lambda w: w.isNotNull())
    return F.when(valid, F.col(words)).otherwise(error)


def _query_facts(queries: DataFrame, words: str) -> tuple[int, int]:
    """Number of queries and words per query; rejects unequal or missing ones."""
    facts = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.coalesce(F.size(words), F.lit(-1))).alias("shortest"),
        F.max(F.size(words)).alias("longest"),
    ).first()
    if not facts["n"]:
        raise ValueError("there are no queries")
    if facts["shortest"] != facts["longest"] or facts["shortest"] < 1:
        raise ValueError("all queries must have the same number of words, at least one")
    return facts["n"], facts["shortest"]


def _matrix(fingerprints: pa.Array) -> np.ndarray:
    flat = fingerprints.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return (flat & WORD_MASK).astype(np.uint32).reshape(len(fingerprints), -1)


def similarity_block(items: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Tanimoto similarities (items x queries); 0 where no bit is set at all."""
    shape = (len(items), len(queries))
    shared = np.zeros(shape, dtype=np.int32)
    joined = np.zeros(shape, dtype=np.int32)
    for item_word, query_word in zip(items.T, queries.T):
        shared += np.bitwise_count(item_word[:, None] & query_word[None, :])
        joined += np.bitwise_count(item_word[:, None] | query_word[None, :])
    return np.divide(shared, joined, out=np.zeros(shape), where=joined > 0)


def top_scores(items: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best similarities of each item, descending, in bounded memory."""
    n_kept = min(k, len(queries))
    best = np.empty((len(items), n_kept))
    step = max(1, BLOCK_CELLS // len(queries))
    for lo in range(0, len(items), step):
        scores = similarity_block(items[lo:lo + step], queries)
        kept = np.partition(scores, scores.shape[1] - n_kept, axis=1)[:, -n_kept:]
        best[lo:lo + step] = np.sort(kept, axis=1)[:, ::-1]
    return best


def _mean_of_best(best: Column, k: int) -> Column:
    """Mean of the first k of a descending array, in single precision."""
    total = F.aggregate(F.slice(best, 1, k), F.lit(0.0), lambda total, s: total + s)
    return (total / k).cast("float")


def tanimoto_rows(pairs: DataFrame, a: str, b: str, n_words: int, out: str = "similarity") -> DataFrame:
    """``pairs`` with the similarity of the fingerprints in columns ``a`` and ``b``.

    Which pairs are compared is up to the caller, so there is one row for each
    pair given, and generated code without a shuffle.
    """
    checked = pairs.withColumns({c: _checked(c, n_words) for c in (a, b)})
    shared = word_count(F.col(a), F.col(b), "bitwiseAND", n_words)
    joined = word_count(F.col(a), F.col(b), "bitwiseOR", n_words)
    return checked.withColumn(out, F.coalesce(F.try_divide(shared, joined), F.lit(0.0)))


def _as_words(rows: Sequence[Sequence[int]]) -> np.ndarray:
    return (np.asarray(rows, dtype=np.int64) & WORD_MASK).astype(np.uint32)


def knn_similarity(
    items: DataFrame,
    queries: DataFrame,
    k: int,
    item_id: str,
    words: str = "words",
    max_shipped_bytes: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """``(id, score)``: mean of each item's ``k`` best similarities to the queries."""
    queries = queries.select(words).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_queries, n_words = _query_facts(queries, words)
        if not 1 <= k <= n_queries:
            raise ValueError("k must lie between 1 and the number of queries")
        table = items.select(item_id, _checked(words, n_words).alias("__words"))
        checked = queries.select(_checked(words, n_words).alias("__words"))
        if n_queries * n_words * 8 > max_shipped_bytes:
            return _knn_by_bits(table, checked, k, item_id, n_words)
        fingerprints = [r[0] for r in checked.collect()]
    finally:
        queries.unpersist()
    if n_queries * n_words <= UNROLL_LIMIT:
        sims = ", ".join(tanimoto_sql("__words", q) for q in fingerprints)
        best = table.select(item_id, F.sort_array(F.expr(f"array({sims})"), False).alias("__best"))
        return best.select(item_id, _mean_of_best(F.col("__best"), k).alias("score"))
    matrix = _as_words(fingerprints)

    @F.arrow_udf("float")
    def score(batch: pa.Array) -> pa.Array:
        best = top_scores(_matrix(batch), matrix, k)
        return pa.array(running_mean(best).astype(np.float32))

    return table.select(item_id, score("__words").alias("score"))


def running_mean(best: np.ndarray) -> np.ndarray:
    """Row means, added from left to right as the expression form does."""
    total = np.zeros(len(best))
    for column in best.T:
        total = total + column
    return total / best.shape[1]


def _bits(words: str) -> Column:
    """How many bits of a fingerprint are set."""
    masked = F.transform(words, lambda w: F.bit_count(w.cast("bigint").bitwiseAND(WORD_MASK)))
    return F.aggregate(masked, F.lit(0), lambda total, n: total + n)


def _chunks(queries: DataFrame, k: int, per_chunk: int) -> DataFrame:
    """``(chunk, lo, hi, words)``: the queries in order of their bits, some to a row.

    More than ``k`` copies of a query change nothing and are left out.
    """
    copies = F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)).cast("int")))
    once = queries.groupBy("__words").count().select("__words", _bits("__words").alias("bits"), copies.alias("copy"))
    numbered = global_row_number(once, ["bits", "__words"], "n")
    chunk = F.expr(f"(n - 1) div {per_chunk}")
    return stored(numbered.groupBy(chunk.alias("chunk")).agg(
        F.min("bits").alias("lo"), F.max("bits").alias("hi"), F.collect_list("__words").alias("words")
    ))


def _packed(per_block: int):
    """Consecutive items as blocks ``(block, lo, hi, ids, words)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, per_block):
                part = batch.slice(at, per_block)
                bits = part.column(2)
                lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | n]), *[pa.array([f(bits).as_py()], pa.int32()) for f in (pc.min, pc.max)], *lists],
                    names=["block", "lo", "hi", "ids", "words"],
                )
                n += 1

    return run


def _floors(k: int):
    """For each block and its nearest chunk: the least similarity that can still be among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for i in range(batch.num_rows):
                items, queries = (_matrix(batch.column(c)[i].values) for c in (1, 2))
                floors.append(float(top_scores(items, queries, k)[:, -1].min()) if len(queries) >= k else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(floors, pa.float64())], names=["block", "least"])

    return run


def _visits(k: int, id_type: pa.DataType | None = None):
    """Scores of each block's items from the chunks that follow it, the nearest first.

    Rows are ``(block, at, lo, hi, ids, words)``, sorted; a block itself comes before its
    chunks. A chunk none of whose queries can beat an item's k-th best is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = items = best = counts = None

        def result():
            order = np.sort(best, axis=1)[:, ::-1]
            return pa.RecordBatch.from_arrays([ids, pa.array(running_mean(order).astype(np.float32))], names=["id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                _, _, lo, hi, own, words = (column[i] for column in batch.columns)
                if own.is_valid:
                    if ids is not None:
                        yield result()
                    ids, items = own.values, _matrix(words.values)
                    best = np.full((len(ids), k), -1.0)
                    counts = np.bitwise_count(items).sum(axis=1).astype(np.int64)
                    continue
                near = np.clip(counts, lo.as_py(), hi.as_py())
                larger = np.maximum(near, counts)
                bound = np.divide(np.minimum(near, counts), larger, out=np.zeros(len(counts)), where=larger > 0)
                open_ = np.flatnonzero(bound > best.min(axis=1))
                if len(open_):
                    found = top_scores(items[open_], _matrix(words.values), k)
                    merged = np.concatenate([best[open_], found], axis=1)
                    best[open_] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
        if ids is not None:
            yield result()

    return run


def _knn_by_bits(
    items: DataFrame, queries: DataFrame, k: int, item_id: str, n_words: int,
    per_chunk: int = QUERIES_PER_CHUNK, per_block: int = ITEMS_PER_BLOCK,
) -> DataFrame:
    """Exact scores when the queries are too many to ship: none passes the driver.

    Fingerprints with a and b bits are at most min(a, b) / max(a, b) alike. So queries and
    items are put in the order of their bits and cut, the queries into chunks, the items
    into blocks; the chunk nearest to a block tells what similarity its items have to beat,
    and a block meets only the chunks whose bound lies above that, each of them once and
    the nearest first. A block's best similarities stay in its task, so nothing has to be
    merged, and items move once, whatever the number of chunks.
    """
    chunks = _chunks(queries, k, per_chunk)
    kinds = dict(items.dtypes)
    counted = items.withColumn("__bits", _bits("__words"))
    by_bits = counted.repartitionByRange("__bits", quoted(item_id)).sortWithinPartitions("__bits")
    blocks = stored(by_bits.select(quoted(item_id), "__words", "__bits").mapInArrow(
        _packed(per_block), f"block bigint, lo int, hi int, ids array<{kinds[item_id]}>, words array<{kinds['__words']}>"
    ))
    spans = chunks.select("chunk", F.explode(F.sequence("lo", "hi")).alias("bits"))
    # a chunk for each number of bits; there are no more of these than a fingerprint has bits
    chunk_of = dict(spans.groupBy("bits").agg(F.min("chunk")).collect())
    likeness = {p: max(chunk_of, key=lambda b: (min(b, p) / max(b, p, 1), -b)) for p in range(32 * n_words + 1)}
    middle = F.expr("(lo + hi) div 2")
    home = F.get(F.array(*[F.lit(chunk_of[likeness[p]]) for p in range(32 * n_words + 1)]), middle)
    nearest = blocks.select("block", "words", home.alias("chunk")).join(
        chunks.select("chunk", F.col("words").alias("theirs")), "chunk"
    )
    floors = nearest.select("block", "words", "theirs").mapInArrow(_floors(k), "block bigint, least double")
    lowest = F.floor(F.col("lo") * F.col("least")).cast("int")
    highest = F.when(F.col("least") > 0, F.least(F.ceil(F.col("hi") / F.col("least")), F.lit(32 * n_words))).otherwise(
        32 * n_words).cast("int")
    reach = blocks.select("block", "lo", "hi", middle.alias("middle")).join(floors, "block").select(
        "block", "middle", F.explode(F.sequence(lowest, highest)).alias("bits")
    )
    pairs = reach.join(spans, "bits").select("block", "middle", "chunk").distinct()
    met = pairs.join(chunks, "chunk").select(
        "block", F.least(F.abs(F.col("lo") - F.col("middle")), F.abs(F.col("hi") - F.col("middle"))).alias("at"),
        "lo", "hi", F.lit(None).cast(f"array<{kinds[item_id]}>").alias("ids"), "words",
    )
    whole = blocks.select("block", F.lit(-1).alias("at"), "lo", "hi", "ids", "words")
    stream = whole.unionByName(met).repartition("block").sortWithinPartitions("block", "at")
    scores = stream.mapInArrow(_visits(k), f"id {kinds[item_id]}, score float")
    return scores.select(F.col("id").alias(item_id), "score")
