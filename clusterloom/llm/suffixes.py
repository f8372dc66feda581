"""Repeated passages by sparse suffixes.

Of the suffixes of a text (word by word) only those are retained that begin at a
minimiser: the place of the smallest ``head`` words hash among all heads that
fit into a run of ``min_words`` words. Equal runs of ``min_words`` words retain
the same suffix, so

1. retained suffixes whose heads occur once are dropped; in text without
   repeats nothing is left,
2. each suffix that is left is extended left and right to the runs of
   ``min_words`` words whose minimiser it is, and the runs are brought together
   by the hash of their words,
3. repeated runs of a document that overlap grow together into passages.

Suffixes are not compared with their neighbours in sorted order: the neighbour
shares most to the right, and another one, which shares less there and more to
the left, may be the only one with which ``min_words`` words are reached.

The result is exact: a word counts as repeated if, and only if, it lies in a run
of ``min_words`` words that occurs more than once. Suffix heads are counted with
a partial count before the shuffle. Runs of a very common head are sorted in
several parts, of which only the first rows meet, so that a passage that is in
every third text is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.lineage import cut_lineage

MIN_WORDS = 50
HEAD_WORDS = 18
#: Occurrences of a head for each part in which its runs are sorted.
ROWS_PER_PART = 100_000
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Runs:
    """Hashes of all runs of n words of a text, from one pass over its words."""

    def __init__(self):
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        self.power = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
        self.inverse = np.cumprod(np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64))

    def sums(self, words: list[bytes]) -> np.ndarray:
        if len(words) > len(self.power):
            self._grow(2 * len(words))
        digest = xxhash.xxh64_intdigest
        codes = np.fromiter(map(digest, words), np.uint64, len(words))
        return np.concatenate([[np.uint64(0)], np.cumsum(codes * self.power[: len(words)])])

    def hashes(self, sums: np.ndarray, n: int) -> np.ndarray:
        h = (sums[n:] - sums[:-n]) * self.inverse[: len(sums) - n]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _minimisers(heads: np.ndarray, width: int) -> np.ndarray:
    """For each run the place of its smallest head, the first of equal ones."""
    offsets = np.lib.stride_tricks.sliding_window_view(heads, width).argmin(axis=1)
    return np.arange(len(offsets)) + offsets


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows equal in id and text have one ``row`` and count as one document."""
    return docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, head_words: int = HEAD_WORDS,
                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(row, start, is_first)`` of every run of ``min_words`` words that occurs again."""
    head_words = min(head_words, min_words)
    width = min_words - head_words + 1
    rows = _keyed(docs, id_col, text_col)

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for batch in batches:
            heads, own, starts = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().split()
                if len(words) >= min_words:
                    hashes = runs.hashes(runs.sums(words), head_words)
                    at = np.unique(_minimisers(hashes, width))
                    heads.append(hashes[at])
                    own.append(np.full(len(at), row, dtype=np.int64))
                    starts.append(at.astype(np.int32))
            if heads:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(own)),
                     pa.array(np.concatenate(starts))],
                    names=["head", "row", "at"],
                )

    suffixes = rows.mapInArrow(retain, "head long, row long, at int")
    # stored, so that the join below sees a plain table and can split a common head
    common = cut_lineage(
        suffixes.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("head", F.ceil(F.col("n") / rows_per_part).cast("int").alias("n_parts"))
    )
    any_parted = not common.filter("n_parts > 1").isEmpty()
    left = suffixes.join(common, "head")
    places = left.groupBy("row").agg(F.collect_set(F.struct("at", "n_parts")).alias("places"))
    extended = rows.join(places, "row").dropDuplicates(["row"]).select("row", "text", "places")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                batch = whole.slice(first, 200)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for row, text, found in zip(*(c.to_pylist() for c in batch.columns)):
                    sums = runs.sums(text.split())
                    anchors = _minimisers(runs.hashes(sums, head_words), width)
                    parts = np.zeros(len(sums), dtype=np.int32)
                    for place in found:
                        parts[place["at"]] = place["n_parts"]
                    start = np.flatnonzero(parts[anchors])
                    out[0].append(runs.hashes(sums, min_words)[start])
                    out[1].append(np.full(len(start), row, dtype=np.int64))
                    out[2].append(start.astype(np.int32))
                    out[3].append(parts[anchors[start]])
                columns = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].view(np.int64)), *map(pa.array, columns[1:])],
                    names=["run", "row", "start", "n_parts"],
                )

    candidates = extended.mapInArrow(extend, "run long, row long, start int, n_parts int")
    part = F.when(F.col("n_parts") > 1, F.pmod("row", F.col("n_parts"))).otherwise(0)
    candidates = candidates.withColumn("part", part.cast("int"))
    # equal runs lie side by side; a run with a neighbour is a repeat
    order = Window.partitionBy("run", "part").orderBy("row", "start")
    compared = candidates.select(
        "run", "row", "start", "n_parts",
        F.lag("start").over(order).isNull().alias("is_first"),
        F.lead("start").over(order).isNull().alias("is_last"),
    )
    alone = F.col("is_first") & F.col("is_last")
    one = F.col("n_parts") == 1
    settled = compared.filter((one & ~alone) | (~one & ~F.col("is_first"))).select("row", "start", "is_first")
    if not any_parted:
        return settled
    # the first rows of the parts of one run, and whether more follow in the part
    across = Window.partitionBy("run").orderBy("row", "start")
    firsts = compared.filter(~one & F.col("is_first")).select(
        "row", "start", "is_last",
        F.lag("start").over(across).isNull().alias("is_first"),
        F.lead("start").over(across).isNull().alias("is_only"),
    )
    firsts = firsts.filter(~(F.col("is_first") & F.col("is_only") & F.col("is_last")))
    return settled.unionByName(firsts.select("row", "start", "is_first"))


def _passages(starts: np.ndarray, n: int) -> list[dict[str, int]]:
    if not len(starts):
        return []
    starts = np.sort(starts)
    cuts = np.flatnonzero(np.diff(starts) > n) + 1
    lows = starts[np.concatenate([[0], cuts])]
    highs = starts[np.concatenate([cuts - 1, [len(starts) - 1]])] + n
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(lows, highs)]


_SPANS = "array<struct<lo:bigint,hi:bigint>>"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS, head_words: int = HEAD_WORDS,
                      rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(row, passages, extra)`` of the documents that have repeated passages.

    Passages are word spans. ``passages`` are all words in runs that occur more
    than once, in one document or several; ``extra`` those in runs that are not
    the first of their kind, so that without them one copy of each run stays.
    First is the row with the smallest ``row``, a hash of id and text, and in a
    row the leftmost run.

    Rows equal in id and text are one document here. Null, empty and short texts
    have no passages; an empty table gives none.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words, head_words, rows_per_part)
    by_row = runs.groupBy("row").agg(
        F.collect_list(F.when(F.col("is_first"), F.col("start"))).alias("first"),
        F.collect_list(F.when(~F.col("is_first"), F.col("start"))).alias("again"),
    )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            all_of, extra = [], []
            for first, again in zip(batch.column(1), batch.column(2)):
                again = again.values.to_numpy()
                all_of.append(_passages(np.concatenate([first.values.to_numpy(), again]), min_words))
                extra.append(_passages(again, min_words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(all_of, kind), pa.array(extra, kind)],
                names=["row", "passages", "extra"],
            )

    return by_row.mapInArrow(grow, f"row long, passages {_SPANS}, extra {_SPANS}")


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The ``row`` of :func:`repeated_passages`."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The text without the words of the spans and the white space after each."""
    if not spans:
        return text
    starts = [m.start() for m in _WORD.finditer(text)]
    starts.append(len(text))
    out, at = [], 0
    for span in spans:
        out.append(text[at : starts[span["lo"]]])
        at = starts[span["hi"]]
    out.append(text[at:])
    return b"".join(out)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without their extra passages, and without texts that held nothing else.

    ``n_chars``, where there is one, follows the text. Null, empty and short texts stay as
    they are; rows equal in id and text are one document and lose the same words; an empty
    table gives none. All columns of ``docs`` stay, whatever their names.
    """
    found = repeated_passages(docs, id_col, text_col, **options).select("row", "extra")
    name = {c: f"__column_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(row_hash(id_col, text_col).alias("row"), *[F.col(c).alias(n) for c, n in name.items()])
    joined = named.join(found, "row", "left").drop("row")
    text = name[text_col]
    at = joined.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for value, spans in zip(batch.column(at), batch.column(batch.num_columns - 1)):
                value, spans = value.as_py(), spans.as_py()
                if spans:
                    value = without(value.encode(), spans).decode()
                texts.append(value)
                keep.append(not spans or bool(value.strip(" \t\n\v\f\r")))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            kept = pa.RecordBatch.from_arrays(columns, names=list(batch.schema.names[:-1]))
            yield kept.filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{n} {t}" for n, t in joined.dtypes[:-1])
    clean = joined.mapInArrow(cut, schema)
    result = {c: F.col(n) for c, n in name.items()}
    if "n_chars" in result:
        result["n_chars"] = F.coalesce(F.length(text).cast("long"), F.lit(0))
    return clean.select(*[v.alias(c) for c, v in result.items()])
