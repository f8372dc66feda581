"""Document fingerprints by a threshold-scaled sketch.

A shingle is ``width`` bytes of the UTF-8 text. Of its hashes a text keeps all
that lie below a fixed fraction of the hash range, so the sketch grows with the
text, sketches of two texts are samples of the same hashes, and the sketch of a
union is the union of the sketches: short texts can be held against much longer
ones by containment, which sketches of fixed size cannot do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import partitions, range_bounds, range_of

WIDTH = 12
FRACTION = 1 / 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` bytes; a shorter text is one run."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    span = min(width, len(data))
    # hashes of 1, 2, 4, ... bytes, joined to the width asked for
    run, have, power = data.astype(np.uint64) + np.uint64(1), 1, np.array([_BASE])
    total, done = None, 0
    while True:
        if span & have:
            if total is None:
                total, done = run, have
            else:
                n = len(data) - done - have + 1
                total = total[:n] * power + run[done : done + n]
                done += have
        if have * 2 > span:
            break
        run = run[:-have] * power + run[have:]
        power, have = power * power, have * 2
    h = total[: len(data) - span + 1] + np.uint64(span)
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def sketch(text: str, fraction: float = FRACTION, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes below the threshold, ascending.

    A text that has shingles, but none below it, keeps its smallest hash, so that
    only a text without any character has an empty sketch.
    """
    hashes = shingle_hashes(text, width)
    kept = np.unique(hashes[hashes < np.uint64(int(fraction * 2**64))])
    return kept if len(kept) or not len(hashes) else hashes.min(keepdims=True)


def as_text(kept: np.ndarray) -> str:
    """16 hexadecimal digits for each hash."""
    return kept.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes over all hashes; two empty sketches are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The part of the smaller sketch that the other one has."""
    smaller = min(len(a), len(b))
    if not smaller:
        return 1.0 if len(a) == len(b) else 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / smaller


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """``(id, fingerprint)`` of every text, in the row's own place; null is empty."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(sketch(t.as_py(), fraction, width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"]
            )

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The second half replaced by the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, edited_containment double"
)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row of a sorted run with the next one; a guest row is only ever next."""
    held = None
    for batch in batches:
        columns = batch.column("id"), batch.column("text"), batch.column("guest")
        for key, text, guest in zip(*columns):
            row = (key.as_py(), text.as_py())
            if held is not None:
                yield held, row
            held = None if guest.as_py() else row
    if held is not None:
        raise AssertionError("a run ends with a guest row")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The rows are dealt out by ranges of the key and sorted; a range also gets the
    first row of the next one as a guest, and the last one the first of all. So
    each text is shuffled once, and no range needs another one.

    Null texts are empty. Rows of equal key follow each other by a hash of the text; null keys
    come first. A single row follows itself; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    kind = dict(rows.dtypes)["id"]
    n = partitions(docs)
    keys = ["id", "tie"]
    bounds = range_bounds(rows, keys, n)
    rows = rows.withColumn("range", range_of([F.col(k) for k in keys], bounds, [kind, "bigint"]))
    # the first key of each range: one row a range
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")
    firsts = rows.groupBy("range").agg(F.min(order).alias("first")).orderBy("range").collect()
    full = [r["range"] for r in firsts]
    schema = f"`{id_col}` {kind}, {_RESULT}"
    if not full:
        return docs.sparkSession.createDataFrame([], schema)
    opening = docs.sparkSession.createDataFrame(
        [(r["first"]["id"], r["first"]["tie"], full[i - 1]) for i, r in enumerate(firsts)],
        f"first_id {kind}, first_tie long, visited int",
    )
    # one row for each range is broadcast; of rows with one key and text any will do
    opens = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    guests = (
        rows.join(F.broadcast(opening), opens)
        .dropDuplicates(["visited"])
        .select("id", "text", "tie", F.col("visited").alias("range"), F.lit(True).alias("guest"))
    )
    dealt = (
        rows.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .repartitionById(n, "range")
        .sortWithinPartitions("guest", F.col("id").asc_nulls_first(), "tie")
        .select("id", "text", "guest")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[str, np.ndarray] | None = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 3]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=[id_col, *[f.split()[0] for f in _RESULT.split(", ")]],
            )

        id_type = None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.column("id").type
                yield batch

        for (key, text), (_, following) in _pairs(typed()):
            own = carried[1] if carried and carried[0] == text else sketch(text, fraction, width)
            changed_text = edited(text, following)
            changed = sketch(changed_text, fraction, width)
            after = own if following == text else sketch(following, fraction, width)
            carried = (following, after)
            digest = hashlib.sha256(changed_text.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((key, len(text), digest, as_text(own), as_text(changed),
                        resemblance(own, changed), resemblance(own, after), containment(own, changed)))
            if len(out) >= 512:
                yield flush()
        if out:
            yield flush()

    return dealt.mapInArrow(run, schema)
