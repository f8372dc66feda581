"""Target-distribution importance resampling over hashed runs of words.

Texts are drawn by how much more likely their runs of one to three words are in a
target than in the corpus. A run's bucket is the crc32 of its bytes modulo
``N_BUCKETS``; the counts of all buckets on both sides give each bucket a gain, a
document's weight is the sum of its runs' gains, and adding Gumbel noise that is fixed
by its id turns the highest scores into a draw without replacement.

**Method.** A task reads its texts in blocks of ``BLOCK_BYTES``. The distinct words of
a block, bounded by a delimiter on both sides, go into an Aho-Corasick automaton with
their payloads: the crc32 of the word, that of the word behind a space, and the length.
One scan of the block emits the payloads in order, and runs are made from neighbouring
payloads only: crc32 is linear, so the checksum of "a b" is that of "a", moved on by the
length of " b", xor that of " b". Moving on is a product with a bit matrix, four table
lookups for each length. No run of words is ever put together as text.

**Scale.** Counting and scoring are two maps over the texts; the first shuffles at most
``N_BUCKETS`` counts from each task, and the driver holds the gains, whose number is
fixed. Dictionaries are as large as a block. The draw is a distributed numbering of one
narrow row for each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage
from clusterloom.operators.ordered import global_row_number, quoted

N_BUCKETS = 10_000
MAX_RUN = 3
MIN_WORDS = 20
SEED = 42
#: Bytes of text that one dictionary covers.
BLOCK_BYTES = 1 << 21
#: Bytes of text whose folded form is held at a time, or one text.
PORTION_BYTES = 1 << 22
#: Longer words stand in the dictionary under a number; their payload is their own.
LONGEST_WORD = 256
#: Bytes that are in words; A-Z become a-z and everything else a space.
_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256)
)
END_OF_TEXT = b"\x02"  # no byte of a folded text, so a word of its own between texts


# --- checksums of runs -----------------------------------------------------


def _byte_table() -> np.ndarray:
    """The crc32 step for one byte (reflected polynomial 0xEDB88320), from its definition."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


class CrcShift:
    """Moves checksums on by numbers of bytes: what zero bytes behind them would do."""

    def __init__(self, longest: int = LONGEST_WORD + 1):
        step = _byte_table()
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        columns = [bits]
        for _ in range(longest):
            last = columns[-1]
            columns.append((last >> 8) ^ step[last & 0xFF])
        self.longest = longest
        self.tables = np.stack([self._table(c) for c in columns]).reshape(-1)
        self.others: dict[int, np.ndarray] = {}
        self.one_byte = columns[1]

    @staticmethod
    def _table(columns: np.ndarray) -> np.ndarray:
        """For each of four bytes and each of its values, the xor of the columns of its bits."""
        table = np.zeros((4, 256), dtype=np.uint32)
        for k in range(4):
            for bit in range(8):
                size = 1 << bit
                table[k, size:2 * size] = table[k, :size] ^ columns[8 * k + bit]
        return table

    @staticmethod
    def _applied(table: np.ndarray, base, crc: np.ndarray) -> np.ndarray:
        moved = table[base + (crc & 0xFF).astype(np.int64)]
        for k in (1, 2, 3):
            moved ^= table[base + 256 * k + ((crc >> (8 * k)) & 0xFF).astype(np.int64)]
        return moved

    def _columns_of(self, n: int) -> np.ndarray:
        """The matrix for ``n`` bytes, by repeated squaring."""
        result = np.uint32(1) << np.arange(32, dtype=np.uint32)
        power = self.one_byte
        while n:
            if n & 1:
                result = self._applied(self._table(power).reshape(-1), 0, result)
            power = self._applied(self._table(power).reshape(-1), 0, power)
            n >>= 1
        return result

    def moved(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = self._applied(self.tables, np.minimum(lengths, self.longest).astype(np.int64) * 1024, crc)
        far = np.flatnonzero(lengths > self.longest)
        for length in np.unique(lengths[far]).tolist():
            if length not in self.others:
                if len(self.others) >= 4096:
                    self.others.clear()
                self.others[length] = self._table(self._columns_of(length)).reshape(-1)
            at = far[lengths[far] == length]
            out[at] = self._applied(self.others[length], 0, crc[at])
        return out


# --- payloads --------------------------------------------------------------


def _blocks(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` cut behind words, into pieces of about ``size`` bytes."""
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def block_payloads(block: bytes) -> np.ndarray:
    """Payloads ``(crc, crc behind a space, bytes with the space)`` of a block's words, in order.

    An end of a text is a word without bytes.
    """
    words = block.split()
    distinct = list(set(words))
    names, payloads = [], np.zeros((3, len(distinct)), dtype=np.uint32)
    stand_ins: dict[bytes, bytes] = {}
    for n, word in enumerate(distinct):
        if word != END_OF_TEXT:
            payloads[:, n] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        if len(word) > LONGEST_WORD:
            stand_ins[word] = word = b"\x01%d" % n
        names.append(word)
    if stand_ins:
        words = [stand_ins.get(w, w) for w in words]
    dictionary = ahocorasick.Automaton()
    for n, name in enumerate(names):
        dictionary.add_word(f" {name.decode('latin-1')} ", n)
    if not names:
        return payloads
    dictionary.make_automaton()
    said = f" {b' '.join(words).decode('latin-1')} "
    found = np.fromiter((n for _, n in dictionary.iter(said)), dtype=np.int64, count=len(words))
    return payloads[:, found]


class TextRuns:
    """Adds up what the runs of words of some texts come to, block by block."""

    def __init__(self, texts: list[bytes | None], shift: CrcShift, n_buckets: int = N_BUCKETS):
        self.n_texts, self.shift, self.n_buckets = len(texts), shift, n_buckets
        self.folded = b"".join(b"%b \x02 " % (t or b"").translate(FOLDED) for t in texts)

    def _ending(self) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For each block: whether a word ends a text, and the bucket of each run that ends
        with it, with whether the run lies within one text."""
        before = np.zeros((3, MAX_RUN - 1), dtype=np.uint32)  # what precedes all words is no word
        for block in _blocks(self.folded, BLOCK_BYTES):
            payloads = np.concatenate([before, block_payloads(block)], axis=1)
            crc, spaced, lengths = payloads
            is_word = lengths != 0
            ending = []
            run, whole = crc, is_word
            for n in range(1, MAX_RUN + 1):
                if n > 1:
                    run = self.shift.moved(run[:-1], lengths[n - 1:]) ^ spaced[n - 1:]
                    whole = whole[:-1] & is_word[n - 1:]
                ending.append((run[MAX_RUN - n:] % self.n_buckets, whole[MAX_RUN - n:]))
            yield ~is_word[MAX_RUN - 1:], ending
            before = payloads[:, payloads.shape[1] - MAX_RUN + 1:]

    def counts(self) -> np.ndarray:
        """How many runs fall into each bucket."""
        counts = np.zeros(self.n_buckets, dtype=np.int64)
        for _, ending in self._ending():
            for buckets, whole in ending:
                counts += np.bincount(buckets[whole], minlength=self.n_buckets)
        return counts

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words, runs, and the sum of its runs' gains."""
        totals = np.zeros((3, self.n_texts), dtype=np.int64)
        first = 0
        for is_end, ending in self._ending():
            text = np.cumsum(is_end) - is_end  # counted from the block's first text
            gained = np.zeros(len(text), dtype=np.int64)
            runs = np.zeros(len(text), dtype=np.int64)
            for buckets, whole in ending:
                gained += np.where(whole, gains[buckets], 0)
                runs += whole
            for row, amounts in zip(totals, (~is_end, runs, gained)):
                sums = np.bincount(text, weights=amounts)  # sums of integers far below 2**53
                row[first:first + len(sums)] += sums.astype(np.int64)
            first += int(is_end.sum())
        return tuple(totals)


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``PORTION_BYTES`` of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    reached = np.cumsum(np.asarray(lengths, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        begun = reached[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(reached, begun + PORTION_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _counting(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, counts = CrcShift(), np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for portion in _portions(batch, 0):
                counts += TextRuns(portion.column(0).to_pylist(), shift, n_buckets).counts()
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(there, pa.int32()), "n": pa.array(counts[there], pa.int64())})

    return run


def bucket_counts(texts: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS) -> DataFrame:
    """``(bucket, n)``: how many runs of all ``texts`` fall into each bucket that has any."""
    own = texts.select(quoted(text).cast("string").cast("binary").alias("text"))
    counted = own.mapInArrow(_counting(n_buckets), "bucket int, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _gain(t: float, s: float, all_t: float, all_s: float, n_buckets: int) -> int:
    return math.floor(1000 * math.log((t + 1) * (all_s + n_buckets) / ((s + 1) * (all_t + n_buckets))))


def bucket_gains(documents: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> list[int]:
    """1000 times the log of how much likelier each bucket is in the target, rounded down.

    Every bucket counts as seen once more than it was. The driver holds ``n_buckets`` counts
    of each side.
    """
    def counts(texts: DataFrame) -> list[float]:
        held = dict(map(tuple, bucket_counts(texts, n_buckets=n_buckets).collect()))
        return [float(held.get(b, 0)) for b in range(n_buckets)]

    s, t = counts(documents), counts(target)
    all_s, all_t = sum(s), sum(t)
    return [_gain(t[b], s[b], all_t, all_s, n_buckets) for b in range(n_buckets)]


def _scoring(gains: list[int]):
    table = np.asarray(gains, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = CrcShift()
        for batch in batches:
            for portion in _portions(batch, 1):
                numbers = TextRuns(portion.column(1).to_pylist(), shift, len(table)).weights(table)
                yield pa.RecordBatch.from_arrays(
                    [portion.column(0), *[pa.array(x, pa.int64()) for x in numbers]],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel draw, fixed by the seed and the id, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance_resample(
    documents: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every document, all long but the id.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred, rounded
    down, are drawn: those with the highest scores, equal ones by smaller ``doc_id`` (null
    last). ``rank`` numbers them from 1 and is null for all others. ``target`` needs a
    column ``text``, ``documents`` also ``doc_id``; others are not looked at.

    A null text has no words, like an empty one; a text without words weighs 0. A null id
    draws as an empty one. Repeated rows are documents of their own with the same score.
    Bytes that are no UTF-8 are bytes of words. Empty tables give empty results, and an
    empty target leaves every bucket as likely as its corpus counts make it.
    """
    kind = dict(documents.dtypes)["doc_id"]
    own = documents.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    gains = bucket_gains(documents, target)
    scored = own.mapInArrow(
        _scoring(gains), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint"
    )
    scored = cut_lineage(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    n_drawn = scored.filter(F.col("n_words") >= min_words).count() * percent // 100
    keyed = scored.select(
        "*", (F.col("n_words") < min_words).alias("short"), (-F.col("score")).alias("below"),
        F.col("doc_id").isNull().alias("unknown"),
    )
    numbered = global_row_number(keyed, ["short", "below", "unknown", "doc_id"], "n")
    rank = F.when(~F.col("short") & (F.col("n") <= n_drawn), F.col("n"))
    return numbered.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
