"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what
toxic text has beyond it; the second is used on top of the first. A text is cut
into windows of a few words, each window is compressed with both, and what the
toxic dictionary saves is a number of bytes that ordinary words, known to both,
leave near zero. The largest saving, the three largest together, and the share
of windows that save more than a threshold are turned into a probability by a
logistic fit on labelled texts that neither dictionary has seen.

Only the dictionaries and a few numbers leave the driver. They are fitted on at
most ``FIT_ROWS`` labelled rows of each class; whole texts of all rows are scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage

#: Labelled rows of each class that the fit uses, those with the smallest hash.
FIT_ROWS = 12_000
#: Of four fitted rows, one calibrates and the others train dictionaries.
CALIBRATE_ONE_OF = 4
WINDOW_WORDS = 6
#: A saving, in bytes, that counts a window as striking.
STRIKING = 3
PREDICT_FROM = 0.3
#: Bounds of the fit within these rows, so that the driver can train. Of ordinary texts,
#: passages of so many bytes from all over each text, so many in all (one of a text at
#: least); of a toxic text, so many of its speaking words, from all over it; and so many
#: beginnings that speak. Scoring has no bounds.
_ORDINARY_SAMPLES, _SAMPLE_BYTES = 80_000, 512
_TOXIC_WORDS, _SPEAKING = 1000, 5000
#: With fewer rows than this to calibrate, the same rows train and calibrate.
_LEAST_CALIBRATION = 20
#: The two dictionaries' sizes; the ordinary one is trained in parts.
_ORDINARY_PARTS, _PART_BYTES, _TOXIC_BYTES = 4, 1 << 18, 4096
#: Log-likelihood ratio from which a word's beginning speaks for toxic text.
_SPEAKS = 25.0
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_BEGINNINGS = (4, 5, 6, 8)
#: Words of a shingle by which copies among the labelled texts are told.
_COPY_WORDS = 4


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters of the whole text, A-Z lower-cased."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def _beginnings(word: bytes) -> list[bytes]:
    return [b" " + word[:n] for n in _BEGINNINGS if len(word) >= n] + [b" " + word + b" "]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Matches of six bytes and more, so that scraps of the dictionary do not count."""
    own = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        window_log=21, hash_log=18, chain_log=18, search_log=4, min_match=6, target_length=0,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False,
        write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    own.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=parameters)


@dataclass(frozen=True)
class ToxicityModel:
    """Two dictionaries, and the weights of a logistic function of the features."""

    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    base: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.base)
        x = (features - np.array(self.centre)) / np.array(self.spread) @ np.array(self.weights) + self.base
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Windows:
    """Features of whole texts under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain = _compressor(ordinary).compress
        self.marked = _compressor(ordinary + toxic).compress

    def savings(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        words, plain, marked = words_of(text), self.plain, self.marked
        out = []
        for i in range(0, len(words), WINDOW_WORDS):
            window = b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" "
            out.append(len(plain(window)) - len(marked(window)))
        return np.array(out or [0], dtype=np.int64)

    def features(self, text: str | None) -> np.ndarray:
        saved = np.sort(self.savings(text))[::-1]
        striking = saved >= STRIKING
        return np.array([
            saved[0], saved[:3].sum(), math.log1p(striking.sum()), 10 * striking.mean(),
            10 * saved.mean(), math.log(len(saved)),
        ])


def held_out(id_col: str) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _mixed(samples: list[bytes]) -> list[bytes]:
    """In an order that depends on the samples alone, and not on the alphabet.

    The trainer holds back the last of its samples, which must not be of one kind.
    """
    return sorted(samples, key=lambda s: (zlib.crc32(s), s))


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised likelihood; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    hold = penalty * np.eye(len(w))
    hold[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + hold, x.T @ (p - y) + hold @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """A model from the labelled rows that are not held out.

    Of both classes the ``fit_rows`` rows with the smallest hash of the id are
    used; their ids and labels are broadcast, so texts are filtered where they are
    read. Null ids or labels are no labels; of a row labelled twice the larger
    label holds. If a class has no row, each text scores the share of toxic ones.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .dropna().filter(~held_out("id"))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .withColumn("order", F.xxhash64("id"))
    )
    picked = None
    for toxic in (0, 1):
        part = known.filter(F.col("toxic") == toxic).orderBy("order", "id").limit(fit_rows)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), "id"
    )
    # no more than the rows of the fit, which several jobs read
    rows = cut_lineage(_one_of_copies(rows).select(
        "text", "toxic", (F.pmod("order", F.lit(CALIBRATE_ONE_OF)) == 0).alias("calibrates")
    ))
    sizes = {(r.toxic, r.calibrates): r.n for r in rows.groupBy("toxic", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {t: sum(v for (toxic, _), v in sizes.items() if toxic == t) for t in (0, 1)}
    if not n[0] or not n[1]:
        return ToxicityModel(b"", b"", (), (), (), n[1] / max(1, n[0] + n[1]))
    spare = min(sizes.get((t, True), 0) for t in (0, 1)) >= _LEAST_CALIBRATION
    training = rows.filter(~F.col("calibrates")) if spare else rows
    calibrating = rows.filter("calibrates") if spare else rows

    toxic_dictionary = _toxic_dictionary(training)
    ordinary_dictionary = _ordinary_dictionary(training)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(ordinary_dictionary, toxic_dictionary)
        for batch in batches:
            found = [windows.features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["features", "toxic"]
            )

    measured = calibrating.mapInArrow(measure, "features array<double>, toxic int").collect()
    x = np.array([r.features for r in measured])
    y = np.array([r.toxic for r in measured], dtype=np.float64)
    order = np.lexsort([y, *x.T[::-1]])  # sums do not depend on the order of arrival
    x, y = x[order], y[order]
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - centre) / spread, y)
    return ToxicityModel(
        ordinary_dictionary, toxic_dictionary, tuple(centre), tuple(spread), tuple(w[:-1]), float(w[-1])
    )


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """One labelled row of texts that share their smallest or largest shingle hash.

    Copies of a toxic text would make all of its words speak for toxicity.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                words = words_of(text.as_py())
                grams = zip(*[words[i:] for i in range(_COPY_WORDS)]) if len(words) >= _COPY_WORDS else [words]
                hashes = [zlib.crc32(b" ".join(g)) for g in grams]
                found.append((min(hashes), max(hashes)))
            low, high = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, low, high], names=["text", "toxic", "order", "low", "high"])

    rows = rows.select("text", "toxic", "order").mapInArrow(
        ends, "text string, toxic int, order long, low long, high long"
    )
    for end in ("low", "high"):
        first = F.min_by(F.struct("text", "order", "low", "high"), F.struct("order", F.xxhash64("text")))
        rows = rows.groupBy("toxic", end).agg(first.alias("row")).select("toxic", "row.*")
    return rows.select("text", "toxic", "order")


def _toxic_dictionary(training: DataFrame) -> bytes:
    """Trained on the words that speak for toxic text, as toxic texts have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column(0), batch.column(1)):
                counts[toxic.as_py() == 1].update(
                    {b for w in set(words_of(text.as_py())) for b in _beginnings(w)}
                )
            keys = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()),
                 pa.array([counts[0][k] for k in keys], pa.int64())],
                names=["beginning", "a", "b"],
            )

    n0, n1 = (training.filter(F.col("toxic") == t).count() for t in (0, 1))
    if not n0 or not n1:
        return b""
    counted = training.select("text", "toxic").mapInArrow(count, "beginning binary, a long, b long")
    counted = counted.groupBy("beginning").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def term(k: Column, total: Column | int, p: Column) -> Column:
        q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        return k * F.log(q) + (F.lit(total) - k) * F.log(1 - q)

    a, b = F.col("a"), F.col("b")
    p = (a + b) / F.lit(n0 + n1)
    ratio = 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))
    speaks = counted.filter((a >= 5) & (a / n1 > 10 * (b + 0.5) / n0) & (ratio > _SPEAKS))
    speaking = frozenset(bytes(r.beginning) for r in speaks.orderBy(ratio.desc(), "beginning").limit(_SPEAKING).collect())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                own = [w for w in words_of(text.as_py()) if not speaking.isdisjoint(_beginnings(w))]
                if own:
                    found.append(b" " + b" ".join(own[::-(-len(own) // _TOXIC_WORDS)]) + b" ")
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["sample"])

    toxic = training.filter("toxic = 1").select("text").mapInArrow(sample, "sample binary")
    return _dictionary(_TOXIC_BYTES, _mixed([bytes(r.sample) for r in toxic.collect()]))


def _ordinary_dictionary(training: DataFrame) -> bytes:
    """Trained in parts on passages from all over the ordinary texts."""
    n = max(1, training.filter("toxic = 0").count())
    each = max(1, _ORDINARY_SAMPLES // n)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0):
                words = b" " + b" ".join(words_of(text.as_py())) + b" "
                step = max(_SAMPLE_BYTES, len(words) // each)
                found += [words[i : i + _SAMPLE_BYTES] for i in range(0, len(words), step)][:each]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["sample"])

    plain = training.filter("toxic = 0").select("text").mapInArrow(sample, "sample binary")
    samples = _mixed([bytes(r.sample) for r in plain.collect()])
    return b"".join(_dictionary(_PART_BYTES, samples[i::_ORDINARY_PARTS]) for i in range(_ORDINARY_PARTS))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 for each whole text; a null text is empty."""
    names = [f"__column_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    rows = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(model.ordinary, model.toxic)
        for batch in batches:
            found = np.array([windows.features(t.as_py()) for t in batch.column(at)]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.scores(found), pa.float64())], names=[*names, "score"]
            )

    schema = ", ".join([f"{n} {t}" for n, t in rows.dtypes] + ["score double"])
    return rows.mapInArrow(run, schema).toDF(*docs.columns, score_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(id, held_out, score, predicted)``, one row for each row of ``docs``.

    ``predicted`` is 1 from a score of ``PREDICT_FROM``. Null and empty texts are
    scored like a text without striking windows. Repeated rows score alike; an
    empty table gives none, and without labels all score 0.
    """
    model = fit(docs, labels, id_col, text_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = score(rows, model).select("id", "score")
    return scored.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
        (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"),
    )


def ordinary_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without those predicted to be toxic.

    Null and empty texts are scored like a text without striking windows, repeated rows
    alike; an empty table gives none. All columns of ``docs`` stay, whatever their names.
    """
    model = fit(docs, labels, text_col=text_col, **options)
    names = [f"__column_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    scored = score(docs.toDF(*names), model, text, "score")
    return scored.filter(F.col("score") < PREDICT_FROM).drop("score").toDF(*docs.columns)
