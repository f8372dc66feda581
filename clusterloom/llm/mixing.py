"""Mixing sources to target weights by Sainte-Laguë apportionment.

Highest quotients ``target / (2 * seats + 1)`` give each source a whole number of
words, and so a number of blocks of ``block_words`` words and a shorter last one. The
same rule shares a source's blocks among its shards by their size; the last goes to
the shard that would get the next one. In a shard
the documents of a source form one stream in seeded order, cut into blocks; as
many whole passes as the quota holds take every document, and a seeded
permutation of the blocks supplies the rest, the last one in part.

Texts are only counted, never shuffled (unless carried on purpose). A source is
cut into shards of bounded size by a hash of the row, so one that holds most rows
is many small windows. The driver holds one row for each source, which is the
size of the mix's own configuration.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm.common import SPACE

SEED = 20_240_601
BLOCK_WORDS = 32
ROWS_PER_SHARD = 4096
MOST_COPIES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def repeating_weights(sources: Sequence[str | None]) -> list[int]:
    """1, 2, 3, 1, 2, 3, ... in the order given."""
    return [i % 3 + 1 for i in range(len(sources))]


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the whole by weight, none above ``most`` times its own size.

    The excess of the sources that stop there is shared by weight among the
    others until none is above.
    """
    caps = [Fraction(most) * s for s in sizes]
    weights = [Fraction(w) for w in weights]
    targets = [Fraction(0)] * len(sizes)
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: caps[i] / weights[i])
    left, weight = Fraction(sum(sizes)), sum(weights, Fraction(0))
    for place, i in enumerate(order):
        if left / weight <= caps[i] / weights[i]:
            for j in order[place:]:
                targets[j] = left * weights[j] / weight
            break
        targets[i] = caps[i]
        left, weight = left - caps[i], weight - weights[i]
    return [float(t) for t in targets]


def sainte_lague(shares: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients ``share / (2 * seats + 1)``; ties go to the first.

    Starts at the rounded proportional seats and moves single seats until the sum
    is right and no seat has a lower quotient than one not given.
    """
    shares = np.asarray(shares, dtype=np.float64)
    total = shares.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(shares), dtype=np.int64)
    given = np.floor(shares * (seats / total) + 0.5).astype(np.int64)
    while True:
        gain = shares / (2 * given + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            loss = np.where(given > 0, shares / (2 * given - 1), np.inf)
        excess = int(given.sum()) - seats
        best, worst = int(gain.argmax()), len(loss) - 1 - int(loss[::-1].argmin())
        if excess > 0:
            given[worst] -= 1
        elif excess < 0:
            given[best] += 1
        elif gain[best] > loss[worst]:
            given[best] += 1
            given[worst] -= 1
        else:
            return given


def _shard_plan(block_words: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For the shards of one source: whole passes, and which blocks fill the rest."""

    def plan(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("shard", ignore_index=True)
        most = cells["words"].to_numpy() * MOST_COPIES
        sizes = cells["words"].to_numpy(dtype=np.float64)
        blocks, last = divmod(int(cells["quota"].iloc[0]), block_words)
        seats = sainte_lague(sizes, blocks)
        quotas = seats * block_words
        quotas[(sizes / (2 * seats + 1)).argmax()] += last
        fits = np.minimum(quotas, most)
        # what is too much for a shard goes to the first ones with room
        room = np.cumsum(most - fits)
        fits += np.diff(np.minimum(room, (quotas - fits).sum()), prepend=0)
        rows = []
        for shard, words, wanted in zip(cells["shard"], cells["words"], fits):
            words, wanted = int(words), int(wanted)
            blocks = max(1, -(-words // block_words))
            passes, rest = divmod(wanted, words) if words else (0, 0)
            draw = np.random.default_rng([seed, int(shard), blocks])
            stride, start = int(draw.integers(1, blocks + 1)), int(draw.integers(0, blocks))
            while math.gcd(stride, blocks) != 1:
                stride += 1
            # the last block of the stream may be short; find its place in the order
            last = (stride * (blocks - 1) + start) % blocks
            short = words - block_words * (blocks - 1)
            if rest <= last * block_words:
                full, part = divmod(rest, block_words)
            elif rest <= last * block_words + short:
                full, part = last, rest - last * block_words
            else:
                full, part = divmod(rest - last * block_words - short, block_words)
                full += last + 1
            rows.append((shard, passes, blocks, stride, start, full, part))
        out = pd.DataFrame(rows, columns=["shard", "passes", "blocks", "stride", "start", "full", "part"])
        out.insert(0, "source_key", cells["source_key"].iloc[0])
        return out

    return plan


def mix_sources(
    docs: DataFrame,
    weights: Callable[[Sequence[str | None]], Sequence[float]] = repeating_weights,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: Sequence[str] = (),
    block_words: int = BLOCK_WORDS,
    rows_per_shard: int = ROWS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of each row of ``docs``.

    ``weights`` gets the sources in code point order, null last, and gives one
    weight for each. Returned are the key, ``source``, ``size`` (words of the
    text, 0 for null), ``source_size``, ``target``, ``passes`` (whole copies),
    ``ranges`` (word spans that are taken once more, ascending) and ``taken``
    (words, repeats counted), and the columns named in ``carry``.

    All sources together take as many words as there are. No row exceeds three
    times its size. A null source is a source of its own; rows without words
    take 0; an empty table gives none. Repeated rows and null keys are rows like
    any other: rows that are equal in key and text may swap what they take.
    """
    source = F.col(source_col)
    rows = docs.select(
        F.col(id_col).alias("__id"),
        source.alias("__source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("source_key"),
        n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__mix"),
        *[F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)],
    )
    spark = docs.sparkSession
    totals = rows.groupBy("source_key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # null (an empty key) last; the others all begin with the same letter
    sources = sorted(totals.collect(), key=lambda r: (r.source_key == "", r.source_key.encode()))
    shares = weights([r.source_key[1:] if r.source_key else None for r in sources])
    targets = capped_targets([r["size"] for r in sources], shares, MOST_COPIES)
    quotas = sainte_lague(targets, round(sum(targets)))
    n_shards = max(1, -(-sum(r.n for r in sources) // rows_per_shard))
    mix = spark.createDataFrame(
        [(r.source_key, r["size"], t, int(q)) for r, t, q in zip(sources, targets, quotas)],
        "source_key string, source_size long, target double, quota long",
    )

    rows = rows.withColumn("shard", F.pmod(F.col("__mix"), F.lit(n_shards)))
    cells = rows.groupBy("source_key", "shard").agg(F.sum("size").alias("words"))
    plan = (
        cells.join(mix, "source_key")
        .groupBy("source_key")
        .applyInPandas(
            _shard_plan(block_words, seed),
            "source_key string, shard long, passes long, blocks long, stride long, start long, "
            "full long, part long",
        )
    )
    stream = Window.partitionBy("source_key", "shard").orderBy("__mix", "__id", "size")
    placed = rows.withColumn(
        "first",
        F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    )
    joined = placed.join(plan, ["source_key", "shard"]).join(mix, "source_key")

    first, size, b = F.col("first"), F.col("size"), F.lit(block_words)

    def taken_of(block: Column) -> Column:
        """The words of a block that the rest takes, as a span of the document."""
        place = (F.col("stride") * block + F.col("start")) % F.col("blocks")
        long = F.when(place < F.col("full"), b).when(place == F.col("full"), F.col("part")).otherwise(0)
        lo = F.greatest(block * b - first, F.lit(0))
        hi = F.least(block * b + long - first, size)
        return F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))

    blocks = F.sequence(F.floor(first / b), F.floor((first + size - 1) / b))
    spans = F.filter(F.transform(blocks, taken_of), lambda s: s["hi"] > s["lo"])
    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    joined = joined.withColumn("ranges", F.when(size > 0, spans).otherwise(nothing))
    more = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("__source").alias(source_col),
        "size", "source_size", "target", "passes", "ranges",
        (F.col("passes") * size + more).alias("taken"),
        *[F.col(f"__carry_{i}").alias(c) for i, c in enumerate(carry)],
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``.

    A document comes once for each whole pass and once more with the words of
    its ranges, joined by single spaces; one that the mix takes nothing of is
    left out. ``n_chars``, where there is one, follows the text.
    """
    # numbered names, so that no column clashes with the mix's own
    name = {c: f"__column_{i}" for i, c in enumerate(docs.columns)}
    others = [n for c, n in name.items() if c not in (id_col, source_col)]
    text = name[text_col]
    mixed = mix_sources(docs.toDF(*name.values()), id_col=name[id_col], source_col=name[source_col],
                        text_col=text, carry=others, **options)
    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")

    def spans_of(all_words: Column) -> Column:
        spans = F.transform("ranges", lambda s: F.slice(all_words, s["lo"] + 1, s["hi"] - s["lo"]))
        return F.array_join(F.flatten(spans), " ")

    # as the variable of a function the words are split once, not again for each span
    part = F.get(F.transform(F.array(words), spans_of), 0)
    copies = F.array_repeat(F.col(text), F.col("passes").cast("int"))
    parts = F.when(F.size("ranges") > 0, F.array(part)).otherwise(F.array().cast("array<string>"))
    taken = mixed.withColumn("__text", F.explode(F.concat(copies, parts)))
    result = {c: F.col(n) for c, n in name.items()} | {text_col: F.col("__text")}
    if "n_chars" in result:
        result["n_chars"] = F.length("__text").cast("long")
    return taken.select(*[v.alias(c) for c, v in result.items()])
