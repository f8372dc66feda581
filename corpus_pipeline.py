"""From raw documents to packed sequences, by the operators of ``clusterloom.llm``.

Each stage works on what its predecessor kept and writes its own decisions into
the documents: toxic ones go, one of each group of near copies stays, repeated
passages are cut to their first copy, sources are brought to their target
weights, and what is left is packed into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clusterloom.lineage import new_folder, remove_folder
from clusterloom.llm import mixing, packing, simhash, suffixes, toxicity

#: Near copies share this much of their five-word shingles.
COPY_SIMILARITY = 0.8
COPY_SHINGLE = 5
#: Bits by which their fingerprints may differ before the shingles are compared.
COPY_RADIUS = simhash.COPY_RADIUS
#: A wide radius prunes less, so trees are kept smaller than by default.
COPY_SHARD = 1024

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents predicted to be toxic."""
    return toxicity.ordinary_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.one_of_each_group(
        docs, groups=simhash.near_copies, similarity=COPY_SIMILARITY, shingle=COPY_SHINGLE,
        radius=COPY_RADIUS, shard_size=COPY_SHARD,
    )


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that an earlier document has."""
    return suffixes.deduplicated(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes, repeats and cuts documents to their sources' targets."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences."""
    return packing.pack_documents(
        docs, public_tokenizers.path("word_bpe_49k.json"),
        max_documents=packing.MAX_DOCUMENTS, max_attention=packing.MAX_ATTENTION,
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("suffix_array_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Hashes of the fits, shingles and draws are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order.

    What a stage keeps is written as Parquet beside the checkpoints and read again, so the
    next one's jobs do not make it anew, and no lost executor changes what they see. It
    goes when the next stage's is there.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
