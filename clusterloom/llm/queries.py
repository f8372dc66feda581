"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.lineage import new_folder, remove_folder
from clusterloom.llm import archives, chat, embeddings, fingerprints, html_text, mixing, packing, repair, resampling, simhash, suffixes, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]

#: Host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["lo"], s["hi"])), ",")
    return rendered.withColumn("spans", spans)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with repeated passages, as word spans."""
    documents = table(spark, sf_dir, "documents")
    found = suffixes.repeated_passages(documents)
    ids = documents.select("doc_id", suffixes.row_hash().alias("row"))

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["lo"], s["hi"])), ",")

    return ids.join(found, "row").select(
        "doc_id", text("passages").alias("passages"), text("extra").alias("extra")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing.pack_documents(
        documents, public_tokenizers.path("word_bpe_49k.json"),
        max_documents=packing.MAX_DOCUMENTS, max_attention=packing.MAX_ATTENTION,
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, copies = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_digests(turns, copies)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold; they go when their records have been read."""
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    records = archives.archived_pages(spark, table(spark, sf_dir, "pages"), arc, warc)
    for folder in (arc, warc):
        remove_folder(spark, folder)
    return records


QUERIES: dict[str, Query] = {
    "op1_embeddings": op1_embeddings,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_suffixes": op6_suffixes,
    "op7_packing": op7_packing,
    "op8_html_text": op8_html_text,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_repair": op11_repair,
    "op12_resampling": op12_resampling,
    "op13_archives": op13_archives,
}
