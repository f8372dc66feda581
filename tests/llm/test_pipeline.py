"""The pipeline's stages over the smallest tables, each against a plain version."""

import json

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from clusterloom.llm import mixing, simhash, suffixes, toxicity
from tests.conftest import SF_DIR
from tests.llm.test_near_copies import brute as brute_copies
from tests.llm.test_packing import check
from tests.llm.test_suffixes import brute as brute_repeats


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made, written and read again, after the documents themselves."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF_DIR).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "mixing", "packing"
    ]
    assert corpus_pipeline.ORACLE_SQL is None
    assert contract.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in contract.oracle_sql()
    names = {n.split("_")[0] for n in contract.queries() if n.startswith("op") and n[2].isdigit()}
    assert names == {f"op{i}" for i in range(1, 14)}


def test_all_but_the_last_return_documents(stages):
    for made in stages[1:-1]:
        assert made.dtypes == stages[0].dtypes


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    said = toxicity.toxicity(stages[0], labels).filter("predicted = 0").select("doc_id").collect()
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in said)


def test_one_near_copy_stays(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(brute_copies(rows)))


def test_columns_that_stages_use_themselves_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    odd = docs.withColumns({c: F.lit(c) for c in ("__row", "row", "__score", "key", "held", "__text", "extra", "bits", "node")})
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    for kept in (toxicity.ordinary_documents(odd, labels), simhash.one_of_each_group(odd, groups=simhash.near_copies),
                 suffixes.deduplicated(odd), mixing.mixed_documents(odd)):
        assert kept.dtypes == odd.dtypes
        for r in kept.collect():
            assert all(r[c] == c for c in odd.columns[5:])


def test_of_equal_texts_one_fixed_row_stays(spark):
    rows = [(1, "the same text", s) for s in "abcdef"] * 2
    made = [
        simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)).collect()
        for n in (1, 3, 7)
    ]
    assert len(made[0]) == 1 and made[0] == made[1] == made[2]


def test_words_are_split_once(spark):
    docs = spark.createDataFrame([(1, "word " * 9000, "a")], "doc_id long, text string, source string")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_repeats_are_cut(stages):
    keyed = {r.h: (r.doc_id, r.text) for r in stages[2].select(suffixes.row_hash().alias("h"), "doc_id", "text").collect()}
    extra = {h: e for h, (_, e) in brute_repeats([(h, t) for h, (_, t) in keyed.items()], 50).items()}
    want = {}
    for h, (doc, text) in keyed.items():
        spans = [{"lo": a, "hi": b} for a, b in extra.get(h, [])]
        left = suffixes.without(text.encode(), spans).decode()
        if not spans or left.split():
            want[doc] = left
    assert {r.doc_id: r.text for r in stages[3].collect()} == want


def test_mixture_holds_the_words_decided(stages):
    decided = mixing.mix_sources(stages[3]).groupBy("doc_id").agg(F.sum("taken").alias("n"))
    want = {r.doc_id: r.n for r in decided.collect() if r.n}
    got = {}
    for r in stages[4].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want


def test_packing_is_a_round_trip(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(f"{r.doc_id}/{i}", r.text) for i, r in enumerate(stages[4].orderBy("doc_id").collect())]
    # copies of a document are told apart for the comparison only
    spark = stages[4].sparkSession
    table = spark.createDataFrame(docs, "doc_id string, text string")
    n, total = check(corpus_pipeline.packing_stage(spark, table, SF_DIR).collect(), docs, tokenizer)
    assert n <= total / 2048 * 1.02 + 1
    rows = stages[5].collect()
    assert sum(r.length for r in rows) == total
    assert json.dumps(sorted((r.length, r.ids_crc32) for r in rows))


def test_run_applies_all_stages(spark, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF_DIR).select(*key).collect()
    assert sorted(got) == sorted(stages[5].select(*key).collect())
