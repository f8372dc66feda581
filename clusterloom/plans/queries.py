"""Every job over the driver's tables, one query per name.

Input mapping: traffic measurements are ``events`` (reported by ``user_id``),
roads are ``customer``, items with many properties are ``embeddings``,
accelerometer samples by model are ``lineitem`` by return flag, audit lines are
rendered from ``events``.  The query fingerprints are one majority fingerprint
per label, derived from all embeddings, so every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clusterloom.functions import bits
from clusterloom.functions.tables import register_table_functions
from clusterloom.lineage import new_folder
from clusterloom.operators import audit, ftest, kmeans, matrix, ordered, scan, similarity, subset
from clusterloom.plans import traffic
from clusterloom.sources import (
    TRAFFIC_METADATA_SCHEMA,
    TRAFFIC_RAWDATA_SCHEMA,
    read_audit_log,
    read_traffic_metadata,
    read_traffic_rawdata,
    session_lines,
)

DIMENSIONS = 64
K = 5
CONVERGED_PASSES = 15
SESSION_USER = 1001
FEATURES = ["value", "hour", "dow"]
START_CENTROIDS = [
    (0, [10.0, 3.0, 0.0]),
    (1, [30.0, 9.0, 2.0]),
    (2, [60.0, 12.0, 3.0]),
    (3, [100.0, 15.0, 4.0]),
    (4, [180.0, 21.0, 6.0]),
]
MOVED_CENTROIDS = [
    (0, [8.0, 4.0, 1.0]),
    (1, [32.0, 10.0, 3.0]),
    (2, [55.0, 13.0, 3.0]),
    (3, [95.0, 14.0, 3.0]),
    (4, [170.0, 20.0, 5.0]),
]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs ----------------------------------------------------------------


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as items: key, reporter, time and three numeric features."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("report_id"),
        "ts",
        "value",
        F.hour(ts).cast("double").alias("hour"),
        (F.dayofweek(ts) - 1).cast("double").alias("dow"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("report_id"), "c_nationkey", "c_acctbal"
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", bits.sign_words("embedding", DIMENSIONS).alias("words")
    )


def label_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label, the fingerprint of the bits that more than half of its items have."""
    embeddings = table(spark, sf_dir, "embeddings")
    counts = embeddings.groupBy("label").agg(
        *[F.count_if(F.expr(f"embedding[{i}] > 0")).alias(f"n{i}") for i in range(DIMENSIONS)],
        F.count(F.lit(1)).alias("n"),
    )
    majority = F.array(*[2 * F.col(f"n{i}") - F.col("n") for i in range(DIMENSIONS)])
    return counts.select("label", majority.alias("m")).select(
        "label", bits.sign_words("m", DIMENSIONS).alias("words")
    )


def bit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each item and of the item with the next key."""
    items = fingerprints(spark, sf_dir).select("vec_id", F.col("words").alias("a"))
    following = items.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return items.join(following, "vec_id")


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines of a session in which each event is a process.

    Every event gives an exec and an exit event; sign-ups also log in, and
    errors leave a line that is no audit record. Machines are x86-64 or arm64.
    First arguments look like arguments themselves or are hexadecimal, and clicks
    make a process that lives on call what would be an exit on 32-bit x86.
    """
    events = table(spark, sf_dir, "events")
    # an event makes three long lines, so its file has far fewer parts than a log of them would have
    e = events.repartition(ordered.n_partitions(events)).select(
        (F.col("event_id") + 2).alias("pid"),
        F.expr("event_id div 2 + 1").alias("ppid"),
        "user_id", "event_type", "props",
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("sec"),
        F.date_format("ts", "SSS").alias("ms"),
    )

    def stamp(serial: str) -> str:
        return f"concat('msg=audit(', sec, '.', ms, ':', {serial}, '): ')"

    process = (
        "concat(' ppid=', ppid, ' pid=', pid, ' auid=1000 uid=', user_id, ' euid=', user_id, "
        "' comm=\"', event_type, '\" exe=\"/usr/bin/', event_type, '\" "
        "subj=system_u:system_r:', event_type, '_t:s0')"
    )
    first = (
        "CASE pid % 4 WHEN 0 THEN concat('\"', user_id, '\"') WHEN 1 THEN concat('\"--data1=', user_id, '\"') "
        "WHEN 2 THEN hex(concat('-f a2=', user_id, ' \"x\"')) ELSE concat('\"a3=', user_id, '\"') END"
    )
    arm = "pid % 7 = 0"
    lines = [
        f"concat('type=SYSCALL ', {stamp('3 * pid')}, CASE WHEN {arm} THEN 'arch=c00000b7 syscall=221' "
        f"ELSE 'arch=c000003e syscall=59' END, ' success=yes', {process})",
        f"concat('type=EXECVE ', {stamp('3 * pid')}, 'argc=', pid % 3 + 1, ' a0=\"', event_type, '\"', "
        f"CASE WHEN pid % 3 > 0 THEN concat(' a1=', {first}) ELSE '' END, "
        "CASE WHEN pid % 3 > 1 THEN concat(' a2=\"', pid, '\"') ELSE '' END)",
        f"concat('type=SYSCALL ', {stamp('3 * pid + 1')}, CASE WHEN {arm} THEN 'arch=c00000b7 syscall=94' "
        f"ELSE 'arch=c000003e syscall=231' END, {process})",
        f"CASE WHEN event_type = 'click' THEN concat('type=SYSCALL ', {stamp('3 * pid + 2')}, "
        "'arch=c000003e syscall=252 ppid=1 pid=', pid + 5000000000, ' auid=1001 euid=0') END",
        f"CASE WHEN event_type = 'signup' THEN concat('type=LOGIN ', {stamp('3 * pid + 2')}, "
        "'pid=1 uid=0 auid=1000') END",
        "CASE WHEN event_type = 'error' THEN props END",
    ]
    return e.select(F.explode(F.expr(f"array({', '.join(lines)})")).alias("value")).filter(
        "value IS NOT NULL"
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("uid"), F.col("c_name").alias("name")
    )


# --- queries ---------------------------------------------------------------


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def popc(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fingerprints(spark, sf_dir).select(
        "vec_id", bits.words_to_binary("words", DIMENSIONS // 32).alias("a")
    )
    return items.select("vec_id", bits.popc("a").alias("n_bits"))


def _pair_query(operator: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counted = bits.word_count(F.col("a"), F.col("b"), operator, DIMENSIONS // 32).alias("n_bits")
        return bit_pairs(spark, sf_dir).select("vec_id", counted)

    return run


def popc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts by the SQL functions, over bit strings as binary."""
    bits.register_sql_functions(spark)
    n = DIMENSIONS // 32
    pairs = bit_pairs(spark, sf_dir).select(
        "vec_id", bits.words_to_binary("a", n).alias("a"), bits.words_to_binary("b", n).alias("b")
    )
    return pairs.selectExpr(
        "vec_id", "popc(a) AS n_bits", "popc_and(a, b) AS n_and", "popc_or(a, b) AS n_or",
        "popc_xor(a, b) AS n_xor",
    )


def tanimoto_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the fingerprint of its own label."""
    labels = label_fingerprints(spark, sf_dir).withColumnRenamed("words", "label_words")
    pairs = fingerprints(spark, sf_dir).join(labels, "label")
    compared = similarity.tanimoto_rows(pairs, "words", "label_words", DIMENSIONS // 32)
    return rounded(compared.select("vec_id", "label", "similarity"), ["similarity"])


def knn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fingerprints(spark, sf_dir).drop("label")
    scores = similarity.knn_similarity(items, label_fingerprints(spark, sf_dir), 5, "vec_id")
    return scores.select("vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def knn_similarity_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores by the form for query tables too large to ship."""
    items = fingerprints(spark, sf_dir).drop("label")
    queries = label_fingerprints(spark, sf_dir)
    scores = similarity.knn_similarity(items, queries, 5, "vec_id", max_shipped_bytes=0)
    return scores.select("vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def knn_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against the fingerprints of all items, shipped to the tasks."""
    items = fingerprints(spark, sf_dir).drop("label")
    scores = similarity.knn_similarity(items, items, 5, "vec_id")
    return scores.select("vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def knn_similarity_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item against the items whose id is divisible by 50, none of them shipped."""
    items = fingerprints(spark, sf_dir).drop("label")
    queries = items.filter("vec_id % 50 = 0")
    scores = similarity.knn_similarity(items, queries, 5, "vec_id", max_shipped_bytes=0)
    return scores.select("vec_id", F.round(F.col("score").cast("double"), 5).alias("score"))


def knn_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores by the table function, called from SQL."""
    register_table_functions(spark)
    fingerprints(spark, sf_dir).createOrReplaceTempView("knn_sql_items")
    label_fingerprints(spark, sf_dir).createOrReplaceTempView("knn_sql_queries")
    spark.sql("DECLARE OR REPLACE VARIABLE knn_sql_words ARRAY<ARRAY<BIGINT>>")
    spark.sql("SET VAR knn_sql_words = (SELECT collect_list(words) FROM knn_sql_queries)")
    return spark.sql("""
        SELECT vec_id, round(CAST(score AS DOUBLE), 5) AS score
        FROM knn_similarity(items => TABLE(SELECT vec_id, words FROM knn_sql_items), queries => knn_sql_words)
    """)


def kmeans_assign_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of given centroids by the table function, called from SQL."""
    register_table_functions(spark)
    measurements(spark, sf_dir).createOrReplaceTempView("assign_sql_items")
    centres = ", ".join(f"array({', '.join(f'{x}D' for x in vector)})" for _, vector in START_CENTROIDS)
    return spark.sql(f"""
        SELECT event_id, cid FROM nearest_centroid(
            items => TABLE(SELECT event_id, array({', '.join(FEATURES)}) AS v FROM assign_sql_items),
            centroids => array({centres}))
    """)


def _rounded_test(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, ["var1", "var2", "f"]), ["lower", "upper"], 5)


def f_test_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    values = ["l_quantity", "l_discount", "l_tax"]
    return _rounded_test(ftest.f_test_two_groups(lineitem, "l_returnflag", values, "A", "N"))


def f_test_vs_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _rounded_test(ftest.f_test_vs_control(events, "event_type", "value", "click"))


def kmeans_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.kmeans_validate(measurements(spark, sf_dir), "event_id", FEATURES, K)


def kmeans_init_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids = kmeans.init_random(measurements(spark, sf_dir), "event_id", FEATURES, K)
    return rounded(centroids, FEATURES)


def kmeans_init_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    return kmeans.init_hash(events, "event_id", K)


def kmeans_init_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    return kmeans.init_roundrobin(events, "event_id", K)


def kmeans_pp_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.kmeans_plus_plus(measurements(spark, sf_dir), "event_id", FEATURES, K)


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = measurements(spark, sf_dir)
    return kmeans.kmeans_assign(items, FEATURES, START_CENTROIDS).select("event_id", "cid")


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kmeans.kmeans_assign(measurements(spark, sf_dir), FEATURES, START_CENTROIDS)
    return rounded(kmeans.kmeans_update(items, "cid", FEATURES), FEATURES)


def kmeans_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kmeans.kmeans_assign(measurements(spark, sf_dir), FEATURES, START_CENTROIDS)
    both = kmeans.kmeans_assign(items, FEATURES, MOVED_CENTROIDS, "new_cid")
    return kmeans.kmeans_changes(both, "cid", "new_cid")


def kmeans_changes_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same count from two cluster tables."""
    items = measurements(spark, sf_dir)
    old = kmeans.kmeans_assign(items, FEATURES, START_CENTROIDS).select("event_id", "cid")
    new = kmeans.kmeans_assign(items, FEATURES, MOVED_CENTROIDS).select("event_id", "cid")
    return kmeans.kmeans_changes_between(old, new, "event_id")


def kmeans_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows moved in each pass, up to the pass in which no more than 5 % of them moved."""
    items = measurements(spark, sf_dir)
    model = kmeans.kmeans_fit(
        items, "event_id", FEATURES, K, init="hash", max_iter=CONVERGED_PASSES, empty="zero",
        changed_at_most=items.count() // 20,
    )
    rows = list(enumerate(model.changes, 2))
    return spark.createDataFrame(rows, "pass int, n_changed long")


def kmeans_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = kmeans.kmeans(
        measurements(spark, sf_dir), "event_id", FEATURES, K, init="random", max_iter=10
    )
    return clusters.select("cid", "event_id", "report_id", *FEATURES)


def kmeans_sql_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same driver, seeded by k-means++."""
    clusters = kmeans.kmeans(
        measurements(spark, sf_dir), "event_id", FEATURES, K, init="plus", max_iter=10
    )
    return clusters.select("cid", "event_id")


def kmeans_sql_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same driver over a wide array column."""
    clusters = kmeans.kmeans(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, init="random", max_iter=5
    )
    return clusters.select("cid", "vec_id")


def kmeans_stored_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters with centroids as a table, and rounds from which the loop can go on."""
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = kmeans.kmeans_fit(
        embeddings, "vec_id", "embedding", 8, init="random", max_iter=5, folder=new_folder(spark, "kmeans")
    )
    return model.assign(embeddings).select("cid", "vec_id")


def kmeans_fixed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.kmeans_fixed_rounds(measurements(spark, sf_dir), "event_id", FEATURES, K)


def kmeans_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.kmeans_roundrobin(measurements(spark, sf_dir), "event_id", FEATURES, K)


def kmeans_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = measurements(spark, sf_dir)
    return kmeans.kmeans_join_back(items, "event_id", ["value", "hour"], K, n_rounds=10)


def distance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    _, pivot = subset.pick_item(items, "vec_id", "embedding")
    return rounded(subset.distance_table(items, "vec_id", "embedding", pivot), ["dist"])


def minmax_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    picks = subset.minmax_subset(items, "vec_id", "label", "embedding", 10)
    return rounded(picks, ["dist"])


def traffic_dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.cluster_reports(measurements(spark, sf_dir), "event_id", "report_id", FEATURES, K)


def traffic_time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant clusters within each time slice, from one loop over all slices."""
    items = measurements(spark, sf_dir)
    summary = traffic.cluster_reports_by_slice(items, "event_id", "report_id", "ts", FEATURES, K)
    return summary.withColumnRenamed("slice", "time_slice")


def traffic_map_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = traffic.cluster_reports(
        measurements(spark, sf_dir), "event_id", "report_id", FEATURES, K
    )
    points = ["c_nationkey", "c_acctbal", "c_acctbal", "c_nationkey"]
    return traffic.map_report(summary, roads(spark, sf_dir), "report_id", points)


def _written_csv(df: DataFrame, folder: str, schema: str) -> str:
    """Writes ``df`` as CSV with a header and all columns of ``schema``, those it lacks empty."""
    kinds = StructType.fromDDL(schema)
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds
    ]
    df.select(*columns).write.csv(folder, header=True)
    return folder


def traffic_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements from many CSV files with a header as one table, and roads from one file."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("report_id"), F.col("ts").alias("timestamp"), F.hour("ts").alias("vehicle_count")
    )
    raw = _written_csv(events.repartition(7, "report_id"), new_folder(spark, "rawdata"), TRAFFIC_RAWDATA_SCHEMA)
    named = roads_with_names(spark, sf_dir).coalesce(1)
    meta = _written_csv(named, new_folder(spark, "metadata"), TRAFFIC_METADATA_SCHEMA)
    latest = F.max(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("latest")
    summary = read_traffic_rawdata(spark, raw).groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("vehicle_count").cast("long").alias("vehicles"), latest
    )
    names = read_traffic_metadata(spark, meta).select("report_id", "report_name")
    return summary.join(names, "report_id")


def roads_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("report_id"), F.col("c_name").alias("report_name")
    )


def audit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = audit.audit_parse(audit_lines(spark, sf_dir))
    numbers = ["serial", "ppid", "pid", "auid", "euid", "argc"]  # -1 where absent, for comparison
    return parsed.withColumns({
        "event_time": F.col("event_time").cast("string"),
        **{n: F.coalesce(n, F.lit(-1)) for n in numbers},
    })


def piecewise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXECVE records of events whose first argument is long: three pieces in two records."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("sec"),
        F.date_format("ts", "SSS").alias("ms"),
        F.expr("hex(repeat(concat('é ', event_type, ' ', user_id, ';'), 20))").alias("digits"),
    )
    stamp = "concat('type=EXECVE msg=audit(', sec, '.', ms, ':', event_id, '): ')"
    lines = [
        f"concat({stamp}, 'a1[2]=', substring(digits, 33), ' a2=\"', event_id, '\"')",
        f"concat({stamp}, 'argc=3 a0=\"run\" a1_len=', length(digits), ' a1[0]=', substring(digits, 1, 2), "
        "' a1[1]=', substring(digits, 3, 30))",
    ]
    return e.select(F.explode(F.expr(f"array({', '.join(lines)})")).alias("value"))


def audit_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arguments of each event of a written log, whose records lie wherever they fell."""
    folder = new_folder(spark, "log")
    piecewise_lines(spark, sf_dir).repartition(F.xxhash64("value")).write.text(folder)
    arguments = audit.event_arguments(read_audit_log(spark, folder))
    return arguments.select("serial", F.col("event_time").cast("string").alias("event_time"), "args")


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.line_counts(audit.audit_parse(audit_lines(spark, sf_dir)))


def audit_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one login user, as numbers of lines by record type."""
    lines = session_lines(audit_lines(spark, sf_dir), SESSION_USER)
    kind = F.regexp_extract("value", "^type=([A-Z]+)", 1)
    return lines.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def process_tree_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed lines with their numbers in pre-order, and the sizes of the trees below."""
    records = audit.audit_parse(audit_lines(spark, sf_dir))
    tree = audit.process_tree(records, users(spark, sf_dir), with_position=True)
    return tree.select("position", "size", "line")


def process_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = audit.audit_parse(audit_lines(spark, sf_dir))
    tree = audit.process_tree(records, users(spark, sf_dir), with_pids=True)
    return tree.withColumn("pids", F.concat_ws("/", F.col("pids").cast("array<string>"))).withColumnRenamed("pids", "path")


def text_like_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the whole table: both ends of the key range are open."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan.text_like_range_scan(documents, "doc_id", "text", pattern="%ing%")
    return found.select("doc_id", F.length("text").alias("n_chars"))


def global_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered from 1 by reporter, value and key."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return ordered.global_row_number(events, ["user_id", "value", "event_id"])


def weighed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its squared distance to the nearest start centroid."""
    distances = [
        sum(((F.col(f) - c) * (F.col(f) - c) for f, c in zip(FEATURES, centre)), F.lit(0.0))
        for _, centre in START_CENTROIDS
    ]
    return measurements(spark, sf_dir).select("event_id", F.least(*distances).alias("dist2"))


def running_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all squared distances that is reached with each event."""
    items = weighed_events(spark, sf_dir)
    shares = ordered.running_total(items, ["event_id"], "dist2", "share", share=True)
    return rounded(shares.select("event_id", "share"), ["share"])


def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events drawn with probabilities by their squared distances."""
    return ordered.weighted_draws(weighed_events(spark, sf_dir), "event_id", "dist2", 10)


def dominant_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most frequent properties and their number, without knowing which there are."""
    events = table(spark, sf_dir, "events").select("user_id", F.floor("value").cast("string").alias("label"))
    return traffic.dominant_label(events, "user_id", "label")


def matrix_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as blocks of a matrix, and their rows again."""
    blocks = matrix.matrix_blocks(measurements(spark, sf_dir), "event_id", FEATURES, height=1000)
    return matrix.rows_of_blocks(blocks, "event_id", FEATURES)


def text_signed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a word of a pattern, from a copy of the table with signatures."""
    path = new_folder(spark, "signed")
    scan.write_with_signatures(table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id", "text")
    found = scan.signed_like_scan(spark, path, "text", "%tion of%")
    return found.select("doc_id", F.length("text").alias("n_chars"))


QUERIES: dict[str, Query] = {
    "popc": popc,
    "popc_and": _pair_query("bitwiseAND"),
    "popc_or": _pair_query("bitwiseOR"),
    "popc_xor": _pair_query("bitwiseXOR"),
    "popc_sql": popc_sql,
    "tanimoto_rows": tanimoto_rows,
    "knn_similarity": knn_similarity,
    "knn_similarity_blocked": knn_similarity_blocked,
    "knn_similarity_all": knn_similarity_all,
    "knn_similarity_of_set": knn_similarity_of_set,
    "knn_sql": knn_sql,
    "kmeans_assign_sql": kmeans_assign_sql,
    "f_test_two_groups": f_test_two_groups,
    "f_test_vs_control": f_test_vs_control,
    "kmeans_validate": kmeans_validate,
    "kmeans_init_random": kmeans_init_random,
    "kmeans_init_hash": kmeans_init_hash,
    "kmeans_init_roundrobin": kmeans_init_roundrobin,
    "kmeans_pp_init": kmeans_pp_init,
    "kmeans_assign": kmeans_assign,
    "kmeans_update": kmeans_update,
    "kmeans_changes": kmeans_changes,
    "kmeans_changes_tables": kmeans_changes_tables,
    "kmeans_converged": kmeans_converged,
    "kmeans_sql": kmeans_sql,
    "kmeans_sql_plus": kmeans_sql_plus,
    "kmeans_sql_vectors": kmeans_sql_vectors,
    "kmeans_stored_rounds": kmeans_stored_rounds,
    "kmeans_fixed_rounds": kmeans_fixed_rounds,
    "kmeans_roundrobin": kmeans_roundrobin,
    "kmeans_join_back": kmeans_join_back,
    "distance_table": distance_table,
    "minmax_subset": minmax_subset,
    "traffic_dominant_cluster": traffic_dominant_cluster,
    "traffic_time_slices": traffic_time_slices,
    "traffic_map_report": traffic_map_report,
    "traffic_csv": traffic_csv,
    "audit_parse": audit_parse,
    "audit_source": audit_source,
    "audit_counts": audit_counts,
    "audit_session": audit_session,
    "process_tree": process_tree,
    "process_tree_lines": process_tree_lines,
    "text_like_range_scan": text_like_range_scan,
    "text_signed_scan": text_signed_scan,
    "dominant_event": dominant_event,
    "matrix_round_trip": matrix_round_trip,
    "global_row_number": global_row_number,
    "running_share": running_share,
    "weighted_draws": weighted_draws,
}
