"""The registered queries in DuckDB SQL, written independently of the Spark plans.

Loops are unrolled into common table expressions.  All results are rounded where
the order of a floating-point sum may show in the last bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from clusterloom.plans.queries import CONVERGED_PASSES, K, MOVED_CENTROIDS, START_CENTROIDS

M = 4294967295
D = 64


def with_(ctes: Sequence[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- seeded hash -----------------------------------------------------------


def _hash_ctes(source: str, name: str, x: str, out: str) -> list[str]:
    """CTEs that end in ``name``: ``source`` plus the 32-bit hash of ``x`` as ``out``."""
    start = (0x9E3779B9 + 4 + 3923095) & M
    previous = f"{name}_0"
    ctes = [
        f"{previous} AS (SELECT *, ({start}::BIGINT + ({x})) & {M} AS ha, "
        f"{start}::BIGINT AS hb, {start}::BIGINT AS hc FROM {source})"
    ]
    # fixed values: targets, sources and rotations of the final mixing steps
    rounds = [("hc", "hb", 14), ("ha", "hc", 11), ("hb", "ha", 25), ("hc", "hb", 16),
              ("ha", "hc", 4), ("hb", "ha", 14), ("hc", "hb", 24)]
    for n, (t, s, r) in enumerate(rounds, 1):
        rotated = f"((({s} << {r}) & {M}) | ({s} >> {32 - r}))"
        ctes.append(
            f"{name}_{n} AS MATERIALIZED (SELECT * REPLACE ((xor({t}, {s}) - {rotated}) & {M} AS {t}) "
            f"FROM {previous})"
        )
        previous = f"{name}_{n}"
    ctes.append(f"{name} AS (SELECT * EXCLUDE (ha, hb, hc), hc AS {out} FROM {previous})")
    return ctes


# hash(seed + hash(draw)) for seed 1 and draws 0..4: fixed values of the salts
SALTS = {0: 1012327490, 1: 2604310886, 2: 3344610773, 3: 1811844382, 4: 1292458603}


def _uniform_ctes(source: str, name: str, pk: str, draw: int) -> list[str]:
    """CTEs that end in ``name``: ``source`` plus a uniform ``u``."""
    first = _hash_ctes(source, f"{name}_lo", f"(({pk} & {M}) + {SALTS[draw]}) & {M}", "h1")
    second = _hash_ctes(f"{name}_lo", f"{name}_hi", f"(h1 + (({pk} >> 32) & {M})) & {M}", "h2")
    last = (
        f"{name} AS (SELECT * EXCLUDE (h1, h2), "
        f"((h2 * 2097152 + (h1 >> 11))::DOUBLE + 0.5) / 9007199254740992.0 AS u FROM {name}_hi)"
    )
    return [*first, *second, last]


# --- bit fingerprints ------------------------------------------------------

BITS = f"""bits AS (
    SELECT vec_id, label, [(e > 0)::INT FOR e IN embedding] AS b FROM embeddings)"""
QUERY_BITS = f"""positions AS (
    SELECT label, vec_id, unnest(b) AS bit, unnest(range({D})) AS pos FROM bits),
query_bits AS (
    SELECT label, list(one ORDER BY pos) AS q FROM (
        SELECT label, pos, (2 * sum(bit) > count(*))::INT AS one FROM positions GROUP BY label, pos)
    GROUP BY label),
pairs AS (
    SELECT q.label, b.vec_id,
        list_sum([q.q[i] * b.b[i] FOR i IN range(1, {D + 1})]) AS shared,
        list_sum([greatest(q.q[i], b.b[i]) FOR i IN range(1, {D + 1})]) AS joined
    FROM query_bits q CROSS JOIN bits b),
sims AS (
    SELECT label, vec_id,
        CASE WHEN joined = 0 THEN 0.0::DOUBLE ELSE shared::DOUBLE / joined::DOUBLE END AS similarity
    FROM pairs)"""


def _pair_sql(bit: str) -> str:
    return with_([BITS], f"""
        SELECT a.vec_id,
            list_sum([{bit} FOR i IN range(1, {D + 1})])::INTEGER AS n_bits
        FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1""")


KNN = with_([BITS, QUERY_BITS], """
    SELECT vec_id, round((sum(similarity ORDER BY similarity DESC) / 5)::FLOAT::DOUBLE, 5) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC) AS r FROM sims)
    WHERE r <= 5 GROUP BY vec_id""")

# --- F-tests ---------------------------------------------------------------


def _bounds_ctes(pairs: str) -> list[str]:
    """Acceptance bounds per row of ``pairs`` (id, n1, n2), by tabulating the
    distribution of ln F on a grid and interpolating where it crosses p."""
    return [
        f"""grid AS (
            SELECT id, (n1 - 1)::DOUBLE AS d1, (n2 - 1)::DOUBLE AS d2,
                sqrt(2.0 / (n1 - 1) + 2.0 / (n2 - 1)) AS s, unnest(range(-12000, 12001)) AS g
            FROM {pairs})""",
        """density AS (
            SELECT id, g, g * s / 1000 AS z,
                exp(d1 / 2 * (g * s / 1000)
                    - (d1 + d2) / 2 * ln((d2 + d1 * exp(g * s / 1000)) / (d1 + d2))) AS f
            FROM grid)""",
        """cumulative AS (
            SELECT id, g, z,
                (sum(f) OVER (PARTITION BY id ORDER BY g) - f / 2) / sum(f) OVER (PARTITION BY id) AS p
            FROM density)""",
        """steps AS (
            SELECT id, z, p, lead(z) OVER w AS z2, lead(p) OVER w AS p2
            FROM cumulative WINDOW w AS (PARTITION BY id ORDER BY g))""",
        """bounds AS (
            SELECT id,
                max(CASE WHEN p < 0.025 AND p2 >= 0.025
                         THEN exp(z + (z2 - z) * (0.025 - p) / (p2 - p)) END) AS lower,
                max(CASE WHEN p < 0.975 AND p2 >= 0.975
                         THEN exp(z + (z2 - z) * (0.975 - p) / (p2 - p)) END) AS upper
            FROM steps GROUP BY id)""",
    ]


F_COLUMNS = """n1, round(var1, 6) AS var1, n2, round(var2, 6) AS var2,
    round(var1 / var2, 6) AS f, round(lower, 5) AS lower, round(upper, 5) AS upper,
    var1 / var2 BETWEEN lower AND upper AS accept"""

# --- k-means ---------------------------------------------------------------

ITEMS = """items AS (
    SELECT event_id, user_id AS report_id, ts, value,
        extract(hour FROM ts)::DOUBLE AS hour, extract(dow FROM ts)::DOUBLE AS dow
    FROM events)"""
FEATURES = ("value", "hour", "dow")


def _distance2(features: Sequence[str] = FEATURES) -> str:
    return " + ".join(f"(i.{f} - c.{f}) * (i.{f} - c.{f})" for f in features)


def _assign_cte(name: str, items: str, centroids: str, features: Sequence[str] = FEATURES) -> str:
    return f"""{name} AS MATERIALIZED (
        SELECT * EXCLUDE (dist2, nearness) FROM (
            SELECT i.*, c.cid, {_distance2(features)} AS dist2,
                row_number() OVER (PARTITION BY i.event_id ORDER BY dist2, c.cid) AS nearness
            FROM {items} i CROSS JOIN {centroids} c)
        WHERE nearness = 1)"""


def _update_cte(name: str, clusters: str, empty: str, features: Sequence[str] = FEATURES) -> str:
    means = ", ".join(f"avg({f}) AS {f}" for f in features)
    if empty == "drop":
        return f"{name} AS MATERIALIZED (SELECT cid, {means} FROM {clusters} GROUP BY cid)"
    filled = ", ".join(f"coalesce(m.{f}, 0.0) AS {f}" for f in features)
    return f"""{name} AS MATERIALIZED (
        SELECT k.cid, {filled} FROM (SELECT unnest(range({K}))::INTEGER AS cid) k
        LEFT JOIN (SELECT cid, {means} FROM {clusters} GROUP BY cid) m ON m.cid = k.cid)"""


def _lloyd_ctes(
    labelled: str, prefix: str, rounds: int, empty: str, features: Sequence[str] = FEATURES
) -> list[str]:
    """CTEs that end in ``{prefix}_final``, from initial clusters in ``labelled``."""
    ctes = []
    clusters = labelled
    for n in range(1, rounds + 1):
        name = f"{prefix}_final" if n == rounds else f"{prefix}_a{n}"
        ctes.append(_update_cte(f"{prefix}_c{n}", clusters, empty, features))
        ctes.append(_assign_cte(name, "items_" + prefix, f"{prefix}_c{n}", features))
        clusters = name
    return ctes


def _hash_clusters(
    prefix: str, rounds: int, condition: str = "TRUE", features: Sequence[str] = FEATURES
) -> list[str]:
    """Hash init and ``rounds`` rounds over the items that meet ``condition``."""
    return [
        f"items_{prefix} AS (SELECT * FROM items WHERE {condition})",
        *_hash_ctes(f"items_{prefix}", f"{prefix}_h", f"(event_id + 1) & {M}", "h"),
        f"{prefix}_init AS (SELECT * EXCLUDE (h), (h % {K})::INTEGER AS cid FROM {prefix}_h)",
        *_lloyd_ctes(f"{prefix}_init", prefix, rounds, "zero", features),
    ]


RANDOM_INIT = [
    ITEMS,
    *_uniform_ctes("items", "drawn", "event_id", 0),
    f"labelled AS (SELECT * EXCLUDE (u), least(floor(u * {K}), {K - 1})::INTEGER AS cid FROM drawn)",
]


def _fixed_centroids(name: str, centroids) -> str:
    rows = ", ".join(f"({cid}, {', '.join(map(repr, values))})" for cid, values in centroids)
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(cid, {', '.join(FEATURES)}))"


def _plus_ctes(k: int) -> list[str]:
    """CTEs ``seed_0 .. seed_{k-1}`` (one row each) and ``seeds``."""
    ctes = [
        *_uniform_ctes("items", "first_draw", "event_id", 0),
        "seed_0 AS MATERIALIZED (SELECT 0 AS cid, value, hour, dow FROM first_draw "
        "ORDER BY u, event_id LIMIT 1)",
    ]
    for j in range(1, k):
        nearer = _distance2() if j == 1 else f"least(i.w, {_distance2()})"
        earlier = "items" if j == 1 else f"weight_{j - 1}"
        ctes += [
            f"""weight_{j} AS MATERIALIZED (
                SELECT i.event_id, i.value, i.hour, i.dow, {nearer} AS w
                FROM {earlier} i CROSS JOIN seed_{j - 1} c)""",
            *_uniform_ctes(f"weight_{j}", f"draw_{j}", "event_id", j),
            f"""seed_{j} AS MATERIALIZED (
                SELECT {j} AS cid, value, hour, dow FROM draw_{j} WHERE w > 0
                ORDER BY -ln(u) / w, event_id LIMIT 1)""",
        ]
    ctes.append("seeds AS (" + " UNION ALL ".join(f"SELECT * FROM seed_{j}" for j in range(k)) + ")")
    return ctes


def _plus_rounds(rounds: int) -> list[str]:
    ctes = ["items_plus AS (SELECT * FROM items)", _assign_cte("plus_first", "items", "seeds")]
    return [*ctes, *_lloyd_ctes("plus_first", "plus", rounds - 1, "drop")]


# k-means over the embeddings, as one row per (vector, position)
def _vector_ctes(k: int, rounds: int) -> list[str]:
    ctes = [
        f"""cells AS MATERIALIZED (
            SELECT vec_id, unnest(range({D})) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)""",
        *_uniform_ctes("(SELECT vec_id FROM embeddings)", "drawn", "vec_id", 0),
        f"a0 AS MATERIALIZED (SELECT vec_id, least(floor(u * {k}), {k - 1})::INTEGER AS cid FROM drawn)",
    ]
    for n in range(1, rounds + 1):
        ctes += [
            f"""c{n} AS MATERIALIZED (
                SELECT cid, pos, avg(x) AS m FROM cells JOIN a{n - 1} USING (vec_id) GROUP BY cid, pos)""",
            f"""a{n} AS MATERIALIZED (
                SELECT vec_id, arg_min(cid, (dist2, cid)) AS cid FROM (
                    SELECT vec_id, cid, sum((x - m) * (x - m) ORDER BY pos) AS dist2
                    FROM cells JOIN c{n} USING (pos) GROUP BY vec_id, cid)
                GROUP BY vec_id)""",
        ]
    return ctes


# --- min-max ---------------------------------------------------------------

VECTORS = "vectors AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
PIVOT = [
    VECTORS,
    *_uniform_ctes("vectors", "drawn", "vec_id", 0),
    "pick_0 AS MATERIALIZED (SELECT vec_id, label, e, NULL::DOUBLE AS dist FROM drawn ORDER BY u, vec_id LIMIT 1)",
]


def _minmax_ctes(rounds: int) -> list[str]:
    ctes = [
        *PIVOT,
        "near_0 AS MATERIALIZED (SELECT v.*, list_distance(v.e, p.e) AS d FROM vectors v, pick_0 p)",
    ]
    for n in range(1, rounds + 1):
        ctes += [
            f"""pick_{n} AS MATERIALIZED (
                SELECT vec_id, label, e, d AS dist FROM near_{n - 1} ORDER BY d DESC, vec_id LIMIT 1)""",
            f"""near_{n} AS MATERIALIZED (
                SELECT v.* REPLACE (least(v.d, list_distance(v.e, p.e)) AS d)
                FROM near_{n - 1} v, pick_{n} p)""",
        ]
    return ctes


# --- traffic ---------------------------------------------------------------


def _dominant(clusters: str) -> str:
    return f"""
        SELECT report_id, cid, c FROM (
            SELECT report_id, cid, count(*) AS c,
                row_number() OVER (PARTITION BY report_id ORDER BY count(*) DESC, cid) AS r
            FROM {clusters} GROUP BY report_id, cid)
        WHERE r = 1"""


# fixed values: hours and days of the time slices
SLICES = {
    "daytime": "extract(hour FROM ts) BETWEEN 7 AND 17",
    "night": "extract(hour FROM ts) BETWEEN 18 AND 23 OR extract(hour FROM ts) BETWEEN 0 AND 7",
    "weekend": "extract(dow FROM ts) IN (0, 6)",
    "weekday": "extract(dow FROM ts) IN (1, 2, 3, 4, 5)",
}

# --- audit -----------------------------------------------------------------

# the first argument as the log has it, and as it is shown
FIRST_LOGGED = """CASE pid % 4 WHEN 0 THEN '"' || user_id || '"' WHEN 1 THEN '"--data1=' || user_id || '"'
        WHEN 2 THEN hex('-f a2=' || user_id || ' "x"') ELSE '"a3=' || user_id || '"' END"""
FIRST_SHOWN = """'"' || CASE pid % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '--data1=' || user_id
        WHEN 2 THEN '-f a2=' || user_id || ' "x"' ELSE 'a3=' || user_id END || '"'"""
ARGS = f"""CASE pid % 3 WHEN 0 THEN '' WHEN 1 THEN {FIRST_SHOWN}
        ELSE {FIRST_SHOWN} || ' "' || pid || '"' END"""

AUDIT_LINES = f"""source AS (
    SELECT event_id + 2 AS pid, event_id // 2 + 1 AS ppid, user_id, event_type, props,
        (epoch_us(ts) // 1000000) || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') AS stamp
    FROM events),
tails AS (
    SELECT *, ' ppid=' || ppid || ' pid=' || pid || ' auid=1000 uid=' || user_id || ' euid=' || user_id
        || ' comm="' || event_type || '" exe="/usr/bin/' || event_type
        || '" subj=system_u:system_r:' || event_type || '_t:s0' AS tail
    FROM source),
lines AS (
    SELECT 'type=SYSCALL msg=audit(' || stamp || ':' || (3 * pid) || '): '
        || CASE WHEN pid % 7 = 0 THEN 'arch=c00000b7 syscall=221' ELSE 'arch=c000003e syscall=59' END
        || ' success=yes' || tail AS value, NULL AS args FROM tails
    UNION ALL
    SELECT 'type=EXECVE msg=audit(' || stamp || ':' || (3 * pid) || '): argc=' || (pid % 3 + 1)
        || ' a0="' || event_type || '"'
        || CASE WHEN pid % 3 > 0 THEN ' a1=' || {FIRST_LOGGED} ELSE '' END
        || CASE WHEN pid % 3 > 1 THEN ' a2="' || pid || '"' ELSE '' END, {ARGS} FROM source
    UNION ALL
    SELECT 'type=SYSCALL msg=audit(' || stamp || ':' || (3 * pid + 1) || '): '
        || CASE WHEN pid % 7 = 0 THEN 'arch=c00000b7 syscall=94' ELSE 'arch=c000003e syscall=231' END
        || tail, NULL FROM tails
    UNION ALL
    SELECT 'type=SYSCALL msg=audit(' || stamp || ':' || (3 * pid + 2)
        || '): arch=c000003e syscall=252 ppid=1 pid=' || (pid + 5000000000) || ' auid=1001 euid=0', NULL
    FROM source WHERE event_type = 'click'
    UNION ALL
    SELECT 'type=LOGIN msg=audit(' || stamp || ':' || (3 * pid + 2) || '): pid=1 uid=0 auid=1000', NULL
    FROM source WHERE event_type = 'signup'
    UNION ALL
    SELECT props, NULL FROM source WHERE event_type = 'error' AND props IS NOT NULL)"""


def _field(pattern: str) -> str:
    return f"nullif(regexp_extract(value, '{pattern}', 1), '')"


AUDIT_PARSE = with_([AUDIT_LINES, f"""fields AS (
    SELECT value, args, {_field('^type=([A-Z_]+) ')} AS type,
        {_field(' arch=([^ ]+)')} AS arch,
        {_field(r' msg=audit\(([0-9]+\.[0-9]+):[0-9]+\)')} AS event_time,
        coalesce({_field(r' msg=audit\([0-9]+\.[0-9]+:([0-9]+)\)')}::BIGINT, -1) AS serial,
        {_field(' syscall=([^ ]+)')} AS syscall,
        coalesce({_field(' ppid=([0-9]+)')}::BIGINT, -1) AS ppid,
        coalesce({_field(' pid=([0-9]+)')}::BIGINT, -1) AS pid,
        coalesce({_field(' auid=([0-9]+)')}::BIGINT, -1) AS auid,
        coalesce({_field(' euid=([0-9]+)')}::BIGINT, -1) AS euid,
        {_field(' exe="([^"]+)"')} AS exe,
        {_field(' subj=[^: ]+:[^: ]+:([^: ]+)')} AS domain,
        coalesce({_field(' argc=([0-9]+)')}::INTEGER, -1) AS argc
    FROM lines)"""], """
    SELECT * EXCLUDE (value), type IS NULL OR serial = -1 AS malformed
    FROM fields""")

PROCESS_TREE = f"""
WITH RECURSIVE nodes AS (
    SELECT event_id + 2 AS pid, event_id // 2 + 1 AS ppid, event_type, user_id FROM events),
tree AS (
    SELECT pid, pid AS root, 0 AS depth, pid::VARCHAR AS path FROM nodes WHERE ppid = 1
    UNION ALL
    SELECT n.pid, t.root, t.depth + 1, t.path || '/' || n.pid
    FROM nodes n JOIN tree t ON n.ppid = t.pid),
shown AS (
    SELECT t.*, '/usr/bin/' || event_type AS exe,
        {ARGS} AS args,
        c_name AS "user", event_type || '_t' AS domain
    FROM tree t JOIN nodes n USING (pid) LEFT JOIN customer ON c_custkey = n.user_id)
SELECT root, depth::INTEGER AS depth, path, pid, exe, args, "user", domain,
    repeat('  ', depth::INTEGER) || '- "' || exe || '" ' || args || ' (pid=' || pid
        || ', user=' || coalesce("user", '') || ', domain=' || domain || ')' AS line
FROM shown"""

# --- running totals --------------------------------------------------------

SHARES = [ITEMS, "weighed AS (SELECT event_id, least(" + ", ".join(
    f"(value - {v}) * (value - {v}) + (hour - {h}) * (hour - {h}) + (dow - {d}) * (dow - {d})"
    for _, (v, h, d) in START_CENTROIDS) + ") AS dist2 FROM items)",
    """shares AS (
    SELECT event_id, sum(dist2) OVER (ORDER BY event_id) / sum(dist2) OVER () AS share FROM weighed)"""]

# ---------------------------------------------------------------------------

MEANS = ", ".join(f"round(avg({f}), 6) AS {f}" for f in FEATURES)

ORACLE_SQL: dict[str, str] = {
    "popc": with_([BITS], "SELECT vec_id, list_sum(b)::INTEGER AS n_bits FROM bits"),
    "popc_and": _pair_sql("a.b[i] * b.b[i]"),
    "popc_or": _pair_sql("greatest(a.b[i], b.b[i])"),
    "popc_xor": _pair_sql("abs(a.b[i] - b.b[i])"),
    "popc_sql": with_([BITS], f"""
        SELECT a.vec_id, list_sum(a.b)::INTEGER AS n_bits,
            list_sum([a.b[i] * b.b[i] FOR i IN range(1, {D + 1})])::INTEGER AS n_and,
            list_sum([greatest(a.b[i], b.b[i]) FOR i IN range(1, {D + 1})])::INTEGER AS n_or,
            list_sum([abs(a.b[i] - b.b[i]) FOR i IN range(1, {D + 1})])::INTEGER AS n_xor
        FROM bits a JOIN bits b ON b.vec_id = a.vec_id + 1"""),
    "tanimoto_rows": with_([BITS, QUERY_BITS], """
        SELECT s.label, s.vec_id, round(similarity, 6) AS similarity
        FROM sims s JOIN bits b ON b.vec_id = s.vec_id AND b.label = s.label"""),
    "knn_similarity": KNN,
    "knn_similarity_blocked": KNN,
    "knn_sql": KNN,
    "knn_similarity_all": with_([BITS, f"""sims AS (
        SELECT a.vec_id, coalesce(list_sum([a.b[i] * q.b[i] FOR i IN range(1, {D + 1})])::DOUBLE
            / nullif(list_sum([greatest(a.b[i], q.b[i]) FOR i IN range(1, {D + 1})]), 0), 0.0) AS similarity
        FROM bits a CROSS JOIN bits q)"""], """
        SELECT vec_id, round((sum(similarity ORDER BY similarity DESC) / 5)::FLOAT::DOUBLE, 5) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC) AS r FROM sims)
        WHERE r <= 5 GROUP BY vec_id"""),
    "knn_similarity_of_set": with_([BITS, f"""sims AS (
        SELECT a.vec_id, coalesce(list_sum([a.b[i] * q.b[i] FOR i IN range(1, {D + 1})])::DOUBLE
            / nullif(list_sum([greatest(a.b[i], q.b[i]) FOR i IN range(1, {D + 1})]), 0), 0.0) AS similarity
        FROM bits a CROSS JOIN bits q WHERE q.vec_id % 50 = 0)"""], """
        SELECT vec_id, round((sum(similarity ORDER BY similarity DESC) / 5)::FLOAT::DOUBLE, 5) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC) AS r FROM sims)
        WHERE r <= 5 GROUP BY vec_id"""),
    "f_test_two_groups": with_([
        """stats AS (
            SELECT l_returnflag AS g, count(*) AS n,
                var_samp(l_quantity + l_discount + l_tax) AS v
            FROM lineitem GROUP BY l_returnflag)""",
        """pairs AS (
            SELECT 1 AS id, a.n AS n1, a.v AS var1, b.n AS n2, b.v AS var2
            FROM stats a, stats b WHERE a.g = 'A' AND b.g = 'N')""",
        *_bounds_ctes("pairs"),
    ], f"SELECT {F_COLUMNS} FROM pairs JOIN bounds USING (id)"),
    "f_test_vs_control": with_([
        """stats AS (
            SELECT event_type AS g, count(*) AS n, var_samp(value) AS v
            FROM events GROUP BY event_type)""",
        """pairs AS (
            SELECT row_number() OVER () AS id, a.g AS group1, b.g AS group2,
                a.n AS n1, a.v AS var1, b.n AS n2, b.v AS var2
            FROM stats a JOIN stats b ON a.g <> b.g AND b.g = 'click')""",
        *_bounds_ctes("pairs"),
    ], f"SELECT group1, group2, {F_COLUMNS} FROM pairs JOIN bounds USING (id)"),
    "kmeans_validate": with_([ITEMS, """keys AS (
            SELECT event_id, count(*) AS n,
                count(*) FILTER (value IS NULL OR hour IS NULL OR dow IS NULL) AS missing
            FROM items GROUP BY event_id)""",
        """facts AS (
            SELECT sum(n)::BIGINT AS n_rows, sum(missing)::BIGINT AS n_missing,
                coalesce(sum(n) FILTER (event_id IS NULL), 0)::BIGINT AS n_null_keys,
                count(*) FILTER (event_id IS NOT NULL AND n > 1) AS n_repeated_keys
            FROM keys)"""],
        """SELECT *, n_rows > 0 AND n_missing + n_null_keys + n_repeated_keys = 0 AS valid
        FROM facts"""),
    "kmeans_init_random": with_(RANDOM_INIT, f"SELECT cid, {MEANS} FROM labelled GROUP BY cid"),
    "kmeans_init_hash": with_(
        _hash_ctes("(SELECT event_id FROM events)", "hashed", f"(event_id + 1) & {M}", "h"),
        f"SELECT event_id, (h % {K})::INTEGER AS cid FROM hashed"),
    "kmeans_init_roundrobin": f"SELECT event_id, (event_id % {K})::INTEGER AS cid FROM events",
    "kmeans_pp_init": with_([ITEMS, *_plus_ctes(K)], "SELECT cid, value, hour, dow FROM seeds"),
    "kmeans_assign": with_(
        [ITEMS, _fixed_centroids("start", START_CENTROIDS), _assign_cte("assigned", "items", "start")],
        "SELECT event_id, cid FROM assigned"),
    "kmeans_assign_sql": with_(
        [ITEMS, _fixed_centroids("start", START_CENTROIDS), _assign_cte("assigned", "items", "start")],
        "SELECT event_id, cid FROM assigned"),
    "kmeans_update": with_(
        [ITEMS, _fixed_centroids("start", START_CENTROIDS), _assign_cte("assigned", "items", "start")],
        f"SELECT cid, {MEANS} FROM assigned GROUP BY cid"),
    "kmeans_changes": with_([
        ITEMS,
        _fixed_centroids("start", START_CENTROIDS),
        _fixed_centroids("moved", MOVED_CENTROIDS),
        _assign_cte("before", "items", "start"),
        _assign_cte("after", "items", "moved"),
    ], """SELECT count(*) AS n_changed
        FROM before o JOIN after n ON o.event_id = n.event_id AND o.cid != n.cid"""),
    "kmeans_changes_tables": with_([
        ITEMS,
        _fixed_centroids("start", START_CENTROIDS),
        _fixed_centroids("moved", MOVED_CENTROIDS),
        _assign_cte("before", "items", "start"),
        _assign_cte("after", "items", "moved"),
    ], """SELECT count(*) AS n_changed
        FROM before o JOIN after n ON o.event_id = n.event_id AND o.cid != n.cid"""),
    "kmeans_converged": with_([
        ITEMS, *_hash_clusters("conv", CONVERGED_PASSES),
        *[f"""moved_{n} AS (
            SELECT {n} AS pass, count(*) FILTER (o.cid != n.cid) AS n_changed
            FROM conv_a{n - 1} o JOIN conv_a{n} n USING (event_id))"""
          for n in range(2, CONVERGED_PASSES)],
        "moved AS (" + " UNION ALL ".join(f"SELECT * FROM moved_{n}" for n in range(2, CONVERGED_PASSES)) + ")",
        "stop AS (SELECT min(pass) AS pass FROM moved WHERE n_changed <= (SELECT count(*) // 20 FROM items))",
    ], """SELECT m.pass::INTEGER AS pass, n_changed FROM moved m, stop s
        WHERE s.pass IS NULL OR m.pass <= s.pass"""),
    "kmeans_sql": with_(
        [*RANDOM_INIT, "items_sql AS (SELECT * FROM items)",
         *_lloyd_ctes("labelled", "sql", 10, "drop")],
        "SELECT cid, event_id, report_id, value, hour, dow FROM sql_final"),
    "kmeans_sql_plus": with_(
        [ITEMS, *_plus_ctes(K), *_plus_rounds(10)], "SELECT cid, event_id FROM plus_final"),
    "kmeans_sql_vectors": with_(_vector_ctes(8, 5), "SELECT cid, vec_id FROM a5"),
    "kmeans_stored_rounds": with_(_vector_ctes(8, 5), "SELECT cid, vec_id FROM a5"),
    "kmeans_fixed_rounds": with_(
        [ITEMS, *_hash_clusters("all", 10)], "SELECT event_id, cid FROM all_final"),
    "kmeans_roundrobin": with_(
        [ITEMS, "items_rr AS (SELECT * FROM items)",
         f"rr_init AS (SELECT *, (event_id % {K})::INTEGER AS cid FROM items)",
         *_lloyd_ctes("rr_init", "rr", 20, "zero")],
        "SELECT event_id, cid FROM rr_final"),
    "kmeans_join_back": with_(
        [ITEMS, *_hash_clusters(
            "all", 10, "true", ("value", "hour"))],
        "SELECT event_id, cid AS cluster, value, hour FROM all_final"),
    "distance_table": with_(PIVOT, """
        SELECT v.vec_id, round(list_distance(v.e, p.e), 6) AS dist FROM vectors v, pick_0 p"""),
    "minmax_subset": with_(_minmax_ctes(10), " UNION ALL ".join(
        f"SELECT {n}::INTEGER AS pick, vec_id, label, round(dist, 6) AS dist FROM pick_{n}"
        for n in range(11))),
    "traffic_dominant_cluster": with_([ITEMS, *_hash_clusters("all", 10)], _dominant("all_final")),
    "traffic_time_slices": with_(
        [ITEMS, *[cte for name, rule in SLICES.items() for cte in _hash_clusters(name, 10, rule)]],
        " UNION ALL ".join(
            f"SELECT '{name}' AS time_slice, * FROM ({_dominant(name + '_final')})"
            for name in SLICES)),
    "traffic_map_report": with_([ITEMS, *_hash_clusters("all", 10),
        f"summary AS ({_dominant('all_final')})",
        """paths AS (
            SELECT s.report_id, 'path=color:' || CASE s.cid WHEN 1 THEN 'red' WHEN 2 THEN 'blue'
                WHEN 3 THEN 'green' WHEN 4 THEN 'purple' ELSE 'orange' END || '|weight:3|'
                || c_nationkey::VARCHAR || ',' || c_acctbal::VARCHAR || '|'
                || c_acctbal::VARCHAR || ',' || c_nationkey::VARCHAR AS path_entry
            FROM summary s JOIN customer ON c_custkey = s.report_id)"""],
        """SELECT report_id // 125 AS page, 'http://maps.google.com/maps/api/staticmap?zoom=11&size=640x480&scale=2&'
            || string_agg(path_entry, '&' ORDER BY report_id) || '&sensor=false' AS url FROM paths
        GROUP BY report_id // 125"""),
    "traffic_csv": """
        SELECT user_id::INTEGER AS report_id, count(*) AS n, sum(hour(ts))::BIGINT AS vehicles,
            strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, any_value(c_name) AS report_name
        FROM events JOIN customer ON c_custkey = user_id GROUP BY user_id""",
    "audit_parse": AUDIT_PARSE,
    "audit_source": """
        SELECT event_id AS serial, (epoch_us(ts) // 1000000) || '.' || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') AS event_time,
            '"' || repeat('é ' || event_type || ' ' || user_id || ';', 20) || '" "' || event_id || '"' AS args
        FROM events""",
    "audit_counts": with_([AUDIT_LINES], """
        SELECT count(*) AS n_lines, count(*) FILTER (NOT starts_with(value, 'type=')) AS n_malformed,
            count(*) FILTER (starts_with(value, 'type=') AND value NOT LIKE '% syscall=252 %') AS n_session
        FROM lines"""),
    "audit_session": with_([AUDIT_LINES], """
        SELECT 'SYSCALL' AS type, count(*) AS n FROM lines WHERE value LIKE '% auid=1001 %' HAVING count(*) > 0"""),
    "process_tree": PROCESS_TREE,
    "process_tree_lines": f"""
        WITH RECURSIVE stamped AS (
            SELECT event_id + 2 AS pid, event_id // 2 + 1 AS ppid, epoch_us(ts) // 1000 AS ms FROM events),
        walk AS (
            SELECT pid, [struct_pack(ms, pid)] AS way FROM stamped WHERE ppid = 1
            UNION ALL
            SELECT s.pid, list_append(w.way, struct_pack(s.ms, s.pid)) FROM stamped s JOIN walk w ON s.ppid = w.pid),
        counted AS (SELECT pid, row_number() OVER (ORDER BY way) AS position FROM walk),
        passed AS (SELECT unnest(way).pid AS pid FROM walk),
        sizes AS (SELECT pid, count(*) AS size FROM passed GROUP BY pid)
        SELECT position, size, line FROM ({PROCESS_TREE}) JOIN counted USING (pid) JOIN sizes USING (pid)""",
    "text_like_range_scan": """
        SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents
        WHERE text LIKE '%ing%'""",
    "text_signed_scan": """
        SELECT doc_id, length(text)::INTEGER AS n_chars FROM documents WHERE text LIKE '%tion of%'""",
    "dominant_event": """
        WITH counted AS (
            SELECT user_id, CAST(floor(value) AS BIGINT)::VARCHAR AS label, count(*) AS c FROM events
            WHERE value IS NOT NULL GROUP BY 1, 2)
        SELECT user_id, label, c FROM counted
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, label) = 1""",
    "matrix_round_trip": with_([ITEMS], """
        SELECT row_number() OVER (ORDER BY event_id) AS row, event_id, value, hour, dow FROM items"""),
    "global_row_number": """
        SELECT event_id, user_id, value, row_number() OVER (ORDER BY user_id, value, event_id) AS row_number
        FROM events""",
    "running_share": with_(SHARES, "SELECT event_id, round(share, 6) AS share FROM shares"),
    "weighted_draws": with_(
        [*SHARES, "wheel AS (SELECT range::INTEGER AS draw FROM range(10))",
         *_uniform_ctes("wheel", "spun", "draw", 0)],
        """SELECT draw, (SELECT min(event_id) FROM shares WHERE share > u) AS event_id FROM spun"""),
}
