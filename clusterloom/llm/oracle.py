"""The same results in DuckDB SQL, where SQL can express them."""

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# crc32 bit by bit, of a text of ASCII characters
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({0}, '')]),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _best_edit(state: int, kept: str, given: int, kept_behind: str, given_behind: int) -> str:
    """The cheapest (cost, audit) from a state: delete, keep, rerole, or insert and one of these."""
    def way(cost: str, letters: str, to: str) -> str:
        return f"{{c: {cost} + ({to}).c, a: '{letters}' || ({to}).a}}"

    return f"""list_sort([{way('3', 'D', f'b{state}')}] || CASE WHEN gone THEN [] ELSE [
        {way('cut', 'K', kept)}, {way('2 + cut', 'R', f'b{given}')},
        {way('2 + cut', 'IK', kept_behind)}, {way('4 + cut', 'IR', f'b{given_behind}')}] END)[1] AS b{state}"""


_NO_WAY = "{c: 1000000000::BIGINT, a: ''}"
_FROM_START = f"CASE letter WHEN 's' THEN b2 WHEN 'u' THEN b3 ELSE {_NO_WAY} END"
_TO_USER = f"CASE letter WHEN 'u' THEN b3 ELSE {_NO_WAY} END"
_TO_ASSISTANT = f"CASE letter WHEN 'a' THEN b4 ELSE {_NO_WAY} END"

ORACLE_SQL: dict[str, str] = {
    # all pairs of a label, and what a walk along the links reaches
    "op1_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), fit AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, r) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a
), n AS (
    SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT reach.vec_id, coalesce(any_value(n.n_links), 0) AS n_links, min(r) AS component_id,
       reach.vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON n.a = reach.vec_id GROUP BY reach.vec_id
""",
    # a join with every rule, the longest one first
    "op2_url_filters": f"""
WITH u AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '{_URL}', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
    FROM pages
), r(h, p, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
           ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT page_id, host, path,
       (SELECT arg_max(h || p, length(h || p)) FROM r
        WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) AS rule,
       coalesce((SELECT arg_max(verdict, length(h || p)) FROM r
        WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)), 'allow') AS verdict
FROM u
""",
    # every turn once for each speaker; spans from running lengths
    "op4_chat": """
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
    FROM conversations
), p AS (
    SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), r AS (
    SELECT t.conv_id, p.perspective, t.turn // 64 AS segment, t.turn, t.speaker, t.text AS said,
           CASE WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
                WHEN t.speaker = p.perspective THEN '<|assistant|>' || chr(10)
                ELSE '<|user|>' || t.speaker || chr(10) END AS head,
           t.text || '<|end|>' AS body,
           t.speaker = p.perspective AS own
    FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), l AS (
    SELECT *, sum(length(head) + length(body) + 1) OVER (
        PARTITION BY conv_id, perspective, segment ORDER BY turn, speaker, said
        ROWS UNBOUNDED PRECEDING) - length(body) - 1 AS lo
    FROM r
)
SELECT conv_id, segment, 0::BIGINT AS part, perspective, count(*) AS n_turns,
       count(*) FILTER (own) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY turn, speaker, said) AS text,
       coalesce(string_agg(CAST(lo AS VARCHAR) || '-' || CAST(lo + length(body) AS VARCHAR), ','
                ORDER BY turn, speaker, said) FILTER (own), '') AS spans
FROM l GROUP BY conv_id, perspective, segment
""",
    # the cheapest edits from the end backwards, for the states start, after s, u and a
    "op11_repair": f"""
WITH RECURSIVE coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code
    FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM coded, range(2) AS copy(n) WHERE n < CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
           left(role, 1) AS letter
    FROM damaged
), seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
           lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM placed
), t AS (
    SELECT *, blank OR again AS gone,
           (NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$'))::BIGINT AS cut
    FROM seen
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
           count(*) FILTER (cut = 1) AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM t GROUP BY conv_id
), best AS (
    SELECT conv_id, n + 1 AS i, {{c: 0::BIGINT, a: ''}} AS b1, {_NO_WAY} AS b2, {{c: 2::BIGINT, a: 'I'}} AS b3,
           {{c: 0::BIGINT, a: ''}} AS b4
    FROM counts
    UNION ALL
    SELECT best.conv_id, t.i, {_best_edit(1, _FROM_START, 3, _TO_ASSISTANT, 4)},
        {_best_edit(2, _TO_USER, 3, _TO_ASSISTANT, 4)}, {_best_edit(3, _TO_ASSISTANT, 4, _TO_USER, 3)},
        {_best_edit(4, _TO_USER, 3, _TO_ASSISTANT, 4)}
    FROM best JOIN t ON t.conv_id IS NOT DISTINCT FROM best.conv_id AND t.i = best.i - 1
), chosen AS (
    SELECT conv_id, b1.c AS cost, b1.a AS audit FROM best WHERE i = 1
), letters AS (
    SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS pos FROM chosen WHERE audit <> ''
), numbered AS (
    SELECT *, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS k
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), kept AS (
    SELECT l.conv_id, pos, edit, k, role, text,
           bool_or(edit = 'K' AND k = 1 AND letter = 's') OVER (PARTITION BY l.conv_id) AS opens
    FROM numbered l LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i WHERE edit <> 'D'
), said AS (
    SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN role
        ELSE CASE WHEN (k - opens::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END
        || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired
    FROM kept GROUP BY conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM every LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM every.conv_id
    LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM every.conv_id
    LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM every.conv_id
""",
    # digests in base32 from forty bits at a time
    "op13_archives": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x,
           row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS n,
           first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS original
    FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)
           FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN original END AS refers_to
FROM d
""",
}
