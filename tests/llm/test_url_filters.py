import pytest

from clusterloom.llm.queries import URL_RULES
from clusterloom.llm.url_filters import url_filter

SCHEMA = "page_id long, url string, host string, rule string, key string"


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:]
        cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
        path = path[:cut]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, verdict in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return (host, path, *(best or (None, default)))


URLS = [
    None, "", "no scheme", "http://", "https://COM/", "https://com", "http://Example.COM/en/x?y#z",
    "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://notexample.com/en/",
    "http://example.com/en", "http://example.com?x=/en/", "ftp://a.net/es/", "http://net/fr/#q",
    "http://x.net/de/", "http://example.com./en/", "http://..com/", "://com/a://b/",
    "http://user@example.com:80/en/", "http://exämple.com/en/\n?", "x" * 50_000 + "://net/es/a",
]


@pytest.mark.parametrize("rules", [URL_RULES, [], [("", "", "block"), ("com", "/e", "block"), ("b.com", "/e/long", "allow")]])
def test_matches_brute_force(spark, rules):
    rows = [(i, u, "h", "r", "k") for i, u in enumerate(URLS * 3)] + [(None, URLS[6], None, None, None)] * 2
    found = url_filter(spark.createDataFrame(rows, SCHEMA), rules)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(str, (tuple(r) for r in found.collect())))
    assert got == sorted(str((r[0], *brute(r[1], rules))) for r in rows)


def test_hot_host_and_many_rules(spark):
    rules = [("a.com", f"/{i}/", "block" if i % 2 else "allow") for i in range(200)]
    rules += [(f"h{i}.com", "/", "block") for i in range(200)]
    rows = [(i, f"http://a.com/{i % 300}/x", "", "", "") for i in range(3000)]
    rows += [(10_000 + i, f"http://www.h{i % 400}.com/", "", "", "") for i in range(1000)]
    found = url_filter(spark.createDataFrame(rows, SCHEMA), rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(rows)
    assert got == {r[0]: brute(r[1], rules) for r in rows}


def test_rule_given_twice_and_empty_table(spark):
    rules = spark.createDataFrame(
        [("A.com", "/", "allow"), ("a.com", "/", "block"), ("b.com", None, "block")],
        "host string, path string, verdict string",
    )
    urls = spark.createDataFrame([(1, "http://a.com/", "", "", ""), (2, "http://b.com/", "", "", "")], SCHEMA)
    got = {r.page_id: r.verdict for r in url_filter(urls, rules).collect()}
    assert got == {1: "block", 2: "allow"}
    assert url_filter(urls.limit(0), rules).collect() == []
