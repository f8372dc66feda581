"""ARC and WARC files: round trips, hand-written files and broken ones."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clusterloom.llm import archives, queries

ARC_1 = (
    b"filedesc://old.arc 0.0.0.0 19970417175710 text/plain 70\n1 0 Somebody\n"
    b"URL IP-address Archive-date Content-type Archive-length\n\n\n"
    b"http://www.example.com:80/a b 192.0.2.1 19970417175710 text/html 35\n"
    b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>\n\n\n"
    b"dns:www.example.com 192.0.2.9 1997041717 text/dns 8\nlook up\n\n"
)


def test_first_version():
    records = list(archives.arc_contents("old.arc", gzip.compress(ARC_1)))
    assert [(r["at"], r["version"], r["url"], r["mime"], r["block"]) for r in records[1:]] == [
        (1, 1, "http://www.example.com:80/a b", "text/html", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<p>\n\n"),
        (2, 1, "dns:www.example.com", "text/dns", b"look up\n"),
    ]
    written = b"\r\n\r\n".join(archives.converted("old.arc", r, None) for r in records) + b"\r\n\r\n"
    read = list(archives.warc_contents("new.warc", gzip.compress(written)))
    assert [f["warc-type"] for f, _ in read] == ["warcinfo", "response", "resource"]
    fields, block = read[1]
    assert block == records[1]["block"]
    assert fields["warc-date"] == "1997-04-17T17:57:10Z" and fields["warc-ip-address"] == "192.0.2.1"
    sha1 = base64.b32encode(hashlib.sha1(b"<p>\n\n").digest()).decode()
    assert fields["warc-payload-digest"] == f"sha1:{sha1}"
    assert read[2][0]["warc-date"] == "1997-04-17T17:00:00Z" and read[2][0]["content-type"] == "text/dns"
    assert len({f["warc-record-id"] for f, _ in read}) == 3


def second_version(checksum):
    body = b"2 0 Somebody\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    return (
        b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc %d\n%b\n"
        b"http://e.org/ 192.0.2.1 20010101000000 text/html 200 %b - 0 new.arc 4\nbody\n" % (len(body), body, checksum)
    )


def test_second_version_and_checksums():
    good = hashlib.md5(b"body").hexdigest().encode()
    records = list(archives.arc_contents("new.arc", gzip.compress(second_version(good))))
    assert [r["version"] for r in records] == [2, 2] and records[1]["block"] == b"body"
    with pytest.raises(ValueError, match="checksum"):
        list(archives.arc_contents("new.arc", gzip.compress(second_version(b"0" * 32))))


@pytest.mark.parametrize("broken", [ARC_1[:-20], ARC_1.replace(b"1 0 Some", b"9 0 Some"), b"not an archive at all\n", ARC_1.replace(b" 35\n", b" 3x\n")])
def test_broken_files(broken):
    with pytest.raises(ValueError):
        list(archives.arc_contents("old.arc", gzip.compress(broken)))


def made_up(n=60):
    rng = random.Random(7)
    texts = ["", None, "<p>", "one\r\n\r\nWARC/1.1\r\nhttp://x 0.0.0.0 1 a 5\nfive!", "ü" * 500, "\n\n", "x" * 70000]
    urls = [None, "", "http://e.org/a b\tc\n%41", "https://é.example/ü", "no url"]
    ids = [*range(n // 2), *range(n // 2 - 5, n - 7), None, None]
    return [(i, rng.choice(urls), rng.choice(texts) if rng.random() < 0.8 else f"<b>{rng.random()}</b>") for i in ids]


def literal(rows, min_bytes=0):
    """The contract's rows, with one original for each payload."""
    firsts, out = {}, []
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        repeats = len(payload) >= min_bytes and payload in firsts
        out.append((page_id, len(payload), digest, "revisit" if repeats else "response", firsts[payload] if repeats else None))
        firsts.setdefault(payload, page_id)
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3, F.rand(1))
    return df.withColumns({c: F.lit(1) for c in ("value", "content", "archive", "at", "within", "Version")})


@pytest.mark.parametrize("min_bytes, per_file", [(0, 4096), (0, 4), (3, 7)])
def test_round_trip(spark, tmp_path, min_bytes, per_file):
    rows = made_up()
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    got = archives.archived_pages(spark, frame(spark, rows), arc, warc, min_bytes, per_file)
    assert sorted(map(tuple, got.collect()), key=repr) == literal(rows, min_bytes)
    records = archives.read_warc(spark, warc).collect()
    kept = sorted((r["page_id"] is None, r["page_id"] or 0, bytes(r["payload"])) for r in records if r["record_type"] == "response")
    want = literal(rows, min_bytes)
    assert len(kept) == sum(r[3] == "response" for r in want)
    assert {p for *_, p in kept} == {(h or "").encode() for *_, h in rows}
    assert len({r["record_id"] for r in records}) == len(records)
    versions = {v for f in (tmp_path / "arc").glob("*.gz") for v in [r["version"] for r in archives.arc_contents(f.name, f.read_bytes())][:1]}
    assert versions == {1, 2}
    assert {r["target_uri"] for r in records if r["record_type"] != "warcinfo"} == {
        "-", "http://e.org/a%20b%09c%0A%41", "https://é.example/ü", "no%20url"}


def test_query(spark, tmp_path):
    rows = made_up()
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op13_archives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == literal(rows)


def test_empty_table_and_ill_formed_bytes(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archived_pages(spark, empty, f"{tmp_path}/a", f"{tmp_path}/b").count() == 0
    odd = spark.sql("SELECT 1L AS page_id, 'http://e.org/' AS url, CAST(X'FF00FE' AS string) AS html")
    row = archives.archived_pages(spark, odd, f"{tmp_path}/c", f"{tmp_path}/d").first()
    assert row["payload_digest"] == base64.b32encode(hashlib.sha1(b"\xff\x00\xfe").digest()).decode()
    assert row["payload_bytes"] == 3


def test_a_changed_payload_is_found(spark, tmp_path):
    odd = spark.createDataFrame([(1, "http://e.org/", "<p>text</p>")], "page_id long, url string, html string")
    archives.archived_pages(spark, odd, f"{tmp_path}/a", f"{tmp_path}/b")
    [path] = [p for p in (tmp_path / "b").glob("*.gz")]
    changed = tmp_path / "c"
    changed.mkdir()
    (changed / "x.gz").write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"<p>text", b"<p>TEXT")))
    with pytest.raises(Exception, match="another digest"):
        archives.read_warc(spark, str(changed)).collect()
