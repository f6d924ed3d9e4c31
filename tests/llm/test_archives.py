import base64
import hashlib
import zlib
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyspark.llm import interleave, queries, url_lists, warc
from tallyspark.llm.common import stage_table, work_folder
from tests.conftest import SF
from tests.llm.helpers import docs, texts
from tests.oracle import connect, same


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    first, rows = {}, [(i, u, h or "") for i, u, h in rows]
    for i, _, h in rows:
        if i is not None and (h not in first or i < first[h]):
            first[h] = i
    for i, _, h in rows:
        raw = h.encode()
        to = first.get(h)
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to in (None, i) else "revisit", None if to in (None, i) else to


def archived(df):
    index, _ = stage_table(warc.write_bundles(warc.plan_records(df), work_folder(df.sparkSession, "warc")), "index")
    return index, warc.read_bundles(index)


def key(r):
    return tuple(str(x) for x in r)


def test_records_by_brute_force(spark):
    rows = [(5, "http://a/x", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://b\r\nX: y", "z" * 3_000_000), (1, "u", ""), (8, "u", ""), (7, "u", "<p>é</p>"), (4, "u", "WARC/1.1\r\n\r\n")]
    index, read = archived(pages(spark, rows))
    got = [tuple(r)[:5] for r in read.collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert archived(pages(spark, []))[1].count() == 0
    for uri, n_records in index.groupBy("bundle").count().collect():
        # each frame stands alone, and the whole is a valid stream whose seek table readers skip
        archive = Path(uri.removeprefix("file://")).read_bytes()
        raw = b"".join(zstandard.ZstdDecompressor().decompress(archive[a : a + n], max_output_size=m) for a, n, m in warc.BundleReader(archive).places)
        assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC-Record-ID") == n_records
        assert zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True).read() == raw


def test_lookup(spark):
    rows = [(i, f"http://a/{i}", "same" if i % 3 == 0 else f"page {i} " * 50) for i in range(40)]
    index, _ = archived(pages(spark, rows).withColumn("bundle", F.lit("x")).withColumn("sha", F.lit(1)))
    wanted = spark.createDataFrame([("7",), ("0",), ("9",), ("77",), ("7",)], "record_id string")
    got = sorted((r.page_id, r.url, r.record_type, r.refers_to, r.payload and bytes(r.payload)) for r in warc.lookup(index, wanted).collect())
    assert got == [(0, "http://a/0", "response", None, b"same"), (7, "http://a/7", "response", None, b"page 7 " * 50), (9, "http://a/9", "revisit", 0, None)]


def test_repeated_pages(spark):
    got = sorted(tuple(r)[:1] + tuple(r)[3:5] for r in archived(pages(spark, [(4, "u", "x"), (4, "u", "x"), (5, "u", "x"), (4, "u", "y")]))[1].collect())
    assert got == [(4, "response", None), (4, "response", None), (4, "response", None), (5, "revisit", 4)]


def test_null_pages(spark):
    got = [tuple(r)[:5] for r in archived(pages(spark, [(2, "u", None), (1, "u", ""), (None, "u", "x"), (None, None, "")]))[1].collect()]
    empty = base64.b32encode(hashlib.sha1(b"").digest()).decode()
    assert (2, 0, empty, "revisit", 1) in got and (1, 0, empty, "response", None) in got and (None, 0, empty, "revisit", 1) in got and len(got) == 4


def test_damage_is_found():
    w = warc.BundleWriter(frame=100)
    for i in range(5):
        w.add(str(i), warc.record(i, "u", b"x" * 60, warc.base32_sha1(b"x" * 60), None))
    raw = w.close()
    r = warc.BundleReader(raw)
    assert len(r.places) == 5
    assert warc.parse_record(r.read(*w.index[3][1:]))[2] == b"x" * 60
    with pytest.raises(ValueError):
        warc.BundleReader(raw[:-1] + b"\0")


def test_warc_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [tuple(r)[:5] for r in queries.op7_warc_bundles(spark, SF).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_warc_query_equals_sql(spark):
    same(queries.op7_warc_bundles(spark, SF), connect(SF), queries.oracle_sql()["op7_warc_bundles"])


def test_warc_sql_of_null_and_equal_payloads(spark):
    rows = [(2, "u", None), (1, "u", ""), (None, "u", "x"), (None, None, ""), (7, "u", "é" * 9), (5, "u", "é" * 9)]
    con = connect(SF)
    con.execute("create or replace view pages as select * from (values (2, null), (1, ''), (null, 'x'), (null, ''), (7, repeat('é', 9)), (5, repeat('é', 9))) as t(page_id, html)")
    assert sorted(con.execute(queries.oracle_sql()["op7_warc_bundles"]).fetchall(), key=key) == sorted(brute(rows), key=key)


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 64, bytes(range(256)) * 3):
        payload = interleave.pad(raw)
        assert len(payload) % 64 == 0 and payload and interleave.from_png(interleave.to_png(payload)) == payload
    broken = bytearray(interleave.to_png(interleave.pad(b"abc")))
    broken[45] ^= 1
    with pytest.raises(Exception):
        interleave.from_png(bytes(broken))


def test_sequences_stay_aligned(spark):
    html = "<p>one<script>no</script></p><figure><img src='media:d1'><figcaption>first &amp; best</figcaption></figure>two<img src='media:d2' alt='second'><p>three</p>"
    found = interleave.segments(html)
    assert [(s["kind"], s["text"] or s["digest"], s["caption"]) for s in found] == [("text", "one", None), ("media", "d1", "first & best"), ("text", "two", None), ("media", "d2", "second"), ("text", "three", None)]
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")
    features = spark.createDataFrame([("d1", "f1")], "digest string, feature string")
    rows = interleave.resolve(interleave.parse_sequences(df, "page_id"), "page_id", features).collect()
    assert sorted((r.page_id, r.pos, r.feature) for r in rows if r.page_id == 1) == [(1, 0, None), (1, 1, "f1"), (1, 2, None), (1, 3, None), (1, 4, None)]
    assert sorted(r.page_id for r in rows if r.pos is None) == [2, 3]


def test_captions_and_blocks_lose_no_text():
    kinds = lambda html: [(s["text"] or s["digest"], s["caption"]) for s in interleave.segments(html)]
    assert kinds("<figure><img src=a><figcaption>cap</figure><p>kept</p>") == [("a", "cap"), ("kept", None)]
    assert kinds("<figure><img src=a><figcaption>cap<p>and all of the rest") == [("a", None), ("cap and all of the rest", None)]
    assert kinds("<table><tr><td>a</td><td>b</td></tr></table><h4>t</h4><blockquote>q</blockquote><pre>p</pre>") == [("a", None), ("b", None), ("t", None), ("q", None), ("p", None)]
    assert kinds("<figure><img src=a><figcaption>one<figure><img src=b><figcaption>two <b>three</b><br>four</figcaption></figure>tail") == [("a", "one"), ("b", "two three four"), ("tail", None)]


def brute_feature(payload):
    """By loops over bytes."""
    levels = [0] * 16
    for b in payload:
        levels[b // 16] += 1
    steps = [abs(a - b) for a, b in zip(payload, payload[1:])]
    return bytes([*(n * 255 // len(payload) for n in levels), sum(payload) // len(payload), min(255, sum(steps) // len(steps))]).hex()


def check_media(rows, by_id):
    for r in rows:
        raw = (by_id[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.feature == brute_feature(payload)
        assert (r.media_bytes, r.media_sha256) == (len(interleave.to_png(payload)), hashlib.sha256(interleave.to_png(payload)).hexdigest())


def test_media_report(spark):
    rows = interleave.media_report(docs(spark), lambda d: stage_table(d, "media")[0]).collect()
    assert len(rows) == len(texts())
    check_media(rows, dict(enumerate(texts())))
    assert interleave.media_report(docs(spark, []), lambda d: stage_table(d, "media")[0]).count() == 0
    check_media(queries.op9_media_sequences(spark, SF).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})


def test_url_filter_equals_sql(spark):
    same(queries.op10_url_filter(spark, SF), connect(SF), queries.oracle_sql()["op10_url_filter"])


def test_dropped_entries_leave_it_to_the_parent(spark):
    entries = spark.sql("select * from values ('a.com', date'2024-01-01', 'block', 'spam'), ('x.a.com', date'2024-02-01', 'allow', null), ('x.a.com', date'2024-03-01', 'drop', null) as t(pattern, listed_on, action, category)")
    captures = spark.createDataFrame([(i, "http://x.a.com/", d) for i, d in enumerate(["2024-01-15", "2024-02-15", "2024-03-15"])], "page_id long, url string, d string").selectExpr("page_id", "url", "cast(d as date) as fetched_on")
    got = sorted((r.page_id, r.verdict, r.pattern) for r in url_lists.evaluate(captures, url_lists.intervals(entries)).collect())
    assert got == [(0, "blocked", "a.com"), (1, "allowed", "x.a.com"), (2, "blocked", "a.com")]


def test_url_filter_by_day(spark):
    entries = spark.sql("""select * from values ('a.com', date'2024-01-05', 'block', 'spam'), ('a.com', date'2024-03-01', 'drop', null), ('x.a.com', date'2024-01-10', 'allow', null),
        ('a.com', date'2024-01-05', 'allow', 'spam'), (null, date'2024-01-01', 'block', 'x') as t(pattern, listed_on, action, category)""")
    rows = [(1, "http://a.com/", "2024-01-04"), (2, "http://A.com:80/", "2024-01-05"), (3, "https://x.a.com?q", "2024-01-09"), (4, "https://u@y.x.a.com/", "2024-01-10"), (5, "http://b.com", "2024-02-01"), (6, None, "2024-02-01"), (7, "http://a.com", None), (8, "http://a.com", "2024-03-01"), (2, "http://A.com:80/", "2024-01-05"), (9, "http://x.a.com", "2025-09-09")]
    captures = spark.createDataFrame(rows, "page_id long, url string, d string").selectExpr("page_id", "url", "cast(d as date) as fetched_on", "'own' as pattern", "1 as action", "2 as e", "3 as day", "4 as month")
    got = sorted((r.page_id, r.verdict) for r in url_lists.evaluate(captures, url_lists.intervals(entries)).collect())
    found = url_lists.evaluate(captures, url_lists.intervals(entries))
    assert {r.pattern for r in found.collect()} == {"a.com", "x.a.com", None} and {"action", "e", "day", "month"} <= set(found.columns)
    assert got == [(1, "unlisted"), (2, "blocked"), (2, "blocked"), (3, "blocked"), (4, "allowed"), (5, "unlisted"), (6, "unlisted"), (7, "unlisted"), (8, "unlisted"), (9, "allowed")]
    assert url_lists.url_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
