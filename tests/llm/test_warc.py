import hashlib

import zstandard
from helpers import rows

from conftest import SF001
from routelytics.llm import warc as WA

SCHEMA = "page_id long, url string, html string"
BIG = "<html>" + "é" * 700 + "</html>"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4", "small"), (5, "http://a/5", "small"),
         (6, "http://a/6", None), (7, "http://a/7\r\nX-Bad: 1", "\r\n\r\nWARC/1.1\r\n\r\n" * 200), (8, "http://a/8", "y" * 300_000),
         (9, "u", BIG + "!"), (9, "u", BIG + "!"), (None, "http://a/n", BIG), (None, None, "z" * 2000), (10, "http://a/10", "")]


def _want(pages):
    out = []
    for p, _, html in pages:
        body = (html or "").encode()
        same = [q for q, _, h in pages if (h or "").encode() == body and q is not None]
        keep = max(same) if same and len(body) >= 1000 else None
        revisit = keep is not None and p != keep
        out.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA).repartition(3).withColumn("extra", WA.F.lit(1)).select("*", *[WA.F.lit("x").alias(c) for c in ("_digest", "_keep", "_twin", "refers_to")])
    out, index = WA.write_archives(df, out=f"file://{tmp_path}/w", frame_bytes=4000, bundle_bytes=9000)
    assert rows(WA.read_archives(index, out), *COLUMNS) == _want(PAGES)
    # the bundles are plain Zstandard, their records stand where the index says
    for name in {r.bundle for r in index.collect()}:
        data = (tmp_path / "w" / name).read_bytes()
        frames = WA.read_seek_table(data)
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert sum(d for _, _, d in frames) == len(whole)
        for r in index.filter(index.bundle == name).collect():
            at, size, plain = frames[r.frame]
            assert (at, size) == (r.frame_offset, r.frame_size)
            frame = zstandard.ZstdDecompressor().decompress(data[at:at + size], max_output_size=plain)
            head, _, end = WA.parse_record(frame, r.offset)
            assert head["warc-record-id"] == r.record_id and end == r.offset + r.length
    assert not list((tmp_path / "w").glob("*.tmp"))
    one = index.filter("page_id = 8")
    record = WA.fetch_records(one, out).first()["record"]
    assert bytes(record).endswith(b"y" * 300_000 + b"\r\n\r\n")


def test_reruns_give_the_same_records(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA)
    ids = [rows(WA.write_archives(df, out=f"file://{tmp_path}/{k}")[1], "page_id", "record_id", "length") for k in "ab"]
    assert ids[0] == ids[1]


def test_revisits_name_the_record_they_refer_to(spark, tmp_path):
    out, index = WA.write_archives(spark.createDataFrame(PAGES, SCHEMA), out=f"file://{tmp_path}/w")
    ids = {r.page_id: r.record_id for r in index.collect() if r.page_id is not None}
    records = {r["record_id"]: bytes(r["record"]) for r in WA.fetch_records(index, out).collect()}
    for r in WA.read_archives(index, out).collect():
        if r["record_type"] == "revisit":
            head, _, _ = WA.parse_record(records[r["record_id"]])
            assert head["warc-refers-to"] == ids[r["refers_to"]] and head["warc-profile"] == WA.PROFILE


def test_whole_table_and_empty_table(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    out, index = WA.write_archives(pages)
    assert rows(WA.read_archives(index, out), *COLUMNS) == _want([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    out, index = WA.write_archives(spark.createDataFrame([], SCHEMA))
    assert WA.read_archives(index, out).collect() == []


def test_reading_is_spread(spark, tmp_path):
    df = spark.range(0, 3000, 1, 1).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(sha2(cast(id AS string), 256), 40) AS html")
    out, index = WA.write_archives(df, out=f"file://{tmp_path}/w", frame_bytes=20_000, bundle_bytes=100_000)
    got = WA.read_archives(index, out, read_bytes=20_000)
    held = got.groupBy(WA.F.spark_partition_id()).count().collect()
    size = sum(r.frame_size for r in index.select("bundle", "frame", "frame_size").distinct().collect())
    assert len(held) >= 0.7 * size / 20_000 > 10 and max(r["count"] for r in held) < 600
    assert sum(r["count"] for r in held) == 3000
    assert len(WA.read_archives(index, out).groupBy(WA.F.spark_partition_id()).count().collect()) == 4  # the session's partitions
