import gzip
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.session import scratch


def test_framing_is_undone_wherever_it_is_cut():
    rng = random.Random(5)
    for size in (0, 1, 7, 4096, 20000):
        payload = rng.randbytes(size)
        framed = warc.chunked(payload, 100)
        d, out, at = warc.Dechunker(), b"", 0
        while at < len(framed):
            step = rng.randrange(1, 50)
            out += d.feed(framed[at : at + step])
            at += step
        assert out == payload and d.over()


def key(r):
    return tuple((x is None, x) for x in r)


def brute(rows, least):
    first = {}
    for i, p in sorted(((r[0], r[2] or b"") for r in rows), key=key):
        first.setdefault(p, []).append(i)
    out = []
    for p, ids in first.items():
        for k, i in enumerate(ids):
            again = k > 0 and len(p) >= least
            out.append((i, "revisit" if again else "response", len(p), warc.digest(p), ids[0] if again else None, None))
    return sorted(out, key=key)


def ids(frame):
    """Rows read back, with ids in place of names."""

    def one(name):
        return int(name.split(":")[2]) if name and name.split(":")[2] else None

    got = [(one(r.record_id), r.record_type, r.payload_bytes, r.payload_digest, one(r.refers_to), r.error) for r in frame.collect()]
    return sorted(got, key=key)


def test_round_trip(spark):
    rng = random.Random(6)
    long = rng.randbytes(300)
    rows = [(i, f"http://a/{i}\r\nX: y", rng.choice([b"", b"x" * 9, long, rng.randbytes(rng.randrange(2000)), b"\r\n\r\nWARC/1.1\r\n\r\n", b"\n\r\r\n\n" * 90, None])) for i in range(300)]
    more = rng.randbytes(1000)
    rows += [(None, None, b"no id"), (None, None, long), (None, None, long), (5, "u", more), (5, "u", more), (5, "v", more), (7, None, None), (7, None, rng.randbytes(900))]
    df = spark.createDataFrame(rows, "id long, url string, body binary").withColumn("record_type", F.lit("clash")).withColumn("size", F.lit(1))
    for least in (0, 10):
        path = scratch(spark, "t")
        warc.write_warc(df, path, "id", "url", "body", least_bytes=least, segment_bytes=256, chunk_bytes=100)
        got = warc.read_warc(spark, path)
        assert ids(got) == brute(rows, least)
        assert got.agg(F.max("segments")).first()[0] > 3
        assert got.select("record_id").distinct().count() == len(rows)


def test_repeated_rows_beyond_a_segment(spark):
    rows = [(1, "u", "x" * 200_000), (1, "u", "x" * 200_000), (None, "u", "y" * 100_000), (2, "u", "x"), (2, "u", "x"), (None, None, None)]
    pages = spark.createDataFrame([(*r, "a") for r in rows], "page_id long, url string, html string, payload_digest string")
    want = sorted((r[0], r[2], r[1], r[4]) for r in brute([(i, u, (h or "").encode()) for i, u, h in rows], 0) if r[0])
    for cols in (["page_id", "payload_bytes", "record_type", "refers_to"], ["page_id"]):
        got = warc.archived(pages, scratch(spark, "t")).select(cols).collect()
        assert len(got) == len(rows)
        if len(cols) > 1:
            assert sorted(tuple(r) for r in got if r.page_id) == want


def test_archives_of_any_name(spark, tmp_path):
    rng = random.Random(8)
    payloads = [rng.randbytes(rng.randrange(3000)) for _ in range(40)]
    made = [[r + b"\r\n\r\n" for i in range(k, 40, 4) for r in warc.records(f"urn:row:{i}:0", "u", payloads[i], 500, 64)] for k in range(4)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made[0]))  # a member for each record
    (tmp_path / "deep" / "b.gz").write_bytes(gzip.compress(b"".join(made[1])))
    (tmp_path / "c.warc").write_bytes(b"".join(made[2]))
    (tmp_path / "gz").write_bytes(gzip.compress(b"".join(made[3])))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = warc.read_warc(spark, f"file://{tmp_path}")
    assert ids(got) == brute([(i, None, p) for i, p in enumerate(payloads)], 0)


def test_wrong_framing_and_digest_are_reported(spark, monkeypatch):
    good = list(warc.records("urn:row:1:0", "u", b"abc", 200, 64))
    assert _error(spark, good) is None
    assert _error(spark, [good[0].replace(b"abc", b"abd")]) == "digest differs"
    assert _error(spark, [good[0].replace(b"3\r\nabc", b"z\r\nabc")]).startswith("wrong framing")
    monkeypatch.setattr(warc, "write_warc", lambda pages, path, *_: spark.createDataFrame([(good[0].replace(b"abc", b"abd").decode(),)], "value string").write.option("lineSep", warc.END).text(path))
    for col in ("page_id", "record_type"):
        with pytest.raises(Exception, match="digest differs"):
            warc.archived(spark.createDataFrame([], "page_id long"), scratch(spark, "t")).select(col).collect()


def _error(spark, made):
    path = scratch(spark, "t")
    spark.createDataFrame([(m.decode(),) for m in made], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    return warc.read_warc(spark, path).first().error


def test_missing_segment_is_reported(spark):
    made = list(warc.records("urn:row:1:0", "u", b"abc" * 500, 200, 64))
    assert _error(spark, [m for i, m in enumerate(made) if i != 2]) == "a segment is missing"
    assert _error(spark, made[:-1]) == "the last segment is missing"
    assert _error(spark, [*made, made[1]]) == "a segment is repeated"


def test_empty_table(spark):
    path = scratch(spark, "t")
    warc.write_warc(spark.createDataFrame([], "id long, url string, body string"), path, "id", "url", "body")
    assert warc.read_warc(spark, path).collect() == []
