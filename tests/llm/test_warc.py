"""Operator 10: exact round trip, content addressing, collisions."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from nightjar.llm import warc as W

BIG = "<html>" + "é" * 600 + "</html>"
ROWS = ([(i, f"http://h/{i}", BIG) for i in range(40)] + [(100 + i, "u", f"<p>{i % 3}</p>") for i in range(9)]
        + [(200, None, None), (201, "u\r\nWARC-Type: x", ""), (202, "dup", "z" * 1000), (202, "dup", "z" * 1000), (203, "z", "z" * 999),
           (204, "z", "z" * 999), (None, "n", BIG), (None, "m", "y" * 2000), (205, "long", "q" * 3_000_000)])
SCHEMA = "page_id long, url string, html string, address string, header int"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)


def test_records_come_back_whole(spark, tmp_path):
    W.write_archive(frame(spark), f"{tmp_path}/a")
    got = W.read_archive(spark, f"{tmp_path}/a").withColumn("bytes", W.record_bytes()).collect()
    assert sorted((str(r.record_id), bytes(r.payload).decode()) for r in got) == sorted((str(i), h or "") for i, _, h in ROWS)
    winner = {}
    for i, _, h in ROWS:
        if i is not None:
            winner[h or ""] = max(winner.get(h or "", i), i)
    for r in got:
        body = bytes(r.payload)
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        best = winner.get(body.decode())
        revisit = len(body) >= 1000 and r.record_id != best
        assert (r.record_type, r.refers_to) == (("revisit", best) if revisit else ("response", None))
        head, _, rest = bytes(r.bytes).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Type"].decode() == r.record_type
        assert rest == (b"" if revisit else body) + b"\r\n\r\n"
        assert int(fields[b"Content-Length"]) == len(rest) - 4
    store = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert store.count() == len({h or "" for _, _, h in ROWS})
    urls = {r.url for r in got}
    assert "http://h/3" in urls and None in urls and "u%0D%0AWARC-Type: x" in urls


def test_two_payloads_of_one_digest_stop_the_write(spark, tmp_path):
    with pytest.raises(Exception, match="two payloads have the digest"):
        W.write_archive(frame(spark), f"{tmp_path}/b", address=lambda c: F.substring(F.sha2(c, 256), 1, 1))


def test_changed_payload_is_noticed(spark, tmp_path):
    W.write_archive(frame(spark), f"{tmp_path}/c")
    store = spark.read.parquet(f"{tmp_path}/c/payloads")
    (store.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/d/payloads"))
    spark.read.parquet(f"{tmp_path}/c/headers").write.parquet(f"{tmp_path}/d/headers")
    with pytest.raises(Exception, match="payload and header differ"):
        W.read_archive(spark, f"{tmp_path}/d").collect()


def test_empty_table(spark, tmp_path):
    W.write_archive(frame(spark, []), f"{tmp_path}/e")
    assert W.read_archive(spark, f"{tmp_path}/e").count() == 0
    assert re.match("string", dict(W.read_archive(spark, f"{tmp_path}/e").dtypes)["record_type"])
