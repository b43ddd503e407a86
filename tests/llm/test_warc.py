import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import warc
from vigil.llm.warc import archive, fetch


def brute(rows, floor=1000):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        top = max(ids) if ids and len(data) >= floor else page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(),
                    "response" if top == page else "revisit", None if top == page else top))
    return sorted(out, key=str)


def pages():
    rnd = random.Random(4)
    html = ["<p>" + "é" * 600 + str(i) for i in range(5)] + ["small", "", None, "\r\n\r\nWARC/1.0\r\n", "x" * 1000, "x" * 999]
    urls = ["http://a.b.example.com/x?q=1#f", "https://B.example.org/", "no scheme", None, "http://h/\nline", "http://hot.example.net/same"]
    rows = [(i, rnd.choice(urls) if rnd.random() < .6 else f"http://host{i % 7}.example.net/p/{i}", rnd.choice(html)) for i in range(400)]
    return rows + [(7, rows[7][1], rows[7][2]), (None, urls[0], "x" * 1000), (None, None, "lonely" * 300), (900, urls[5], "y" * 5000)]


@pytest.mark.parametrize("block,file_bytes", [(1024, 1 << 30), (3, 2000)])
def test_round_trip(spark, monkeypatch, block, file_bytes):
    monkeypatch.setattr(warc, "BLOCK", block)
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    rows = pages()
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3) \
        .withColumns({"key": F.lit(1), "file": F.lit(2), "sha": F.lit(3)})
    path, shards = archive(d)
    got = fetch(spark, d, path, shards, with_payload=True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == brute(rows)
    by = {r.page_id: r for r in got if r.record_type == "response"}
    assert bytes(by[900].payload) == b"y" * 5000


def test_lookup_of_some_urls_and_plain_gzip(spark):
    rows = pages()
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    path, shards = archive(d)
    ask = spark.createDataFrame([("http://hot.example.net/same",), ("http://nowhere.example/",)], "url string")
    got = fetch(spark, ask, path, shards).collect()
    assert sorted(r.page_id for r in got) == sorted(p for p, u, _ in rows if u == "http://hot.example.net/same")
    fs, base = warc.file_system(f"{path}/data")
    name = fs.get_file_info(warc.pafs.FileSelector(base))[0].path
    assert gzip.decompress(fs.open_input_stream(name, compression=None).read()).startswith(b"WARC/1.0\r\nWARC-Type: ")


def test_empty_table(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    path, shards = archive(d)
    assert fetch(spark, d, path, shards).count() == 0
