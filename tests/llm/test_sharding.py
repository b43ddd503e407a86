import random
import zlib

from vigil.llm.sharding import shard


def check(spark, docs, n=8):
    got = shard(spark.createDataFrame(docs, "doc_id long, text string"), n).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return got, by


def test_near_equal_and_groups_together(spark):
    rnd = random.Random(1)
    docs = [(i, "x" * rnd.randint(0, 200) + str(i)) for i in range(3000)]
    docs += [(10000 + i, "copy of one text") for i in range(3)] + [(1, docs[1][1]), (None, None), (5, None), (20000, "é" * 3000)]
    got, by = check(spark, docs)
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert sorted(by) == list(range(8))
    assert max(sizes) - min(sizes) <= 6001 + 0.02 * sum(sizes) / 8
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"copy of one text")}) == 1


def test_one_group_holds_most_rows(spark):
    docs = [(i, "the same text") for i in range(2000)] + [(5000 + i, f"other {i}") for i in range(500)]
    _, by = check(spark, docs)
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8 + 30


def test_small_and_empty(spark):
    check(spark, [(1, "a")])
    check(spark, [(1, None), (2, ""), (2, "")])
    assert shard(spark.createDataFrame([], "doc_id long, text string"), 8).count() == 0
