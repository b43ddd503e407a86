import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.llm import decontam
from vigil.llm.decontam import hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        seq = words(t)
        w = min(window, len(seq))
        for p in range(len(seq) - w + 1 if seq else 0):
            wins.setdefault(tuple(seq[p:p + w]), set()).add("null" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for d, t in docs:
        seq, hit, found = words(t), set(), set()
        for p in range(len(seq)):
            for n in sizes:
                k = tuple(seq[p:p + n])
                if len(k) == n and k in wins:
                    hit |= set(range(p, p + n))
                    found |= wins[k]
        out.append((d, len(seq), len(hit), len(found),
                    hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def cases(seed, n_docs=60):
    rnd = random.Random(seed)
    vocab = ["a", "b", "Ab", "x1", "é", "ñ", "zz"]

    def text(k):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "--"]) for _ in range(k))
    items = [(i, text(rnd.choice([0, 1, 3, 10, 12, 30]))) for i in range(25)] + [(3, "a b"), (None, "zz zz zz zz"), (99, None)]
    items = [(i, t) for i, t in items if len(words(t)) != 1]
    docs = [(i, text(rnd.randint(0, 80)))
            for i in range(n_docs)]
    docs += [(100 + i, "un deux " + (t or "") + " trois") for i, t in items if i is not None]
    docs += [(500, None), (501, ""), (502, "  "), (0, docs[0][1]), (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, None), (2, None), (3, 400)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items = cases(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("item_id", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = hits(d, b)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute(docs, items), key=str)


@pytest.mark.parametrize("block", [None, 400])
def test_removal_equals_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items = cases(7)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("item_id", F.lit(1))
    got = decontam.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text", "item_id"]
    want = [d for d, r in zip(docs, brute(docs, items)) if not r[5]]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(want, key=str) and len(want) < len(docs)


def test_longest_match_has_its_place(spark):
    item = " ".join(f"w{i}" for i in range(20))
    doc = "start here " + " ".join(f"w{i}" for i in range(3, 18)) + " end"
    r = hits(spark.createDataFrame([(1, doc)], "doc_id long, text string"),
             spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert r.n_hit == 15 and ["7"] == r["items"]
    assert tuple(r.longest) == (2, 15, "7")


def test_an_item_that_another_one_continues_is_matched_whole(spark):
    first = " ".join(f"w{i}" for i in range(14))
    items = [(1, first), (2, " ".join(f"w{i}" for i in range(13)) + " other words follow here")]
    docs = [(i, f"{i} {first} end") for i in range(10)]  # each document has its own place
    got = hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: tuple(r.longest) for r in got.collect()} == {i: (1, 14, "1") for i in range(10)}


@pytest.mark.parametrize("seed,block", [(1, None), (4, None), (3, 400)])
def test_longest_matches_equal_brute_force(spark, monkeypatch, seed, block):
    if block:
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items = cases(seed)
    texts = [words(t) for _, t in items]
    windows = {tuple(t[p:p + min(10, len(t))]) for t in texts for p in range(max(0, len(t) - min(10, len(t)) + 1)) if t}
    runs = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}

    def longest(seq):
        best = None
        for p in range(len(seq)):
            if any(tuple(seq[p:p + len(w)]) == w for w in windows):
                n = max(k for k in range(1, len(seq) - p + 1) if tuple(seq[p:p + k]) in runs)
                best = (p, n) if best is None or n > best[1] else best
        return best
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = hits(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = sorted(((str(i), longest(words(t))) for i, t in docs), key=str)
    if block is None:
        assert sorted(((str(r.doc_id), r.longest and (r.longest.word, r.longest.length)) for r in got), key=str) == want
    else:  # a place's match in a block of items begins where a window of that block stands
        assert sorted((str(r.doc_id), r.longest is not None) for r in got) == sorted((i, m is not None) for i, m in want)
    by_item = {("null" if i is None else str(i)): [] for i, _ in items}
    for i, t in items:
        by_item["null" if i is None else str(i)].append(words(t))
    ids = [str(i) for i, _ in docs]
    text = {str(i): t for i, t in docs if ids.count(str(i)) == 1}
    for r in got:
        if r.longest and str(r.doc_id) in text:
            run = words(text[str(r.doc_id)])[r.longest.word:r.longest.word + r.longest.length]
            assert any(run == t[a:a + len(run)] for t in by_item[r.longest.item] for a in range(len(t)))


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert hits(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.contaminated) for r in hits(one, b).collect()] == [(3, False)]
    assert decontam.decontaminate(one, b).count() == 1
