import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import simhash
from vigil.llm.components import components
from vigil.llm.simhash import block_plan, keep_one, near_duplicates, near_links


def brute_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def parts(values, radius=4):
    """Smallest index reachable of each value, all pairs compared."""
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= radius
    label = np.arange(len(v))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(v))])
        if (new == label).all():
            return label
        label = new


def chains(seed=0, n=500):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
    v = [*base, np.uint64(0), np.uint64(2 ** 64 - 1)]
    for b in base[:n // 2]:
        x = int(b)
        for k in rng.choice(64, rng.integers(1, 12), replace=False):
            x ^= 1 << int(k)
            if rng.random() < .5:
                v.append(np.uint64(x))
    return np.unique(np.array(v, np.uint64))


@pytest.mark.parametrize("tree,size,combinations", [(1 << 15, 0, 5), (16, 0, 5), (1 << 15, 1 << 25, 15)])
def test_no_link_is_lost(spark, monkeypatch, tree, size, combinations):
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "block_plan", lambda n, radius: block_plan(max(n, size), radius))
    v = chains()
    assert len(simhash.block_plan(len(v), 4)[1]) == combinations
    nodes = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    root = {r.node: r.root for r in components(near_links(nodes, 4)).collect()}
    groups, want = {}, {}
    for i, x in enumerate(v.view(np.int64)):
        groups.setdefault(root.get(int(x), int(x)), []).append(i)
    for i, p in enumerate(parts(v)):
        want.setdefault(p, []).append(i)
    assert sorted(groups.values()) == sorted(want.values())


def test_long_chain_of_links(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_documents(spark):
    rnd = random.Random(2)
    word = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(word) for _ in range(rnd.randint(1, 300))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(120):
        w = rnd.choice(base).split()
        w[rnd.randrange(len(w))] = "changed"
        docs.append((200 + i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "a"), (504, "A"), (None, base[0]), (None, "alone here it is"), (3, base[3])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit(1), "low": F.lit(2), "node": F.lit(3)})
    got = near_duplicates(d).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    label = parts(fps)
    ids = {}
    for (i, _), p in zip(docs, label):
        ids.setdefault(p, []).append(i)
    low = {p: min([x for x in v if x is not None], default=None) for p, v in ids.items()}
    want = [(i, f"{f:016x}", low[p]) for (i, _), f, p in zip(docs, fps, label)]
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == sorted(want, key=str)
    stay = keep_one(d).collect()
    assert sorted({str(r.doc_id) for r in stay}) == sorted({str(x) for x in low.values()})
    assert len(stay) == len(set(low.values())) + 1  # the row repeated with one id stays twice


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
