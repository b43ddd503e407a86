import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm.exact_dedup import Directory, dedup


def brute(docs):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    out = []
    for (d, _), n in zip(docs, norm):
        ids = [x for (x, _), m in zip(docs, norm) if m == n]
        known = [x for x in ids if x is not None]
        out.append((d, min(known) if known else None, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return out


def cases():
    rnd = random.Random(2)
    texts = ["", " ", "\t\n", "a b", "a  b", "a b", "ab", "A b", None, "\x0b x", "é" * 50, "x" * 5000]
    docs = [(i, rnd.choice(texts)) for i in range(300)] + [(1000 + i, f"unique {i}") for i in range(300)]
    return docs + [(None, "a b"), (None, "lonely"), (None, "lonely"), (1005, "unique 5"), (3, docs[3][1])]


@pytest.mark.parametrize("page", [1 << 25, 600])
def test_equals_brute_force(spark, page):
    docs = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({"h": F.lit(1), "row": F.lit("x")})
    got = dedup(d, page_bytes=page).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted(brute(docs), key=str)
    kept = {}
    for r in got:
        kept.setdefault(r.text_sha256, []).extend([r.doc_id] * r.kept)
    assert all(len(v) == 1 for v in kept.values())  # of repeated rows exactly one
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_directory_follows_the_bits():
    rng = np.random.default_rng(0)
    h = rng.integers(-2 ** 63, 2 ** 63 - 1, 20000)
    h[:8000] = h[0]  # one hot key
    cells, n = np.unique(h.view(np.uint64) >> np.uint64(64 - 10), return_counts=True)
    d = Directory({int(c): int(k) * 100 for c, k in zip(cells, n)}, 10, 50_000)
    b = d.find(h)
    load = np.bincount(b) * 100
    order = np.argsort(h.view(np.uint64))
    assert (np.flatnonzero(np.diff(b[order])).size + 1) == len(np.unique(b))  # a bucket is a range of keys
    over = load > 50_000
    assert over.sum() <= 1 and (d.pages[over] >= load[over] / 50_000).all() and (d.pages[~over] == 1).all()


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
