import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vigil.llm import lexical
from vigil.llm.lexical import Index, Queries, impacts, search, terms, weight


def brute(docs, items, k):
    """Every document scored for every item."""
    low = {c: c + 32 for c in range(65, 91)}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_words = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for q, text in items:
        rows = []
        for i, b, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) *
                    ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(words(text)) if t in b)
            if s > 0:
                rows.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out)


def corpus(seed=0, n=300, vocabulary=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    chances = [1 / (i + 1) for i in range(vocabulary)]
    docs = [(i, " ".join(rng.choices(words, chances, k=rng.choice([1, 5, 30, 100])))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(40)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(25)]
    return docs, items


def test_terms():
    assert terms("Ab1-É ç_x\0y ÉA") == ["ab1", "É", "ç", "x", "y", "Éa"]
    assert terms(None) == terms("") == terms(" -!") == []


@pytest.mark.parametrize("block", [1, 4, 64])
def test_blocks_skip_only_what_cannot_be_among_the_best(monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    rng = np.random.default_rng(block)
    held = rng.random((600, 40)) < np.linspace(.02, .6, 40)
    tf = np.where(held, rng.integers(1, 9, held.shape), 0)
    n = np.repeat(tf.sum(1, keepdims=True), 40, axis=1)
    impact = np.where(held, impacts(tf, n, 600, int(tf.sum())), 0).astype(np.int32)
    weights = {t: weight(600, int(held[:, t].sum())) for t in range(40)}
    of = [rng.choice(40, rng.integers(1, 10), replace=False).tolist() for _ in range(30)]
    queries = Queries(list(range(30)), of, weights)
    columns = np.array([queries.used.tolist().index(t) for t in queries.used])
    index = Index(impact[:, queries.used[columns]], queries)
    looked = 0
    for q, c, w in zip(queries.of, queries.columns, queries.w):
        want = impact[:, q].astype(np.int64) @ w
        rows, scores = index.search(c, w, queries.mates, 10, 0)
        looked += len(rows)
        assert (want[rows] == scores).all()
        assert sorted(scores.tolist())[-10:] == sorted(want[want > 0].tolist())[-10:]
        last = sorted(want.tolist())[-10]
        assert set(np.flatnonzero((want >= last) & (want > 0)).tolist()) <= set(rows.tolist())
    assert looked < 30 * 600


def test_summaries_bound_their_blocks():
    rng = np.random.default_rng(5)
    impact = (rng.integers(0, 900, (500, 12)) * (rng.random((500, 12)) < .3)).astype(np.int32)
    queries = Queries([0], [list(range(12))], {t: t for t in range(12)})
    index = Index(impact, queries)
    for c, docs in index.lists.items():
        assert sorted(index.order[docs].tolist()) == np.flatnonzero(impact[:, c]).tolist()
        ends = [*index.heads[c][1:], len(docs)]
        for b, (lo, hi) in enumerate(zip(index.heads[c], ends)):
            block = impact[index.order[docs[lo:hi]]][:, queries.mates[c]]
            assert (index.summaries[c][b] == block.max(axis=0)).all()


@pytest.mark.parametrize("k,query_terms", [(7, 1 << 15), (50, 20), (1000, 1 << 15)])
def test_same_as_scoring_everything(spark, monkeypatch, k, query_terms):
    monkeypatch.setattr(lexical, "QUERY_TERMS", query_terms)
    docs, items = corpus()
    got = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(6),
                 spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items, k)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "--- !"), (4, "alpha beta"), (5, "alpha beta"), (5, "alpha beta"), (None, "alpha beta"),
            (7, "gamma " * 700_000 + "alpha"), (8, "x\0alpha")]
    items = [(1, "Alpha"), (2, None), (3, ""), (4, "unknown"), (5, "gamma gamma"), (6, "x")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, q int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in search(d, q, 50).collect()]
    assert sorted(got) == brute(docs, items, 50)
    assert [i for a, _, i, _ in sorted(got) if a == 1] == [4, 5, 5, 8, None, 7]  # four equal scores, null last
    assert search(d.filter("doc_id < 0"), q, 50).collect() == []
    assert search(d, q.filter("item_id < 0"), 50).collect() == []


def test_query_equals_sql(spark):
    from conftest import SF_SMALL
    from oracle_compare import canon, duck
    from vigil.llm.queries import ORACLE, QUERIES
    got = QUERIES["op12_lexical"](spark, SF_SMALL).toPandas()
    assert canon(got) == canon(duck(SF_SMALL).execute(ORACLE["op12_lexical"]).df())
