import random

import numpy as np
import pytest

from vigil.llm import setsketch
from vigil.llm.setsketch import confirm, estimate, grow, meet, merge, minima, near_duplicates, registers, shingle_set


def sets_with(j, size, rng):
    """Two random sets with a Jaccard similarity of about ``j``."""
    both = round(size * j)
    own = (size - both) // 2
    h = rng.integers(0, 2 ** 64, both + 2 * own, dtype=np.uint64)
    return np.unique(h[:both + own]), np.unique(np.concatenate([h[:both], h[both + own:]]))


def brute(rows, k=5, percent=85):
    """Set sizes and least reachable ids, all pairs compared."""
    def of(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    sets, label = [of(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    low = {}
    for (i, _), x in zip(rows, label):
        low[x] = min([v for v in (low.get(x), i) if v is not None], default=None)
    return sorted(((i, len(s), low[x], i == low[x]) for (i, _), s, x in zip(rows, sets, label)), key=str)


def family(seed=1):
    """Originals with chains of edited copies, some across the threshold."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        text = [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([4, 12, 60, 200]))]
        rows.append(" ".join(text))
        for _ in range(12):
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"v{rng.randrange(10 ** 6)}"
            rows.append("  ".join(text).upper() if rng.random() < .3 else " ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_registers_of_parts_merge():
    s = np.random.default_rng(0).integers(0, 2 ** 64, 5000, dtype=np.uint64)
    whole, a, b = registers(minima([s, s[:1], s[1:]]))
    assert (merge(a, b) == whole).all()


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.7, 0.85, 0.95):
        for size in (20, 300, 3000):
            pairs = [sets_with(j, size, rng) for _ in range(60)]
            u, v = registers(minima([p for p, _ in pairs])).astype(int), registers(minima([q for _, q in pairs])).astype(int)
            nu, nv = np.array([len(p) for p, _ in pairs], float), np.array([len(q) for _, q in pairs], float)
            true = np.array([len(np.intersect1d(p, q)) / len(np.union1d(p, q)) for p, q in pairs])
            got = estimate((u > v).sum(1), (u < v).sum(1), (u == v).sum(1), nu, nv)
            assert abs((got - true).mean()) < 0.015
            assert abs(got - true).max() < setsketch.MARGIN


def test_equal_registers_are_as_frequent_as_the_similarity():
    a, b = sets_with(0.85, 1000, np.random.default_rng(2))
    ra, rb = registers(minima([a, b]))
    assert abs((ra == rb).mean() - 0.85) < 0.1


@pytest.mark.parametrize("small", [0, 24])
def test_units_lose_no_link(monkeypatch, small):
    monkeypatch.setattr(setsketch, "SMALL", small)
    sets = [shingle_set(t, 5) for _, t in family(3)]
    n, regs = np.array([len(s) for s in sets]), registers(minima(sets))
    unit = np.repeat(np.arange(len(sets) // 12), 12)
    regs, n = regs[:len(unit)], n[:len(unit)]
    yes = np.ones(len(unit), bool)
    a, b = meet(regs, n, unit, yes, yes, 0.85)

    def roots(links, size):
        label = np.arange(size)
        for x, y in links:
            label[label == label[x]] = label[y]
        return {frozenset(np.flatnonzero(label == v).tolist()) for v in label}

    def all_pairs(unit_rows):
        for p in unit_rows:
            for q in unit_rows:
                if p < q and setsketch.likely(regs[[p]], regs[[q]], n[[p]], n[[q]], 0.85)[0]:
                    yield p, q
    want = [x for u in np.unique(unit) for x in all_pairs(np.flatnonzero(unit == u))]
    assert roots(zip(a, b), len(unit)) == roots(want, len(unit))


def test_forest_spans_each_part():
    near = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4)):
        near[a, b] = near[b, a] = True
    yes = np.ones(6, bool)
    links = list(grow(yes, yes, lambda p, rest: near[p, rest]))
    assert len(links) == 3 and {frozenset(x) for x in links} <= {frozenset(x) for x in ((0, 1), (0, 2), (1, 2), (3, 4))}


def test_confirmed_at_the_exact_share():
    a, b, c = (np.arange(x, y, dtype=np.uint64) for x, y in ((0, 185), (15, 200), (16, 201)))
    yes = np.ones(3, bool)
    assert [tuple(sorted(x)) for x in confirm([a, b], yes[:2], yes[:2], 85)] == [(0, 1)]  # 170 of 200
    assert confirm([a, c], yes[:2], yes[:2], 85) == []  # 169 of 201


@pytest.mark.parametrize("unit,set_unit", [(4096, 1 << 22), (5, 400)])
def test_same_as_all_pairs(spark, monkeypatch, unit, set_unit):
    monkeypatch.setattr(setsketch, "UNIT", unit)
    monkeypatch.setattr(setsketch, "SET_UNIT", set_unit)
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b"), (5, "A  b"), (5, "A  b"), (None, "a b"), (None, "only here"),
            (8, long), (9, long + " y"), (10, "nul \0 a b c d"), (11, "nul \0 a b c e")]
    docs = spark.createDataFrame([(i, t, 7, "r") for i, t in rows], "doc_id long, text string, n int, root string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False),
                          (None, 1, 4, False), (None, 1, None, True), (8, 299_996, 8, True), (9, 299_997, 8, False),
                          (10, 2, 10, True), (11, 2, 11, True)], key=str)
    assert near_duplicates(docs.filter("doc_id > 99")).collect() == []


def test_query_equals_sql(spark):
    from conftest import SF_SMALL
    from oracle_compare import canon, duck
    from vigil.llm.queries import ORACLE, QUERIES
    got = QUERIES["op13_setsketch"](spark, SF_SMALL).toPandas()
    assert canon(got) == canon(duck(SF_SMALL).execute(ORACLE["op13_setsketch"]).df())
