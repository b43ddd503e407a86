import hashlib
import random
import re
import zlib

import pytest

from vigil.llm import prefix_trie
from vigil.llm.prefix_trie import TernaryTree, balanced, trie


def brute(rows):
    """All prefixes of all rebuilt conversations, in dictionaries."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(f"{c % 20 if c >= 0 else -(-c % 20)}")
        full[c] = own.get(base, [])[:h] + seq[h:]
    members, ends = {}, {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[:len(q)] == q and len(r) == len(q) + 1 for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), leaves, saved, sha))
    return sorted(out, key=str)


def talks(seed=0, n=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 400), n):
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, None, 0]), rng.choice(["user", "bot", None]),
                         rng.choice(["a", "a b", "", None, " x\ty  z ", "a b c d"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_tree_holds_every_prefix_once():
    rng = random.Random(4)
    seqs = sorted({tuple(rng.randrange(5) for _ in range(rng.randrange(6))) for _ in range(300)})
    tree = TernaryTree()
    at = {}
    for i in balanced(len(seqs)):
        at[seqs[i]] = tree.insert(list(seqs[i]), [1] * len(seqs[i]))
    assert sorted(at) == seqs

    def path(cell):
        return () if cell < 0 else (*path(tree.parent[cell]), tree.id[cell])
    assert all(path(c) == s for s, c in at.items())
    order = [path(c) for c in tree.preorder()]
    assert order == sorted({s[:d] for s in seqs for d in range(1, len(s) + 1)})


def test_medians_first_keep_the_tree_low():
    tree = TernaryTree()
    for i in balanced(1023):
        tree.insert([i], [0])

    def height(c):
        return 0 if c < 0 else 1 + max(height(tree.low[c]), height(tree.high[c]))
    assert height(tree.top) == 10


@pytest.mark.parametrize("run,parts", [(1 << 17, 1), (1 << 17, 7), (3, 3), (12, 5), (1, 2)])
def test_same_as_all_prefixes(spark, monkeypatch, run, parts):
    monkeypatch.setattr(prefix_trie, "partitions", lambda spark: parts)
    rows = talks(run + parts)
    got = trie(spark.createDataFrame(rows, SCHEMA), run=run)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [1, 2, 5, 40])
def test_partial_sums_of_runs_add_up(size):
    """Runs of any size, merged by key and corrected for neighbours."""
    rng = random.Random(size)
    seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(7))) for _ in range(120)})
    words = [[3 * x + 1 for x in s] for s in seqs]
    count, least = [rng.randrange(1, 4) for _ in seqs], [rng.randrange(1000) for _ in seqs]

    def merged(cuts):
        out = {}
        for lo, hi in zip(cuts, cuts[1:]):
            rows = prefix_trie.run_nodes([list(s) for s in seqs[lo:hi]], words[lo:hi], count[lo:hi], least[lo:hi],
                                         [str(i) for i in range(lo, hi)]).to_pylist()
            if lo:
                rows += prefix_trie.overlap(list(seqs[lo - 1]), words[lo - 1], list(seqs[lo])).to_pylist()
            for i, r in enumerate(rows):
                old = out.setdefault(r["key"] or (lo, i), r)
                if old is not r:
                    for c in prefix_trie.SUMS:
                        old[c] += r[c]
                    old["conv_id"] = min(x for x in (old["conv_id"], r["conv_id"]) if x is not None)
                    old["ends_sha256"] = old["ends_sha256"] or r["ends_sha256"]
        return sorted(((r["depth"], r["conv_id"], r["ends_sha256"] or "", *(r[c] for c in prefix_trie.SUMS))
                       for r in out.values()))
    assert merged([*range(0, len(seqs), size), len(seqs)]) == merged([0, len(seqs)])


def test_defined_cases(spark):
    long = "word " * 200_000
    rows = [(0, 1, "user", "hi"), (0, None, None, None), (0, 2, "user", long), (None, 1, "user", "lost"), (7, 3, "bot", "x"),
            (7, 3, "bot", "x"), (20, 1, "user", "hi"), (20, 1, "user", "hi"), (25, None, None, ""), (31, 0, "u\0", "n\0l")]
    d = spark.createDataFrame([(*r, 1, b"k") for r in rows], SCHEMA + ", id int, key binary")
    assert sorted((tuple(r) for r in trie(d).collect()), key=str) == brute(rows)
    assert trie(d.filter("conv_id < -9")).collect() == []


def test_query_equals_sql(spark):
    from conftest import SF_SMALL
    from oracle_compare import duck
    from vigil.llm.queries import ORACLE, QUERIES
    got = QUERIES["op11_prefix_trie"](spark, SF_SMALL)
    want = duck(SF_SMALL).execute(ORACLE["op11_prefix_trie"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)
