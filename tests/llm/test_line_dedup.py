import random

from pyspark.sql import functions as F

from vigil.llm.line_dedup import dedup_lines, rising


def longest_rising(v):
    best = [1] * len(v)
    for i in range(len(v)):
        best[i] = 1 + max([best[j] for j in range(i) if v[j] < v[i]], default=0)
    return max(best, default=0)


def test_rising_is_longest():
    rnd = random.Random(5)
    for _ in range(200):
        v = [rnd.randint(0, 9) for _ in range(rnd.randint(0, 12))]
        got = [v[i] for i in rising(v)]
        assert got == sorted(set(got)) and len(got) == longest_rising(v)


def brute(docs, min_words):
    """Deleted lines by the stated rule, with plain loops over all documents."""
    order = sorted({(d if d is not None else 1 << 63, t) for d, t in docs}, key=lambda r: r[0])
    numbered = []
    for d, t in order:
        seen, lines = {}, []
        for p, line in enumerate(t.split("\n") if t else []):
            line = line.strip()
            if line:
                seen[line] = seen.get(line, 0) + 1
                lines.append(((line, seen[line]), p, len(line.split())))
        numbered.append(lines)
    holder = {}
    for i, lines in enumerate(numbered):
        for seq, (key, _, _) in enumerate(lines):
            holder.setdefault(key, (i, seq))
    out = {}
    for i, lines in enumerate(numbered):
        gone, by = set(), {}
        for seq, (key, p, w) in enumerate(lines):
            if holder[key][0] != i:
                by.setdefault(holder[key][0], []).append((seq, holder[key][1], p, w))
        for pairs in by.values():
            from vigil.llm.line_dedup import rising as lis
            kept = [pairs[x] for x in lis([q[1] for q in pairs])]
            blocks = []
            for q in kept:
                if blocks and (q[0], q[1]) == (blocks[-1][-1][0] + 1, blocks[-1][-1][1] + 1):
                    blocks[-1].append(q)
                else:
                    blocks.append([q])
            gone |= {q[2] for b in blocks if sum(x[3] for x in b) >= min_words for q in b}
        d, t = order[i]
        out[order[i]] = t if not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return [(d, out[(d if d is not None else 1 << 63, t)]) for d, t in docs]


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    pool = [" ".join(rnd.choice(["red", "blue", "ñu", "x"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 8)))
            for _ in range(40)]
    docs = []
    for i in range(120):
        k = rnd.randint(0, 10)
        at = rnd.randint(0, 30)
        lines = pool[at:at + k] if rnd.random() < .5 else [rnd.choice(pool) for _ in range(k)]
        lines = [x if rnd.random() < .8 else rnd.choice(["", "  ", f"own line {i} {x}"]) for x in lines]
        docs.append((i, "\n".join(lines)))
    docs += [(200, docs[5][1]), (7, docs[7][1]), (7, docs[7][1]), (201, None), (202, ""), (203, "\n\n"), (None, docs[9][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5) \
        .withColumns({"partners": F.lit(1), "did": F.lit(2), "runs": F.lit(3)})
    got = dedup_lines(d, min_words=5).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == sorted(brute(docs, 5), key=str)
    assert all(r.runs == 3 and r.did == 2 for r in got)


def test_passages_go_and_order_decides(spark):
    passage = "\n".join(" ".join(f"p{j}w{i}" for i in range(12)) for j in range(3))
    docs = [(1, "alpha one\n" + passage + "\nend"), (2, "beta\n\n" + passage), (3, "short line\nalpha one"), (4, passage)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[0][1] and got[1].n_removed == 0
    assert got[2].text == "beta\n" and got[2].partners == [1] and got[2].words_removed == 36
    assert got[3].text == docs[2][1]  # shared lines of few words stay
    assert got[4].text == ""


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
