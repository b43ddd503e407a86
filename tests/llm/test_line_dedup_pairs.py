import random

import pytest

from vigil.llm.line_dedup import LAST_ID, common_blocks, dedup_lines, windows
from vigil.llm.queries import QUERIES


def brute(docs, min_words):
    """Texts after every document was aligned with every earlier one."""
    order = sorted(set(docs), key=lambda r: LAST_ID if r[0] is None else r[0])
    numbered = []
    for _, t in order:
        seen, lines = {}, {}
        for p, line in enumerate(t.split("\n") if t else []):
            line = line.strip()
            if line:
                seen[line] = seen.get(line, 0) + 1
                lines[line, seen[line]] = (len(lines), p, len(line.split()))
        numbered.append(lines)
    out = {}
    for i, later in enumerate(numbered):
        gone = set()
        for earlier in numbered[:i]:
            gone |= common_blocks([(q, earlier[k][0], p, w) for k, (q, p, w) in later.items() if k in earlier], min_words)
        t = order[i][1]
        out[order[i]] = t if not gone else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return sorted([(d, out[d, t]) for d, t in docs], key=str)


def test_windows_cover_every_run():
    rnd = random.Random(4)
    for _ in range(300):
        words = [rnd.choice([1, 2, 3, 12]) for _ in range(rnd.randint(0, 14))]
        got = windows(words, 10)
        for i in range(len(words)):
            for j in range(i, len(words)):
                inside = {k for a, b in got if i <= a and b <= j for k in range(a, b + 1)}
                assert inside == (set(range(i, j + 1)) if sum(words[i:j + 1]) >= 10 else set())


def test_query_aligns_pairs_on_all_their_lines(spark, tmp_path):
    l1, l2, l3 = ("\n".join([" ".join(f"{c}{i}" for i in range(5))]) for c in "abc")
    x, y = (" ".join(f"{c}{i}" for i in range(12)) for c in "xy")
    docs = [(1, l2), (2, "\n".join([l1, l2, l3])), (3, "\n".join([l1, l2, l3])),  # short lines of one passage
            (4, f"{x}\n{y}"), (5, f"{y}\n{x}"), (6, f"{y}\n{x}"), (7, f"{y}\nown\n{x}")]  # crossing order
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.text) for r in QUERIES["op6_line_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(docs, 10)
    assert dict(got)[3] == dict(got)[6] == "" and dict(got)[7] == "own"


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_alignment_of_every_pair(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.choice([1, 2, 3, 7]))) for _ in range(25)]
    docs = []
    for i in range(90):
        parts = [pool[a:a + rnd.randint(1, 6)] for a in rnd.choices(range(22), k=rnd.randint(0, 4))]  # in any order
        docs.append((i, "\n".join(x if rnd.random() < .95 else f"own {i}" for part in parts for x in part)))
    docs += [(200, docs[5][1]), docs[7], docs[7], (201, None), (202, ""), (203, "\n\n"), (None, docs[9][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = dedup_lines(d, min_words=6, all_pairs=True).collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == brute(docs, 6)
