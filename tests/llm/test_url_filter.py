import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from vigil.llm.queries import RULES
from vigil.llm.url_filter import duckdb_sql, judge


def rows():
    rnd = random.Random(6)
    out = []
    for i in range(1500):
        kind = rnd.random()
        if kind < .3:  # a bad section of a host
            url, bad = f"https://news.example.info/casino/{rnd.choice('abcdefgh')}{i}", rnd.random() < .9
        elif kind < .6:
            url, bad = f"https://news.example.info/{rnd.choice(['sport', 'arts', 'city'])}/{i}.html?x=1", rnd.random() < .1
        elif kind < .7:
            url, bad = f"http://slugs.example.info/{'-'.join(rnd.choices('pqrst', k=4))}/read", rnd.random() < .5
        else:
            url, bad = f"http://{rnd.choice(['www.example.com', 'EXAMPLE.com', 'a.net', 'net', 'xnet', 'b.org'])}/{rnd.choice(['en', 'es', 'fr', 'en/'])}/{i % 9}/x/y/z/1/2/3", rnd.random() < .4
        out.append((i, url, bad if rnd.random() < .8 else None))
    odd = [None, "", "no scheme/en/", "http://", "https://Example.COM", "http://example.com?x/en/", "ftp://a.net:80/es/#q",
           "http://h//en//", "http://net/es/é x", "x://y://net/fr/", "http://com/"]
    return out + [(5000 + i, u, None) for i, u in enumerate(odd)] + [(3, *out[3][1:]), (None, out[4][1], True)]


def test_equals_sql(spark):
    data = rows()
    d = spark.createDataFrame(data, "page_id long, url string, bad boolean").withColumns({"seg": F.lit(1), "kids": F.lit(2), "host": F.lit(3)})
    cols = ["page_id", "host", "path", "rule", "verdict", "template"]
    got = judge(d, RULES).select(*cols).collect()
    con = duckdb.connect()
    con.register("src_rows", pd.DataFrame(data, columns=["page_id", "url", "bad"]).astype({"page_id": "Int64", "bad": "boolean"}))
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({duckdb_sql(RULES, 'SELECT page_id, url, bad FROM src_rows')})").fetchall()
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_templates_rules_and_verdicts(spark):
    d = spark.createDataFrame(rows(), "page_id long, url string, bad boolean")
    got = {r.url: r for r in judge(d, RULES).collect()}
    casino = [r for u, r in got.items() if u and "/casino/" in u]
    assert {r.verdict for r in casino} == {"block"} and {r.rule for r in casino} == {None}
    assert {r.verdict for u, r in got.items() if u and "/sport/" in u} == {"allow"}
    assert {r.template for u, r in got.items() if u and "slugs." in u} == {"/*/read"}  # many children: one wildcard
    assert (got[None].host, got[None].path, got[None].rule) == ("", "", None)
    assert (got["no scheme/en/"].host, got["no scheme/en/"].path) == ("", "")
    assert (got["https://Example.COM"].host, got["https://Example.COM"].rule) == ("example.com", None)
    assert got["http://com/"].rule == "com/"
    assert got["ftp://a.net:80/es/#q"].rule is None
    assert got["http://net/es/é x"].rule == "net/es/" and got["http://net/es/é x"].verdict == "block"
    assert {r.rule for u, r in got.items() if u and "//www.example.com/en/" in u} == {"www.example.com/en/"}
    assert {(r.rule, r.verdict) for u, r in got.items() if u and "//EXAMPLE.com/en/" in u} == {("example.com/en/", "block")}
    assert all(r.rule is None for u, r in got.items() if u and "//xnet/" in u)


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "http://a.org/x", None)], "page_id long, url string, bad boolean")
    assert [r.verdict for r in judge(d, RULES).collect()] == ["allow"]
    assert judge(d.limit(0), RULES).count() == 0
