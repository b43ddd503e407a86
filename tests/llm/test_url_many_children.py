import pytest

from vigil.llm.url_filter import duckdb_sql, judge


def site(sections):
    """One bad section among clean ones of equal size, and slugs of one label."""
    out = [(f"http://big.info/{'casino' if s == 0 else f'sec{chr(97 + s // 26)}{chr(97 + s % 26)}'}/p", s == 0 and i < 95)
           for s in range(sections) for i in range(100)]
    return out + [(f"http://slugs.info/{a}{b}/read", a + b == "ab") for a in "abcdefgh" for b in "abcdefgh"]


@pytest.mark.parametrize("sections", [30, 45, 400])
def test_a_section_apart_stays_on_a_node_of_any_size(spark, sections):
    d = spark.createDataFrame(site(sections), "url string, bad boolean")
    got = {(r.url, r.template, r.verdict) for r in judge(d, []).collect()}
    big = {(t, v) for u, t, v in got if "big." in u}
    assert big == {("/casino/p", "block"), ("/*/p", "allow")}
    # one bad row is apart from 63 clean ones, but not enough to reject
    assert {(t, v) for u, t, v in got if "slugs." in u} == {("/ab/read", "allow"), ("/*/read", "allow")}


@pytest.mark.parametrize("siblings", [19, 30, 31, 39, 300])
def test_the_verdict_does_not_depend_on_the_number_of_siblings(spark, siblings):
    rows = [("http://few.info/bad/p", True)] * 4 + [
        (f"http://few.info/s{chr(97 + s // 26)}{chr(97 + s % 26)}/p", False) for s in range(siblings) for _ in range(50)]
    got = {(r.url, r.template, r.verdict) for r in judge(spark.createDataFrame(rows, "url string, bad boolean"), []).collect()}
    assert {(t, v) for u, t, v in got if "/bad/" in u} == {("/bad/p", "block")}
    assert {(t, v) for u, t, v in got if "/bad/" not in u} == {("/*/p", "allow")}


@pytest.mark.parametrize("sections", [30, 45, 400])
def test_sql_states_the_same_rule(spark, sections):
    import duckdb
    rows = [(i, u, b) for i, (u, b) in enumerate(site(sections))]
    rows += [(10 ** 6, None, None), (10 ** 6 + 1, "http://big.info/casino/q", None), (10 ** 6 + 2, "no url", True)]
    d = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    names = ["page_id", "host", "path", "rule", "verdict", "template"]
    got = judge(d, []).select(*names).collect()
    con = duckdb.connect()
    con.register("rows", d.toPandas())
    want = con.execute(duckdb_sql([("block", "never.example", "/")], "SELECT page_id, url, bad FROM rows")).fetchall()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
