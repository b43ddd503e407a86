import re

import pytest

import corpus_pipeline
from conftest import SF_SMALL
from test_decontam import brute as brute_hits
from test_line_dedup_pairs import brute as brute_lines
from test_simhash import brute_fingerprint, parts
from vigil.llm.line_dedup import MIN_WORDS


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage over the small documents."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    extra = spark.createDataFrame([(90001, "12 34 --", "en", "x", 8), (90002, None, None, None, None), (90003, "", "en", "x", 0),
                                   (90004, "qzx wvk pqj xkcd zzyq vbnmq wrtp lkjh " * 12, None, "x", 468)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF_SMALL)
        rows = new.collect()
        out.append((name, docs.collect(), rows, new.columns))
        docs = spark.createDataFrame(rows, new.schema) if name != "tokenize" else None
    return {name: (before, after, cols) for name, before, after, cols in out}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokenize"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_of_documents(stages):
    for name, (_, _, cols) in stages.items():
        assert (cols == ["doc_id", "text", "lang", "source", "n_chars"]) == (name != "tokenize")


def test_language_id_drops_only_rows_without_a_language(stages):
    before, after, _ = stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {90001, 90002, 90003, 90004}  # no letters, or in no learned language
    assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text for r in before if r.doc_id not in gone}


def test_line_dedup_equals_brute_force(stages):
    before, after, _ = stages["line_dedup"]
    want = dict(brute_lines([(r.doc_id, r.text) for r in before], MIN_WORDS))
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after, _ = stages["near_dedup"]
    label = parts([brute_fingerprint(r.text) for r in before])
    low = {}
    for r, p in zip(before, label):
        low[p] = min(low.get(p, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(low.values())


def test_decontamination_equals_brute_force(spark, stages):
    before, after, _ = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_hits([(r.doc_id, r.text) for r in before], items) if r[5]}
    assert bad and sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = got.collect()
    assert 0 < len(rows) <= spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) for r in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_a_stage_of_no_documents_is_empty(spark, name, stage):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert stage(spark, docs.limit(0), SF_SMALL).collect() == []


def test_queries_registered_for_every_operator():
    import __spark_entry__ as E
    names = list(E.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_bpe", "op2_sharding", "op3_decontam", "op4_exact_dedup", "op5_simhash", "op6_line_dedup",
                                  "op7_warc", "op8_url_filter", "op9_langid", "op10_pii"])
def test_every_query_returns_its_whole_table(spark, name):
    import __spark_entry__ as E
    key, of = ("page_id", "pages") if name in ("op7_warc", "op8_url_filter") else ("doc_id", "documents")
    got = E.queries()[name](spark, SF_SMALL)
    want = spark.read.parquet(f"{SF_SMALL}/{of}.parquet").select(key)
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in want.collect())
