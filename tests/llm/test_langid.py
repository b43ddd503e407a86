import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from conftest import SF_SMALL
from vigil.llm.langid import (NAMES, UNKNOWN, detect, evidence_needed, fit, identify, in_a_learned_language, scripts_of, trigrams,
                              viterbi)

ENGLISH = "the house is on the hill and the people of this town walk there with their dogs every morning before work"
GERMAN = "das haus steht auf dem hügel und die leute dieser stadt gehen dort jeden morgen vor der arbeit mit ihren hunden"
RUSSIAN = "дом стоит на холме и жители этого города гуляют там каждое утро перед работой со своими собаками"


def labelled(spark):
    rnd = random.Random(1)
    rows = []
    for lang, text in (("en", ENGLISH), ("de", GERMAN), ("ru", RUSSIAN)):
        words = text.split()
        rows += [(len(rows) + i, " ".join(rnd.sample(words, 12)), lang) for i in range(40)]
    return spark.createDataFrame(rows + [(900, None, "en"), (901, "no label here", None)], "doc_id long, text string, lang string")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    n = np.array([5, 0, 1, 7, 3])
    start = np.cumsum(n) - n
    score = rng.normal(0, 4, (n.sum(), 3)).astype(np.float32)
    label = viterbi(score, np.arange(n.sum()), start, n, 2.5)
    for s, k in zip(start, n):
        def value(path):
            return sum(score[s + i, x] for i, x in enumerate(path)) - 2.5 * sum(a != b for a, b in zip(path, path[1:]))
        if k:
            best = max(map(value, itertools.product(range(3), repeat=int(k))))
            assert abs(value(label[s:s + k]) - best) < 1e-3


def test_spans_of_mixed_text_and_defined_cases(spark):
    model = fit(labelled(spark))
    assert model["langs"] == ["de", "en", "ru"]
    rows = [(1, f"{ENGLISH}. {GERMAN}."), (2, RUSSIAN), (3, None), (4, ""), (5, "12 + 34 = !!"), (6, ENGLISH), (6, ENGLISH), (7, "中文"),
            (8, ENGLISH + " 123 " + RUSSIAN.upper())]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "word": F.lit(1)})
    got = {r.doc_id: r for r in detect(d, model, spans=True).collect()}
    assert [(s.lang, s.first, s.past) for s in got[1].spans] == [("en", 0, 21), ("de", 21, 42)]
    assert (got[2].lang_pred, got[2].score) == ("ru", 1.0)
    for i in (3, 4, 5):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == (UNKNOWN, 0.0, [])
    assert got[6].lang_pred == "en" and got[7].lang_pred in model["langs"]
    assert [s.lang for s in got[8].spans] == ["en", "ru"]
    assert all(r.word == 1 for r in got.values())


def test_scripts():
    assert [NAMES[i] for i in scripts_of(np.array([ord(c) for c in "aéжα中あ한ע9"]))] == [
        "latin", "latin", "cyrillic", "greek", "han", "kana", "hangul", "hebrew", "other"]


def test_held_out_accuracy_and_no_leak(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    got = {r.doc_id: r for r in identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= got[r.doc_id].score <= 1
    held = [r for r in rows if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right / len(held) >= 0.97
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in identify(wrong).collect()}
    assert again == {k: r.lang_pred for k, r in got.items()}


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(d).collect()] == [(UNKNOWN, 0.0)]
    assert identify(d.limit(0)).count() == 0


def test_evidence_rejects_what_is_in_no_learned_language(spark):
    rnd = random.Random(1)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = fit(docs)
    needed = evidence_needed(docs, model)

    def kept(rows):
        d = spark.createDataFrame(rows, "k string, text string")
        return {r.k: r.kept for r in detect(d, model, evidence=True).withColumn("kept", in_a_learned_language(needed)).collect()}
    clean = {r.doc_id: r.text for r in docs.filter("length(text) > 200 AND lang IS NOT NULL").collect()}
    some = rnd.sample(sorted(clean), 40)
    mixed = [(f"mixed {a}", clean[a][:100] + " " + clean[b][:100]) for a, b in zip(some, some[1:])]
    assert all(kept([(f"doc {i}", clean[i]) for i in some] + [(f"part {i}", clean[i][20:60]) for i in some] + mixed).values())
    noise = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(60)),
             "A kutya gyorsan futott a mezőn keresztül, miközben a gyerekek nevetve követték őt a folyóig, ahol megálltak pihenni",
             "Дети играли в саду пока родители говорили о погоде и новостях дня на кухне"]
    assert not any(kept([(f"noise {i}", t) for i, t in enumerate(noise)]).values())
    assert kept([("none", None), ("empty", ""), ("digits", "12 34")]) == {"none": False, "empty": False, "digits": False}
    assert detect(docs.limit(0), model, evidence=True).collect() == []


def test_model_and_thresholds_come_from_all_labelled_rows(spark):
    words = ["".join(w) for w in itertools.product("abcdefghijklmnopqrst", repeat=3)]  # 8,000, one a row
    rows = [(i, w, "en") for i, w in enumerate(words)] + [(-1, "привет", "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    seen = model["logp"][trigrams(words)[1], 0]
    assert seen.min() > model["logp"][:, 0].min()  # no word was left out
    docs = spark.createDataFrame([(i, "und das ist so", "de") for i in range(8000)] + [(9000, "qqqq jjjj xxxx", "de")],
                                 "doc_id long, text string, lang string")
    model = fit(docs)
    d = detect(docs.filter("doc_id = 9000"), model, evidence=True)
    usual, short = evidence_needed(docs, model)["de"]
    r = d.first()
    assert abs(short - 2.5 - (usual - r.evidence - 8 / r.letters ** 0.5)) < 1e-6  # the rarest row counts
