"""Language identification with spans for mixed-language text.

Words are runs of letters.  The script of a word's letters narrows the
languages it can have to those that use the script in the training rows.  A
word's score for a language is the sum of log probabilities of its letter
trigrams (with word ends).  Viterbi over the words of a text, with a penalty
for every change of language, labels each word; equal neighbours are a span.
The predicted language has the most letters in the spans; the score is their
share of all letters.

The model is counted on Spark from all labelled rows.  It is trigram buckets x
languages in size and at most MAX_LANGS languages are accepted, so it can be
broadcast.  Every row is labelled, whole, without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0
and no spans, as is every text if no labelled row exists.  A word of a script
that no training row uses keeps all languages.  Ties go to the first language
in sorted order.  Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import steps, wider, written

BUCKETS = 1 << 16    # trigram buckets
MAX_LANGS = 512
PENALTY = 12.0       # of a change of language, in nats
FOREIGN = 60.0       # of a word whose script the language doesn't use, in nats
UNKNOWN = "und"
STRAY = 4.0          # standard deviations of chance that a text's mean may be off
MARGIN = 2.5         # more than any labelled row falls short, in nats a letter: a short text may hold a key or an address
LETTER_DEVIATION = 2.0  # of a letter's log probability, in nats, about

# First and last code points of the main ranges of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
NAMES = sorted({n for n, _, _ in SCRIPTS}) + ["other"]
STARTS = np.array([a for _, a, _ in sorted(SCRIPTS, key=lambda s: s[1])])
STOPS = np.array([b for _, _, b in sorted(SCRIPTS, key=lambda s: s[1])])
SCRIPT_AT = np.array([NAMES.index(n) for n, _, _ in sorted(SCRIPTS, key=lambda s: s[1])])

# ASCII: letters in lower case, everything else a blank; other bytes stay
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def scripts_of(points: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(STARTS, points, side="right") - 1, 0)
    inside = (points >= STARTS[at]) & (points <= STOPS[at])
    return np.where(inside, SCRIPT_AT[at], len(NAMES) - 1)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of all words: its word, trigram bucket and script."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.cumsum(points == 10) - 1
    uniq, inverse = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in uniq])[inverse]
    points = np.where(letter, points, 10)  # anything else ends a word
    at = np.flatnonzero(letter)
    h = (points[at - 1] * 0x9E3779B1 + points[at]) * 0x85EBCA77 + points[at + 1]
    h = (h ^ (h >> 15)) * 0xC2B2AE3D
    return word[at], ((h ^ (h >> 17)) & (BUCKETS - 1)), scripts_of(uniq)[inverse][at]


def tokens(texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of the tokens of all texts, the distinct tokens, tokens a text."""
    parts = [t.encode().translate(LETTERS).split() if t else [] for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for p in parts for w in p]
    code, uniq = pd.factorize(flat)
    return code, [w.decode().lower().replace("\n", " ") for w in uniq], counts


def count_trigrams(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, bucket, n): trigram counts and letters by script."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in steps(batches, "_text"):
            langs = np.array(rb.column("_lang").to_pylist(), object)
            code, words, counts = tokens(rb.column("_text").to_pylist())
            word, bucket, script = trigrams(words)
            owner = np.repeat(np.arange(len(langs)), counts)
            for lang in sorted(set(langs)):
                uses = np.bincount(code[langs[owner] == lang], minlength=len(words)).astype(np.float64)
                for kind, key, size in (("g", bucket, BUCKETS), ("s", script, len(NAMES))):
                    n = np.bincount(key, weights=uses[word], minlength=size)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pa.array([kind] * len(some), pa.string()),
                         pa.array(some, pa.int32()), pa.array(n[some].astype(np.int64))], ["lang", "kind", "bucket", "n"])

    return rows.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")) \
        .mapInArrow(run, "lang string, kind string, bucket int, n long") \
        .groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def labelled_rows(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    return rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())


def evidence_needed(labelled: DataFrame, model: dict, text_col: str = "text",
                    lang_col: str = "lang") -> dict[str, tuple[float, float]]:
    """``evidence_of`` the labelled rows of a frame."""
    rows = labelled_rows(labelled, text_col, lang_col).select(F.col(text_col).alias("text"))
    return evidence_of(written(detect(rows, model, "text", evidence=True).drop("text"), "evidence"))


def evidence_of(detected: DataFrame) -> dict[str, tuple[float, float]]:
    """By predicted language: the usual evidence, and the greatest shortfall,
    of labelled rows out of ``detect(evidence=True)``.
    A text may fall short of the language's usual evidence by chance (STRAY
    deviations of a mean of its letters) and by MARGIN more than any labelled
    row does."""
    seen = detected.filter("letters > 0")
    usual = {r.lang_pred: r.m for r in seen.groupBy("lang_pred").agg(F.percentile_approx("evidence", 0.5).alias("m")).collect()}
    least = seen.withColumn("short", shortfall(usual)).groupBy("lang_pred").agg(F.max("short").alias("s")).collect()
    return {r.lang_pred: (usual[r.lang_pred], r.s + MARGIN) for r in least}


def shortfall(usual: dict[str, float]) -> Column:
    """By how many nats a letter a text has less evidence than is usual for
    its language, beyond chance."""
    at = F.lit(None).cast("double")
    for lang, m in usual.items():
        at = F.when(F.col("lang_pred") == lang, F.lit(float(m))).otherwise(at)
    return at - F.col("evidence") - F.lit(STRAY * LETTER_DEVIATION) / F.sqrt(F.greatest("letters", F.lit(1.0)))


def in_a_learned_language(needed: dict[str, tuple[float, float]]) -> Column:
    """Whether a row of ``detect(evidence=True)`` has the evidence needed."""
    enough = F.lit(None).cast("double")
    for lang, (_, s) in needed.items():
        enough = F.when(F.col("lang_pred") == lang, F.lit(float(s))).otherwise(enough)
    return F.coalesce(shortfall({k: m for k, (m, _) in needed.items()}) <= enough, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Count the model from all rows with a text and a language."""
    rows = labelled_rows(labelled, text_col, lang_col)
    langs = sorted(r[0] for r in rows.select(lang_col).distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: the model would be too large to broadcast")
    logp = np.zeros((BUCKETS, len(langs)), np.float32)
    uses = np.zeros((len(NAMES), len(langs)), bool)
    if langs:
        counts = count_trigrams(rows, text_col, lang_col).toPandas()  # buckets x languages at most
        column = counts["lang"].map({x: i for i, x in enumerate(langs)})
        g = counts["kind"] == "g"
        n = np.zeros((BUCKETS, len(langs)))
        n[counts["bucket"][g], column[g]] = counts["n"][g]
        seen = (n.sum(1) > 0).sum()
        logp = np.log((n + 0.5) / (n.sum(0) + 0.5 * max(1, seen))).astype(np.float32)
        s = np.zeros((len(NAMES), len(langs)))
        s[counts["bucket"][~g], column[~g]] = counts["n"][~g]
        uses = s > 0.001 * np.maximum(1, s.sum(0))
        uses[~uses.any(1)] = True
    return {"langs": langs, "logp": logp, "uses": uses}


def word_scores(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words x languages) and the number of letters of each word."""
    word, bucket, script = trigrams(words)
    n, size = len(words), len(model["langs"])
    letters = np.bincount(word, minlength=n)
    out = np.empty((n, size), np.float32)
    for j in range(size):
        out[:, j] = np.bincount(word, weights=model["logp"][bucket, j], minlength=n)
    # the script that most letters of a word have narrows its languages
    by = np.bincount(word * len(NAMES) + script, minlength=n * len(NAMES)).reshape(n, len(NAMES))
    out -= np.where(model["uses"][by.argmax(1)] | (letters == 0)[:, None], 0, FOREIGN).astype(np.float32)
    return out, letters


def viterbi(score: np.ndarray, code: np.ndarray, start: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """Language of every word: all texts of a step advance word by word."""
    label = np.empty(len(code), np.int16)
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    if not len(n) or not n[0]:
        return label
    active = np.searchsorted(-n, -np.arange(n[0]))  # texts with more than t words
    size = score.shape[1]
    v = np.zeros((len(n), size), np.float32)
    stay = np.empty((len(code), -(-size // 8)), np.uint8)
    best = np.empty(len(code), np.int16)
    for t in range(int(n[0])):
        k = active[t]
        at = start[:k] + t
        x = v[:k]
        b = x.argmax(1)
        cut = x[np.arange(k), b] - penalty if t else x[np.arange(k), b]
        stay[at] = np.packbits(x >= cut[:, None], axis=1)
        best[at] = b
        v[:k] = np.maximum(x, cut[:, None]) + score[code[at]]
        if t % 64 == 63:
            v[:k] -= v[:k].max(1, keepdims=True)
    now = np.zeros(len(n), np.int64)
    for t in range(int(n[0]) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        ends = n[:k] - 1 == t
        now[:k][ends] = v[:k][ends].argmax(1)
        here = now[:k]
        label[at] = here
        keeps = (stay[at, here >> 3] >> (7 - (here & 7))) & 1
        now[:k] = np.where(keeps, here, best[at])
    return label


def label_texts(texts: list[str | None], model: dict, penalty: float = PENALTY):
    """Predicted language, score and spans [(word from, word to, language)]."""
    code, words, counts = tokens(texts)
    size = len(model["langs"])
    score, letters = word_scores(words, model)
    has = letters[code] > 0
    code = code[has]
    owner = np.repeat(np.arange(len(texts)), counts)[has]
    n = np.bincount(owner, minlength=len(texts))
    start = np.cumsum(n) - n
    label = viterbi(score, code, start, n, penalty) if size else np.zeros(len(code), np.int16)
    mass = np.bincount(owner * max(1, size) + label, weights=letters[code],
                       minlength=len(texts) * max(1, size)).reshape(len(texts), max(1, size))
    top, total = mass.argmax(1), mass.sum(1)
    known = (total > 0) & (size > 0)
    won = np.bincount(owner, weights=score[code, label], minlength=len(texts)) if size else np.zeros(len(texts))
    evidence = np.where(known, won / np.maximum(total, 1), 0.0)
    pred = [model["langs"][j] if ok else UNKNOWN for j, ok in zip(top, known)]
    share = np.where(known, mass.max(1) / np.maximum(total, 1), 0.0)
    if size:
        change = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1]))) \
            if len(label) else np.empty(0, np.int64)
    else:
        change = np.empty(0, np.int64)
    return pred, share, (change, np.append(change[1:], len(label)), owner, start, label), (evidence, total)


def detect(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = PENALTY,
           spans: bool = False, evidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and, if asked, spans by word number
    (array of first, past, lang) and the evidence: the mean log probability of
    a letter under the labels, and the letters.  Columns of these names are
    replaced."""
    bc = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, both bounded
    base = docs.drop("lang_pred", "score", "spans", *["evidence", "letters"] * evidence)
    schema = wider(base, "lang_pred string, score double")
    limit = (4 << 20) * 4 // max(4, len(model["langs"]))
    if spans:
        schema = wider(base, "lang_pred string, score double, spans array<struct<first:int,past:int,lang:string>>")

    if evidence:
        schema = T.StructType([*schema.fields, *T.StructType.fromDDL("evidence double, letters double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for rb in steps(batches, text_col, limit):
            pred, share, (first, past, owner, start, label), found = label_texts(rb.column(text_col).to_pylist(), model, penalty)
            cols = [*rb.columns, pa.array(pred, pa.string()), pa.array(share, pa.float64())]
            if spans:
                out: list[list[dict]] = [[] for _ in pred]
                for a, b in zip(first.tolist(), past.tolist()):
                    d = owner[a]
                    out[d].append({"first": int(a - start[d]), "past": int(b - start[d]), "lang": model["langs"][label[a]]})
                cols.append(pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())]))))
            if evidence:
                cols += [pa.array(found[0], pa.float64()), pa.array(found[1], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; learns only from rows
    that are not held out."""
    model = fit(docs.filter(~held_out(id_col)), text_col, lang_col)
    return detect(docs.select(id_col, text_col), model, text_col) \
        .select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
