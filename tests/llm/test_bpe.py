import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from vigil.llm.bpe import bpe, decode_ids, encode_texts, encode_words, load_model

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ("aab'sSdDtTlLe  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　éÉßΣσςİıçÑ1२٣½²Ⅷ€😀👍🏽中文字한국アか́̇‍.,!?-_ẞﬁDž"
            "<|>\0\0")
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts(n=3000):
    rnd = random.Random(9)
    pool = list(ALPHABET) + SPECIAL
    out = ["", " ", "a", "it's DON'T we'll", "foo<|endoftext|>Bar <|startoftext|>", "aaaa" * 500, "ab" * 3000, "ΑΣ ΣΑΣ", "é" * 999]
    return out + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("monotone", [True, False])
def test_ids_and_decoding_equal_the_library(library, monotone):
    model = {**load_model(PATH), "monotone": monotone}
    cases = texts(1500 if monotone else 200)
    flat, at = encode_texts(cases, model)
    for i, t in enumerate(cases):
        want = library.encode(t, add_special_tokens=False).ids
        got = flat[at[i]:at[i + 1]]
        assert got.tolist() == want, repr(t)
        assert decode_ids(got, model["tokens"]).decode() == library.decode(want, skip_special_tokens=False)


def test_nul_is_a_character_like_any_other(library):
    model = load_model(PATH)
    cases = ["x\0alpha", "x\0beta", " \0one  \0one", "\0", "\0\0", "a\0", "a", "x\0alpha x\0beta x", "\0 \0a \0b"]
    flat, at = encode_texts(cases, model)
    for i, t in enumerate(cases):
        assert flat[at[i]:at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_rounds_equal_one_merge_at_a_time():
    """A toy model whose merges overlap and whose ranks aren't monotone."""
    size = 8
    pairs = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4), (0, 1): (3, 5), (5, 2): (4, 6)}
    keys = np.array(sorted(a * size + b for a, b in pairs))
    rank = np.array([pairs[k // size, k % size][0] for k in keys])
    made = np.array([m for _, m in sorted(pairs.values())])
    start = np.zeros(256, np.int64)
    start[ord("a")] = 1
    model = {"size": size, "keys": keys, "rank": rank, "made": made, "start": start, "end": start, "monotone": False}
    words = [b"a" * n + b"b" + b"a" * m for n in range(6) for m in range(6)]
    ids, n = encode_words(words, model)
    at = np.append(0, np.cumsum(n))
    for w, a, b in zip(words, at[:-1], at[1:]):
        sym = [int(start[c]) for c in w]
        while True:
            best = min(((pairs[p][0], i) for i, p in enumerate(zip(sym, sym[1:])) if p in pairs), default=None)
            if best is None:
                break
            i = best[1]
            sym[i:i + 2] = [pairs[sym[i], sym[i + 1]][1]]
        assert ids[a:b].tolist() == sym


def test_query_over_documents(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (0, "again")], "doc_id long, text string")
    rows = docs.unionByName(extra).collect()
    got = bpe(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "_text": F.lit(1)}),
              PATH, keep_ids=True).collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r["ids"], r.decoded) for r in got], key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert bpe(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
