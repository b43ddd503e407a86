"""BPE encoding and decoding in batched numpy merge rounds.

The texts of a step are cut at ASCII blanks into coarse tokens, which are
counted once each.  Every distinct coarse token is normalised and cut into
words; the symbols of all distinct words lie in one flat array.  A round
builds the key of each neighbouring pair, finds its merge rank by binary
search over the sorted pair keys, and merges in every word the pair of the
lowest rank.  Rounds go on until no word has a pair left.

Words are encoded for a vocabulary with byte-level symbols and a word-end
suffix; white space is dropped by that tokenizer, so decoding gives the
tokens' strings joined by spaces, exactly as the tokenizer without a decoder.

Defined cases: a null text is an empty text (no ids, decoded ``""``).  Added
(special) tokens are found in the raw text, as the tokenizers library does.
Only the key and text columns are read, so clashing extra columns don't
matter; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import steps

NO_RANK = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def load_model(path: str) -> dict:
    """Read a tokenizer file (driver) into arrays to broadcast.

    The size is bounded by the vocabulary.  Raises if the file isn't of the
    kind this operator encodes.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    m, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if m["type"] != "BPE" or not suffix or kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"]:
        raise ValueError(f"{path} is no word-end byte-level BPE tokenizer")
    vocab, alphabet = m["vocab"], byte_alphabet()
    pairs = [p if isinstance(p, list) else p.split(" ") for p in m["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    size = 1 + max(chain(vocab.values(), (t["id"] for t in spec["added_tokens"])))
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    # A pair listed twice keeps its last rank, as a map filled in order would.
    last = np.append(np.diff(keys[order]) != 0, True)
    order = order[last]
    tokens = [""] * size
    for t, i in vocab.items():
        tokens[i] = t
    for t in spec["added_tokens"]:
        tokens[t["id"]] = t["content"]
    rank_made = np.full(size, NO_RANK)  # the first rank that makes a symbol
    np.minimum.at(rank_made, made, np.arange(len(made)))
    ranks = np.arange(len(made))
    return {
        "size": size, "keys": keys[order], "rank": ranks[order], "made": made,
        "start": np.array([vocab[c] for c in alphabet], np.int64),
        "end": np.array([vocab[c + suffix] for c in alphabet], np.int64),
        "tokens": [t.encode() for t in tokens],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        # \s of the file's pattern is Unicode white space
        "pattern": split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"),
        # True if no pair that holds a merged symbol ranks before its merge:
        # then all places of a word's best pair can merge in one round.
        "monotone": bool((ranks > np.where(rank_made[left] == NO_RANK, -1, rank_made[left])).all()
                         and (ranks > np.where(rank_made[right] == NO_RANK, -1, rank_made[right])).all()),
    }


def encode_words(words: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one flat array, and the number of ids of each."""
    lens = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), lens
    sym = model["start"][data]
    ends = np.cumsum(lens)[lens > 0] - 1
    sym[ends] = model["end"][data[ends]]
    word = np.repeat(np.arange(len(words)), lens)
    keys, rank, made, size = model["keys"], model["rank"], model["made"], model["size"]
    done_sym, done_word = [], []
    while len(sym):
        key = sym[:-1] * size + sym[1:]
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        r = np.where((keys[at] == key) & (word[:-1] == word[1:]), rank[at], NO_RANK) if len(key) else key
        r = np.append(r, NO_RANK)
        firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(r, firsts)
        sizes = np.diff(np.append(firsts, len(sym)))
        live = best != NO_RANK
        if not live.all():
            keep = np.repeat(live, sizes)
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            sym, word, r, best, sizes = sym[keep], word[keep], r[keep], best[live], sizes[live]
            if not len(sym):
                break
        hit = np.flatnonzero(r == np.repeat(best, sizes))
        if model["monotone"]:
            # of overlapping places (a run of one symbol) every second merges
            new_run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
        else:
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
        sym[hit] = made[r[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, word = sym[keep], word[keep]
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(words))


def cut_words(tokens: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    """Words (normalised) and special tokens of all coarse tokens, and the
    number of them for each coarse token.  Coarse tokens hold no line feed, so
    one pass over the tokens joined by line feeds cuts them all."""
    special = model["special"]
    subs, owner = tokens, None
    if special and any(s in t for s in special for t in tokens):
        cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
        subs, owner = [], []
        for i, t in enumerate(tokens):
            for part in cut(t):
                subs.append(part)
                owner.append(i)
    joined = "\n".join("" if owner is not None and s in special else s for s in subs)
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")  # lower case of each character alone
    found = regex.compile(model["pattern"] + r"|\n").findall(joined.lower())
    found.append("\n")
    if owner is None:
        ends = np.flatnonzero(np.array(found, object) == "\n")
        words = [w for w in found if w != "\n"]
        return words, np.diff(np.append(-1, ends)) - 1
    words, counts, i = [], np.zeros(len(tokens), np.int64), 0
    if subs and subs[0] in special:
        words.append(subs[0])
        counts[owner[0]] += 1
    for w in found:
        if w != "\n":
            words.append(w)
            counts[owner[i]] += 1
        else:
            i += 1
            if i < len(subs) and subs[i] in special:
                words.append(subs[i])
                counts[owner[i]] += 1
    return words, counts


def coarse(text: str) -> list[str]:
    """Cut at ASCII blanks; no word of the tokenizer spans one."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def distinct(strings: list[str]) -> tuple[np.ndarray, list[str]]:
    """Code of each string and the strings by code (whole strings: a NUL is a
    character like any other)."""
    d = pa.array(strings, pa.large_string()).dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def encode_texts(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and the offsets of each text (one more than texts)."""
    parts = [coarse(t) if t else [] for t in texts]
    counts = np.array([len(p) for p in parts], np.int64)
    code, uniq = distinct(list(chain.from_iterable(parts)))
    found, n_pieces = cut_words(uniq, model)
    piece, words = distinct(found)
    special = model["special"]
    ids, n_ids = encode_words([b"" if w in special else w.encode() for w in words], model)
    at = np.cumsum(n_ids) - n_ids
    for i in [i for i, w in enumerate(words) if w in special] if special else []:
        at[i], n_ids[i] = len(ids), 1
        ids = np.append(ids, special[words[i]])
    tok_ids = ids[ranges(at[piece], n_ids[piece])]  # ids by distinct coarse token
    piece_ends = np.append(0, np.cumsum(n_ids[piece]))
    tok_at = piece_ends[np.append(0, np.cumsum(n_pieces))]
    tok_n = np.diff(tok_at)
    flat = tok_ids[ranges(tok_at[code], tok_n[code])]
    ends = np.append(0, np.cumsum(tok_n[code]))
    return flat, ends[np.append(0, np.cumsum(counts))]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start[i], start[i] + n[i])."""
    total = int(n.sum())
    out = np.arange(total)
    return out + np.repeat(start - (np.cumsum(n) - n), n)


def decode_ids(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """UTF-8 of the decoded text (special tokens kept)."""
    return b" ".join([tokens[i] for i in ids.tolist()])


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
        keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: id, n_tokens, ids_sha256, decoded_sha256
    and with ``keep_ids`` the ids (array<int>) and the decoded text.

    No shuffle: each partition streams through in steps of bounded size.
    """
    bc = docs.sparkSession.sparkContext.broadcast(load_model(path))  # bounded by the vocabulary
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {key}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bc.value
        for rb in steps(batches, "_text", 4 << 20):
            flat, at = encode_texts(rb.column("_text").to_pylist(), model)
            flat32 = flat.astype("<u4")
            cut = [flat32[a:b] for a, b in zip(at[:-1], at[1:])]
            decoded = [decode_ids(x, model["tokens"]) for x in cut]
            cols = [rb.column("_id"), pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in cut], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32())),
                         pa.array([x.decode() for x in decoded], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
