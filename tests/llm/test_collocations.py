"""Phrase collocations against a plain version: pieces, cuts, ties, containment, streams dealt in small ranges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from verdikt.llm import collocations as C


def plain(rows, least, longest, inside, top, scale=1_000_000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[k : k + m]) for m in range(1, longest + 1) for k in range(len(w) - m + 1))
    often = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    out = {}
    for (lang, *p), a in often.items():
        score, at = min((scale * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (other, *q), b in often.items() if other == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
        if not any(100 * b >= inside * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, *p[:at]], f[lang, *p[at:]]))
    return sorted((lang, k + 1, phrase.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for k, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]))


def made(seed, many=150):
    rng = random.Random(seed)
    words = ["a", "B", "b", "c", "d", "été", "漢字", "e" * 30, "f", "\x7f", "g-h"]
    rows = []
    for _ in range(many):
        text = "".join(rng.choice(words[: rng.choice([3, 11])]) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", " new york city ", ". ", "\x0c"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("fr", ""), ("fr", " .,; \n"), (None, "a b c " * 20_000), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("seed,least,longest,inside,top,stream,block", [(1, 10, 3, 50, 2000, 200_000, 4_000_000), (2, 3, 3, 50, 40, 7, 100), (3, 2, 4, 80, 500, 11, 1000), (4, 2, 2, 50, 30, 3, 50)])
def test_equals_plain(spark, monkeypatch, seed, least, longest, inside, top, stream, block):
    monkeypatch.setattr(C, "STREAM_ROWS", stream)
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "SLICE", 16)
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, rank int").repartition(3)
    got = C.collocations(df, least, longest, inside, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, longest, inside, top)


def test_texts_longer_than_a_slab(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice(["one", "two", "three", "é"]) + rng.choice([" ", "\t\t", ", ", "  "]) for _ in range(400)).encode()
    langs = C._lang_hashes(["en"] * 3)
    whole = [(i.copy(), b.copy()) for i, b, _ in C._runs([text, b"", text], langs, 0, 3)]
    monkeypatch.setattr(C.slabs, "__defaults__", (37, b"\n"))
    ids, begins = [], []
    for i, b, held in C._runs([text, b"", text], langs, 0, 3):
        ids.append(i[held:])
        begins.append(b[held:])
    assert np.array_equal(np.concatenate(ids), whole[0][0]) and np.array_equal(np.concatenate(begins), whole[0][1])


def test_another_seed_where_words_share_a_number(spark, monkeypatch):
    real = C._ids
    monkeypatch.setattr(C, "_codes", lambda seed: np.ones(256, dtype=np.uint64) if seed == 0 else np.random.default_rng([13, seed]).integers(1, 2**64, 256, dtype=np.uint64))
    docs = spark.createDataFrame([("en", "aa bb cc aa")], "lang string, text string").coalesce(1)
    words, seed = C._distinct_ids(docs)
    assert real is C._ids and seed in (0, 1) and {r.word: r.n for r in words.collect()} == {"aa": 2, "bb": 1, "cc": 1}


def test_great_counts_are_exact(spark):
    assert spark.sql("select (cast(1000000 as decimal(7,0)) * (cast(3000000001 as decimal(18,0)) * cast(3000000001 as decimal(18,0)))) div (cast(3000000007 as decimal(18,0)) * cast(3000000011 as decimal(18,0))) s").first().s == 1_000_000 * 3000000001**2 // (3000000007 * 3000000011)


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame([], "lang string, text string"), longest=1)
