"""Substring dedup against a plain version: windows, owners, periodic and long texts, odd rows, small shards."""

import hashlib
import random

import pytest

from verdikt.llm import passages as P


def plain(rows, window):
    """Every window of every document, compared as words."""
    split = [(d, (x or "").encode().split()) for d, x in rows]
    first: dict = {}
    for d, w in split:
        if d is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < d:
                    gone.update(range(k, k + window))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def made(seed, window, many):
    """Texts of a few words that share passages of about a window: near misses, overlaps, periods, copies, case."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "A", "été", "漢", "x" * 40]) + str(rng.randrange(30))
    pool = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(8)]
    pool += [["p", "q", "r"] * window, ["z"] * (2 * window)]
    rows = []
    for d in range(many):
        w: list = []
        for _ in range(rng.randrange(5)):
            w += [word() for _ in range(rng.randrange(2 * window))]
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += p[a:] if rng.random() < 0.5 else p
        rows.append((rng.randrange(1000) if rng.random() < 0.9 else d, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [rows[3], (rows[3][0] + 500, rows[3][1]), (None, rows[5][1]), (1001, None), (1002, " \x0b\n"), (1003, "one"), (2000, rows[7][1].replace(" ", "\x0c")), (2001, "z " * 20_000), (2002, " ".join(f"w{k}" for k in range(30_000))), (2003, " ".join(f"w{k}" for k in range(29_000)))]
    return rows


@pytest.mark.parametrize("seed,window,shard,claim", [(1, 10, 50_000, 100_000), (2, 10, 40, 60), (3, 5, 300, 50), (4, 50, 100, 100)])
def test_equals_plain(spark, monkeypatch, seed, window, shard, claim):
    monkeypatch.setattr(P, "SHARD_WORDS", shard)
    monkeypatch.setattr(P, "CLAIM_WORDS", claim)
    rows = made(seed, window, 60)
    df = spark.createDataFrame([(d, x, "k") for d, x in rows], "doc_id long, text string, key string").repartition(3)
    got = P.repeated_passages(df, window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
    out = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == plain(rows, window)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.spans) for r in out)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.repeated_passages(none).collect() == []
    one = spark.createDataFrame([(1, "word " * 200), (2, "other words")], "doc_id long, text string")
    assert sorted(r.n_removed for r in P.repeated_passages(one).collect()) == [0, 0]


def test_automaton_over_more_words_than_symbols(monkeypatch):
    monkeypatch.setattr(P, "SYMBOLS", 60)
    shard = P.Phrases(10)
    assert shard.room(["w"] * 500)
    shard.add(1, [f"w{k}" for k in range(50)])
    assert not shard.room(["w"] * 20)
    assert shard.compiled().found(1, [f"w{k}" for k in range(20, 45)]) == [(0, 25)] and shard.found(2, [f"w{k}" for k in range(20, 45)]) == []


def test_symbols_pass_over_surrogates():
    assert "".encode() == P.Phrases.text([]).encode() and P.Phrases.text([0xD7FF, 0xD800, 0xE000]).encode("utf-8")
