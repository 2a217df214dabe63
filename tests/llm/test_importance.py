"""Importance resampling against a plain version: checksums, weights, draws, odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.llm import importance as I
from verdikt.llm.common import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)


def plain(rows, target, most, least, percent, buckets, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, most)[0]) for texts in ([x for _, x in rows], target))
    big_s, big_t = s.total(), t.total()
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets))))
    out = []
    for doc, x in rows:
        f, n = features(x, most)
        weight = sum(gain(bucket(a)) for a in f) // len(f) if f else 0
        if doc is None:
            out.append((doc, len(f), weight, None, n))
            continue
        h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in out if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    place = {r[0]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((r[0] or -1, *r[1:4], place.get(r[0]) if r[4] >= least else None) for r in out)


@pytest.mark.parametrize("columns", [I.COLUMNS, 7])
def test_checksums_of_every_length(monkeypatch, columns):
    monkeypatch.setattr(I, "COLUMNS", columns)
    monkeypatch.setattr(I, "_SKIP", I._skip_tables())
    monkeypatch.setattr(I, "MATRIX", 4096)
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 40_000, dtype=np.uint8)
    length = np.concatenate([np.arange(0, 40), [255, 256, 257, 511, 512, 513, 5000, 30_000], np.full(50, 9)])
    begin = rng.integers(0, len(data) - length + 1)
    assert I.crc32s(data, begin, length).tolist() == [zlib.crc32(data[b : b + n].tobytes()) for b, n in zip(begin, length, strict=True)]


ROWS = [(1, "One two THREE four-five six"), (2, None), (3, ""), (4, "... ---"), (5, "été über 漢字 " * 30), (6, "a" * 3000 + " b c"), (7, "one two three four five six"), (8, "one two three four five six"), (None, "one two three"), (9, "x y z " * 400_000), (10, "one" + "\x00" + "two\x7fthree `six`")]


@pytest.mark.parametrize("most,least,percent", [(1, 3, 50), (2, 1, 100), (3, 2, 10)])
def test_equals_plain(spark, most, least, percent):
    rows = ROWS if most == 1 else [(d, x and x[:500]) for d, x in ROWS]
    df = spark.createDataFrame([(d, "k", x) for d, x in rows], "doc_id long, rank string, text string").repartition(3)
    target = ["one two", None, "été six six"]
    got = I.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), buckets=50, most=most, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == plain(rows, target, most, least, percent, 50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert I.resample(none, none).collect() == []
    assert [r["rank"] for r in I.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none, least_words=1, percent=100).collect()] == [1]


def test_ranked_within_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 11).alias("v"), "id")
    got = ranked(df, [F.desc("v"), F.col("id")], ["g"]).collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: (-r.v, r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
