"""Two-phase scans, selection and statistics on counts against plain versions; indexed duplicates and neighbours."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.operators import duplicates as U
from verdikt.operators import events as E
from verdikt.operators import retrieval as K
from verdikt.operators import selection as L
from verdikt.operators import stats as S


@pytest.fixture
def many_parts(spark):
    """More ranges than a clip has rows, some of them: chunks begin and end inside runs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_of_one_long_clip_over_many_tasks(spark, many_parts):
    rng = random.Random(3)
    rows = []
    for clip, n in (("hot", 4000), ("b", 7), ("c", 1), (None, 3)):
        value = None
        for k in range(n):
            value = rng.choice([True, False, None]) if rng.random() < 0.02 else value
            rows.append((clip, k, value, f"w{k}"))
    df = spark.createDataFrame(rows, "item string, k long, v boolean, w string").repartition(5)
    got = E.runs(df, ["item"], "k", F.col("v"), first=["w"], last=["w"], text="w")
    want = []
    for clip in ("hot", "b", "c", None):
        for value, run in itertools.groupby([r for r in rows if r[0] == clip], key=lambda r: r[2]):
            run = list(run)
            want.append((clip, value, run[0][1], run[-1][1], len(run), run[0][3], run[-1][3], " ".join(r[3] for r in run)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert E.chunked(df, ["item"], "k").filter("item = 'hot'").select("_chunk").distinct().count() > 5
    true = E.flag_runs(df.withColumnRenamed("v", "flag"), ["item"], "k", "flag", 3)
    assert sorted(map(tuple, true.collect()), key=str) == sorted([(c, a, b, n) for c, v, a, b, n, *_ in want if v and n >= 3], key=str)


def test_one_run_through_every_chunk(spark, many_parts):
    df = spark.range(5000).select(F.lit("a").alias("item"), F.col("id").alias("k"), F.lit(True).alias("flag"))
    assert [tuple(r) for r in E.flag_runs(df, ["item"], "k", "flag").collect()] == [("a", 0, 4999, 5000)]
    assert E.flag_runs(df.limit(0), ["item"], "k", "flag").collect() == []


def test_nearest_turn_over_chunks(spark, many_parts):
    rng = random.Random(5)
    words = [(c, k, "x", t, t + 0.5) for c in ("a", "b") for k, t in enumerate(rng.uniform(0, 10_000) for _ in range(600))]
    turns = [(c, k, t, t + 1.0, f"S{k % 5}") for c in ("a",) for k, t in enumerate(rng.uniform(4000, 6000) for _ in range(9))]
    got = E.assign_speakers(spark.createDataFrame(words, "item_id string, word_idx int, word string, start_s double, end_s double"), spark.createDataFrame(turns, "item_id string, turn_idx int, start_s double, end_s double, speaker string"))

    def plain(c, a, b):
        own = [t for t in turns if t[0] == c]
        over = [(-(min(b, t[3]) - max(a, t[2])), t[1], t[4]) for t in own if min(b, t[3]) > max(a, t[2])]
        near = [(abs((t[2] + t[3]) / 2 - (a + b) / 2), t[1], t[4]) for t in own]
        return min(over)[2] if over else min(near)[2] if near else "SPK1"

    assert {(r.item_id, r.word_idx): r.speaker for r in got.collect()} == {(c, k): plain(c, a, b) for c, k, _, a, b in words}


def test_interval_pairs_equal_all_pairs(spark):
    rng = random.Random(9)
    span = lambda most: (lambda a: (a, a + rng.choice([0.0, 0.25, 1.0, rng.uniform(0, 3), rng.uniform(0, most)])))(rng.choice([0.0, 4.0, rng.uniform(-100, 100)]))
    left = [(rng.choice("ab"), k, *span(5)) for k in range(150)] + [("a", 900, None, 1.0), ("a", 901, 5.0, 1.0), ("b", 902, float("nan"), 2.0)]
    right = [(rng.choice("abc"), k, *span(150)) for k in range(150)] + [("b", 903, -1000.0, 1000.0), ("b", 904, 0.0, float("inf"))]
    a, b = spark.createDataFrame(left, "item string, u int, s double, e double"), spark.createDataFrame(right, "item string, v int, rs double, re double")
    got = [(r.u, r.v) for r in E.interval_pairs(a, b, ["item"], ("s", "e"), ("rs", "re")).collect()]
    good = lambda x, y: x is not None and x == x and x <= y < math.inf
    want = [(u, v) for i, u, s, e in left for j, v, rs, re in right if i == j and good(s, e) and good(rs, re) and max(s, rs) <= min(e, re)]
    assert sorted(got) == sorted(want) and len(want) > 500
    assert E.interval_pairs(a, b.limit(0), ["item"], ("s", "e"), ("rs", "re")).collect() == []


def test_envelope_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK_FRAMES", 16)
    x = np.random.default_rng(2).standard_normal(1003)
    got = E.rms_envelope(spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "item_id string, idx long, x double"), 4).orderBy("frame").collect()
    frames = [math.sqrt(sum(v * v for v in x[max(0, 4 * f - 2) : 4 * f + 2]) / 4) for f in range(len(got))]
    assert np.allclose([r.rms for r in got], frames)
    assert np.allclose([r.smoothed for r in got], [sum(frames[max(0, f - 5) : f + 5]) / 10 for f in range(len(frames))])


@pytest.mark.parametrize("few", [1, 10_000])
def test_order_statistics(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW", few)
    monkeypatch.setattr(L, "BINS", 8)
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(0, 5, 500), np.full(300, 7.0), rng.integers(-3, 3, 200), [1e308, -1e308, np.inf, -np.inf, -np.inf, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    ranks = [0, 1, 2, 100, 400, 500, 700, len(values) - 2, len(values) - 1]
    assert L.order_statistics(df, F.col("v"), ranks) == np.sort(values)[ranks].tolist()
    assert L.exact_quantile(df, F.col("v"), 0.5) == float(np.median(values)) and L.exact_quantile(df.limit(0), F.col("v"), 0.5) is None
    with pytest.raises(ValueError):
        L.order_statistics(df, F.col("v"), [len(values)])


def test_tails_equal_the_sum():
    for n, p in itertools.product((1, 2, 17, 100, 401), (Fraction(1, 2), Fraction(1, 4), Fraction(9, 10))):
        for r in {0, 1, n // 4, n // 2, n // 2 + 1, 3 * n // 4, n}:
            want = sum(Fraction(math.comb(n, i)) * p**i * (1 - p) ** (n - i) for i in range(r, n + 1))
            assert S.binomial_tail(r, n, float(p)) == pytest.approx(float(want), rel=1e-12)
    assert S.exact_binomial_p(50_010_000, 49_990_000) == pytest.approx(math.erfc((20_000 - 1) / 10_000 / math.sqrt(2)), rel=1e-6)
    assert S.exact_binomial_p(10**8, 10**8) == 1.0


def test_mixed_chance_equals_the_sum():
    for options in ([(2, 40), (4, 60), (8, 20)], [(1, 4), (2, 5), (3, 6)], [(3, 50), (4, 50)]):
        mass = {0: Fraction(1)}
        for k, n in options:
            own = [Fraction(math.comb(n, i) * (k - 1) ** (n - i), k**n) for i in range(n + 1)]
            nxt: dict = {}
            for (a, x), (i, y) in itertools.product(mass.items(), enumerate(own)):
                nxt[a + i] = nxt.get(a + i, 0) + x * y
            mass = nxt
        for right in range(0, sum(n for _, n in options) + 1, 7):
            assert S.chance_p(options, right) == pytest.approx(float(sum(v for a, v in mass.items() if a >= right)), rel=1e-11)


@pytest.mark.parametrize("numbers,part", [(4_000_000, 100_000), (30, 7)])
def test_knn_equals_plain(spark, monkeypatch, numbers, part):
    monkeypatch.setattr(K, "SENT_NUMBERS", 0 if numbers == 30 else numbers)
    monkeypatch.setattr(K, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(K, "PART_ROWS", part)
    rng = np.random.default_rng(8)
    v = rng.standard_normal((60, 4))
    v[10:14] = v[10]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "item_id long, embedding array<double>")
    dups = [(q, p) for q in range(20) for p in range(20, 60) if (q * p) % 7 == 0] + [(3, p) for p in range(20, 59)]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for drop in (False, True):
        got = K.knn(df, df.filter("item_id >= 20"), spark.createDataFrame(dups * 2, "left_id long, right_id long"), 5, drop_duplicates=drop)
        for q in range(20):
            scored = sorted((-(float("-inf") if (q, p) in dups else float(unit[q] @ unit[p])), p) for p in range(20, 60))
            want = [p for s, p in scored[:5] if not drop or s < float("inf")]
            assert [r.neighbor_id for r in sorted((r for r in got.collect() if r.item_id == q), key=lambda r: r["rank"])] == want
        assert got.filter("item_id >= 20").isEmpty()
    assert K.knn(df, df.limit(0), None, 2).collect() == []


def recordings(n, length, seed=1, noise=0.02):
    """Signals, every fourth with a cut of it that is shifted, louder, moved and noisy."""
    rng = np.random.default_rng(seed)
    rows, twins = [], set()
    for k in range(n):
        x = np.cumsum(rng.standard_normal(length + 500)) * 0.05 + rng.standard_normal(length + 500)
        rows.append((k, x[:length]))
        if k % 4 == 0:
            at = int(rng.integers(0, min(500, length // 2)))
            rows.append((1000 + k, 3.0 * x[at : at + length] + 7.0 + noise * rng.standard_normal(length)))
            twins.add((k, 1000 + k))
    return [(k, x.tolist()) for k, x in rows], twins


@pytest.mark.parametrize("entry", [1024, 1])
def test_index_finds_what_all_pairs_find(spark, monkeypatch, entry):
    monkeypatch.setattr(U, "ENTRY_ROWS", entry)
    rows, twins = recordings(40, 1200)
    rows += [(5000, [0.0] * 1200), (5001, [0.0] * 1200), (5002, [1.0] * 5), (5003, None)]
    df = spark.createDataFrame(rows, "item_id long, samples array<double>")
    key = lambda d: {(r.left_id, r.right_id): round(r["corr"], 9) for r in d.collect()}
    got = key(U.indexed_duplicates(df, 600, 0.8))
    assert got == key(U.near_duplicates(df, 600, 0.8)) and set(got) == twins | {(b, a) for a, b in twins}
    assert U.candidate_pairs(df, 600).count() < 0.1 * len(rows) ** 2 / 2


def test_ids_may_be_texts(spark):
    rows, twins = recordings(9, 600, noise=0.0)
    df = spark.createDataFrame([(f"clip{k:04d}", x) for k, x in rows], "item_id string, samples array<double>")
    want = {(f"clip{a:04d}", f"clip{b:04d}") for a, b in twins}
    assert {(r.left_id, r.right_id) for r in U.indexed_duplicates(df, 300, 0.8, symmetric=False).collect()} == want
    assert {(r.left_id, r.right_id) for r in U.near_duplicates(df, 300, 0.8, symmetric=False).collect()} == want


def test_index_compares_an_ever_smaller_share(spark):
    share = []
    pairs = lambda rows: {tuple(r) for r in U.candidate_pairs(spark.createDataFrame(rows, "item_id long, samples array<double>"), 400).collect()}
    for n in (30, 300):
        rows, twins = recordings(n, 800, seed=n, noise=0.0)
        found = pairs(rows)
        assert twins <= found  # every cut
        share.append(len(found) / (len(rows) * (len(rows) - 1) / 2))
        rows, twins = recordings(n, 800, seed=n)
        assert len(twins & pairs(rows)) >= 0.9 * len(twins)  # with noise on a short common part, nearly every
    assert share[1] < share[0] / 3
