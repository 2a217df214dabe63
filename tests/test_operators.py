"""Hand-made tables with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.operators import compare as C
from verdikt.operators import dataset as D
from verdikt.operators import duplicates as U
from verdikt.operators import events as E
from verdikt.operators import outcomes as O
from verdikt.operators import requests as Q
from verdikt.operators import retrieval as K
from verdikt.operators import signals as G
from verdikt.operators import stats as S


def outcomes(spark):
    runs = {"ID1": ("BBB", "BBB"), "ID2": ("BBA", "BBB"), "ID3": ("BAA", "BBB"), "ID4": ("AAA", "BBA")}
    rows = [("m", arm, k + 1, item, letters[k] == "B", "c") for item, both in runs.items() for arm, letters in zip(("baseline", "cot"), both, strict=True) for k in range(3)]
    return spark.createDataFrame(rows, "model string, experiment string, run_idx int, item_id string, correct boolean, category string")


def test_majority_and_pairing(spark):
    m = O.majority_correct(outcomes(spark))
    right = {(r.experiment, r.item_id) for r in m.filter("correct").collect()}
    assert right == {("baseline", "ID1"), ("baseline", "ID2")} | {("cot", f"ID{k}") for k in (1, 2, 3, 4)}
    r = C.won_lost(C.with_baseline(m), ["experiment"]).filter("experiment = 'cot'").first()
    assert (r.won, r.lost, r.n) == (2, 0, 4)


def test_item_missing_in_a_run_vanishes(spark):
    rows = outcomes(spark).filter("not (item_id = 'ID1' and run_idx = 2 and experiment = 'cot')")
    assert {r.item_id for r in O.majority_correct(rows).filter("experiment = 'cot'").collect()} == {"ID2", "ID3", "ID4"}


@pytest.mark.parametrize("won,lost,p", [(16, 4, 0.0118), (35, 19, 0.0402), (34, 12, 0.0016), (9, 9, 1.0), (0, 0, 1.0), (3000, 2900, 0.1974)])
def test_mcnemar(won, lost, p):
    assert S.exact_binomial_p(won, lost) == pytest.approx(p, abs=6e-4)
    assert S.exact_binomial_p(won, lost) == S.exact_binomial_p(lost, won)


def test_resampling_on_counts():
    low, high = S.bootstrap_interval(75, 100, "k")
    r = np.random.default_rng(0)
    rows = np.percentile((r.random((10000, 100)) < 0.75).mean(axis=1) * 100, [2.5, 97.5])
    assert abs(low - rows[0]) <= 2 and abs(high - rows[1]) <= 2 and S.bootstrap_interval(0, 0, "k") == (0.0, 0.0)
    assert S.permutation_p([0, 0], [0, 0], [5, 5], "k") == 1.0 and S.permutation_p([], [], [], "k") == 1.0
    assert S.permutation_p([30, 30, 0], [0, 0, 0], [40, 40, 40], "k") < 0.01


def test_holm(spark):
    df = spark.createDataFrame([("m", "a", 0.01), ("m", "b", 0.04), ("m", "c", 0.03), ("n", "a", 0.5), ("n", "b", None)], "model string, e string, p double")
    got = {(r.model, r.e): r.holm for r in S.holm(df, "p", ["model"]).collect()}
    assert got[("m", "a")] == pytest.approx(0.03) and got[("m", "c")] == got[("m", "b")] == pytest.approx(0.06) and got[("n", "a")] == 0.5 and got[("n", "b")] is None


def test_balanced_accuracy_and_collapse(spark):
    df = spark.createDataFrame([("COPD", "COPD")] * 4 + [("healthy", "COPD")] * 2, "t string, p string")
    assert O.balanced_accuracy(df, [], "t", F.col("t") == F.col("p")).first().balanced_accuracy == 50.0
    r = O.collapse_metrics(df.withColumn("g", F.lit(1)), ["g"], "t", F.col("p"), ["COPD", "healthy"]).first()
    assert (round(r.majority_baseline_pct, 2), r.chance_pct, r.collapse_index_pct, r.unparsed_pct) == (66.67, 50.0, 100.0, 0.0)
    report = {x.label: x for x in O.classification_report(df, "t", "p").collect()}
    assert report["healthy"].f1 == 0.0 and report["COPD"].recall == 1.0 and report["COPD"].precision == pytest.approx(4 / 6)


def test_judge_scores(spark):
    df = spark.createDataFrame([("x", 8, 10, 0), ("x", 2, 0, 1), ("x", 8, 10, 0)], "e string, acoustic int, diagnostic int, hallucination int")
    r = O.judge_score_metrics(df, ["e"]).first()
    assert (r.acoustic_pct, round(r.diagnostic_pct, 2), round(r.hallucination_pct, 2)) == (60.0, 66.67, 33.33)


def test_votes_undo_permutations(spark):
    orders = [[0, 1, 2], [1, 0, 2], [2, 0, 1], [1, 2, 0], [0, 2, 1]]
    rows = [("q", k, letter, orders[k]) for k, letter in enumerate(["B", "A", None, "B", "C"])] + [("tie", 0, "A", orders[0]), ("tie", 1, "A", orders[1]), ("none", 0, None, orders[0])]
    df = spark.createDataFrame(rows, "item string, v int, letter string, permutation array<int>")
    got = {r.item: (r.winner, r.votes) for r in O.vote(df, "item", "v", O.unpermuted(F.col("letter"), F.col("permutation"))).collect()}
    assert got == {"q": ("B", ["B", "B", "C", "B"]), "tie": ("A", ["A", "B"]), "none": ("", [])}


def test_contrastive_scores(spark):
    rows = [("i", "A", "real", -1.0), ("i", "A", "silence", -1.0), ("i", "B", "real", -1.0), ("i", "B", "silence", -3.0)]
    best = O.contrastive_scores(spark.createDataFrame(rows, "item_id string, letter string, signal string, logprob double"), spark.createDataFrame([(0.0,), (1.0,)], "alpha double"))
    assert {r.alpha: r.best for r in best.collect()} == {0.0: "A", 1.0: "B"}


def test_knn_ranks_duplicates_last(spark):
    rows = [("north", [0.0, 3.0], "cold"), ("east", [2.0, 0.0], "mild"), ("northeast", [1.0, 1.0], "mild"), ("south", [0.0, -1.0], "warm"), ("p1", [0.1, 1.0], "cold"), ("p2", [1.0, 0.2], "mild"), ("p3", [-0.1, -1.0], "hot"), ("zero", [0.0, 0.0], "none"), ("gone", None, "none")]
    good, bad = K.usable_vectors(spark.createDataFrame(rows, "item_id string, embedding array<double>, label string"))
    assert {r.item_id for r in bad.collect()} == {"zero", "gone"}
    pool = good.filter("item_id like 'p_'")
    same = spark.createDataFrame([("north", "p1"), ("south", "p3")], "left_id string, right_id string")
    got = K.knn(good, pool, same, 3)
    by = {}
    for r in got.collect():
        by.setdefault(r.item_id, {})[r["rank"]] = r.neighbor_id
    assert {q: [v[k] for k in sorted(v)] for q, v in by.items()} == {"north": ["p2", "p3", "p1"], "east": ["p2", "p1", "p3"], "northeast": ["p2", "p1", "p3"], "south": ["p2", "p1", "p3"]}
    assert {r.item_id for r in K.knn(good, pool, same, 3, drop_duplicates=True).filter("neighbor_id = 'p3'").collect()} == {"north", "east", "northeast"}
    vote = K.knn_vote(got.filter("rank = 1"), good.select("item_id", "label"))
    assert {r.item_id: r.predicted for r in vote.collect()} == dict.fromkeys(("north", "east", "northeast", "south"), "mild")


def test_best_correlation_equals_brute_force():
    r = np.random.default_rng(6)
    wave = np.cumsum(r.standard_normal(300))
    signals = [wave[:120], wave[60:200], -wave[10:110], r.standard_normal(90), np.full(50, 2.0), wave[:20]]
    block = U.Block(signals)
    for shared in (1, 12, 60, 130):
        got = U.against(block, 0, block, np.arange(len(signals)), shared)
        for x, c in zip(signals, got, strict=True):
            a, best = signals[0], -np.inf
            for lag in range(-len(x) + 1, len(a)):
                i, j = max(0, lag), min(len(a), len(x) + lag)
                if j - i >= max(shared, 2) and a[i:j].std() > 1e-9 and x[i - lag : j - lag].std() > 1e-9:
                    best = max(best, np.corrcoef(a[i:j], x[i - lag : j - lag])[0, 1])
            if shared >= 12:
                assert c == pytest.approx(best if best > -np.inf else 0.0, abs=1e-6)


def test_cut_signals_are_found(spark, monkeypatch):
    r = np.random.default_rng(7)
    whole = [np.cumsum(r.standard_normal(900)) for _ in range(9)]
    rows = [(k, w[:700].tolist()) for k, w in enumerate(whole)] + [(100, whole[4][150:].tolist()), (101, None), (102, [1.0])]
    df = spark.createDataFrame(rows, "item_id long, samples array<double>")
    found = {(x.left_id, x.right_id): x.corr for x in U.near_duplicates(df, 500, 0.99).collect()}
    assert set(found) == {(4, 100), (100, 4)} and found[(4, 100)] == pytest.approx(1.0)
    monkeypatch.setattr(U, "BLOCK_SAMPLES", 1000)
    assert {(x.left_id, x.right_id) for x in U.near_duplicates(df, 500, 0.99).collect()} == set(found)


RATE = 4000


def tone(seconds, *parts):
    t = np.arange(int(seconds * RATE)) / RATE
    x = np.zeros(len(t))
    for hz, start, length in parts:
        at = (t >= start) & (t < start + length)
        x[at] += np.sin(2 * np.pi * hz * t[at])
    return x + 1e-4 * np.random.default_rng(1).standard_normal(len(t))


def clips_of(spark, **signals):
    return spark.createDataFrame([(k, RATE, None if v is None else [float(x) for x in v]) for k, v in signals.items()], "item_id string, sample_rate int, samples array<double>")


def test_tones_and_transients(spark):
    noise = np.fft.rfft(0.1 * np.random.default_rng(0).standard_normal(5 * RATE))
    hz = np.fft.rfftfreq(5 * RATE, 1 / RATE)
    noise = np.fft.irfft(np.where((hz > 100) & (hz < 1800), noise, 0))  # the detectors start from filtered signals
    clicks = 1e-3 * np.random.default_rng(4).standard_normal(3 * RATE)
    for at in (6000, 6300, 6600, 9000):
        clicks[at : at + 24] += np.hanning(24) * np.cos(2 * np.pi * 600 * np.arange(24) / RATE)
    df = clips_of(spark, one=tone(1.5, (520, 0.4, 0.5)), two=tone(1.5, (300, 0.2, 0.6), (700, 0.2, 0.6)), noise=noise, clicks=clicks, short=[1.0, 2.0])
    tonal = {r.item_id: r for r in G.detect_wheezes(df).collect()}
    assert set(tonal) == {"one", "two"} and tonal["one"].kind == "monophonic" and abs(tonal["one"].tones[0] - 520) < 20
    assert tonal["two"].kind == "polyphonic" and abs(tonal["one"].start_s - 0.4) < 0.07 and abs(tonal["one"].end_s - 0.9) < 0.07
    assert sorted(round((r.start_s + r.end_s) / 2 * RATE, -2) for r in G.detect_crackles(df.filter("item_id in ('clicks', 'noise', 'short')")).collect()) == [6000, 6300, 6600, 9000]


def test_cycles_and_their_text(spark):
    t = np.arange(20 * RATE) / RATE
    breath = np.random.default_rng(5).standard_normal(len(t)) * (0.1 + np.sin(np.pi * 0.3 * t) ** 2)
    for k in range(3):
        breath[int(8.3 * RATE) + 250 * k] += 60
    df = clips_of(spark, breath=breath, silent=np.zeros(RATE), bad=[0.0, float("nan")], none=None, empty=[])
    spans = G.segment_cycles(df).orderBy("start_s").collect()
    assert 60 * len(spans) / (spans[-1].end_s - spans[0].start_s) == pytest.approx(18, abs=1.5)
    got = {r.item_id: r for r in G.clip_evidence(df).collect()}
    assert len(got) == 5 and got["bad"].error and got["none"].error and got["none"].cycles_summary is None
    assert got["silent"].adventitious_summary == G.NO_EVENTS and got["empty"].cycles_summary == G.NO_CYCLES
    assert got["breath"].cycles_summary.startswith("Respiratory rate ~18/min over 4 segmented cycles; mean cycle length 3.3 s; inspiration:expiration ~1:")
    lines = got["breath"].adventitious_summary.split("\n")
    assert "3 fine crackle-like transients in the" in lines[0] and lines[0].startswith("Cycle ") and lines[-1] == "Total: 0 wheeze-like events, 3 crackle-like transients (0.8 per cycle)."


def in_pieces(spark, length, **signals):
    rows = [(k, RATE, at, [float(x) for x in v[at : at + length]]) for k, v in signals.items() for at in range(0, max(1, len(v)), length)]
    return spark.createDataFrame(rows, "item_id string, sample_rate int, start long, samples array<double>").repartition(3)


@pytest.mark.parametrize("length", [256, 1000, 4001, 10**6])
def test_pieces_equal_whole_recordings(spark, length):
    rng = np.random.default_rng(6)
    t = np.arange(12 * RATE) / RATE
    breath = rng.standard_normal(len(t)) * (0.1 + np.sin(np.pi * 0.3 * t) ** 2)
    mixed = tone(3.0, (300, 0.2, 0.6), (700, 0.2, 0.6), (520, 1.4, 1.1)) + 0.02 * rng.standard_normal(3 * RATE)
    signals = {"breath": breath, "one": tone(1.5, (520, 0.4, 0.5)), "mixed": mixed, "short": np.array([1.0, 2.0, 1.0]), "empty": np.zeros(0), "odd": tone(1.0, (400, 0.0, 1.0))[:3333]}
    whole, cut = clips_of(spark, **signals), in_pieces(spark, length, **signals)
    key = lambda df: sorted((r.item_id, round(r.start_s, 9), round(r.end_s, 9), *([r.kind, [round(x, 6) for x in r.tones]] if "kind" in df.columns else [r.cycle_idx])) for r in df.collect())
    assert key(G.wheezes_in_pieces(cut)) == key(G.detect_wheezes(whole)) and len(key(G.detect_wheezes(whole))) >= 4
    assert key(G.cycles_in_pieces(cut)) == key(G.segment_cycles(whole)) and len(key(G.segment_cycles(whole))) >= 2


def test_bytes_are_samples(spark):
    df = spark.createDataFrame([(1, RATE, bytearray(b"ab" * 900))], "item_id long, sample_rate int, samples binary")
    assert G.clip_rows(df).filter("part = 'clip'").first().end_s == 0.45


def test_speakers_and_lines(spark):
    words = spark.createDataFrame([("i", 0, "hi", 0.0, 1.0), ("i", 1, "there", 1.1, 2.0), ("i", 2, "yes", 5.0, 5.5), ("j", 0, "alone", 0.0, 1.0)], "item_id string, word_idx int, word string, start_s double, end_s double")
    turns = spark.createDataFrame([("i", 0, 0.0, 2.0, "Z"), ("i", 1, 3.0, 4.5, "A")], "item_id string, turn_idx int, start_s double, end_s double, speaker string")
    got = E.assign_speakers(words, turns)
    assert {(r.item_id, r.word_idx): r.speaker for r in got.collect()} == {("i", 0): "Z", ("i", 1): "Z", ("i", 2): "A", ("j", 0): "SPK1"}
    assert [r.line for r in E.diarized_lines(got.filter("item_id = 'i'")).orderBy("first").collect()] == ["[0.0-2.0] Z: hi there", "[5.0-5.5] A: yes"]
    names = {r.speaker: r.name for r in E.rename_by_first_appearance(got, turns).filter("item_id = 'i'").collect()}
    assert names == {"Z": "SPK1", "A": "SPK2"}


def test_peak_clusters(spark):
    got = spark.range(1).select(E.peak_clusters(F.array(*[F.lit(float(x)) for x in (350, 355, 620, 460, 700)])).alias("x")).first().x
    assert got == [350.0, 460.0, 620.0]


def test_splits_fail_loudly(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "item_id string, label string")
    dups = spark.createDataFrame([("c", "a"), ("a", "c")], "left_id string, right_id string")
    split = D.demo_split(items, dups, "label")
    assert {(r.item_id, r.role) for r in split.collect()} == {("b", "demonstration"), ("c", "demonstration"), ("a", "held_out")}
    D.check_split(split, 2)
    with pytest.raises(ValueError):
        D.check_split(split, 3)
    with pytest.raises(ValueError):
        D.check_split(split, 2, most_per_demo=0)


def test_variants(spark):
    df = spark.createDataFrame([("a", "B", ["x", "y", "z"])], "item_id string, gold string, choices array<string>")
    rows = Q.shuffle_variants(df, 4).collect()
    assert [r.permutation for r in rows if r.variant_idx == 0] == [[0, 1, 2]]
    assert all(r.choices[ord(r.gold) - 65] == "y" and sorted(r.permutation) == [0, 1, 2] for r in rows)


def test_degenerate_and_scores(spark):
    df = spark.createDataFrame([("same",)] * 6 + [(str(k),) for k in range(5)], "t string")
    assert D.degenerate_text(df, "t").first().rejected and not D.degenerate_text(df.limit(9), "t").first().rejected
    assert math.isclose(S.above_chance(spark.createDataFrame([("g", True)] * 3, "g string, correct boolean"), ["g"], F.lit(2)).first().p, 0.125)


def test_chance_over_mixed_options_is_exact():
    want = 0.0
    for hits in np.ndindex(4, 3):  # 3 items with 2 options, 2 items with 5
        mass = math.comb(3, hits[0]) * 0.5**3 * math.comb(2, hits[1]) * 0.2 ** hits[1] * 0.8 ** (2 - hits[1])
        want += mass if sum(hits) >= 3 else 0.0
    assert S.chance_p([(2, 3), (5, 2)], 3) == pytest.approx(want) and S.chance_p([(1, 4)], 4) == 1.0 and S.chance_p([(4, 9)], 0) == pytest.approx(1.0)
    assert 0 < S.chance_p([(2, 200_000), (4, 100_000)], 126_000) < 1e-3


def test_missing_baseline_raises(spark):
    arms = spark.createDataFrame([("a", "baseline"), ("a", "x"), ("b", "x")], "model string, experiment string")
    assert [r.experiment for r in C.experiments_run_by_all(arms, None).collect()] == ["x"]
    with pytest.raises(ValueError):
        C.experiments_run_by_all(arms)
