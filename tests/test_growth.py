"""What queries hold and move as their tables grow: plans, stored tables, files."""

import numpy as np
from pyspark.sql import functions as F

from verdikt.functions import text as X
from verdikt.llm import near_vectors as N
from verdikt.operators import compare as C
from verdikt.operators import duplicates as U
from verdikt.operators import outcomes as O
from verdikt.plans import queries_outcomes as V
from verdikt.plans import reports as R


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def answers(spark):
    """Answers of two models under two experiments, three runs, as a table that has to be parsed."""
    rows = [(m, e, r, i, "c" if i % 3 else "d", "BA"[(i + r) % 2], f"**{'ABCD'[(i * r + len(m + e)) % 4]}**", list("wxyz")) for m in ("m1", "m2") for e in ("baseline", "t1") for r in (1, 2, 3) for i in range(20)]
    return spark.createDataFrame(rows, "model string, experiment string, run_idx int, item_id long, category string, gold string, text string, choices array<string>")


def test_confusion_reads_answers_once(spark):
    rows = O.parsed(answers(spark)).withColumn("told", F.coalesce("letter", F.lit(X.UNPARSED_CHOICE)))
    got = O.confusion(rows, "gold", "told")
    assert "regexp" not in plan(got).lower() and len(plan(got)) < 20_000
    cells = {(r.truth, r.predicted): r.n for r in got.collect()}
    assert len(cells) == 16 and sum(cells.values()) == 240 and cells["C", "D"] == 0


def test_long_answers_are_told_by_their_beginnings(spark):
    """A long text is one of the choices only if its beginning may be: blanks, quotes and cut characters don't hide that."""
    long = "é" * 200 + " " + "雨" * 150
    choices = ["light rain", long, "Fog"]
    filler = "Nothing in it settles the matter so far. " * 80
    cases = [
        ("　" * 900 + "FOG" + "\n" * 5, "C"), ("light" + "  " * 700 + "RAIN.", "A"), ("*" * 600 + "`light rain`" + "." * 600, "A"), ("x" + long, None), (long, "B"), (long.upper() + "..", "B"),
        (filler + "\nB", "B"), (filler + "\x0bFog", None), (long + "\x85" + filler, "B"), ("fog" + " " * 400 + "\n" + filler, "C"), (filler + " C. fog " + filler, "C"), ("A) " + filler, "A"), (filler + "The ANSWER is B. " + filler, "B"), (filler + "The ANSWER is Bs " + filler, None), (filler + "final answer: B " + filler, "B"), ("\x1c" + filler + "\x1c", None),
    ]
    df = spark.createDataFrame([(k, t, choices) for k, (t, _) in enumerate(cases)], "i int, text string, choices array<string>")
    got = X.with_letter(df)
    assert "octet_length" in plan(got) and "translate" in plan(got)
    assert [(t[:20], r.letter) for (t, _), r in zip(cases, got.orderBy("i").collect(), strict=True)] == [(t[:20], w) for t, w in cases]


def stored_columns(monkeypatch, *modules):
    """The columns of every table that is stored from now on."""
    seen = []
    for m in modules:
        monkeypatch.setattr(m, "stored", lambda df, keep=m.stored: seen.append(df.columns) or keep(df))
    return seen


def test_reports_store_counts_not_answers(spark, monkeypatch):
    """What reports store has as many rows as arms, answers and categories make, whatever the number of items."""
    seen = stored_columns(monkeypatch, R, V)
    for f in (V.r4_answer_shares, V.r5_compare_models, V.r6_compare_runs, V.r6_category_table, V.r2_item_table):
        f(spark, "/root/testdata/sf0.001")
    assert seen and not any("item_id" in c or "text" in c for c in seen)
    assert not any({"run_idx", "choices"} <= set(c) for c in seen)


def test_reports_of_odd_lines_equal_joins(spark):
    """Items that miss in a run or an arm, lines that repeat, categories that change, against plain joins of majorities."""
    rows = [r for k, r in enumerate(answers(spark).collect()) if k % 7 and not (r.model == "m2" and r.item_id < 4)] + answers(spark).filter("item_id in (5, 6) and run_idx = 2").collect()
    rows = O.parsed(spark.createDataFrame(rows, answers(spark).schema))
    right = O.outcomes(rows)
    majority = O.majority_correct(right)
    split = majority.filter("model = 'm1' and experiment = 't1'").select("item_id", F.when(F.col("correct"), "transcript_solvable").otherwise("audio_dependent").alias("subset"))
    got = {r.experiment: r for r in R.compare_models(rows, "m1", "m2").collect()}
    sides = [majority.filter(F.col("model") == m).select("experiment", "item_id", F.col("correct").alias(c)) for m, c in (("m1", "x"), ("m2", "y"))]
    want = {r.experiment: r for r in sides[0].join(sides[1], ["experiment", "item_id"]).groupBy("experiment").agg(F.count("*").alias("n"), F.count_if("x").alias("a"), F.count_if("y").alias("b"), F.count_if(F.expr("y and not x")).alias("won"), F.count_if(F.expr("x and not y")).alias("lost")).collect()}
    assert got.keys() == want.keys() and all((got[e].n, got[e].won, got[e].lost) == (want[e].n, want[e].won, want[e].lost) and abs(got[e].score_a - 100 * want[e].a / want[e].n) < 1e-9 for e in want)
    told = {(r.model, r.experiment): r for r in R.compare_runs(right, split).collect()}
    paired = C.with_baseline(majority).join(split, "item_id", "left")
    plain = {(r.model, r.experiment): r for r in paired.groupBy("model", "experiment").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"), F.count_if(F.expr("correct and not base")).alias("won"), F.count_if(F.expr("base and not correct")).alias("lost"), F.count_if(F.expr("subset = 'audio_dependent'")).alias("n_ad")).collect()}
    assert told.keys() == plain.keys() and all([told[a][c] for c in ("n", "right", "won", "lost", "n_ad")] == [plain[a][c] for c in ("n", "right", "won", "lost", "n_ad")] for a in plain)
    items = right.select("item_id").distinct().withColumn("sub_category", F.lit("s"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(R.item_table(majority, split, items)) == key(R.item_table(majority, F.expr("model = 'm1' and experiment = 't1'"), items))


def test_near_duplicates_rule_out_by_products_and_collapse_copies(spark, monkeypatch):
    """Many short signals of mixed lengths, copies and flat ones: few reach the exact correlation, all pairs are found."""
    r = np.random.default_rng(7)
    rows = [(k, r.exponential(50, int(r.integers(30, 60))).tolist()) for k in range(60)]
    rows += [(100 + k, (2 * np.array(rows[k][1][3:]) + 5).tolist()) for k in range(10)] + [(200 + k, rows[k % 3][1]) for k in range(6)] + [(300, [4.0] * 40), (301, [4.0] * 40), (302, [0.1] * 30 + [0.2] * 10)]
    df = spark.createDataFrame(rows, "item_id long, samples array<double>")
    block, whole = U.Block([s for _, s in rows]), {}
    for k in range(len(rows)):
        others = np.arange(k + 1, len(rows))
        c = U.against(block, k, block, others, 24)
        whole |= {tuple(sorted((rows[k][0], rows[o][0]))): v for o, v in zip(others, c, strict=True) if v >= 0.8}
    assert {(200, 203), (0, 200), (0, 100)} <= whole.keys() and (300, 301) not in whole
    one = U.Stretches(block)
    some = U.likely(one, one, 24, 0.8)
    assert sum(map(len, some.values())) < 2 * len(whole)
    for samples in (4_000_000, 500):
        monkeypatch.setattr(U, "BLOCK_SAMPLES", samples)
        got = {(x.left_id, x.right_id): x.corr for x in U.near_duplicates(df, 24, 0.8, symmetric=False).collect()}
        assert got.keys() == whole.keys() and all(abs(got[p] - whole[p]) < 1e-9 for p in got)


def test_near_vectors_write_nothing_for_a_pair_of_blocks(spark, monkeypatch):
    """Blocks meet where their trees are read: what is stored of the pairs is at most a count and an edge for a vector and task."""
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    rows = [(k, (base[k % 40] + 0.1 * r.standard_normal(16)).tolist()) for k in range(1200)]
    kept = []
    monkeypatch.setattr(N, "stored", lambda df, keep=N.stored: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    got = {x.vec_id: x for x in N.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [got[k].n_links for k in range(1200)] == links.tolist() and links.max() > 10
    found = next(t for t in kept if t.columns == ["a", "b", "n"])
    assert not any(t.columns == ["x", "y"] for t in kept) and found.count() < 1200 * 2 * 8
