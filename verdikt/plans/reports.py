"""Report tables: compositions of the operators that a user calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare as C
from ..operators import dataset as D
from ..operators import outcomes as O
from ..operators import stats as S
from ..sources.store import stored

ARM = O.ARM


def choice_summary(parsed: DataFrame, baseline: str = "baseline", control: str = "t3") -> DataFrame:
    """Model by experiment: accuracy overall and per subset, deltas and paired tests against the baseline, top answer.

    The subset of an item comes from the model's ``control`` arm. Tests are adjusted inside a model over the arms that
    aren't the baseline; the baseline's own delta is null and its p is 1.
    """
    majority = O.majority_correct(O.outcomes(parsed))
    rows = C.with_baseline(majority, baseline)
    solvable = F.max(F.when(F.col("experiment") == control, F.col("correct"))).over(Window.partitionBy("model", "item_id"))
    rows = rows.withColumn("subset", F.when(solvable, "ts").when(~solvable, "ad"))
    a, b = F.col("correct"), F.col("base")
    of = lambda s: F.lit(True) if s is None else F.col("subset") == s
    cols = [F.count("*").alias("n")]
    for name, s in (("", None), ("_ts", "ts"), ("_ad", "ad")):
        cols += [(F.avg(F.when(of(s), a.cast("double"))) * 100).alias(f"acc{name}"), F.count_if(of(s) & a & ~b).alias(f"won{name}"), F.count_if(of(s) & ~a & b).alias(f"lost{name}")]
    out = rows.groupBy(*ARM).agg(*cols)
    for name in ("", "_ts", "_ad"):
        own = F.max(F.when(F.col("experiment") == baseline, F.col(f"acc{name}"))).over(Window.partitionBy("model"))
        out = out.withColumn(f"d{name}", F.when(F.col("experiment") != baseline, F.col(f"acc{name}") - own))
        out = out.withColumn(f"p{name}", F.when(F.col("experiment") == baseline, 1.0).otherwise(S.mcnemar_exact(f"won{name}", f"lost{name}")))
    out = out.withColumn("_tested", F.when(F.col("experiment") != baseline, F.col("p")))
    out = S.holm(out, "_tested", ["model"]).withColumn("holm", F.coalesce("holm", F.lit(1.0))).drop("_tested")
    told = O.answer_distribution(parsed, ARM)
    unparsed = told.groupBy(*ARM).agg(F.coalesce(F.max(F.when(F.col("answer") == X.UNPARSED_ANSWER, F.col("share_pct"))), F.lit(0.0)).alias("unparsed_pct"))
    return out.join(O.top_answer(told, ARM), ARM).join(unparsed, ARM)


def item_table(majority: DataFrame, split: DataFrame | Column, items: DataFrame) -> DataFrame:
    """Outcomes item by item with subset, layer and sub-category.

    ``split`` has ``item_id, subset``, or it is a condition that holds for the rows of the text-only control: what they
    say is then read off the item's group, without another pass or a join.
    """
    if isinstance(split, Column):
        told = F.max(F.when(split & F.col("item_id").isNotNull(), F.col("correct"))).over(Window.partitionBy("item_id"))
        rows = majority.withColumn("subset", F.when(told, "transcript_solvable").when(~told, "audio_dependent"))
    else:
        rows = majority.join(split, "item_id", "left")
    return rows.join(items.select("item_id", "sub_category"), "item_id", "left").select(*ARM, "item_id", "correct", "subset", F.col("category").alias("layer"), "sub_category")


def balanced_summary(majority: DataFrame, baseline: str = "baseline", silence: str = "t1") -> DataFrame:
    """Balanced accuracy, accuracy, and swap tests against the baseline and the silence control, adjusted per model."""
    out = O.balanced_accuracy(majority, ARM, "category", F.col("correct")).join(majority.groupBy(*ARM).agg(F.count("*").alias("n"), O.pct(F.col("correct")).alias("acc")), ARM)
    for name, arm in (("base", baseline), ("silence", silence)):
        test = S.paired_permutation(C.with_baseline(majority, arm), ARM).select(*ARM, (F.col("ba") - F.col("base_ba")).alias(f"d_{name}"), F.col("p").alias(f"p_{name}"))
        out = out.join(test, ARM, "left")
    tested = out.withColumn("_t", F.when(F.col("experiment") != baseline, F.col("p_base")))
    return S.holm(tested, "_t", ["model"]).drop("_t")


def answer_shares(parsed: DataFrame, truth: DataFrame, control: str = "t1") -> DataFrame:
    """Share of each answer per arm next to its share among gold answers and in the control arm.

    The shares are stored, not the answers: those are read once.
    """
    told = stored(O.answer_distribution(parsed, ARM).select(*ARM, "answer", "share_pct"))
    gold = truth.groupBy("answer").agg(F.count("*").alias("n")).withColumn("truth_pct", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) * 100).drop("n")
    beside = told.filter(F.col("experiment") == control).select("model", "answer", F.col("share_pct").alias("control_pct"))
    return told.join(gold, "answer", "left").join(beside, ["model", "answer"], "left")


def _lines(rows: DataFrame, by: list[str], *cols: str) -> DataFrame:
    """The lines of each group in an array ``lines``: a line for each run and arm of an item that the group has."""
    return rows.groupBy(*by).agg(F.collect_list(F.struct("run_idx", *cols)).alias("lines"))


def _tally(lines: Column) -> tuple[Column, Column]:
    """How many of the lines are right, and how many runs they are of."""
    return F.size(F.filter(lines, lambda x: x["correct"])).alias("right"), F.size(F.array_distinct(F.filter(F.transform(lines, lambda x: x["run_idx"]), lambda r: r.isNotNull()))).alias("seen")


def compare_models(parsed: DataFrame, a: str, b: str) -> DataFrame:
    """Shared experiments of two models over shared items: scores, delta, exact p adjusted over all, top answers, language.

    Answers are read once: an item's lines stand in one group, and what they say for the pair and for their own arm ends
    in one stored table of counts.
    """
    rows = parsed.filter(F.col("model").isin(a, b)).withColumn("correct", F.col("letter").eqNullSafe(F.col("gold")))
    items = _lines(rows, ["experiment", "item_id"], "model", "correct", "answer", "non_english")
    side = lambda model: F.filter("lines", lambda x: x["model"] == model)
    of = lambda model: [F.when(F.size(side(model)) > 0, x) for x in _tally(side(model))]
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("model", "string"), ("run_idx", parsed.schema["run_idx"].dataType), ("answer", "string"), ("non_english", "boolean"))]
    no_pair = [F.lit(None).cast("int").alias(c) for c in ("right_a", "seen_a", "right_b", "seen_b")]
    pair = F.struct(*nothing, *[x.alias(f"{c}_{side}") for side, model in (("a", a), ("b", b)) for c, x in zip(("right", "seen"), of(model), strict=True)])
    own = F.transform("lines", lambda x: F.struct(x["model"].alias("model"), x["run_idx"].alias("run_idx"), x["answer"].alias("answer"), x["non_english"].alias("non_english"), *no_pair))
    cells = items.select("experiment", F.explode(F.concat(F.array(pair), own)).alias("x")).select("experiment", "x.*")
    cube = stored(cells.groupBy(*cells.columns).agg(F.count("*").alias("count")))
    lines, count = cube.filter("model is not null"), F.col("count")
    runs = lambda model, name: F.count_distinct(F.when(F.col("model") == model, F.col("run_idx"))).alias(name)
    pairs = cube.filter("model is null").join(F.broadcast(lines.groupBy("experiment").agg(runs(a, "n_a"), runs(b, "n_b"))), "experiment").filter("seen_a = n_a and seen_b = n_b")
    x, y = 2 * F.col("right_a") > F.col("n_a"), 2 * F.col("right_b") > F.col("n_b")
    total = lambda when: F.coalesce(F.sum(F.when(when, count)), F.lit(0))
    out = pairs.groupBy("experiment").agg(F.sum(count).alias("n"), (total(x) / F.sum(count) * 100).alias("score_a"), (total(y) / F.sum(count) * 100).alias("score_b"), total(y & ~x).alias("won"), total(~y & x).alias("lost"))
    out = S.holm(out.withColumn("delta", F.col("score_b") - F.col("score_a")).withColumn("p", S.mcnemar_exact("won", "lost")), "p", [])
    told = lines.groupBy(*ARM, "answer").agg(F.sum(count).alias("n"), total(F.col("non_english")).alias("k"))
    per = told.groupBy("experiment").agg(*[f.alias(f"{name}_{side}") for side, model in (("a", a), ("b", b)) for own in [F.col("model") == model] for f, name in ((F.max(F.when(own, F.col("n"))) / F.sum(F.when(own, F.col("n"))) * 100, "top_pct"), (F.sum(F.when(own, F.col("k"))) / F.sum(F.when(own, F.col("n"))) * 100, "non_english"))])
    return out.join(per, "experiment")


def run_cubes(rows: DataFrame, split: DataFrame, baseline: str = "baseline") -> tuple[DataFrame, DataFrame]:
    """Counts of majorities by arm, category and subset, and of lines by arm, run and category: the only pass over answers.

    The first has n and right; of the items that the baseline has too (shared): right in this arm (a) and in the
    baseline (b), won and lost. As many rows as arms, categories and subsets make. An item's lines stand in one group;
    what they come to is counted before it is known how many runs an arm has.
    """
    items = _lines(rows, ["model", "item_id"], "experiment", "category", "correct").join(split.select("item_id", "subset"), "item_id", "left")
    under = lambda e: F.filter("lines", lambda x: x["experiment"].eqNullSafe(e))
    based = lambda k: F.when(F.size(under(F.lit(baseline))) > 0, _tally(under(F.lit(baseline)))[k])
    run, correct = rows.schema["run_idx"].dataType, F.lit(None).cast("boolean").alias("correct")
    last = lambda e: F.array_max(F.transform(F.filter(under(e), lambda x: x["run_idx"].isNotNull()), lambda x: F.struct(x["run_idx"].alias("run_idx"), x["category"].alias("category"))))["category"]
    arms = F.transform(F.array_distinct(F.transform("lines", lambda x: x["experiment"])), lambda e: F.struct(e.alias("experiment"), last(e).alias("category"), *_tally(under(e)), F.col("base_right"), F.col("base_seen"), F.lit(None).cast(run).alias("run_idx"), correct))
    none = [F.lit(None).cast("int").alias(c) for c in ("right", "seen", "base_right", "base_seen")]
    lines = F.transform("lines", lambda x: F.struct(x["experiment"].alias("experiment"), x["category"].alias("category"), *none, x["run_idx"].alias("run_idx"), x["correct"].alias("correct")))
    cells = items.withColumns({"base_right": based(0), "base_seen": based(1)}).select("model", "subset", F.explode(F.concat(arms, lines)).alias("x")).select("model", F.when(F.col("x.seen").isNotNull(), F.col("subset")).alias("subset"), "x.*")
    cells = stored(cells.groupBy(*cells.columns).agg(F.count("*").alias("count")))
    count, told = F.col("count"), cells.filter("seen is null")
    total = lambda when: F.coalesce(F.sum(F.when(when, count)), F.lit(0))
    runs = stored(told.groupBy(*ARM).agg(F.count_distinct("run_idx").alias("n_runs")))  # one row for each arm
    base = runs.filter(F.col("experiment") == baseline).select("model", F.col("n_runs").alias("base_runs"))
    pairs = cells.filter("seen is not null").join(F.broadcast(runs), ARM).filter("seen = n_runs").join(F.broadcast(base), "model", "left")
    pairs = pairs.withColumns({"x": 2 * F.col("right") > F.col("n_runs"), "y": F.when(F.col("base_seen") == F.col("base_runs"), 2 * F.col("base_right") > F.col("base_runs"))})
    x, y, both = F.col("x"), F.col("y"), F.col("y").isNotNull()
    cube = pairs.groupBy(*ARM, "category", "subset").agg(F.sum(count).alias("n"), total(x).alias("right"), total(both).alias("shared"), total(both & x).alias("a"), total(both & y).alias("b"), total(both & x & ~y).alias("won"), total(both & ~x & y).alias("lost"))
    return stored(cube), told.groupBy(*ARM, "run_idx", "category").agg(F.sum(count).alias("n"), total(F.col("correct")).alias("right"))


def compare_runs(rows: DataFrame, split: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per arm: accuracy and balanced accuracy with intervals, mean of runs, delta and test against the baseline, subsets.

    ``split`` has ``item_id, subset``. The exact p belongs to accuracy, ``p_ba`` (permutation) to balanced accuracy,
    which is over the categories present; ``categories`` has accuracy and n of each. Everything comes from one stored
    cube of counts, read by grouping sets, and the counts of the single runs; ``rows`` are read once.
    """
    cube, runs = run_cubes(rows, split, baseline)
    counts = ["n", "right", "shared", "a", "b", "won", "lost"]
    level = F.grouping("category") * 2 + F.grouping("subset")
    sets = cube.groupingSets([[*ARM], [*ARM, "category"], [*ARM, "subset"], [*ARM, "category", "subset"]], *ARM, "category", "subset").agg(level.alias("level"), *[F.sum(c).alias(c) for c in counts])
    own, classes, side, cell = (F.col("level") == k for k in (3, 1, 2, 0))
    classed = F.col("category").isNotNull()
    named = lambda s: F.col("subset") == s
    one = lambda c, when: F.max(F.when(when, F.col(c)))
    sides = (("transcript_solvable", "ts"), ("audio_dependent", "ad"))
    per = sets.groupBy(*ARM).agg(
        *[one(c, own).alias(c) for c in ("n", "right", "shared", "won", "lost")],
        F.array_sort(F.collect_list(F.when(classes & classed, F.struct("category", *counts)))).alias("cells"),
        F.collect_list(F.when(classes, F.struct(F.coalesce(F.nullif("category", F.lit("")), F.lit("Unknown")).alias("category"), "right", "n"))).alias("named"),
        *[F.coalesce(one("n", side & named(s)), F.lit(0)).alias(f"n_{short}") for s, short in sides],
        *[one("right", side & named(s)).alias(f"right_{short}") for s, short in sides],
        *[(F.avg(F.when(cell & classed & named(s), F.col("right") / F.col("n"))) * 100).alias(f"ba_{short}") for s, short in sides],
    )
    total = lambda xs, c: F.aggregate(xs, F.lit(0).cast("long"), lambda t, x: t + x[c])
    mean = lambda xs, f: F.try_divide(F.aggregate(F.transform(xs, f), F.lit(0.0), lambda t, x: t + x), F.size(xs)) * 100
    paired = F.filter("cells", lambda c: c["shared"] > 0)
    # Categories without a name are one.
    together = F.transform(F.array_sort(F.array_distinct(F.transform("named", lambda c: c["category"]))), lambda name: F.struct(name.alias("category"), F.filter("named", lambda c: c["category"] == name).alias("xs")))
    out = per.withColumns({
        "acc": F.col("right") / F.col("n") * 100,
        "delta": (F.col("won") - F.col("lost")) / F.nullif("shared", F.lit(0)) * 100,
        "ba": mean(F.col("cells"), lambda c: c["right"] / c["n"]),
        "delta_ba": mean(paired, lambda c: (c["a"] - c["b"]) / c["shared"]),
        "categories": F.transform(together, lambda c: F.struct(c["category"].alias("category"), (total(c["xs"], "right") / total(c["xs"], "n") * 100).alias("accuracy_pct"), total(c["xs"], "n").alias("n"))),
        **{f"acc_{short}": F.col(f"right_{short}") / F.col(f"n_{short}") * 100 for _, short in sides},
    }).withColumn("paired", paired)
    out = S.with_intervals(out, ARM).withColumn("p", S.mcnemar_exact("won", "lost"))
    recall = F.when(classed, F.col("right") / F.col("n"))
    runs = runs.groupBy(*ARM, "run_idx").agg((F.sum("right") / F.sum("n") * 100).alias("acc"), (F.avg(recall) * 100).alias("ba"))
    runs = runs.groupBy(*ARM).agg(F.avg("acc").alias("mean_accuracy_pct"), F.count("*").alias("runs"), F.avg("ba").alias("mean_ba"))
    return out.join(runs, ARM).filter("shared > 0").select(*ARM, "n", "right", "low", "high", "acc", "mean_accuracy_pct", "runs", "won", "lost", "delta", "p", "ba", "ba_low", "ba_high", "mean_ba", "delta_ba", "p_ba", "acc_ts", "acc_ad", "n_ts", "ba_ts", "n_ad", "ba_ad", "categories")


def category_pivot(compared: DataFrame, categories: list[str]) -> DataFrame:
    """The per-category accuracies of ``compare_runs`` as columns, in the order of ``categories``; null where an arm has none."""
    at = lambda c: F.get(F.filter("categories", lambda x: x["category"] == c), F.lit(0))["accuracy_pct"]
    return compared.select(*ARM, *[at(c).alias(c) for c in categories])


def compare_all_models(majority: DataFrame) -> DataFrame:
    """Every two models over the items and experiments that both have: scores, delta, exact p adjusted inside a pair.

    The models' outcomes on an item stand in one group, as many as there are models, and its pairs become counts before
    the shuffle; no join for each pair.
    """
    wide = majority.groupBy("experiment", "item_id").agg(F.array_sort(F.collect_list(F.struct("model", "correct"))).alias("all"))
    pairs = wide.select("experiment", "all", F.posexplode("all").alias("k", "a")).select("experiment", "a", F.explode(F.slice("all", F.col("k") + 2, F.size("all"))).alias("b"))
    x, y = F.col("a.correct"), F.col("b.correct")
    out = pairs.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), "experiment").agg(F.count("*").alias("n"), O.pct(x).alias("score_a"), O.pct(y).alias("score_b"), F.count_if(y & ~x).alias("won"), F.count_if(~y & x).alias("lost"))
    out = out.withColumn("delta", F.col("score_b") - F.col("score_a")).withColumn("p", S.mcnemar_exact("won", "lost"))
    return S.holm(out, "p", ["model_a", "model_b"])


def scaling_table(scores: DataFrame, dependent: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per model, over experiments all models ran: the baseline, best and worst technique, the dependent subset's baseline."""
    shared = scores.join(C.experiments_run_by_all(scores, baseline), "experiment", "left_semi")
    base = shared.filter(F.col("experiment") == baseline).select("model", F.col("acc").alias("baseline_acc"))
    low = dependent.filter(F.col("experiment") == baseline).select("model", F.col("acc_ad").alias("baseline_ad"))
    return C.best_worst(shared, baseline).join(base, "model").join(low, "model", "left")


def technique_matrix(summary: DataFrame, bound: float = 20.0) -> DataFrame:
    """Technique by (model, subset): delta clipped to the bound, and whether p is below 0.05."""
    long = summary.filter("d is not null").select("experiment", "model", F.explode(F.array(*[F.struct(F.lit(s).alias("subset"), F.col(f"d_{s}").alias("delta"), F.col(f"p_{s}").alias("p")) for s in ("ts", "ad")])).alias("x")).select("experiment", "model", "x.*")
    return long.select("experiment", "model", "subset", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("delta"))).alias("delta"), (F.col("p") < 0.05).alias("significant"))


def technique_pivot(matrix: DataFrame, cells: list[str]) -> DataFrame:
    return matrix.withColumn("cell", F.concat_ws("_", "model", "subset")).groupBy("experiment").pivot("cell", cells).agg(F.first("delta"))


def extreme_techniques(summary: DataFrame, k: int = 4) -> DataFrame:
    """Per model the ``k`` techniques that move the subsets most."""
    size = F.abs(F.coalesce("d_ts", F.lit(0.0))) + F.abs(F.coalesce("d_ad", F.lit(0.0)))
    rows = summary.filter("d is not null").withColumn("size", size)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("size"), "experiment"))).filter(F.col("rank") <= k).select("model", "experiment", "rank", "size")


def modality_ablation(summary: DataFrame, with_audio: str, without: str) -> DataFrame:
    """One arm against its variant without audio, per model and subset."""
    pick = lambda e, s: summary.filter(F.col("experiment") == e).select("model", F.col("acc_ts").alias(f"ts_{s}"), F.col("acc_ad").alias(f"ad_{s}"))
    return pick(with_audio, "with").join(pick(without, "without"), "model").withColumn("d_ts", F.col("ts_with") - F.col("ts_without")).withColumn("d_ad", F.col("ad_with") - F.col("ad_without"))


def metadata_ceiling(items: DataFrame, label: str, rules: dict[str, DataFrame]) -> DataFrame:
    """Accuracy and balanced accuracy of every rule's predictions (column ``predicted``) and the best of the latter."""
    scored = None
    for name, rows in rules.items():
        one = D.rule_scores(rows, label, "predicted").withColumn("rule", F.lit(name))
        scored = one if scored is None else scored.unionByName(one)
    return scored.withColumn("ceiling", F.max("ba_pct").over(Window.partitionBy(F.lit(1))))  # a row for each rule


def experiment_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Judge scores and F1 averages per experiment; labels as ``X.normalize_label`` gives them."""
    scores = O.judge_score_metrics(rows, by)
    t, p = X.normalize_label(F.col("truth")), X.normalize_label(F.col("predicted"))
    cells = rows.groupBy(*by, t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("real")), F.struct(F.col("p").alias("label"), F.lit(False).alias("real")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"), "n")
    zero = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    per = sides.groupBy(*by, F.col("s.label").alias("label")).agg(zero(F.col("s.real") & F.col("hit")).alias("tp"), zero(F.col("s.real")).alias("support"), zero(~F.col("s.real")).alias("given"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("given")), F.lit(0.0))
    means = per.withColumn("f1", f1).groupBy(*by).agg((F.avg("f1") * 100).alias("macro_f1_pct"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support") * 100).alias("weighted_f1_pct"))
    return scores.join(means, by)


def melted(table: DataFrame, by: list[str]) -> DataFrame:
    return table.unpivot(by, [c for c in table.columns if c not in by], "metric", "value")
