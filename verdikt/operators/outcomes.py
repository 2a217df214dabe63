"""From answers to outcomes, votes and metrics. Plain grouping; every shuffle carries partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import stored

RUN = ["model", "experiment", "run_idx"]
ARM = ["model", "experiment"]


def pct(condition: Column) -> Column:
    return F.avg(condition.cast("double")) * 100


def parsed(responses: DataFrame) -> DataFrame:
    """Responses with ``letter``, ``answer`` (text of the choice) and ``non_english``; the text goes no further."""
    return X.with_letter(responses).withColumn("answer", X.answer_text(F.col("letter"), F.col("choices"))).withColumn("non_english", X.is_non_english(F.col("text"))).drop("text")


def outcomes(parsed_rows: DataFrame) -> DataFrame:
    return parsed_rows.withColumn("correct", F.col("letter").eqNullSafe(F.col("gold"))).drop("letter", "gold", "answer", "choices", "non_english")


def last_write_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the lines of one key the one with the largest ``order``; a map-side combined maximum, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s"))
    return best.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def majority_correct(rows: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Strict majority over all runs of an arm; items that miss in any run are dropped. ``runs``: arm, n_runs if known."""
    runs = runs if runs is not None else rows.groupBy(*ARM).agg(F.count_distinct("run_idx").alias("n_runs"))
    got = rows.groupBy(*ARM, "item_id").agg(F.count_if("correct").alias("right"), F.count_distinct("run_idx").alias("seen"), F.max_by("category", "run_idx").alias("category"))
    # One row for each arm.
    return got.join(F.broadcast(runs), ARM).filter("seen = n_runs").select(*ARM, "item_id", (2 * F.col("right") > F.col("n_runs")).alias("correct"), "n_runs", "category")


def choice_metrics(rows: DataFrame) -> DataFrame:
    """Per run: parser and judge accuracy, unparsed, parser-judge agreement, non-English, all in percent. Needs ``judged``."""
    letter = F.coalesce("letter", F.lit(X.UNPARSED_CHOICE))
    return rows.groupBy(*RUN).agg(
        pct(F.col("letter").eqNullSafe(F.col("gold"))).alias("accuracy_pct"),
        pct(F.trim("judged") == F.col("gold")).alias("judge_accuracy_pct"),
        pct(F.col("letter").isNull()).alias("unparsed_pct"),
        pct(letter == F.trim("judged")).alias("agreement_pct"),
        pct(F.col("non_english")).alias("non_english_pct"),
    )


def category_report(rows: DataFrame, by: list[str], category: str = "category", least: int = 1) -> DataFrame:
    name = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("Unknown")).alias("category")
    return rows.groupBy(*by, name).agg(pct(F.col("correct")).alias("accuracy_pct"), F.count("*").alias("n")).filter(F.col("n") >= least)


def judge_score_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0)))
    return rows.groupBy(*by).agg((mean("acoustic") * 10).alias("acoustic_pct"), (mean("diagnostic") * 10).alias("diagnostic_pct"), (mean("hallucination") * 100).alias("hallucination_pct"), F.count("*").alias("n"))


def balanced_accuracy(rows: DataFrame, by: list[str], label: str, correct: Column, include: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes present (and included), in percent. Two levels of grouping, the second tiny."""
    rows = rows.filter(F.col(label).isin(include)) if include else rows
    recall = rows.groupBy(*by, label).agg(F.avg(correct.cast("double")).alias("recall"))
    return recall.groupBy(*by).agg((F.avg("recall") * 100).alias("balanced_accuracy"), F.count("*").alias("classes"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long confusion matrix over the union of labels, with the zero cells.

    The cells that occur are stored: rows are read once, and what made them stays out of the joins below.
    """
    seen = stored(rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n")))
    names = seen.select(F.explode(F.array("truth", "predicted")).alias("truth")).distinct()
    # Labels by labels: a confusion matrix has that many cells.
    grid = names.crossJoin(names.withColumnRenamed("truth", "predicted"))
    return grid.join(seen, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label, zero where undefined; all from one grouped count."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col("p").alias("label"), F.lit(False).alias("is_truth")))).alias("s"), (F.col("t") == F.col("p")).alias("hit"), "n").select("s.*", "hit", "n")
    per = sides.groupBy("label").agg(
        F.coalesce(F.sum(F.when(F.col("is_truth") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("is_truth"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("is_truth"), F.col("n"))), F.lit(0)).alias("given"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return per.select("label", ratio(F.col("tp"), F.col("given")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("given") + F.col("support")).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 of a classification report."""
    total = F.sum("support")
    return report.agg(F.try_divide(F.sum(F.col("recall") * F.col("support")), total).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"))


def collapse_metrics(rows: DataFrame, by: list[str], truth: str, predicted: Column, primary: list[str]) -> DataFrame:
    """Majority-class baseline, chance, share of the top prediction and unparsed share per group, in percent."""
    rows = rows.withColumn("_p", F.coalesce(predicted, F.lit(X.UNPARSED_CHOICE)))
    cells = rows.groupBy(*by, truth, "_p").agg(F.count("*").alias("n"))
    truths = cells.groupBy(*by, truth).agg(F.sum("n").alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n") * 100).alias("majority_baseline_pct"), F.try_divide(F.lit(100.0), F.count_if(F.col(truth).isin(primary))).alias("chance_pct"))
    told = cells.groupBy(*by, "_p").agg(F.sum("n").alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n") * 100).alias("collapse_index_pct"), (F.coalesce(F.max(F.when(F.col("_p") == X.UNPARSED_CHOICE, F.col("n"))), F.lit(0)) / F.sum("n") * 100).alias("unparsed_pct"))
    return truths.join(told, by)


def stability(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Spread of each metric over repeated runs: population variance, exact percentiles; CV is 0 where the mean is 0."""
    long = metrics.unpivot(by, names, "metric", "value").filter("value is not null")
    at = lambda p: F.percentile("value", F.lit(p))
    out = long.groupBy(*by, "metric").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"), at(0.5).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), at(0.25).alias("p25"), at(0.75).alias("p75"), F.var_pop("value").alias("variance"), F.stddev_pop("value").alias("std_dev"))
    return out.withColumn("cv_pct", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std_dev") / F.col("mean") * 100))


def answer_distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count and share of each answer text over all lines; a hot answer is added up before the shuffle."""
    n = rows.groupBy(*by, "answer").agg(F.count("*").alias("n"))
    return n.withColumn("share_pct", F.col("n") / F.sum("n").over(Window.partitionBy(*by)) * 100)


def top_answer(distribution: DataFrame, by: list[str]) -> DataFrame:
    """Most common answer and its share; ties go to the smaller text (lines have no order of their own here)."""
    best = distribution.groupBy(*by).agg(F.min_by(F.struct("answer", "share_pct"), F.struct(-F.col("n"), F.col("answer"))).alias("s"))
    return best.select(*by, F.col("s.answer").alias("top_answer"), F.col("s.share_pct").alias("top_answer_pct"))


def collapsed_arms(distribution: DataFrame, by: list[str], least_pct: float = 90.0) -> DataFrame:
    return top_answer(distribution, by).filter(F.col("top_answer_pct") >= least_pct)


def mixed_models(runs: DataFrame, folder: str, model: str) -> DataFrame:
    """Folders that hold runs of more than one model."""
    return runs.groupBy(folder).agg(F.array_sort(F.collect_set(model)).alias("models")).filter(F.size("models") > 1)


def vote(rows: DataFrame, item: str, order: str, letter: Column) -> DataFrame:
    """Most frequent letter of an item's rows, ties to the one named first; '' and no votes where none parsed."""
    cast = rows.select(F.col(item), F.col(order).alias("_o"), letter.alias("_l"))
    counted = cast.groupBy(item, "_l").agg(F.count("*").alias("n"), F.min("_o").alias("first"), F.collect_list("_o").alias("_os"))
    per = counted.groupBy(item).agg(
        F.max_by("_l", F.when(F.col("_l").isNotNull(), F.struct("n", (-F.col("first")).alias("f")))).alias("w"),
        F.flatten(F.collect_list(F.when(F.col("_l").isNotNull(), F.transform("_os", lambda o: F.struct(o.alias("o"), F.col("_l").alias("l")))))).alias("all"),
    )
    return per.select(item, F.coalesce("w", F.lit("")).alias("winner"), F.transform(F.array_sort("all"), lambda s: s["l"]).alias("votes"))


def unpermuted(letter: Column, permutation: Column) -> Column:
    """A letter of a shuffled order of options as a letter of the original order."""
    return F.when(permutation.isNull(), letter).otherwise(X.letter_for_index(F.get(permutation, X.index_for_letter(letter))))


def contrastive_scores(logprobs: DataFrame, alphas: DataFrame, digits: int = 12) -> DataFrame:
    """Per item and alpha: score of each letter (real minus alpha times the references' mean) and the best, ties to the first.

    Scores are rounded to ``digits``, so that sums in another order don't break ties.
    """
    real = F.avg(F.when(F.col("signal") == "real", F.col("logprob")))
    base = F.avg(F.when(F.col("signal") != "real", F.col("logprob")))
    per = logprobs.groupBy("item_id", "letter").agg(real.alias("real"), base.alias("base"))
    scored = per.crossJoin(F.broadcast(alphas)).withColumn("score", F.round(F.col("real") - F.col("alpha") * F.col("base"), digits))
    entries = F.array_sort(F.collect_list(F.struct("letter", "score")))  # an item's letters
    return scored.groupBy("item_id", "alpha").agg(F.map_from_entries(entries).alias("choice_scores"), F.min_by("letter", F.struct(-F.col("score"), F.col("letter"))).alias("best"))


def mean_of_runs(rows: DataFrame, by: list[str] = ARM) -> DataFrame:
    runs = rows.groupBy(*by, "run_idx").agg(pct(F.col("correct")).alias("acc"))
    return runs.groupBy(*by).agg(F.avg("acc").alias("mean_accuracy_pct"), F.count("*").alias("runs"))


def chance_level(items: DataFrame, by: str, size: Column) -> DataFrame:
    """Mean of one over the number of options, overall (null group) and per group."""
    return items.rollup(by).agg((F.avg(F.lit(1.0) / size) * 100).alias("chance_pct"), F.count("*").alias("n"))


def run_agreement(rows: DataFrame, by: list[str] = ARM) -> DataFrame:
    """Share of items that all runs answer alike; with a subset among ``by``, inside each."""
    per = rows.groupBy(*by, "item_id").agg((F.count_distinct(F.coalesce("letter", F.lit(X.UNPARSED_CHOICE))) == 1).alias("same"))
    return per.groupBy(*by).agg(pct(F.col("same")).alias("agreement_pct"), F.count("*").alias("items"))


def letter_bias(rows: DataFrame, by: list[str] = ARM) -> DataFrame:
    """How often each letter is predicted and how often it is gold."""
    both = rows.select(*by, F.explode(F.array(F.struct(F.lit("p").alias("side"), F.coalesce("letter", F.lit(X.UNPARSED_CHOICE)).alias("name")), F.struct(F.lit("g").alias("side"), F.col("gold").alias("name")))).alias("s"))
    return both.groupBy(*by, F.col("s.name").alias("letter")).agg(F.count_if(F.col("s.side") == "p").alias("predicted"), F.count_if(F.col("s.side") == "g").alias("gold"))


def language_examples(rows: DataFrame, by: list[str], text: str, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` switches (written in CJK) and quotes (CJK inside English) of each group, excerpts of 200 characters."""
    told = lambda t: F.struct(F.when(X.is_non_english(t), "switch").when(X.contains_cjk(t), "quote").alias("kind"), F.regexp_replace(F.substring(t, 1, 200), "\n", " ").alias("excerpt"))
    found = rows.withColumn("_s", F.get(F.transform(F.array(text), told), F.lit(0))).select(*by, *order, "_s.*").filter("kind is not null")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.select(*by, "kind", "rank", *order, "excerpt")


def score_histogram(rows: DataFrame, score: str, bins: int = 10, high: float = 10.0, sides: dict[str, Column] | None = None) -> DataFrame:
    """Counts of scores in equal bins from 0, the last one closed, empty bins included; ``sides``: counts of rows that meet a condition instead."""
    spark = rows.sparkSession
    at = F.least(F.width_bucket(F.col(score), F.lit(0.0), F.lit(high), F.lit(bins)), F.lit(bins)).cast("long")
    counts = {"n": F.count("*")} if sides is None else {c: F.count_if(when) for c, when in sides.items()}
    n = rows.filter(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(*[x.alias(c) for c, x in counts.items()])
    return spark.range(1, bins + 1).withColumnRenamed("id", "bin").join(n, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
