"""Paired comparisons between arms, subsets, and set operations over items and experiments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outcomes import ARM, pct


def with_baseline(majority: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Each majority row next to the baseline's outcome on the same item of the same model (null if it has none).

    No join: the baseline is read off the item's group, which has one row for each experiment.
    """
    rest = F.collect_list(F.struct("experiment", "correct", "category"))
    base = F.max(F.when(F.col("experiment") == baseline, F.col("correct")))
    return majority.groupBy("model", "item_id").agg(rest.alias("rows"), base.alias("base")).select("model", "item_id", "base", F.explode("rows").alias("r")).select("model", "item_id", "base", "r.*")


def won_lost(paired: DataFrame, by: list[str], after: str = "correct", before: str = "base") -> DataFrame:
    """Items gained, lost and shared per group."""
    a, b = F.col(after), F.col(before)
    shared = paired.filter(a.isNotNull() & b.isNotNull())
    return shared.groupBy(*by).agg(F.count_if(a & ~b).alias("won"), F.count_if(~a & b).alias("lost"), F.count("*").alias("n"))


def paired_outcomes(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Won (b right, a wrong), lost and n over the items that both sides have; ``by`` is common to both."""
    joined = a.select(*by, "item_id", F.col("correct").alias("base")).join(b.select(*by, "item_id", "correct"), [*by, "item_id"])
    return won_lost(joined, by)


def match_experiments(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every experiment of two result sets and whether A, B or both ran it."""
    left = a.select("experiment").distinct().withColumn("in_a", F.lit(True))
    right = b.select("experiment").distinct().withColumn("in_b", F.lit(True))
    return left.join(right, "experiment", "full_outer").select("experiment", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b").alias("found_in"))


def require_shared(matched: DataFrame) -> DataFrame:
    if matched.filter("found_in = 'both'").isEmpty():
        raise ValueError("no experiment has a finished run on both sides")
    return matched


def unsplit_items(majority: DataFrame, split: DataFrame) -> DataFrame:
    return majority.select("item_id").distinct().join(split, "item_id", "left_anti")


def subset_split(control: DataFrame) -> DataFrame:
    """Items the text-only control gets right are solvable from the transcript, the others need the audio."""
    return control.select("item_id", F.when(F.col("correct"), "transcript_solvable").otherwise("audio_dependent").alias("subset"))


def subset_scores(majority: DataFrame, split: DataFrame) -> DataFrame:
    """Accuracy overall and in both subsets, one pass."""
    rows = majority.join(split, "item_id", "left")
    of = lambda s: F.avg(F.when(F.col("subset") == s, F.col("correct").cast("double"))) * 100
    return rows.groupBy(*ARM).agg(F.count("*").alias("n"), pct(F.col("correct")).alias("acc"), of("transcript_solvable").alias("acc_ts"), of("audio_dependent").alias("acc_ad"))


def fusion_bound(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both, one or neither right over shared items, and how far a perfect choice between the two would get."""
    j = a.select("item_id", F.col("correct").alias("x")).join(b.select("item_id", F.col("correct").alias("y")), "item_id")
    x, y = F.col("x"), F.col("y")
    return j.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), pct(x | y).alias("either_pct"))


def shared_items(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("item_id").intersect(b.select("item_id"))


def items_in_all_runs(rows: DataFrame) -> DataFrame:
    """Items every (model, experiment, run) has."""
    n = rows.select(*ARM, "run_idx").distinct().agg(F.count("*").alias("all"))
    seen = rows.select(*ARM, "run_idx", "item_id").distinct().groupBy("item_id").agg(F.count("*").alias("seen"))
    return seen.crossJoin(F.broadcast(n)).filter(F.col("seen") == F.col("all")).select("item_id")  # n is one row


def experiments_run_by_all(arms: DataFrame, baseline: str | None = "baseline") -> DataFrame:
    """Experiments that every model ran. Raises if ``baseline`` (None: no matter) isn't among them."""
    arms = arms.select("model", "experiment").distinct()
    n = arms.select("model").distinct().agg(F.count("*").alias("models"))
    out = arms.groupBy("experiment").agg(F.count("*").alias("seen")).crossJoin(F.broadcast(n)).filter("seen = models").select("experiment")  # n is one row
    if baseline is not None and out.filter(F.col("experiment") == baseline).isEmpty():
        raise ValueError(f"not every model has run {baseline}")
    return out


def best_worst(scores: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Best and worst technique per model, and their distance; ties go to the first name; the baseline is none."""
    rows = scores.filter(F.col("experiment") != baseline)
    first = lambda s: F.min_by("experiment", F.struct(s, F.col("experiment")))
    return rows.groupBy("model").agg(first(-F.col("acc")).alias("best"), F.max("acc").alias("best_acc"), first(F.col("acc")).alias("worst"), F.min("acc").alias("worst_acc"), (F.max("acc") - F.min("acc")).alias("range"))


def union_tables(*tables: DataFrame) -> DataFrame:
    """All rows over the union of columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def deltas(scores: DataFrame, columns: list[str], baseline: str = "baseline") -> DataFrame:
    """Each arm's scores minus its model's baseline's."""
    base = scores.filter(F.col("experiment") == baseline).select("model", *[F.col(c).alias(f"base_{c}") for c in columns])
    return scores.join(base, "model", "left").select(*scores.columns, *[(F.col(c) - F.col(f"base_{c}")).alias(f"d_{c.removeprefix('acc_')}") for c in columns])


def holds(condition: Column, rows: DataFrame) -> bool:
    return rows.filter(~condition).isEmpty()
