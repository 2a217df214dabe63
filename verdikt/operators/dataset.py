"""Diagnostics of the dataset itself: rules without audio, duplicates of texts, held-out and stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import exact_quantile


def seeded(seed: int | str, *parts: Column) -> Column:
    """A fixed random order: md5 of the seed and the row's key, the same on any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def loo_cell_majority(df: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Leave-one-out majority label of each row's cell; ties go to the label seen first once the row is gone.

    Counts per (cell, label) are joined back, never rows with rows: a row's own label loses one count, and its first
    place if the row held it. A cell of one row falls back on the global majority.
    """
    total = df.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    overall = total.agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("_global"))
    w = Window.partitionBy(*keys, label).orderBy(order)
    # The bound on the row number is applied before the shuffle: two rows of each task and group move.
    two = df.select(*keys, label, order).withColumn("_k", F.row_number().over(w)).filter("_k <= 2").groupBy(*keys, label).agg(F.min(order).alias("first"), F.max(F.when(F.col("_k") == 2, F.col(order))).alias("second"))
    seen = df.groupBy(*keys, label).agg(F.count("*").alias("n")).join(two, [*keys, label])
    cells = seen.groupBy(*keys).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "first", "second")).alias("_cell"))
    own = df.join(cells, keys).crossJoin(F.broadcast(overall))  # one row
    left = F.transform("_cell", lambda c: F.struct((-(c["n"] - F.when(c["l"] == F.col(label), 1).otherwise(0))).alias("n"), F.when((c["l"] == F.col(label)) & (c["first"] == F.col(order)), c["second"]).otherwise(c["first"]).alias("first"), c["l"].alias("l")))
    best = F.get(F.array_sort(F.filter(left, lambda c: c["n"] < 0)), F.lit(0))
    return own.withColumn("predicted", F.coalesce(best["l"], F.col("_global"))).drop("_cell", "_global")


def rule_scores(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy and balanced accuracy (over the classes present) of one rule's predictions."""
    hit = (F.col(predicted) == F.col(label)).cast("double")
    per = df.groupBy(label).agg(F.avg(hit).alias("recall"), F.count("*").alias("n"))
    return per.agg((F.sum(F.col("recall") * F.col("n")) / F.sum("n") * 100).alias("accuracy_pct"), (F.avg("recall") * 100).alias("ba_pct"))


def degenerate_text(df: DataFrame, text: str, share: float = 0.5, least: int = 10) -> DataFrame:
    """Share of the most common text and whether the table is rejected for it."""
    n = df.groupBy(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("k")).agg(F.count("*").alias("n"))
    out = n.agg(F.sum("n").alias("entries"), (F.max("n") / F.sum("n")).alias("top_share"))
    return out.withColumn("rejected", (F.col("entries") >= least) & (F.col("top_share") > share))


def label_counts(everything: DataFrame, evaluated: DataFrame, label: str) -> DataFrame:
    a = everything.groupBy(label).agg(F.count("*").alias("n_all"))
    b = evaluated.groupBy(label).agg(F.count("*").alias("n_eval"))
    return a.join(b, label, "full_outer").select(label, F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("n_eval", F.lit(0)).alias("n_eval"))


def duration_summary(clips: DataFrame, duration: Column, rate: Column) -> DataFrame:
    """Least, median and greatest duration, and the distinct rates (few). The median is exact, by histogram refinement."""
    median = exact_quantile(clips, duration, 0.5)
    return clips.agg(F.min(duration).alias("min_s"), F.lit(median).cast("double").alias("median_s"), F.max(duration).alias("max_s"), F.array_sort(F.collect_set(rate)).alias("rates"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """``item_id, dups``: how many others are in an item's group. ``groups``: item_id, group."""
    sizes = groups.groupBy("group").agg((F.count("*") - 1).alias("dups")).filter("dups > 0")
    return groups.join(sizes, "group").select("item_id", "dups")


def demo_split(items: DataFrame, duplicates: DataFrame, label: str, seed: int = 2017, groups: DataFrame | None = None) -> DataFrame:
    """One demonstration per class, fewest near-duplicates first, then in seeded order; their duplicates are held out.

    ``duplicates``: ``left_id, right_id`` in both directions; or, where duplicates are groups, ``item_id, dups`` with
    ``groups`` (item_id, group), so that no pair of a large group is ever made. Returns ``item_id, role`` (demonstration
    or held_out). Use ``check_split`` to make a misfiring detector fail.
    """
    n = duplicates if groups is not None else duplicates.groupBy(F.col("left_id").alias("item_id")).agg(F.count("*").alias("dups"))
    rows = items.select("item_id", label).join(n, "item_id", "left")
    best = rows.groupBy(label).agg(F.min(F.struct(F.coalesce("dups", F.lit(0)).alias("d"), seeded(seed, F.col("item_id")).alias("h"), F.col("item_id"))).alias("s"))
    demos = F.broadcast(best.select(F.col("s.item_id").alias("item_id")))  # a row for each class
    if groups is not None:
        held = groups.join(F.broadcast(groups.join(demos, "item_id", "left_semi").select("group").distinct()), "group", "left_semi").select("item_id")
    else:
        held = duplicates.join(demos, F.col("left_id") == F.col("item_id")).select(F.col("right_id").alias("item_id")).distinct()
    held = held.join(demos, "item_id", "left_anti")
    return best.select(F.col("s.item_id").alias("item_id"), F.lit("demonstration").alias("role")).unionByName(held.withColumn("role", F.lit("held_out")))


def check_split(split: DataFrame, classes: int, most_per_demo: int = 5) -> DataFrame:
    n = {r["role"]: r["n"] for r in split.groupBy("role").agg(F.count("*").alias("n")).collect()}
    if n.get("demonstration", 0) < classes:
        raise ValueError("a class has no item for a demonstration")
    if n.get("held_out", 0) > most_per_demo * n["demonstration"]:
        raise ValueError("too many near-duplicates are held out: the detector misfires")
    return split


def proportional_sample(df: DataFrame, label: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """About ``n`` rows in the classes' proportions: rounded targets, what is missing from the largest class, capped by size."""
    sizes = df.groupBy(label).agg(F.count("*").alias("c"))
    everything = Window.partitionBy(F.lit(1))  # over one row per class
    sizes = sizes.withColumn("target", F.bround(F.col("c") / F.sum("c").over(everything) * n).cast("long"))
    sizes = sizes.withColumn("largest", F.row_number().over(everything.orderBy(F.desc("c"), label)) == 1)
    sizes = sizes.withColumn("target", F.least("c", F.col("target") + F.when(F.col("largest"), n - F.sum("target").over(everything)).otherwise(0)))
    # No class gives more than ``n`` rows: the bound lets each task drop the rest before the shuffle.
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(seeded(seed, F.col(key)), key))).filter(F.col("_r") <= n)
    return ranked.join(F.broadcast(sizes.select(label, "target")), label).filter("_r <= target").drop("_r", "target")


def contingency(df: DataFrame, column: str, label: str) -> DataFrame:
    """Counts of every value with every label, zeros included (values times labels cells)."""
    n = df.groupBy(column, label).agg(F.count("*").alias("n"))
    grid = n.select(column).distinct().crossJoin(n.select(label).distinct())
    return grid.join(n, [column, label], "left").select(column, label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
