"""From items and evidence to requests: selection, evidence, shuffled variants, demonstrations, leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .dataset import seeded

MOST_CLIPS, TOKENS_PER_SECOND, CHARS_PER_TOKEN = 5, 12.5, 4


def join_evidence(items: DataFrame, evidence: DataFrame, column: str, placeholder: str = X.NO_FEATURES) -> DataFrame:
    """Items with their evidence or the placeholder, and ``missing`` where there was none."""
    joined = items.join(evidence.select("item_id", F.col(column).alias("_e")), "item_id", "left")
    return joined.withColumn(column, F.coalesce("_e", F.lit(placeholder))).withColumn("missing", F.col("_e").isNull()).drop("_e")


def select_eval_rows(items: DataFrame, wanted: DataFrame | None = None, excluded: DataFrame | None = None, order: Column | None = None, n: int | None = None, seed: int | None = None) -> DataFrame:
    """Wanted ids kept and excluded ones gone before anything is cut to ``n``, in source order or in seeded order."""
    if wanted is not None:
        items = items.join(wanted.select("item_id"), "item_id", "left_semi")
    if excluded is not None:
        items = items.join(excluded.select("item_id"), "item_id", "left_anti")
    if n is None:
        return items
    return items.orderBy(seeded(seed, F.col("item_id")) if seed is not None else order, "item_id").limit(n)


def missing_ids(items: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("item_id").join(items, "item_id", "left_anti")


def check_disjoint(evaluated: DataFrame, shots: DataFrame, mapping: DataFrame) -> DataFrame:
    """Violations: evaluated items used as demonstrations, items that retrieve themselves or another evaluated item."""
    overlap = evaluated.select("item_id").join(shots.select("item_id"), "item_id", "left_semi").select("item_id", F.lit("overlap").alias("problem"))
    own = mapping.filter("item_id = neighbor_id").select("item_id", F.lit("retrieves itself").alias("problem"))
    other = mapping.filter("item_id <> neighbor_id").join(evaluated.select(F.col("item_id").alias("neighbor_id")), "neighbor_id", "left_semi").select("item_id", F.lit("retrieves evaluated").alias("problem"))
    return overlap.union(own).union(other).distinct()


def attach_fixed_shots(requests: DataFrame, shots: DataFrame, k: int = 3) -> DataFrame:
    """The same first ``k`` demonstrations on every request (an array of k structs, whatever the data's size)."""
    rows = shots.orderBy("shot_id").limit(k).agg(F.array_sort(F.collect_list(F.struct("shot_id", "shot_text"))).alias("shots"))
    return requests.crossJoin(F.broadcast(rows))  # one row


def attach_retrieved_shots(requests: DataFrame, mapping: DataFrame, pool: DataFrame, cap: int = 4) -> DataFrame:
    """Each item's demonstrations in retrieval order, ids outside the pool dropped, at most ``cap``; none gives an empty array."""
    found = mapping.join(pool.select(F.col("shot_id").alias("neighbor_id"), "shot_text"), "neighbor_id")
    lists = found.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "shot_text"))), 1, cap).alias("shots"))
    out = requests.join(lists, "item_id", "left")
    return out.withColumn("shots", F.coalesce("shots", F.array().cast(lists.schema["shots"].dataType)))


def shuffle_variants(items: DataFrame, n: int, seed: int = 2024) -> DataFrame:
    """``n`` orders of each item's options; variant 0 is the original. Adds variant_idx, permutation, choices and gold remapped.

    ``permutation[shown] = original``. The order comes from md5 of seed, item, variant and option, so it doesn't depend
    on partitioning. Only ids and options are exploded; prompts are rendered afterwards.
    """
    rows = items.withColumn("variant_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keyed = F.transform("choices", lambda c, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("item_id").cast("string"), F.col("variant_idx").cast("string"), i.cast("string"))).alias("k"), i.alias("i")))
    mixed = F.transform(F.array_sort(keyed), lambda s: s["i"])
    plain = F.transform("choices", lambda c, i: i)
    rows = rows.withColumn("permutation", F.when(F.col("variant_idx") == 0, plain).otherwise(mixed))
    shown = F.array_position("permutation", X.index_for_letter(F.col("gold"))) - 1
    return rows.withColumn("gold", X.letter_for_index(shown)).withColumn("choices", F.transform("permutation", lambda i: F.get("choices", i)))


def final_turn(conversations: DataFrame) -> DataFrame:
    return conversations.filter("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("final_turn"))


def accumulate_turns(conversations: DataFrame) -> DataFrame:
    """User and assistant turns paired in order as one transcript per conversation."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = conversations.filter("role in ('user', 'assistant')").withColumn("i", F.row_number().over(w))
    line = F.when(F.col("role") == "user", F.concat(F.lit("Turn "), F.col("i").cast("string"), F.lit(" - User: "), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("Assistant: "), F.coalesce("text", F.lit(""))))
    rows = rows.select("conv_id", F.struct("i", F.when(F.col("role") == "user", 0).otherwise(1).alias("o"), line.alias("line")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("transcript"))


def history_messages(conversations: DataFrame) -> DataFrame:
    """Messages with reasoning removed from all assistant turns but the conversation's last message."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    shown = F.when((F.col("role") == "assistant") & (F.col("turn") < last), X.strip_thinking(F.col("text"))).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", shown.alias("text"))


def prompt_budget(parts: DataFrame, by: list[str], seconds: Column, chars: Column, new_tokens: int, window: int) -> DataFrame:
    """Clips, seconds and estimated tokens per request, and whether they pass the limits."""
    out = parts.groupBy(*by).agg(F.count(seconds).alias("clips"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("audio_s"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars"))
    out = out.withColumn("tokens", F.col("audio_s") * TOKENS_PER_SECOND + F.col("chars") / CHARS_PER_TOKEN + new_tokens)
    return out.withColumn("too_many_clips", F.col("clips") > MOST_CLIPS).withColumn("too_long", F.col("tokens") > window)


def clean_transcripts(asr: DataFrame, references: DataFrame, ids: list[DataFrame], marker: str = X.NO_TRANSCRIPT) -> DataFrame:
    """Review table of the wanted ids: reference and trimmed transcript, the marker where it is empty or missing."""
    wanted = ids[0].select("item_id")
    for more in ids[1:]:
        wanted = wanted.union(more.select("item_id"))
    out = wanted.distinct().join(references.select("item_id", "reference"), "item_id", "left").join(asr.select("item_id", "transcript"), "item_id", "left")
    text = F.trim(F.coalesce("transcript", F.lit("")))
    return out.select("item_id", "reference", F.when(text == "", marker).otherwise(text).alias("transcript"))
