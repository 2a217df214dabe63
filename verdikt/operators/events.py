"""Timed events: words and speakers, runs of flags, breathing cycles.

Scans along a clip's time go in two phases, so one long clip is worked on by many tasks: rows are dealt to chunks of
time, each chunk is scanned on its own, and a second, small pass over what chunks leave at their edges joins them up.
Intervals
are joined in buckets whose width is a power of two that follows each interval's own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.store import stored

#: Width of the narrowest bucket of interval joins: 2 to this power, in seconds.
FINEST = -10
MIN_PAUSE_S, TONE_GAP_HZ = 0.25, 100.0
#: Frames in one chunk of a moving average.
CHUNK_FRAMES = 4096


def chunked(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` with ``_chunk``: ranges of (``by``, ``order``), so that chunks of a clip follow one another in time.

    As many chunks as the shuffle has partitions, of about equal size whatever a clip holds; rows of equal time share one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *by, order).withColumn("_chunk", F.spark_partition_id()))


def interval_pairs(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of both sides with equal ``by`` whose closed spans (start, end) touch, each pair once.

    A span's level is the power of two that is at least its length. Two spans meet at the higher of their levels, in
    buckets of that width, of which neither touches more than two: a few very long spans aren't cut into many pieces, and
    many short ones don't meet in wide buckets. Levels that the other side hasn't are left out. Both sides of the join
    are plain shuffles, so Spark can split a bucket that holds too many rows. Rows without a span (null, NaN or an end
    before the start) meet nothing. Apart from ``by`` the sides must have no column in common.
    """
    length = lambda span: F.col(span[1]) - F.col(span[0])
    level = lambda span: F.greatest(F.ceil(F.log2(F.greatest(length(span), F.lit(2.0**FINEST)))), F.lit(FINEST)).cast("int")
    finite = lambda span: (F.abs(span[0]) < float("inf")) & (F.abs(span[1]) < float("inf")) & (length(span) >= 0)
    left, right = left.filter(finite(left_span)).withColumn("_lu", level(left_span)), right.filter(finite(right_span)).withColumn("_lv", level(right_span))
    there = [sorted(r[0] for r in df.select(c).distinct().collect()) for df, c in ((left, "_lu"), (right, "_lv"))]  # powers of two: some tens at most

    def dealt(df: DataFrame, span: tuple[str, str], own: str, others: list[int]) -> DataFrame:
        higher = F.filter(F.array(*[F.lit(k) for k in others]).cast("array<int>"), lambda k: k > F.col(own))
        native = F.when(F.col(own) >= min(others, default=1 << 20), F.array(own)).otherwise(F.array().cast("array<int>"))
        rows = df.withColumn("_level", F.explode(F.concat(higher, native)))
        at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
        return rows.withColumn("_b", F.explode(F.sequence(at(span[0]), at(span[1]))))

    pairs = dealt(left, left_span, "_lu", there[1]).join(dealt(right, right_span, "_lv", there[0]), [*by, "_level", "_b"])
    begin, end = F.greatest(left_span[0], right_span[0]), F.least(left_span[1], right_span[1])
    once = (F.greatest("_lu", "_lv") == F.col("_level")) & (F.col("_b") == F.floor(begin / F.pow(F.lit(2.0), F.col("_level"))))
    return pairs.filter(once & (begin <= end)).drop("_level", "_b", "_lu", "_lv")


def assign_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Each word's speaker: the turn it overlaps most (the first of equals), else the nearest turn's, else SPK1.

    ``words``: item_id, word_idx, start_s, end_s; ``turns``: item_id, turn_idx, start_s, end_s, speaker. Words without overlap are sorted among the middles of their clip's turns and see
    only the nearest on either side: words are never joined with all turns.
    """
    t = turns.select("item_id", F.col("turn_idx").alias("t"), F.col("start_s").alias("ts"), F.col("end_s").alias("te"), "speaker")
    near = interval_pairs(words, t, ["item_id"], ("start_s", "end_s"), ("ts", "te"))
    overlap = F.least("end_s", "te") - F.greatest("start_s", "ts")
    best = near.withColumn("o", overlap).filter("o > 0").groupBy("item_id", "word_idx").agg(F.min_by("speaker", F.struct((-F.col("o")).alias("o"), F.col("t"))).alias("by_overlap"))
    out = words.join(best, ["item_id", "word_idx"], "left")
    middle = lambda a, b: ((F.col(a) + F.col(b)) / 2).alias("mid")
    marks = t.groupBy("item_id", middle("ts", "te")).agg(F.min(F.struct("t", "speaker")).alias("turn"))
    both = chunked(out.filter("by_overlap is null").select("item_id", middle("start_s", "end_s"), "word_idx").unionByName(marks, allowMissingColumns=True), ["item_id"], "mid")
    mark = F.when(F.col("turn").isNotNull(), F.struct("mid", "turn"))
    # Inside a chunk, then what the chunks before and behind it have nearest.
    along = Window.partitionBy("_chunk", "item_id")
    sides = [F.last(mark, ignorenulls=True).over(along.orderBy(o).rangeBetween(Window.unboundedPreceding, 0)) for o in (F.asc("mid"), F.desc("mid"))]
    edges = both.filter("turn is not null").groupBy("_chunk", "item_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    edges = both.select("_chunk", "item_id").distinct().join(edges, ["_chunk", "item_id"], "left")
    chunks = Window.partitionBy("item_id").orderBy("_chunk")
    edges = edges.select("_chunk", "item_id", F.last("high", ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("low", ignorenulls=True).over(chunks.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
    both = both.withColumns({"_a": sides[0], "_z": sides[1]}).filter("word_idx is not null").join(edges.withColumnRenamed("item_id", "_item"), (F.col("_item").eqNullSafe(F.col("item_id"))) & (edges["_chunk"] == both["_chunk"]))
    both = both.withColumns({"_a": F.coalesce("_a", "_before"), "_z": F.coalesce("_z", "_behind")})
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["mid"] - F.col("mid")).alias("d"), F.col(c)["turn"]["t"].alias("t"), F.col(c)["turn"]["speaker"].alias("speaker"))) for c in ("_a", "_z")]
    rest = both.select("item_id", "word_idx", F.least(*sides)["speaker"].alias("by_distance"))
    return out.join(rest, ["item_id", "word_idx"], "left").withColumn("speaker", F.coalesce("by_overlap", "by_distance", F.lit("SPK1"))).drop("by_overlap", "by_distance")


def rename_by_first_appearance(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``item_id, speaker, name``: SPK1 is heard first; speakers no word was given come after, in the order of their turns."""
    heard = words.select("item_id", "speaker", F.lit(0).alias("late"), F.col("word_idx").alias("at"))
    both = heard.unionByName(turns.select("item_id", "speaker", F.lit(1).alias("late"), F.col("turn_idx").alias("at")))
    first = both.groupBy("item_id", "speaker").agg(F.min(F.struct("late", "at")).alias("s"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("s"))
    return first.select("item_id", "speaker", F.concat(F.lit("SPK"), place.cast("string")).alias("name"))


def runs(df: DataFrame, by: list[str], order: str, value: Column, first: list[str] | None = None, last: list[str] | None = None, text: str | None = None, lists: list[str] | None = None) -> DataFrame:
    """Longest runs of equal neighbouring values: ``by, value, start, end, n`` and what was asked for.

    ``first`` and ``last``: columns to take from a run's first or last row; ``text``: a column to join with blanks in
    order; ``lists``: columns to gather in order. Runs inside a chunk are final; those at a chunk's edges are joined with their neighbours of equal value, of
    which a clip has two for each chunk at most.
    """
    first, last, lists = first or [], last or [], lists or []
    more = [c for c in dict.fromkeys([*first, *last, *([text] if text else []), *lists]) if c not in [*by, order]]
    rows = chunked(df.select(*by, order, value.alias("value"), *more), by, order)
    own = Window.partitionBy("_chunk", *by)
    along = own.orderBy(order)
    changed = (F.row_number().over(along) == 1) | ~F.col("value").eqNullSafe(F.lag("value").over(along))
    rows = rows.withColumn("_c", changed.cast("int")).withColumn("_run", F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = lambda o, c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), F.col(c).alias("t")))), lambda x: x["t"])
    carried = [*[F.min_by(c, order).alias(f"_f_{c}") for c in first], *[F.max_by(c, order).alias(f"_l_{c}") for c in last]]
    carried += [*([F.array_join(in_order(order, text), " ").alias("_text")] if text else []), *[in_order(order, c).alias(f"_x_{c}") for c in lists]]
    local = rows.groupBy("_chunk", *by, "_run", "value").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *carried)
    local = stored(local.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(own))))
    over = Window.partitionBy(*by).orderBy("_chunk", "_run")
    goes_on = F.coalesce((F.lag("_chunk").over(over) != F.col("_chunk")) & F.lag("value").over(over).eqNullSafe(F.col("value")), F.lit(False))
    edges = local.filter("_edge").withColumn("_new", F.when((F.row_number().over(over) == 1) | ~goes_on, 1).otherwise(0))
    edges = edges.withColumn("_run", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    carried = [*[F.min_by(f"_f_{c}", "start").alias(f"_f_{c}") for c in first], *[F.max_by(f"_l_{c}", "end").alias(f"_l_{c}") for c in last]]
    carried += [*([F.array_join(in_order("start", "_text"), " ").alias("_text")] if text else []), *[F.flatten(in_order("start", f"_x_{c}")).alias(f"_x_{c}") for c in lists]]
    edges = edges.groupBy(*by, "_run", "value").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), *carried)
    names = {**{f"_f_{c}": f"first_{c}" for c in first}, **{f"_l_{c}": f"last_{c}" for c in last}, "_text": "text", **{f"_x_{c}": c for c in lists}}
    kept = [*by, "value", "start", "end", "n", *[c for c in names if c in edges.columns]]
    return local.filter("not _edge").select(kept).unionByName(edges.select(kept)).withColumnsRenamed(names)


def diarized_lines(words: DataFrame) -> DataFrame:
    """Neighbouring words of one speaker as ``[start-end] speaker: text``."""
    out = runs(words, ["item_id"], "word_idx", F.col("speaker"), first=["start_s"], last=["end_s"], text="word")
    return out.select("item_id", F.col("start").alias("first"), F.format_string("[%.1f-%.1f] %s: %s", "first_start_s", "last_end_s", "value", "text").alias("line"))


def flag_runs(frames: DataFrame, by: list[str], order: str, flag: str, least: int = 1) -> DataFrame:
    """Longest runs of true flags as (start, end), shorter than ``least`` frames dropped; null flags are false."""
    out = runs(frames, by, order, F.coalesce(F.col(flag), F.lit(False)))
    return out.filter(F.col("value") & (F.col("n") >= least)).select(*by, "start", "end", "n")


def top_tags(scores: DataFrame, whitelist: list[str], k: int = 5) -> DataFrame:
    """Per item a line for each window with its ``k`` best whitelisted tags."""
    w = Window.partitionBy("item_id", "start_s").orderBy(F.desc("score"), "tag")
    best = scores.filter(F.col("tag").isin(whitelist)).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    lines = best.groupBy("item_id", "start_s", "end_s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag", "score"))), lambda s: F.format_string("%s %.2f", s["tag"], s["score"])), ", ").alias("tags"))
    lines = lines.select("item_id", "start_s", F.format_string("%.1f-%.1f s: %s", "start_s", "end_s", "tags").alias("line"))
    text = lines.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "line"))), lambda s: s["line"]), "\n").alias("summary"))
    return scores.select("item_id").distinct().join(text, "item_id", "left").withColumn("summary", F.coalesce("summary", F.lit("No whitelisted audio-tagger categories fired.")))


def speaker_rates(words: DataFrame) -> DataFrame:
    """Per speaker: words per second of spoken time, and pauses between neighbouring words of that speaker."""
    gap = F.lead("start_s").over(Window.partitionBy("item_id", "speaker").orderBy("word_idx")) - F.col("end_s")
    rows = words.withColumn("gap", gap)
    pause = F.when(F.col("gap") >= MIN_PAUSE_S, F.col("gap"))
    spoken = F.sum(F.col("end_s") - F.col("start_s"))
    return rows.groupBy("item_id", "speaker").agg(F.when(spoken > 0, F.count("*") / spoken).otherwise(0.0).alias("words_per_s"), F.count(pause).alias("pauses"), F.coalesce(F.avg(pause), F.lit(0.0)).alias("mean_pause_s"))


def loudness(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """RMS of each speaker in dB relative to the clip's (first column of ``by``), one grouping and a tiny window."""
    per = samples.groupBy(*by).agg(F.sum(F.col(value) ** 2).alias("s"), F.count(value).alias("n"))
    clip = Window.partitionBy(by[0])
    rms = lambda s, n: F.sqrt(s / n) + 1e-10
    return per.select(*by, (20 * F.log10(rms(F.col("s"), F.col("n")) / rms(F.sum("s").over(clip), F.sum("n").over(clip)))).alias("loudness_db"))


def events_in_cycles(events: DataFrame, cycles: DataFrame) -> DataFrame:
    """Events with the first cycle that holds them (both ends count) and the third of it, null and ``middle`` where none does."""
    c = cycles.select("item_id", "cycle_idx", F.col("start_s").alias("cs"), F.col("end_s").alias("ce"))
    hit = interval_pairs(events.select("item_id", "event_idx", "t"), c, ["item_id"], ("t", "t"), ("cs", "ce"))
    first = hit.groupBy("item_id", "event_idx").agg(F.min(F.struct("cycle_idx", "cs", "ce")).alias("c"))
    out = events.join(first, ["item_id", "event_idx"], "left")
    third = F.when(F.col("c").isNull(), "middle").otherwise(X.position_in_cycle(F.col("t"), F.col("c.cs"), F.col("c.ce")))
    return out.select(*events.columns, F.col("c.cycle_idx").alias("cycle_idx"), third.alias("third"))


def crackle_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("item_id", "cycle_idx", "third", "kind").agg(F.count("*").alias("n"))


def cycle_summary(cycles: DataFrame) -> DataFrame:
    span = F.max("end_s") - F.min("start_s")
    return cycles.groupBy("item_id").agg(F.when(span > 0, 60 * F.count("*") / span).otherwise(0.0).alias("rate_per_min"), F.count("*").alias("cycles"), F.avg(F.col("end_s") - F.col("start_s")).alias("mean_length_s"))


def cycle_share(clips: DataFrame, cycles: DataFrame) -> DataFrame:
    """Clips, those with a cycle at least, and their share in percent. ``clips``: one row for each item_id."""
    found = clips.select("item_id").join(cycles.select("item_id").distinct().withColumn("_has", F.lit(1)), "item_id", "left")
    return found.agg(F.count("*").alias("clips"), F.count("_has").alias("with_cycles"), (F.count("_has") / F.count("*") * 100).alias("share_pct"))


def rms_envelope(samples: DataFrame, frame: int, smooth: int = 10) -> DataFrame:
    """RMS of centred, zero-padded frames and its moving average over ``smooth`` frames (5 before to 4 after for 10).

    The average is taken in chunks of frames, each with the neighbours' frames that reach into it. A missing frame counts 0.
    """
    at = F.floor((F.col("idx") + frame // 2) / frame)
    rms = samples.groupBy("item_id", at.alias("frame")).agg(F.sqrt(F.sum(F.col("x") ** 2) / frame).alias("rms"))
    before, after = smooth // 2, smooth - smooth // 2 - 1
    chunk = lambda f: F.floor(f / CHUNK_FRAMES)
    held = rms.withColumn("_chunk", F.explode(F.sequence(chunk(F.col("frame") - after), chunk(F.col("frame") + before))))
    w = Window.partitionBy("item_id", "_chunk").orderBy("frame").rangeBetween(-before, after)
    return held.withColumn("smoothed", F.sum("rms").over(w) / smooth).filter(F.col("_chunk") == chunk(F.col("frame"))).drop("_chunk")


def ie_ratio(samples: DataFrame, cycles: DataFrame) -> DataFrame:
    """Median over cycles of the time to the loudest sample against the time after it. ``samples``: item_id, t, x, step."""
    hit = interval_pairs(samples.select("item_id", "t", "x", "step"), cycles.select("item_id", "cycle_idx", "start_s", "end_s"), ["item_id"], ("t", "t"), ("start_s", "end_s")).filter("t < end_s")
    per = hit.groupBy("item_id", "cycle_idx").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.min_by("t", F.struct(-F.abs("x"), F.col("t"))).alias("peak"), F.max("step").alias("step"))
    per = per.withColumn("i", F.col("peak") - F.col("t0")).withColumn("e", F.col("n") * F.col("step") - F.col("i")).filter("n >= 3 and i > 0 and e > 0")
    return per.groupBy("item_id").agg(F.median(F.col("i") / F.col("e")).alias("ie_ratio"))


def peak_clusters(peaks: Column) -> Column:
    """Distinct tones of an array of peaks: a new one lies more than 100 Hz above the last one kept."""
    sorted_ = F.array_sort(F.array_distinct(F.transform(peaks, lambda p: F.round(p, 1))))
    empty = F.array().cast("array<double>")
    return F.aggregate(sorted_, empty, lambda acc, p: F.when((F.size(acc) == 0) | (p - F.get(acc, F.size(acc) - 1) > TONE_GAP_HZ), F.concat(acc, F.array(p))).otherwise(acc))


def fallback_rate(turns: DataFrame, by: list[str], text: Column, duration: Column) -> DataFrame:
    """Share of first turns that name a usable span."""
    span = X.parse_time_span(text, duration)
    return turns.groupBy(*by).agg((F.avg(span.isNotNull().cast("double")) * 100).alias("usable_pct"), F.count_if(span.isNull()).alias("fallbacks"), F.count("*").alias("n"))
