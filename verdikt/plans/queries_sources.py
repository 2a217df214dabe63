"""Readers and writers over files that are made of the given tables, and their SQL on those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources import records as I
from ..sources.store import shared_folder
from .derived import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Run folders that turns of conversations are written to, and entries of one JSON object.
RUNS = {"mmar_baseline_20240101_120000": 0, "mmar_cot_20240102_120000": 1}
OBJECT_ENTRIES = 10_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def runs(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as run records in two run folders, every seventh line cut off, read back."""
    turns = table(s, d, "conversations")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    line = F.to_json(F.struct(F.concat(F.lit("clips/"), name, F.lit(".wav")).alias("sample_id"), F.col("role").alias("instruction"), F.col("text").alias("generated_text"), F.struct(name.alias("item_id")).alias("metadata")))
    cut = (F.col("conv_id") + F.col("turn")) % 7 == 0
    folder = shared_folder(s)
    for run, k in RUNS.items():
        turns.filter((F.col("conv_id") + F.col("turn")) % 2 == k).select(F.when(cut, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(f"{folder}/{run}")
    return I.read_run_records(s, f"{folder}/*/part-*")


TURNS = "(select *, case when (conv_id + turn) % 2 = 0 then 'mmar_baseline_20240101_120000' else 'mmar_cot_20240102_120000' end run_dir from conversations)"


@query(f"select run_dir, 1 run_idx, 'clips/' || conv_id || '-' || turn || '.wav' sample_id, role instruction, text generated_text, conv_id || '-' || turn item_id from {TURNS} where (conv_id + turn) % 7 <> 0")
def s1_read_run_records(s, d):
    good, _ = I.split_corrupt(runs(s, d))
    return good.select("run_dir", "run_idx", "sample_id", "instruction", "generated_text", F.col("metadata.item_id").alias("item_id"))


@query(f"select run_dir, count(*) filter (bad) malformed, count(*) filter (not bad) good from (select *, (conv_id + turn) % 7 = 0 bad from {TURNS}) group by 1")
def s2_split_corrupt(s, d):
    rows = runs(s, d)
    good, bad = I.split_corrupt(rows)
    counts = good.groupBy("run_dir").agg(F.count("*").alias("good")).join(bad.groupBy(F.element_at(F.split("file", "/"), -2).alias("run_dir")).agg(F.count("corrupt").alias("malformed")), "run_dir", "full")
    return counts.select("run_dir", F.coalesce("malformed", F.lit(0)).alias("malformed"), F.coalesce("good", F.lit(0)).alias("good"))


@query("select distinct s_name item_id from supplier join lineitem on l_suppkey = s_suppkey")
def s5_read_id_list(s, d):
    """Supplier names, once for each line item, padded and with empty lines between."""
    names = table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    folder = shared_folder(s)
    names.select(F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  "), F.col("s_name"), F.lit(" \n"))).otherwise(F.col("s_name")).alias("value")).write.text(folder)
    return I.read_id_list(s, f"{folder}/part-*")


@query("select user_id::varchar item_id, arg_max(event_type, event_id) tags_summary from events group by 1")
def s6_read_keyed_jsonl(s, d):
    """Each event as an evidence line; the last of a user counts, so a user's lines stand in order in one file."""
    lines = table(s, d, "events").repartition("user_id").sortWithinPartitions("user_id", "event_id")
    folder = shared_folder(s)
    lines.select(F.col("user_id").cast("string").alias("item_id"), F.col("event_type").alias("tags_summary")).write.json(folder)
    return I.read_keyed_jsonl(s, f"{folder}/part-*", schemas.struct(item_id=schemas.STRING, tags_summary=schemas.STRING))


@query("select s_name \"key\", (r - 1)::int pos, case r when 1 then s_name else 'nation ' || s_nationkey end \"value\" from supplier cross join (select unnest(range(1, 3)) r)")
def s7_read_json_map(s, d):
    """Suppliers as JSON objects of bounded size, one in a file: name to a list."""
    rows = table(s, d, "supplier")
    parts = max(1, -(-rows.count() // OBJECT_ENTRIES))
    entry = F.struct(F.col("s_name"), F.array(F.col("s_name"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))))
    objects = rows.groupBy(F.pmod(F.xxhash64("s_name"), F.lit(parts)).alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    folder = shared_folder(s)
    objects.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return I.read_json_map(s, f"{folder}/part-*", "array<string>")


@query("select p_partkey, p_name, p_size, p_retailprice from part")
def s8_write_records(s, d):
    rows = table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    folder = shared_folder(s)
    I.write_records(rows, folder)
    return s.read.schema(rows.schema).json(folder)
