"""Run folders, JSON lines, JSON objects and id lists as DataFrames, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RESPONSE


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Non-blank lines with their file and ``line_ord``, an order of all lines: by file name, then along the file.

    However Spark splits files and deals the splits, a later line of a file and any line of a file whose path sorts
    later compare greater; ``at`` only counts lines inside one split.
    """
    rows = spark.read.text(paths)
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return rows.select(
        file.alias("file"), F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at")).alias("line_ord"), "value"
    ).filter(F.trim("value") != "")


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """JSON lines under an explicit schema, with ``file``, ``line_ord`` and the raw text of malformed lines in ``corrupt``."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = _lines(spark, paths).withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return rows.select("file", "line_ord", *[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], F.col("r._corrupt_record").alias("corrupt"))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and malformed ones as (file, line_ord, corrupt)."""
    return df.filter("corrupt is null").drop("corrupt"), df.filter("corrupt is not null").select("file", "line_ord", "corrupt")


def read_run_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every ``raw_output*.jsonl`` of the run folders: responses with run_dir and run_idx, parsed from the file's path."""
    rows = read_json_lines(spark, paths, RESPONSE)
    parts = F.split("file", "/")
    run = F.regexp_extract(F.element_at(parts, -1), r"(\d+)\.jsonl$", 1)
    return rows.withColumn("run_dir", F.element_at(parts, -2)).withColumn("run_idx", F.coalesce(run.try_cast("int"), F.lit(1)))


def parse_run_name(name, dataset: str):
    """(experiment, started) from ``dataset_experiment_YYYYMMDD_HHMMSS``; both empty where the name has another form."""
    pattern = rf"^{dataset}_(.+)_(\d{{8}}_\d{{6}})$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def run_catalog(paths: DataFrame, dataset: str, markers: tuple[str, ...] = ("metrics.txt", "stability_report.json")) -> DataFrame:
    """From file paths: one row per run folder with root, experiment, started and whether a finish marker lies in it."""
    parts = F.split("path", "/")
    rows = paths.select(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), "/").alias("root"), F.get(parts, F.size(parts) - 2).alias("run_dir"), F.element_at(parts, -1).alias("file"))
    experiment, started = parse_run_name(F.col("run_dir"), dataset)
    return rows.groupBy("root", "run_dir").agg(F.bool_or(F.col("file").isin(*markers)).alias("finished")).withColumn("experiment", experiment).withColumn("started", started).filter("started <> ''")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths only; no content is read."""
    return spark.read.format("binaryFile").load(pattern).select("path")


def latest_finished_runs(catalog: DataFrame, by: list[str]) -> DataFrame:
    """The newest finished folder of each group; unfinished ones never win."""
    rest = [c for c in catalog.columns if c not in by]
    best = catalog.filter("finished").groupBy(*by).agg(F.max_by(F.struct(*rest), "started").alias("s"))
    return best.select(*by, "s.*")


def attach_run_config(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """Model id of each run folder; ``unrecorded`` where no config lies in it."""
    return runs.join(configs.select("run_dir", "audio_model_id"), "run_dir", "left").withColumn("audio_model_id", F.coalesce("audio_model_id", F.lit("unrecorded")))


def read_id_list(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Distinct trimmed ids: the lines of a text file, or one field of JSON lines; blanks dropped."""
    lines = spark.read.text(path)
    value = F.get_json_object("value", f"$.{field}") if field else F.col("value")
    return lines.select(F.trim(value).alias("item_id")).filter("item_id <> ''").distinct()


def read_keyed_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str = "item_id") -> DataFrame:
    """Evidence lines; of a key's lines the last one, of all files in order of their names. A map-side combined maximum."""
    good, _ = split_corrupt(read_json_lines(spark, path, schema))
    rest = [f.name for f in schema.fields if f.name != key]
    last = good.groupBy(key).agg(F.max_by(F.struct(F.lit(1).alias("_"), *rest), "line_ord").alias("s"))
    return last.select(*[F.col(key) if f.name == key else F.col(f"s.{f.name}") for f in schema.fields])


def read_json_map(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """A JSON object as rows: ``key, value``, and ``key, pos, value`` for lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value_type}>").alias("m"))
    rows = whole.select(F.explode("m").alias("key", "value"))
    return rows.select("key", F.posexplode("value").alias("pos", "value")) if value_type.startswith("array") else rows


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table as Parquet or as CSV with a header; an existing table is not overwritten."""
    writer = df.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def require_clean(good: DataFrame, bad: DataFrame) -> DataFrame:
    """``good``, or an error that shows the first quarantined row."""
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"quarantined rows: {first[0]}")
    return good
