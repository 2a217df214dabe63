"""Evaluation tables derived from the star-schema tables with integer arithmetic that Spark and any SQL engine share.

``RESPONSES`` makes answers of two models under four experiments with three runs each from ``orders``. The template of
an answer's text and the letter it means are separate columns, so a check never has to parse a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHOICES = ["a kettle boils", "Two people whisper", "rain on a tin roof", "the engine stalls"]
CHINESE = "我认为这段录音里的选项是这个"

RESPONSES = """
select m.model, e.experiment, r.run_idx, o.o_orderkey as item_id, o.o_orderpriority as category, o.o_orderstatus as sub_category,
  cast(o.o_orderkey % 4 as int) as gold_idx,
  cast(case when (o.o_orderkey * 31 + r.run_idx * 17 + e.no * 101 + m.no * 57) % 97 < 40 + e.no * 8 + m.no * 3 then o.o_orderkey % 4
    else (o.o_orderkey + 1 + (o.o_orderkey * 13 + r.run_idx * 7 + e.no * 5 + m.no) % 3) % 4 end as int) as said_idx,
  cast((o.o_orderkey * 7 + r.run_idx * 3 + e.no * 5 + m.no * 2) % 11 as int) as template
from {orders} o
cross join (select 1 as run_idx union all select 2 union all select 3) r
cross join (select 0 as no, 'baseline' as experiment union all select 1, 't1' union all select 2, 't2' union all select 3, 't3') e
cross join (select 0 as no, 'm1' as model union all select 1, 'm2') m
"""

#: The letter each answer means: templates 7 (cut-off reasoning) and 9 (ambiguous) mean none.
SQL_RESPONSES = f"select *, chr(65 + gold_idx) as gold, case when template in (7, 9) then null else chr(65 + said_idx) end as letter from ({RESPONSES.format(orders='orders')})"
SQL_OUTCOMES = f"select model, experiment, run_idx, item_id, category, sub_category, coalesce(letter = gold, false) as correct from ({SQL_RESPONSES})"
SQL_MAJORITY = f"select model, experiment, item_id, max(category) as category, 2 * count(*) filter (correct) > 3 as correct from ({SQL_OUTCOMES}) group by 1, 2, 3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def responses(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Answers with their texts: model, experiment, run_idx, item_id, category, sub_category, gold, text, choices.

    Items are dealt to tasks by id before each becomes 24 answers, so texts are made and parsed in parallel and what is
    grouped by item later needs no shuffle. ``more``: further columns of ``RESPONSES`` to keep.
    """
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rows = spark.sql(RESPONSES, orders=items)
    choices = F.array(*[F.lit(c) for c in CHOICES])
    said = F.chr(F.lit(65) + F.col("said_idx"))
    texts = [said, F.concat(F.lit("("), said, F.lit(")")), F.concat(F.lit("**"), said, F.lit("**")), F.concat(F.lit("First, it looks odd.\nFinal answer: "), said), F.get(choices, F.col("said_idx"))]
    texts += [F.concat(F.lit("<analysis>A or B.</analysis><answer>"), said, F.lit("</answer>")), F.concat(F.lit("<think>maybe A</think>"), said), F.concat(F.lit("<think>"), said), F.concat(F.lit(CHINESE + "\n"), said), F.lit("It could be A or B")]
    blank = F.when(F.col("said_idx") % 2 == 0, "\u00a0").otherwise("\u2003")  # blanks beyond ASCII
    texts += [F.concat(said, F.when(F.col("said_idx") < 2, ")").otherwise("."), blank, F.lit("because of the cold"))]
    text = F.get(F.array(*texts), F.col("template"))
    return rows.select("model", "experiment", "run_idx", "item_id", "category", "sub_category", F.chr(F.lit(65) + F.col("gold_idx")).alias("gold"), text.alias("text"), choices.alias("choices"), *more)
