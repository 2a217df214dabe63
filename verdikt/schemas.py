"""Explicit schemas of the tables that jobs exchange. Nothing is inferred, and no session is needed to import them."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(STRING)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


METADATA = struct(
    item_id=STRING,
    question=STRING,
    choices=STRINGS,
    transcript=STRING,
    modality=STRING,
    category=STRING,
    sub_category=STRING,
    original_item_id=STRING,
    variant_idx=INT,
    permutation=T.ArrayType(INT),
    original_choices=STRINGS,
    votes=STRINGS,
    choice_scores=T.MapType(STRING, DOUBLE),
    cycle_spans=T.ArrayType(T.ArrayType(DOUBLE)),
)
EVALUATION = struct(reasoning=STRING, acoustic_accuracy=INT, diagnostic_accuracy=INT, hallucination_penalty=INT, extracted_class=STRING, extracted_choice=STRING)
#: One answer line. ``instruction`` is a string: the JSON reader keeps the raw text of both its string and its list form.
RESPONSE = struct(sample_id=STRING, instruction=STRING, generated_text=STRING, final_turn_text=STRING, ground_truth=STRING, metadata=METADATA, evaluation=EVALUATION)
OUTCOMES = struct(model=STRING, experiment=STRING, run_idx=INT, item_id=STRING, correct=BOOL, category=STRING)
MAJORITY = struct(model=STRING, experiment=STRING, item_id=STRING, correct=BOOL, n_runs=LONG, category=STRING)
SPLIT = struct(item_id=STRING, subset=STRING)
NEIGHBORS = struct(item_id=STRING, rank=INT, neighbor_id=STRING, score=DOUBLE)
PAIRS = struct(left_id=STRING, right_id=STRING, corr=DOUBLE)
