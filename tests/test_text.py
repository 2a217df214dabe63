"""Tables of texts and the answers they hold."""

import pytest
from pyspark.sql import functions as F

from verdikt.functions import text as X

WEATHER = ["light rain", "Heavy snow", "a dry, hot wind", "Fog"]
SIX = ["oak", "elm", "Silver birch", "ash", "None of these", "larch"]
WEATHER_CASES = [
    # explicit statements: the last valid one counts
    ("My final answer is D", "D"), ("answer = B? No.\nCorrect option: (A)", "A"), ("The answer is Z, so the answer is C", "C"), ("the answer is B's cousin", None), ("The Answer: **D**", "D"),
    # a whole answer or a first line that is a choice's text
    ("heavy   SNOW", "B"), ("`Fog.`", "D"), ("light rain\nD is not it", "A"), ("heavy snow or fog", None),
    # letters on the first and the last line
    ("b", None), ("[C]", "C"), ("D) Fog in the valley", "D"), ("Hard to say\nbut well\n**A**:", "A"), ("F", None), ("B)\u00a0because of the cold", "B"), ("C.\u3000因为很热", "C"), ("Well\nD:\u2003\u00a0so it is", "D"), ("A.\u00a0", "A"), ("B)\u200bno blank", None),
    # all answer-shaped lines name one letter
    ("Hmm:\nB. heavy snow\nthat is it", "B"), ("see\nA. light rain\nD. fog\nso both", None), ("see\nA. fog\nno", None), ("So:\nB.\u3000heavy\u00a0snow\nit is", "B"),
    # reasoning and tags
    ("<think>answer is A</think>\n\nD", "D"), ("<THINK>C? B?", None), ("<|channel>thought B<channel|> (A)", "A"), ("answer: B <answer> A </answer> answer: C", "A"), ("<answer>Fog", "D"),
    ("", None), (None, None), (" \u3000\n", None),
]
SIX_CASES = [("F", "F"), ("G", None), ("none of these", "E"), ("The tree must be:\nC. silver  birch\nbecause of its bark", "C"), ("correct choice is E)", "E")]


def column(spark, values, f, choices=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    c = F.array(*[F.lit(x) for x in choices]) if choices else None
    return [r.x for r in df.select("i", f(F.col("t"), c).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("table,choices", [(WEATHER_CASES, WEATHER), (SIX_CASES, SIX)])
def test_chosen_letters(spark, table, choices):
    df = spark.createDataFrame([(i, t, choices) for i, (t, _) in enumerate(table)], "i int, text string, choices array<string>")
    got = [r.letter for r in X.with_letter(df).orderBy("i").collect()]
    assert [(t, g) for (t, _), g in zip(table, got, strict=True)] == table
    assert X.with_letter(df).columns == ["i", "text", "choices", "letter"]
    assert [r.letter for r in X.with_letter(df.withColumn("choices", F.lit(None).cast("array<string>"))).collect()] == [None] * len(table)


def test_choices_that_are_equal_name_no_letter(spark):
    assert column(spark, ["Yes", "no", "'NO'."], X.match_choice_text, ["yes", "No", "Yes "]) == [None, "B", "B"]
    assert column(spark, ["YES", "no", "maybe"], X.answer_to_letter, ["yes", "No", "Yes "]) == ["A", "B", None]


def test_language(spark):
    texts = ["The dog barks.", "She says 你好 and leaves the room", "我认为答案是狗叫", "これは日本語です", "한국어 문장입니다", "", None]
    assert column(spark, texts, lambda t, _: X.is_non_english(t)) == [False, False, True, True, True, False, False]
    assert column(spark, texts, lambda t, _: X.contains_cjk(t)) == [False, True, True, True, True, False, False]


def test_time_span(spark):
    cases = [('{"start": 1, "end": 3}', (1.0, 3.0)), ('no {"start": 5, "end": 2} but {"start": -1, "end": 99}', (0.0, 10.0)), ("nothing", None), ('{"start": "2.5", "end": 4}', (2.5, 4.0)), ('{"start": "x", "end": 4}', None), ("{broken", None)]
    got = column(spark, [t for t, _ in cases], lambda t, _: X.parse_time_span(t, F.lit(10.0)))
    assert [(g.start, g.end) if g else None for g in got] == [x for _, x in cases]


def test_item_key_choices_and_metadata(spark):
    assert column(spark, ["a/b/clip.v2.wav", "clip", "/x/.hidden", "dir/name.wav/"], lambda t, _: X.item_key(F.lit(None).cast("string"), t)) == ["clip.v2", "clip", ".hidden", "name"]
    lists = ['["a", "b"]', "['British', \"it's\"]", "plain", "[]", None]
    assert column(spark, lists, lambda t, _: X.normalize_choices(t)) == [["a", "b"], ["British", "it's"], None, None, None]
    said = ["Sound recorded at the patient's Left Lung , with the acquisition mode being Multichannel.", "nothing"]
    got = column(spark, said, lambda t, _: X.parse_recording_metadata(t))
    assert (got[0].location, got[0].mode, got[1]) == ("left lung", "multichannel", None)


def test_judgement_fallback(spark):
    good = '{"reasoning":"r","acoustic_accuracy":8,"diagnostic_accuracy":10,"hallucination_penalty":0,"extracted_class":"COPD"}'
    got = column(spark, [good, good.replace("8", "11"), "broken", None], lambda t, _: X.parse_judgement(t))
    assert [g.extracted_class for g in got] == ["COPD", "Unknown", "Unknown", "Unknown"]
    assert [(g.acoustic_accuracy, g.hallucination_penalty) for g in got][1:] == [(0, 1)] * 3
