"""Run folders and artifacts written to a temporary folder and read back."""

import json

import pytest
from pyspark.sql import functions as F

from verdikt import schemas
from verdikt.sources import records as I
from verdikt.streaming.live import scored_stream


def line(item, text, **more):
    return json.dumps({"sample_id": f"clips/{item}.wav", "instruction": ["a", "b"], "generated_text": text, "metadata": {"item_id": item, "choices": ["Dog", "Cat"]}, **more})


def test_run_records(spark, tmp_path):
    old, new, broken = (tmp_path / "m" / f"mmar_cot_2024010{k}_120000" for k in (1, 2, 3))
    for k, folder in enumerate((old, new, broken)):
        folder.mkdir(parents=True)
        (folder / "raw_output_2.jsonl").write_text(line("ID1", "A") + "\n\n" + line("ID1", "B") + "\n{oops\n")
        if k < 2:
            (folder / "metrics.txt").write_text("done")
    rows = I.read_run_records(spark, str(tmp_path / "m" / "*" / "raw_output*.jsonl"))
    good, bad = I.split_corrupt(rows)
    assert good.count() == 6 and bad.count() == 3
    with pytest.raises(ValueError):
        I.require_clean(good, bad)
    r = good.filter(F.col("run_dir") == new.name).orderBy("line_ord").collect()
    assert [x.generated_text for x in r] == ["A", "B"] and r[0].run_idx == 2 and json.loads(r[0].instruction) == ["a", "b"]
    catalog = I.run_catalog(I.list_files(spark, str(tmp_path / "m" / "*" / "*")), "mmar")
    assert I.latest_finished_runs(catalog, ["experiment"]).first().run_dir == new.name
    configs = spark.createDataFrame([(new.name, "model-a")], "run_dir string, audio_model_id string")
    assert {x.run_dir: x.audio_model_id for x in I.attach_run_config(catalog, configs).collect()}[old.name] == "unrecorded"


def test_keyed_maps_and_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\n\n b \na\n")
    (tmp_path / "ids.jsonl").write_text('{"item_id": "x"}\n{"item_id": " "}\n')
    assert {r.item_id for r in I.read_id_list(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    assert {r.item_id for r in I.read_id_list(spark, str(tmp_path / "ids.jsonl"), "item_id").collect()} == {"x"}
    (tmp_path / "map.json").write_text('{"k1": ["a", "b"], "k2": []}')
    assert {(r.key, r.pos, r.value) for r in I.read_json_map(spark, str(tmp_path / "map.json"), "array<string>").collect()} == {("k1", 0, "a"), ("k1", 1, "b")}
    (tmp_path / "ev.jsonl").write_text('{"item_id":"a","tags_summary":"1"}\n{"item_id":"a","tags_summary":"2"}\n')
    got = I.read_keyed_jsonl(spark, str(tmp_path / "ev.jsonl"), schemas.struct(item_id=schemas.STRING, tags_summary=schemas.STRING)).collect()
    assert [(r.item_id, r.tags_summary) for r in got] == [("a", "2")]


def test_the_last_line_wins_over_files_and_splits(spark, tmp_path):
    """Files are cut into splits that are dealt largest first; the order of lines doesn't follow them."""
    kind = schemas.struct(item_id=schemas.STRING, tags_summary=schemas.STRING)
    want = {}
    for name, n in (("a", 900), ("b", 40), ("c", 300)):
        lines = [(f"k{(k * 7) % 50}", f"{name}{k}") for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"item_id": k, "tags_summary": v}) + "\n" for k, v in lines))
        want |= dict(lines)
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {c: spark.conf.get(c) for c in (size, cost)}
    try:
        spark.conf.set(size, "3000")
        spark.conf.set(cost, "100")
        rows = I.read_json_lines(spark, str(tmp_path / "*.jsonl"), kind)
        assert rows.rdd.getNumPartitions() > 10
        assert {r.item_id: r.tags_summary for r in I.read_keyed_jsonl(spark, str(tmp_path / "*.jsonl"), kind).collect()} == want
        assert [r.tags_summary for r in rows.orderBy("line_ord").collect()] == [f"{name}{k}" for name, n in (("a", 900), ("b", 40), ("c", 300)) for k in range(n)]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    I.write_table(df, str(tmp_path / "t"), "csv")
    I.write_records(df, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 2


def test_answers_are_scored_as_they_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"text":"Final answer: B","choices":["x","y"],"gold":"B"}\n{"text":"?","choices":["x","y"],"gold":"A"}\n')
    stream = spark.readStream.schema("text string, choices array<string>, gold string").json(str(tmp_path / "in"))
    q = scored_stream(stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.letter, r.correct) for r in spark.table("scored").collect()} == {("B", True), (None, False)}
