"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.oracle import same
from verdikt.plans import queries_data, queries_outcomes, queries_sources

ALL = {**queries_outcomes.QUERIES, **queries_data.QUERIES, **queries_sources.QUERIES}
SQL = {**queries_outcomes.SQL, **queries_data.SQL, **queries_sources.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, name):
    same(ALL[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    assert ALL[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cut_signal_keeps_its_tail(spark, tmp_path):
    events = spark.range(1_000_050).selectExpr("4L as user_id", "id as event_id", "cast(id as double) as value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = queries_data.signals(spark, str(tmp_path)).selectExpr("item_id", "size(samples) n", "samples[0] first", "element_at(samples, -1) last").collect()
    assert sorted(map(tuple, got)) == [(-5, 1_000_045, 5.0, 1_000_049.0), (4, 1_000_050, 0.0, 1_000_049.0)]


def test_compare_runs_has_every_column(spark):
    from verdikt.plans import reports

    right = {"baseline": {1: True, 2: False, 3: True, 4: False}, "t1": {1: True, 2: True, 3: False, 4: True}}
    rows = spark.createDataFrame([("m", e, 0, i, c, "a" if i < 4 else "b") for e, x in right.items() for i, c in x.items()], "model string, experiment string, run_idx int, item_id long, correct boolean, category string")
    split = spark.createDataFrame([(1, "transcript_solvable"), (2, "audio_dependent"), (3, "audio_dependent")], "item_id long, subset string")
    got = {r.experiment: r for r in reports.compare_runs(rows, split).collect()}["t1"]
    assert [round(got[c], 6) for c in ("acc", "delta", "ba", "mean_ba", "delta_ba", "acc_ts", "acc_ad", "ba_ts", "ba_ad", "n_ts", "n_ad")] == [75, 25, 83.333333, 83.333333, 50, 100, 50, 100, 50, 1, 2]
    assert got.ba_low <= got.ba <= got.ba_high and 0 < got.p_ba <= 1
    assert [(c.category, round(c.accuracy_pct, 6), c.n) for c in got.categories] == [("a", 66.666667, 3), ("b", 100, 1)]


def test_dataset_report_has_every_part(spark, data):
    rows = queries_data.r10_dataset_report(spark, data).collect()
    parts = {p: {r["name"]: r["value"] for r in rows if r["part"] == p} for p in {r["part"] for r in rows}}
    assert {"evaluation labels", "rule accuracy", "ceiling", "durations", "rates", "demonstration"} <= set(parts)
    assert parts["ceiling"]["ba_pct"] == max(parts["rules"].values()) and set(parts["rates"]) == {"8000", "8001", "8002"}
    assert all(len(parts.get(role, {})) == n for role, n in parts["split"].items())
