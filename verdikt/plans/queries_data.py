"""Queries over items, documents, vectors, conversations and events, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dataset as D
from ..operators import duplicates as U
from ..operators import events as E
from ..operators import outcomes as O
from ..operators import requests as Q
from ..operators import retrieval as K
from ..operators import signals as G
from ..sources import records as I
from ..sources.store import stored
from . import reports as R
from .derived import table
from .queries_outcomes import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- items -----------------------------------------------------------------------------------------------------------


@query(r"""select page_id, case when page_id % 3 = 0 then 'item-' || page_id else case when length(n) > 1 and regexp_matches(n, '.\.[^.]*$') then regexp_replace(n, '\.[^.]*$', '') else n end end item_key
from (select page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) n from pages)""")
def p1_item_key(s, d):
    p = table(s, d, "pages")
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("item-"), "page_id"))
    return p.select("page_id", X.item_key(meta, F.col("url")).alias("item_key"))


def recordings(s, d) -> DataFrame:
    """An instruction per document that names a site and a mode, or doesn't."""
    docs = table(s, d, "documents").select("doc_id", "lang")
    mode = F.when(F.col("doc_id") % 2 == 0, "Multichannel").otherwise("single channel")
    said = F.concat(F.lit("Sound recorded at the patient's "), F.concat(F.upper("lang"), F.lit("  left ")), F.lit(" , with the acquisition mode being "), mode, F.lit("."))
    return docs.withColumn("instruction", F.when(F.col("doc_id") % 5 == 4, "no metadata here").otherwise(said))


@query("select doc_id, case when doc_id % 5 <> 4 then lower(lang) || '  left' end \"location\", case when doc_id % 5 = 4 then null when doc_id % 2 = 0 then 'multichannel' else 'single channel' end \"mode\" from documents")
def p2_parse_recording_metadata(s, d):
    return recordings(s, d).select("doc_id", X.parse_recording_metadata(F.col("instruction")).alias("m")).select("doc_id", "m.location", "m.mode")


@query("select p_partkey item_id, case when p_partkey % 4 = 3 then 0 else 2 end n, case when p_partkey % 4 = 3 then null else p_brand end first_choice from part")
def p3_normalize_choices(s, d):
    """Choices given as JSON lists, Python lists, or something else."""
    p, k = table(s, d, "part"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))).when(k == 1, F.concat(F.lit("['"), "p_brand", F.lit("', \"it's\"]"))).when(k == 2, F.concat(F.lit("[ '"), "p_brand", F.lit("','x' ]"))).otherwise(F.col("p_brand"))
    c = X.normalize_choices(raw)
    return p.select(F.col("p_partkey").alias("item_id"), F.size(c).alias("n"), F.get(c, F.lit(0)).alias("first_choice")).withColumn("n", F.when(F.col("first_choice").isNotNull(), F.col("n")).otherwise(0))


BAD = "(l_quantity::int % 12 > 10 or l_partkey % 7 = 0)"


@query(f"select l_linestatus status, case when {BAD} then 0 else l_quantity::int % 12 end acoustic, case when {BAD} then 1 else (l_suppkey % 2)::int end hallucination, case when {BAD} then 'Unknown' else l_returnflag end cls, count(*) n from lineitem group by all")
def p12_parse_judgement(s, d):
    rows = table(s, d, "lineitem")
    good = F.format_string('{"reasoning": "r", "acoustic_accuracy": %d, "diagnostic_accuracy": %d, "hallucination_penalty": %d, "extracted_class": "%s"}', (F.col("l_quantity").cast("int") % 12), (F.col("l_quantity").cast("int") % 12), F.col("l_suppkey") % 2, F.col("l_returnflag"))
    raw = F.when(F.col("l_partkey") % 7 == 0, F.lit("I think it is fine {")).otherwise(good)
    j = rows.select(F.col("l_linestatus").alias("status"), X.parse_judgement(raw).alias("j"))
    return j.groupBy("status", F.col("j.acoustic_accuracy").alias("acoustic"), F.col("j.hallucination_penalty").alias("hallucination"), F.col("j.extracted_class").alias("cls")).agg(F.count("*").alias("n"))


@query("select event_type, case when event_type = 'view' then 'Healthy' when event_type = 'click' then 'Unknown' else event_type end label, count(*) n from events group by 1, 2")
def p13_normalize_label(s, d):
    t = F.col("event_type")
    raw = F.when(t == "view", X.HEALTHY_LABEL).when(t == "click", "None").otherwise(t)
    return table(s, d, "events").groupBy("event_type", X.normalize_label(raw).alias("label")).agg(F.count("*").alias("n"))


SPAN = "(select event_id, event_id % 5 k, (event_id % 40)::double / 2 a, (event_id % 40)::double / 2 + 3 b from events)"


@query(f"""select event_id, case when k = 4 then null else a end start_s, case when k = 4 then null else least(20.0, b) end end_s, case when k = 4 then null else greatest(0.0, a - 0.5) end crop_start, case when k = 4 then null else least(20.0, least(20.0, b) + 0.5) end crop_end from {SPAN}""")
def p14_parse_time_span(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") % 5).alias("k"), ((F.col("event_id") % 40).cast("double") / 2).alias("a"))
    one = F.format_string('{"start": %.1f, "end": %.1f}', F.col("a"), F.col("a") + 3)
    text = F.when(F.col("k") == 4, F.lit('nothing {"start": 9, "end": 2} to {"start": "x"} see')).when(F.col("k") == 3, F.concat(F.lit('{"begin": 1} {"start": 5, "end": 5} then '), one)).otherwise(F.concat(F.lit("It is "), one, F.lit(' not {"start": 0, "end": 1}')))
    return e.select("event_id", X.parse_time_span(text, F.lit(20.0)).alias("t")).select("event_id", F.col("t.start").alias("start_s"), F.col("t.end").alias("end_s"), "t.crop_start", "t.crop_end")


def labelled(s, d) -> DataFrame:
    """Documents with labels as items: label and two metadata columns."""
    l = table(s, d, "labels").select("doc_id", F.concat(F.col("quality").cast("string"), F.lit("/"), F.col("toxic").cast("string")).alias("label"))
    return table(s, d, "documents").select("doc_id", "lang", "source").join(l, "doc_id").withColumnRenamed("doc_id", "item_id")


ITEMS = "(select doc_id item_id, lang, source, quality || '/' || toxic as label from documents join labels using (doc_id))"


@query(f"with i as {ITEMS}, m as (select label from i group by 1 order by count(*) desc, label limit 1) select item_id, case when lang = 'en' then '1/0' else '0/0' end by_rule, (select label from m) majority from i")
def p15_rule_predictions(s, d):
    i = labelled(s, d)
    top = i.groupBy("label").agg(F.count("*").alias("n")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"))
    return i.crossJoin(F.broadcast(top)).select("item_id", F.when(F.col("lang") == "en", "1/0").otherwise("0/0").alias("by_rule"), "majority")


@query("""select item_id, md5(case when item_id % 3 = 0 then 'Look.' || chr(10) || chr(10) || b else 'Plan.' || chr(10) || chr(10) || 'Question: ' || text end) first_md5, md5(case when item_id % 3 = 0 then 'x' else 'Answer.' || chr(10) || chr(10) || b end) last_md5, case when item_id % 3 = 0 then 1 else 2 end turns
from (select item_id, text, case when item_id % 2 = 0 then 'Transcript: ' || item_id || chr(10) || chr(10) else '' end || 'Question: ' || text || chr(10) || 'Choices:' || chr(10) || 'A. yes' || chr(10) || 'B. no' b from benchmark)""")
def p16_render_instruction(s, d):
    b = table(s, d, "benchmark")
    one = F.col("item_id") % 3 == 0
    turns = F.when(one, F.array(F.lit("Look."))).otherwise(F.array(F.lit("Plan."), F.lit("Answer.")))
    context = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Transcript: "), F.col("item_id").cast("string")))
    r = b.select("item_id", X.render_instruction(turns, context, F.col("text"), F.array(F.lit("yes"), F.lit("no")), ~one).alias("r"))
    return r.select("item_id", F.md5(F.get("r", F.lit(0))).alias("first_md5"), F.md5(F.coalesce(F.get("r", F.lit(1)), F.lit("x"))).alias("last_md5"), F.size("r").alias("turns"))


@query("""select conv_id, turn, md5('--- PROMPT ---' || chr(10) || role || chr(10) || chr(10) || '--- MODEL ANSWER ---' || chr(10) || coalesce(text, '') || chr(10)) prompt_md5, md5(case when turn % 2 = 0 then 'A' else '<analysis>' || chr(10) || 'The correct choice is A.' || chr(10) || '</analysis>' || chr(10) || '<answer>' || chr(10) || 'A' || chr(10) || '</answer>' end) shot_md5 from conversations""")
def p17_render_judge_prompt(s, d):
    c = table(s, d, "conversations")
    prompt = X.judge_user_text(F.col("role"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""), F.col("text"))
    return c.select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"), F.md5(X.shot_answer(F.lit("A"), F.lit(None).cast("string"), F.col("turn") % 2 == 1)).alias("shot_md5"))


@query("""with c as (select doc_id, n_chars n, greatest(1, least(4, ceil(n_chars / 100.0 / 5)))::bigint k from documents),
w as (select doc_id, n_chars n, case when n_chars <= 500 then 1 else (n_chars - 500) // 250 + 1 end::bigint k from documents)
select c.doc_id, c.k chunks, (c.n * 1) // c.k first_end, w.k windows, case when w.n <= 500 then w.n else (w.k - 1) * 250 + 500 end last_end from c join w using (doc_id)""")
def p18_chunk_bounds(s, d):
    docs = table(s, d, "documents").select("doc_id", X.chunk_bounds(F.col("n_chars"), F.lit(100)).alias("c"), X.window_bounds(F.col("n_chars"), F.lit(100)).alias("w"))
    return docs.select("doc_id", F.size("c").cast("long").alias("chunks"), F.get("c", F.lit(0))["end"].alias("first_end"), F.size("w").cast("long").alias("windows"), F.element_at("w", -1)["end"].alias("last_end"))


@query("select event_type, case when user_id % 10 = 0 then 'middle' when event_id % 96 < 32 then 'early' when event_id % 96 < 64 then 'middle' else 'late' end third, count(*) n from events group by 1, 2")
def p19_position_in_cycle(s, d):
    end = F.when(F.col("user_id") % 10 == 0, 5.0).otherwise(101.0)
    return table(s, d, "events").groupBy("event_type", X.position_in_cycle((F.col("event_id") % 96).cast("double") + 5, F.lit(5.0), end).alias("third")).agg(F.count("*").alias("n"))


@query("""with r as (select conv_id, count(*) filter (role = 'user') clips, coalesce(sum(turn + 1.5) filter (role = 'user'), 0)::double audio_s, coalesce(sum(length(text)), 0)::bigint chars from conversations group by 1)
select *, round(audio_s * 12.5 + chars / 4 + 512, 6) tokens, clips > 5 too_many_clips, audio_s * 12.5 + chars / 4 + 512 > 1024 too_long from r""")
def p20_prompt_budget(s, d):
    c = table(s, d, "conversations")
    seconds = F.when(F.col("role") == "user", F.col("turn") + F.lit(1.5))
    return rounded(Q.prompt_budget(c, ["conv_id"], seconds, F.length("text"), 512, 1024), "tokens")


@query("select conv_id, arg_max(text, turn) final_turn from conversations where role = 'assistant' group by 1")
def p21_final_turn(s, d):
    return Q.final_turn(table(s, d, "conversations"))


@query("""with r as (select *, row_number() over (partition by conv_id, role order by turn) i from conversations where role in ('user', 'assistant'))
select conv_id, string_agg(case when role = 'user' then 'Turn ' || i || ' - User: ' || coalesce(text, '') else 'Assistant: ' || coalesce(text, '') end, chr(10) order by i, role = 'assistant') transcript from r group by 1""")
def p21_accumulate_turns(s, d):
    return Q.accumulate_turns(table(s, d, "conversations"))


@query("select conv_id, turn, role, case when role = 'assistant' and turn < max(turn) over (partition by conv_id) then md5(trim(text)) else md5('<think>x</think>' || text) end shown from conversations")
def p22_history_messages(s, d):
    c = table(s, d, "conversations").withColumn("text", F.concat(F.lit("<think>x</think>"), "text"))
    return Q.history_messages(c).select("conv_id", "turn", "role", F.md5("text").alias("shown"))


@query("""with w as (select distinct doc_id from documents where doc_id % 3 = 0 union select doc_id from labels)
select w.doc_id item_id, d.lang reference, case when w.doc_id % 4 = 0 or d.doc_id is null then '[NO TRANSCRIPT]' else trim(d.source) end transcript from w left join documents d using (doc_id)""")
def p24_clean_transcripts(s, d):
    docs = table(s, d, "documents").withColumnRenamed("doc_id", "item_id")
    asr = docs.select("item_id", F.when(F.col("item_id") % 4 == 0, "   ").otherwise(F.concat(F.lit("  "), "source", F.lit(" "))).alias("transcript"))
    ids = [docs.filter("item_id % 3 = 0"), table(s, d, "labels").withColumnRenamed("doc_id", "item_id")]
    return Q.clean_transcripts(asr, docs.withColumnRenamed("lang", "reference"), ids)


@query("select l_orderkey k, l_partkey, max(l_linenumber) last_line, arg_max(l_quantity, (l_linenumber, l_suppkey, l_quantity)) quantity from lineitem group by 1, 2")
def w2_last_write_wins(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("ord"), F.col("l_quantity").alias("quantity"))
    return O.last_write_wins(rows, ["k", "l_partkey"], "ord").select("k", "l_partkey", F.col("ord.l_linenumber").alias("last_line"), "quantity")


def folders(s, d) -> DataFrame:
    o = table(s, d, "orders")
    name = F.concat(F.lit("set_"), F.lower("o_orderstatus"), F.lit("x_"), F.lpad((F.col("o_custkey") % 9 + 20240101).cast("string"), 8, "0"), F.lit("_"), F.lpad((F.col("o_orderkey") % 97 + 100000).cast("string"), 6, "0"))
    file = F.when(F.col("o_orderkey") % 3 == 0, "metrics.txt").otherwise("raw_output_1.jsonl")
    return o.select(F.concat_ws("/", F.lit("root"), F.concat(F.lit("model"), (F.col("o_custkey") % 2).cast("string")), name, file).alias("path"))


CATALOG = """(select 'root/model' || (o_custkey % 2) root, 'set_' || lower(o_orderstatus) || 'x_' || (o_custkey % 9 + 20240101) || '_' || (o_orderkey % 97 + 100000) run_dir, lower(o_orderstatus) || 'x' experiment,
(o_custkey % 9 + 20240101) || '_' || (o_orderkey % 97 + 100000) started, bool_or(o_orderkey % 3 = 0) finished from orders group by all)"""


@query(f"select * from {CATALOG}")
def s3_run_catalog(s, d):
    return I.run_catalog(folders(s, d), "set")


@query(f"select * from {CATALOG} where finished qualify row_number() over (partition by root, experiment order by started desc) = 1")
def w1_latest_finished_runs(s, d):
    return I.latest_finished_runs(I.run_catalog(folders(s, d), "set"), ["root", "experiment"])


@query("select c_custkey run_dir, coalesce(c_mktsegment || '-' || s_name, 'unrecorded') audio_model_id from customer left join supplier on s_suppkey = c_custkey")
def s4_attach_run_config(s, d):
    runs = table(s, d, "customer").select(F.col("c_custkey").alias("run_dir"), "c_mktsegment")
    cfg = table(s, d, "supplier").join(runs, F.col("s_suppkey") == F.col("run_dir")).select("run_dir", F.concat("c_mktsegment", F.lit("-"), "s_name").alias("audio_model_id"))
    return I.attach_run_config(runs.select("run_dir"), cfg)


@query("select doc_id item_id, coalesce('q' || quality, '[FEATURES UNAVAILABLE]') evidence, quality is null missing from documents left join labels using (doc_id)")
def j1_join_evidence(s, d):
    ev = table(s, d, "labels").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("evidence"))
    return Q.join_evidence(table(s, d, "documents").select(F.col("doc_id").alias("item_id")), ev, "evidence")


@query("select doc_id item_id from documents where doc_id in (select doc_id from labels) and doc_id % 7 <> 0 order by source, doc_id limit 50")
def j2_select_eval_rows(s, d):
    items = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "source")
    wanted = table(s, d, "labels").select(F.col("doc_id").alias("item_id"))
    return Q.select_eval_rows(items, wanted, items.filter("item_id % 7 = 0"), F.col("source"), 50).select("item_id")


@query("""with e as (select doc_id item_id from labels), m as (select doc_id item_id, (doc_id * 3) % 400 neighbor_id from documents)
select item_id, 'overlap' problem from e where item_id % 9 = 0 union select item_id, 'retrieves itself' from m where item_id = neighbor_id union select item_id, 'retrieves evaluated' from m where item_id <> neighbor_id and neighbor_id in (select item_id from e)""")
def j3_check_disjoint(s, d):
    e = table(s, d, "labels").select(F.col("doc_id").alias("item_id"))
    m = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") * 3 % 400).alias("neighbor_id"))
    return Q.check_disjoint(e, table(s, d, "documents").select(F.col("doc_id").alias("item_id")).filter("item_id % 9 = 0"), m)


@query("select doc_id item_id, 3 n, (select min(item_id) from benchmark) first_shot from documents")
def j4_attach_fixed_shots(s, d):
    shots = table(s, d, "benchmark").select(F.col("item_id").alias("shot_id"), F.col("text").alias("shot_text"))
    out = Q.attach_fixed_shots(table(s, d, "documents").select(F.col("doc_id").alias("item_id")), shots)
    return out.select("item_id", F.size("shots").alias("n"), F.get("shots", F.lit(0))["shot_id"].alias("first_shot"))


MAPPING = "(select doc_id item_id, r.\"rank\", (doc_id * 7 + r.\"rank\" * 11) % 120 neighbor_id from documents cross join (select unnest(range(6))::int \"rank\") r)"


@query(f"with f as (select item_id, \"rank\", neighbor_id from {MAPPING} where neighbor_id in (select item_id from benchmark) qualify row_number() over (partition by item_id order by \"rank\", neighbor_id) <= 4) select doc_id item_id, coalesce(n, 0)::int n, coalesce(ids, '') shot_ids from documents left join (select item_id, count(*) n, string_agg(neighbor_id, ',' order by \"rank\", neighbor_id) ids from f group by 1) x on x.item_id = doc_id")
def j5_attach_retrieved_shots(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("item_id"))
    mapping = docs.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("neighbor_id", (F.col("item_id") * 7 + F.col("rank") * 11) % 120)
    pool = table(s, d, "benchmark").select(F.col("item_id").alias("shot_id"), F.col("text").alias("shot_text"))
    out = Q.attach_retrieved_shots(docs, mapping, pool)
    return out.select("item_id", F.size("shots").alias("n"), F.array_join(F.transform("shots", lambda x: x["neighbor_id"].cast("string")), ",").alias("shot_ids"))


# --- metrics of judges -----------------------------------------------------------------------------------------------

JUDGED = "(select l_shipmode_ experiment, case when l_partkey % 13 = 0 then null else l_partkey % 11 end::int acoustic, (l_suppkey % 11)::int diagnostic, (l_orderkey % 2)::int hallucination, case l_partkey % 4 when 0 then 'No potential disease detected' when 1 then 'None' else l_returnflag end truth, case l_suppkey % 3 when 0 then 'No potential disease detected' else l_returnflag end predicted from (select *, l_linestatus l_shipmode_ from lineitem))"


def judged(s, d) -> DataFrame:
    k = lambda c: F.col(c)
    truth = F.when(k("l_partkey") % 4 == 0, X.HEALTHY_LABEL).when(k("l_partkey") % 4 == 1, "None").otherwise(k("l_returnflag"))
    return table(s, d, "lineitem").select(
        k("l_linestatus").alias("experiment"),
        F.when(k("l_partkey") % 13 != 0, k("l_partkey") % 11).cast("int").alias("acoustic"),
        (k("l_suppkey") % 11).cast("int").alias("diagnostic"),
        (k("l_orderkey") % 2).cast("int").alias("hallucination"),
        truth.alias("truth"),
        F.when(k("l_suppkey") % 3 == 0, X.HEALTHY_LABEL).otherwise(k("l_returnflag")).alias("predicted"),
    )


@query(f"select experiment, avg(coalesce(acoustic, 0)) * 10 acoustic_pct, avg(diagnostic) * 10 diagnostic_pct, avg(hallucination) * 100 hallucination_pct, count(*) n from {JUDGED} group by 1")
def a3_judge_score_metrics(s, d):
    return O.judge_score_metrics(judged(s, d), ["experiment"])


NORM = "(select *, case when truth = 'No potential disease detected' then 'Healthy' when truth in ('None', '') then 'Unknown' else truth end t, case when predicted = 'No potential disease detected' then 'Healthy' else predicted end p from {j})".format(j=JUDGED)


@query(f"""with n as {NORM}, l as (select experiment, t x from n union select experiment, p from n), f as (select experiment, x, 2.0 * (select count(*) from n where n.experiment = l.experiment and t = x and p = x) / ((select count(*) from n where n.experiment = l.experiment and t = x) + (select count(*) from n where n.experiment = l.experiment and p = x)) f1, (select count(*) from n where n.experiment = l.experiment and t = x) sup from l),
g as (select experiment, avg(f1) * 100 macro_f1_pct, sum(f1 * sup) / sum(sup) * 100 weighted_f1_pct from f group by 1),
b as (select experiment, avg(coalesce(acoustic, 0)) * 10 acoustic_pct, avg(diagnostic) * 10 diagnostic_pct, avg(hallucination) * 100 hallucination_pct, count(*)::double n from n group by 1), j as (select * from b join g using (experiment))
select experiment, metric, round(value, 6) "value" from j unpivot (value for metric in (acoustic_pct, diagnostic_pct, hallucination_pct, n, macro_f1_pct, weighted_f1_pct))""")
def r11_experiment_metrics(s, d):
    out = R.experiment_metrics(judged(s, d), ["experiment"]).withColumn("n", F.col("n").cast("double"))
    return rounded(R.melted(out, ["experiment"]), "value")


@query(f"select b.bin, coalesce(c.n, 0) n from (select unnest(range(1, 11)) bin) b left join (select least(10, acoustic + 1)::bigint bin, count(*) n from {JUDGED} where acoustic is not null group by 1) c using (bin)")
def a34_score_histogram(s, d):
    return O.score_histogram(judged(s, d), "acoustic")


@query(f"select b.bin, coalesce(hallucinated, 0) hallucinated, coalesce(clean, 0) clean from (select unnest(range(1, 11)) bin) b left join (select least(10, acoustic + 1)::bigint bin, count(*) filter (hallucination > 0) hallucinated, count(*) filter (hallucination = 0) clean from {JUDGED} where acoustic is not null group by 1) c using (bin)")
def a34_hallucinated_and_clean(s, d):
    return O.score_histogram(judged(s, d), "acoustic", sides={"hallucinated": F.col("hallucination") > 0, "clean": F.col("hallucination") == 0})


@query("select event_type, round(avg((event_id % 5 <> 4)::int::double) * 100, 6) usable_pct, count(*) filter (event_id % 5 = 4) fallbacks, count(*) n from events group by 1")
def a35_fallback_rate(s, d):
    text = F.when(F.col("event_id") % 5 == 4, "no span").otherwise('{"start": 1, "end": 2.5}')
    return rounded(E.fallback_rate(table(s, d, "events"), ["event_type"], text, F.lit(10.0)), "usable_pct")


# --- dataset diagnostics ---------------------------------------------------------------------------------------------


@query(f"""with i as {ITEMS}, c as (select lang, source, label, count(*) n, min(item_id) f, (list(item_id order by item_id))[2] f2 from i group by 1, 2, 3), g as (select label from i group by 1 order by count(*) desc, min(item_id) limit 1),
x as (select i.item_id, c.label l, c.n - (c.label = i.label)::int n, case when c.label = i.label and c.f = i.item_id then c.f2 else c.f end f from i join c using (lang, source))
select i.item_id, i.label, coalesce(b.l, (select label from g)) predicted from i left join (select item_id, l from x where n > 0 qualify row_number() over (partition by item_id order by n desc, f) = 1) b using (item_id)""")
def a18_loo_cell_majority(s, d):
    return D.loo_cell_majority(labelled(s, d), ["lang", "source"], "label", "item_id").select("item_id", "label", "predicted")


@query(f"""with i as {ITEMS}, c as (select lang, label, count(*) n, min(item_id) f, (list(item_id order by item_id))[2] f2 from i group by 1, 2), g as (select label from i group by 1 order by count(*) desc, min(item_id) limit 1),
x as (select i.item_id, c.label l, c.n - (c.label = i.label)::int n, case when c.label = i.label and c.f = i.item_id then c.f2 else c.f end f from i join c using (lang)),
p as (select i.item_id, i.label, 'cell majority' rule, coalesce(b.l, (select label from g)) q from i left join (select item_id, l from x where n > 0 qualify row_number() over (partition by item_id order by n desc, f) = 1) b using (item_id) union all select item_id, label, 'fixed rule', case when lang = 'en' then '1/0' else '0/0' end from i),
r as (select rule, label, avg((q = label)::int::double) rec, count(*) n from p group by 1, 2), o as (select rule, round(sum(rec * n) / sum(n) * 100, 6) accuracy_pct, round(avg(rec) * 100, 6) ba_pct from r group by 1)
select *, max(ba_pct) over () ceiling from o""")
def a19_metadata_ceiling(s, d):
    i = labelled(s, d)
    rules = {"cell majority": D.loo_cell_majority(i, ["lang"], "label", "item_id"), "fixed rule": i.withColumn("predicted", F.when(F.col("lang") == "en", "1/0").otherwise("0/0"))}
    return rounded(R.metadata_ceiling(i, "label", rules), "accuracy_pct", "ba_pct", "ceiling")


@query("with n as (select md5(coalesce(text, '')) k, count(*) c from documents group by 1) select sum(c)::bigint entries, round(max(c) / sum(c), 9) top_share, sum(c) >= 10 and max(c) / sum(c) > 0.5 rejected from n")
def a20_degenerate_text(s, d):
    return rounded(D.degenerate_text(table(s, d, "documents"), "text"), "top_share", digits=9)


@query(f"with i as {ITEMS} select coalesce(a.label, b.label) label, coalesce(a.n, 0) n_all, coalesce(b.n, 0) n_eval from (select label, count(*) n from i group by 1) a full join (select label, count(*) n from i where item_id % 10 = 3 group by 1) b using (label)")
def a21_label_counts(s, d):
    i = labelled(s, d)
    return D.label_counts(i, i.filter("item_id % 10 = 3"), "label")


@query("select min(n_chars / 16.0)::double min_s, median(n_chars / 16.0)::double median_s, max(n_chars / 16.0)::double max_s, array_to_string(list_sort(list(distinct 8000 + doc_id % 3)), ',') rates from documents")
def a22_duration_summary(s, d):
    out = D.duration_summary(table(s, d, "documents"), F.col("n_chars") / 16.0, 8000 + F.col("doc_id") % 3)
    return out.withColumn("rates", F.array_join(F.col("rates").cast("array<string>"), ","))


TWINS = "(select a.doc_id left_id, b.doc_id right_id from documents a join documents b on a.text = b.text and a.doc_id <> b.doc_id)"


def twins(s, d) -> DataFrame:
    """Group of equal documents that each document is in."""
    docs = table(s, d, "documents").filter("text is not null")
    return docs.select(F.col("doc_id").alias("item_id"), F.concat_ws(":", F.md5("text"), F.length("text").cast("string")).alias("group"))


@query(f"""with t as {TWINS}, i as {ITEMS}, n as (select left_id, count(*) c from t group by 1),
e as (select item_id from i left join n on left_id = item_id qualify row_number() over (partition by label order by coalesce(c, 0), md5('2017:' || item_id), item_id) = 1)
select item_id, 'demonstration' role from e union all select distinct right_id, 'held_out' from t where left_id in (select item_id from e) and right_id not in (select item_id from e)""")
def w10_demo_split(s, d):
    return D.demo_split(labelled(s, d), D.group_sizes(twins(s, d)), "label", groups=twins(s, d))


@query(f"""with i as {ITEMS}, c as (select label, count(*) c, round_even(count(*) / sum(count(*)) over () * 60, 0)::bigint t, row_number() over (order by count(*) desc, label) k from i group by 1), g as (select label, least(c, t + case when k = 1 then 60 - sum(t) over () else 0 end) t from c)
select item_id, label from i join g using (label) qualify row_number() over (partition by label order by md5('42:' || item_id), item_id) <= any_value(t) over (partition by label)""")
def w11_proportional_sample(s, d):
    return D.proportional_sample(labelled(s, d), "label", 60, "item_id").select("item_id", "label")


@query(f"with i as {ITEMS} select a.lang, b.label, (select count(*) from i where i.lang = a.lang and i.label = b.label) n from (select distinct lang from i) a cross join (select distinct label from i) b")
def r10_contingency(s, d):
    return D.contingency(labelled(s, d), "lang", "label")


#: Equal documents, each next to the first of its group, in both directions: the near-duplicates of vectors of those ids.
SAME = "(select doc_id l, m r from (select doc_id, min(doc_id) over (partition by text) m from documents where text is not null) where doc_id <> m)"
DUPS = f"(select l, r from {SAME} union all select r, l from {SAME})"
VEC = "(select vec_id, embedding::double[] e, label, vec_id in (select doc_id from labels) pooled from embeddings where embedding is not null)"
KNN = f"""(select item_id, neighbor_id, score, row_number() over (partition by item_id order by score desc, neighbor_id) "rank" from (
select q.vec_id item_id, p.vec_id neighbor_id, case when (q.vec_id, p.vec_id) in (select (l, r) from {DUPS}) then '-inf'::double else list_cosine_similarity(q.e, p.e) end score from {VEC} q join {VEC} p on not q.pooled and p.pooled))"""


def same_documents(s, d) -> DataFrame:
    """Each copy of a document and the first of its group, in both directions: as many pairs as copies."""
    groups = twins(s, d)
    first = groups.groupBy("group").agg(F.min("item_id").alias("first"))
    pairs = groups.join(first, "group").filter("item_id <> first")
    return pairs.select(F.col("item_id").alias("left_id"), F.col("first").alias("right_id")).union(pairs.select("first", "item_id"))


def nearest(s, d) -> DataFrame:
    """Neighbours among the vectors whose id has a label, for all the others."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    good, _ = K.usable_vectors(v)
    pool = good.join(table(s, d, "labels").select(F.col("doc_id").alias("item_id")).distinct(), "item_id", "left_semi")
    return K.knn(good, pool, same_documents(s, d), 3)


@query(f"select item_id, \"rank\"::int \"rank\", neighbor_id, round(score, 6) score from {KNN} where \"rank\" <= 3")
def j11_knn(s, d):
    return rounded(nearest(s, d), "score")


@query(f"""with n as (select item_id, "rank" k, neighbor_id from {KNN} where "rank" <= 3), c as (select n.item_id, l.label nl, count(*) c, min(k) k from n join embeddings l on l.vec_id = neighbor_id group by 1, 2)
select c.item_id, nl predicted, e.label from c join embeddings e on e.vec_id = c.item_id qualify row_number() over (partition by c.item_id order by c desc, k) = 1""")
def a17_knn_vote(s, d):
    return K.knn_vote(nearest(s, d), table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "label"))


@query(f"select count(*) items, round(avg((predicted = label)::int::double) * 100, 6) accuracy_pct from ({SQL['a17_knn_vote']})")
def a17_vote_accuracy(s, d):
    """How often the neighbours' majority is the query's own label."""
    return rounded(K.vote_accuracy(a17_knn_vote(s, d)), "accuracy_pct")


# --- timed events ----------------------------------------------------------------------------------------------------

WORDS = "(select user_id item_id, event_id word_idx, event_type word, (epoch(ts) - 1704067200)::double start_s, (epoch(ts) - 1704067200)::double + 5 + event_id % 40 end_s from (select event_id, user_id, event_type, date_trunc('second', ts) ts from events))"
TURNS = "(select user_id item_id, event_id turn_idx, start_s - 20 start_s, start_s + 400 end_s, 'R' || event_id % 3 speaker from (select user_id, event_id, (epoch(date_trunc('second', ts)) - 1704067200)::double start_s from events where event_id % 3 = 0))"


def clock(s, d) -> DataFrame:
    t = (F.unix_timestamp(F.date_trunc("second", F.col("ts"))) - 1704067200).cast("double")
    return table(s, d, "events").select(F.col("user_id").alias("item_id"), "event_id", "event_type", t.alias("t"), "value")


def words(s, d) -> DataFrame:
    return clock(s, d).select("item_id", F.col("event_id").alias("word_idx"), F.col("event_type").alias("word"), F.col("t").alias("start_s"), (F.col("t") + 5 + F.col("event_id") % 40).alias("end_s"))


def turns(s, d) -> DataFrame:
    return clock(s, d).filter("event_id % 3 = 0").select("item_id", F.col("event_id").alias("turn_idx"), (F.col("t") - 20).alias("start_s"), (F.col("t") + 400).alias("end_s"), F.concat(F.lit("R"), (F.col("event_id") % 3 + F.col("event_id") % 2).cast("string")).alias("speaker"))


TURNS = TURNS.replace("'R' || event_id % 3", "'R' || (event_id % 3 + event_id % 2)")
SPOKEN = f"""(select w.item_id, w.word_idx, w.word, w.start_s, w.end_s, coalesce(o.speaker, n.speaker, 'SPK1') speaker from {WORDS} w
left join (select w.item_id, w.word_idx, t.speaker from {WORDS} w join {TURNS} t on w.item_id = t.item_id and least(w.end_s, t.end_s) > greatest(w.start_s, t.start_s) qualify row_number() over (partition by w.item_id, w.word_idx order by least(w.end_s, t.end_s) - greatest(w.start_s, t.start_s) desc, turn_idx) = 1) o using (item_id, word_idx)
left join (select w.item_id, w.word_idx, t.speaker from {WORDS} w join {TURNS} t on w.item_id = t.item_id qualify row_number() over (partition by w.item_id, w.word_idx order by abs((t.start_s + t.end_s) / 2 - (w.start_s + w.end_s) / 2), turn_idx) = 1) n using (item_id, word_idx))"""


@query(f"select item_id, word_idx, speaker from {SPOKEN}")
def j9_assign_speakers(s, d):
    return E.assign_speakers(words(s, d), turns(s, d)).select("item_id", "word_idx", "speaker")


def spoken(s, d) -> DataFrame:
    """Words with a speaker taken from their id, cheap enough for the jobs that only need one."""
    return words(s, d).withColumn("speaker", F.concat(F.lit("R"), F.floor(F.col("word_idx") / 700).cast("long") % 2))


SPEAK = f"(select *, 'R' || (word_idx // 700) % 2 speaker from {WORDS})"


@query(f"""with f as (select item_id, speaker, min(word_idx) pos, 0 late from {SPEAK} group by 1, 2 union all select item_id, speaker, min(turn_idx), 1 from {TURNS} group by 1, 2), g as (select item_id, speaker, min((late, pos)) k from f group by 1, 2)
select item_id, speaker, 'SPK' || row_number() over (partition by item_id order by k) "name" from g""")
def w4_rename_by_first_appearance(s, d):
    return E.rename_by_first_appearance(spoken(s, d), turns(s, d))


@query(f"""with l as (select *, coalesce((speaker <> lag(speaker) over (partition by item_id order by word_idx))::int, 1) c from {SPEAK}), g as (select *, sum(c) over (partition by item_id order by word_idx rows unbounded preceding) k from l)
select item_id, min(word_idx) "first", printf('[%.1f-%.1f] %s: %s', arg_min(start_s, word_idx), arg_max(end_s, word_idx), any_value(speaker), string_agg(word, ' ' order by word_idx)) line from g group by item_id, k""")
def w3_diarized_lines(s, d):
    return E.diarized_lines(spoken(s, d))


@query(f"""with g as (select *, lead(start_s) over (partition by item_id, speaker order by word_idx) - end_s gap from {SPEAK})
select item_id, speaker, round(count(*) / sum(end_s - start_s), 6) words_per_s, count(*) filter (gap >= 0.25) pauses, round(coalesce(avg(gap) filter (gap >= 0.25), 0), 6) mean_pause_s from g group by 1, 2""")
def a30_speaker_rates(s, d):
    return rounded(E.speaker_rates(spoken(s, d)), "words_per_s", "mean_pause_s")


@query("with s as (select user_id item_id, event_type speaker, sum(value * value) s, count(value) n from events group by 1, 2) select item_id, speaker, round(20 * log10((sqrt(s / n) + 1e-10) / (sqrt(sum(s) over (partition by item_id) / sum(n) over (partition by item_id)) + 1e-10)), 6) loudness_db from s")
def a31_loudness(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("speaker"), "value")
    return rounded(E.loudness(e, ["item_id", "speaker"], "value"), "loudness_db")


@query("""with f as (select user_id, event_id, value > 20 flag, row_number() over (partition by user_id order by event_id) i from events), g as (select *, coalesce((flag is distinct from lag(flag) over (partition by user_id order by i))::int, 1) c from f), h as (select *, sum(c) over (partition by user_id order by i rows unbounded preceding) k from g)
select user_id, min(event_id) "start", max(event_id) "end", count(*) n from h where flag group by user_id, k having count(*) >= 2""")
def w5_flag_runs(s, d):
    e = table(s, d, "events").select("user_id", "event_id", (F.col("value") > 20).alias("flag"))
    return E.flag_runs(e, ["user_id"], "event_id", "flag", 2)


TAGGED = "(select user_id item_id, (event_id % 4 * 5)::double start_s, (event_id % 4 * 5 + 5)::double end_s, event_type || '-' || (event_id % 6) tag, (event_id % 89)::double / 89 score, event_type from events)"


@query(f"""with t as (select * from {TAGGED} where event_type in ('click', 'view') qualify row_number() over (partition by item_id, start_s order by score desc, tag) <= 5),
l as (select item_id, start_s, printf('%.1f-%.1f s: ', start_s, end_s) || string_agg(printf('%s %.2f', tag, score), ', ' order by score desc, tag) line from t group by item_id, start_s, end_s), x as (select item_id, string_agg(line, chr(10) order by start_s) summary from l group by 1)
select i.item_id, coalesce(summary, 'No whitelisted audio-tagger categories fired.') summary from (select distinct user_id item_id from events) i left join x using (item_id)""")
def w6_top_tags(s, d):
    e = table(s, d, "events")
    rows = e.select(F.col("user_id").alias("item_id"), (F.col("event_id") % 4 * 5).cast("double").alias("start_s"), (F.col("event_id") % 4 * 5 + 5).cast("double").alias("end_s"), F.concat_ws("-", "event_type", (F.col("event_id") % 6).cast("string")).alias("tag"), ((F.col("event_id") % 89).cast("double") / 89).alias("score"))
    return E.top_tags(rows, [f"{t}-{k}" for t in ("click", "view") for k in range(6)])


CLOCK = "(select user_id item_id, event_id, event_type, (epoch(date_trunc('second', ts)) - 1704067200)::double t from events)"
CYCLES = f"(select item_id, event_id cycle_idx, t start_s, t + 5000 + event_id % 7 * 1000 end_s from {CLOCK} where event_id % 4 = 0)"
PLACED = f"""(select e.item_id, e.event_id event_idx, e.event_type kind, c.cycle_idx, case when c.cycle_idx is null then 'middle' when (e.t - cs) / (ce - cs) < 1.0 / 3 then 'early' when (e.t - cs) / (ce - cs) < 2.0 / 3 then 'middle' else 'late' end third from (select * from {CLOCK} where event_id % 4 <> 0) e
left join (select e.event_id, c.cycle_idx, c.start_s cs, c.end_s ce from {CLOCK} e join {CYCLES} c on e.item_id = c.item_id and e.t between c.start_s and c.end_s qualify row_number() over (partition by e.event_id order by cycle_idx) = 1) c using (event_id))"""


def cycles(s, d) -> DataFrame:
    return clock(s, d).filter("event_id % 4 = 0").select("item_id", F.col("event_id").alias("cycle_idx"), F.col("t").alias("start_s"), (F.col("t") + 5000 + F.col("event_id") % 7 * 1000).alias("end_s"))


def placed(s, d) -> DataFrame:
    e = clock(s, d).filter("event_id % 4 <> 0").select("item_id", F.col("event_id").alias("event_idx"), "t", F.col("event_type").alias("kind"))
    return E.events_in_cycles(e, cycles(s, d))


@query(f"select item_id, event_idx, coalesce(cycle_idx, -1) cycle_idx, third from {PLACED}")
def j10_events_in_cycles(s, d):
    return placed(s, d).select("item_id", "event_idx", F.coalesce("cycle_idx", F.lit(-1)).alias("cycle_idx"), "third")


@query(f"select item_id, coalesce(cycle_idx, -1) cycle_idx, third, kind, count(*) n from {PLACED} group by 1, 2, 3, 4")
def a32_crackle_counts(s, d):
    return E.crackle_counts(placed(s, d)).withColumn("cycle_idx", F.coalesce("cycle_idx", F.lit(-1)))


@query(f"select item_id, round(60 * count(*) / (max(end_s) - min(start_s)), 9) rate_per_min, count(*) cycles, avg(end_s - start_s) mean_length_s from {CYCLES} group by 1")
def a33_cycle_summary(s, d):
    return rounded(E.cycle_summary(cycles(s, d)), "rate_per_min", digits=9)


@query(f"select count(*) clips, count(c.item_id) with_cycles, round(count(c.item_id) / count(*) * 100, 6) share_pct from (select distinct user_id item_id from events) e left join (select distinct item_id from {CYCLES}) c using (item_id)")
def a35_cycle_share(s, d):
    """Share of clips in which any cycle was found."""
    clips_ = clock(s, d).select("item_id").distinct()
    return rounded(E.cycle_share(clips_, cycles(s, d)), "share_pct")


SAMPLES = "(select user_id item_id, row_number() over (partition by user_id order by event_id) - 1 idx, value x from events)"


def samples(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("item_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx"), F.col("value").alias("x"))


@query(f"with f as (select item_id, (idx + 2) // 4 frame, sqrt(sum(x * x) / 4) r from {SAMPLES} group by 1, 2) select item_id, frame::bigint frame, round(r, 6) rms, round(sum(r) over (partition by item_id order by frame rows between 5 preceding and 4 following) / 10, 6) smoothed from f")
def w8_rms_envelope(s, d):
    return rounded(E.rms_envelope(samples(s, d), 4), "rms", "smoothed")


@query(f"""with c as (select item_id, idx // 10 cycle_idx, idx, x from {SAMPLES}), p as (select item_id, cycle_idx, count(*) n, min(idx) a, arg_min(idx, (-abs(x), idx)) k from c group by 1, 2)
select item_id, round(median((k - a) / (n - (k - a))), 6) ie_ratio from p where n >= 3 and k > a group by 1""")
def w12_ie_ratio(s, d):
    x = samples(s, d).select("item_id", F.col("idx").cast("double").alias("t"), "x", F.lit(1.0).alias("step"))
    c = x.groupBy("item_id", F.floor(F.col("t") / 10).alias("cycle_idx")).agg((F.min(F.floor(F.col("t") / 10)) * 10).cast("double").alias("start_s")).withColumn("end_s", F.col("start_s") + 10)
    return rounded(E.ie_ratio(x, c), "ie_ratio")


@query("""with recursive p as (select distinct user_id, round(value * 10, 1) p from events where value is not null), t as (select user_id, min(p) p from p group by 1 union all select t.user_id, min(p.p) from t join p on p.user_id = t.user_id and p.p - t.p > 100 group by 1)
select user_id, list(p order by p) tones from t group by 1""")
def t3_peak_clusters(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.collect_list(F.col("value") * 10).alias("peaks"))
    return e.select("user_id", E.peak_clusters(F.col("peaks")).alias("tones"))


def signals(s, d) -> DataFrame:
    """Each user's values as a signal, and for every fourth user a second one that is cut from it (a negative id)."""
    rows = samples(s, d).groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda v: v["x"]).alias("samples"))
    cut = rows.filter("item_id % 4 = 0").select((-F.col("item_id") - 1).alias("item_id"), F.slice("samples", 6, F.size("samples")).alias("samples"))
    return rows.union(cut)


SIGNALS = f"(select item_id, idx, x from {SAMPLES} union all select -item_id - 1, idx - 5, x from {SAMPLES} where idx >= 5 and item_id % 4 = 0)"


@query(f"""with s as materialized {SIGNALS}, c as (select a.item_id l, b.item_id r, a.idx - b.idx lag, corr(a.x, b.x) c from s a join s b on a.item_id < b.item_id group by 1, 2, 3 having count(*) >= 24)
select left_id, right_id, round(max(c), 5) corr from (select l left_id, r right_id, c from c union all select r, l, c from c) group by 1, 2 having max(c) >= 0.8""")
def j12_near_duplicates(s, d):
    return rounded(U.near_duplicates(signals(s, d), 24, 0.8), "corr", digits=5)


@query(f"""select 'labels' part, label "name", n_all::double "value" from ({SQL['a21_label_counts']}) union all select 'evaluation labels', label, n_eval::double from ({SQL['a21_label_counts']})
union all select 'contingency', concat_ws(' ', lang, label), n::double from ({SQL['r10_contingency']})
union all select 'rules', rule, ba_pct from ({SQL['a19_metadata_ceiling']}) union all select 'rule accuracy', rule, accuracy_pct from ({SQL['a19_metadata_ceiling']}) union all select 'ceiling', 'ba_pct', max(ceiling) from ({SQL['a19_metadata_ceiling']})
union all select 'durations', name, value from (select min_s, median_s, max_s from ({SQL['a22_duration_summary']})) unpivot (value for name in (min_s, median_s, max_s))
union all select 'rates', r, r::double from (select unnest(string_split(rates, ',')) r from ({SQL['a22_duration_summary']}))
union all select 'split', role, count(*)::double from ({SQL['w10_demo_split']}) group by 2 union all select role, item_id::varchar, 1.0 from ({SQL['w10_demo_split']})
union all select 'near-duplicates', 'clips', count(distinct left_id)::double from ({SQL['j12_near_duplicates']}) union all select 'near-duplicates', 'pairs', count(*) / 2.0 from ({SQL['j12_near_duplicates']})""")
def r10_dataset_report(s, d):
    """Label counts, the contingency of language, rule baselines, durations, held-out rows and duplicates in one long table.

    Label counts, contingency and the rule that goes by language are read off one cube of counts; each other part is
    made once and stored, as it is small.
    """
    i = stored(labelled(s, d))
    cube = stored(i.groupBy("lang", "label", (F.col("item_id") % 10 == 3).alias("evaluated")).agg(F.count("*").alias("n")))
    counts = cube.groupBy("label").agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(F.when(F.col("evaluated"), F.col("n"))), F.lit(0)).alias("n_eval"))
    cells = cube.groupBy("lang", "label").agg(F.sum("n").alias("n"))
    by_language = cells.select("label", (F.col("label") == F.when(F.col("lang") == "en", "1/0").otherwise("0/0")).alias("hit"), "n")
    fixed = by_language.groupBy("label").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("right"))
    fixed = fixed.agg((F.sum("right") / F.sum("n") * 100).alias("accuracy_pct"), (F.avg(F.col("right") / F.col("n")) * 100).alias("ba_pct")).withColumn("rule", F.lit("fixed rule"))
    majority = D.rule_scores(D.loo_cell_majority(i, ["lang"], "label", "item_id"), "label", "predicted").withColumn("rule", F.lit("cell majority"))
    rules = stored(fixed.unionByName(majority))
    lengths = stored(D.duration_summary(table(s, d, "documents"), F.col("n_chars") / 16.0, 8000 + F.col("doc_id") % 3))
    split = stored(D.demo_split(i, D.group_sizes(twins(s, d)), "label", groups=twins(s, d)))
    same = stored(U.near_duplicates(signals(s, d), 24, 0.8))
    # One row for each part: names and values.
    grid = cells.agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.array_sort(F.collect_set("label")).alias("labels"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "lang", "label"), "n"))).alias("n"))
    pair = F.flatten(F.transform("langs", lambda x: F.transform("labels", lambda y: F.concat_ws(" ", x, y))))
    grid = grid.select(F.explode(F.transform(pair, lambda c: F.struct(c.alias("name"), F.coalesce(F.col("n")[c], F.lit(0)).alias("value")))).alias("c"))
    long = lambda df, *cols: df.select(F.explode(F.array(*[F.struct((F.lit(part) if isinstance(part, str) else part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value")) for part, name, value in cols])).alias("r")).select("r.*")
    c = F.col
    parts = [
        long(counts, ("labels", c("label"), c("n_all")), ("evaluation labels", c("label"), c("n_eval"))),
        long(grid, ("contingency", c("c.name"), c("c.value"))),
        long(rules, ("rules", c("rule"), c("ba_pct")), ("rule accuracy", c("rule"), c("accuracy_pct"))),
        long(rules.agg(F.max("ba_pct").alias("x")), ("ceiling", F.lit("ba_pct"), c("x"))),
        long(lengths, *[("durations", F.lit(x), c(x)) for x in ("min_s", "median_s", "max_s")]),
        long(lengths.select(F.explode("rates").alias("r")), ("rates", c("r"), c("r"))),
        long(split.groupBy("role").agg(F.count("*").alias("n")), ("split", c("role"), c("n"))),
        long(split, (c("role"), c("item_id"), F.lit(1.0))),
        long(same.agg(F.count_distinct("left_id").alias("k"), (F.count("*") / 2).alias("n")), ("near-duplicates", F.lit("clips"), c("k")), ("near-duplicates", F.lit("pairs"), c("n"))),
    ]
    return rounded(reduce(DataFrame.union, parts), "value")


def long_clips(s, d) -> DataFrame:
    """Clips of 40,000 samples: the characters of 64 documents one after another; of every fourth one a second cut."""
    docs = table(s, d, "documents").filter("text is not null").groupBy(F.floor(F.col("doc_id") / 64).alias("item_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("t"))
    rows = docs.filter(F.length("t") >= 45_000)
    cut = rows.filter("item_id % 4 = 0").select((-F.col("item_id") - 1).alias("item_id"), F.substring("t", 5001, 40_000).alias("t"))
    whole = rows.select("item_id", F.substring("t", 1, 40_000).alias("t"))
    return whole.union(cut).select("item_id", F.transform(F.split("t", ""), lambda c: F.ascii(c).cast("double")).alias("samples"))


@query()
def j12_long_clips(s, d):
    """Near-duplicates among clips of the length that recordings have, through the index."""
    return rounded(U.indexed_duplicates(long_clips(s, d), 10_000, 0.8), "corr", digits=5)


def clips(s, d) -> DataFrame:
    """Every document as a recording: the bytes of its text are 8-bit samples at 1 kHz."""
    docs = table(s, d, "documents").filter("text is not null")
    return docs.select(F.col("doc_id").alias("item_id"), F.lit(1000).alias("sample_rate"), F.encode("text", "UTF-8").alias("samples"))


@query()
def f3_clip_evidence(s, d):
    return G.clip_evidence(clips(s, d))


@query()
def f1_detect_wheezes(s, d):
    return G.detect_wheezes(clips(s, d))


@query()
def f2_detect_crackles(s, d):
    return G.detect_crackles(clips(s, d))


@query()
def w9_segment_cycles(s, d):
    return G.segment_cycles(clips(s, d))


def pieces(s, d) -> DataFrame:
    """The same recordings in pieces of 4,096 samples, as long ones come."""
    whole = clips(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("samples") / 4096).cast("int") - 1))))
    return whole.select("item_id", "sample_rate", (F.col("k") * 4096).cast("long").alias("start"), F.substring("samples", F.col("k") * 4096 + 1, F.lit(4096)).alias("samples"))


@query()
def f1_wheezes_in_pieces(s, d):
    return G.wheezes_in_pieces(pieces(s, d))


@query()
def w9_cycles_in_pieces(s, d):
    return G.cycles_in_pieces(pieces(s, d))
