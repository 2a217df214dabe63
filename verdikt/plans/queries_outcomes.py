"""Queries over the derived answer tables (answers, votes, metrics, comparisons, reports) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compare as C
from ..operators import outcomes as O
from ..operators import requests as Q
from ..operators import stats as S
from ..sources.store import stored
from . import derived as V
from . import reports as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
ARM = O.ARM


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def parsed(s: SparkSession, d: str) -> DataFrame:
    return O.parsed(V.responses(s, d))


def parsed_once(s: SparkSession, d: str) -> DataFrame:
    """Parsed answers for jobs that read them more than once."""
    return stored(parsed(s, d))


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return O.outcomes(parsed(s, d))


def majority(s: SparkSession, d: str) -> DataFrame:
    return O.majority_correct(outcomes(s, d))


R_, O_, M_ = f"({V.SQL_RESPONSES})", f"({V.SQL_OUTCOMES})", f"({V.SQL_MAJORITY})"
ANSWER = f"coalesce(list_extract({V.CHOICES!r}, ascii(letter) - 64), '(unparsed)')"
PCT = "avg(({})::int::double) * 100"
MCNEMAR = """case when {w} + {l} = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, least({w}, {l}) + 1),
  lambda k: exp(lgamma(({w} + {l} + 1)::double) - lgamma((k + 1)::double) - lgamma(({w} + {l} - k + 1)::double) - ({w} + {l}) * ln(2.0))))) end"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"select model, experiment, run_idx, letter, count(*) n, sum(said_idx)::bigint meant from {R_} group by 1, 2, 3, 4")
def p8_parse_choice_letter(s, d):
    """Letters parsed out of every answer text, counted by arm and run."""
    rows = X.with_letter(V.responses(s, d, "said_idx"))
    return rows.groupBy("model", "experiment", "run_idx", "letter").agg(F.count("*").alias("n"), F.sum("said_idx").alias("meant"))


@query(f"select model, case when template = 4 then null else letter end letter, count(*) n, sum(said_idx)::bigint meant from {R_} where experiment = 'baseline' and run_idx = 1 group by 1, 2")
def p8_long_answers(s, d):
    """Letters of answers behind some 3,200 characters of reasoning, as long as such answers are."""
    thought = "Listening once more, the sound might well be several things at once; nothing in it settles the matter so far. "
    rows = V.responses(s, d, "said_idx").filter("experiment = 'baseline' and run_idx = 1")
    rows = X.with_letter(rows.withColumn("text", F.concat(F.repeat(F.lit(thought), F.lit(29)), F.lit("\n"), F.col("text"))))
    return rows.groupBy("model", "letter").agg(F.count("*").alias("n"), F.sum("said_idx").alias("meant"))


@query(f"select model, template = 6 or template = 7 as had_thinking, count(*) n, sum(case when template = 7 then 0 when template = 6 then 1 else 0 end)::bigint left_over from {R_} group by 1, 2")
def p7_strip_thinking(s, d):
    rows = V.responses(s, d).withColumn("t", X.strip_thinking(F.col("text"))).withColumn("h", F.col("text").startswith("<think>"))
    return rows.groupBy("model", F.col("h").alias("had_thinking")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("h"), F.length("t")).otherwise(0)).alias("left_over"))


@query(f"select experiment, count(*) filter (template = 4) matched, count(*) filter (template = 4 and said_idx = 3) speakers from {R_} group by 1")
def p4_match_choice_text(s, d):
    odd = F.concat(F.lit("  '"), F.upper("text"), F.lit("'. "))
    rows = V.responses(s, d).withColumn("m", X.match_choice_text(odd, F.col("choices")))
    return rows.groupBy("experiment").agg(F.count("m").alias("matched"), F.count_if(F.col("m") == "D").alias("speakers"))


@query("select o_orderkey item_id, chr((65 + o_orderkey % 4)::int) letter, (o_orderkey % 4)::int idx, 'A. ' || o_orderpriority || chr(10) || 'B. ' || o_orderstatus lettered from orders")
def p5_letters(s, d):
    o = V.table(s, d, "orders")
    letter = X.letter_for_index((F.col("o_orderkey") % 4).cast("int"))
    return o.select(F.col("o_orderkey").alias("item_id"), letter.alias("letter"), X.index_for_letter(letter).alias("idx"), X.format_lettered_choices(F.array("o_orderpriority", "o_orderstatus")).alias("lettered"))


@query(f"select item_id, chr(65 + gold_idx) letter from {R_} where model = 'm1' and experiment = 'baseline' and run_idx = 1")
def p6_answer_to_letter(s, d):
    """Gold answers given as text, with odd case and spacing, to letters."""
    rows = V.responses(s, d).filter("model = 'm1' and experiment = 'baseline' and run_idx = 1")
    gold = F.concat(F.lit(" "), F.upper(X.answer_text(F.col("gold"), F.col("choices"))), F.lit("  "))
    return rows.select("item_id", X.answer_to_letter(gold, F.col("choices")).alias("letter"))


@query(f"select model, experiment, {PCT.format('template = 8')} switched_pct, count(*) filter (template = 8) contains from {R_} group by 1, 2")
def p9_non_english(s, d):
    return V.responses(s, d).groupBy(*ARM).agg(O.pct(X.is_non_english(F.col("text"))).alias("switched_pct"), F.count_if(X.contains_cjk(F.col("text"))).alias("contains"))


@query(f"select model, experiment, {ANSWER} answer, count(*) n from {R_} group by 1, 2, 3")
def p10_answer_text(s, d):
    return parsed(s, d).groupBy(*ARM, "answer").agg(F.count("*").alias("n"))


@query(f"select model, experiment, run_idx, count(*) filter (correct) n_right, count(*) n from {O_} group by 1, 2, 3")
def p11_is_correct(s, d):
    rows = parsed(s, d)
    ok = X.is_correct(F.col("letter"), F.col("gold"), F.col("choices"), F.lit(None).cast("int"))
    return rows.groupBy(*O.RUN).agg(F.count_if(ok).alias("n_right"), F.count("*").alias("n"))


def judged(s, d):
    """A judge that reads the intended letter, wrong for some items."""
    letter = F.when(F.col("item_id") % 11 == 0, "Unknown").otherwise(F.concat(F.lit(" "), F.chr(F.lit(65) + F.col("said_idx"))))
    return O.parsed(V.responses(s, d, "said_idx")).withColumn("judged", letter)


J_ = f"(select *, case when item_id % 11 = 0 then 'Unknown' else chr(65 + said_idx) end judged from {R_})"


@query(f"select model, experiment, run_idx, {PCT.format('coalesce(letter = gold, false)')} accuracy_pct, {PCT.format('judged = gold')} judge_accuracy_pct, {PCT.format('letter is null')} unparsed_pct, {PCT.format(chr(40) + 'coalesce(letter, ' + chr(39) + 'Unknown' + chr(39) + ') = judged)')} agreement_pct, {PCT.format('template = 8')} non_english_pct from {J_} group by 1, 2, 3")
def a1_choice_metrics(s, d):
    return O.choice_metrics(judged(s, d))


@query(f"select model, experiment, coalesce(nullif(category, ''), 'Unknown') category, {PCT.format('correct')} accuracy_pct, count(*) n from {O_} group by 1, 2, 3 having count(*) >= 5")
def a2_category_report(s, d):
    return O.category_report(outcomes(s, d), ARM, least=5)


@query(f"select model, experiment, item_id, correct, 3::bigint n_runs, category from {M_}")
def a4_majority_correct(s, d):
    return majority(s, d)


BA = "select {by}, avg(r) * 100 balanced_accuracy, count(*) classes from (select {by}, category, avg(correct::int::double) r from {t} group by all) group by all"


@query(BA.format(by="model, experiment", t=M_))
def a5_balanced_accuracy(s, d):
    return O.balanced_accuracy(majority(s, d), ARM, "category", F.col("correct"))


@query(f"select model, experiment, avg(r) * 100 balanced_accuracy, count(*) classes from (select model, experiment, gold = 'D' pos, avg(((letter = 'D') is not distinct from (gold = 'D') and letter is not null or (letter is null and gold <> 'D'))::int::double) r from {R_} group by 1, 2, 3) group by 1, 2")
def a6_binary_balanced_accuracy(s, d):
    rows = parsed(s, d).withColumn("pos", F.col("gold") == "D")
    return O.balanced_accuracy(rows, ARM, "pos", F.coalesce(F.col("letter") == "D", F.lit(False)) == F.col("pos"))


REPORT = """with c as (select t, p, count(*) n from {t} group by 1, 2), l as (select t lab from c union select p from c),
r as (select lab label, coalesce((select sum(n) from c where t = lab and p = lab), 0) tp, coalesce((select sum(n) from c where t = lab), 0) support, coalesce((select sum(n) from c where p = lab), 0) given from l)
select label, case when given = 0 then 0 else tp / given end::double "precision", case when support = 0 then 0 else tp / support end::double recall, case when given + support = 0 then 0 else 2 * tp / (given + support) end::double f1, support::bigint support from r"""
G_ = f"(select gold t, coalesce(letter, 'Unknown') p from {R_})"


@query(REPORT.format(t=G_))
def a7_classification_report(s, d):
    rows = parsed(s, d).withColumn("told", F.coalesce("letter", F.lit("Unknown")))
    return O.classification_report(rows, "gold", "told")


@query(f"with c as (select t truth, p predicted, count(*) n from {G_} group by 1, 2), l as (select truth x from c union select predicted from c) select a.x truth, b.x predicted, coalesce(n, 0)::bigint n from l a cross join l b left join c on c.truth = a.x and c.predicted = b.x")
def a8_confusion_matrix(s, d):
    return O.confusion(parsed(s, d).withColumn("told", F.coalesce("letter", F.lit("Unknown"))), "gold", "told")


@query(f"""with c as (select model, experiment, gold, coalesce(letter, 'Unknown') p, count(*) n from {R_} group by all),
t as (select model, experiment, gold, sum(n) n from c group by all), q as (select model, experiment, p, sum(n) n from c group by all)
select a.*, b.collapse_index_pct, b.unparsed_pct from (select model, experiment, (max(n) / sum(n) * 100)::double majority_baseline_pct, (100.0 / count(*) filter (gold in ('A', 'B', 'C')))::double chance_pct from t group by 1, 2) a
join (select model, experiment, (max(n) / sum(n) * 100)::double collapse_index_pct, (coalesce(max(n) filter (p = 'Unknown'), 0) / sum(n) * 100)::double unparsed_pct from q group by 1, 2) b using (model, experiment)""")
def a9_collapse_metrics(s, d):
    return O.collapse_metrics(parsed(s, d), ARM, "gold", F.col("letter"), ["A", "B", "C"])


@query(f"""with m as (select model, experiment, run_idx, {PCT.format('correct')} acc, 100.0 * count(*) filter (sub_category = 'F') / count(*) as f_share from {O_} group by 1, 2, 3),
l as (select model, experiment, 'acc' metric, acc v from m union all select model, experiment, 'f_share', f_share from m)
select model, experiment, metric, count(*) runs, round(avg(v), 6) mean, round(median(v), 6) median, round(min(v), 6) min, round(max(v), 6) max, round(quantile_cont(v, 0.25), 6) p25, round(quantile_cont(v, 0.75), 6) p75, round(var_pop(v), 6) variance, round(stddev_pop(v), 6) std_dev, round(case when avg(v) = 0 then 0 else stddev_pop(v) / avg(v) * 100 end, 6) cv_pct from l group by 1, 2, 3""")
def a10_stability(s, d):
    runs = outcomes(s, d).groupBy(*O.RUN).agg(O.pct(F.col("correct")).alias("acc"), O.pct(F.col("sub_category") == "F").alias("f_share"))
    return rounded(O.stability(runs, ARM, ["acc", "f_share"]), "mean", "median", "min", "max", "p25", "p75", "variance", "std_dev", "cv_pct")


DIST = f"(select model, experiment, {ANSWER} answer, count(*) n, count(*) / sum(count(*)) over (partition by model, experiment) * 100 share_pct from {R_} group by 1, 2, 3)"


@query(f"select model, experiment, answer, n, round(share_pct, 6) share_pct from {DIST}")
def a11_answer_distribution(s, d):
    return rounded(O.answer_distribution(parsed(s, d), ARM), "share_pct")


@query(f"select model, experiment, answer top_answer, round(share_pct, 6) top_answer_pct from {DIST} qualify row_number() over (partition by model, experiment order by n desc, answer) = 1")
def a11_top_answer(s, d):
    return rounded(O.top_answer(O.answer_distribution(parsed(s, d), ARM), ARM), "top_answer_pct")


@query(f"select model, experiment, answer top_answer, round(share_pct, 6) top_answer_pct from {DIST} qualify row_number() over (partition by model, experiment order by n desc, answer) = 1 and share_pct >= 20.47")
def a12_collapsed_arms(s, d):
    return rounded(O.collapsed_arms(O.answer_distribution(parsed(s, d), ARM), ARM, 20.47), "top_answer_pct")


@query("select o_custkey folder, list_sort(list(distinct o_orderstatus)) models from orders group by 1 having count(distinct o_orderstatus) > 1")
def a13_mixed_models(s, d):
    return O.mixed_models(V.table(s, d, "orders").withColumnRenamed("o_custkey", "folder"), "folder", "o_orderstatus")


VOTES = "select {i} item_id, variant, case when (k * 5 + variant * 3) % 7 = 0 then null else chr((65 + (k + variant * (k % 3)) % 4)::int) end letter from (select o_orderkey k, {i}, v.variant from orders cross join (select unnest(range(5)) variant) v)"


def votes(s, d):
    """Five presentations of each item with a letter or none."""
    rows = V.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("variant"))
    k = F.col("item_id")
    return rows.withColumn("letter", F.when((k * 5 + F.col("variant") * 3) % 7 == 0, None).otherwise(F.chr(F.lit(65) + (k + F.col("variant") * (k % 3)) % 4)))


WINNER = """with v as ({v}), c as (select item_id, letter, count(*) n, min(variant) f from v where letter is not null group by 1, 2)
select i.item_id, coalesce(w.letter, '') winner, coalesce(l.votes, []) votes from (select distinct item_id from v) i
left join (select item_id, letter from c qualify row_number() over (partition by item_id order by n desc, f) = 1) w using (item_id)
left join (select item_id, list(letter order by variant) votes from v where letter is not null group by 1) l using (item_id)"""
V_ = VOTES.format(i="o_orderkey")


@query(WINNER.format(v=V_))
def a15_multi_view_vote(s, d):
    return O.vote(votes(s, d), "item_id", "variant", F.col("letter"))


@query(WINNER.format(v=f"select item_id, variant, case when variant = 0 then letter else chr(65 + (3 - (ascii(letter) - 65) + variant)::int % 4) end letter from ({V_})"))
def a14_shuffled_vote(s, d):
    """Letters of shuffled orders mapped back through each variant's permutation, then voted."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((3 - i + F.col("variant")) % 4).cast("int"))
    rows = votes(s, d).withColumn("permutation", F.when(F.col("variant") > 0, turned))
    return O.vote(rows, "item_id", "variant", O.unpermuted(F.col("letter"), F.col("permutation")))


@query("""with l as (select o_orderkey item_id, chr(65 + x.i) letter, s.signal, -((o_orderkey * 7 + x.i * 13 + s.k * 5) % 23) / 10.0 logprob from orders cross join (select unnest(range(4))::int i) x cross join (select 0 k, 'real' signal union all select 1, 'silence' union all select 2, 'noise') s),
p as (select item_id, letter, avg(logprob) filter (signal = 'real') r, avg(logprob) filter (signal <> 'real') b from l group by 1, 2), a as (select 0.0 alpha union all select 0.5 union all select 1.0)
select item_id, alpha::double alpha, letter best, round(r - alpha * b, 6) score from p cross join a qualify row_number() over (partition by item_id, alpha order by round(r - alpha * b, 9) desc, letter) = 1""")
def a16_contrastive_scores(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    rows = o.select("item_id", "i", F.posexplode(F.array(F.lit("real"), F.lit("silence"), F.lit("noise"))).alias("k", "signal"))
    rows = rows.select("item_id", F.chr(F.lit(65) + F.col("i")).alias("letter"), "signal", (-((F.col("item_id") * 7 + F.col("i") * 13 + F.col("k") * 5) % 23) / F.lit(10.0)).alias("logprob"))
    alphas = s.createDataFrame([(0.0,), (0.5,), (1.0,)], "alpha double")
    best = O.contrastive_scores(rows, alphas, digits=9)
    return best.select("item_id", "alpha", "best", F.round(F.element_at("choice_scores", F.col("best")), 6).alias("score"))


@query(f"select model, experiment, avg(acc) mean_accuracy_pct, count(*) runs from (select model, experiment, run_idx, {PCT.format('correct')} acc from {O_} group by 1, 2, 3) group by 1, 2")
def a23_mean_of_runs(s, d):
    return O.mean_of_runs(outcomes(s, d))


SPLIT = f"(select item_id, case when correct then 'transcript_solvable' else 'audio_dependent' end subset from {M_} where model = 'm1' and experiment = 't3')"


def split(s, d):
    return control_split(majority(s, d))


def control_split(rows: DataFrame) -> DataFrame:
    return C.subset_split(rows.filter("model = 'm1' and experiment = 't3'"))


def scores(s, d) -> DataFrame:
    """Accuracy overall and in both subsets, from majorities that are made once."""
    rows = stored(majority(s, d))
    return C.subset_scores(rows, control_split(rows))


@query(f"select * from {SPLIT}")
def a24_subset_split(s, d):
    return split(s, d)


SUBSETS = f"(select model, experiment, count(*) n, {PCT.format('correct')} acc, {PCT.format('correct')} filter (subset = 'transcript_solvable') acc_ts, {PCT.format('correct')} filter (subset = 'audio_dependent') acc_ad from {M_} left join {SPLIT} using (item_id) group by 1, 2)".replace("* 100 filter (subset = 'transcript_solvable')", "filter (subset = 'transcript_solvable') * 100").replace("* 100 filter (subset = 'audio_dependent')", "filter (subset = 'audio_dependent') * 100")


@query(f"select s.*, s.acc - b.acc d_acc, s.acc_ts - b.acc_ts d_ts, s.acc_ad - b.acc_ad d_ad from {SUBSETS} s left join (select * from {SUBSETS} where experiment = 'baseline') b using (model)")
def a24_subset_scores(s, d):
    return C.deltas(scores(s, d), ["acc", "acc_ts", "acc_ad"])


@query("select o_orderpriority subset, avg(1.0 / (2 + o_orderkey % 3)) * 100 chance_pct, count(*) n from orders group by rollup (o_orderpriority)")
def a25_chance_level(s, d):
    o = V.table(s, d, "orders").withColumnRenamed("o_orderpriority", "subset")
    return O.chance_level(o, "subset", 2 + F.col("o_orderkey") % 3)


@query(f"select model, experiment, {PCT.format('same')} agreement_pct, count(*) items from (select model, experiment, item_id, count(distinct coalesce(letter, 'Unknown')) = 1 same from {R_} group by 1, 2, 3) group by 1, 2")
def a26_run_agreement(s, d):
    return O.run_agreement(parsed(s, d))


@query(f"select model, experiment, subset, {PCT.format('same')} agreement_pct, count(*) items from (select model, experiment, subset, item_id, count(distinct coalesce(letter, 'Unknown')) = 1 same from {R_} join {SPLIT} using (item_id) group by 1, 2, 3, 4) group by 1, 2, 3")
def a26_agreement_by_subset(s, d):
    """Unanimity of the runs inside each subset."""
    rows = parsed_once(s, d)
    return O.run_agreement(rows.join(control_split(O.majority_correct(O.outcomes(rows))), "item_id"), [*ARM, "subset"])


TWO = f"(select a.correct x, b.correct y from {M_} a join {M_} b using (item_id) where a.model = 'm1' and a.experiment = 'baseline' and b.model = 'm2' and b.experiment = 't1')"


@query(f"select count(*) filter (x and y) \"both\", count(*) filter (x and not y) only_a, count(*) filter (not x and y) only_b, count(*) filter (not x and not y) neither, {PCT.format('(x or y)')} either_pct from {TWO}")
def a27_fusion_bound(s, d):
    m = stored(majority(s, d))
    return C.fusion_bound(m.filter("model = 'm1' and experiment = 'baseline'"), m.filter("model = 'm2' and experiment = 't1'"))


@query(f"select model, experiment, x letter, sum(p)::bigint predicted, sum(g)::bigint gold from (select model, experiment, coalesce(letter, 'Unknown') x, 1 p, 0 g from {R_} union all select model, experiment, gold, 0, 1 from {R_}) group by 1, 2, 3")
def a28_letter_bias(s, d):
    return O.letter_bias(parsed(s, d))


@query(f"select model, experiment, 'switch' kind, row_number() over (partition by model, experiment order by run_idx, item_id) \"rank\", run_idx, item_id, '{V.CHINESE} ' || chr(65 + said_idx) excerpt from {R_} where template = 8 qualify row_number() over (partition by model, experiment order by run_idx, item_id) <= 3")
def a29_language_examples(s, d):
    return O.language_examples(V.responses(s, d), ARM, "text", ["run_idx", "item_id"])


@query(f"select model, experiment, count(*) filter (correct and not base) won, count(*) filter (not correct and base) lost, count(*) n from (select a.*, b.correct base from {M_} a join (select * from {M_} where experiment = 'baseline') b using (model, item_id)) group by 1, 2")
def j6_paired_outcomes(s, d):
    return C.won_lost(C.with_baseline(majority(s, d)), ARM)


@query("with a as (select distinct o_orderstatus || o_orderpriority experiment from orders where o_orderkey % 3 = 0 and o_orderstatus <> 'F'), b as (select distinct o_orderstatus || o_orderpriority experiment from orders where o_orderkey % 3 = 1 and o_orderstatus <> 'O') select experiment, case when a.experiment is not null and b.experiment is not null then 'both' when a.experiment is not null then 'a' else 'b' end found_in from a full join b using (experiment)")
def j7_match_experiments(s, d):
    o = V.table(s, d, "orders").withColumn("experiment", F.concat("o_orderstatus", "o_orderpriority"))
    return C.match_experiments(o.filter("o_orderkey % 3 = 0 and o_orderstatus <> 'F'"), o.filter("o_orderkey % 3 = 1 and o_orderstatus <> 'O'"))


@query("select distinct o_orderkey item_id from orders where o_custkey % 4 = 0")
def j8_unsplit_items(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), "o_custkey")
    return C.unsplit_items(o, o.filter("o_custkey % 4 <> 0"))


PAIR = f"(select a.model, a.experiment, count(*) filter (a.correct and not b.correct) w, count(*) filter (not a.correct and b.correct) l from {M_} a join (select * from {M_} where experiment = 'baseline') b using (model, item_id) group by 1, 2)"


@query(f"select model, experiment, w won, l lost, round({MCNEMAR.format(w='w', l='l')}, 6) p from {PAIR}")
def h1_mcnemar_exact(s, d):
    m = majority(s, d)
    return C.won_lost(C.with_baseline(m), ARM).drop("n").withColumn("p", F.round(S.mcnemar_exact("won", "lost"), 6))


@query(f"""with p as (select model, experiment, {MCNEMAR.format(w='w', l='l')} p from {PAIR} where experiment <> 'baseline'),
r as (select *, row_number() over (partition by model order by p) k, count(*) over (partition by model) m from p)
select model, experiment, round(p, 6) p, round(max(least(1.0, (m - k + 1) * p)) over (partition by model order by p rows unbounded preceding), 6) holm from r""")
def w7_holm(s, d):
    m = majority(s, d)
    rows = C.won_lost(C.with_baseline(m), ARM).filter("experiment <> 'baseline'").withColumn("p", S.mcnemar_exact("won", "lost"))
    return rounded(S.holm(rows, "p", ["model"]).select(*ARM, "p", "holm"), "p", "holm")


@query()
def h2_bootstrap_ci(s, d):
    return S.bootstrap_ci(majority(s, d), ARM)


@query()
def h3_stratified_bootstrap(s, d):
    return S.stratified_bootstrap(majority(s, d), ARM)


@query()
def h4_paired_permutation(s, d):
    return S.paired_permutation(C.with_baseline(majority(s, d)), ARM)


@query(f"select model, experiment, count(*) n, count(*) filter (correct) \"right\", true inside from {M_} group by 1, 2")
def h2_interval_ends(s, d):
    """Counts of each arm, and whether its interval's ends lie where the normal approximation puts them, give or take."""
    rows = S.bootstrap_ci(majority(s, d), ARM)
    share = F.col("right") / F.col("n")
    acc, error = share * 100, F.sqrt(share * (1 - share) / F.col("n")) * 100
    near = lambda c, at: F.abs(F.col(c) - at) <= 0.2 * error + 150 / F.col("n")
    inside = (F.col("low") <= acc) & (acc <= F.col("high")) & near("low", acc - 1.96 * error) & near("high", acc + 1.96 * error)
    return rows.select(*ARM, "n", "right", inside.alias("inside"))


@query(BA.format(by="model, experiment", t=M_).replace(", count(*) classes", "").replace("avg(r) * 100 balanced_accuracy", "round(avg(r) * 100, 6) ba, true inside"))
def h3_point_estimates(s, d):
    """Balanced accuracy, and whether its interval holds it."""
    rows = S.stratified_bootstrap(majority(s, d), ARM)
    return rounded(rows.select(*ARM, "ba", F.col("ba").between(F.col("low"), F.col("high")).alias("inside")), "ba")


@query(f"""with p as (select a.*, b.correct base from {M_} a join (select * from {M_} where experiment = 'baseline') b using (model, item_id)), r as (select model, experiment, category, avg(correct::int::double) x, avg(base::int::double) y, count(*) n from p group by 1, 2, 3)
select model, experiment, round(avg(x) * 100, 6) ba, round(avg(y) * 100, 6) base_ba, sum(n)::bigint n, experiment = 'baseline' as alike from r group by 1, 2""")
def h4_point_estimates(s, d):
    """Balanced accuracy of both sides; ``alike``: nothing was swapped that makes a difference (p is 1)."""
    rows = S.paired_permutation(C.with_baseline(majority(s, d)), ARM)
    return rounded(rows.select(*ARM, "ba", "base_ba", "n", (F.col("p") == 1.0).alias("alike")), "ba", "base_ba")


@query()
def h5_label_shuffle(s, d):
    rows = parsed(s, d).withColumn("told", F.coalesce("letter", F.lit("Unknown")))
    return S.label_shuffle(rows, ARM, "gold", "told", "sub_category")


@query(f"select model, experiment, round(avg(r) * 100, 6) ba from (select model, experiment, gold, avg(coalesce(letter = gold, false)::int) r from {R_} group by all) group by all")
def h5_point_estimates(s, d):
    """The balanced accuracy that labels are shuffled against."""
    return rounded(h5_label_shuffle(s, d).select(*ARM, "ba"), "ba")


@query()
def h6_above_chance(s, d):
    return S.above_chance(majority(s, d), ARM, F.lit(2) + F.col("item_id") % 3)


@query(f"""with c as (select model, experiment, 2 + item_id % 3 k, count(*) n, count(*) filter (correct) r from {M_} group by 1, 2, 3)
select model, experiment, k, n, r "right", round(least(1.0, list_sum(list_transform(range(r, n + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - i * ln(k::double) + (n - i) * ln(1 - 1.0 / k))))), 6) p from c""")
def h6_above_chance_by_options(s, d):
    """Against a uniform guesser, arm by arm and number of options by number of options."""
    rows = majority(s, d).withColumn("k", F.lit(2) + F.col("item_id") % 3)
    return rounded(S.above_chance(rows, [*ARM, "k"], F.col("k")), "p")


@query(f"""with s as {SUBSETS}, x as (select * from s where experiment <> 'baseline')
select model, (arg_min(experiment, (-acc, experiment))) best, max(acc) best_acc, arg_min(experiment, (acc, experiment)) worst, min(acc) worst_acc, max(acc) - min(acc) "range" from x group by 1""")
def t1_best_worst(s, d):
    return C.best_worst(scores(s, d))


@query("with a as (select distinct o_orderstatus model, o_orderpriority || '-' || o_custkey experiment from orders) select experiment from a group by 1 having count(*) = (select count(distinct model) from a)")
def u1_experiments_run_by_all(s, d):
    o = V.table(s, d, "orders").select(F.col("o_orderstatus").alias("model"), F.concat_ws("-", "o_orderpriority", F.col("o_custkey").cast("string")).alias("experiment"))
    return C.experiments_run_by_all(o, None)


@query("select o_custkey item_id from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
def u2_shared_items(s, d):
    o = V.table(s, d, "orders").withColumnRenamed("o_custkey", "item_id")
    return C.shared_items(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"))


@query("select c_custkey::bigint k, c_name name, c_acctbal balance, null::double parts from customer union all select s_suppkey, s_name, s_acctbal, null from supplier union all select p_partkey, p_name, null, p_size::double from part")
def u3_union_tables(s, d):
    c = V.table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    u = V.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("parts"))
    return C.union_tables(c, u, p)


B_ = f"(select a.*, b.correct base, t.correct solvable from {M_} a left join (select * from {M_} where experiment = 'baseline') b using (model, item_id) left join (select * from {M_} where experiment = 't3') t using (model, item_id))"
_part = lambda n, c: f"avg(correct::int::double) filter ({c}) * 100 acc{n}, count(*) filter ({c} and correct and not base) won{n}, count(*) filter ({c} and not correct and base) lost{n}"
R1_SQL = f"""with b as (select model, experiment, count(*) n, {_part('', 'true')}, {_part('_ts', 'solvable')}, {_part('_ad', 'not solvable')} from {B_} group by 1, 2),
e as (select *, {', '.join(f"case when experiment <> 'baseline' then acc{x} - max(acc{x}) filter (experiment = 'baseline') over (partition by model) end d{x}" for x in ('', '_ts', '_ad'))},
  {', '.join(f"case when experiment = 'baseline' then 1.0 else {MCNEMAR.format(w='won' + x, l='lost' + x)} end p{x}" for x in ('', '_ts', '_ad'))} from b),
r as (select model, experiment, p, row_number() over (partition by model order by p) k, count(*) over (partition by model) m from e where experiment <> 'baseline'),
h as (select model, experiment, max(least(1.0, (m - k + 1) * p)) over (partition by model order by p, k rows unbounded preceding) holm from r)
select e.* replace ({', '.join(f"round(acc{x}, 6) as acc{x}, round(d{x}, 6) as d{x}, round(p{x}, 6) as p{x}" for x in ('', '_ts', '_ad'))}), round(coalesce(holm, 1.0), 6) holm, t.answer top_answer, round(t.share_pct, 6) top_answer_pct, round(u.share_pct, 6) unparsed_pct
from e left join h using (model, experiment) join (select * from {DIST} qualify row_number() over (partition by model, experiment order by n desc, answer) = 1) t using (model, experiment) join (select * from {DIST} where answer = '(unparsed)') u using (model, experiment)"""
R1_ROUND = [f"{c}{x}" for c in ("acc", "d", "p") for x in ("", "_ts", "_ad")] + ["holm", "top_answer_pct", "unparsed_pct"]


@query(R1_SQL.replace("select e.* replace", "select model, experiment, e.* exclude (model, experiment) replace"))
def r1_choice_summary(s, d):
    """Which technique beats its model's baseline, overall and on both subsets."""
    return rounded(R.choice_summary(parsed_once(s, d)), *R1_ROUND)


@query(f"select model, experiment, item_id, correct, subset, category layer, o_orderstatus sub_category from {M_} left join {SPLIT} using (item_id) left join orders on o_orderkey = item_id")
def r2_item_table(s, d):
    items = V.table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("sub_category"))
    return R.item_table(majority(s, d), F.expr("model = 'm1' and experiment = 't3'"), items)


@query()
def r3_balanced_summary(s, d):
    return R.balanced_summary(stored(majority(s, d)))


@query(f"""with x as (select model, experiment, category, avg(correct::int) r, count(*) n, count(*) filter (correct) k from {M_} group by all), b as (select model, experiment, avg(r) * 100 ba, count(*) classes, sum(n)::bigint n, sum(k) / sum(n) * 100 acc from x group by all)
select model, b.experiment, round(b.ba, 6) balanced_accuracy, b.classes, b.n, round(b.acc, 6) acc, round(b.ba - base.ba, 6) d_base, round(b.ba - s.ba, 6) d_silence from b join (select * from b where experiment = 'baseline') base using (model) join (select * from b where experiment = 't1') s using (model)""")
def r3_balanced_figures(s, d):
    """The balanced summary without what is drawn at random."""
    return rounded(r3_balanced_summary(s, d).drop("p_base", "p_silence", "holm"), "balanced_accuracy", "acc", "d_base", "d_silence")


@query(f"""with g as (select list_extract({V.CHOICES!r}, (o_orderkey % 4 + 1)::int) answer, count(*) / sum(count(*)) over () * 100 truth_pct from orders group by 1), c as (select model, answer, share_pct control_pct from {DIST} where experiment = 't1')
select model, experiment, answer, round(share_pct, 6) share_pct, round(truth_pct, 6) truth_pct, round(control_pct, 6) control_pct from {DIST} left join g using (answer) left join c using (model, answer)""")
def r4_answer_shares(s, d):
    gold = V.table(s, d, "orders").select(F.get(F.array(*[F.lit(c) for c in V.CHOICES]), (F.col("o_orderkey") % 4).cast("int")).alias("answer"))
    return rounded(R.answer_shares(parsed(s, d), gold), "share_pct", "truth_pct", "control_pct")


@query(f"""with j as (select experiment, count(*) n, {PCT.format('a.correct')} score_a, {PCT.format('b.correct')} score_b, count(*) filter (b.correct and not a.correct) won, count(*) filter (a.correct and not b.correct) lost from {M_} a join {M_} b using (experiment, item_id) where a.model = 'm1' and b.model = 'm2' group by 1),
p as (select *, score_b - score_a delta, {MCNEMAR.format(w='won', l='lost')} p from j), r as (select *, row_number() over (order by p) k, count(*) over () m from p),
t as (select * from {DIST} qualify row_number() over (partition by model, experiment order by n desc, answer) = 1), l as (select model, experiment, {PCT.format('template = 8')} e from {R_} group by 1, 2)
select experiment, r.n, round(score_a, 6) score_a, round(score_b, 6) score_b, won, lost, round(delta, 6) delta, round(p, 6) p, round(max(least(1.0, (m - k + 1) * p)) over (order by p, k rows unbounded preceding), 6) holm, round(x.share_pct, 6) top_pct_a, round(f.e, 6) non_english_a, round(y.share_pct, 6) top_pct_b, round(g.e, 6) non_english_b
from r join t x using (experiment) join l f using (experiment) join t y using (experiment) join l g using (experiment) where x.model = 'm1' and f.model = 'm1' and y.model = 'm2' and g.model = 'm2'""")
def r5_compare_models(s, d):
    return rounded(R.compare_models(parsed(s, d), "m1", "m2"), "score_a", "score_b", "delta", "p", "holm", "top_pct_a", "non_english_a", "top_pct_b", "non_english_b")


@query()
def r6_compare_runs(s, d):
    rows = outcomes(s, d)
    return R.compare_runs(rows, control_split(O.majority_correct(rows)))


BASED = f"(select a.*, b.correct base, subset from {M_} a join (select model, item_id, correct from {M_} where experiment = 'baseline') b using (model, item_id) left join {SPLIT} using (item_id))"
R6_SQL = f"""with x as materialized {BASED}, c as (select model, experiment, category, avg(correct::int) r, avg(base::int) q from x group by all), sc as (select model, experiment, subset, category, avg(correct::int) r from x where subset is not null group by all),
runs as (select model, experiment, avg(acc) mean_accuracy_pct, count(*) runs from (select model, experiment, run_idx, {PCT.format('correct')} acc from {O_} group by all) group by all),
mb as (select model, experiment, avg(ba) mean_ba from (select model, experiment, run_idx, avg(r) * 100 ba from (select model, experiment, run_idx, category, avg(correct::int) r from {O_} group by all) group by all) group by all)
select model, experiment, x.n, "right", round(acc, 6) acc, round(mean_accuracy_pct, 6) mean_accuracy_pct, runs, won, lost, round(delta, 6) delta, round({MCNEMAR.format(w='won', l='lost')}, 6) p, round(ba, 6) ba, round(mean_ba, 6) mean_ba, round(delta_ba, 6) delta_ba, round(acc_ts, 6) acc_ts, round(acc_ad, 6) acc_ad, n_ts, n_ad, round(ba_ts, 6) ba_ts, round(ba_ad, 6) ba_ad
from (select model, experiment, count(*) n, count(*) filter (correct) "right", avg(correct::int) * 100 acc, count(*) filter (correct and not base) won, count(*) filter (base and not correct) lost, (count(*) filter (correct and not base) - count(*) filter (base and not correct)) / count(*) * 100 delta,
  count(*) filter (subset = 'transcript_solvable') n_ts, count(*) filter (subset = 'audio_dependent') n_ad, avg(correct::int) filter (subset = 'transcript_solvable') * 100 acc_ts, avg(correct::int) filter (subset = 'audio_dependent') * 100 acc_ad from x group by all) x
join (select model, experiment, avg(r) * 100 ba, avg(r - q) * 100 delta_ba from c group by all) using (model, experiment) join runs using (model, experiment) join mb using (model, experiment)
join (select model, experiment, avg(r) filter (subset = 'transcript_solvable') * 100 ba_ts, avg(r) filter (subset = 'audio_dependent') * 100 ba_ad from sc group by all) using (model, experiment)"""


@query(R6_SQL)
def r6_compare_runs_figures(s, d):
    """The comparison of runs without what is drawn at random: every count, accuracy, delta and exact p."""
    out = r6_compare_runs(s, d).drop("low", "high", "ba_low", "ba_high", "p_ba", "categories")
    return rounded(out, "acc", "mean_accuracy_pct", "delta", "p", "ba", "mean_ba", "delta_ba", "acc_ts", "acc_ad", "ba_ts", "ba_ad")


PRIORITIES = [f"{k}-{x}" for k, x in enumerate(("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"), 1)]


@query("select model, experiment, " + ", ".join(f"round(avg(correct::int) filter (category = '{c}') * 100, 6) p{c[0]}" for c in PRIORITIES) + f" from {M_} group by all")
def r6_category_table(s, d):
    table = R.category_pivot(r6_compare_runs(s, d), PRIORITIES).toDF(*ARM, *[f"p{c[0]}" for c in PRIORITIES])
    return rounded(table, *table.columns[2:])


@query(f"""with j as (select a.model model_a, b.model model_b, experiment, count(*) n, {PCT.format('a.correct')} score_a, {PCT.format('b.correct')} score_b, count(*) filter (b.correct and not a.correct) won, count(*) filter (a.correct and not b.correct) lost from {M_} a join {M_} b using (experiment, item_id) where a.model < b.model group by all),
p as (select *, score_b - score_a delta, {MCNEMAR.format(w='won', l='lost')} p from j), r as (select *, row_number() over (partition by model_a, model_b order by p) k, count(*) over (partition by model_a, model_b) m from p)
select model_a, model_b, experiment, n, round(score_a, 6) score_a, round(score_b, 6) score_b, won, lost, round(delta, 6) delta, round(p, 6) p, round(max(least(1.0, (m - k + 1) * p)) over (partition by model_a, model_b order by p, k rows unbounded preceding), 6) holm from r""")
def r5_compare_all_models(s, d):
    return rounded(R.compare_all_models(majority(s, d)), "score_a", "score_b", "delta", "p", "holm")


@query(f"""with s as {SUBSETS}, x as (select * from s where experiment <> 'baseline'), b as (select model, acc baseline_acc, acc_ad baseline_ad from s where experiment = 'baseline')
select model, arg_min(experiment, (-acc, experiment)) best, max(acc) best_acc, arg_min(experiment, (acc, experiment)) worst, min(acc) worst_acc, max(acc) - min(acc) "range", any_value(baseline_acc) baseline_acc, any_value(baseline_ad) baseline_ad from x join b using (model) group by 1""")
def r7_scaling_table(s, d):
    per = scores(s, d)
    return R.scaling_table(per, per)


@query(f"select experiment, model, x.s subset, greatest(-20.0, least(20.0, case when x.s = 'ts' then d_ts else d_ad end)) delta, case when x.s = 'ts' then p_ts else p_ad end < 0.05 significant from ({R1_SQL}) cross join (select 'ts' s union all select 'ad') x where d is not null")
def r8_technique_matrix(s, d):
    return R.technique_matrix(rounded(R.choice_summary(parsed_once(s, d)), *R1_ROUND))


@query(f"select model, a.acc_ts ts_with, a.acc_ad ad_with, b.acc_ts ts_without, b.acc_ad ad_without, a.acc_ts - b.acc_ts d_ts, a.acc_ad - b.acc_ad d_ad from {SUBSETS} a join {SUBSETS} b using (model) where a.experiment = 't2' and b.experiment = 't1'")
def r9_modality_ablation(s, d):
    return R.modality_ablation(scores(s, d), "t2", "t1")


@query(f"select model, experiment, row_number() over (partition by model order by size desc, experiment) \"rank\", round(size, 5) size from (select model, experiment, abs(coalesce(d_ts, 0)) + abs(coalesce(d_ad, 0)) size from ({R1_SQL}) where d is not null) qualify row_number() over (partition by model order by size desc, experiment) <= 2")
def t2_extreme_techniques(s, d):
    return R.extreme_techniques(rounded(R.choice_summary(parsed_once(s, d)), *R1_ROUND), 2).withColumn("size", F.round("size", 5))


@query("""with v as (select o_orderkey k, x.v, list_transform(range(4), lambda i: i) p from orders cross join (select unnest(range(3)) v) x) select k item_id, v::int variant_idx, 4 n_choices, true contract from v""")
def p23_shuffle_variants(s, d):
    """Every variant is a permutation, the original comes first, and the remapped gold letter still names the gold option."""
    plain = V.responses(s, d).filter("model = 'm1' and experiment = 'baseline' and run_idx = 1").select("item_id", "gold", "choices", F.get("choices", X.index_for_letter(F.col("gold"))).alias("right"))
    out = Q.shuffle_variants(plain, 3)
    same = F.array_sort("permutation") == F.sequence(F.lit(0), F.lit(3))
    first = (F.col("variant_idx") > 0) | (F.col("permutation") == F.sequence(F.lit(0), F.lit(3)))
    return out.select("item_id", "variant_idx", F.size("choices").alias("n_choices"), (same & first & (F.get("choices", X.index_for_letter(F.col("gold"))) == F.col("right"))).alias("contract"))
