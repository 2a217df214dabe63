"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, graph_search, html_text, importance, lm, near_vectors, ngram_join, packing, passages, quality, tokens, toxicity, warc
from .common import fold_of, shared_folder

#: Sequence length of the packing query.
SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.labeller(pages)).select("page_id", "url", "text", "n_chars")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trained = lm.train(docs.filter(fold_of("doc_id", 7) != 2))
    scores = lm.score_texts(docs, trained)
    return scores.select("doc_id", (fold_of("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    rows = warc.read_warc(spark, folder, payloads=False)
    # What was just written must come back whole: a gap fails the query.
    page = F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("a written record was not read back: "), F.col("gap"))).cast("long"))
    return rows.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _labels(spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    return _table(spark, sf_dir, "labels").filter(fold_of("doc_id", folds) != held)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.toxicity_model(docs, _labels(spark, sf_dir, 5, 0))
    return toxicity.score_documents(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.quality_model(docs, _labels(spark, sf_dir, 4, 2))
    return quality.score_documents(docs, model).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(_table(spark, sf_dir, "documents"), word_tokenizer())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), byte_tokenizer(), SEQUENCE, with_ids=False)
    return packing.pack(pieces, SEQUENCE)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.graph_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), buckets=10_000, most=1, least_words=20, percent=10, seed="2024")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=10, longest=3, inside_percent=50, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_lm_scoring, op3_ngram_jaccard_join, op4_warc_round_trip, op5_toxicity, op6_bpe_round_trip, op7_best_fit_packing, op8_embedding_near_dedup, op9_approximate_neighbours, op10_quality, op11_repeated_passages, op12_importance_resampling, op13_phrase_collocations)}


#: Links, then everything reachable by them. Approximate and learned results have no SQL.
OP8_SQL = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), u as (
  select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) n from v
), links as (
  select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), least as (select a, min(b) b from reach group by a),
counts as (select a, count(*) n from links group by a)
select vec_id, coalesce(n, 0)::bigint n_links, least(vec_id, coalesce(l.b, vec_id)) component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) kept
from embeddings e left join least l on l.a = e.vec_id left join counts c on c.a = e.vec_id
"""


OP3_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') t from documents
), s as (
  select doc_id, list_distinct(case when len(t) = 0 then [] when len(t) < 3 then [array_to_string(t, ' ')]
    else list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) end) g from w
), e as (select doc_id, unnest(g) g from s),
sizes as (select doc_id, len(g)::bigint n from s),
common as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)
), both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a, min(b) b from reach group by a)
select doc_id, n n_shingles, least(doc_id, coalesce(b, doc_id)) component_id from sizes left join least on a = doc_id
"""
OP4_SQL = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, '')))::bigint n, sha1(coalesce(html, '')) d from pages),
g as (select d, n, max(page_id) m from p where n >= 1000 group by d, n)
select page_id, p.n payload_bytes, p.d payload_digest, case when m > page_id then 'revisit' else 'response' end record_type, case when m > page_id then m end refers_to
from p left join g on g.d = p.d and g.n = p.n
"""

OP11_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') t from documents),
windows as (select doc_id, unnest(range(1, len(t) - 48)) i, t from w where len(t) >= 50),
sums as (select doc_id, i, array_to_string(t[i:i + 49], ' ') g from windows),
first as (select g, min(doc_id) o from sums group by g having count(*) > 1),
hit as (select doc_id, i from sums join first using (g) where o < doc_id),
word as (select doc_id, unnest(range(1, len(t) + 1)) i, unnest(t) x from w),
covered as (select doc_id, word.i, x, max(case when hit.i is null then 0 else 1 end) over (partition by doc_id order by word.i rows between 49 preceding and current row) c from word left join hit using (doc_id, i)),
per as (select doc_id, count(*) n_words, sum(c)::bigint n_removed, coalesce(string_agg(x, ' ' order by i) filter (c = 0), '') k from covered group by doc_id)
select doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(k, '')) kept_sha256 from documents left join per using (doc_id)
"""


#: The checksum is folded byte by byte over the distinct words, with its table made by the rule.
OP12_SQL = """
with recursive steps(i, n, c) as (select i, 0, i from range(256) r(i) union all select i, n + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where n < 8),
crc as (select list(c order by i) t from steps where n = 8),
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') t from documents),
e as (select doc_id, unnest(t) x from w),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) x from benchmark),
words as (select x, hex(encode(x)) h from (select x from e union select x from b)),
bytes as (select x, list_prepend(4294967295::bigint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)) l from words),
bucket as (select x, xor(list_reduce(l, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 k from bytes, crc),
raw as (select k, count(*) s from e join bucket using (x) group by k),
goal as (select k, count(*) t from b join bucket using (x) group by k),
sums as (select (select count(*) from e)::double s_all, (select count(*) from b)::double t_all),
gain as (select k, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (s_all + 10000) / ((s + 1.0::double) * (t_all + 10000))))::bigint g from raw left join goal using (k), sums),
per as (select doc_id, count(*)::bigint n, floor(sum(g) / count(*))::bigint weight from e join bucket using (x) join gain using (k) group by doc_id),
scored as (
  select doc_id, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
  from documents left join per using (doc_id)
), drawn as (select doc_id, row_number() over (order by score desc, doc_id) r, count(*) over () many from scored where n_features >= 20)
select doc_id, n_features::bigint n_features, weight::bigint weight, score::bigint score, case when r <= 10 * many // 100 then r end rank from scored left join drawn using (doc_id)
"""

OP13_SQL = """
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
p as (select lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) p from d),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') t from p),
g as (
  select lang, unnest(t) x, 1 m from w union all
  select lang, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 2 from w union all
  select lang, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])), 3 from w
), f as (select lang, x, m, count(*)::hugeint a from g group by all having count(*) >= 10),
n as (select lang, count(*) n from g where m = 1 group by lang),
c as (select lang, x, m, a, string_split(x, ' ') t from f where m > 1),
cuts as (
  select lang, x, a, k, array_to_string(t[:k], ' ') y, array_to_string(t[k + 1:], ' ') z from c, range(1, 3) r(k) where k < m
), scored as (
  select lang, x, cuts.a, l.a l, r.a r, k, (1000000::hugeint * cuts.a * cuts.a) // (l.a * r.a) score
  from cuts join (select lang, x y, a from f) l using (lang, y) join (select lang, x z, a from f) r using (lang, z)
), best as (select * from scored qualify row_number() over (partition by lang, x order by score, k) = 1),
longer as (
  select lang, y x, max(a) a from (
    select lang, t[1] || ' ' || t[2] y, a from c where m = 3 union all select lang, t[2] || ' ' || t[3], a from c where m = 3
  ) group by lang, y
), kept as (
  select b.* from best b left join longer o on o.lang = b.lang and o.x = b.x where o.a is null or 100 * o.a < 50 * b.a
), placed as (select *, row_number() over (partition by lang order by score desc, a desc, encode(x)) rank from kept)
select lang, rank, x phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score from placed join n using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3_SQL, "op4_warc_round_trip": OP4_SQL, "op8_embedding_near_dedup": OP8_SQL, "op11_repeated_passages": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_phrase_collocations": OP13_SQL}
