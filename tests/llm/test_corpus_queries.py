"""The registered corpus queries and the pipeline on the smallest tables: folds, columns, SQL, brute force."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from verdikt.llm import queries as Q

COLUMNS = {
    "op1_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op2_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_warc_round_trip": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_bpe_round_trip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9_approximate_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_repeated_passages": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op13_phrase_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, data, name):
    got = dict(Q.queries()[name](spark, data).dtypes)
    assert {k: got.get(k) for k in (c.split()[0] for c in COLUMNS[name].split(", "))} == dict(c.split() for c in COLUMNS[name].split(", "))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, data, name):
    same(Q.queries()[name](spark, data), Q.oracle_sql()[name], data)


@pytest.mark.parametrize("name,folds,held,least,label", [("op5_toxicity", 5, 0, 0.5, "toxic"), ("op10_quality", 4, 2, 0.7, "quality")])
def test_classifiers_hold_their_fold_out(spark, data, name, folds, held, least, label):
    got = Q.queries()[name](spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.85


def test_labels_of_the_held_out_fold_change_nothing(spark, data, tmp_path):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(str(tmp_path / "labels.parquet"))
    (tmp_path / "documents.parquet").symlink_to(f"{data}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.score) for r in df.collect())
    assert key(Q.op5_toxicity(spark, data)) == key(Q.op5_toxicity(spark, str(tmp_path)))


def test_packing_pieces_equal_the_public_tokenizer(spark, data):
    import tokenizers

    coder = tokenizers.Tokenizer.from_file(Q.byte_tokenizer()[0])
    coder.no_truncation()
    coder.no_padding()
    want = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        start, k = 0, 0
        while start < len(ids):
            n = (len(ids) % Q.SEQUENCE or Q.SEQUENCE) if k == 0 else Q.SEQUENCE
            want.add((r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], dtype="<u4").tobytes())))
            start, k = start + n, k + 1
    got = Q.op7_best_fit_packing(spark, data).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= Q.SEQUENCE


def test_language_model_fold_and_counts(spark, data):
    got = Q.op2_lm_scoring(spark, data).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert all(r.n_tokens == len((docs[r.doc_id] or "").encode().split()) + 1 and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.fixture(scope="module")
def wide(spark, data, tmp_path_factory):
    """The given tables with columns of documents whose names the operators use themselves."""
    folder = tmp_path_factory.mktemp("wide")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = docs.withColumns({"score": F.lit(42.0), "_text": F.concat(F.lit("x"), F.col("doc_id")), "id": F.lit(7), "bin": F.array(F.col("doc_id"))})
    odd = spark.createDataFrame([(None, "no id here"), (900_001, None), (900_002, ""), (900_003, "word " * 60_000), (900_003, "word " * 60_000)], "doc_id long, text string")
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(str(folder / "documents.parquet"))
    (folder / "labels.parquet").symlink_to(f"{data}/labels.parquet")
    return str(folder)


def test_pipeline_keeps_columns_and_rows_whole(spark, wide):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{wide}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for _, stage in P.STAGES[:-1]:
        kept = P.stored(stage(spark, docs, wide))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        assert kept.filter("score <> 42.0").isEmpty() and kept.filter("_text is not null and _text <> concat('x', doc_id)").isEmpty()
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
        docs = kept
    assert docs.filter("doc_id = 900003").count() <= 1
    pieces = P.STAGES[-1][1](spark, docs, wide).collect()
    assert {r.doc_id for r in pieces} == ids[-1] and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)


def test_near_duplicate_stage_equals_brute_force(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in P.one_of_each(spark, docs, data).collect()}
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    assert kept == {i for i in sets if root(i) == i}


def test_run_equals_its_stages(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, data))
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(P.run(spark, data)) == key(P.STAGES[-1][1](spark, docs, data))


def test_pipeline_of_an_empty_table_with_more_columns(spark, data, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("rank", F.lit(1)).withColumn("tokens", F.lit("x"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "labels.parquet").symlink_to(f"{data}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).columns == docs.columns


def test_packing_over_many_buckets_of_a_length(spark, data, monkeypatch):
    from verdikt.llm import packing as K

    monkeypatch.setattr(K, "BUCKET_ROWS", 3)
    got = Q.op7_best_fit_packing(spark, data).collect()
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[-1][0] + b[-1][1] <= Q.SEQUENCE
    assert len(got) == len({(r.doc_id, r.piece) for r in got})
