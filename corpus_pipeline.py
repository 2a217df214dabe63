"""From raw documents to packed training sequences: four stages, each an operator of ``verdikt.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of ``documents``; the last
returns packed pieces. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import ngram_join, packing, quality, toxicity
from verdikt.llm.common import fold_of, free_name, stored
from verdikt.llm.queries import SEQUENCE, byte_tokenizer

#: Words of a shingle, and the Jaccard similarity in percent from which two documents are one.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Scores from which a document counts as toxic, and as good.
TOXIC_FROM, GOOD_FROM = 0.5, 0.7


def _labels(spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    """Rows that may be learnt from: the folds the operators' own queries learn from, so that the rest stays held out."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of("doc_id", folds) != held)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below ``TOXIC_FROM``.

    A null text is scored as the empty one, and both stay; rows without an id are scored like others; rows that repeat
    an id are judged each for itself. An empty table stays empty; without usable labels nothing is learnt and all stay.
    """
    model = toxicity.toxicity_model(docs, _labels(spark, sf_dir, 5, 0))
    name = free_name(docs, "score")
    return toxicity.score_documents(docs, model, keep=True, score_col=name).filter(F.col(name) < TOXIC_FROM).drop(name)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``GOOD_FROM``.

    A null text is scored as the empty one; rows without an id are scored like others; rows that repeat an id are judged
    each for itself. Whole texts are scored. An empty table stays empty.
    """
    model = quality.quality_model(docs, _labels(spark, sf_dir, 4, 2))
    name = free_name(docs, "score")
    return quality.score_documents(docs, model, keep=True, score_col=name).filter(F.col(name) >= GOOD_FROM).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without words or id stay.

    Rows that repeat an id are one document: one of them stays.
    """
    groups = stored(ngram_join.ngram_components(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT))
    named = docs.filter("doc_id is not null")
    kept = named.join(groups.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    if named.count() != groups.count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter("doc_id is null")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with the sequence and the place each was given.

    A null or empty text is one piece, the end alone; longer texts than a sequence are cut. Rows that repeat an id, or
    have none, have pieces of their own. An empty table gives no pieces. Columns of ``docs`` beyond id and text go.
    """
    return packing.pack(packing.token_pieces(docs, byte_tokenizer(), SEQUENCE, with_ids=False), SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_duplicates", one_of_each), ("packing", pack_sequences)]

#: No stage's result can be told in SQL: two are trained, one packs. The tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
