"""A cleaning pipeline over documents: each stage works on all rows that the one before kept.

Stages, in order: toxicity (documents scored toxic go), exact deduplication (one of
equal texts stays), n-gram Jaccard join (one of each near-duplicate component stays),
benchmark decontamination (documents that share a window with the benchmark go), BPE
encoding and decoding (digests of what stays). All but the last return the columns of
documents, with their rows unchanged. Decisions are by row, so ids may be null or
repeated: a stage numbers its input's rows (a table or a checkpoint, which is read in the
same order each time), the operators take these numbers as ids, and they bring the
decisions back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoledger.llm import bpe_codec, decontamination, exact_dedup, signature_join, toxicity
from chronoledger.llm.common import cut, table

#: Rejected rows that may be broadcast (some 50 bytes each); beyond them the join shuffles.
BROADCAST = 500_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the name of that column, which none of docs has."""
    name = "_row"
    while name in map(str.lower, docs.columns):
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def _without(docs: DataFrame, row: str, rejected: DataFrame) -> DataFrame:
    """The numbered rows of docs whose number is not among the rejected (doc_id), without it."""
    gone = cut(rejected.select(F.col("doc_id").alias(row)))
    if gone.count() <= BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, row, "left_anti").drop(row)


def _all_but_best(docs: DataFrame, row: str, groups: DataFrame, *first: Column) -> DataFrame:
    """Row numbers (as doc_id) that go if of each group (doc_id, head: the number of one of its rows) the row that is least by first, then by id (null last), stays."""
    others = cut(groups.where("doc_id <> head").select("doc_id", "head"))
    members = others.unionByName(others.select(F.col("head").alias("doc_id"), "head").distinct())
    ranks = docs.select(F.col(row).alias("member"), F.struct(*first, F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")).alias("rank"))
    best = members.join(ranks, members["doc_id"] == ranks["member"]).groupBy("head").agg(F.min("rank")["row"].alias("best"))
    return members.join(best.select("best"), members["doc_id"] == F.col("best"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of 0.7 or more; learns from the stage's input and its labels."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, keeps the row with most code points, then the smallest id."""
    docs, row = _numbered(docs)
    groups = exact_dedup.exact_dedup(docs, id_col=row).select("doc_id", F.col("keep_id").alias("head"))
    return _without(docs, row, _all_but_best(docs, row, groups, -F.char_length(F.coalesce("text", F.lit("")))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies keeps the document with the smallest id."""
    docs, row = _numbered(docs)
    groups = signature_join.near_components(docs, id_col=row).select("doc_id", F.col("component_id").alias("head"))
    return _without(docs, row, _all_but_best(docs, row, groups))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a word inside a window of ten words of a benchmark item."""
    docs, row = _numbered(docs)
    return _without(docs, row, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col=row).where("contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document that is left."""
    return bpe_codec.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near-duplicate join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding", encode),
]

#: A trained score, a component search and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is cut in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
