"""Training-corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, langid, lsm, mixing, simhash
from tickloom.llm.common import not_null, shared_dir, stored, table
from tickloom.llm.queries import held_out, vocabulary_path


def _kept(spark: SparkSession, docs: DataFrame, digest: Column, keys: DataFrame) -> DataFrame:
    """One row of docs, with its own columns in order, for each of keys (doc_id, digest, n). Where n says that several have a key, it is the one with the longest text, then the greatest."""
    keys = stored(spark, keys.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n"), f"{shared_dir(spark)}/kept")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), digest.alias("_text"))

    def with_key(k: DataFrame, how: str) -> DataFrame:
        return rows.join(k.drop("n"), rows["_row"]["doc_id"].eqNullSafe(k["_id"]) & (rows["_text"] == k["_digest"]), how)

    out = with_key(keys.where("n = 1"), "left_semi").select("_row")
    several = keys.where("n > 1")
    if not several.isEmpty():
        best = F.max(F.struct(F.length("_row.text").alias("n_points"), "_row"))
        out = out.unionByName(with_key(several, "inner").groupBy("_id", "_digest").agg(best.alias("_best")).select(F.col("_best._row").alias("_row")))
    return out.select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, with lang where it was null; those with a null text, without letters or with a tie between languages go.

    Repeated rows and null ids stay as they are; any extra columns stay; an empty table, or one without labels, gives an empty result.
    """
    learned = langid.dictionaries(docs.where(~held_out()))
    return langid.classify_rows(docs, learned)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays: most code points, then smallest doc_id, null last, then the greatest of rows that tie in both.

    A null text counts as empty. Rows that share a doc_id are told apart by their texts; any extra columns stay; an empty table gives an empty result.
    """
    groups = lsm.exact_groups(spark, docs).where("kept")
    return _kept(spark, docs, lsm.digest(lsm.without_spaces(not_null())), groups.groupBy("doc_id", "digest").agg(F.count("*").alias("n")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: smallest doc_id, null last, then smallest text digest, then the greatest of rows that tie in both.

    A null or empty text has fingerprint 0 and is linked like any other. Any extra columns stay; an empty table gives an empty result.
    """
    digest = F.sha2(not_null(), 256)
    return _kept(spark, docs, digest, simhash.one_of_each(spark, docs, digest))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as their source's target weight says, in shuffled order.

    A null source is a source like any other; rows with one doc_id, or without, occur equally often; any extra columns stay, whatever their names; an empty table gives an empty result.
    """
    return mixing.mix(spark, docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document that came: its ids, and digests of them and of the decoded text.

    A null text counts as empty: no ids. Repeated rows and null ids stay; extra columns go; an empty table gives an empty result.
    """
    return bpe.encode_documents(spark, docs, vocabulary_path(), ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("bpe_encode", bpe_encode)]

#: Neither compression, SimHash links nor byte-pair merges can be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
