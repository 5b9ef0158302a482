"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Input partitions are dealt to memtables. A memtable is flushed as a sorted run, one entry for each digest: the row that
stays of its own rows, and how many there are. Each run has a bitmap filter. Compaction reads the filters first: an entry
that the filters of all other runs deny goes into the next level as it is; only the others are merged, digest by digest,
keeping the smallest identifier of the longest texts. Digests with more than one row are hits: a filter sized by their
number, with no limit, lets only rows of hits through a second scan of the texts, and those are verified by bytes before they count as copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import not_null, shared_dir, stored

#: Memtables, and so runs of level 0, whatever the input.
RUNS = 4
#: Bits of filter for each digest: of the runs, whose filters meet entries page by page, and of the hits.
RUN_BITS, HIT_BITS = 8, 16
#: Filter pages up to so many bytes are broadcast, of the runs and of the hits (67 million of them); beyond, rows meet their pages by a join, which Spark deals by page.
RUN_BYTES, HIT_BYTES = 16 << 20, 128 << 20
#: Bits and bytes of a page.
_PAGE, _BYTES = 15, 4096


def without_spaces(text: Column) -> Column:
    """Deletes U+0020 and U+0009 to U+000D."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _best() -> Column:
    """Of equal texts: most code points, then smallest doc_id; a null doc_id comes last."""
    return F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))


def bits_for(n: int, each: int) -> int:
    """Logarithm of the bits of a filter for n digests."""
    return max(_PAGE, math.ceil(math.log2(max(1, n * each))))


def filter_bytes(bits: int) -> int:
    return _BYTES << (bits - _PAGE)


def _bit(bits: int) -> Column:
    """Place of a digest in a filter."""
    return F.pmod(F.xxhash64("digest"), F.lit(1 << bits))


def filter_of(rows: DataFrame, bits: int, *keys: str) -> DataFrame:
    """(keys, page, bits): bitmaps of the digests, combined in each task first; at most 2**(bits - 15) pages of 4 KB for each key."""
    at = _bit(bits)
    return rows.groupBy(*keys, F.shiftright(at, _PAGE).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << _PAGE) - 1))).alias("bits"))


def probed(rows: DataFrame, pages: DataFrame, bits: int, *keys: str) -> DataFrame:
    """rows with maybe: whether the filter (of the row's keys) may hold the digest; none that it holds is denied."""
    at = _bit(bits)
    rows = rows.withColumn("page", F.shiftright(at, _PAGE)).join(pages, [*keys, "page"], "left")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at.bitwiseAND(F.lit((1 << _PAGE) - 1)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("maybe", F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))).drop("page", "bits")


def maybe_in(spark: SparkSession, rows: DataFrame, hits: DataFrame, path: str) -> DataFrame:
    """Rows (digest and more) whose digest may be among the hits, a stored table. The filter has HIT_BITS bits a hit, however many there are."""
    bits = bits_for(hits.count(), HIT_BITS)
    pages = filter_of(hits, bits)
    pages = F.broadcast(pages) if filter_bytes(bits) <= HIT_BYTES else stored(spark, pages, path)
    return probed(rows, pages, bits).where("maybe").drop("maybe")


def flush(spark: SparkSession, log: DataFrame, path: str) -> DataFrame:
    """Memtables to level 0: (run, digest, best, n), one entry for each digest of a run, sorted; best is (-code points, no id, doc_id)."""
    runs = log.groupBy("run", "digest").agg(_best().alias("best"), F.count("*").alias("n"))
    return stored(spark, runs.sortWithinPartitions("run", "digest"), path)


def beyond_own(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """runs with maybe: whether the filters of the other runs may hold the digest too. What they deny is not merged."""
    n = runs.count()
    bits = bits_for(n, RUN_BITS)
    filters = stored(spark, filter_of(runs, bits, "run"), path)
    others = filters.select(F.explode(F.array_remove(F.array(*map(F.lit, range(RUNS))), F.col("run"))).alias("run"), "page", "bits").groupBy("run", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
    return probed(runs, F.broadcast(others) if RUNS * filter_bytes(bits) <= RUN_BYTES else others, bits, "run")


def compact(spark: SparkSession, runs: DataFrame, path: str) -> DataFrame:
    """Level 0 to level 1, one sorted run of all digests: (digest, keep_id, group_size)."""
    runs = beyond_own(spark, runs, f"{path}-filters")
    merged = runs.where("maybe").groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    level = runs.where("not maybe").select("digest", "best", "n").unionByName(merged)
    return stored(spark, level.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size")).sortWithinPartitions("digest"), path)


def exact_groups(spark: SparkSession, docs: DataFrame, key=digest) -> DataFrame:
    """One row for every row of docs: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when they are without U+0020 and U+0009 to U+000D; a null text counts as empty. Of equal texts
    the row with the most code points, then the smallest doc_id stays. Rows with the same doc_id and text are copies
    like any other; kept is true for each row whose doc_id is keep_id. Extra columns are ignored; an empty table gives
    an empty result. key may be any function of the text: equal digests of different texts are told apart by bytes.
    """
    folder = shared_dir(spark)
    text = without_spaces(not_null())
    log = docs.select("doc_id", key(text).alias("digest"), F.length(not_null()).alias("n_points"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"))
    log = stored(spark, log.sortWithinPartitions("digest"), f"{folder}/log")
    level = compact(spark, flush(spark, log, f"{folder}/level0"), f"{folder}/level1")
    hits = level.where("group_size > 1").select("digest")
    rows = docs.select("doc_id", text.alias("norm"), F.length(not_null()).alias("n_points")).withColumn("digest", key(F.col("norm")))
    rows = maybe_in(spark, rows, hits, f"{folder}/hits")
    # copies of one text collapse in each task before the shuffle, so a large group moves its text once for each task
    texts = rows.groupBy("digest", "norm").agg(_best().getField("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_digest = texts.groupBy("digest").agg(F.count("*").alias("n_texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
    per_digest = stored(spark, per_digest.where("group_size > 1 or n_texts > 1"), f"{folder}/verified")
    sure = per_digest.where("n_texts = 1").select("digest", "keep_id", "group_size")
    mixed = per_digest.where("n_texts > 1").select("digest")
    whole = log
    if not mixed.isEmpty():  # different texts under one digest: their rows are grouped by their bytes
        whole = log.join(mixed, "digest", "left_anti")
        apart = rows.select("doc_id", "digest", "norm").join(mixed, "digest")
        again = texts.join(mixed, "digest").select("digest", "norm", "keep_id", "group_size")
        apart = apart.join(again, ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
    out = whole.join(sure, "digest", "left").select("doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    if whole is not log:
        out = out.unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
