"""Line dedup over content-defined chunks of lines, in DataFrame operations only.

A chunk ends after a line if the rolling hash over the hashes of that line and the one before says so; so boundaries
depend on nearby lines alone and shift with them. Chunks of several lines that occur more than once anywhere are compared
by bytes, and all but the first occurrence go. A boundary before or after a copied passage is no line of it, so from a chunk
that goes, its occurrence is extended line by line: the next line goes too while it and its neighbour occur side by side
elsewhere. Passages, runs of such neighbours of over PASSAGE words that hold no common chunk and single lines of that
many words, go in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import not_null, shared_dir, stored
from .lsm import maybe_in

#: Copied lines of more words than this together are a passage.
PASSAGE = 50
#: Rolling hash of two lines: HASH_BASE * (hash of the line before) + hash of the line; a boundary where it is a multiple of MEAN_LINES, after HASH_MODULUS.
HASH_BASE, HASH_MODULUS, MEAN_LINES = 31, 1_000_003, 3
CHUNK, PAIR, LINE = "c", "p", "l"


def n_words(line: Column) -> Column:
    """Runs of other characters than U+0020 and U+0009 to U+000D."""
    return F.size(F.array_remove(F.split(F.translate(line, "\t\x0b\x0c\r", "    "), " "), ""))


def units(docs: DataFrame, key, texts: bool) -> DataFrame:
    """docs (doc_id, _text) to (doc_id, _version, kind, start, digest), and bytes with texts: chunks of several lines, pairs of neighbours, and lines that may be a passage by their length.

    start counts lines from 1. Digests are made of the lines' digests, so that a text is digested once. Each step is a column, so that no array is computed twice.
    """
    last = F.size("_lines")

    def unit(kind: str, start: Column, n: Column) -> Column:
        parts = [F.lit(kind).alias("kind"), start.alias("start"), F.concat(F.lit(kind), F.array_join(F.slice("_md5", start, n), "")).alias("of")]
        return F.struct(*parts, *([F.array_join(F.slice("_lines", start, n), "\n").alias("bytes")] if texts else []))

    def cut(i: Column) -> Column:
        before = F.when(i > 1, F.element_at("_hashes", F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        return (i == last) | ((before * HASH_BASE + F.element_at("_hashes", i)) % HASH_MODULUS % MEAN_LINES == 0)

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.element_at("_ends", F.greatest(k, F.lit(1))) + 1).otherwise(F.lit(1))
        return F.struct(start.alias("start"), (end - start + 1).alias("n"))

    rows = docs.withColumn("_lines", F.split(F.col("_text"), "\n", -1)).withColumn("_md5", F.transform("_lines", lambda x: F.md5(x)))
    rows = rows.withColumn("_hashes", F.transform("_md5", lambda m: F.conv(F.substring(m, 1, 7), 16, 10).cast("long"))).withColumn("_ends", F.filter(F.sequence(F.lit(1), last), cut))
    chunks = F.transform(F.filter(F.transform("_ends", chunk), lambda c: c["n"] > 1), lambda c: unit(CHUNK, c["start"], c["n"]))
    pairs = F.transform(F.sequence(F.lit(1), last), lambda i: unit(PAIR, i, F.lit(2)))  # the last one is dropped: it has no neighbour
    long = F.filter(F.sequence(F.lit(1), last), lambda i: F.length(F.element_at("_lines", i)) > 2 * PASSAGE)
    rows = rows.withColumn("_units", F.concat(chunks, F.slice(pairs, F.lit(1), last - 1), F.transform(long, lambda i: unit(LINE, i, F.lit(1)))))
    rows = rows.select("doc_id", "_version", F.explode_outer("_units").alias("u")).where("u is not null")  # outer: no filter on the whole array is inferred
    return rows.select("doc_id", "_version", "u.kind", "u.start", key(F.col("u.of")).alias("digest"), *(["u.bytes"] if texts else []))


def eligible() -> Column:
    """Chunks with a word, pairs, and lines of over PASSAGE words; words and next are the words of a unit's first line and of the second."""
    return (F.col("kind") == PAIR) | ((F.col("kind") == CHUNK) & (F.length(F.trim(F.col("bytes"), F.lit(" \t\n\x0b\x0c\r"))) > 0)) | ((F.col("kind") == LINE) & (F.col("words") > PASSAGE))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start"))


def ranges(gone: DataFrame) -> DataFrame:
    """gone: units that occur earlier. (doc_id, _version, first, last) of the lines that go: runs of neighbours with a chunk that goes or over PASSAGE words, and long lines."""
    doc = ["doc_id", "_version"]
    lines = gone.where(F.col("kind") != LINE).groupBy(*doc, "start").agg(F.bool_or(F.col("kind") == CHUNK).alias("chunk"), F.max("words").alias("words"), F.max("next").alias("next"))
    run = F.col("start") - F.row_number().over(Window.partitionBy(*doc).orderBy("start"))
    runs = lines.withColumn("run", run).groupBy(*doc, "run").agg(F.min("start").alias("first"), (F.max("start") + 1).alias("last"), F.bool_or("chunk").alias("chunk"), (F.sum("words") + F.max_by("next", "start")).alias("words"))
    single = gone.where(F.col("kind") == LINE).select(*doc, F.col("start").alias("first"), F.col("start").alias("last")).distinct()
    return runs.where(F.col("chunk") | (F.col("words") > PASSAGE)).select(*doc, "first", "last").unionByName(single)


def line_dedup(spark: SparkSession, docs: DataFrame, key=F.md5) -> DataFrame:
    """One row for every row of docs: doc_id, n_lines, n_removed, and the text without the lines that are copied from earlier ones, by doc_id and place.

    A null text counts as empty, which is one line and stays. Repeated rows (equal doc_id and text) are one document: what is first
    in one of them is first in all. Null ids come last and stay. Extra columns are ignored; an empty table gives an empty result.
    key may be any function of a unit's lines' digests: equal keys of different texts are told apart by bytes, and by kind.
    """
    folder = shared_dir(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), not_null().alias("_text")).withColumn("_version", F.md5("_text"))
    place = ["doc_id", "_version", "kind", "start"]
    parts = units(base, key, texts=True)
    index = stored(spark, units(base, key, texts=False), f"{folder}/index")
    often = stored(spark, index.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), f"{folder}/often")
    texts = maybe_in(spark, parts, often, f"{folder}/hits").groupBy("digest", "kind", "bytes").agg(_first().alias("first"), F.count("*").alias("n"))
    lines = F.split("bytes", "\n", -1)  # words are counted once for each text that is common, not for each line
    texts = texts.withColumns({"words": n_words(lines[0]), "next": n_words(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))}).where(eligible())
    one = lambda *names: [F.first(c).alias(c) for c in names]
    per_digest = texts.groupBy("digest").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n"), *one("first", "words", "next"))
    per_digest = stored(spark, per_digest.where("n > 1"), f"{folder}/verified")
    later = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start") > F.col("first")
    gone = maybe_in(spark, index, often, f"{folder}/hits-again").join(per_digest.where("n_texts = 1"), "digest").where(later).select(*place, "words", "next")
    mixed = per_digest.where("n_texts > 1").select("digest")
    if not mixed.isEmpty():  # different texts under one digest: each by its own bytes
        apart = parts.join(mixed, "digest").join(texts.join(mixed, "digest").select("digest", "kind", "bytes", "first", "words", "next"), ["digest", "kind", "bytes"])
        gone = gone.unionByName(apart.where(later).select(*place, "words", "next"))
    gone = ranges(gone).groupBy("doc_id", "_version").agg(F.collect_list(F.struct("first", "last")).alias("_gone"))
    out = base.join(gone, (base["doc_id"] == gone["doc_id"]) & (base["_version"] == gone["_version"]), "left").select(base["doc_id"], "_text", "_gone")
    out = out.withColumn("_lines", F.split(F.col("_text"), "\n", -1))
    left = F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.flatten(F.transform("_gone", lambda g: F.sequence(g["first"], g["last"]))))  # by hashing: linear
    out = out.withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    n = F.size("_lines").cast("long")
    text = F.when(F.col("_left").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_left", lambda i: F.element_at("_lines", i)), "\n"))
    return out.select("doc_id", n.alias("n_lines"), F.when(F.col("_left").isNull(), 0).otherwise(n - F.size("_left")).cast("long").alias("n_removed"), text.alias("text"))
