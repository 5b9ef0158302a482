"""Language identification by compression: a text belongs to the language whose raw-content zstandard dictionary makes it smallest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Bound of the training sample: labelled rows of each language, drawn by hash from all of them, and bytes of its dictionary.
SAMPLE_ROWS = 400
DICTIONARY_BYTES = 64 << 10
#: Characters of the pieces that sampled texts are cut into; a dictionary is made of pieces from anywhere in them, drawn by hash.
DRAWN = 512
#: Texts are compressed in pieces of this many bytes, each beginning at the dictionary anew, so that long texts don't become their own dictionary.
PIECE = 4 << 10
#: Search effort: short matches of at least four bytes, as words of one language share few long ones.
EFFORT = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 17, "hash_log": 17, "chain_log": 16, "search_log": 4}
#: Smallest lead of the best language over the next, as a share of the next one's size. A narrower lead rejects the text.
MARGIN = 0.001

#: Words are letters and the marks on them.
_BETWEEN, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    """Lower-case words with single spaces between them, one at either end; without a letter: nothing."""
    if not _LETTER.search(text):
        return b""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} ".encode()


def dictionaries(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Language to dictionary, from a bounded sample of labelled rows: those whose text has the smallest hashes, equal texts once.

    Their whole texts are cut into pieces, and the pieces with the smallest hashes fill the dictionary. Rows without text or lang
    don't count, nor do languages without a letter in any sampled text; no language is left out for its rank. Only rows and pieces
    whose hash is under about twice the share that is wanted are moved, so no task gets a language as a whole, and the driver gets
    about four dictionaries' bytes of pieces for each language. An empty table gives no dictionary.
    """
    spark, unit = docs.sparkSession, lambda h: F.col(h) / F.lit(2.0**64) + 0.5
    some = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}

    def share(wanted: dict[str, float]) -> F.Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * wanted[k] / max(1, n)))]), F.col("lang"))

    near = some.where(unit("h") <= share(dict.fromkeys(counts, rows))).groupBy("lang", "h").agg(F.min("text").alias("text"))
    near = stored(spark, near, f"{shared_dir(spark)}/sample")
    bounds = near.groupBy("lang").agg(F.get(F.sort_array(F.collect_list("h")), F.lit(rows - 1)).alias("bound"))  # about twice the rows wanted, and as many numbers
    near = near.join(F.broadcast(bounds), "lang").where("bound is null or h <= bound")
    pieces = near.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DRAWN}}}"), F.lit(0))).alias("piece")).withColumn("h", F.xxhash64("piece"))
    counts = {k: 0 for k in counts} | {r["lang"]: r["n"] for r in pieces.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    found = pieces.where(unit("h") <= share(dict.fromkeys(counts, 2 * size / DRAWN))).groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        if len(out.setdefault(r["lang"], b"")) < size:
            out[r["lang"]] += plain(r["piece"])
    return {k: v[:size] for k, v in out.items() if v}


def judge_by(learned: dict[str, bytes], margin: float):
    """Makes the function that judges a text: (language, score, rejected)."""
    names = sorted(learned)
    packers = []
    for n in names:
        known = zstandard.ZstdCompressionDict(learned[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        effort = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, **EFFORT)
        known.precompute_compress(compression_params=effort)
        packers.append(zstandard.ZstdCompressor(compression_params=effort, dict_data=known).compress)

    def judge(text: str | None) -> tuple[str, float, bool]:
        data = plain(text) if text else b""
        if not data or not names:
            return "und", 0.0, True
        sizes = [0] * len(names)
        for k in range(0, len(data), PIECE):
            piece = data[k : k + PIECE]
            for i, pack in enumerate(packers):
                sizes[i] += len(pack(piece))
        (best, i), (second, _) = sorted(zip(sizes, range(len(names)), strict=True))[:2] if len(names) > 1 else ((sizes[0], 0), (2 * sizes[0], 0))
        lead = 1 - best / second
        return names[i], 0.5 + 0.5 * min(1.0, lead / 0.25), lead < margin

    return judge


def classify(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs; docs needs only doc_id and text.

    Null text or no letter: und, score 0, rejected. With no language learned all are und. Ties go to the first language by name, with
    score 0.5 and rejected. Repeated rows and null ids stay; extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = judge_by(learned, margin)
        for batch in batches:
            got = [judge(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.selectExpr("cast(doc_id as long)", "cast(text as string)").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def classify_rows(docs: DataFrame, learned: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Rows of docs that are not rejected, with all their columns; a null lang is filled by the language found.

    Null texts, texts without a letter and ties go; repeated rows and null ids stay as they are; no column name can clash; an empty
    table gives an empty result.
    """

    @F.arrow_udf("string")
    def language(texts: pa.Array) -> pa.Array:
        judge = judge_by(learned, margin)
        return pa.array([None if r else name for name, _, r in (judge(t.as_py()) for t in texts)], pa.string())

    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), language(docs["text"].cast("string")).alias("found")).where("found is not null")
    return found.select(*[(F.coalesce(F.col("row.lang"), F.col("found")) if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
