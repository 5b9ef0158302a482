"""Chat formatting, mixing, language, pipeline, and the queries with SQL."""

import glob
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import bpe, chat, langid, mixing, queries

SF = "/root/testdata/sf0.001"


def fold(events):
    """Plain reconstruction of one conversation: [(role, text)]."""
    out = []
    for m, _, _, role, text, kind in sorted(events, key=lambda e: (e[0], e[1], e[2], e[3], e[4])):
        same = out and out[-1][0] == m and kind != "message"
        old = out.pop() if same else (m, role, "")
        out.append((m, old[1], old[2] + text if kind == "delta" else "" if kind == "regenerate" else text))
    return [(r, t) for _, r, t in out]


def test_event_log_is_folded_and_read_back(spark):
    random.seed(1)
    nth = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}
    bits = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "\\", "\\\\", "<", "|", "é", "\n", "$1", "x", ""]
    rows, logs = [], {}
    for c in range(25):
        for s in range(random.randint(1, 120)):
            kind, m = random.choice(["message", "delta", "delta", "edit", "regenerate"]), s // 3
            role, text = random.choice(["user", "assistant", "to ol\n<|", ""]), "".join(random.choice(bits) for _ in range(random.randint(0, 6)))
            rows.append((c, m, s, kind, role, text))
            logs.setdefault(c, []).append((m, s, nth[kind], role, text, kind))
    df = spark.createDataFrame(rows, "conv_id long, msg long, seq long, kind string, role string, text string").repartition(4)
    for r in chat.format_conversations(df, block=4).withColumn("t", chat.parsed(F.col("formatted"))).collect():
        want = fold(logs[r.conv_id])
        assert [(t.role, t.text) for t in r.t] == want
        assert r.formatted.count("<|im_start|>") == len(want) and "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_digests_and_edges(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b"), (2, 0, None, None), (3, None, "assistant", "x"), (3, 5, "assistant", "y"), (3, 5, "assistant", "y"), (None, 0, "user", "z")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(chat.message_events(chat.with_probe(spark, conv)))).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    probe = chat.PROBE
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == h(probe) and got[-1].turns_sha256 == h(f"user\n{probe}\nassistant\n{probe}\n")
    assert got[1].loss_chars == 3 and got[2].turns_sha256 == h("\n\n") and got[2].loss_chars == 0 and got[3].loss_sha256 == h("xyy") and got[None].n_turns == 1
    assert chat.format_conversations(chat.message_events(conv.where("false"))).count() == 0


def test_many_messages_in_one_conversation(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), "id", F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text")).withColumnRenamed("id", "turn")
    r = chat.digests(chat.format_conversations(chat.message_events(df))).first()
    assert r.n_turns == 3000 and r.loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 3000, 2)).encode()).hexdigest()


def test_streamed_log_folds_to_the_rows(spark):
    """Deltas, edits and regenerations of every row, ties and repeated rows included, give what whole messages give."""
    random.seed(5)
    words = ["</s>", "\\", "é😀", "\n", "[INST]", "word ", ""]
    rows = [(c, random.choice([None, 0, 0, 1, 2, 40]), random.choice(["user", "assistant", None]), random.choice([None, "".join(random.choice(words) for _ in range(random.randint(0, 9)))])) for c in (0, 1, 2, None) for _ in range(30)]
    conv = spark.createDataFrame(rows + rows[:40], "conv_id long, turn long, role string, text string").withColumns({"copy": F.lit("clash"), "seq": F.lit(-1), "way": F.lit(9)}).repartition(3)
    log = chat.streamed_events(conv)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["message"] == len(rows) + 40
    same = lambda events: sorted(map(str, chat.digests(chat.format_conversations(events)).collect()))
    assert same(log) == same(chat.message_events(conv))
    assert chat.streamed_events(conv.where("false")).count() == 0


def test_mixing_meets_its_rates(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").when(F.col("id") % 20 == 9, "tiny").alias("source"), F.lit("x").alias("text"), F.lit(1).alias("_c"))
    w = spark.createDataFrame([("big", 1.0), ("mid", 2.0), ("tiny", 1.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix(spark, df, w).groupBy("source").count().collect()}
    assert abs(got["big"] - 5000) < 300 and abs(got["mid"] - 10000) < 400 and abs(got["tiny"] - 5000) < 300 and None not in got
    clash = df.withColumns({"_mix_copy": F.lit(77), "row": F.lit(1), "n_copies": F.lit(-1), "copy_no": F.lit(-2), "mix_order": F.lit("o"), "name": F.lit("n"), "rate": F.lit(0.0), "a.b": F.lit(5)})
    again = mixing.mix(spark, clash.repartition(7), w)
    assert again.columns == clash.columns and again.count() == sum(got.values())
    assert {tuple(r)[3:] for r in again.distinct().limit(3).collect()} == {(1, 77, 1, -1, -2, "o", "n", 0.0, 5)}
    assert mixing.mix(spark, df.where("false"), w).count() == 0
    one = mixing.mix(spark, spark.createDataFrame([(1, None, None), (None, None, "y")], "doc_id long, source string, text string"), total=300.0)
    assert {r.doc_id for r in one.collect()} == {1, None} and abs(one.count() - 600) < 120


def test_copies_are_poisson(spark):
    for mean in (0.3, 1.0, 4.5):
        r = spark.range(20_000).select(mixing.copies(F.lit(mean), F.col("id").cast("string")).alias("n")).agg(F.avg("n"), F.var_pop("n"), F.avg((F.col("n") == 0).cast("double"))).first()
        assert abs(r[0] - mean) < 0.05 * mean + 0.01 and abs(r[1] - mean) < 0.08 * mean + 0.01 and abs(r[2] - 2.718281828 ** -mean) < 0.015


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.95 and r[1] < 0.03 and 0 <= r[2] and r[3] <= 1


def plain_language(text, learned):
    """Every language's size of every piece, compressed anew; the smallest total."""
    import unicodedata

    import zstandard

    kinds = [unicodedata.category(c)[0] for c in text or ""]
    if "L" not in kinds:
        return "und", 0.0, True
    low = text.lower()
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in low).split(" ")
    data = f" {' '.join(w for w in words if w)} ".encode()
    sizes = []
    for name in sorted(learned):
        params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, **langid.EFFORT)
        total = 0
        for k in range(0, len(data), 4096):
            total += len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(data[k : k + 4096]))
        sizes.append((total, name))
    (best, name), (second, _) = sorted(sizes)[:2]
    return name, 0.5 + 0.5 * min(1.0, (1 - best / second) / 0.25), 1 - best / second < langid.MARGIN


def test_language_query_is_plain_recompression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    import zlib

    learned = langid.dictionaries(docs.where(~queries.held_out()))
    got = {r.doc_id: r for r in queries.op7_language_id(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.lang_pred, g.score, g.rejected) == plain_language(r.text, learned) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_letters_are_letters():
    """Numbers that are no decimals are no letters; marks don't cut words."""
    for t in ("½ ²", "Ⅷ ① 12 _", "\u0301\u0308", "!? \n", ""):
        assert langid.plain(t) == b"", t
    assert langid.plain("Ne\u0301e A_b ªx²y") == " ne\u0301e a b ªx y ".encode() and langid.plain("हिन्दी") == " हिन्दी ".encode()
    assert langid.judge_by({"aa": b" alpha ", "bb": b" beta "}, 0.0)("½ ²") == ("und", 0.0, True)


def test_dictionaries_reach_the_ends_of_texts_and_all_languages(spark):
    from pyspark.sql import types as T

    tail = spark.createDataFrame([("xx", "start " * 3000 + "finish " * 3000)], "lang string, text string")
    many = spark.range(450).select(F.concat(F.lit("l"), "id").alias("lang"), F.concat(F.lit("word"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    d = langid.dictionaries(tail.unionByName(many))
    assert isinstance(tail.schema["lang"].dataType, T.StringType) and len(d) == 451 and b"finish" in d["xx"] and b"start" in d["xx"]


def test_language_edges(spark, docs):
    learned = {"aa": b" alpha beta gamma delta " * 200, "bb": b" uno dos tres quatro " * 200}
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "ALPHA beta! gamma"), (5, "uno dos " * 60_000), (None, "tres quatro dos")]
    got = {r.doc_id: r for r in langid.classify(docs(*rows), learned).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "bb", "bb"]
    assert got[1].rejected and got[1].score == 0 and not got[4].rejected
    assert all(r.lang_pred == "und" for r in langid.classify(docs(*rows), {}).collect())
    assert langid.dictionaries(docs((1, None))) == {} and langid.classify(docs(*rows).where("false"), learned).count() == 0
    clash = docs(*rows).withColumns({"_language": F.lit("MINE"), "found": F.lit(1), "row": F.lit(2), "a.b": F.lit(3)})
    kept = langid.classify_rows(clash, learned)
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["4", "5", "None"] and kept.columns == clash.columns
    assert {(r._language, r.found, r.row, r["a.b"], r.lang) for r in kept.collect()} == {("MINE", 1, 2, 3, "en")}
    assert {r.lang for r in langid.classify_rows(clash.withColumn("lang", F.lit(None).cast("string")), learned).collect()} == {"aa", "bb"}


def test_sample_is_bounded_and_takes_copies_once(spark, docs):
    df = docs(*[(i, f"{'abcdefghij'[i % 10] * (1 + i // 10 % 5)} other") for i in range(3000)])
    d = langid.dictionaries(df, rows=20, size=1 << 12)
    assert d["en"].count(b"other") <= 20 and len(set(d["en"].split())) > 10


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, db, name):
    df, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def plain_copies(rows):
    """doc_id to its number of copies: rates from square roots, Poisson sums inverted at numbers from md5. rows: (doc_id, source)."""
    import math
    from collections import Counter

    n = Counter(s for _, s in rows)
    weights = {s: math.sqrt(k) for s, k in n.items()}
    out = {}
    for i, s in rows:
        rate = len(rows) * weights[s] / sum(weights.values()) / n[s]
        parts, total = math.ceil(rate), 0
        for j in range(1, parts + 1):
            u, mean, k, term, below = int(hashlib.md5(f"7|{i}|{j}".encode()).hexdigest()[:13], 16) / (1 << 52), rate / parts, 0, math.exp(-rate / parts), 0.0
            while (below := below + term) < u and k <= 20:
                k += 1
                term *= mean / k
            total += k
        out[i] = total
    return out


def test_pipeline_is_its_stages_by_brute_force(spark):
    """Each stage's decisions, made again plainly from what the stage before kept: recompression, groups by text, all pairs of fingerprints, Poisson sums, the tokenizers library."""
    from tokenizers import Tokenizer

    from tests.llm.test_dedup import brute_exact, classes, plain_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = langid.dictionaries(docs.where(~queries.held_out()))
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if not plain_language(r.text, learned)[2]]
    keep = {k for v in brute_exact(rows).values() for k, _ in v}
    rows = sorted(r for r in rows if r[0] in keep)
    fps = [plain_fingerprint(t) for _, t in rows]
    cls = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    rows = [rows[i] for i in sorted(set(cls))]
    copies = plain_copies([(i, source[i]) for i, _ in rows])
    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        h = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        want += [(i, ids, h)] * copies[i]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and len(want) > 50
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in got.collect()) == sorted(want)


def test_stages_keep_the_columns_and_stand_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_kept", F.lit("clash"))
    for df in (docs.limit(30), docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
            out.count()
