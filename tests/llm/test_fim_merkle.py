"""Fill-in-middle and Merkle manifest against plain versions and their SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import fim, merkle, queries

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_fim(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h1, h2, h3, h4 = (int(sha(f"7:{'null' if doc_id is None else doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text), text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text), out)


def some_texts():
    random.seed(12)
    rows = [(i, "".join(random.choice(["a", "é", "\n", "\n", "𝄞", " ", "<", "P", ">", "\r"]) for _ in range(random.randint(0, 40)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "x"), (904, "a<P>b\nc"), (905, "<S>"), (906, "q\n" * 50_000 + "é" * 100_000), (None, "one\ntwo\nthree"), (None, None), (7, rows[7][1]), (7, "another\ntext\n"), (908, "<P\n>\n<S"), (909, "\x00\n\x00")]
    return rows


@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 20)])
def test_fill_in_middle(spark, docs, rate, spm):
    rows = some_texts()
    df = docs(*rows).withColumns({"form": F.lit(1), "output_sha256": F.lit(2), "prefix_chars": F.lit(3)})
    got = [tuple(r) for r in fim.fill_in_middle(df.repartition(3), texts=True, rate=rate, spm=spm).collect()]
    want = [plain_fim(i, t, rate, spm) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"} and all(r[6] == sha(t or "") for r, (_, t) in zip(want, rows, strict=True))
    assert fim.fill_in_middle(df.where("false")).count() == 0


def test_pieces_are_cut_arranged_and_restored():
    """Nothing is copied; a cut inside a piece makes two of it; the inverse permutation gives the document's bytes again."""
    data = "ab\ncd\né".encode()
    pieces = fim.whole(data)
    parts = fim.cut(pieces, [2, 2, 7])
    assert [[(p.start, p.end) for p in part] for part in parts] == [[(0, 2)], [], [(2, 7)], [(7, 8)]]
    assert [[(p.start, p.end) for p in x] for x in fim.cut(parts[0] + parts[2] + parts[3], [1, 4])] == [[(0, 1)], [(1, 2), (2, 4)], [(4, 7), (7, 8)]]
    for form in fim.ORDERS:
        out = b"".join(p.view() for p in fim.arranged([parts[0], parts[3], parts[2]], form))
        assert b"".join(p.view() for p in fim.restored(out, form)) == data and out != data
    assert fim.code_points(pieces) == 7 and fim.line_ends(data).tolist() == [3, 6, 8] and fim.line_ends(b"").tolist() == [] and fim.line_ends(b"\n").tolist() == [1]


def plain_manifest(rows, tampered):
    def leaf(r):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, pos, h):
        proof = []
        for level in levels[:-1]:
            run, k = level[pos // 3 * 3 : pos // 3 * 3 + 3], pos % 3
            proof += run[:k] + run[k + 1 :]
            run[k], pos = h, pos // 3
            h = sha(*run)
        return proof, h

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, r in enumerate(groups[s]):
            below, h = climb(trees[s], pos, leaf((*r[:4], tampered(r[0], r[4]))))
            over, h = climb(top, k, h)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*below, *over), h, h == top[-1][0]))
    return out


def without_ends(i, t):
    return t.replace("\n", "") if i is not None and t is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t


def manifest_of(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"tree": F.lit(1), "pos": F.lit(2), "n": F.lit(3), "leaf": F.lit("x"), **more})
    return [tuple(r) for r in merkle.manifest(spark, df.repartition(5)).collect()]


def test_manifest_is_the_plain_trees(spark, monkeypatch):
    """Sources of 1, 2, 3, 4, 81, 82 and 300 documents, one without a name; nulls, repeated rows and ids; blocks in several copies."""
    random.seed(13)
    rows, i = [], 0
    for source, n in (("a", 1), ("b", 2), ("é", 3), (None, 4), ("z", 81), ("", 82), ("hot", 300)):
        for _ in range(n):
            rows.append((i, source, random.choice(["en", None]), random.choice([5, None]), random.choice(["one\ntwo", "x", None, "", "é\n"])))
            i += random.randint(1, 3)
    rows += [rows[50], rows[50], (rows[60][0], rows[60][1], "fr", 1, "other\ntext"), (None, "b", "en", 1, "no id\n"), (None, "b", "en", 1, "no id\n"), (5000, "z", "en", 3, "q\n" * 200_000)]
    monkeypatch.setattr(merkle, "CLIMBERS", 50)
    got, want = manifest_of(spark, rows), plain_manifest(rows, without_ends)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_many_sources_and_of_few_rows(spark):
    many = [(k, f"s{k % 250}", "en", k, f"text\n{k}") for k in range(300)]
    assert sorted(manifest_of(spark, many)) == sorted(plain_manifest(many, without_ends))
    for rows in ([(1, "a", "en", 1, "alone\n")], [(1, "a", None, 1, "x\n"), (2, "b", "en", 1, "y\n")], [(k, None, "en", 1, "x\n") for k in range(100)]):
        assert sorted(manifest_of(spark, rows)) == sorted(plain_manifest(rows, without_ends))
    assert manifest_of(spark, []) == []


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_merkle_manifest"])
def test_registered_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
