"""Exact and near duplicates, vectors, lines: brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import components, linededup, lsm, rabitq, simhash

SF = "/root/testdata/sf0.001"


def classes(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000)] + [(3000, 3000 + i) for i in range(1, 200)]
    got = {r.id: r.component for r in components.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(6000, edges)
    assert got == {i: want[i] for a, b in edges if a != b for i in (a, b)}
    assert components.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def brute_exact(rows):
    out, groups = {}, {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for i, t in rows:
        g = groups[re.sub("[\x20\x09-\x0d]", "", t or "")]
        out.setdefault(i, []).append((min(g)[3], len(g)))
    return out


@pytest.mark.parametrize("key", [lsm.digest, lambda c: F.substring(F.sha2(c, 256), 1, 1), lambda c: F.lit("same")])
def test_exact_groups(spark, docs, key):
    """Also with digests that collide: bytes decide."""
    random.seed(2)
    rows = [(i, "".join(random.choice(["a", "b", " ", "\n", "é"]) for _ in range(random.randint(0, 4)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \t"), (903, " "), (904, "x" * 200_000), (905, "x" * 200_000 + " "), (None, "null id"), (None, "null  id"), (7, rows[7][1])]
    got: dict = {}
    for r in lsm.exact_groups(spark, docs(*rows).repartition(5), key).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size))
        assert r.kept == (r.doc_id == r.keep_id)
    want = brute_exact(rows)
    assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in want.items()}
    assert lsm.exact_groups(spark, docs(*rows).where("false"), key).count() == 0


def test_filters_keep_entries_from_being_merged(spark, tmp_path):
    """All digests that two runs hold are merged, and few others; a filter has room for what it holds."""
    rows = [(k % 4, f"one {k}") for k in range(4000)] + [(r, f"two {k}") for k in range(200) for r in (k % 4, (k + 1) % 4)]
    log = spark.createDataFrame([(i, d, 5, r) for i, (r, d) in enumerate(rows)], "doc_id long, digest string, n_points int, run int")
    runs = lsm.beyond_own(spark, lsm.flush(spark, log, f"{tmp_path}/runs"), f"{tmp_path}/filters").collect()
    assert len(runs) == len(rows)
    assert all(r.maybe for r in runs if r.digest.startswith("two")) and sum(r.maybe for r in runs if r.digest.startswith("one")) < 800
    level = {r.digest: (r.keep_id, r.group_size) for r in lsm.compact(spark, spark.read.parquet(f"{tmp_path}/runs"), f"{tmp_path}/level").collect()}
    assert len(level) == 4200 and all(n == (2 if d.startswith("two") else 1) for d, (_, n) in level.items())
    assert all(level[d][0] == min(i for i, (_, x) in enumerate(rows) if x == d) for d in ("two 0", "two 199", "one 7"))
    assert [lsm.bits_for(n, 16) for n in (0, 10**5, 10**7, 10**12)] == [15, 21, 28, 44]


def plain_fingerprint(t):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints():
    random.seed(3)
    texts = [None, "", " \n", "one", "One two", "ONE two\tthree", "a b c d", "Éa b É c\x0bd\x1ce", "a " * 40_000, *(" ".join(random.choice("abcdefgh") for _ in range(random.randint(1, 60))) for _ in range(300))]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_carry_save_counts_any_radius():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[100:200] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 60, 100, dtype=np.uint64))
    planes = simhash.planes_of(fps)
    for radius in (0, 1, 2, 3, 5, 7, 12):
        for q in (0, 7, 150):
            mask = simhash.near(planes, int(fps[q]), radius)
            assert (simhash._lanes(mask, 300) == (np.bitwise_count(fps ^ fps[q]) <= radius)).all()
        for by in (1, 5, 63):
            assert (simhash._lanes(simhash.near_shifted(planes, by, radius), 300 - by) == (np.bitwise_count(fps[:-by] ^ fps[by:]) <= radius)).all()


@pytest.mark.parametrize("chunk", [8192, 7])
def test_hamming_links_join_what_hangs_together(spark, chunk):
    """Random fingerprints, chains, and one dense group that shares most blocks."""
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 1 << 63, 200, dtype=np.uint64).tolist())
    for base in list(fps)[:60]:
        x = base
        for _ in range(4):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {0x0123456789ABCDEF ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    fps = sorted(fps)
    f = np.array(fps, np.uint64)
    want = classes(len(fps), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 3), strict=True))
    table = spark.createDataFrame([(int(x), i) for i, x in enumerate(f.view(np.int64))], "fp long, rep long")
    links = [(r.a, r.b) for r in simhash.hamming_links(spark, table, chunk=chunk).collect()]
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
    assert classes(len(fps), links) == want
    assert len(links) < 12 * len(fps) * (1 if chunk > 100 else 60)


def test_simhash_components(spark, docs):
    rows = [(1, None), (2, ""), (3, "  "), (4, "alpha beta gamma delta " * 30), (5, "ALPHA beta gamma delta " * 30), (5, "ALPHA beta gamma delta " * 30), (6, "something else entirely here and there"), (None, "alpha beta gamma delta " * 30)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(spark, docs(*rows)).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (None, 4)], key=repr)
    assert simhash.simhash_components(spark, docs(*rows).where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long")


def test_similar_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64)).astype(np.float32)
    for i in range(100, 300):
        x[i] = x[i % 20] + rng.standard_normal(64) * rng.uniform(0.05, 0.6)
    x[390] = x[5]
    x[391] = x[5]
    rows = [(i, [float(v) for v in r], 0, 0) for i, r in enumerate(x)]
    rows += [(500, None, 0, 0), (501, [], 0, 0), (502, [0.0] * 64, 0, 0), (503, [float("nan")] + [1.0] * 63, 0, 0), (504, [None] + [1.0] * 63, 0, 0), (505, [float("inf")] + [1.0] * 63, 0, 0), (506, [1.0, 2.0], 0, 0), (507, [2.0, 4.0], 0, 0)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    want = classes(400, zip(*np.nonzero(near), strict=True))
    for chunk in (4096, 5):
        got = {r.vec_id: r for r in rabitq.similar(spark, vectors(spark, rows), chunk=chunk).collect()}
        links = np.array([got[i].n_links for i in range(400)])
        assert (links <= near.sum(1) - 1).all() and links.sum() >= 0.97 * (near.sum() - 400)
        assert sum(got[i].component_id == want[i] for i in range(400)) >= 395
        assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 506)) and got[506].n_links == 1 and got[507].component_id == 506
    assert rabitq.similar(spark, vectors(spark, rows).where("false")).count() == 0
    assert rabitq.similar(spark, vectors(spark, [(1, None, 0, 0)])).first().component_id == 1


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    x, q = rabitq.unit_rows(rng.standard_normal((3000, 64))), rabitq.unit_rows(rng.standard_normal((20, 64)))
    codes, factors = rabitq.codes_of(x)
    a, b = np.repeat(np.arange(20), 3000), np.tile(np.arange(3000), 20)
    about, error = rabitq.estimates(rabitq.query_planes(q @ rabitq.rotation(64, 0).T), codes, factors, 64, a, b)
    gap = about - (q @ x.T).ravel()
    assert abs(gap.mean()) < 0.003 and (np.abs(gap) <= error).mean() > 0.999


def test_close_pairs_are_all_pairs_of_a_bucket():
    """Small and large buckets, and two sides of a large one."""
    rng = np.random.default_rng(11)
    sizes = [1, 2, 3, 64, 65, 200, 1, 40, 30, 90]
    keys = np.repeat(np.arange(len(sizes)), sizes)
    sides = np.where(keys < 8, 2, rng.integers(0, 2, len(keys)))
    codes = rng.integers(0, 1 << 63, (len(keys), 2), dtype=np.uint64)
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2)
    i, j = np.nonzero((keys[:, None] == keys[None]) & (apart <= 60))
    want = {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x < y and (sides[x] == 2 or sides[x] != sides[y])}
    got = [tuple(sorted(p)) for a, b in rabitq.close_pairs(keys, sides, codes, 60) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_trees_are_joined():
    rng = np.random.default_rng(12)
    parent = np.arange(500)
    a, b = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    for k in range(0, 300, 37):
        rabitq.joined(parent, a[k : k + 37], b[k : k + 37])
    assert parent.tolist() == classes(500, zip(a.tolist(), b.tolist(), strict=True))


def test_recall_exactly_at_the_threshold():
    rng = np.random.default_rng(8)
    a, n = rabitq.unit_rows(rng.standard_normal((4000, 64))), rng.standard_normal((4000, 64))
    b = 0.9 * a + np.sqrt(1 - 0.81) * rabitq.unit_rows(n - (n * a).sum(1, keepdims=True) * a)
    for width in (1, 2, 3):
        t = rabitq.tables_for(64, 0.9, width)
        assert np.mean(np.any([rabitq.keys_of(a, k, width) == rabitq.keys_of(b, k, width) for k in range(t)], axis=0)) >= 0.9


def plain_units(text):
    """Lines of a text, and (kind, first line, text) of its chunks, neighbours and long lines."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:7], 16)
    lines, units, start = text.split("\n"), [], 0
    words = [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in lines]
    for i, x in enumerate(lines):
        roll = 31 * (h(lines[i - 1]) if i else 0) + h(x)
        if i + 1 == len(lines) or roll % 1000003 % 3 == 0:
            if i > start and any(words[start : i + 1]):
                units.append(("c", start, "\n".join(lines[start : i + 1])))
            start = i + 1
        if i + 1 < len(lines):
            units.append(("p", i, x + "\n" + lines[i + 1]))
        if words[i] > 50:
            units.append(("l", i, x))
    return lines, words, units


def plain_line_dedup(rows):
    first = {}
    for i, t in rows:
        for kind, at, x in plain_units(t or "")[2]:
            first[kind, x] = min(first.get((kind, x), (True,)), (i is None, i or 0, at))
    want = {}
    for i, t in rows:
        lines, words, units = plain_units(t or "")
        gone, marked = {(k, at) for k, at, x in units if i is not None and first[k, x] < (False, i, at)}, set()
        k = 0
        while k < len(lines):
            e = k
            while ("p", e) in gone:
                e += 1
            if e > k and (any(("c", x) in gone for x in range(k, e)) or sum(words[k : e + 1]) > 50):
                marked |= set(range(k, e + 1))
            k = e + 1
        marked |= {at for kind, at in gone if kind == "l"}
        want[i] = (len(lines), len(marked), "\n".join(x for k, x in enumerate(lines) if k not in marked))
    return want


@pytest.mark.parametrize("key", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_line_dedup(spark, docs, key):
    random.seed(9)
    pool = [" ".join(random.choice(["a", "b", "é"]) for _ in range(random.choice([0, 1, 3, 30, 60]))) for _ in range(40)]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, rows[3][1]), (None, rows[3][1]), (504, "line\n" * 2000), (505, "x\n\n\n\ny"), (506, "z\n\n\n\nw")]
    want = plain_line_dedup(rows)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.line_dedup(spark, docs(*rows), key).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 200 and got[506][1] == 0
    assert linededup.line_dedup(spark, docs(*rows).where("false"), key).count() == 0


def test_every_copied_passage_of_over_50_words_goes(spark, docs):
    """Passages of a few long or many short lines in otherwise unrelated documents, at any place in them: removed whole, all else kept."""
    random.seed(10)
    line = lambda n: " ".join(f"w{random.randrange(10**8)}" for _ in range(n))
    rows, kept = [], {}
    for k in range(240):
        n, size = [(1, 51), (2, 30), (3, 20), (4, 15), (6, 10), (17, 3), (26, 2)][k % 7]
        passage = [line(size) for _ in range(n)]
        for j in range(3):
            before, after = [line(9) for _ in range(random.randint(1, 6))], [line(9) for _ in range(random.randint(1, 6))]
            rows.append((3 * k + j, "\n".join(before + passage + after)))
            kept[3 * k + j] = rows[-1][1] if j == 0 else "\n".join(before + after)
    assert {r.doc_id: r.text for r in linededup.line_dedup(spark, docs(*rows)).collect()} == kept


def test_vectors_without_ids_link_and_join_others(spark):
    """At angles 0, 0.4 and 0.8 a vector without an id joins its neighbours; two equal ones without ids are a component of their own, without a name."""
    at = lambda t: [float(np.cos(t)), float(np.sin(t)), 0.0]
    schema = "vec_id long, embedding array<double>"
    got = {repr(r.vec_id): (r.n_links, r.component_id, r.kept) for r in rabitq.similar(spark, spark.createDataFrame([(1, at(0)), (None, at(0.4)), (3, at(0.8))], schema), recall=0.9999).collect()}
    assert got == {"1": (1, 1, True), "None": (2, 1, False), "3": (1, 1, False)}
    got = rabitq.similar(spark, spark.createDataFrame([(None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 2.0]), (5, at(0))], schema), recall=0.9999).collect()
    assert sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("5", 0, 5, True), ("None", 1, None, True), ("None", 1, None, True)]


def test_pairs_are_compared_once_whatever_tables_they_meet_in():
    rng = np.random.default_rng(5)
    unit = rabitq.unit_rows(rng.standard_normal((40, 8)))
    unit[20:] = rabitq.unit_rows(unit[:20] + 0.05 * rng.standard_normal((20, 8)))
    keys = np.array([rabitq.keys_of(unit, t, 1) for t in range(6)])
    a, b = np.triu_indices(40, 1)
    seen = np.zeros(len(a), int)
    for t in range(6):
        together = keys[t, a] == keys[t, b]
        seen[together] += rabitq.first_meeting(keys[:5], np.full(40, t), a[together], b[together])
    assert (seen == (keys[:, a] == keys[:, b]).any(0)).all()


def test_fingerprints_without_ids_join_others(spark, docs, monkeypatch):
    """Fingerprints 0, 7, 63: the one in between has no doc_id, and still joins the others."""
    fps = spark.createDataFrame([(1, 0), (None, 7), (3, 63), (None, 0x0F0F0F0F0F0F0F0F), (None, 0x0F0F0F0F0F0F0F0F)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: fps)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(spark, docs((1, "x"))).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (None, 7, 1), (3, 63, 1), (None, 0x0F0F0F0F0F0F0F0F, None), (None, 0x0F0F0F0F0F0F0F0F, None)], key=repr)


def test_filter_of_hits_beyond_a_broadcast(spark, docs, monkeypatch, tmp_path):
    """The same rows pass, whether pages are broadcast or joined: all hits, and few others."""
    rows = [(i, f"text {i % 700 if i < 1400 else i}") for i in range(4000)]
    df = docs(*rows).repartition(4)
    want = sorted(map(tuple, lsm.exact_groups(spark, df).collect()))
    monkeypatch.setattr(lsm, "HIT_BYTES", 0)
    monkeypatch.setattr(lsm, "RUN_BYTES", 0)
    assert sorted(map(tuple, lsm.exact_groups(spark, df).collect())) == want
    digests = df.select(lsm.digest(lsm.without_spaces(F.col("text"))).alias("digest"), "doc_id")
    hits = digests.groupBy("digest").count().where("count > 1").select("digest")
    passed = [r.doc_id for r in lsm.maybe_in(spark, digests, hits, f"{tmp_path}/pages").collect()]
    assert set(range(1400)) <= set(passed) and len(passed) < 1400 + 400
