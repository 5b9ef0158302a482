"""Live forms: roster, corrections and merged rows, over several batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.streaming import live as S

T = dt.datetime(2026, 9, 30, 14, 0)


def at(m):
    return T + dt.timedelta(minutes=m)


def test_roster_tells_of_who_never_came_and_of_silence(spark, tmp_path):
    """Two runs of one stream; the second brings only the clock."""
    rows = spark.createDataFrame([("a", at(0)), ("a", at(3)), ("b", at(1)), ("x", at(1))], "symbol string, ts timestamp")
    rows.write.parquet(str(tmp_path / "rows"))
    roster = spark.createDataFrame([("a",), ("b",), ("never",), ("a",)], "symbol string")
    beats = [[at(0), at(1), at(2), at(3), at(4)], [at(5), at(6), at(30)]]
    for part in beats:
        spark.createDataFrame([(t,) for t in part], "ts timestamp").write.mode("append").parquet(str(tmp_path / "beats"))
        out = S.finished(S.roster_alerts(S.landed(spark, str(tmp_path / "rows"), rows.schema), S.landed(spark, str(tmp_path / "beats"), "ts timestamp"), roster), str(tmp_path / "run"))
    got = {}
    for r in out.orderBy("at").collect():
        got.setdefault(r.symbol, []).append((int((r.at - T).total_seconds() // 60), r.late))
    assert got == {"a": [(0, False), (6, True)], "b": [(0, True), (1, False), (4, True)], "never": [(0, True)]}


def test_roster_of_many_in_few_buckets(spark, tmp_path):
    """Forty symbols share three states over three runs, and change as a plain machine for each of them says; a beat exactly as much later as is allowed isn't late, to the millisecond."""
    rng = random.Random(5)
    base = dt.datetime(2026, 1, 5, tzinfo=dt.timezone.utc)
    t = lambda ms: base + dt.timedelta(milliseconds=ms)
    names = [f"s{i}" for i in range(39)] + ["exact"]
    runs = [([(rng.choice(names[:30]), rng.randrange(600_000)) for _ in range(300)] + ([("exact", m) for m in range(1, 400, 7)] if k == 0 else []), sorted({rng.randrange(k * 200_000, k * 200_000 + 200_000) for _ in range(40)} | ({120_000 + m for m in range(1, 400, 7)} if k == 0 else set()))) for k in range(3)]
    roster = spark.createDataFrame([(n,) for n in names], "symbol string")
    state, want = {n: (None, None) for n in names}, set()
    for come, beats in runs:
        spark.createDataFrame([(s, t(m)) for s, m in come] + [("other", t(0))], "symbol string, ts timestamp").write.mode("append").parquet(str(tmp_path / "rows"))
        spark.createDataFrame([(t(m),) for m in beats] + [(None,)], "ts timestamp").write.mode("append").parquet(str(tmp_path / "beats"))
        out = S.finished(S.roster_alerts(S.landed(spark, str(tmp_path / "rows"), "symbol string, ts timestamp"), S.landed(spark, str(tmp_path / "beats"), "ts timestamp"), roster, buckets=3), str(tmp_path / "run"))
        for n in names:
            last, said = state[n]
            for m, beat in sorted([(m, False) for s, m in come if s == n] + [(m, True) for m in beats]):
                if not beat:
                    last = m if last is None else max(last, m)
                elif (late := last is None or m - last > 120_000 or last > m) != said:
                    said = late
                    want.add((n, m, late))
            state[n] = (last, said)
    got = [(r.symbol, r.ms - int(base.timestamp()) * 1000, r.late) for r in out.select("symbol", F.unix_millis("at").alias("ms"), "late").collect()]
    assert len(got) == len(want) and set(got) == want
    assert spark.read.format("statestore").load(str(tmp_path / "run" / "checkpoint")).count() == 3


def test_corrections_suppress_what_they_correct(spark, tmp_path):
    """A correction that is out of the look-back takes the place of the earlier article; times out of order count for nothing; what ages is told once."""
    schema = "url string, article_id string, published_at timestamp, received_at timestamp, first_observed_at timestamp, assessed_at timestamp"
    h = lambda n: 60 * n
    batches = [
        [("u", "first", at(0), at(1), at(2), at(3)), ("v", "only", at(0), at(1), at(2), at(3)), ("w", "broken", at(5), at(1), at(2), at(3))],
        [("u", "old", at(-h(30)), at(10), at(11), at(12)), ("u", "late copy", at(0), at(1), at(1), at(13))],
        [("z", "much later", at(h(40)), at(h(40)), at(h(40)), at(h(40)))],
        [("z", "later", at(h(41)), at(h(41)), at(h(41)), at(h(41)))],
    ]
    said = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = S.finished(S.corrections(S.landed(spark, str(tmp_path / "in"), schema)), str(tmp_path / "run"), "update").orderBy("epoch", "url").collect()
        said.append({(r.url, r.article_id, r.active) for r in out})
    assert said[0] == {("u", "first", True), ("v", "only", True)}
    assert said[1] - said[0] == {("u", "old", False)}
    assert ("v", "only", False) in said[3] and ("z", "later", True) in said[3] and not any(r[0] == "w" for r in said[3])


def test_merge_rewrites_what_a_batch_touches(spark, tmp_path):
    """Files written grow with the batch; a batch that is run again gives the same; an empty one changes nothing."""
    path = str(tmp_path / "latest")
    merge = S.upsert_latest(spark, path, ["k"], ["t"], buckets=16)
    schema = "k int, t int, v string"
    first = spark.createDataFrame([(k, 1, "a") for k in range(400)], schema)
    merge(first, 0)
    before = S.pointers(spark, path)
    second = spark.createDataFrame([(7, 2, "b"), (7, 3, "c"), (8, 0, "old")], schema)
    for _ in range(2):
        merge(second, 1)
        now = S.pointers(spark, path)
        assert set(now) == set(before) and {b for b, e in now.items() if e == 1} == {r.b for r in second.select(F.pmod(F.xxhash64("k"), F.lit(16)).cast("int").alias("b")).collect()}
        got = {r.k: (r.t, r.v) for r in S.latest_rows(spark, path, schema).collect()}
        assert len(got) == 400 and got[7] == (3, "c") and got[8] == (1, "a")
    merge(second.where("false"), 2)
    assert S.latest_rows(spark, path, schema).count() == 400
    assert S.latest_rows(spark, str(tmp_path / "nothing"), schema).count() == 0
