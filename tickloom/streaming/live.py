"""Live semantics as Structured Streaming. Sources are landed files; every function takes and gives a streaming DataFrame unless it says so."""

from __future__ import annotations

import statistics
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import CODES, REARM
from ..operators.ema import ALPHA, SEEDS, SIZE, WINDOW


def landed(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they land; with files_per_trigger an archive is replayed step by step."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)


def completed_bars(ticks: DataFrame, minutes: int = 1, late: str = "2 minutes", offset: str = "0 seconds") -> DataFrame:
    """ticks (symbol, ts, price, size, nth): bars of tumbling windows, each given once when no tick of it can still come. nth orders ticks of one time."""
    at = F.struct("ts", "nth")
    w = F.window("ts", f"{minutes} minutes", startTime=offset)
    bars = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def known_in_time(facts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Facts first seen before the minute they are about was decided; a later one never changes an earlier row. (ts, first_seen_ts)"""
    return facts.withWatermark("ts", late).where(F.col("first_seen_ts") <= F.col("ts") + F.expr("interval 1 minute"))


def distinct_within(rows: DataFrame, key: str, late: str = "24 hours") -> DataFrame:
    """The first of equal keys within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def advance(state: tuple | None, sample: tuple) -> tuple:
    """One step of a reversal warning, in plain Python for the stream; the batch fold says the same in columns.

    state: (cutoff, code, detected, acknowledged, clear, last_clear, warnings); sample: (cutoff, code, usable, acknowledged).
    """
    cutoff, code, usable, ack = sample
    match = bool(usable) and code in CODES
    _, was, detected, acked, clear, last, n = state or (-1, None, None, False, 0, None, 0)
    if state is None or cutoff < state[0]:
        quiet = usable and not match
        return (cutoff, code if match else None, cutoff if match else None, False, int(quiet), cutoff if quiet else None, n + match)
    acked = acked or bool(ack)
    if match:
        new = was is None or was != code or (acked and clear >= REARM)
        return (cutoff, code if new else was, cutoff if new else detected, acked and not new, 0, None, n + new)
    if not usable:
        return (cutoff, was, detected, acked, 0, None, n)
    clear = clear if last == cutoff else clear + 1 if last == cutoff - 1 else 1
    return (cutoff, was, detected, acked, clear, cutoff, n)


STATE = "cutoff int, code string, detected int, acknowledged boolean, clear int, last_clear int, warnings int"


def stateful(step: Callable[[tuple | None, tuple], tuple], columns: list[str], order: str, key: str):
    """A function for applyInPandasWithState: folds each key's rows in order and gives its state after the batch."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        for row in rows[columns].itertuples(index=False):
            now = step(now, tuple(None if pd.isna(v) else v for v in row))
        state.update(now)
        yield pd.DataFrame([(k[0], *now)], columns=[key, *[c.split()[0] for c in STATE.split(", ")]])

    return run


def reversal_warnings(samples: DataFrame) -> DataFrame:
    """samples (scope, seq, cutoff, code, usable, acknowledged): each scope's state after every batch that touches it."""
    f = stateful(advance, ["cutoff", "code", "usable", "acknowledged"], "seq", "scope")
    return samples.groupBy("scope").applyInPandasWithState(f, f"scope string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


#: What a stream of buckets keeps for a symbol: place in the calendar, today's EMA, the EMA of today's buckets alone (which warms tomorrow's), and the open episode of either side.
EMA_STATE = "session string, opened int, closes int, bucket int, n int, ema double, seeds array<double>, pc double, pe double, own_ema double, own_seeds array<double>, own_pc double, own_pe double, gap boolean, " + ", ".join(f"{s}_status string, {s}_nth int, {s}_crossed int, {s}_retested int, {s}_cross double, {s}_confirm double, {s}_reference double" for s in ("bull", "bear"))
EMA_OUT = "symbol string, session_date string, kind string, nth int, ema double, side string, status string, crossed int, retested int, ended int, cross_price double, confirm_price double, reference double"


def _smooth(ema: float | None, seeds: list[float], close: float) -> tuple[float | None, list[float]]:
    if ema is not None:
        return ema + ALPHA * (close - ema), seeds
    seeds = [*seeds, close]
    return (sum(seeds) / SEEDS if len(seeds) == SEEDS else None), seeds


def _over(now: dict, out: list, name: str, status: str, ended: int) -> None:
    """Ends the open episode of a side."""
    out.append(_said(now, name, status, ended))
    now[f"{name}_status"] = None


def _said(now: dict, name: str, status: str | None = None, ended: int | None = None) -> tuple:
    return (now["session"], "episode", now[f"{name}_nth"], None, SIDES[name], status or now[f"{name}_status"], now[f"{name}_crossed"], now[f"{name}_retested"], ended, now[f"{name}_cross"], now[f"{name}_confirm"], now[f"{name}_reference"])


SIDES = {"bull": "bullish", "bear": "bearish"}


def _gap(now: dict, out: list) -> None:
    """The next bucket of today is not complete."""
    now["bucket"] += 1
    end = now["opened"] + (now["bucket"] + 1) * SIZE
    now.update(ema=None, seeds=[], pc=None, pe=None)
    for name in SIDES:
        if now[f"{name}_status"]:
            _over(now, out, name, "cancelled", end)


def _close(now: dict, out: list) -> None:
    """The session has ended: buckets that never came are gaps, and what is still watched or confirmed goes no further."""
    while now["opened"] + (now["bucket"] + 2) * SIZE <= now["closes"]:
        _gap(now, out)
    for name in SIDES:
        if now[f"{name}_status"] == "watching":
            _over(now, out, name, "expired", now["closes"])
        now[f"{name}_status"] = None


def ema_step(now: dict | None, b: tuple) -> tuple[dict, list]:
    """One bucket (session, opened, closes, bucket, high, low, close, rows, complete) for a symbol's state, in plain Python for the stream; the batch fold says the same in columns.

    A new session goes on from what the buckets of the one before say alone, and has no episode of it. Buckets that are left out are gaps; one that isn't
    later than the last is ignored. Gives the new state and what changed: points, and episodes as they stand now.
    """
    session, opened, closes, bucket, high, low, close, rows, complete = b
    out: list = []
    if now is not None and (session, bucket) <= (now["session"], now["bucket"]):
        return now, out
    now = dict(now) if now else {f"{s}_{c}": None for s in SIDES for c in ("status", "nth", "crossed", "retested", "cross", "confirm", "reference")} | {"session": "", "own_ema": None, "own_seeds": [], "own_pc": None, "own_pe": None, "bucket": -1, "opened": opened, "closes": 0}
    if session != now["session"]:
        _close(now, out)
        now.update(session=session, opened=opened, closes=closes, bucket=-1, n=0, ema=now["own_ema"], seeds=now["own_seeds"], pc=now["own_pc"], pe=now["own_pe"], own_ema=None, own_seeds=[], own_pc=None, own_pe=None, gap=False)
    while now["bucket"] < bucket - 1:
        _gap(now, out)
        now["gap"] = True
    end = opened + (bucket + 1) * SIZE
    today = end <= closes
    if rows and (not complete or now["gap"]):  # a gap counts for tomorrow only where something came after it
        now.update(own_ema=None, own_seeds=[], own_pc=None, own_pe=None, gap=False)
    now["gap"] = now["gap"] or not rows
    if complete:
        now["own_ema"], now["own_seeds"] = _smooth(now["own_ema"], now["own_seeds"], close)
        now["own_pc"], now["own_pe"] = close, now["own_ema"]
    if not complete or not today:
        if today:
            _gap(now, out)
        now["bucket"] = bucket
    else:
        now["bucket"] = bucket
        pc, pe = now["pc"], now["pe"]
        ema, now["seeds"] = _smooth(now["ema"], now["seeds"], close)
        now.update(ema=ema, pc=close, pe=ema)
        out.append((session, "point", bucket, ema, *[None] * 8))
        if ema is not None and pe is not None:
            crossed = {"bull": pc <= pe and close > ema, "bear": pc >= pe and close < ema}
            for name, other in (("bull", "bear"), ("bear", "bull")):
                status = now[f"{name}_status"]
                right, wrong = (close > ema, close < ema) if name == "bull" else (close < ema, close > ema)
                if status == "confirmed" and wrong:
                    _over(now, out, name, "invalidated", end)
                elif status == "watching":
                    later = (end - now[f"{name}_crossed"]) / SIZE
                    if crossed[other]:
                        _over(now, out, name, "cancelled", end)
                    elif 0 < later <= WINDOW and low <= pe <= high and right:
                        now.update({f"{name}_status": "confirmed", f"{name}_retested": end, f"{name}_confirm": close, f"{name}_reference": pe})
                        out.append(_said(now, name))
                    elif later >= WINDOW:
                        _over(now, out, name, "expired", end)
            for name in SIDES:
                if crossed[name] and not now[f"{name}_status"]:
                    now.update({f"{name}_status": "watching", f"{name}_nth": now["n"], f"{name}_crossed": end, f"{name}_retested": None, f"{name}_cross": close, f"{name}_confirm": None, f"{name}_reference": None}, n=now["n"] + 1)
                    out.append(_said(now, name))
    if today and end + SIZE > closes:
        for name in SIDES:
            if now[f"{name}_status"] == "watching":
                _over(now, out, name, "expired", closes)
    return now, out


def ema_states(buckets: DataFrame) -> DataFrame:
    """buckets (symbol, session_date, open_minute, close_minute, bucket, high, low, close, rows, complete), those of a symbol in order over batches: each batch's points, and its episodes that changed, as they stand after it.

    kind point: nth is the bucket; episode: nth counts those of a session. The state is one EMA and two open episodes, however long the stream.
    """
    names = [c.split()[0] for c in EMA_STATE.split(", ")]
    out_names = [c.split()[0] for c in EMA_OUT.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(names, state.get, strict=True)) if state.exists else None
        if now:
            now.update(seeds=list(now["seeds"]), own_seeds=list(now["own_seeds"]))
        rows = pd.concat(list(parts)).assign(session=lambda r: r["session_date"].astype(str)).sort_values(["session", "bucket"])
        said: dict = {}
        for r in rows.itertuples(index=False):
            now, out = ema_step(now, (r.session, int(r.open_minute), int(r.close_minute), int(r.bucket), r.high, r.low, r.close, int(r.rows), bool(r.complete)))
            said.update({(o[0], o[1], o[2]): o for o in out})
        state.update(tuple(now[c] for c in names))
        kinds = {c.split()[0]: {"int": "Int32", "double": "Float64"}.get(c.split()[1], "object") for c in EMA_OUT.split(", ")}
        yield pd.DataFrame([(k[0], *o) for o in said.values()], columns=out_names).astype(kinds)

    return buckets.groupBy("symbol").applyInPandasWithState(run, EMA_OUT, EMA_STATE, "update", GroupStateTimeout.NoTimeout)


def running_baseline(points: DataFrame, lookback: int = 60, least: int = 5) -> DataFrame:
    """points (symbol, minute, extrinsic, valid): z of each valid point in its unbroken run, over batches; state is the run's last values."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, values = state.get if state.exists else (-2, [])
        values, out = list(values), []
        for p in pd.concat(list(parts)).sort_values("minute").itertuples(index=False):
            if not p.valid or p.minute - last != 1:
                values = []
            if p.valid:
                values.append(float(p.extrinsic))
                del values[:-lookback]
                sd = statistics.pstdev(values)
                out.append((k[0], int(p.minute), len(values), (values[-1] - statistics.fmean(values)) / sd if len(values) >= least and sd > 1e-8 else None))
            last = int(p.minute)
        state.update((last, values))
        yield pd.DataFrame(out, columns=["symbol", "minute", "baseline_bars", "z"])

    return points.groupBy("symbol").applyInPandasWithState(run, "symbol string, minute int, baseline_bars int, z double", "last int, values array<double>", "append", GroupStateTimeout.NoTimeout)


def freshness_alerts(rows: DataFrame, most: str = "120 seconds", late: str = "0 seconds") -> DataFrame:
    """rows (symbol, ts) to (symbol, late): false in each batch that brings something of a symbol, true once when event time has gone on for so long without it."""
    ms = int(pd.Timedelta(most).total_seconds() * 1000)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
        else:
            last = max(int(p["ts"].max().timestamp() * 1000) for p in parts)
            last = max(last, state.get[0]) if state.exists else last
            state.update((last,))
            state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(k[0], not state.exists)], columns=["symbol", "late"])

    return rows.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(run, "symbol string, late boolean", "last long", "update", GroupStateTimeout.EventTimeTimeout)


#: Buckets to which symbols of a roster are dealt; a bucket is one state, so the number stays the same as long as a checkpoint lives.
ROSTER_BUCKETS = 1024
#: Stands for no time.
NEVER = np.iinfo(np.int64).min


def roster_alerts(rows: DataFrame, beats: DataFrame, roster: DataFrame, most: str = "120 seconds", buckets: int = ROSTER_BUCKETS) -> DataFrame:
    """rows (symbol, ts), beats (ts) of a clock, roster (symbol) of those that must come: (symbol, at, late) whenever what is known of one changes, from the first beat on.

    A beat reaches every symbol of the roster, so one that never came is late at once, and total silence shows as soon as the clock goes on; in production the
    clock is a rate source. late: nothing so far, something older than most, or something later than the beat. Others than those of the roster are left out,
    and what has no time tells nothing. Symbols are dealt to buckets by hash, whose rows of a batch are numbers in arrays: a call for each symbol cost more than its rows.
    """
    ms = int(pd.Timedelta(most).total_seconds() * 1000)
    wanted = roster.select("symbol").distinct()
    of = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int").alias("bucket")
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    came = rows.where("ts is not null").join(wanted, "symbol", "left_semi").select(of, "symbol", us, F.lit(False).alias("beat"))
    every = beats.where("ts is not null").crossJoin(wanted).select(of, "symbol", us, F.lit(True).alias("beat"))  # a beat for each of the roster

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, lasts, said = state.get if state.exists else ([], [], [])
        places = {s: i for i, s in enumerate(known)}
        pieces = []
        for p in parts:  # symbols as numbers, so that the texts of a part go with it
            codes, names = pd.factorize(p["symbol"], use_na_sentinel=False)
            at = np.array([places.setdefault(None if pd.isna(s) else s, len(places)) for s in names], dtype=np.int64)
            pieces.append((at[codes], p["us"].to_numpy(np.int64), p["beat"].to_numpy(bool)))
        who, at, beat = (np.concatenate(c) for c in zip(*pieces, strict=True))
        new = len(places) - len(known)
        last = np.array([NEVER if v is None else v for v in lasts] + [NEVER] * new, dtype=np.int64)
        was = np.array([-1 if v is None else int(v) for v in said] + [-1] * new, dtype=np.int8)
        order = np.lexsort((beat, at, who))
        who, at, beat = who[order], at[order], beat[order]
        row = np.arange(len(who))
        first = np.r_[True, who[1:] != who[:-1]]
        begin = np.maximum.accumulate(np.where(first, row, 0))
        event = np.maximum.accumulate(np.where(beat, -1, row))  # the last row before that isn't a beat, perhaps of another symbol
        seen = np.maximum(last[who], np.where(event >= begin, at[event] // 1000, NEVER))
        np.maximum.at(last, who[~beat], at[~beat] // 1000)
        who, at, seen, ms_at = who[beat], at[beat], seen[beat], at[beat] // 1000
        late = (seen == NEVER) | (ms_at - np.where(seen == NEVER, ms_at, seen) > ms) | (seen > ms_at)
        first, ends = (np.r_[True, who[1:] != who[:-1]], np.r_[who[1:] != who[:-1], True]) if len(who) else (late, late)
        changed = late != np.where(first, was[who], np.r_[False, late[:-1]][: len(late)])
        was[who[ends]] = late[ends]
        names = list(places)
        state.update((names, [None if v == NEVER else v for v in last.tolist()], [None if v < 0 else bool(v) for v in was.tolist()]))
        yield pd.DataFrame({"symbol": np.array(names, dtype=object)[who[changed]], "us": at[changed], "late": late[changed]})

    out = came.unionAll(every).groupBy("bucket").applyInPandasWithState(run, "symbol string, us long, late boolean", "symbols array<string>, lasts array<long>, said array<boolean>", "append", GroupStateTimeout.NoTimeout)
    return out.select("symbol", F.timestamp_micros("us").alias("at"), "late")


def corrections(articles: DataFrame, lookback: str = "24 hours", late: str = "0 seconds", keep: str = "7 days") -> DataFrame:
    """articles (url, article_id, published_at, received_at, first_observed_at, assessed_at): (url, article_id, published_at, active) whenever the latest known article of a url changes, or goes beyond the look-back.

    The latest is by received, first observed, published and id, of those whose times are in order; one whose publication is too old takes the place of an earlier
    one and is not active, so an ineligible correction suppresses what it corrects. Time is the watermark on assessed_at. A url is forgotten keep after its last article went.
    """
    us = lambda t: int(pd.Timedelta(t) / pd.Timedelta("1us"))
    back, kept = us(lookback), us(keep)

    def micros(t: pd.Timestamp) -> int:
        return int(t.value // 1000)

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        best = tuple(state.get) if state.exists else None  # received, first observed, published, article, whether it was given as active
        if state.hasTimedOut:
            received, first, published, article, active = best
            if active:
                state.update((received, first, published, article, False))
                state.setTimeoutTimestamp(max((published + back + kept) // 1000, now // 1000 + 1))
                yield pd.DataFrame([(k[0], article, pd.Timestamp(published, unit="us"), False)], columns=["url", "article_id", "published_at", "active"])
            else:
                state.remove()
            return
        before = best
        for p in parts:
            for r in p.itertuples(index=False):
                now = max(now, micros(r.assessed_at))
                if r.published_at <= r.received_at <= r.first_observed_at <= r.assessed_at:
                    one = (micros(r.received_at), micros(r.first_observed_at), micros(r.published_at), r.article_id)
                    best = (*one, None) if best is None or one > best[:4] else best
        if best is None:
            return
        active = now - best[2] <= back
        state.update((*best[:4], active))
        state.setTimeoutTimestamp(max((best[2] + back + (0 if active else kept)) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if before is None or best[:4] != before[:4] or active != before[4]:
            yield pd.DataFrame([(k[0], best[3], pd.Timestamp(best[2], unit="us"), active)], columns=["url", "article_id", "published_at", "active"])

    shape = "received long, first long, published long, article_id string, active boolean"
    return articles.withWatermark("assessed_at", late).groupBy("url").applyInPandasWithState(run, "url string, article_id string, published_at timestamp, active boolean", shape, "update", GroupStateTimeout.EventTimeTimeout)


#: Buckets of keys in a table of latest rows. A batch rewrites those that it touches.
KEY_BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def pointers(spark: SparkSession, path: str) -> dict[int, int]:
    """Bucket to the batch whose file holds it, as the last pointer file says; at most one entry for each bucket. Empty where nothing was written."""
    fs, make = _fs(spark, path)
    if not fs.exists(make(f"{path}/pointers")):
        return {}
    done = sorted(int(f.getPath().getName()) for f in fs.listStatus(make(f"{path}/pointers")) if fs.exists(make(f"{path}/pointers/{f.getPath().getName()}/_SUCCESS")))
    return {r.bucket: r.epoch for r in spark.read.schema("bucket int, epoch long").parquet(f"{path}/pointers/{done[-1]}").collect()} if done else {}


def latest_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """What upsert_latest keeps under path."""
    at = pointers(spark, path)
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{e}/bucket={b}" for b, e in sorted(at.items())])


def upsert_latest(spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = KEY_BUCKETS):
    """For foreachBatch: keeps one row for each key, the last in order. Keys are dealt to buckets by hash; a batch reads and rewrites the buckets that it touches, then a pointer file says where each bucket lies.

    A batch that is run again finds the pointers of the batch before and gives the same; files of no pointer but the last two go.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs, make = _fs(spark, path)
        if fs.exists(make(f"{path}/pointers/{epoch}")):  # this batch was run before
            fs.delete(make(f"{path}/pointers/{epoch}"), True)
        before = pointers(spark, path)
        of = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = f"{path}/incoming/{epoch}"
        batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("r.*").withColumn("bucket", of).write.mode("overwrite").parquet(new)
        rows = spark.read.parquet(new)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        old = [f"{path}/rows/{before[b]}/bucket={b}" for b in touched if b in before]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", of))
        best = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r")).select("bucket", "r.*")
        best.repartition(min(len(touched), spark.sparkContext.defaultParallelism * 4), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/{epoch}")
        now = before | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/{epoch}")
        fs.delete(make(new), True)
        for b in touched:  # what the pointers before the last ones said is not needed again
            for f in fs.listStatus(make(f"{path}/rows")):
                e = int(f.getPath().getName())
                if e not in (epoch, before.get(b)):
                    fs.delete(make(f"{path}/rows/{e}/bucket={b}"), True)

    return merge


def finished(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that has landed and gives the batch table of what it wrote; every batch of an update stream is kept, with its number in epoch."""
    spark = df.sparkSession
    w = df.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", f"{path}/out").outputMode("append").start()
    else:
        q = w.outputMode(mode).foreachBatch(lambda b, n: b.withColumn("epoch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/{n}")).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", mode != "append").parquet(f"{path}/out")
