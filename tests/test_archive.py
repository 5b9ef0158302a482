"""Archive: damage of every kind is told and left out, sound rows are read whole."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tickloom.sources import archive as A


def days(spark, n=6, rows=40):
    return spark.range(n * rows).select(F.lit("p").alias("provider"), F.lit("bars").alias("kind"), F.when(F.col("id") % 2 == 0, "007").otherwise("X Y:Z").alias("symbol"), F.concat(F.lit("2024-01-0"), F.floor(F.col("id") / rows) + 1).alias("date"), "id", F.when(F.col("id") % 5 == 0, "5m").otherwise("1m").alias("interval"))


def files(path, symbol, day):
    found = sorted(glob.glob(f"{path}/data/*/provider=p/kind=bars/symbol={symbol}/date=2024-01-0{day}/part-*.parquet"))
    assert found
    return found[0]


def checks(spark, path, **within):
    return {(r.symbol, r.date): (r.check, r.foreign) for r in A.verify(spark, path, **within).collect()}


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_damage_is_told_and_the_rest_is_read(spark, tmp_path):
    path = str(tmp_path / "a")
    A.write_archive(days(spark), path)
    assert ids(A.scan(spark, path)) == list(range(240))
    cut, gone, one, two, beside = (files(path, "007", d) for d in (1, 2, 3, 4, 5))
    with open(cut, "r+b") as f:
        f.truncate(os.path.getsize(cut) // 2)
    os.remove(gone)
    shutil.move(one, f"{path}/swap")
    shutil.move(two, one)
    shutil.move(f"{path}/swap", two)
    with open(os.path.join(os.path.dirname(beside), "part-99999.parquet"), "w") as f:
        f.write("no table")
    for f in glob.glob(f"{path}/data/**/.*.crc", recursive=True):
        os.remove(f)
    got = checks(spark, path)
    assert {d: got["007", f"2024-01-0{d}"] for d in range(1, 7)} == {1: ("length", 0), 2: ("missing", 0), 3: (got["007", "2024-01-03"][0], 0), 4: (got["007", "2024-01-04"][0], 0), 5: ("ok", 1), 6: ("ok", 0)}
    assert {got["007", f"2024-01-0{d}"][0] for d in (3, 4)} <= {"length", "sha256"}
    assert all(v == ("ok", 0) for k, v in got.items() if k[0] == "X Y:Z") and len(got) == 12
    assert ids(A.scan(spark, path)) == [i for i in range(240) if i % 2 or i // 40 in (4, 5)]
    assert ids(A.scan(spark, path, symbols=["007"], start="2024-01-05", end="2024-01-05")) == list(range(160, 200, 2))
    with pytest.raises(Exception):
        A.scan(spark, path, checked=False).collect()


def test_same_length_other_bytes(spark, tmp_path):
    path = str(tmp_path / "a")
    A.write_archive(days(spark, 2), path)
    f = files(path, "007", 1)
    with open(f, "r+b") as h:
        h.seek(8)
        b = h.read(1)
        h.seek(8)
        h.write(bytes([b[0] ^ 255]))
    os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    assert checks(spark, path)["007", "2024-01-01"] == ("sha256", 0)
    assert len(A.scan(spark, path).collect()) == 60


def test_filters_reach_the_folders(spark, tmp_path):
    path = str(tmp_path / "a")
    A.write_archive(days(spark), path)
    got = A.scan(spark, path, kind="bars", provider="p", symbols=["X Y:Z"], start="2024-01-02", end="2024-01-03", interval="5m")
    assert ids(got) == [i for i in range(40, 120) if i % 2 and i % 5 == 0]
    assert dict(got.dtypes)["symbol"] == "string" and A.BATCH not in got.columns
    assert A.scan(spark, path, kind="quotes").count() == 0 and A.scan(spark, path, provider="q").count() == 0
    assert set(checks(spark, path, end="2024-01-01")) == {("007", "2024-01-01"), ("X Y:Z", "2024-01-01")}


def test_an_entry_written_again_replaces_the_earlier_one(spark, tmp_path):
    path = str(tmp_path / "a")
    A.write_archive(days(spark, 2), path)
    again = days(spark, 1).where("symbol = '007' and id < 10").withColumn("extra", F.lit(1))
    A.write_archive(again, path)
    assert ids(A.scan(spark, path)) == sorted([i for i in range(80) if i % 2 or i >= 40] + [0, 2, 4, 6, 8])
    assert {r.extra for r in A.scan(spark, path).collect()} == {1, None}
    assert {r.check for r in A.verify_files(spark, path).collect()} == {"ok", "superseded"}
    A.write_unavailable(days(spark, 1).where("symbol = '007'"), path)
    assert ids(A.scan(spark, path)) == [i for i in range(80) if i % 2 or i >= 40]


def test_a_batch_without_manifest_is_foreign(spark, tmp_path):
    path = str(tmp_path / "a")
    A.write_archive(days(spark, 1), path)
    days(spark, 1).write.partitionBy(*A.PARTITIONS).parquet(f"{path}/data/{A.BATCH}=b0")
    assert {r.check for r in A.verify_files(spark, path).collect()} == {"ok", "foreign"}
    assert ids(A.scan(spark, path)) == ids(A.scan(spark, path, checked=False)) == list(range(40))


def test_no_rows_nulls_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "a")
    some = days(spark, 1, 4).withColumn("date", F.when(F.col("id") % 2 == 0, F.col("date")))
    A.write_archive(some, path)
    A.write_archive(some.where("false"), path)
    assert ids(A.scan(spark, path)) == [0, 1, 2, 3] and {r.check for r in A.verify(spark, path).collect()} == {"ok"}
    with pytest.raises(ValueError):
        A.write_archive(some.withColumn(A.BATCH, F.lit(1)), path)
