"""Disk of the ingest: lines joined, exchanged and stored some at a time, shuffle files gone as a write ends."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_round3 import _part_files, exchanges
from tests.test_round4 import _fresh, _must_not
from waypoint.operators import identity
from waypoint.session import materialize, scratch_path, short_shuffles
from waypoint.sources import cache
from waypoint.sources import fixtures as FX

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    before = _shuffle_files(spark)
    df = spark.range(5000).repartition(16, "id")
    assert materialize(df, "short-shuffle").columns == ["id"]
    for _ in range(100):  # they are removed in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left


@pytest.mark.parametrize("old", [None, "false", "true"])
def test_the_session_keeps_its_setting(spark, old):
    spark.conf.unset(CLEANUP)
    usual = spark.conf.get(CLEANUP, None)
    if old:
        spark.conf.set(CLEANUP, old)
    with pytest.raises(ValueError), short_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(CLEANUP, None) == (old or usual)
    spark.conf.unset(CLEANUP)


def test_slices_hold_every_year(spark, monkeypatch):
    monkeypatch.setattr(cache, "SLICE_ROWS", 10)
    years = ((2001, 4), (None, 3), (1999, 5), (2000, 30), (2002, 6))
    df = spark.createDataFrame([(y, i) for y, n in years for i in range(n)], "use_year int, i int")
    got = [sorted({str(r.use_year) for r in df.where(c).collect()}) for c in cache.year_slices(years)]
    assert got == [["1999"], ["2000"], ["2001", "2002"], ["None"]]
    assert sum(df.where(c).count() for c in cache.year_slices(years)) == df.count()
    assert cache.year_slices(()) == ()
    assert sorted(cache.lines_by_year(df, 48), key=str) == sorted(years, key=str)
    assert cache.lines_by_year(df, 10) == () == cache.lines_by_year(df.drop("use_year"), 48)


def test_lines_are_stored_by_slices(spark, monkeypatch):
    """The same lines, folders, files and layout as in one go; missing and repeated rows too; a slice's exchange alone."""
    days = [dt.date(1997, 3, 1), dt.date(1998, 5, 2), dt.date(1998, 12, 31), dt.date(1999, 1, 1), None]
    rows = [(i % 23 if i % 10 else None, days[i % 5], i // 2) for i in range(400)]
    raw = spark.createDataFrame(rows, "ccid long, begin_use_date date, n int").withColumn(cache.YEAR, F.year("begin_use_date"))
    lines = materialize(raw, "slices-test", partition_by=[cache.YEAR])
    parts = (lines.where("ccid <> 3 OR ccid IS NULL"), lines.where("ccid = 3"))
    monkeypatch.setattr(cache, "SLICE_ROWS", 100)
    by_year = cache.lines_by_year(lines, 400)
    assert len(cache.year_slices(by_year)) == 4
    folders, tables = {}, {}
    for name, years in (("whole", ()), ("sliced", by_year)):
        folders[name] = scratch_path(spark, f"{name}-test")
        cache.write_tables({"tx": lines}, folders[name], hot=(3,), buckets=3, parts=parts, by_year=years)
        spark.sql(f"DROP TABLE {cache._name(folders[name] + '/tx')}")
        tables[name] = cache.tx_parts(cache.read_tables(spark, folders[name]))
    for a, b in zip(tables["whole"], tables["sliced"], strict=True):
        assert a.schema == b.schema and _rows(a) == _rows(b) and not a.isEmpty()
    assert _part_files(spark, f"{folders['sliced']}/tx") == _part_files(spark, f"{folders['whole']}/tx")
    assert exchanges(tables["sliced"][0].groupBy("ccid").count()) == 0
    # the condition reaches the folders of the lines that are read for it
    plan = parts[0].where(cache.year_slices(by_year)[1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan


def test_a_cache_of_some_slices_is_not_read(spark, monkeypatch):
    """Only the last slice marks the table as written to the end."""
    df = spark.createDataFrame([(i, 2000 + i % 3) for i in range(30)], "ccid long, use_year int")
    folder = scratch_path(spark, "broken-test")
    bad = F.when(F.col("ccid") > 5, F.raise_error(F.lit("lost"))).otherwise(F.lit(True)).cast("boolean")
    with pytest.raises(Exception, match="lost"):
        cache.write_clustered(df, f"{folder}/tx", 2, year="use_year", slices=(F.col("use_year") == 2000, bad))
    assert not spark.read.parquet(f"{folder}/tx").isEmpty()
    with pytest.raises(FileNotFoundError, match="tx not written to the end"):
        cache.read_tables(spark, folder)
    done = scratch_path(spark, "done-test")
    cache.write_clustered(df, f"{done}/tx", 2, year="use_year",
                          slices=tuple(F.col("use_year") == y for y in (2000, 2001, 2002)))
    assert cache.read_tables(spark, done)["tx"].count() == 30


def _tables(spark, folder, orders_key="long"):
    o = [(k, 100 + k % 6 if k % 5 else None, dt.date(1997, 1, 1 + k % 20), f"{1 + k % 5}-X") for k in range(40)]
    o += [o[3], (None, 7, dt.date(1997, 1, 1), "1-X")]
    li = [(k % 45 if k % 11 else None, 1 + k % 9, 1 + k % 4, 1 + k % 7, float(1 + k % 50), 10.0 + k, 0.05, 0.02,
           dt.date(1997 + k % 3, 2, 1 + k % 27)) for k in range(300)]
    p = [(k, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")[k % 5]) for k in range(1, 9)]
    spark.createDataFrame(o, f"o_orderkey {orders_key}, o_custkey long, o_orderdate date, o_orderpriority string").write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame(li + li[:9], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_shipdate date").write.parquet(
        f"{folder}/lineitem.parquet")
    spark.createDataFrame(p, "p_partkey long, p_type string").write.parquet(f"{folder}/part.parquet")


def test_extract_by_parts_is_the_extract(spark, monkeypatch):
    """Every line once, with missing keys and repeated rows, whatever the parts; orders of other types are not split."""
    folder = scratch_path(spark, "tables-test")
    _tables(spark, folder)
    whole = FX.tx_extract(spark, folder, flagged=True)
    want = _rows(whole)
    assert len(FX.tx_extracts(spark, folder)) == 1 and len(want) > 200
    monkeypatch.setattr(cache, "SLICE_ROWS", 70)
    parts = FX.tx_extracts(spark, folder)
    assert len(parts) == 5 and all(x.columns == whole.columns for x in parts)
    assert sum(not x.isEmpty() for x in parts) > 1
    assert sorted(r for x in parts for r in _rows(x)) == want
    other = scratch_path(spark, "tables-test")
    _tables(spark, other, orders_key="int")
    assert [_rows(x) for x in FX.tx_extracts(spark, other)] == [want]


def test_an_extract_of_parts_is_stored_whole(spark):
    a, b = (spark.range(i, i + 10).withColumn("y", (F.col("id") % 3).cast("int")) for i in (0, 10))
    got = materialize(a, "appended", partition_by=["y"], more=[b, a.limit(0)])
    assert sorted(r.id for r in got.collect()) == list(range(20))


def test_tx_year_slice_stores_the_models_columns_only(spark, monkeypatch):
    context, registry = _fresh(spark, monkeypatch)
    whole = context.load(spark, SF_SMALL).data.tx
    want = _rows(whole.where("begin_use_date >= DATE'1998-01-01' AND begin_use_date < DATE'1999-01-01'").selectExpr(
        "ccid", "booking_code", "begin_use_date", "year(begin_use_date)", "month(begin_use_date)"))
    context._CACHE.clear()
    monkeypatch.setattr(cache, "SLICE_ROWS", 1500)  # and by slices
    written = []
    store = context.write_tables
    monkeypatch.setattr(context, "write_tables", lambda t, *a: written.append((len(t["tx"].columns), a)) or store(t, *a))
    got = registry.QUERIES["tx_year_slice"](spark, SF_SMALL)
    assert _rows(got) == want and want
    (columns, args), = written
    assert columns == len(context.MODEL_COLUMNS) + 1 and len(cache.year_slices(args[-1])) > 2


def test_cache_roundtrip_stores_the_lines_once(spark, monkeypatch):
    context, registry = _fresh(spark, monkeypatch)
    want = _rows(registry.as_output(context.load(spark, SF_SMALL).data.tx))
    context._CACHE.clear()
    monkeypatch.setattr(context, "ingest", _must_not)  # a cache before the query's own
    monkeypatch.setattr(cache, "SLICE_ROWS", 1500)
    got = registry.QUERIES["cache_roundtrip"](spark, SF_SMALL)
    assert _rows(got) == want and want
    assert identity.Dataset(None, None, None).by_year == ()
