"""Parquet cache of the model's tables.

``tx`` is clustered: its lines are bucketed and sorted by customer inside
folders by use year, so year filters prune folders and everything grouped or
joined by customer (spend cuts, units, roll-ups) needs no exchange of lines.
Lines of hot customers (one of them may hold a third of all) lie in a table of
their own, ``tx_hot``, which is not bucketed, so they are read and combined by
many tasks. Work by customer runs on each part and the results are unioned
(``by_part``): no customer is in both.

Files are bounded by volume: a bucket's writer makes one file a year, other
tables are rebalanced before they are written, and no file exceeds
``FILE_ROWS`` rows. Disk is too: many lines are written some use years at a
time (``year_slices``), and the shuffle files of a write go as it ends.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waypoint.operators.joins import is_hot
from waypoint.session import scratch_path, short_shuffles
from waypoint.sources import files

#: Rows of a file at most, and rows of a bucket about: a bucket's whole lines are sorted by one task as it is written,
#: and rolled up by one task, which both fit the memory of a core.
FILE_ROWS, BUCKET_ROWS = 16_000_000, 400_000
KEY, YEAR, LAYOUT = "ccid", "use_year", "_layout"
#: Lines whose exchanges lie on disk at once, about, as a cache is written.
SLICE_ROWS = 48_000_000
#: Stored lines are many and read a few times: they take a fifth less with zstd, or a third.
CODEC = "zstd"


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows; as many as shuffle partitions at least, so that a scan keeps all cores busy."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def _name(path: str) -> str:
    """Name under which the session knows the bucketed files at ``path``."""
    return f"waypoint_{hashlib.md5(path.encode()).hexdigest()[:20]}"


def lines_by_year(tx: DataFrame, n_lines: int) -> tuple[tuple[int | None, int], ...]:
    """Lines of each use year, where they are in folders by it and too many to be exchanged at once."""
    if n_lines <= SLICE_ROWS or YEAR not in tx.columns:
        return ()
    return tuple((r[0], r[1]) for r in tx.groupBy(YEAR).count().collect())


def year_slices(by_year: tuple[tuple[int | None, int], ...]) -> tuple[Column, ...]:
    """Conditions that split lines by use year: each holds at most ``SLICE_ROWS`` lines, or one year; missing years too."""
    groups: list[list] = []
    for y, n in sorted(by_year, key=lambda r: (r[0] is None, r[0])):
        if groups and groups[-1][1] + n <= SLICE_ROWS:
            groups[-1] = [[*groups[-1][0], y], groups[-1][1] + n]
        else:
            groups.append([[y], n])
    return tuple(reduce(or_, (F.col(YEAR).eqNullSafe(F.lit(y).cast("int")) for y in years)) for years, _ in groups)


def write_clustered(df: DataFrame, path: str, buckets: int, key: str = KEY, year: str | None = None,
                    slices: tuple[Column, ...] = ()) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key`` (and in folders by ``year``); read it back.

    ``slices``: conditions of which each row meets one; their rows are exchanged and written one after the other.
    """
    spark = df.sparkSession
    if files.exists(spark, path):
        raise FileExistsError(path)
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    for i, some in enumerate([df.where(c) for c in slices] or [df]):
        w = (some.repartition(buckets, key).write.mode("append" if i else "error").bucketBy(buckets, key).sortBy(key)
             .option("maxRecordsPerFile", FILE_ROWS).option("compression", CODEC).option("path", path).format("parquet"))
        if slices:  # none of them is the whole table
            w = w.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        with short_shuffles(spark):
            (w.partitionBy(year) if year else w).saveAsTable(_name(path))
    if slices:
        files.touch(spark, f"{path}/_SUCCESS")
    layout = {"buckets": buckets, "key": key, "year": year, "schema": json.loads(df.schema.json())}
    spark.createDataFrame([(json.dumps(layout),)], "layout string").coalesce(1).write.text(f"{path}/{LAYOUT}")
    return spark.table(_name(path))


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """A clustered table by its path, in any session: the layout stored with it is declared anew."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = json.loads(spark.read.text(f"{path}/{LAYOUT}").first()[0])
        fields = StructType.fromJson(layout["schema"]).fields
        year = layout["year"]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                            for f in sorted(fields, key=lambda f: f.name == year))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet " + (f"PARTITIONED BY (`{year}`) " if year else "")
                  + f"CLUSTERED BY (`{layout['key']}`) SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS "
                  + f"LOCATION '{path}'")
        if year:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def buckets_of(spark: SparkSession, path: str) -> int:
    return json.loads(spark.read.text(f"{path}/{LAYOUT}").first()[0])["buckets"]


def by_part(parts: tuple[DataFrame, ...], fn: Callable[..., DataFrame], hot: tuple | None = None) -> DataFrame:
    """``fn`` of each part (no customer is in two of them), unioned: for work that is done by customer.

    With ``hot``, ``fn`` also gets the part's hot customers: none in the first of several parts.
    """
    out = None
    for i, part in enumerate(parts):
        got = fn(part) if hot is None else fn(part, () if i == 0 and len(parts) > 1 else hot)
        out = got if out is None else out.unionByName(got)
    return out


def clustered_parts(df_parts: tuple[DataFrame, ...], name: str, buckets: int, year: str | None = None) -> tuple[DataFrame, ...]:
    """Stage tables of the parts under the shared folder: the first bucketed by customer, the others not."""
    spark = df_parts[0].sparkSession
    out = [write_clustered(df_parts[0], scratch_path(spark, name), buckets, year=year)]
    for df in df_parts[1:]:
        path = scratch_path(spark, f"{name}-hot")
        df.write.parquet(path)
        out.append(spark.read.parquet(path))
    return tuple(out)


def write_table(df: DataFrame, path: str, year: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet files of bounded number and size: rows are rebalanced (by year) before they are written."""
    df = df.hint("rebalance", *([year] if year else []))
    w = df.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).option("compression", CODEC)
    with short_shuffles(df.sparkSession):
        (w.partitionBy(year) if year else w).parquet(path)


def write_tables(tables: dict[str, DataFrame], folder: str, hot: tuple = (), buckets: int | None = None,
                 parts: tuple[DataFrame, ...] = (), by_year: tuple[tuple[int | None, int], ...] = ()) -> None:
    """``hot``: customers whose lines are kept apart. A ``tx`` without customers is not clustered.

    ``parts``: the lines in parts already, the ordinary customers' first; each is then computed once.
    ``by_year``: the lines of every use year (``lines_by_year``) of parts that are read by it.
    """
    dated = lambda x: x if by_year else x.withColumn(YEAR, F.year("begin_use_date"))
    for name, df in tables.items():
        if name != "tx" or "begin_use_date" not in df.columns:
            write_table(df, f"{folder}/{name}")
            continue
        lines = df.withColumn(YEAR, F.year("begin_use_date"))
        if KEY not in df.columns:
            write_table(lines, f"{folder}/{name}", YEAR)
            continue
        n = buckets or bucket_count(df.sparkSession, 0)
        own = [dated(x) for x in parts] or (
            [lines.where(~is_hot(F.col(KEY), hot)), lines.where(is_hot(F.col(KEY), hot))] if hot else [lines])
        write_clustered(own[0], f"{folder}/{name}", n, year=YEAR, slices=year_slices(by_year))
        for x in own[1:]:
            write_table(x, f"{folder}/{name}_hot", YEAR)


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = files.list_names(spark, folder)
    if not names:
        raise FileNotFoundError(
            f"cache {folder} is empty; build it with write_tables(process_ccids(...))")
    broken = [n for n in names if not files.exists(spark, f"{folder}/{n}/_SUCCESS")]
    if broken:
        raise FileNotFoundError(f"cache {folder}: {', '.join(broken)} not written to the end; build it again")
    out = {n: read_clustered(spark, f"{folder}/{n}") if files.exists(spark, f"{folder}/{n}/{LAYOUT}")
           else spark.read.parquet(f"{folder}/{n}") for n in names if n != "tx_hot"}
    if "tx_hot" in names:  # like ``tx``; no file tells its columns if it is empty
        out["tx_hot"] = spark.read.schema(out["tx"].schema).parquet(f"{folder}/tx_hot")
    return out


def tx_parts(tables: dict[str, DataFrame]) -> tuple[DataFrame, ...]:
    """The lines of a cache: the clustered part, and the hot customers' if there are any."""
    cold = tables["tx"]
    return (cold, tables["tx_hot"].select(*cold.columns)) if "tx_hot" in tables else (cold,)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Return the Parquet at ``path`` if present, else build, store and re-read it."""
    if not files.exists(spark, f"{path}/_SUCCESS"):
        # a folder without the marker is a build that did not end: written anew
        with short_shuffles(spark):
            build().write.mode("overwrite").option("compression", CODEC).parquet(path)
    return spark.read.parquet(path)
