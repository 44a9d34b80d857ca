"""Growth of the ingest steps: lines exchanged once, bounded sorts, steps made only when needed."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from waypoint.operators import identity, joins
from waypoint.sources import cache
from waypoint.sources import fixtures as FX

KEY = FX.NATURAL_KEY


@pytest.mark.parametrize("hot", [(), (None,), ("a",), (None, "a")])
@pytest.mark.parametrize("tasks", [None, 5])
def test_parts_of_lines_get_the_ids(spark, hot, tasks):
    """Every line once with its id, missing keys too; one exchange of the ordinary lines, none of the hot ones."""
    rows = [(k, i) for i in range(40) for k in ("a", "b", None, "", f"k{i}")]
    lines = spark.createDataFrame(rows, f"{KEY} string, n int")
    ids = spark.createDataFrame([(k, i) for i, k in enumerate(sorted({k for k, _ in rows if k is not None}))] + [(None, 99)],
                                f"{KEY} string, ccid long")
    want = sorted((r.ccid, r.n) for r in identity.attach_ccid(lines, ids).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = identity.attach_parts(lines, ids, hot=hot, tasks=tasks)
        assert len(parts) == (2 if hot else 1) and all(p.columns == ["ccid", "n"] for p in parts)
        assert sorted((r.ccid, r.n) for p in parts for r in p.collect()) == want
        if hot:
            plan = parts[1]._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan
        plan = parts[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 2  # the lines' and the ids'
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_tasks_follow_the_lines(spark):
    """A task sorts some hundred thousand whole lines at most, whatever the session's partitions."""
    lines = 216_000_000
    assert lines / cache.bucket_count(spark, lines) <= 500_000
    assert lines / joins.task_count(spark, lines, 5_000_000) <= 500_000
    assert joins.task_count(spark, lines, 1000) is None  # the other side may be broadcast
    assert joins.task_count(spark, 1000, 5_000_000) is None


def _fresh(spark, monkeypatch):
    from waypoint.plans import context, registry
    monkeypatch.setattr(context, "_CACHE", {})
    monkeypatch.setattr(registry, "_MODELS", {})
    return context, registry


def _must_not(*args, **kw):
    raise AssertionError("not a step of this query")


def test_faults_are_read_without_ids(spark, monkeypatch):
    context, registry = _fresh(spark, monkeypatch)
    want = sorted(tuple(r) for r in registry.QUERIES["read_faults"](spark, SF_SMALL).collect())
    context._CACHE.clear()
    monkeypatch.setattr(context, "process_ccids", _must_not)
    assert sorted(tuple(r) for r in registry.QUERIES["read_faults"](spark, SF_SMALL).collect()) == want and want


def test_customers_get_ids_without_stored_lines(spark, monkeypatch):
    context, registry = _fresh(spark, monkeypatch)
    monkeypatch.setattr(context, "ingest", _must_not)
    got = registry.QUERIES["attach_ccid"](spark, SF_SMALL)
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/customer.parquet").count()
    assert got.where("ccid IS NULL").isEmpty()


def test_hot_lines_are_stored_as_computed(spark, monkeypatch):
    """Parts are written as they are: the lines are not joined once more to tell the hot ones."""
    from waypoint.session import scratch_path
    df = spark.range(60).select((F.col("id") % 6).alias("ccid"), F.lit("2020-05-01").cast("date").alias("begin_use_date"), "id")
    folder = scratch_path(spark, "parts-test")
    monkeypatch.setattr(cache, "is_hot", _must_not)
    cache.write_tables({"tx": df}, folder, hot=(3,), buckets=2, parts=(df.where("ccid <> 3"), df.where("ccid = 3")))
    cold, hot = cache.tx_parts(cache.read_tables(spark, folder))
    assert (cold.count(), hot.count()) == (50, 10)


def test_survey_lines_are_the_marked_ones(spark, monkeypatch):
    context, _ = _fresh(spark, monkeypatch)
    c = context.load(spark, SF_SMALL)
    want = FX.tx_extract(spark, SF_SMALL, survey=True)
    got = c.extract.where(FX.SURVEYED).select(*want.columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty() and not got.isEmpty()
    assert c.tx_extract.columns == want.columns


def test_unplaced_lines_by_part(spark, monkeypatch):
    """The same lines from parts as from all at once, every column; ordinary lines are not exchanged for it."""
    from waypoint.operators import segments as S
    context, registry = _fresh(spark, monkeypatch)
    m = registry.model(spark, SF_SMALL)
    whole = context.load(spark, SF_SMALL).data
    assert set(whole.tx.columns) > set(m.data.tx.columns) and len(m.data.tx.columns) < 12
    assert whole.tx.count() == m.data.tx.count()
    got = S.unplaced_lines(whole.tx_parts, m.typing, m.p, m.hot)
    want = S.unplaced_lines(whole.tx, m.typing, m.p, m.hot)
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert dataclasses.is_dataclass(m)
