"""Clustered cache, bounded files, packed draw, one-pass respondents, forest as a table."""

import datetime as dt
import re

import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from waypoint.operators import forest, lines, segments, units
from waypoint.params import ModelParams, fixture_params
from waypoint.session import scratch_path
from waypoint.sources import cache, files


def exchanges(df, below: str | None = None) -> int:
    """Exchanges of the initial plan; with ``below``, those with a scan of that path under them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Final Plan ==")[-1]
    rows = [(len(re.match(r"[\s:+|\-*()\d]*", l).group()), l) for l in plan.splitlines()]
    count = 0
    for i, (depth, l) in enumerate(rows):
        if not re.search(r"(?<!Broadcast)Exchange ", l):
            continue
        under = []
        for d, x in rows[i + 1:]:
            if d <= depth:
                break
            under.append(x)
        count += below is None or any("FileScan" in x and below in x for x in under)
    return count


@pytest.fixture(scope="module")
def model(spark):
    from waypoint.plans.registry import model
    return model(spark, SF_SMALL)


def test_work_by_customer_exchanges_no_lines(spark, model):
    """Spend cells, the line roll-up, units and bookings of the clustered part: no Exchange over the lines."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p, cold = model.p, model.data.tx_parts[0]
        assert len(model.data.tx_parts) == 2  # the customer of the missing e-mails is hot
        assert exchanges(segments.spend_cells(cold, p)) == 0
        rolled = lines.line_rollup(cold, p)
        assert exchanges(rolled) == 0
        assert exchanges(rolled.repartition(model.buckets, "ccid")) == 0  # written bucketed where it is
        stored = model.line_parts[0]
        assert exchanges(units.active_customers(stored, model.cust_dim, p), "n_unit") == 0
        active = units.active_customers(stored, model.cust_dim, p)
        assert exchanges(units.active_booking_lobs(stored, active), "trip_elements") == 0
        by = units.booking_years(None, p, by_lob=model.by_lob_parts[0])
        assert exchanges(units.customer_units(by, p)) == 0 and exchanges(units.booking_rollup(by, p)) == 0
        # the hot part is combined and exchanged by booking too, so one customer splits
        assert exchanges(lines.line_rollup(model.data.tx_parts[1], p)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cache_is_read_by_another_session(spark):
    """The stored layout is declared anew where the session does not know the table."""
    df = spark.range(100).select((F.col("id") % 7).alias("ccid"), F.lit(dt.date(2020, 5, 1)).alias("begin_use_date"),
                                 F.col("id").alias("n"))
    folder = scratch_path(spark, "cache-test")
    cache.write_tables({"tx": df}, folder, hot=(3,), buckets=3)
    spark.sql(f"DROP TABLE {cache._name(folder + '/tx')}")
    t = cache.read_tables(spark, folder)
    cold, hot = cache.tx_parts(t)
    assert exchanges(cold.groupBy("ccid").count()) == 0
    assert hot.select("ccid").distinct().collect() == [(3,)] and cold.where("ccid = 3").isEmpty()
    assert sorted(r.n for r in cold.unionByName(hot).collect()) == list(range(100))
    assert cache.buckets_of(spark, f"{folder}/tx") == 3
    with pytest.raises(FileExistsError):
        cache.write_clustered(df, f"{folder}/tx", 3)


def test_empty_lines_are_cached(spark):
    df = spark.createDataFrame([], "ccid long, begin_use_date date, n long")
    folder = scratch_path(spark, "cache-empty")
    cache.write_tables({"tx": df}, folder, hot=(1,), buckets=2)
    spark.sql(f"DROP TABLE {cache._name(folder + '/tx')}")
    assert cache.by_part(cache.tx_parts(cache.read_tables(spark, folder)), lambda x: x).count() == 0


def _part_files(spark, path: str) -> int:
    return sum(n.startswith("part-") for year in files.list_names(spark, path)
               for n in ([year] if year.startswith("part-") else files.list_names(spark, f"{path}/{year}")))


def test_files_follow_volume_not_tasks(spark, monkeypatch):
    """64 tasks and 7 years: a file or two a year, not 448; and no file beyond the row bound."""
    df = spark.range(20_000).repartition(64).select("id", (F.col("id") % 7 + 2000).cast("int").alias("use_year"))
    path = scratch_path(spark, "files-test")
    cache.write_table(df, path, "use_year")
    assert spark.read.parquet(path).count() == 20_000 and _part_files(spark, path) <= 14
    lines_ = df.withColumn("ccid", F.col("id") % 50)
    cache.write_clustered(lines_, f"{path}-buckets", 4, year="use_year")
    assert _part_files(spark, f"{path}-buckets") <= 28
    monkeypatch.setattr(cache, "FILE_ROWS", 1000)
    cache.write_table(df, f"{path}-small", "use_year")
    assert _part_files(spark, f"{path}-small") >= 20


def test_packed_draw_equals_the_expanded_one(spark):
    p = ModelParams(spend_step=1000, spend_cap=3000)
    counts = [(float(a), float(l), s, n) for a in (0, 1000, 2000) for l in (0, 1000, 3000)
              for s, n in (("x", 1 + int(a) // 1000), ("y", 2), ("z", 5))]
    from tests.test_segments import _typing
    typing = _typing(spark, counts)
    tx = spark.range(4000).select(
        F.col("id").alias("ccid"), F.lit(dt.date(2024, 2, 2)).alias("begin_use_date"),
        F.when(F.col("id") % 3 == 0, "air").when(F.col("id") % 3 == 1, "lodging").otherwise("car").alias("lob"),
        ((F.col("id") * 37) % 4500 - 100).cast("double").alias("gbv"))
    tx = tx.unionByName(tx.withColumn("lob", F.lit("lodging")).withColumn("gbv", F.lit(1500.0)).where("ccid % 5 = 0"))
    want = {r.ccid: (r.segment, r.uncovered) for r in segments.draw_segments(
        segments.segment_candidates(tx, typing, p), p.seed).collect()}
    plan = segments.drawn_segments(segments.spend_cells(tx, p), typing, p)
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.ccid: (r.segment, r.uncovered) for r in plan.collect()}
    assert len(got) == 4000
    assert {c: v for c, v in got.items() if c in want} == want
    assert {v for c, v in got.items() if c not in want} == {(None, False)}  # without spend
    assert len({s for s, _ in got.values()}) == 4 and any(u for _, u in got.values())


def test_survey_features_read_the_lines_once(spark):
    from waypoint.operators.respondents import respondent_rollup, survey_features
    from waypoint.plans import context
    c = context.load(spark, SF_SMALL)
    df = survey_features(c.survey.cid_to_ccid, c.survey.ccids, c.survey.tx, c.params.analysis_year)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "gbv" in plan and "/tx" not in plan.replace("tx-", "")  # the finish reads the roll-up alone
    assert respondent_rollup(c.survey.tx.limit(0)).count() == 0


def test_reconciliation_reads_no_lines_again(spark):
    from waypoint.plans.registry import QUERIES
    plan = QUERIES["stage_reconciliation"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"FileScan[^\n]*(/tx|enriched-lines)", plan)


def test_forest_table_votes_like_the_library(spark):
    """Every customer: the node table's votes and class are those of the fitted model."""
    p = fixture_params().with_(forest_trees=20)
    rows = [(i, *[float((i * (j + 3)) % 11) for j in range(len(p.forest_lobs))], "ABC"[(i * i) % 3]) for i in range(200)]
    names = [f"lob_{x}" for x in p.forest_lobs]
    df = spark.createDataFrame(rows, ["ccid", *names, "segments_v1"])
    fitted = forest.fit_forest(df.drop("ccid"), p)
    nodes, labels = forest.forest_nodes(fitted)
    assert nodes.count() == 20
    path = scratch_path(spark, "forest-test")
    fitted[0].stages[-1].write().save(path)
    library = RandomForestClassificationModel.load(path)
    scored = library.transform(fitted[0].stages[0].transform(df)).select("ccid", "rawPrediction", "prediction").collect()
    got = {r.ccid: r.votes for r in forest.votes(nodes, df, p).collect()}
    for r in scored:
        assert got[r.ccid] == pytest.approx(list(r.rawPrediction))
    classes = {r.ccid: r.pred_class for r in forest.predictions(nodes, labels, df, p).collect()}
    for r in scored:  # equal votes may differ in the last bit between the two sums
        top = sorted(r.rawPrediction)[-2:]
        assert classes[r.ccid] == labels[int(r.prediction)] or top[1] - top[0] < 1e-9
    counts = {r.pred_class: r.n for r in forest.predicted_counts(forest.predictions(nodes, labels, df, p)).collect()}
    assert sum(counts.values()) == 200


def test_all_customers_are_scored_where_few_exist(spark):
    from waypoint.plans.registry import QUERIES
    n = QUERIES["rf_scored_customers"](spark, SF_SMALL).count()
    assert n > 100
