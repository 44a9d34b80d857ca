"""Column pruning of salted joins, null keys of the survey side, name cleaning, forest, caches."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from waypoint.operators import forest
from waypoint.operators.joins import lookup_join
from waypoint.operators.segments import check_levels, clean_name, override_segmentation
from waypoint.params import fixture_params
from waypoint.sources import cache, csv
from waypoint.sources.survey import cid_to_ccid, survey_answers


def scans(df, table: str) -> list[set]:
    """Columns that each scan of ``table`` reads."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "FileScan" in line and f"/{table}" in line]
    return [set(re.findall(r"(\w+):", line.split("ReadSchema: struct<")[1])) for line in found]


@pytest.mark.parametrize("name", ["recorded_tier_distribution", "typing_table", "rf_training_set"])
def test_salted_joins_keep_column_pruning(spark, name):
    from waypoint.plans.registry import QUERIES
    read = scans(QUERIES[name](spark, SF_SMALL), "tx")
    assert read and all(len(cols) <= 11 for cols in read), read


def test_salted_lookup_spreads_a_missing_code(spark):
    """Half of all rows under one null code: balanced partitions, the rows of the plain join."""
    rows = [(i, None if i % 2 else f"c{i}", i % 7) for i in range(4000)]
    fact = spark.createDataFrame(rows, "ccid long, booking_code string, v int").repartition(4)
    dim = spark.createDataFrame([(None, 1.0), *[(f"c{i}", float(i)) for i in range(0, 4000, 4)]],
                                "booking_code string, w double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = lookup_join(fact, dim, "booking_code", "left", hot=(None,), null_safe=True, salts=8)
        plain = fact.join(dim.withColumnRenamed("booking_code", "k"),
                          F.col("booking_code").eqNullSafe(F.col("k")), "left").drop("k")
        assert sorted(map(str, out.select("ccid", "booking_code", "v", "w").collect())) == sorted(
            map(str, plain.select("ccid", "booking_code", "v", "w").collect()))
        salts = out.where("booking_code IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(salts) >= 3 and max(r["count"] for r in salts) <= 1200  # 2000 rows in all
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blank_cells_of_the_survey_map_match_nothing(spark):
    folder = tempfile.mkdtemp(prefix="waypoint-map-")
    with open(os.path.join(folder, "map.csv"), "w") as f:
        f.write('parallax_hashed_email_address,cid\n,S1\n"",S2\nnull,S3\na,S4\nb,\nc,null\n')
    got = {(r.cid, r.parallax_hashed_email_address) for r in csv.read_survey_map(spark, folder).collect()}
    assert got == {("S1", ""), ("S2", ""), ("S3", None), ("S4", "a"), ("", "b"), (None, "c")}
    ccids = spark.createDataFrame([(None, 1), ("a", 2), ("c", 3)], "parallax_hashed_email_address string, ccid long")
    ids = cid_to_ccid(ccids, csv.read_survey_map(spark, folder))
    assert sorted(ids.collect(), key=str) == sorted([(1, "S3"), (2, "S4"), (3, None)], key=str)


def test_null_respondent_ids_match(spark):
    ids = spark.createDataFrame([(3, None), (2, "S4")], "ccid long, cid string")
    responses = spark.createDataFrame([(None, "Low"), ("S4", "High"), ("S9", "High")], "CIDExternal string, Segments_V1 string")
    got = {(r.cid_external, r.ccid) for r in survey_answers(responses, ids).collect()}
    assert got == {(None, 3), ("S4", 2), ("S9", None)}
    alt = spark.createDataFrame([(None, "Gold"), ("S4", "Blue")], "cid_external_cid string, tier string")
    over = override_segmentation(survey_answers(responses, ids), alt, ids, "tier")
    assert {(r.ccid, r.segments_v1) for r in over.collect()} == {(3, "Gold"), (2, "Blue")}


def test_column_names_are_cleaned_like_the_survey_package():
    want = {"CIDExternal": "cid_external", "2nd trip": "x2nd_trip", "% spend": "percent_spend", "# of trips": "number_of_trips",
            "Q1_Trips": "q1_trips", "Traveller's  Age (yrs)": "travellers_age_yrs", "éa": "ea", "--": "x"}
    assert {n: clean_name(n) for n in want} == want


def test_unknown_default_level_is_named(spark):
    answers = spark.createDataFrame([(1, "A"), (2, None), (None, "Z")], "ccid long, segments_v1 string")
    check_levels(answers, "A")
    with pytest.raises(ValueError, match=r"\(Z\) not in levels \(A\)"):
        check_levels(answers, "Z")


def test_unfinished_cache_is_not_read(spark):
    folder = tempfile.mkdtemp(prefix="waypoint-half-")
    spark.range(3).write.parquet(f"{folder}/tx")
    os.remove(f"{folder}/tx/_SUCCESS")
    with pytest.raises(FileNotFoundError, match="not written to the end"):
        cache.read_tables(spark, folder)
    assert cache.load_or_build(spark, f"{folder}/tx", lambda: spark.range(5)).count() == 5
    assert cache.load_or_build(spark, f"{folder}/tx", lambda: spark.range(9)).count() == 5


def test_forest_separates_known_classes(spark):
    """Classes that need more than five splits in a row: the depth bound does not cut them."""
    p = fixture_params().with_(forest_trees=25)
    rows = [(*[float(i * 100 + j) for j in range(len(p.forest_lobs))], "AB"[i % 2]) for i in range(24) for _ in range(6)]
    names = [f"lob_{x}" for x in p.forest_lobs]
    train = spark.createDataFrame(rows, names + ["segments_v1"])
    nodes, labels = forest.forest_nodes(forest.fit_forest(train, p))
    score = train.withColumn("ccid", F.monotonically_increasing_id())
    counts = {r.pred_class: r.n for r in forest.predicted_counts(forest.predictions(nodes, labels, score, p)).collect()}
    assert counts == {"A": 72, "B": 72}


def test_value_labels(spark):
    from waypoint.sources.survey import codebook, label_columns, value_labels
    raw = spark.createDataFrame([(1.0, "2"), (2.0, "x"), (None, None), (9.0, "1")], "Seg double, q string")
    got = value_labels(label_columns(raw, {"Seg": "Which?"}), {"Seg": {"1": "A", "2": "B"}, "q": {"1": "yes"}})
    assert [tuple(r) for r in got.collect()] == [("A", "2"), ("B", "x"), (None, None), ("9", "yes")]
    assert {r.qid: r.full_question for r in codebook(spark, got).collect()}["seg"] == "Which?"


def test_entry_without_the_training_operators():
    """The other queries stay registered where the optional folder is gone."""
    import subprocess
    import sys
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('waypoint.llm'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert 'bookings_for_simulator' in names and 'pipeline' not in names, names
assert set(e.oracle_sql()) <= names
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
