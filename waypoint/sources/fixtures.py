"""Domain extracts derived from the driver's synthetic tables.

The model reads a customer extract, a transaction-line extract and a survey.
The test data is a TPC-H-like star schema, so this module maps it onto those
extracts (the mapping is the one documented in FIXTURES.md section 2) with
the raw column names of the extracts. Everything is lazy; Catalyst prunes
the columns an operator does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.functions.kernel import MONEY
from waypoint.operators.joins import task_count
from waypoint.session import balance
from waypoint.sources import cache

NATURAL_KEY = "parallax_hashed_email_address"

# The 20 per-line flag / quantity columns summed per respondent,
# in the order of the respondent feature table.
FLAG_SUM_COLUMNS = (
    "package_indicator", "international_flag", "vipa_ind", "vipa_and_burn_flag",
    "fourfive_star_flag", "any_mod_flag", "tiered_mod_flag", "chain_flag",
    "cheap_channels_flag", "app_flag", "coupons_flag", "room_night_count",
    "length_of_stay", "vip_perk_ind", "vip_room_upgrade_ind", "business_flag",
    "child_flag", "totl_person_count", "new_flag_brand", "reacquired_flag_brand",
)
QUANTITY_COLUMNS = ("room_night_count", "length_of_stay", "totl_person_count")
FLAG_COLUMNS = tuple(c for c in FLAG_SUM_COLUMNS if c not in QUANTITY_COLUMNS)

# Test-data category -> line of business (raw spelling).
PART_TYPE_TO_LOB = {"ECONOMY": "Air", "LARGE": "Lodging", "MEDIUM": "Car",
                    "PROMO": "Activity", "SMALL": "Insurance"}
# Market segment -> survey segment (the first is misspelt on purpose).
MKTSEGMENT_TO_SEGMENT = {
    "BUILDING": "High Hotel / Hight Flight",
    "FURNITURE": "Low Frequency",
    "MACHINERY": "High Hotel",
    "HOUSEHOLD": "High Flight",
}


VALUE_LABELS = {"Segments_V1": {str(i): t for i, t in enumerate(
    [*MKTSEGMENT_TO_SEGMENT.values(), "All Others"], start=1)}}


def codebook_extract(spark: SparkSession) -> DataFrame:
    """The survey's codebook as a file holds it: a row a code, or one for a question without codes."""
    rows = [("CID_External", "Respondent identifier", None, None, None),
            ("Q1_Trips", "How many trips did you take in the last twelve months?", None, None, None)]
    rows += [("Segments_V1", "Traveller segment (first segmentation)", code, text, code)
             for code, text in VALUE_LABELS["Segments_V1"].items()]
    return spark.createDataFrame(rows, "question string, question_text string, code string, label string, position string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hk(custkey: Column) -> Column:
    return F.when(custkey % 50 == 0, F.lit(None).cast("string")).otherwise(
        F.md5(F.concat(F.lit("c"), custkey.cast("string"))))


def _case(col: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def in_survey_sample(custkey: Column) -> Column:
    """Customers of the survey's own extracts: every second (the id map's), and every fifth,
    so that the sample also holds customers without a respondent."""
    return (custkey % 2 == 0) | (custkey % 5 == 0)


#: Column of an extract made for both sides: the line is the survey's too.
SURVEYED = "__surveyed"


def tx_extracts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """``tx_extract`` (flagged) in parts of about ``SLICE_ROWS`` lines, each with the lines of other orders, so that they
    can be joined and written one after the other."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = max(1, -(-li.count() // cache.SLICE_ROWS))
    if li.schema["l_orderkey"].dataType != orders.schema["o_orderkey"].dataType:
        n = 1  # equal keys of two types have two hashes
    return [tx_extract(spark, sf_dir, flagged=True, part=(i, n)) for i in range(n)]


def tx_extract(spark: SparkSession, sf_dir: str, survey: bool = False, flagged: bool = False,
               part: tuple[int, int] = (0, 1)) -> DataFrame:
    """Transaction lines with the extract's raw column names (``survey``: the survey's own; ``flagged``: with
    the column ``SURVEYED``, which marks the survey's own; ``part``: number and count of the parts by order)."""
    li, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    i, n = part
    tasks = task_count(spark, li.count() // n, orders.count() // n)  # counts of the files' footers
    if n > 1:
        of_part = lambda k: F.pmod(F.xxhash64(k), F.lit(n)) == i
        li, orders = li.where(of_part("l_orderkey")), orders.where(of_part("o_orderkey"))
    od = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if survey:
        od = od.where(in_survey_sample(F.col("o_custkey")))
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    # parts first: the orders' columns are not exchanged for them, and an order's lines stay side by side
    j = (li if tasks else balance(li)).join(pt, F.col("l_partkey") == pt.p_partkey)
    if tasks:
        j = j.where(F.col("l_orderkey").isNotNull()).repartition(tasks, "l_orderkey")
    j = j.join(od, F.col("l_orderkey") == od.o_orderkey)
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    flags = {}
    for i, name in enumerate(FLAG_COLUMNS, start=1):
        v = F.when((pk + sk) % (i + 2) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        if name == "any_mod_flag":
            v = F.when(pk % 97 == 0, F.lit(None).cast("double")).otherwise(v)
        flags[name] = v
    prio = F.substring("o_orderpriority", 1, 1)
    ok, use = F.col("l_orderkey"), F.col("l_shipdate").cast("date")
    # awkward rows: codes that are missing or shared by two orders, missing dates, units, tiers and values
    # (values only outside the analysis year of the test parameters: a missing one makes every total of it missing)
    code = F.when(ok % 397 == 0, F.lit(None)).when(ok % 89 == 1, ok - 1).otherwise(ok)
    lost = lambda a, b, m, c: F.when((a * pk + b * sk) % m != 0, c)
    cols = {
        NATURAL_KEY: _hk(F.col("o_custkey")),
        "boooking_code": code,
        "eg_brand_code": F.when(sk % 5 == 0, F.lit("BR2")).otherwise(F.lit("BR1")),
        "line_of_business": _case(F.col("p_type"), PART_TYPE_TO_LOB),
        "unit_count": lost(1, 5, 701, F.when(F.col("l_quantity") <= 2, F.lit(0.0))
                           .otherwise(F.ceil(F.col("l_quantity") / 10)).cast("double")),
        "gross_booking_amount_usd": F.when((F.year(use) == 1998) | ((pk + 3 * sk) % 211 != 0),
                                           F.col("l_extendedprice").cast(MONEY)),
        "booking_date_pst": lost(2, 1, 907, F.col("o_orderdate").cast("date")),
        "begin_use_date": lost(1, 1, 503, use),
        "loyalty_tier": lost(3, 1, 997, _case(prio, {"1": 1.0, "2": 2.0, "3": 3.0, "5": 5.0}, 0.0).cast("double")),
        "loyalty_amount_net_burned_usd": lost(1, 2, 307, F.col("l_discount").cast(MONEY)),
        "loyalty_amount_net_earned_usd": F.col("l_tax").cast(MONEY),
        "room_night_count": F.col("l_quantity").cast("double"),
        "length_of_stay": F.col("l_linenumber").cast("double"),
        "totl_person_count": (1 + pk % 4).cast("double"),
        **flags,
    }
    if flagged:
        cols[SURVEYED] = F.coalesce(in_survey_sample(F.col("o_custkey")), F.lit(False))
    return j.select(*[c.alias(n) for n, c in cols.items()])


def customer_extract(spark: SparkSession, sf_dir: str, survey: bool = False) -> DataFrame:
    """Customer extract: natural key, join date held as text (with a 'null' token)."""
    c = table(spark, sf_dir, "customer")
    if survey:
        c = c.where(in_survey_sample(F.col("c_custkey")))
    k = F.col("c_custkey")
    jd = F.make_date((1995 + k % 7).cast("int"), (1 + k % 12).cast("int"),
                     (1 + k % 28).cast("int")).cast("string")
    return c.select(
        _hk(k).alias(NATURAL_KEY),
        F.when(k % 7 == 0, F.lit("null")).otherwise(jd).alias("first_ever_bex_ok_join_date"),
        F.col("c_mktsegment").alias("tier_today"),
        F.col("c_acctbal").cast("double").alias("loyalty_amount_net_earned_usd_lifetime_bex_and_ok"),
    )


def _survey_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0)


def survey_map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey id map: natural key -> survey respondent id ``cid``."""
    c = _survey_customers(spark, sf_dir)
    return c.select(_hk(F.col("c_custkey")).alias(NATURAL_KEY),
                    F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("cid"))


def survey_responses_extract(spark: SparkSession, sf_dir: str, coded: bool = False) -> DataFrame:
    """Survey responses (one row per respondent) with their raw question ids; ``coded``:
    segments as the codes of ``VALUE_LABELS``."""
    c = _survey_customers(spark, sf_dir)
    texts = VALUE_LABELS["Segments_V1"]
    segment = _case(F.col("c_mktsegment"), MKTSEGMENT_TO_SEGMENT, "All Others")
    if coded:
        segment = _case(segment, {v: float(k) for k, v in texts.items()})
    return c.select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("CID_External"),
        segment.alias("Segments_V1"),
        F.col("c_nationkey").cast("double").alias("Q1_Trips"),
    )


def _tier_expanded(bal: Column) -> Column:
    return (F.when(bal < 0, F.lit("Non-Member")).when(bal < 2500, F.lit("Blue"))
             .when(bal < 5000, F.lit("Silver")).when(bal < 7500, F.lit("Gold"))
             .otherwise(F.lit("Platinum")))


def alt_segments_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternate segmentation file (raw headers); some respondents appear twice."""
    c = _survey_customers(spark, sf_dir)
    base = c.select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("CID External CID"),
        _tier_expanded(F.col("c_acctbal")).alias("Tier Expanded"),
        F.col("c_custkey"),
    )
    dup = base.where(F.col("c_custkey") % 22 == 0)
    return base.unionByName(dup).drop("c_custkey")
