"""Oracle SQL (DuckDB) for every registered query.

Written independently of the Spark operators, step by step as the model
describes them (line-level, global windows, COUNT DISTINCT), over the
driver's tables. Shared steps are CTE fragments composed per query.
"""

from __future__ import annotations

from waypoint.params import fixture_params
from waypoint.sources.fixtures import FLAG_COLUMNS, FLAG_SUM_COLUMNS

P = fixture_params()
Y = P.analysis_year
FRAC = f"CAST({P.extract_fraction!r} AS DOUBLE)"
CAP = float(P.unit_cap)
BRAND = P.brand
LOBS3 = "('air','lodging','car')"


def yr(col: str, year: int) -> str:
    return f"({col} >= DATE '{year}-01-01' AND {col} < DATE '{year + 1}-01-01')"


def _hk(k: str) -> str:
    return (f"CASE WHEN {k} % 50 = 0 THEN NULL "
            f"ELSE md5(concat('c', CAST({k} AS VARCHAR))) END")


_flags = []
for _i, _n in enumerate(FLAG_COLUMNS, start=1):
    _v = f"CASE WHEN (l.l_partkey + l.l_suppkey) % {_i + 2} = 0 THEN 1.0 ELSE 0.0 END"
    if _n == "any_mod_flag":
        _v = f"CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE {_v} END"
    _flags.append(f"CAST({_v} AS DOUBLE) AS {_n}")
FLAGS_SQL = ",\n    ".join(_flags)

def base_ctes(pre: str = "", where_o: str = "", where_c: str = "") -> str:
    """The extracts with ids; ``pre`` and the conditions make the survey's own."""
    return f"""
{pre}tx_x AS (
  SELECT
    {_hk('o.o_custkey')} AS parallax_hashed_email_address,
    CASE WHEN l.l_orderkey % 397 = 0 THEN NULL WHEN l.l_orderkey % 89 = 1 THEN l.l_orderkey - 1
         ELSE l.l_orderkey END AS boooking_code,
    CASE WHEN l.l_suppkey % 5 = 0 THEN 'BR2' ELSE 'BR1' END AS eg_brand_code,
    CASE p.p_type WHEN 'ECONOMY' THEN 'Air' WHEN 'LARGE' THEN 'Lodging' WHEN 'MEDIUM' THEN 'Car'
                  WHEN 'PROMO' THEN 'Activity' WHEN 'SMALL' THEN 'Insurance' END AS line_of_business,
    CASE WHEN (l.l_partkey + 5 * l.l_suppkey) % 701 <> 0
         THEN CAST(CASE WHEN l.l_quantity <= 2 THEN 0 ELSE ceil(l.l_quantity / 10) END AS DOUBLE) END AS unit_count,
    CASE WHEN year(l.l_shipdate) = 1998 OR (l.l_partkey + 3 * l.l_suppkey) % 211 <> 0
         THEN CAST(l.l_extendedprice AS DECIMAL(18,6)) END AS gross_booking_amount_usd,
    CASE WHEN (2 * l.l_partkey + l.l_suppkey) % 907 <> 0 THEN CAST(o.o_orderdate AS DATE) END AS booking_date_pst,
    CASE WHEN (l.l_partkey + l.l_suppkey) % 503 <> 0 THEN CAST(l.l_shipdate AS DATE) END AS begin_use_date,
    CASE WHEN (3 * l.l_partkey + l.l_suppkey) % 997 <> 0
         THEN CAST(CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3
              WHEN '5' THEN 5 ELSE 0 END AS DOUBLE) END AS loyalty_tier,
    CASE WHEN (l.l_partkey + 2 * l.l_suppkey) % 307 <> 0
         THEN CAST(l.l_discount AS DECIMAL(18,6)) END AS loyalty_amount_net_burned_usd,
    CAST(l.l_tax AS DECIMAL(18,6)) AS loyalty_amount_net_earned_usd,
    CAST(l.l_quantity AS DOUBLE) AS room_night_count,
    CAST(l.l_linenumber AS DOUBLE) AS length_of_stay,
    CAST(1 + l.l_partkey % 4 AS DOUBLE) AS totl_person_count,
    {FLAGS_SQL}
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey {where_o}
),
{pre}cust_x AS (
  SELECT {_hk('c_custkey')} AS parallax_hashed_email_address,
    CASE WHEN c_custkey % 7 = 0 THEN 'null'
         ELSE CAST(make_date(CAST(1995 + c_custkey % 7 AS INT), CAST(1 + c_custkey % 12 AS INT),
                             CAST(1 + c_custkey % 28 AS INT)) AS VARCHAR) END
      AS first_ever_bex_ok_join_date,
    c_mktsegment AS tier_today,
    CAST(c_acctbal AS DOUBLE) AS loyalty_amount_net_earned_usd_lifetime_bex_and_ok
  FROM customer {where_c}
),
{pre}keys AS (
  SELECT parallax_hashed_email_address AS k FROM {pre}cust_x
  UNION SELECT parallax_hashed_email_address FROM {pre}tx_x
),
{pre}ccids AS (
  SELECT k AS parallax_hashed_email_address,
         CAST(row_number() OVER (ORDER BY k NULLS FIRST) AS BIGINT) AS ccid
  FROM {pre}keys
),
{pre}tx AS (
  SELECT c.ccid, t.boooking_code AS booking_code, t.eg_brand_code,
         lower(t.line_of_business) AS lob, t.unit_count,
         t.gross_booking_amount_usd AS gbv,
         t.* EXCLUDE (parallax_hashed_email_address, boooking_code, eg_brand_code,
                      line_of_business, unit_count, gross_booking_amount_usd)
  FROM {pre}tx_x t JOIN {pre}ccids c
    ON t.parallax_hashed_email_address IS NOT DISTINCT FROM c.parallax_hashed_email_address
),
{pre}cust AS (
  SELECT c.ccid, x.* EXCLUDE (parallax_hashed_email_address)
  FROM {pre}cust_x x JOIN {pre}ccids c
    ON x.parallax_hashed_email_address IS NOT DISTINCT FROM c.parallax_hashed_email_address
),
{pre}members AS (
  SELECT ccid FROM (
    SELECT ccid, CASE WHEN first_ever_bex_ok_join_date = 'null' THEN NULL
                      ELSE first_ever_bex_ok_join_date END AS join_date FROM {pre}cust)
  WHERE join_date IS NOT NULL AND year(TRY_CAST(join_date AS DATE)) <= {Y}
)"""


BASE = base_ctes()
SAMPLE = "WHERE {0} % 2 = 0 OR {0} % 5 = 0"
SURVEY = base_ctes("s_", SAMPLE.format("o.o_custkey"), SAMPLE.format("c_custkey")) + f""",
survey_map AS (
  SELECT {_hk('c_custkey')} AS parallax_hashed_email_address,
         concat('S', CAST(c_custkey AS VARCHAR)) AS cid
  FROM customer WHERE c_custkey % 2 = 0
),
cid_to_ccid AS (
  SELECT c.ccid, m.cid FROM s_ccids c JOIN survey_map m
    ON c.parallax_hashed_email_address IS NOT DISTINCT FROM m.parallax_hashed_email_address
),
responses AS (
  SELECT concat('S', CAST(c_custkey AS VARCHAR)) AS cid_external,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'High Hotel / Hight Flight'
      WHEN 'FURNITURE' THEN 'Low Frequency' WHEN 'MACHINERY' THEN 'High Hotel'
      WHEN 'HOUSEHOLD' THEN 'High Flight' ELSE 'All Others' END AS segments_v1,
    CAST(c_nationkey AS DOUBLE) AS q1_trips,
    c_acctbal, c_custkey
  FROM customer WHERE c_custkey % 2 = 0
),
answers AS (
  SELECT r.cid_external, r.segments_v1, r.q1_trips, i.ccid
  FROM responses r LEFT JOIN cid_to_ccid i ON r.cid_external = i.cid
),
survey_tx AS (SELECT * FROM s_tx),
alt_raw AS (
  SELECT cid_external AS cid,
    CASE WHEN c_acctbal < 0 THEN 'Non-Member' WHEN c_acctbal < 2500 THEN 'Blue'
         WHEN c_acctbal < 5000 THEN 'Silver' WHEN c_acctbal < 7500 THEN 'Gold'
         ELSE 'Platinum' END AS tier_expanded, c_custkey
  FROM responses
),
alt AS (
  SELECT cid, tier_expanded FROM alt_raw
  UNION ALL SELECT cid, tier_expanded FROM alt_raw WHERE c_custkey % 22 = 0
),
alt_unique AS (
  SELECT i.ccid, min(a.tier_expanded) AS segments_v1
  FROM alt a JOIN cid_to_ccid i ON a.cid = i.cid
  GROUP BY i.ccid HAVING count(*) = 1
),
answers_o AS (
  SELECT a.cid_external, a.q1_trips, a.ccid, u.segments_v1
  FROM answers a JOIN alt_unique u ON a.ccid = u.ccid
  WHERE u.segments_v1 <> 'Non-Member'
)"""


def spend_cte(name: str, src: str) -> str:
    def cut(l):
        s = f"CAST(coalesce(sum(CASE WHEN lob = '{l}' THEN gbv END), 0) AS DOUBLE)"
        return (f"CASE WHEN {s} > {float(P.spend_cap)} THEN {float(P.spend_cap)} "
                f"ELSE floor({s} / {float(P.spend_step)}) * {float(P.spend_step)} END")
    return f"""
{name} AS (
  SELECT ccid, CAST({cut('air')} AS DOUBLE) AS lob_air_gbv_cut,
         CAST({cut('lodging')} AS DOUBLE) AS lob_lodging_gbv_cut
  FROM {src}
  WHERE {yr('begin_use_date', Y)} AND lob IN ('air','lodging') AND gbv > 0
  GROUP BY ccid
)"""


def typing_cte(name: str, answers: str) -> str:
    return f"""
{name}_counts AS (
  SELECT s.lob_air_gbv_cut, s.lob_lodging_gbv_cut,
    CASE WHEN a.segments_v1 = 'High Hotel / Hight Flight' THEN 'High Hotel / High Flight'
         ELSE a.segments_v1 END AS segment_nm,
    count(*) AS n
  FROM survey_spend s JOIN {answers} a ON s.ccid = a.ccid
  WHERE a.ccid IS NOT NULL AND a.segments_v1 <> 'All Others'
  GROUP BY ALL
),
{name} AS (
  SELECT lob_air_gbv_cut, lob_lodging_gbv_cut, segment_nm,
    n / sum(n) OVER (PARTITION BY lob_air_gbv_cut, lob_lodging_gbv_cut) AS segment_frac,
    n,
    CAST(sum(n) OVER (PARTITION BY lob_air_gbv_cut, lob_lodging_gbv_cut) AS BIGINT) AS n_cell,
    CAST(sum(n) OVER (PARTITION BY lob_air_gbv_cut, lob_lodging_gbv_cut ORDER BY segment_nm
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_n
  FROM {name}_counts
)"""


SEGMENTS = (spend_cte("survey_spend", "survey_tx") + "," + typing_cte("typing", "answers_o")
            + "," + spend_cte("all_spend", "tx") + f""",
candidates AS (
  SELECT s.ccid, s.lob_air_gbv_cut, s.lob_lodging_gbv_cut, t.segment_nm, t.segment_frac,
         t.n, t.n_cell, t.cum_n
  FROM all_spend s LEFT JOIN typing t
    ON s.lob_air_gbv_cut = t.lob_air_gbv_cut AND s.lob_lodging_gbv_cut = t.lob_lodging_gbv_cut
),
drawn AS (
  SELECT ccid, arg_min(segment_nm, cum_n) AS segment
  FROM candidates
  WHERE segment_nm IS NOT NULL
    AND CAST(cum_n AS HUGEINT) * CAST({2 ** 52} AS HUGEINT)
        > CAST(('0x' || substr(md5('{P.seed}:' || CAST(ccid AS VARCHAR)), 1, 13))::BIGINT AS HUGEINT)
          * CAST(n_cell AS HUGEINT)
  GROUP BY ccid
),
segments AS (
  SELECT a.ccid, coalesce(d.segment, '{P.default_segment}') AS segment
  FROM (SELECT DISTINCT ccid FROM tx) a LEFT JOIN drawn d ON a.ccid = d.ccid
)""")

def n_distinct(x: str) -> str:
    """Distinct values, a missing one counted as one more."""
    return f"(count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END))"


def strict(x: str) -> str:
    """Sum that is missing if any input is."""
    return f"CASE WHEN count({x}) = count(*) THEN sum({x}) END"


def filled(x: str, cond: str) -> str:
    """0 when no row meets cond, missing when a meeting row has a missing x, else the sum."""
    n = f"count(CASE WHEN {cond} THEN 1 END)"
    return (f"CASE WHEN {n} = 0 THEN 0 WHEN count(CASE WHEN {cond} THEN {x} END) = {n} "
            f"THEN sum(CASE WHEN {cond} THEN {x} END) END")


LOB_EXT = ["air", "lodging", "car", "air_package", "lodging_package", "car_package"]

MODEL = f"""
pk AS (
  SELECT booking_code, count(DISTINCT lob) AS n, count(DISTINCT lob) > 1 AS is_package
  FROM tx WHERE lob IS NOT NULL AND eg_brand_code = '{BRAND}' AND lob IN {LOBS3}
  GROUP BY booking_code
),
mtx AS (
  SELECT t.ccid, t.booking_code, t.lob, t.begin_use_date, t.booking_date_pst, t.loyalty_tier,
         s.segment, coalesce(k.is_package, false) AS is_package,
         t.lob || CASE WHEN coalesce(k.is_package, false) THEN '_package' ELSE '' END AS lob_ext,
         t.gbv AS gbvlc, t.unit_count AS trip_elements
  FROM tx t JOIN segments s ON t.ccid = s.ccid
  LEFT JOIN pk k ON t.booking_code IS NOT DISTINCT FROM k.booking_code
  WHERE t.ccid IN (SELECT ccid FROM members)
    AND t.lob IS NOT NULL AND t.eg_brand_code = '{BRAND}' AND t.lob IN {LOBS3}
    AND t.unit_count > 0
),
cyu AS (
  SELECT ccid, sum(trip_elements) AS trip_elements_current_year,
         {n_distinct('booking_code')} AS bookings_current_year
  FROM mtx WHERE year(begin_use_date) = {Y} GROUP BY ccid
),
pyu AS (
  SELECT ccid, sum(trip_elements) AS trip_elements_prev_year,
         {n_distinct('booking_code')} AS bookings_prev_year
  FROM mtx WHERE year(begin_use_date) = {Y - 1} AND ccid IN (SELECT ccid FROM cyu) GROUP BY ccid
),
p2u AS (
  SELECT ccid, sum(trip_elements) AS trip_elements_prev_2_year
  FROM mtx WHERE year(begin_use_date) = {Y - 2} AND ccid IN (SELECT ccid FROM cyu) GROUP BY ccid
),
blw AS (
  SELECT booking_code,
    {", ".join(f"{filled('gbvlc', f"lob_ext = '{e}'")} AS lob_gbvlc_{e}" for e in LOB_EXT)},
    {", ".join(f"CAST(max(CASE WHEN lob_ext = '{e}' THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS lob_bookings_{e}" for e in LOB_EXT)},
    {", ".join(f"coalesce(sum(CASE WHEN lob_ext = '{e}' THEN trip_elements END), 0) AS lob_trip_elements_{e}" for e in LOB_EXT)}
  FROM mtx WHERE ccid IN (SELECT ccid FROM cyu) GROUP BY booking_code
),
bk AS (
  SELECT ccid, booking_code, segment, sum(trip_elements) AS trip_elements, CAST(1.0 AS DOUBLE) AS bookings,
         min(begin_use_date) AS begin_use_date, count(DISTINCT lob_ext) > 1 AS is_package,
         {strict('gbvlc')} AS gbvlc
  FROM mtx WHERE year(begin_use_date) = {Y} AND ccid IN (SELECT ccid FROM cyu)
  GROUP BY ccid, booking_code, segment
),
run AS (
  SELECT *,
    coalesce(sum(trip_elements) OVER (PARTITION BY ccid ORDER BY begin_use_date, booking_code, segment
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trip_elements_start_of_booking,
    CAST(row_number() OVER (PARTITION BY ccid ORDER BY begin_use_date, booking_code, segment) - 1
         AS DOUBLE) AS bookings_start_of_booking
  FROM bk
),
bu AS (
  SELECT r.ccid, r.booking_code, r.segment, r.trip_elements,
    least(coalesce(r.bookings, 0), {CAP}) AS bookings,
    r.begin_use_date, r.is_package, r.gbvlc,
    least(coalesce(r.trip_elements_start_of_booking, 0), {CAP}) AS trip_elements_start_of_booking,
    least(coalesce(r.bookings_start_of_booking, 0), {CAP}) AS bookings_start_of_booking,
    least(coalesce(CAST(c.trip_elements_current_year AS DOUBLE), 0), {CAP}) AS trip_elements_current_year,
    least(coalesce(CAST(c.bookings_current_year AS DOUBLE), 0), {CAP}) AS bookings_current_year,
    least(coalesce(CAST(p.trip_elements_prev_year AS DOUBLE), 0), {CAP}) AS trip_elements_prev_year,
    least(coalesce(CAST(p.bookings_prev_year AS DOUBLE), 0), {CAP}) AS bookings_prev_year,
    least(coalesce(CAST(q.trip_elements_prev_2_year AS DOUBLE), 0), {CAP}) AS trip_elements_prev_2_year,
    b.* EXCLUDE (booking_code)
  FROM run r JOIN cyu c ON r.ccid = c.ccid
  LEFT JOIN pyu p ON r.ccid = p.ccid
  LEFT JOIN p2u q ON r.ccid = q.ccid
  LEFT JOIN blw b ON r.booking_code IS NOT DISTINCT FROM b.booking_code
),
views AS (
  SELECT *, trip_elements_prev_year AS units_earned_prev_year,
    trip_elements_current_year AS units_earned_current_year,
    trip_elements_start_of_booking AS units_earned_start_of_booking,
    'trip_elements' AS unit_type FROM bu
  UNION ALL
  SELECT *, bookings_prev_year, bookings_current_year, bookings_start_of_booking,
    'bookings' FROM bu
)"""

LOB_COLS = [f"lob_{m}_{e}" for m in ("gbvlc", "bookings", "trip_elements") for e in LOB_EXT]


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def rnd(x: str) -> str:
    return f"round_even(CAST({x} AS DOUBLE), 0)"


BOOKINGS_OUT = f"""
  SELECT segment, {rnd('units_earned_prev_year')} AS units_earned_prev_year,
    {rnd('units_earned_current_year')} AS units_earned_current_year,
    {rnd('units_earned_start_of_booking')} AS units_earned_start_of_booking,
    unit_type, {rnd(f'sum(bookings) / {FRAC}')} AS bookings
  FROM views
  GROUP BY segment, units_earned_prev_year, units_earned_current_year,
           units_earned_start_of_booking, unit_type"""

MEMBERS_OUT = f"""
  SELECT segment, {rnd('units_earned_prev_year')} AS units_earned_prev_year,
    {rnd('units_earned_current_year')} AS units_earned_current_year, unit_type,
    {rnd(f'count(DISTINCT ccid) / {FRAC}')} AS num_members,
    {rnd(f"CAST({strict('gbvlc')} AS DOUBLE) / {FRAC}")} AS gbvlc,
    {rnd(f'sum(bookings) / {FRAC}')} AS bookings,
    {rnd(f'sum(trip_elements) / {FRAC}')} AS trip_elements,
    {rnd(f'sum(CAST(is_package AS INT)) / {FRAC}')} AS packages,
    {", ".join(f"{rnd(f'CAST({strict(c)} AS DOUBLE) / {FRAC}')} AS {c}" for c in LOB_COLS)}
  FROM views
  GROUP BY segment, units_earned_prev_year, units_earned_current_year, unit_type"""


def model_sql(select: str) -> str:
    return with_(BASE, SURVEY, SEGMENTS, MODEL) + "\n" + select


ORACLE: dict[str, str] = {}
ORACLE["bookings_for_simulator"] = model_sql(BOOKINGS_OUT)
ORACLE["members_for_simulator"] = model_sql(MEMBERS_OUT)


# ---------------------------------------------------------------------------
MONEY_TX = ("gbv", "loyalty_amount_net_burned_usd", "loyalty_amount_net_earned_usd")
TX_OUT = "* REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_TX) + ")"
GBV_OUT = "* REPLACE (CAST(gbvlc AS DOUBLE) AS gbvlc)"
LOB_MONEY = [f"lob_gbvlc_{e}" for e in LOB_EXT]
BU_OUT = ("* REPLACE (CAST(gbvlc AS DOUBLE) AS gbvlc, "
          + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LOB_MONEY) + ")")
ELIG = (f"lob IS NOT NULL AND eg_brand_code = '{BRAND}' AND lob IN {LOBS3} "
        f"AND unit_count > 0")


def base_sql(select: str, *extra: str) -> str:
    return with_(BASE, *extra) + "\n" + select


def survey_sql(select: str, *extra: str) -> str:
    return with_(BASE, SURVEY, *extra) + "\n" + select


def seg_sql(select: str) -> str:
    return with_(BASE, SURVEY, SEGMENTS) + "\n" + select


def fsum(x: str, cond: str) -> str:
    """0 when no row meets cond, null when a meeting row has null x, else the sum."""
    return (f"CAST(CASE WHEN count(CASE WHEN {cond} THEN 1 END) = 0 THEN 0 "
            f"WHEN count(CASE WHEN {cond} THEN {x} END) = count(CASE WHEN {cond} THEN 1 END) "
            f"THEN sum(CASE WHEN {cond} THEN {x} END) END AS DOUBLE)")


O = ORACLE

# ---- ingest and identity
_norm_cols = ", ".join(
    ["parallax_hashed_email_address", "boooking_code AS booking_code", "eg_brand_code",
     "lower(line_of_business) AS lob", "unit_count",
     "CAST(gross_booking_amount_usd AS DOUBLE) AS gbv", "booking_date_pst", "begin_use_date",
     "loyalty_tier",
     "CAST(loyalty_amount_net_burned_usd AS DOUBLE) AS loyalty_amount_net_burned_usd",
     "CAST(loyalty_amount_net_earned_usd AS DOUBLE) AS loyalty_amount_net_earned_usd",
     "room_night_count", "length_of_stay", "totl_person_count", *FLAG_COLUMNS])
O["tx_normalised"] = base_sql(f"SELECT {_norm_cols} FROM tx_x")
O["customer_ids"] = base_sql("SELECT * FROM ccids")
O["attach_ccid"] = base_sql("SELECT * FROM cust")
O["tx_year_slice"] = base_sql(
    "SELECT ccid, booking_code, begin_use_date, CAST(year(begin_use_date) AS INTEGER) AS use_year, "
    f"CAST(month(begin_use_date) AS INTEGER) AS use_month FROM tx WHERE {yr('begin_use_date', Y)}")

_cust_typed = {
    "parallax_hashed_email_address": "parallax_hashed_email_address",
    "first_book_date_bex": "CAST(NULL AS DATE)",
    "tier_today": "tier_today",
    "tier_12m_ago": "CAST(NULL AS VARCHAR)",
    "highest_ever_bex_or_ok_tier": "CAST(NULL AS VARCHAR)",
    "highest_ever_ok_tier": "CAST(NULL AS VARCHAR)",
    "loyalty_amount_net_earned_usd_lifetime_bex_and_ok":
        "loyalty_amount_net_earned_usd_lifetime_bex_and_ok",
    "loyalty_amount_net_burned_usd_lifetime_bex_and_ok": "CAST(NULL AS DOUBLE)",
    "loyalty_amount_net_earned_usd_lifetime_ok": "CAST(NULL AS DOUBLE)",
    "loyalty_amount_net_burned_usd_lifetime_ok": "CAST(NULL AS DOUBLE)",
    "n_burns_lifetime": "CAST(NULL AS DOUBLE)",
    "n_burns_lifetime_ok": "CAST(NULL AS DOUBLE)",
    "onekey_cash_balance_local_currency": "CAST(NULL AS VARCHAR)",
    "onekey_points_currency": "CAST(NULL AS VARCHAR)",
    "ok_join_or_migration_date": "CAST(NULL AS VARCHAR)",
    "first_ever_bex_ok_join_date":
        "CASE WHEN first_ever_bex_ok_join_date = 'null' THEN NULL "
        "ELSE first_ever_bex_ok_join_date END",
}
O["scan_customer_csv"] = base_sql(
    "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _cust_typed.items()) + " FROM cust_x")

_tx_scan = [
    "booking_date_pst", "CAST(boooking_code AS VARCHAR) AS boooking_code", "eg_brand_code",
    "CAST(NULL AS VARCHAR) AS posa_country_code", "parallax_hashed_email_address",
    "line_of_business", "package_indicator", "unit_count", "international_flag", "vipa_ind",
    "vipa_and_burn_flag", "fourfive_star_flag", "any_mod_flag", "tiered_mod_flag",
    "CAST(NULL AS VARCHAR) AS mod_saving", "chain_flag", "cheap_channels_flag", "app_flag",
    "coupons_flag", "CAST(gross_booking_amount_usd AS DOUBLE) AS gross_booking_amount_usd",
    "CAST(loyalty_amount_net_burned_usd AS DOUBLE) AS loyalty_amount_net_burned_usd",
    "CAST(loyalty_amount_net_earned_usd AS DOUBLE) AS loyalty_amount_net_earned_usd",
    "room_night_count", "CAST(NULL AS VARCHAR) AS loyalty_program", "loyalty_tier",
    "CAST(NULL AS DOUBLE) AS burn_ind", "length_of_stay", "vip_perk_ind",
    "vip_room_upgrade_ind", "begin_use_date", "business_flag", "child_flag",
    "totl_person_count", "new_flag_brand", "reacquired_flag_brand"]
O["scan_tx_parts"] = base_sql("SELECT " + ", ".join(_tx_scan) + " FROM tx_x")
O["read_faults"] = base_sql(" UNION ALL ".join(
    f"SELECT 'transactions' AS source, '{c}' AS column_name, '{kind}' AS kind, count(*) AS n FROM tx_x "
    f"WHERE boooking_code % {m} = 0 AND {c} IS NOT NULL HAVING count(*) > 0"
    for c, kind, m in (("begin_use_date", "lost", 17), ("unit_count", "lost", 11),
                       ("gross_booking_amount_usd", "rounded", 13))))
O["cache_roundtrip"] = base_sql(
    f"SELECT {TX_OUT}, CAST(year(begin_use_date) AS INTEGER) AS use_year FROM tx")

# ---- survey
O["survey_id_map"] = survey_sql("SELECT * FROM cid_to_ccid")
O["survey_dataset"] = survey_sql("SELECT * FROM answers")
O["override_segmentation"] = survey_sql("SELECT * FROM answers_o")
O["unique_only"] = survey_sql("SELECT * FROM alt_unique")

# ---- segmentation
O["spend_cut_wide"] = base_sql("SELECT * FROM all_spend", spend_cte("all_spend", "tx"))
O["typing_table"] = survey_sql("SELECT * FROM typing_v1", spend_cte("survey_spend", "survey_tx"),
                               typing_cte("typing_v1", "answers"))
O["typing_table_override"] = seg_sql("SELECT * FROM typing")
O["segment_candidates"] = seg_sql("SELECT * FROM candidates")
O["segment_assignment"] = seg_sql("SELECT * FROM segments")
O["unsegmented_customers"] = seg_sql(
    f"SELECT {TX_OUT} FROM tx WHERE ccid NOT IN (SELECT ccid FROM drawn WHERE segment IS NOT NULL)")

# ---- model stages
O["members"] = base_sql("SELECT * FROM members")
O["package_flags"] = model_sql("SELECT * FROM pk")
O["tx_enriched"] = model_sql(
    "SELECT ccid, booking_code, lob, lob_ext, segment, is_package, begin_use_date, "
    "booking_date_pst, loyalty_tier, CAST(gbvlc AS DOUBLE) AS gbvlc, trip_elements FROM mtx")
O["current_year_units"] = model_sql("SELECT * FROM cyu")
O["prev_year_units"] = model_sql("SELECT * FROM pyu")
O["booking_lob_wide"] = model_sql(
    "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LOB_MONEY)
    + ") FROM blw")
O["booking_rollup"] = model_sql(f"SELECT {GBV_OUT} FROM bk")
O["running_units"] = model_sql(f"SELECT {GBV_OUT} FROM run")
O["booking_units"] = model_sql(f"SELECT {BU_OUT} FROM bu")
O["shared_booking_codes"] = model_sql(
    "SELECT count(*) AS n_booking_codes, count(CASE WHEN n > 1 THEN 1 END) AS n_shared_codes, "
    "CAST(coalesce(max(n), 0) AS BIGINT) AS max_customers_per_code "
    "FROM (SELECT booking_code, count(*) AS n FROM bu GROUP BY booking_code)")
O["unit_views"] = model_sql(f"SELECT {BU_OUT} FROM views")
_sink_cols = ["segment", "units_earned_prev_year", "units_earned_current_year",
              "units_earned_start_of_booking", "unit_type", "bookings"]
O["sink_roundtrip"] = model_sql(
    "SELECT " + ", ".join(f'{c} AS "{c.replace("_", " ")}"' for c in _sink_cols)
    + f" FROM ({BOOKINGS_OUT})")
O["stage_reconciliation"] = model_sql(f"""
  SELECT 'raw' AS stage, CAST({strict('gbv')} AS DOUBLE) / {FRAC} AS gbvlc,
         {n_distinct('booking_code')} / {FRAC} AS bookings,
         sum(unit_count) / {FRAC} AS trip_elements
  FROM tx WHERE {yr('begin_use_date', Y)} AND {ELIG}
  UNION ALL
  SELECT 'raw_members', CAST({strict('gbv')} AS DOUBLE) / {FRAC},
         {n_distinct('booking_code')} / {FRAC}, sum(unit_count) / {FRAC}
  FROM tx WHERE {yr('begin_use_date', Y)} AND {ELIG} AND ccid IN (SELECT ccid FROM members)
  UNION ALL
  SELECT 'tx', CAST({strict('gbvlc')} AS DOUBLE) / {FRAC}, {n_distinct('booking_code')} / {FRAC},
         sum(trip_elements) / {FRAC}
  FROM mtx WHERE {yr('begin_use_date', Y)}
  UNION ALL
  SELECT 'current_year', NULL, sum(bookings_current_year) / {FRAC},
         sum(trip_elements_current_year) / {FRAC} FROM cyu
  UNION ALL
  SELECT 'unit_calculation', CAST({strict('gbvlc')} AS DOUBLE) / {FRAC}, sum(bookings) / {FRAC},
         sum(trip_elements) / {FRAC} FROM bu
  UNION ALL
  SELECT 'book_for_sim', NULL, sum(bookings) / 2.0, NULL FROM ({BOOKINGS_OUT})
  UNION ALL
  SELECT 'mem_for_sim', sum(gbvlc) / 2.0, sum(bookings) / 2.0, sum(trip_elements) / 2.0
  FROM ({MEMBERS_OUT})""")
O["sample_customers"] = base_sql(f"""
  SELECT {TX_OUT} FROM tx WHERE ccid IN (
    SELECT ccid FROM (SELECT DISTINCT ccid FROM tx)
    ORDER BY ('0x' || substr(md5('{P.seed}:' || CAST(ccid AS VARCHAR)), 1, 13))::BIGINT, ccid
    LIMIT {P.sample_size})""")

# ---- respondent features
SURVEY_LOBS = ["activity", "air", "car", "insurance", "lodging", None]
_lw = []
for _m, _src in (("num_bookings", None), ("unit_count", "unit_count"),
                 ("gross_booking_amount_usd", "gbv"),
                 ("loyalty_amount_net_burned_usd", "loyalty_amount_net_burned_usd"),
                 ("loyalty_amount_net_earned_usd", "loyalty_amount_net_earned_usd")):
    for _l in SURVEY_LOBS:
        _cond = "lob IS NULL" if _l is None else f"lob = '{_l}'"
        _name = f"{_m}_lob_{'NA' if _l is None else _l}"
        if _src is None:
            _lw.append(f"count(DISTINCT CASE WHEN {_cond} THEN booking_code END) + "
                       f"max(CASE WHEN {_cond} AND booking_code IS NULL THEN 1 ELSE 0 END) "
                       f"AS {_name}")
        else:
            _lw.append(f"{fsum(_src, _cond)} AS {_name}")
LOB_WIDE_NAMES = [x.rsplit(" AS ", 1)[1] for x in _lw]
FLAG_NAMES = list(FLAG_SUM_COLUMNS)
RESP = f"""
p12 AS (SELECT * FROM survey_tx WHERE {yr('begin_use_date', Y)}),
lw AS (SELECT ccid, {", ".join(_lw)} FROM p12 GROUP BY ccid),
fs AS (SELECT ccid, {", ".join(f"{strict(c)} AS {c}" for c in FLAG_NAMES)} FROM p12 GROUP BY ccid)"""
O["lob_metrics_wide"] = survey_sql("SELECT * FROM lw", RESP)
O["flag_sums"] = survey_sql("SELECT * FROM fs", RESP)
O["survey_features"] = survey_sql(f"""
  SELECT i.cid, c.parallax_hashed_email_address,
    {", ".join(f"coalesce(w.{n}, 0) AS {n}" for n in LOB_WIDE_NAMES)},
    {", ".join(f"coalesce(f.{n}, 0) AS {n}" for n in FLAG_NAMES)}
  FROM cid_to_ccid i JOIN s_ccids c ON i.ccid = c.ccid
  LEFT JOIN lw w ON i.ccid = w.ccid LEFT JOIN fs f ON i.ccid = f.ccid""", RESP)

# ---- tiers
TIER_NAME = ("CASE {x} WHEN 1 THEN 'Blue' WHEN 2 THEN 'Silver' WHEN 3 THEN 'Gold' "
             "WHEN 5 THEN 'Platinum' END")
a_, b_, c_ = P.tier_thresholds
NAMED = (f"CASE WHEN trip_elements_start_of_booking >= {c_} OR trip_elements_prev_year >= {c_} "
         f"THEN 'platinum' WHEN trip_elements_start_of_booking >= {b_} OR "
         f"trip_elements_prev_year >= {b_} THEN 'gold' WHEN trip_elements_start_of_booking >= {a_} "
         f"OR trip_elements_prev_year >= {a_} THEN 'silver' ELSE 'blue' END")
TIERS = f"""
dims AS (
  SELECT booking_code,
    CASE WHEN count(booking_date_pst) = count(*) THEN min(booking_date_pst) END AS booking_date_pst,
    CASE WHEN count(loyalty_tier) = count(*) THEN min(loyalty_tier) END AS loyalty_tier
  FROM mtx GROUP BY booking_code
),
cmp0 AS (
  SELECT *, CASE WHEN trip_elements_start_of_booking IS NOT NULL AND trip_elements_prev_year IS NOT NULL
                 THEN greatest(trip_elements_start_of_booking, trip_elements_prev_year) END AS base_t
  FROM bu
),
cmp1 AS (
  SELECT *, CASE WHEN month(begin_use_date) <= 2 THEN
              CASE WHEN trip_elements_prev_2_year IS NOT NULL AND base_t IS NOT NULL
                   THEN greatest(trip_elements_prev_2_year, base_t) END
            ELSE base_t END AS trip_elements_for_tier
  FROM cmp0
),
cmp AS (
  SELECT b.ccid, d.booking_date_pst, b.begin_use_date, b.trip_elements_start_of_booking,
    b.trip_elements_prev_year, b.trip_elements_prev_2_year, b.trip_elements, b.booking_code,
    b.trip_elements_for_tier,
    {TIER_NAME.format(x=f"CASE WHEN b.trip_elements_for_tier < {a_} THEN 1 WHEN b.trip_elements_for_tier < {b_} THEN 2 WHEN b.trip_elements_for_tier < {c_} THEN 3 WHEN b.trip_elements_for_tier < 'inf'::DOUBLE THEN 5 END")} AS calculated_tier,
    {TIER_NAME.format(x="d.loyalty_tier")} AS loyalty_tier
  FROM cmp1 b JOIN dims d ON b.booking_code IS NOT DISTINCT FROM d.booking_code
),
named AS (SELECT *, {NAMED} AS tier FROM bu)"""


def tier_sql(select: str) -> str:
    return with_(BASE, SURVEY, SEGMENTS, MODEL, TIERS) + "\n" + select


O["recorded_tier_distribution"] = base_sql(f"""
  SELECT loyalty_tier, n / {FRAC} AS num_bookings, n / sum(n) OVER () AS prct_bookings
  FROM (SELECT loyalty_tier, count(*) AS n FROM (
          SELECT DISTINCT booking_code, loyalty_tier FROM tx
          WHERE {yr('begin_use_date', Y)} AND {ELIG} AND ccid IN (SELECT ccid FROM members))
        GROUP BY loyalty_tier HAVING loyalty_tier > 0)""")
O["tier_compare"] = tier_sql("SELECT * FROM cmp")
O["tier_confusion"] = tier_sql(
    "SELECT loyalty_tier, calculated_tier, count(*) AS n FROM cmp GROUP BY ALL")
O["tier_confusion_monthly"] = tier_sql(
    "SELECT loyalty_tier, calculated_tier, strftime(begin_use_date, '%b') AS begin_month, "
    "count(*) AS n FROM cmp GROUP BY ALL")
O["tier_mismatch_rows"] = tier_sql(
    "SELECT * FROM cmp WHERE loyalty_tier = 'Silver' AND calculated_tier = 'Blue' "
    "AND month(begin_use_date) = 12")
O["customer_history"] = tier_sql(f"""
  SELECT booking_code, begin_use_date, trip_elements, lob, loyalty_tier FROM mtx
  WHERE ccid = (SELECT ccid FROM (SELECT ccid, count(*) AS n FROM mtx
                WHERE {yr('begin_use_date', Y)} GROUP BY ccid) ORDER BY n DESC, ccid LIMIT 1)""")
O["calculated_tier_totals"] = tier_sql(
    f"SELECT tier, CAST({strict('gbvlc')} AS DOUBLE) / {FRAC} AS gbvlc, sum(bookings) / {FRAC} AS bookings "
    "FROM named GROUP BY tier")
O["recorded_tier_value"] = tier_sql(
    f"SELECT loyalty_tier, CAST({strict('gbvlc')} AS DOUBLE) / {FRAC} AS gbvlc FROM mtx "
    f"WHERE {yr('begin_use_date', Y)} GROUP BY loyalty_tier")
O["recorded_tier_counts"] = tier_sql(
    f"SELECT loyalty_tier, count(*) AS n FROM mtx WHERE {yr('begin_use_date', Y + 1)} "
    "GROUP BY loyalty_tier")
O["monthly_tier_mix"] = tier_sql(f"""
  SELECT m AS begin_use_date, loyalty_tier, n, n / sum(n) OVER (PARTITION BY m) AS p
  FROM (SELECT CAST(date_trunc('month', begin_use_date) AS DATE) AS m, loyalty_tier, count(*) AS n
        FROM mtx WHERE begin_use_date < DATE '{Y + 1}-08-01' GROUP BY ALL)""")
O["daily_bookings"] = tier_sql("SELECT begin_use_date, count(*) AS n FROM bu GROUP BY ALL")
O["monthly_calculated_tier"] = tier_sql(
    "SELECT tier, CAST(date_trunc('month', begin_use_date) AS DATE) AS begin_use_date, "
    "count(*) AS n FROM named GROUP BY ALL")
O["calculated_tier_counts"] = tier_sql("SELECT tier, count(*) AS n FROM named GROUP BY tier")

# ---- transitions
TRANS_T = """
ttx AS (
  SELECT * FROM {src} WHERE ccid IN (SELECT ccid FROM {members}) AND lob IS NOT NULL
    AND eg_brand_code = '{BRAND}' AND lob IN ('air','lodging') AND unit_count > 0
),
tcy AS (
  SELECT ccid, sum(unit_count) AS trip_elements_current_year,
         {CODES} AS bookings_current_year
  FROM ttx WHERE year(begin_use_date) = {Y} GROUP BY ccid
),
tpy AS (
  SELECT ccid, sum(unit_count) AS trip_elements_prev_year,
         {CODES} AS bookings_prev_year
  FROM ttx WHERE year(begin_use_date) = {Y1} AND ccid IN (SELECT ccid FROM tcy) GROUP BY ccid
),
uc AS (SELECT * FROM tcy LEFT JOIN tpy USING (ccid)),
cohort AS (
  SELECT * FROM uc WHERE bookings_prev_year = 1 AND bookings_current_year > 1
    AND bookings_current_year <= {BAND}
)"""


TRANS = TRANS_T.format(src="tx", members="members", BRAND=BRAND, Y=Y, Y1=Y - 1, BAND=P.band_max, CODES=n_distinct("booking_code"))


def trans_sql(select: str, src: str = "tx") -> str:
    t = TRANS_T.format(src=src, members="members" if src == "tx" else "s_members", BRAND=BRAND, Y=Y, Y1=Y - 1, BAND=P.band_max, CODES=n_distinct("booking_code"))
    if src == "tx":
        return with_(BASE, t) + "\n" + select
    return with_(BASE, SURVEY, t) + "\n" + select


O["units_compare"] = trans_sql("SELECT * FROM uc")
UNIT_TRANSITIONS = f"""
  SELECT * FROM (
    SELECT bookings_current_year, bookings_prev_year, count(*) AS n,
           count(*) / sum(count(*)) OVER (PARTITION BY bookings_prev_year) AS p
    FROM uc GROUP BY bookings_current_year, bookings_prev_year)
  WHERE bookings_prev_year <= {P.band_max} AND bookings_prev_year > 0
    AND bookings_current_year <= {P.band_max} AND bookings_current_year > 0"""
O["unit_transitions"] = trans_sql(UNIT_TRANSITIONS)
O["survey_unit_transitions"] = trans_sql(UNIT_TRANSITIONS, "survey_tx")
O["growth_cohort"] = trans_sql("SELECT * FROM cohort")
O["growth_bookings_dist"] = trans_sql(
    "SELECT bookings_current_year, count(*) AS n, count(*) / sum(count(*)) OVER () AS p "
    "FROM cohort GROUP BY 1")
O["growth_units_dist"] = trans_sql(
    "SELECT trip_elements_current_year, count(*) AS n, count(*) / sum(count(*)) OVER () AS p "
    "FROM cohort GROUP BY 1")
_k = float(P.num_buckets)
O["growth_multipliers"] = trans_sql(f"""
  SELECT b / CAST({_k} AS DOUBLE) AS percentile_group, avg(v) AS group_mean_trip_elements,
         avg(v) / (SELECT avg(trip_elements_current_year) FROM cohort) AS group_multiplier
  FROM (SELECT v, floor((i / n) * CAST({_k} AS DOUBLE)) AS b FROM (
          SELECT trip_elements_current_year AS v,
                 row_number() OVER (ORDER BY trip_elements_current_year) - 1 AS i,
                 count(*) OVER () AS n FROM cohort))
  GROUP BY b""")

# ---- random forest
O["rf_training_set"] = survey_sql(f"""
  SELECT {", ".join(f"{fsum('gbv', f"lob = '{l}'")} AS lob_{l}" for l in P.forest_lobs)},
         a.segments_v1
  FROM survey_tx t JOIN answers a ON t.ccid = a.ccid
  WHERE {yr('t.begin_use_date', Y)} AND a.segments_v1 IS NOT NULL
  GROUP BY t.ccid, a.cid_external, a.segments_v1""")
O["rf_scored_customers"] = base_sql(f"""
  SELECT t.ccid, {", ".join(f"{fsum('gbv', f"lob = '{l}'")} AS lob_{l}" for l in P.forest_lobs)}
  FROM tx t WHERE {yr('t.begin_use_date', Y)} AND t.ccid IN (
    SELECT ccid FROM ccids
    ORDER BY ('0x' || substr(md5('{P.seed}:' || CAST(ccid AS VARCHAR)), 1, 13))::BIGINT, ccid
    LIMIT {P.scored_size})
  GROUP BY t.ccid""")
