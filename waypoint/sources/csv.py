"""CSV extracts: customers, multi-part transactions, survey map, alternate segments; CSV sink.

Columns are matched by header name in every file (Spark's CSV reader with a
given schema matches by position), so each part is read as text by header,
then projected and cast by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.functions.kernel import MONEY, null_tokens
from waypoint.sources import files

NULL_TOKENS = ("", "NA", "null")
TX_PART_PATTERN = r"_tx[0-9]+of[0-9]\.csv$"

# The customer extract's typed columns (others are kept as text).
CUSTOMER_TYPES = {
    "parallax_hashed_email_address": "string",
    "first_book_date_bex": "date",
    "tier_today": "string",
    "tier_12m_ago": "string",
    "highest_ever_bex_or_ok_tier": "string",
    "highest_ever_ok_tier": "string",
    "loyalty_amount_net_earned_usd_lifetime_bex_and_ok": "double",
    "loyalty_amount_net_burned_usd_lifetime_bex_and_ok": "double",
    "loyalty_amount_net_earned_usd_lifetime_ok": "double",
    "loyalty_amount_net_burned_usd_lifetime_ok": "double",
    "n_burns_lifetime": "double",
    "n_burns_lifetime_ok": "double",
    "onekey_cash_balance_local_currency": "string",
    "onekey_points_currency": "string",
    "ok_join_or_migration_date": "string",
    "first_ever_bex_ok_join_date": "string",
}

# The transaction extract's 30 columns and types (only these
# are kept); money is read as a decimal of six places so sums are exact.
TX_TYPES = {
    "booking_date_pst": "date",
    "boooking_code": "string",
    "eg_brand_code": "string",
    "posa_country_code": "string",
    "parallax_hashed_email_address": "string",
    "line_of_business": "string",
    "package_indicator": "double",
    "unit_count": "double",
    "international_flag": "double",
    "vipa_ind": "double",
    "vipa_and_burn_flag": "double",
    "fourfive_star_flag": "double",
    "any_mod_flag": "double",
    "tiered_mod_flag": "double",
    "mod_saving": "string",
    "chain_flag": "double",
    "cheap_channels_flag": "double",
    "app_flag": "double",
    "coupons_flag": "double",
    "gross_booking_amount_usd": MONEY,
    "loyalty_amount_net_burned_usd": MONEY,
    "loyalty_amount_net_earned_usd": MONEY,
    "room_night_count": "double",
    "loyalty_program": "string",
    "loyalty_tier": "double",
    "burn_ind": "double",
    "length_of_stay": "double",
    "vip_perk_ind": "double",
    "vip_room_upgrade_ind": "double",
    "begin_use_date": "date",
}
#: Column of a read with accounts: the cells of the row that its casts lose or round.
FAULTS = "__faults"
# Used by the respondent table but not in the list above: read when present.
TX_OPTIONAL_TYPES = {c: "double" for c in (
    "business_flag", "child_flag", "totl_person_count", "new_flag_brand",
    "reacquired_flag_brand")}


def _typed(col: str, typ: str, tokens) -> F.Column:
    c = null_tokens(F.col(f"`{col}`"), tokens) if tokens else F.col(f"`{col}`")
    if typ == "string":
        return c
    if typ == "date":
        return F.try_to_date(c)
    return c.try_cast(typ)


def _fault(col: str, typ: str, tokens) -> F.Column:
    """The cell if its cast loses it (``lost``) or keeps fewer of its digits (``rounded``), else null."""
    text = null_tokens(F.col(f"`{col}`"), tokens) if tokens else F.col(f"`{col}`")
    typed = _typed(col, typ, tokens)
    kind = F.when(text.isNotNull() & typed.isNull(), F.lit("lost"))
    if typ.startswith("decimal"):
        kind = kind.when(text.try_cast("decimal(38,18)") != typed, F.lit("rounded"))
    return F.when(kind.isNotNull(), F.struct(F.lit(col).alias("column_name"), text.alias("text"), kind.alias("kind")))


def faulty_cells(df: DataFrame, source: str) -> DataFrame:
    """Quarantine of a read with accounts: (source, column_name, text, kind, row), one row a faulty cell;
    ``row`` is the typed row as JSON, without what was lost."""
    rows = df.where(F.size(FAULTS) > 0)
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != FAULTS]))
    return rows.select(F.lit(source).alias("source"), row.alias("row"), F.inline(FAULTS)).select(
        "source", "column_name", "text", "kind", "row")


def fault_counts(cells: DataFrame) -> DataFrame:
    """Faulty cells by source, column and kind."""
    return cells.groupBy("source", "column_name", "kind").agg(F.count(F.lit(1)).alias("n"))


def read_text_csv(spark: SparkSession, path: str, null_value: str | None = None) -> DataFrame:
    r = (spark.read.option("header", True).option("inferSchema", False)
         .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def project(df: DataFrame, types: dict[str, str], keep_others: bool,
            optional: dict[str, str] | None = None, tokens=NULL_TOKENS, faults: bool = False) -> DataFrame:
    """Typed projection by name; listed but absent columns are null. ``faults``: with the column
    ``FAULTS``, taken in the same pass (a table written with it is counted without another read)."""
    cols = []
    for c, t in types.items():
        cols.append(_typed(c, t, tokens).alias(c) if c in df.columns
                    else F.lit(None).cast(t).alias(c))
    for c, t in (optional or {}).items():
        if c in df.columns:
            cols.append(_typed(c, t, tokens).alias(c))
    if keep_others:
        cols += [null_tokens(F.col(f"`{c}`"), tokens).alias(c)
                 for c in df.columns if c not in types]
    if faults:
        read = {c: t for c, t in (types | (optional or {})).items() if c in df.columns and t != "string"}
        cells = F.array(*[_fault(c, t, tokens) for c, t in read.items()]) if read else F.array().cast(
            "array<struct<column_name:string,text:string,kind:string>>")
        cols.append(F.filter(cells, lambda x: x.isNotNull()).alias(FAULTS))
    return df.select(*cols)


def read_customers(spark: SparkSession, path: str, faults: bool = False) -> DataFrame:
    """Customer extract (S1): 16 typed columns, other columns kept as text."""
    return project(read_text_csv(spark, path), CUSTOMER_TYPES, keep_others=True, faults=faults)


def read_tx_parts(spark: SparkSession, folder: str, faults: bool = False) -> DataFrame:
    """Union of the numbered part files ``*_tx<i>of<n>.csv`` under ``folder``."""
    names = files.list_names(spark, folder, TX_PART_PATTERN)
    if not names:
        raise FileNotFoundError(f"no transaction parts matching {TX_PART_PATTERN} in {folder}")
    parts = [project(read_text_csv(spark, f"{folder.rstrip('/')}/{n}"), TX_TYPES,
                     keep_others=False, optional=TX_OPTIONAL_TYPES, faults=faults) for n in names]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def read_survey_map(spark: SparkSession, path: str) -> DataFrame:
    """Survey id map (S6): two text columns; only ``null`` is a null token.

    The reader gives blank cells as null whatever its null token, so the token
    is set to one that does not occur, and both are mapped afterwards: blank
    cells are empty strings (which match nothing), ``null`` is null.
    """
    df = read_text_csv(spark, path, null_value="\x01")
    return df.select(*[F.when(F.coalesce(F.col(c), F.lit("")) != "null", F.coalesce(F.col(c), F.lit("")))
                       .alias(c) for c in ("parallax_hashed_email_address", "cid")])


def read_all_text(spark: SparkSession, path: str, tokens=("", "NA")) -> DataFrame:
    """Every column as text (S10), with the default null tokens ``""`` and ``NA``."""
    df = read_text_csv(spark, path)
    return df.select(*[null_tokens(F.col(f"`{c}`"), tokens).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, null_value: str = "NA", mode: str = "errorifexists"):
    (df.write.mode(mode).option("header", True).option("nullValue", null_value)
       .option("emptyValue", "").csv(path))


def output_names(df: DataFrame) -> DataFrame:
    """Export layer: underscores become spaces in every column name."""
    return df.toDF(*[c.replace("_", " ") for c in df.columns])


def write_output(df: DataFrame, out_dir: str, run_id: str, name: str,
                 order: list | None = None, spaces: bool = True) -> str:
    """CSV with header into ``out_dir/run_id/name`` (a folder of parts); nulls as NA.

    ``spaces``: underscores in the header become spaces (the two simulator
    files; the respondent table keeps its names).
    """
    path = f"{out_dir.rstrip('/')}/{run_id}/{name}"
    if order:
        df = df.orderBy(*order)
    write_csv(output_names(df) if spaces else df, path)
    return path


def read_output(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a written output back, cast by header name to the schema of ``like``."""
    raw = read_text_csv(spark, path, null_value="NA")
    types = {f.name.replace("_", " "): f.dataType.simpleString() for f in like.schema.fields}
    return project(raw, types, keep_others=False, tokens=("NA",))
