"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of one white-space character as the word rules use it.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def id_text(col: str = "doc_id") -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_mod(col: str, m: int) -> Column:
    return F.pmod(F.crc32(id_text(col).cast("binary")), F.lit(m)).cast("int")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of ``df`` that pass through an operator: all but ``taken`` (its input and result
    names, in any case) and names with two leading underscores, which operators use."""
    names = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in names and not c.startswith("__")]


def whole(df: DataFrame) -> Column:
    """The row as one struct, so that names an operator adds cannot clash with its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).isEmpty()
