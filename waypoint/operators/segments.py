"""Customer segmentation from survey spend typing."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waypoint.functions.kernel import filled_sum, hash52, null_safe_join, spend_cut, year_filter
from waypoint.params import ModelParams
from waypoint.sources.cache import by_part

# The misspelt survey level and its correction; the level
# excluded from typing; the level removed under the tier segmentation.
TYPO_LEVEL = "High Hotel / Hight Flight"
FIXED_LEVEL = "High Hotel / High Flight"
EXCLUDED_LEVEL = "All Others"
NON_MEMBER_LEVEL = "Non-Member"
# Fixed value: the alternate file's (cleaned) natural-key column, not a segmentation.
ALT_KEY_COLUMN = "parallax_hashed_email_address_parallax_hashed_email_address"
TWO52 = 2 ** 52


def cut_columns(p: ModelParams) -> list[str]:
    return [f"lob_{l}_gbv_cut" for l in sorted(p.typing_lobs)]


def spend_cut_wide(tx: DataFrame, p: ModelParams) -> DataFrame:
    """Per customer: analysis-year spend in air and lodging, floored to steps and capped."""
    lines = tx.where(year_filter(tx, p.analysis_year)
                     & F.col("lob").isin(*p.typing_lobs) & (F.col("gbv") > 0))
    aggs = [spend_cut(filled_sum("gbv", F.col("lob") == l), p.spend_step, p.spend_cap)
            .alias(f"lob_{l}_gbv_cut") for l in sorted(p.typing_lobs)]
    return lines.groupBy("ccid").agg(*aggs)


def recode_segments(df: DataFrame, col: str = "segments_v1") -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) == TYPO_LEVEL, F.lit(FIXED_LEVEL))
                                .otherwise(F.col(col)))


def typing_table(survey_tx: DataFrame, answers: DataFrame, p: ModelParams) -> DataFrame:
    """P(segment | spend cell) from survey respondents, 'All Others' excluded.

    Keeps the integer counts ``n`` and ``n_cell`` and the cumulative count
    ``cum_n`` (segments in name order) that the draw uses.
    """
    segs = recode_segments(answers.select("ccid", "segments_v1")
                           .where(F.col("ccid").isNotNull()))
    cells = cut_columns(p)
    raw = spend_cut_wide(survey_tx, p).join(segs, "ccid")
    counts = (raw.where(F.col("segments_v1") != EXCLUDED_LEVEL)
                 .groupBy(*cells, F.col("segments_v1").alias("segment_nm"))
                 .agg(F.count(F.lit(1)).alias("n")))
    cell = Window.partitionBy(*cells)
    return counts.select(
        *cells, "segment_nm",
        (F.col("n") / F.sum("n").over(cell)).alias("segment_frac"),
        "n",
        F.sum("n").over(cell).alias("n_cell"),
        F.sum("n").over(cell.orderBy("segment_nm").rowsBetween(
            Window.unboundedPreceding, 0)).alias("cum_n"))


def typing_row_bound(p: ModelParams, n_segments: int) -> int:
    levels = p.spend_cap // p.spend_step + 1
    return levels ** len(p.typing_lobs) * n_segments


def segment_candidates(tx: DataFrame, typing: DataFrame, p: ModelParams) -> DataFrame:
    """Each customer with every segment of its spend cell (many-to-many, J5).

    The typing table has at most (cut levels)^2 x segments rows; it is
    broadcast only after that count is checked, else joined by shuffle.
    """
    cells = cut_columns(p)
    n_rows = typing.count()
    t = F.broadcast(typing) if n_rows <= 100_000 else typing
    return (spend_cut_wide(tx, p).join(t, cells, "left")
            .select("ccid", *cells, "segment_nm", "segment_frac", "n", "n_cell", "cum_n"))


def check_levels(answers: DataFrame, default_segment: str) -> None:
    known = answers.where(F.col("ccid").isNotNull()).select("segments_v1")
    levels = recode_segments(known)
    if levels.where(F.col("segments_v1") == default_segment).isEmpty():
        some = sorted(r[0] for r in levels.where(F.col("segments_v1").isNotNull()).distinct().limit(20).collect())
        raise ValueError(f"value for missing segments ({default_segment}) not in levels "
                         f"({', '.join(some)}{', ...' if len(some) == 20 else ''})")


def draw_segments(candidates: DataFrame, seed: int) -> DataFrame:
    """One segment per customer, drawn with probability ``segment_frac``.

    Inverse CDF on integers: with h a 52-bit hash of (seed, ccid), take the
    first segment in name order with ``cum_n * 2^52 > h * n_cell``. Candidate
    rows per customer are bounded by the segment count. ``uncovered`` marks
    customers whose spend cell has no typing row.
    """
    h = hash52(seed, F.col("ccid")).cast("decimal(20,0)")
    hit = (F.col("cum_n").cast("decimal(20,0)") * F.lit(TWO52).cast("decimal(18,0)")
           > h * F.col("n_cell").cast("decimal(18,0)"))
    return (candidates.groupBy("ccid")
                      .agg(F.min_by(F.when(hit, F.col("segment_nm")),
                                    F.when(hit, F.col("cum_n"))).alias("segment"),
                           F.max(F.col("segment_nm").isNull()).alias("uncovered")))


def spend_cells(tx: DataFrame, p: ModelParams) -> DataFrame:
    """Every customer with lines, with its analysis-year spend cuts (null without spend): one grouping."""
    spent = year_filter(tx, p.analysis_year) & F.col("lob").isin(*p.typing_lobs) & (F.col("gbv") > 0)
    cuts = [F.when(F.count_if(spent) > 0, spend_cut(filled_sum("gbv", spent & (F.col("lob") == l)), p.spend_step, p.spend_cap))
            .alias(f"lob_{l}_gbv_cut") for l in sorted(p.typing_lobs)]
    return tx.groupBy("ccid").agg(*cuts)


def draw_table(typing: DataFrame, p: ModelParams) -> DataFrame:
    """The typing table packed to one row a spend cell: its customers' number and (cum_n, segment) in order."""
    steps = F.array_sort(F.collect_list(F.struct("cum_n", "segment_nm")))
    return typing.groupBy(*cut_columns(p)).agg(F.max("n_cell").alias("n_cell"), steps.alias("steps"))


def drawn_segments(cells: DataFrame, typing: DataFrame, p: ModelParams) -> DataFrame:
    """One segment per customer of ``cells``, as ``draw_segments`` draws it, by a search in its cell's row.

    Customers are joined to one row at most, never multiplied by segments.
    Without spend ``segment`` is null; ``uncovered`` marks spend cells without a typing row.
    """
    names = cut_columns(p)
    packed = draw_table(typing, p)
    if packed.count() <= 100_000:
        packed = F.broadcast(packed)
    target = hash52(p.seed, F.col("ccid")).cast("decimal(20,0)") * F.col("n_cell").cast("decimal(18,0)")
    hit = lambda s: s["cum_n"].cast("decimal(20,0)") * F.lit(TWO52).cast("decimal(18,0)") > target
    return cells.join(packed, names, "left").select(
        "ccid", F.get(F.filter("steps", hit), F.lit(0))["segment_nm"].alias("segment"),
        (F.col(names[0]).isNotNull() & F.col("steps").isNull()).alias("uncovered"))


def unplaced_lines(parts: DataFrame | tuple[DataFrame, ...], typing: DataFrame, p: ModelParams, hot: tuple = ()) -> DataFrame:
    """Lines of customers that the typing table places in no segment, before the default fill.

    ``parts``: the lines, or parts of them, no customer in two. A clustered part's lines stay where they are;
    the part of the hot customers meets their segments (a row each, as many as ``hot`` at most) by broadcast.
    """
    parts = parts if isinstance(parts, tuple) else (parts,)

    def of_part(x: DataFrame, own_hot: tuple) -> DataFrame:
        drawn = drawn_segments(spend_cells(x, p), typing, p).where(F.col("segment").isNotNull())
        if own_hot and len(parts) > 1:
            return unsegmented(x, F.broadcast(drawn.select("ccid")))
        return unsegmented(x, drawn, own_hot)

    return by_part(parts, of_part, hot)


def get_segments(tx: DataFrame | tuple[DataFrame, ...], typing: DataFrame, answers: DataFrame,
                 p: ModelParams) -> DataFrame:
    """Segment of every customer with lines; default level for those without spend.

    ``tx``: the lines, or parts of them, no customer in two. Returns a materialised
    table (it is read by the guard and by the model).
    """
    from waypoint.session import materialize
    check_levels(answers, p.default_segment)
    parts = tx if isinstance(tx, tuple) else (tx,)
    drawn = drawn_segments(by_part(parts, lambda x: spend_cells(x, p)), typing, p)
    seg = materialize(drawn.select("ccid", F.coalesce("segment", F.lit(p.default_segment)).alias("segment"),
                                   "uncovered"), "segments")
    if p.on_uncovered == "error" and not seg.where("uncovered").limit(1).isEmpty():
        raise ValueError("Some customers not placed in segments")
    return seg.drop("uncovered")


def unsegmented(tx: DataFrame, segments: DataFrame, hot: tuple = ()) -> DataFrame:
    """Lines whose customer has no segment (must be empty, J8)."""
    from waypoint.operators.joins import lookup_join
    return lookup_join(tx, segments, "ccid", "left_anti", hot=hot, spread_copies=True)


def clean_name(name: str) -> str:
    """snake_case: words and acronyms apart, ``%`` and ``#`` spelt out, quotes dropped, accents
    stripped, other characters to one underscore, and ``x`` before a leading digit."""
    s = unicodedata.normalize("NFKD", name.strip()).encode("ascii", "ignore").decode()
    s = re.sub(r"['\"]", "", s).replace("%", "_percent_").replace("#", "_number_")
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    return f"x{s}" if not s or s[0].isdigit() else s


def clean_names(df: DataFrame) -> DataFrame:
    """Clean every column name; repeated names get ``_2``, ``_3`` suffixes."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        b = clean_name(c)
        seen[b] = seen.get(b, 0) + 1
        out.append(b if seen[b] == 1 else f"{b}_{seen[b]}")
    return df.toDF(*out)


def unique_only(df: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` occurs exactly once.

    A count per key with the row carried along: partial aggregation bounds
    the work of a hot key, and a kept group has one row by construction. Column
    metadata (the level order) stays.
    """
    rest = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"),
                              *[F.any_value(c).alias(c, metadata=df.schema[c].metadata) for c in rest])
    return agg.where(F.col("__n") == 1).select(key, *rest)


def override_segmentation(answers: DataFrame, alt_raw: DataFrame, cid_to_ccid: DataFrame,
                          name: str) -> DataFrame:
    """Replace ``segments_v1`` of survey answers by a column of an alternate file."""
    alt = clean_names(alt_raw).withColumnRenamed("cid_external_cid", "cid")
    alt = null_safe_join(alt, cid_to_ccid, "cid")
    excluded = {"cid", "ccid", ALT_KEY_COLUMN}
    available = [c for c in alt.columns if c not in excluded]
    if name not in available:
        raise ValueError(f"Segmentation not a valid selection: {name!r}; "
                         f"available: {', '.join(available)}")
    alt = unique_only(alt.select("ccid", F.col(name).alias("segments_v1")), "ccid")
    return answers.drop("segments_v1").join(alt, "ccid")


def drop_non_members(answers: DataFrame, segmentation: str | None) -> DataFrame:
    if segmentation == "tier_expanded":
        return answers.where(F.col("segments_v1") != NON_MEMBER_LEVEL)
    return answers
