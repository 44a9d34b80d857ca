"""Survey side: id map, labelled responses, codebook, survey dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypoint.functions.kernel import null_safe_join
from waypoint.operators.identity import Dataset
from waypoint.operators.segments import clean_names
from waypoint.sources.csv import read_all_text
from waypoint.sources.fixtures import NATURAL_KEY


@dataclass(frozen=True)
class SurveyDataset:
    tx: DataFrame           # the survey sample's lines (ccid-keyed), whole
    cust: DataFrame         # the survey sample's customers
    ccids: DataFrame        # natural key -> ccid, numbered for the survey alone
    cid_to_ccid: DataFrame  # (ccid, cid)
    answers: DataFrame      # cleaned response columns + ccid
    questions: DataFrame | None = None  # (qid, full_question)
    hot_ccids: tuple = ()   # customers holding a large share of the lines
    parts: tuple[DataFrame, ...] = ()  # ``tx`` as stored

    @property
    def tx_parts(self) -> tuple[DataFrame, ...]:
        return self.parts or (self.tx,)


def label_columns(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach question text as column metadata (the labelled-column form)."""
    return df.select(*[
        F.col(c).alias(c, metadata={"label": labels[c]}) if c in labels else F.col(c)
        for c in df.columns])


def value_labels(df: DataFrame, labels: dict[str, dict[str, str]]) -> DataFrame:
    """Coded answers as their texts; codes without a text stay, whole numbers read as such.

    The labels are the codebook's (metadata, not data), so each column is one
    look-up in a literal map. Question labels of the columns are kept.
    """
    cols = []
    for f in df.schema.fields:
        texts = labels.get(f.name)
        if not texts:
            cols.append(F.col(f"`{f.name}`"))
            continue
        code = F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"^(-?\d+)\.0$", "$1")
        table = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
        cols.append(F.coalesce(F.try_element_at(table, code), code).alias(f.name, metadata=f.metadata))
    return df.select(*cols)


#: Rows that a codebook may have: it is held as metadata and as one map.
MAX_CODES = 1_000_000
BOOK_COLUMNS = ("question", "question_text", "code", "label", "position")


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """(question, question_text, code, label, position) from a CSV by header name: a row for each code
    of a coded question, in the order of its levels, and one without a code for any other question."""
    raw = read_all_text(spark, path)
    missing = set(BOOK_COLUMNS) - set(raw.columns)
    if missing:
        raise ValueError(f"codebook {path} has no column {', '.join(sorted(missing))}")
    book = raw.select(*BOOK_COLUMNS[:-1], F.col("position").try_cast("int").alias("position"))
    if book.limit(MAX_CODES + 1).count() > MAX_CODES:
        raise ValueError(f"codebook {path} has more than {MAX_CODES} rows")
    return book


def decoded(df: DataFrame, book: DataFrame) -> DataFrame:
    """Coded answers as their texts by a codebook table; question texts and the order of the levels
    become column metadata (``label``, ``levels``), which joins and selections carry on.

    The codes reach the rows as one map (a scalar subquery), so the answers are neither joined
    nor exchanged. A code without a text stays, a whole number read as such; of repeated codes
    the first text counts; a position that is no number comes last.
    """
    mine = book.where(F.col("question").isin(*df.columns))
    order = F.struct(F.col("position").isNull(), "position", "label")
    codes = (mine.where(F.col("code").isNotNull() & F.col("label").isNotNull())
             .groupBy("question", "code").agg(F.min_by("label", order).alias("label"), F.min(order).alias("at")))
    by_question = codes.groupBy("question").agg(
        F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("texts"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["label"])).alias("levels"))
    packed = by_question.agg(F.map_from_entries(F.collect_list(F.struct("question", "texts")))).scalar()
    levels = {r["question"]: list(r["levels"]) for r in by_question.select("question", "levels").collect()}
    texts = {r["question"]: r["t"] for r in
             mine.groupBy("question").agg(F.min("question_text").alias("t")).collect()}
    cols = []
    for f in df.schema.fields:
        x, meta = F.col(f"`{f.name}`"), dict(f.metadata)
        if texts.get(f.name):
            meta["label"] = texts[f.name]
        if f.name in levels:
            meta["levels"] = levels[f.name]
            code = F.regexp_replace(x.cast("string"), r"^(-?\d+)\.0$", "$1")
            x = F.coalesce(F.try_element_at(F.try_element_at(packed, F.lit(f.name)), code), code)
        cols.append(x.alias(f.name, metadata=meta))
    return df.select(*cols)


def levels_of(df: DataFrame, column: str) -> tuple[str, ...]:
    """The levels of a decoded column in the codebook's order (none, if it has no codes)."""
    return tuple(df.schema[column].metadata.get("levels", ()))


def codebook(spark: SparkSession, responses: DataFrame) -> DataFrame:
    """(qid, full_question) from the column labels; metadata-sized.

    Question ids are cleaned like the answer columns, so they match them.
    """
    ids = clean_names(responses).columns
    rows = [(q, f.metadata.get("label")) for q, f in zip(ids, responses.schema.fields)]
    return spark.createDataFrame(rows, "qid string, full_question string")


def cid_to_ccid(ccids: DataFrame, survey_map: DataFrame, key: str = NATURAL_KEY) -> DataFrame:
    """Survey id -> ccid; null natural keys match (inner, null-safe)."""
    return null_safe_join(ccids, survey_map.select(key, "cid"), key).select("ccid", "cid")


def survey_answers(responses: DataFrame, ids: DataFrame) -> DataFrame:
    """Cleaned responses with ``ccid`` (null for respondents without a match, J3)."""
    a = clean_names(responses)
    m = ids.withColumnRenamed("cid", "__cid")
    return a.join(m, a["cid_external"].eqNullSafe(m["__cid"]), "left").drop("__cid")


def survey_dataset(data: Dataset, survey_map: DataFrame, responses: DataFrame,
                   questions: DataFrame | None = None) -> SurveyDataset:
    """The survey side from its own extracts: all of their customers and lines stay,
    with or without a respondent."""
    ids = cid_to_ccid(data.ccids, survey_map)
    return SurveyDataset(tx=data.tx, cust=data.cust, ccids=data.ccids, cid_to_ccid=ids,
                         answers=survey_answers(responses, ids), questions=questions,
                         hot_ccids=data.hot_ccids, parts=data.parts)
