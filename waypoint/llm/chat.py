r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its reply trainable. Turns after the last assistant turn
form a closing example with nothing trainable, so the examples of a
conversation always hold all of it. A turn is written as

    <s>[INST] role \n text [/INST]</s>      (no spaces; texts as they are)

with ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` as control strings. Inside
roles and texts a backslash is doubled and a control string's first character
becomes ``\{`` or ``\(`` (a role's line feed ``\n``), which ``read_back``
reverses; so control strings in texts can neither open nor close a turn.

Defined cases: null texts and roles are empty; turns are ordered by turn,
role and text, nulls first, and repeated turns stay; a null conversation id
is a conversation; a conversation without assistant turns has just the
closing example; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waypoint.llm.common import table

#: The control strings.
OPEN, CLOSE, BEGIN, END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = (OPEN, CLOSE, BEGIN, END)
TARGET = "assistant"
#: Stand-ins of a control string's first character.
STAND_IN = {"<": "\\{", "[": "\\("}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(STAND_IN[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """Undoes ``escape``: between doubled backslashes every backslash starts a stand-in."""
    def plain(part: Column) -> Column:
        for char, mark in STAND_IN.items():
            part = F.replace(part, F.lit(mark), F.lit(char))
        return F.replace(part, F.lit("\\n"), F.lit("\n"))

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """One row per example of ``turns`` (conv_id, turn, role, text):
    conv_id, example (from 0), formatted, loss_start, loss_end (code points; equal
    where nothing is trainable) and last (the example holds the whole conversation)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    body = escape(F.col("text"))
    piece = F.concat(F.lit(OPEN + BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"),
                     body, F.lit(END + CLOSE))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = rows.select("conv_id", F.row_number().over(order).alias("i"), piece.alias("piece"),
                        F.sum(F.length(piece)).over(upto).cast("int").alias("end"),
                        F.length(body).alias("n"), (F.col("role") == TARGET).alias("target"))
    conv = spans.groupBy("conv_id").agg(  # the window's partitioning serves the grouping too
        F.array_sort(F.collect_list(F.struct("i", "piece", "end", "n", "target"))).alias("p"))
    shown = F.filter("p", lambda x: x["target"] | (x["i"] == F.size("p")))
    loss_end = F.col("x.end") - len(END + CLOSE)
    return (conv.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("w"),
                        F.size("p").alias("turns"), F.transform(shown, lambda x: x.dropFields("piece")).alias("s"))
            .select("conv_id", "w", "turns", F.posexplode("s").alias("example", "x"))
            .select("conv_id", "example", F.substring(F.col("w"), F.lit(1), F.col("x.end")).alias("formatted"),
                    F.when(F.col("x.target"), loss_end - F.col("x.n")).otherwise(loss_end).alias("loss_start"),
                    loss_end.alias("loss_end"), (F.col("x.i") == F.col("turns")).alias("last")))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    turn = lambda x: F.struct(
        unescape(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, F.length(x))).alias("text"))
    # the piece after the last closing string is empty
    parts = F.split(formatted, r"\[/INST\]</s>")
    inner = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1),
                        lambda x: F.substring(x, F.lit(len(OPEN + BEGIN) + 1), F.length(x)))
    return F.transform(inner, turn)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations (and conversation -1), read back from their examples."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, t.* FROM VALUES (0L, 'user', '{said}'), "
                      f"(1L, 'assistant', '{said}') AS t(turn, role, text)")
    made = examples(own.unionByName(extra))
    span = F.col("loss_end") - F.col("loss_start")
    read = made.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("n"),
        unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, span)).alias("reply"),
        F.when(F.col("last"), read_back(F.col("formatted"))).alias("turns"))
    digested = read.select(
        "conv_id", "example", "n", "reply", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"), F.col("turns").isNotNull().alias("last"))
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"]), "")
    return (digested.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("n_turns"))).alias("n_turns"),
        F.max(F.when(F.col("last"), F.col("sha"))).alias("turns_sha256"),
        loss.alias("loss"), F.sum("n").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))


#: The digests straight from the table; formatted lengths from the control strings' lengths.
OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS n,
    (21 + length(role) + length(text)
      + (length(role) - length(replace(role, '\', ''))) + (length(text) - length(replace(text, '\', '')))
      + (length(role) - length(replace(role, chr(10), '')))
      + len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]'))) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR rn = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
