"""Preference formatting: pairs of conversations as one prompt and two masked completions.

A conversation's turns are ordered by turn number (then role and text, so repeated
numbers have a defined order). The longest common prefix of the chosen and the
rejected turns - same role, same text - is rendered once as the prompt; the turns
behind it are the two completions. Loss counts only inside the spans of a
completion: the texts of ``learn`` turns with their end mark. The prompt has none.

DataFrame operations only. The turns of a pair are brought together once (a pair is
one row of the result, so a task holds no more of it than the result does), and
prefix, rendering and spans are higher-order functions over that row.

Null roles render as an empty role and null texts as empty; they equal only their
like. Rows without a conversation id belong to no pair. A pair with only one side has
an empty other side (``paired`` is false). Equal sides give an empty completion on both.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, name: str) -> DataFrame:
    """``pair_id`` and the ordered turns of each conversation."""
    one = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("pair_id")).agg(F.sort_array(F.collect_list(one)).alias(name))


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(CLOSE))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def rendered(turns_: Column) -> Column:
    return F.array_join(F.transform(turns_, lambda t: F.concat(head(t), body(t))), "")


def spans(turns_: Column, learn: tuple[str, ...]) -> Column:
    """Start and end (code points) of the learned texts in the rendered turns."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(head(t))
        end = start + F.length(body(t))
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        learned = F.coalesce(t["role"].isin(*learn), F.lit(False))
        return F.struct(end.alias("at"), F.when(learned, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns_, empty, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays of turns."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(least).cast("int")


def preference_samples(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``pair_id``, ``paired``, ``prompt_turns``, ``prompt``, and of each side its completion and learned spans; a row a pair."""
    names = (id_col, turn_col, role_col, text_col)
    both = turns(chosen, *names, "c").join(turns(rejected, *names, "r"), "pair_id", "full")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    both = both.withColumn("paired", F.col("c").isNotNull() & F.col("r").isNotNull())
    both = both.withColumns({s: F.coalesce(F.col(s), F.transform(none, lambda t: F.struct(t["turn"].cast(chosen.schema[turn_col].dataType).alias("turn"), t["role"].alias("role"), t["text"].alias("text")))) for s in ("c", "r")})
    both = both.withColumn("prompt_turns", common_turns(F.col("c"), F.col("r")))
    rest = {s: F.slice(F.col(s), F.col("prompt_turns") + 1, F.size(s)) for s in ("c", "r")}
    both = both.withColumns({"p": F.slice("c", F.lit(1), F.col("prompt_turns")), "c": rest["c"], "r": rest["r"]})
    return both.select(
        "pair_id", "paired", "prompt_turns", rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), spans(F.col("c"), learn).alias("chosen_spans"),
        rendered(F.col("r")).alias("rejected"), spans(F.col("r"), learn).alias("rejected_spans"),
    )


def halved(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rejected conversations for a table that has none: in each, one assistant turn (the id-th, counted round) keeps the first half of its text."""
    answer = F.coalesce(F.col(role_col) == "assistant", F.lit(False))
    w = Window.partitionBy(id_col, answer)
    place, n = F.row_number().over(w.orderBy(turn_col, role_col, text_col)) - 1, F.count("*").over(w)
    cut = F.substring(F.col(text_col), F.lit(1), F.floor(F.length(text_col) / 2).cast("int"))
    hit = F.col("_answer") & (F.col("_place") == F.pmod(F.col(id_col), F.col("_n")))
    marked = rows.select(id_col, turn_col, role_col, text_col).withColumns({"_place": place, "_n": n, "_answer": answer})
    return marked.withColumn(text_col, F.when(hit, cut).otherwise(F.col(text_col))).drop("_place", "_n", "_answer")


def spans_text(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


SQL = """
WITH t AS (
  SELECT conv_id, role, coalesce(text, '') AS text, coalesce(role, '') AS r, coalesce(role = 'assistant', false) AS a,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
    row_number() OVER (PARTITION BY conv_id, coalesce(role = 'assistant', false) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS k,
    count(*) OVER (PARTITION BY conv_id, coalesce(role = 'assistant', false)) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT *, CASE WHEN a AND k = conv_id % n THEN substring(text, 1, length(text) // 2) ELSE text END AS other FROM t),
d AS (SELECT *, min(CASE WHEN text != other THEN i END) OVER (PARTITION BY conv_id) AS differs, count(*) OVER (PARTITION BY conv_id) AS turns FROM h),
m AS (
  SELECT *, i < coalesce(differs, turns + 1) AS common, '<|' || r || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body, other || '<|end|>' || chr(10) AS obody FROM d),
o AS (
  SELECT *, coalesce(sum(CASE WHEN common THEN 0 ELSE length(head) + length(body) END) OVER w, 0) AS pos,
    coalesce(sum(CASE WHEN common THEN 0 ELSE length(head) + length(obody) END) OVER w, 0) AS opos
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, true AS paired, (count(*) FILTER (common))::INT AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (NOT common), '') AS chosen,
  coalesce(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY i) FILTER (NOT common AND a), '') AS chosen_spans,
  coalesce(string_agg(head || obody, '' ORDER BY i) FILTER (NOT common), '') AS rejected,
  coalesce(string_agg((opos + length(head))::BIGINT || '-' || (opos + length(head) + length(obody))::BIGINT, ',' ORDER BY i) FILTER (NOT common AND a), '') AS rejected_spans
FROM o GROUP BY conv_id"""
