"""Chat formatting in budgeted windows, in DataFrame operations only.

A turn is written as <turn>role<text>text<end>; a turn that a window repeats begins with <past> instead. Inside roles and
texts ~ becomes ~0, < becomes ~1 and [ becomes ~2, so no control string can occur there, and the way back is exact.

Windows: with p the prefix sum of a conversation's turn tokens before a turn, the turn belongs to span floor(p / stride),
where stride is half of what the budget leaves beside the history. A span is a run of whole turns of less than stride
tokens plus its last turn. A window holds, in order, the conversation's first system turn (repeated, if it lies before the
span), the last turns of the span before that fit ``history`` tokens (repeated), and the span. The loss mask covers the
texts of the span's assistant turns, so every assistant text is a target exactly once; repeated turns are masked. A
window keeps to ``budget`` tokens unless the system turn or a single turn is larger than half the budget; turns are never
cut.

Only window functions and aggregations by (conversation, span) are used; no row ever holds more than a window.

Edge cases: null text and null role count as empty; turns with equal numbers follow role and text, null numbers come
first; a null conv_id is a conversation of its own; a conversation without assistant turns has an empty mask; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._text import WORD

BUDGET, HISTORY = 1024, 192
#: Control strings (fixed values).
TURN, PAST, TEXT, END = "<turn>", "<past>", "<text>", "<end>"
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"
#: Tokens that a turn's marks count.
MARKS = 3


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, span (from 1), formatted, loss: array of (start, length) in code points, for turns (conv_id, turn, role, text)."""
    stride = max(1, (budget - history) // 2)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("turn", "role", "text")
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + MARKS).withColumn("pos", F.row_number().over(order))
    rows = rows.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    rows = rows.withColumn("span", F.dense_rank().over(conv.orderBy(F.floor(F.col("before") / stride))))
    every = conv.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("spans", F.max("span").over(every)).withColumn("system_pos", F.min(F.when(F.col("role") == SYSTEM_ROLE, F.col("pos"))).over(every))
    # the next span begins where this one ends
    rows = rows.withColumn("next", F.max(F.col("before") + F.col("tokens")).over(Window.partitionBy("conv_id", "span")))
    is_system = F.coalesce(F.col("pos") == F.col("system_pos"), F.lit(False))
    repeated = (
        F.when(is_system & (F.col("span") < F.col("spans")), F.sequence(F.col("span") + 1, F.col("spans")))
        .when(~is_system & (F.col("span") < F.col("spans")) & (F.col("next") - F.col("before") <= history), F.array(F.col("span") + 1))
        .otherwise(F.array().cast("array<int>"))
    )
    placed = rows.select("conv_id", "pos", "role", "text", F.col("span").alias("own"), F.explode(F.concat(F.array("span"), repeated)).alias("span"))
    past = F.col("own") < F.col("span")
    placed = placed.withColumn("head", F.concat(F.when(past, F.lit(PAST)).otherwise(F.lit(TURN)), escape(F.col("role")), F.lit(TEXT))).withColumn("body", escape(F.col("text")))
    placed = placed.withColumn("size", F.length("head") + F.length("body") + len(END))
    within = Window.partitionBy("conv_id", "span").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.sum("size").over(within) - F.col("size") + F.length("head"))
    loss = F.when(~past & (F.col("role") == TARGET_ROLE), F.struct("pos", F.col("at").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    windows = placed.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.concat("head", "body", F.lit(END)).alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(loss)).alias("loss"),
    )
    return windows.select(
        "conv_id", "span", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("loss", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns and targets come from the formatted texts and masks alone: new turns in the order of the windows, and the text
    under the mask, unescaped.
    """
    pieces = F.filter(F.split("formatted", END), lambda x: x.startswith(TURN))
    parts = F.transform(pieces, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), TEXT))
    said = F.array_join(F.transform(parts, lambda p: F.concat(unescape(p[0]), F.lit("\n"), unescape(p[1]), F.lit("\n"))), "")
    target = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = windows.select("conv_id", "span", F.size(pieces).alias("n"), said.alias("said"), target.alias("target"), F.length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("span", "said", "target"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turns, loss = F.array_join(F.col("w.said"), ""), F.array_join(F.col("w.target"), "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def oracle(budget: int = BUDGET, history: int = HISTORY) -> str:
    """DuckDB SQL for the read-back of ``conversations`` and conversation -7."""
    stride = max(1, (budget - history) // 2)
    escaped = "replace(replace(replace({}, '~', '~0'), '<', '~1'), '[', '~2')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, len(regexp_extract_all(text, '{WORD}')) + {MARKS} AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM c
), p AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t
), s AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY floor(before / {stride})) AS span FROM p
), n AS (
  SELECT *, max(span) OVER (PARTITION BY conv_id) AS spans,
         min(pos) FILTER (WHERE role = '{SYSTEM_ROLE}') OVER (PARTITION BY conv_id) AS system_pos,
         max(before + tokens) OVER (PARTITION BY conv_id, span) AS next FROM s
), z AS (
  SELECT *, length({escaped.format("role")}) + length({escaped.format("text")}) + {len(TURN + TEXT + END)} AS size,
         1 + CASE WHEN pos = system_pos THEN spans - span WHEN span < spans AND next - before <= {history} THEN 1 ELSE 0 END AS times FROM n
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TARGET_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = '{TARGET_ROLE}'), '')) AS loss_sha256,
       CAST(sum(size * times) AS BIGINT) AS formatted_chars
FROM z GROUP BY conv_id
"""
