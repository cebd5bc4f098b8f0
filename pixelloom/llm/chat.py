"""Operator 4: chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation once for every state it went through. Each
turn gets a rolling hash of its conversation up to there: running sums of
four position-dependent hashes of role and text, so equal prefixes have
equal hashes at equal positions. A conversation whose whole hash is a
prefix hash of a longer one is dropped by an anti-join, of equal ones the
smallest id stays, and the rest are rendered. Prefix hashes and whole hashes
are aggregated before they are joined, so a first turn or a conversation that
a third of all logs share is one row on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import written

#: How a turn is rendered: {role} and {text} are replaced.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"

_SUMS = ["s0", "s1", "s2", "s3"]


def rolling(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, at, role, text, s0..s3, last): turns in order with the rolling hash of the conversation so far."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = W.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("last", F.lead("at").over(order).isNull())
    a, b = F.xxhash64("at", "role", "text"), F.xxhash64("text", "at", "role")
    halves = [F.shiftrightunsigned(h, s).bitwiseAND(0xFFFFFFFF) for h in (a, b) for s in (0, 32)]
    sofar = order.rowsBetween(W.unboundedPreceding, 0)
    return rows.select("conv", "at", "role", "text", "last", *[F.sum(h).over(sofar).alias(s) for h, s in zip(halves, _SUMS, strict=True)])


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv): conversations that are no prefix of a longer one, and of equal ones the smallest."""
    key = ["at", *_SUMS]
    whole = hashes.where("last").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    inner = hashes.where("not last").groupBy(*key).agg(F.lit(1).alias("one"))
    return whole.join(inner, key, "left_anti").select("conv")


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, text): the maximal conversations, rendered by the template.

    Turns are ordered by turn, then role and text, so ties have one order;
    their numbers need not start at 0 or follow each other. Null role or text
    is the empty string; a null id is a conversation of its own, and the
    smallest of equal ones; repeated rows are turns of their own; an empty
    table gives no rows; other columns are not read.
    """
    hashes = written(rolling(turns, conv_col, turn_col, role_col, text_col))
    stays = maximal(hashes.select("conv", "at", "last", *_SUMS)).select(F.col("conv").alias("c"))
    before, between, after = *template.split("{role}")[:1], *template.split("{role}")[1].split("{text}")
    turn = F.concat(F.lit(before), "role", F.lit(between), "text", F.lit(after))
    rows = hashes.select("conv", "at", turn.alias("turn")).join(stays, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    return rows.groupBy(F.col("conv").alias(conv_col)).agg(F.count("*").alias("n_turns"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "turn"))).getField("turn"), "").alias("text"))


#: The same rows by comparing whole prefixes as strings.
ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations),
p AS (
  SELECT conv_id, pos, role, text, lead(pos) OVER (PARTITION BY conv_id ORDER BY pos) IS NULL AS last,
         string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix FROM t),
stays AS (
  SELECT min(conv_id) AS conv_id FROM p WHERE last GROUP BY pos, prefix
  HAVING NOT EXISTS (SELECT 1 FROM p AS i WHERE NOT i.last AND i.pos = p.pos AND i.prefix = p.prefix))
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM t SEMI JOIN stays USING (conv_id) GROUP BY conv_id
"""
