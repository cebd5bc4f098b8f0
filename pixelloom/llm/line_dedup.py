"""Operator 5: line dedup by site-relative frequency.

For each host, the pages that hold a line are divided by the host's pages; a
line whose share exceeds a ratio is boilerplate of that host and goes. Only
line hashes are shuffled, pre-aggregated by host and line, so a host with a
third of all pages is summed in every task first. A host can have no more
boilerplate lines than its mean number of lines a page divided by the ratio,
so their list is short; pages get it by a broadcast of checked size or, beyond
it, a join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import broadcast_if_small, written

#: Boilerplate lines, over all hosts, that a broadcast may hold (8 bytes each, and their hosts).
BROADCAST_LINES = 200_000


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, line): hashes of the lines that exceed the ratio of their host's pages; null hosts are one host ''."""
    rows = pages.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    lines = rows.select("host", F.explode(F.expr("array_distinct(transform(split(text, '\n'), x -> trim(x)))")).alias("l")).where("l <> ''")
    holding = lines.groupBy("host", F.xxhash64("l").alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    total = rows.groupBy("host").agg(F.count("*").alias("total"))
    return holding.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "line")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 2, spare_copies: bool = False) -> DataFrame:
    """All columns of pages, text_col without its host's boilerplate lines, and n_dropped: how many went.

    Lines are compared without blanks at their ends, and count once a page;
    blank lines stay. A line is boilerplate if more than `ratio` of its
    host's pages hold it and at least min_pages do (2: a line that no other
    page of the host repeats never is), whatever else its page holds. With
    spare_copies, pages without any other line whose whole text another page
    of their host repeats stay as they are, for document dedup. Null text
    stays null; null hosts form one host; repeated rows are pages of their
    own; an empty table gives none. A column n_dropped is replaced.
    """
    found = written(boilerplate(pages, host_col, text_col, ratio, min_pages))
    few = found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    lists = found.groupBy("host").agg(F.collect_set("line").alias("__lines"))
    lists = F.broadcast(lists) if few else lists.hint("merge")
    rest = pages.drop("n_dropped")
    rows = rest.withColumn("__host", F.coalesce(F.col(host_col).cast("string"), F.lit(""))).join(lists.withColumnRenamed("host", "__host"), "__host", "left")
    split = f"split(`{text_col}`, '\n')"
    rows = rows.withColumn("__kept", F.when(F.col("__lines").isNotNull(), F.expr(f"filter({split}, x -> trim(x) = '' or not array_contains(__lines, xxhash64(trim(x))))")))
    rows = rows.withColumn("__text", F.array_join("__kept", "\n"))
    take = F.length("__text") < F.length(text_col)
    if spare_copies:
        rows = rows.withColumn("__digest", F.when(F.expr("not exists(__kept, x -> trim(x) <> '')"), F.sha2(text_col, 256)))
        copies = written(rows.where("__digest is not null").groupBy("__host", "__digest").agg(F.count("*").alias("n")).where("n > 1").select("__host", "__digest", F.lit(True).alias("__copy")))
        rows = rows.join(broadcast_if_small(copies, BROADCAST_LINES), ["__host", "__digest"], "left")
        take = take & F.col("__copy").isNull()
    take = F.coalesce(take, F.lit(False))
    dropped = F.when(take, F.expr(f"size({split}) - size(__kept)")).otherwise(F.lit(0)).cast("long")
    out = rows.withColumn("n_dropped", dropped).withColumn(text_col, F.when(take, F.col("__text")).otherwise(F.col(text_col)))
    return out.select(*rest.columns, "n_dropped")


#: The same rows, with source as host and the default parameters, by comparing whole lines.
ORACLE = """
WITH lines AS (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
holding AS (SELECT host, trim(l) AS l, count(DISTINCT doc_id) AS n FROM lines WHERE trim(l) <> '' GROUP BY ALL),
total AS (SELECT coalesce(source, '') AS host, count(*) AS total FROM documents GROUP BY 1),
bad AS (SELECT host, l FROM holding JOIN total USING (host) WHERE n >= 2 AND n > 0.1 * total),
marked AS (SELECT lines.*, bad.l IS NOT NULL AS b FROM lines LEFT JOIN bad ON bad.host = lines.host AND bad.l = trim(lines.l)),
kept AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT b), '') AS kept, count(*) FILTER (WHERE b) AS gone FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone > 0 THEN kept ELSE text END AS text, coalesce(gone, 0) AS n_dropped FROM documents LEFT JOIN kept USING (doc_id)
"""
