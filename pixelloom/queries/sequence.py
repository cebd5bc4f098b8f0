"""Timeline queries: events of a user are a track's samples, orders of a customer its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.operators import sequence as seq
from pixelloom.queries.registry import query, table
from pixelloom.sources.isobmff import chunk_places

#: Microseconds of a tick: half a day.
TICK = 43_200_000_000

_SAMPLES = f"""
samples AS (SELECT user_id, event_id, event_type, value, row_number() OVER w - 1 AS sample_idx,
            CAST(coalesce((epoch_us(lead(ts) OVER w) - epoch_us(ts)) // {TICK}, 0) AS BIGINT) AS delta
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

_RUNS = (
    _SAMPLES
    + """,
marked AS (SELECT *, CASE WHEN delta = lag(delta) OVER (PARTITION BY user_id ORDER BY sample_idx) THEN 0 ELSE 1 END AS new FROM samples),
runs AS (SELECT user_id, run, count(*) AS count, min(delta) AS delta
         FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY sample_idx) - 1 AS BIGINT) AS run FROM marked) GROUP BY ALL)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.floor((F.lead(us).over(by) - us) / F.lit(TICK))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.row_number().over(by) - 1).cast("long").alias("sample_idx"), F.coalesce(gap, F.lit(0)).cast("long").alias("delta"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.rle_encode(samples(spark, sf_dir), "user_id", "sample_idx", "delta")


@query("seq_decode_time", f"WITH {_SAMPLES} SELECT user_id, sample_idx, delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY sample_idx) - delta AS BIGINT) AS decode_time FROM samples")
def seq_decode_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.decode_times(samples(spark, sf_dir).select("user_id", "sample_idx", "delta"), "user_id", "sample_idx", "delta")


@query("seq_rle_encode", f"WITH {_RUNS} SELECT user_id, run, count, delta FROM runs")
def seq_rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir)


@query("seq_rle_decode", f"WITH {_SAMPLES} SELECT user_id, sample_idx, delta FROM samples")
def seq_rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.rle_decode(runs(spark, sf_dir), "user_id")


@query("seq_rle_lookup", f"WITH {_SAMPLES} SELECT w.user_id, w.sample_idx, coalesce(delta, 0) AS delta FROM (SELECT DISTINCT user_id, unnest([0, 5, 17, 1000000]) AS sample_idx FROM events) AS w LEFT JOIN samples USING (user_id, sample_idx)")
def seq_rle_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 5, 17, 1_000_000)])).alias("sample_idx"))
    return seq.rle_lookup(wanted, runs(spark, sf_dir), "user_id", "sample_idx", "delta")


@query("seq_total_duration", f"WITH {_RUNS} SELECT user_id, CAST(sum(count) AS BIGINT) AS n_samples, CAST(sum(count * delta) - max_by(delta, run) AS BIGINT) AS duration FROM runs GROUP BY user_id")
def seq_total_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.total_duration(runs(spark, sf_dir), "user_id", "delta", without_last=True)


@query("seq_sample_count", f"WITH {_RUNS} SELECT user_id, CAST(sum(count) AS BIGINT) AS n_samples, CAST(sum(count * delta) AS BIGINT) AS duration FROM runs GROUP BY user_id")
def seq_sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.total_duration(runs(spark, sf_dir), "user_id", "delta")


@query("seq_least_offset", "SELECT user_id, CAST(coalesce(min(CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END), 2147483647) AS BIGINT) AS least FROM events GROUP BY user_id")
def seq_least_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "error", F.floor("value")).alias("offset"))
    return seq.least_offset(rows, "user_id", "offset")


@query("seq_chunk_offsets", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 1000 + coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM lineitem")
def seq_chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    return seq.chunk_offsets(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "size", F.col("l_orderkey") * 1000).select("l_orderkey", "l_linenumber", "offset")


_CHUNKS = """
chunks AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS chunk, CAST(left(o_orderpriority, 1) AS BIGINT) AS per_chunk FROM orders)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(by).cast("long").alias("chunk"), F.substring("o_orderpriority", 1, 1).cast("long").alias("per_chunk"))


def entries(rows: DataFrame) -> DataFrame:
    """A sample-to-chunk table: one entry where the number of samples in a chunk changes."""
    r = seq.rle_encode(rows, "o_custkey", "chunk", "per_chunk")
    first = F.sum("count").over(W.partitionBy("o_custkey").orderBy("run").rowsBetween(W.unboundedPreceding, 0)) - F.col("count") + 1
    return r.select("o_custkey", first.alias("first_chunk"), "per_chunk")


@query("seq_chunk_asof", f"WITH {_CHUNKS} SELECT o_custkey, chunk, per_chunk FROM chunks")
def seq_chunk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return seq.as_of_entries(rows.select("o_custkey", "chunk"), entries(rows), "o_custkey", "chunk", "first_chunk", "per_chunk")


@query(
    "seq_samples_of_chunks",
    f"""WITH {_CHUNKS}, s AS (SELECT *, sum(per_chunk) OVER (PARTITION BY o_custkey ORDER BY chunk) - per_chunk AS start FROM chunks)
    SELECT o_custkey, chunk, CAST(i AS INTEGER) AS in_chunk, CAST(start + i AS BIGINT) AS sample_idx FROM s, LATERAL (SELECT unnest(range(per_chunk)) AS i)""",
)
def seq_samples_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.samples_of_chunks(chunks(spark, sf_dir), "o_custkey", "chunk", "per_chunk")


@query("seq_repeat", f"WITH {_SAMPLES}, n AS (SELECT user_id, count(*) AS n FROM samples GROUP BY user_id) SELECT user_id, sample_idx, CAST(play AS INTEGER) AS play, CAST(play * n + sample_idx AS BIGINT) AS out_idx FROM samples JOIN n USING (user_id), (SELECT unnest(range(3)) AS play)")
def seq_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.repeated(samples(spark, sf_dir).select("user_id", "sample_idx"), "user_id", "sample_idx", 3)


@query(
    "seq_edit_repetitions",
    f"""WITH {_RUNS}, d AS (SELECT user_id, CAST(sum(count * delta) AS BIGINT) AS media FROM runs GROUP BY user_id)
    SELECT user_id, CAST(CASE WHEN user_id % 4 <> 0 AND user_id % 3 = 0 AND media > 0 THEN media * 3 // media ELSE 0 END AS BIGINT) AS plays FROM d""",
)
def seq_edit_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seq.total_duration(runs(spark, sf_dir), "user_id", "delta")
    media = F.col("duration")
    plays = seq.edit_repetitions(media, media, F.lit(0), F.when(F.col("user_id") % 4 == 0, 2).otherwise(1), F.col("user_id") % 3 == 0, media * 3, F.lit(600), F.lit(600))
    return d.select("user_id", plays.alias("plays"))


@query("seq_rescale", f"WITH {_SAMPLES} SELECT user_id, sample_idx, CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE delta * 90000 // (user_id % 5 * 7) END AS BIGINT) AS scaled FROM samples")
def seq_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("user_id", "sample_idx", seq.rescale(F.col("delta"), F.col("user_id") % 5 * 7, F.lit(90000)).alias("scaled"))


@query("seq_movie_duration", f"WITH {_RUNS} SELECT CAST(max(d * 600 // (user_id + 1)) AS BIGINT) AS duration FROM (SELECT user_id, sum(count * delta) AS d FROM runs GROUP BY user_id)")
def seq_movie_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = seq.total_duration(runs(spark, sf_dir), "user_id", "delta").withColumn("scale", F.col("user_id") + 1)
    return seq.movie_duration(d, "duration", "scale", 600)


@query(
    "seq_constant_size",
    """SELECT l_orderkey, count(*) <= 1 AS constant FROM (SELECT l_orderkey, q, CASE WHEN q = lag(q) OVER w THEN 0 ELSE 1 END AS new
       FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) WHERE new = 1 GROUP BY l_orderkey""",
)
def seq_constant_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(by).alias("i"), F.col("l_quantity").cast("long").alias("size"))
    return seq.constant_size(seq.rle_encode(rows, "l_orderkey", "i", "size"), "l_orderkey")


@query("seq_sync_filter", f"WITH {_SAMPLES} SELECT user_id, sample_idx FROM samples WHERE event_type = 'error'")
def seq_sync_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("event_type = 'error'").select("user_id", "sample_idx")


@query("seq_all_sync", "SELECT user_id, count(*) = count(*) FILTER (WHERE value < 180) AS all_sync FROM events GROUP BY user_id")
def seq_all_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.all_sync(table(spark, sf_dir, "events"), "user_id", F.col("value") < 180)


@query("seq_paired_frames", f"WITH {_SAMPLES} SELECT a.user_id, a.sample_idx, a.delta AS colour, b.delta AS alpha FROM samples AS a LEFT JOIN samples AS b ON b.user_id = a.user_id + 1 AND b.sample_idx = a.sample_idx WHERE a.user_id % 2 = 0")
def seq_paired_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("user_id", "sample_idx", "delta")
    return seq.paired_frames(s.where("user_id % 2 = 0"), s.where("user_id % 2 = 1").withColumn("user_id", F.col("user_id") - 1), "user_id", "sample_idx", "delta")


@query(
    "seq_chunk_places",
    """WITH c AS (SELECT l_returnflag AS file, l_orderkey % 50 AS chunk, l_linenumber AS track, l_orderkey, CAST(l_quantity AS BIGINT) AS size, l_orderkey * 10000000000 + l_partkey * 10000 + l_suppkey AS ord FROM lineitem),
    b AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY file ORDER BY chunk, track ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT file, chunk, track, sum(size) AS bytes FROM c GROUP BY ALL))
    SELECT file, chunk, track, l_orderkey, ord, CAST(8 + start + sum(size) OVER (PARTITION BY file, chunk, track ORDER BY ord, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS offset FROM c JOIN b USING (file, chunk, track)""",
)
def seq_chunk_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), (F.col("l_orderkey") % 50).alias("chunk"), F.col("l_linenumber").alias("track"), "l_orderkey", F.col("l_quantity").cast("long").alias("size"), (F.col("l_orderkey") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ord"))
    return chunk_places(c, "file", "track", "chunk", ["ord", "size"], "size", 8).select("file", "chunk", "track", "l_orderkey", "ord", "offset")


@query(
    "seq_auxiliary_tables",
    """WITH s AS (SELECT o_custkey AS track, left(o_orderpriority, 1) AS kind, o_orderkey % 3 AS parameter, o_orderkey AS place, o_orderstatus = 'F' AS sizes FROM orders),
    n AS (SELECT track, count(*) FILTER (WHERE sizes) AS n, count(*) FILTER (WHERE NOT sizes) AS m FROM s GROUP BY track),
    f AS (SELECT track, kind, parameter, min(place) AS offsets FROM s WHERE NOT sizes GROUP BY ALL)
    SELECT track, kind, parameter, place AS sizes, offsets, CASE WHEN n <> m THEN 'tables not in pairs' WHEN offsets IS NULL THEN 'no offsets' END AS problem FROM s JOIN n USING (track) LEFT JOIN f USING (track, kind, parameter) WHERE sizes""",
)
def seq_auxiliary_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), F.substring("o_orderpriority", 1, 1).alias("kind"), (F.col("o_orderkey") % 3).alias("parameter"), F.col("o_orderkey").alias("place"), "o_orderstatus")
    return seq.auxiliary_tables(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), "track", "kind", "parameter", "place")


@query(
    "seq_auxiliary_offsets",
    """WITH s AS (SELECT l_orderkey AS track, l_linenumber % 2 AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, CAST(l_quantity AS BIGINT) AS size FROM lineitem)
    SELECT track, chunk, i, size, CAST(CASE WHEN track % 3 = 0 THEN 1000 + sum(size) OVER (PARTITION BY track ORDER BY i) - size WHEN track % 3 = 1 THEN 5000 * (chunk + 1) + sum(size) OVER (PARTITION BY track, chunk ORDER BY i) - size END AS BIGINT) AS offset FROM s""",
)
def seq_auxiliary_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third track's information lies in one place, others' by chunk, or nowhere."""
    by = W.partitionBy("l_orderkey").orderBy(F.col("l_linenumber") % 2, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), (F.col("l_linenumber") % 2).alias("chunk"), F.row_number().over(by).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("size"))
    tracks = rows.select("track").distinct()
    chunks = tracks.where("track % 3 = 0").selectExpr("track", "0 AS chunk", "1000L AS offset").union(tracks.where("track % 3 = 1").selectExpr("track", "explode(array(0, 1)) AS chunk", "0L").selectExpr("track", "chunk", "5000L * (chunk + 1)"))
    return seq.auxiliary_offsets(rows, chunks, "track", "chunk", "i", "size", "offset")
