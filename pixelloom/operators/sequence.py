"""Sample tables of image sequences: run-length coding, timelines, chunk offsets, edit lists.

Every function takes and returns DataFrames in long form. Windows are
partitioned by track (or chunk), so a table of many tracks needs one shuffle
on the track's key, and run-length coded tables stay coded until a caller
asks for samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an empty composition-offset table has as its least offset.
NO_OFFSET = 2**31 - 1
#: Where a rescaled duration stops growing.
MAX_DURATION = 2**63 - 1


def rle_encode(samples: DataFrame, track: str, index: str, value: str) -> DataFrame:
    """(track, run, count, value): maximal runs of equal values in the order of index; null equals null."""
    by = W.partitionBy(track).orderBy(index)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1), F.lit(True)).cast("int")
    runs = samples.withColumn("run", (F.sum(changed).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long"))
    return runs.groupBy(track, "run").agg(F.count("*").alias("count"), F.first(value).alias(value))


def rle_decode(runs: DataFrame, track: str, run: str = "run", count: str = "count", value: str = "delta") -> DataFrame:
    """(track, sample_idx, value): each run expanded where it lies, without collecting a track."""
    ends = F.sum(count).over(W.partitionBy(track).orderBy(run).rowsBetween(W.unboundedPreceding, 0))
    starts = runs.where(F.col(count) > 0).withColumn("__start", ends - F.col(count))
    return starts.select(track, F.explode(F.sequence(F.col("__start"), F.col("__start") + F.col(count) - 1)).alias("sample_idx"), value)


def rle_lookup(wanted: DataFrame, runs: DataFrame, track: str, index: str, value: str, default: int = 0) -> DataFrame:
    """wanted (track, index) with the value of the run that holds the sample; `default`, not null, outside of all runs. By one sorted stream for each track, as as_of_entries."""
    end = F.sum("count").over(W.partitionBy(track).orderBy("run").rowsBetween(W.unboundedPreceding, 0))
    spans = runs.where("count > 0").select(track, (end - F.col("count")).alias("__from"), F.struct(F.col(value).alias("v"), end.alias("to")).alias("__span"))
    found = as_of_entries(wanted, spans, track, index, "__from", "__span")
    return found.select(track, index, F.coalesce(F.when(F.col(index) < F.col("__span.to"), F.col("__span.v")), F.lit(default)).alias(value))


def decode_times(samples: DataFrame, track: str, index: str, duration: str) -> DataFrame:
    """samples with decode_time: the sum of all earlier durations, 0 for the first."""
    before = W.partitionBy(track).orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    return samples.withColumn("decode_time", F.coalesce(F.sum(duration).over(before), F.lit(0)).cast("long"))


def total_duration(runs: DataFrame, track: str, delta: str, without_last: bool = False) -> DataFrame:
    """(track, n_samples, duration): sums of a run-length table; without_last leaves the last sample's delta out."""
    last = F.max_by(delta, "run") if without_last else F.lit(0)
    return runs.groupBy(track).agg(F.sum("count").cast("long").alias("n_samples"), (F.sum(F.col("count") * F.col(delta)) - last).cast("long").alias("duration"))


def least_offset(offsets: DataFrame, track: str, offset: str) -> DataFrame:
    """(track, least): the least composition offset; NO_OFFSET if all are null."""
    return offsets.groupBy(track).agg(F.coalesce(F.min(offset), F.lit(NO_OFFSET)).cast("long").alias("least"))


def chunk_offsets(samples: DataFrame, chunk: str, order: list[str], size: str, start: Column | None = None) -> DataFrame:
    """samples with offset: the chunk's start plus the sizes of the samples before it in the chunk."""
    before = W.partitionBy(chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return samples.withColumn("offset", ((start if start is not None else F.lit(0)) + F.coalesce(F.sum(size).over(before), F.lit(0))).cast("long"))


def as_of_entries(chunks: DataFrame, entries: DataFrame, track: str, chunk: str, first: str, value: str) -> DataFrame:
    """(track, chunk, value): for each chunk the entry with the greatest first <= chunk; null before the first entry.

    Both sides are laid into one sorted stream for each track, so no range
    join is needed and nothing is compared pairwise.
    """
    both = chunks.select(track, F.col(chunk).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(entries.schema[value].dataType).alias(value)).unionByName(entries.select(track, F.col(first).alias("__at"), F.lit(0).alias("__kind"), value))
    seen = F.last(value, ignorenulls=True).over(W.partitionBy(track).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("__kind = 1").select(track, F.col("__at").alias(chunk), value)


def samples_of_chunks(chunks: DataFrame, track: str, chunk: str, per_chunk: str) -> DataFrame:
    """(track, chunk, in_chunk, sample_idx): samples in the order of chunks."""
    start = F.sum(per_chunk).over(W.partitionBy(track).orderBy(chunk).rowsBetween(W.unboundedPreceding, 0)) - F.col(per_chunk)
    rows = chunks.where(F.col(per_chunk) > 0).withColumn("__start", start)
    return rows.select(track, chunk, "__start", F.posexplode(F.sequence(F.lit(1), F.col(per_chunk).cast("int"))).alias("in_chunk", "__n")).select(track, chunk, "in_chunk", (F.col("__start") + F.col("in_chunk")).cast("long").alias("sample_idx"))


def repeated(samples: DataFrame, track: str, index: str, times: int) -> DataFrame:
    """(..., play, out_idx): an edit list that plays a track `times` times; infinite lists have to be bounded by the caller."""
    n = F.count("*").over(W.partitionBy(track))
    return samples.withColumn("__n", n).withColumn("play", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("out_idx", (F.col("play") * F.col("__n") + F.col(index)).cast("long")).drop("__n")


def edit_repetitions(segment_duration: Column, media_duration: Column, media_time: Column, entries: Column, repeat: Column, movie_duration: Column, movie_scale: Column, track_scale: Column) -> Column:
    """How often a track plays: more than once only for one entry from time 0 over the whole media, in one timescale, with the repeat flag."""
    whole = (movie_scale == track_scale) & (entries == 1) & (media_time == 0) & (segment_duration == media_duration) & repeat & (segment_duration > 0)
    return F.when(whole, F.floor(movie_duration / segment_duration)).otherwise(F.lit(0)).cast("long")


def rescale(value: Column, old: Column, new: Column) -> Column:
    """value in a timescale of new ticks a second instead of old: truncated, 0 for an old timescale of 0, saturated."""
    wide = value.cast("decimal(38,0)") * new.cast("decimal(10,0)")
    exact = F.floor(wide / F.when(old != 0, old).cast("decimal(10,0)"))
    return F.when(old == 0, F.lit(0)).otherwise(F.least(exact, F.lit(MAX_DURATION).cast("decimal(38,0)"))).cast("long")


def movie_duration(tracks: DataFrame, duration: str, scale: str, movie_scale: int) -> DataFrame:
    """One row: the longest track in the movie's timescale."""
    return tracks.agg(F.max(rescale(F.col(duration), F.col(scale), F.lit(movie_scale))).alias("duration"))


def constant_size(runs: DataFrame, track: str) -> DataFrame:
    """(track, constant): whether a run-length table has one entry at most."""
    return runs.groupBy(track).agg((F.count("*") <= 1).alias("constant"))


def all_sync(samples: DataFrame, track: str, sync: Column) -> DataFrame:
    """(track, all_sync): whether every sample is a sync sample."""
    return samples.groupBy(track).agg((F.count_if(sync) == F.count("*")).alias("all_sync"))


def paired_frames(colour: DataFrame, alpha: DataFrame, track: str, index: str, value: str) -> DataFrame:
    """(track, index, colour, alpha): frames of two tracks by position; alpha is null where its track is shorter."""
    right = alpha.select(track, index, F.col(value).alias("alpha"))
    return colour.select(track, index, F.col(value).alias("colour")).join(right, [track, index], "left")


def auxiliary_tables(sizes: DataFrame, offsets: DataFrame, track: str, kind: str, parameter: str, order: str) -> DataFrame:
    """(track, kind, parameter, sizes, offsets, problem): each table of auxiliary sizes with the first table of offsets of its type and parameter.

    sizes and offsets are the tables' places in `order`; problem is 'no
    offsets' for a table of sizes without one, 'tables not in pairs' where a
    track has other numbers of both, else null.
    """
    keys = [track, kind, parameter]
    first = offsets.groupBy(*keys).agg(F.min(order).alias("offsets"))
    n = sizes.groupBy(track).agg(F.count("*").alias("__n")).join(offsets.groupBy(track).agg(F.count("*").alias("__m")), track, "left")
    rows = sizes.select(*keys, F.col(order).alias("sizes")).join(first, keys, "left").join(n, track)
    problem = F.when(F.col("__n") != F.coalesce("__m", F.lit(0)), "tables not in pairs").when(F.col("offsets").isNull(), "no offsets")
    return rows.select(*keys, "sizes", "offsets", problem.alias("problem"))


def auxiliary_offsets(samples: DataFrame, chunks: DataFrame, track: str, chunk: str, index: str, size: str, offset: str) -> DataFrame:
    """samples (track, chunk, index, size) with offset: where each one's auxiliary information lies.

    chunks (track, chunk, offset) has one row for a track whose information
    lies in one place, then sizes add up over all of the track's samples, else
    one for each chunk, then over the chunk's; a sample whose chunk is missing
    there has none.
    """
    single = chunks.groupBy(track).agg(F.count("*").alias("__n"), F.min(offset).alias("__base"))
    rows = samples.join(single, track, "left").withColumn("__part", F.when(F.col("__n") == 1, F.lit(-1)).otherwise(F.col(chunk)))
    rows = rows.withColumn("__before", F.coalesce(F.sum(size).over(W.partitionBy(track, "__part").orderBy(index).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(chunks.select(track, chunk, F.col(offset).alias("__own")), [track, chunk], "left")
    base = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.col("__own"))
    return rows.withColumn("offset", (base + F.col("__before")).cast("long")).drop("__n", "__base", "__part", "__before", "__own")
