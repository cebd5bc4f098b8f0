"""Operator 3: sharding by extendible hashing, in DataFrame operations only.

A key's hash has 60 bits. A bucket is all rows whose hashes share a prefix;
it starts as the empty prefix and splits on the next bit while it is larger
than the limit and holds more than one hash. The directory is found without
touching rows again and again: rows are summed by a prefix of STEP bits,
sizes of all shorter prefixes follow from those sums, and only rows of
prefixes that are still too large go into the next round of STEP bits. Each
round's table says, for a prefix, the depth of its bucket or that the next
round decides; rows find their shard by equi-joins with these tables.

A bucket of one hash that exceeds the limit can't be parted by hash bits (a
key that repeats, or one huge row). Its rows are dealt into numbered parts by
their running bytes instead, in order of a hash of the whole row: rows of up
to half the limit share a part while they start within half a limit, larger
ones are parts of their own. So every shard fits but those of one huge row.
Running bytes are taken in two levels, over parts of about a shard's size,
so no task sorts a hot key's rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelloom.llm.common import broadcast_if_small, written

#: Bits of a key's hash, and bits that a round adds.
BITS, STEP = 60, 6
#: Entries of a directory table that a broadcast may hold (about 40 bytes each); beyond, the join shuffles.
BROADCAST_ENTRIES = 500_000
#: Bytes that a shard may hold in production.
SHARD_BYTES = 64 << 20


def hash_bits(key: list[str]) -> Column:
    """The first 60 bits of the MD5 of the key's columns as text, null as the empty text."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> list[DataFrame]:
    """rows (h, bytes) -> for each round a written table (cell, depth, prefix, shard_bytes, shard_rows, parts).

    A cell is a prefix of STEP bits more than the round before; depth is null
    where the next round decides, parts is above 1 where rows of one hash are
    dealt out.
    """
    rounds: list[DataFrame] = []
    active = rows
    for bits in range(STEP, BITS + 1, STEP):
        down = f"shiftright(h, {BITS - bits})"
        cells = active.groupBy(F.expr(down).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = cells.withColumn("d", F.explode(F.sequence(F.lit(0 if bits == STEP else bits - STEP + 1), F.lit(bits)))).withColumn("p", F.expr(f"shiftright(cell, {bits} - d)"))
        sums = levels.groupBy("d", "p").agg(F.sum("b").alias("bb"), F.sum("n").alias("nn"), F.min("lo").alias("l"), F.max("hi").alias("g"))
        ends = sums.where(f"bb <= {limit} or l = g")
        found = levels.select("cell", "d", "p").join(ends, ["d", "p"]).groupBy("cell").agg(F.min(F.struct("d", "p", "bb", "nn")).alias("e"))
        table = written(
            cells.select("cell")
            .join(found, "cell", "left")
            .select("cell", F.col("e.d").alias("depth"), F.col("e.p").alias("prefix"), F.col("e.bb").alias("shard_bytes"), F.col("e.nn").alias("shard_rows"))
            .withColumn("parts", F.when((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1), F.least(F.col("shard_rows"), F.ceil(F.col("shard_bytes") * 2 / F.lit(limit)))).otherwise(F.lit(1)).cast("long"))
        )
        rounds.append(table)
        open_cells = table.where("depth is null").select("cell")
        if open_cells.isEmpty():
            break
        active = active.withColumn("cell", F.expr(down)).join(broadcast_if_small(open_cells, BROADCAST_ENTRIES), "cell", "left_semi").drop("cell")
    return rounds


def shards(docs: DataFrame, key: list[str] | None = None, text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """All columns of docs, with shard (depth-prefix, and .part where one key was dealt out), shard_depth and n_bytes of the row.

    n_bytes is the UTF-8 length of text_col, 0 for null. A null key column
    counts as the empty text. Rows of one key share a shard unless they exceed
    the limit together. An empty table gives no rows; columns of these names
    are replaced, and none may start with two underscores.
    """
    key = key or ["doc_id"]
    rest = docs.drop("shard", "shard_depth", "n_bytes")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rounds = directory(written(docs.select(hash_bits(key).alias("h"), size.alias("bytes"))), limit)
    out = rest.withColumn("__h", hash_bits(key))
    found = [F.lit(None)]
    for i, table in enumerate(rounds):
        few = broadcast_if_small(table.where("depth is not null").select(F.col("cell").alias("__cell"), F.struct("depth", "prefix", "parts").alias(f"__e{i}")), BROADCAST_ENTRIES)
        out = out.withColumn("__cell", F.expr(f"shiftright(__h, {BITS - STEP * (i + 1)})")).join(few, "__cell", "left").drop("__cell")
        found.append(F.col(f"__e{i}"))
    name = F.concat_ws("-", F.col("__e.depth"), F.col("__e.prefix"))
    out = out.withColumn("__e", F.coalesce(*found[1:])).withColumn("shard", name).withColumn("shard_depth", F.col("__e.depth")).withColumn("n_bytes", size)
    hot = any(not t.where("parts > 1").isEmpty() for t in rounds)
    single = out.where("coalesce(__e.parts, 1) <= 1") if hot else out
    single = single.select(*rest.columns, "shard", "shard_depth", "n_bytes")
    return single.unionByName(_dealt(out.where("__e.parts > 1"), limit).select(*single.columns)) if hot else single


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """rows of hot shards (with __e.parts, n_bytes, shard), shard with .part behind it."""
    own = [f.name for f in rows.schema.fields if not f.name.startswith("__") and "map<" not in f.dataType.simpleString()]
    rows = rows.withColumn("__order", F.xxhash64(*[F.col(f"`{c}`") for c in own])).withColumn("__large", F.col("n_bytes") > limit // 2)
    # Large rows count as one unit each, others by their bytes.
    rows = rows.withColumn("__unit", F.when(F.col("__large"), F.lit(1).cast("long")).otherwise(F.col("n_bytes"))).withColumn("__sub", F.pmod("__order", "__e.parts"))
    sums = rows.groupBy("shard", "__large", "__sub").agg(F.sum("__unit").alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(W.partitionBy("shard", "__large").orderBy("__sub")) - F.col("__sum")).drop("__sum")
    inside = W.partitionBy("shard", "__large", "__sub").orderBy("__order", "n_bytes").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum("__unit").over(inside)).join(written(before), ["shard", "__large", "__sub"])
    start = F.col("__before") + F.col("__upto") - F.col("__unit")
    part = F.when(F.col("__large"), F.concat(F.lit("r"), start)).otherwise(F.floor(start / F.lit(max(1, limit // 2))).cast("string"))
    return rows.withColumn("shard", F.concat_ws(".", "shard", part))


def oracle(limit: int) -> str:
    """The same shards, for keys that don't repeat, by sizes of all prefixes up to 24 bits."""
    return f"""
WITH k AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
l AS (SELECT k.*, d, h >> (60 - d) AS p FROM k, (SELECT unnest(range(0, 25)) AS d)),
s AS (SELECT doc_id, d, p, n_bytes, sum(n_bytes) OVER w AS total, min(h) OVER w = max(h) OVER w AS single FROM l WINDOW w AS (PARTITION BY d, p)),
e AS (SELECT doc_id, n_bytes, min(d) AS d, min_by(p, d) AS p FROM s WHERE total <= {limit} OR single GROUP BY doc_id, n_bytes)
SELECT doc_id, d || '-' || p AS shard, CAST(d AS INTEGER) AS shard_depth, CAST(n_bytes AS BIGINT) AS n_bytes FROM e
"""
