import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pixelloom.operators import metadata as meta
from pixelloom.operators import sequence as seq
from pixelloom.queries import ORACLES, QUERIES
from pixelloom.streaming.frames import timed

SF = "/root/testdata/sf0.001"


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted([plain(v) for v in r] for r in rel.fetchall())
    assert sorted([plain(r[c]) for c in cols] for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_run_lengths_round_trip(spark):
    rng = random.Random(1)
    rows = [(t, i, rng.choice([1, 1, 1, 2, None])) for t in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "track long, i long, delta long")
    runs = seq.rle_encode(df, "track", "i", "delta")
    assert sorted(map(str, seq.rle_decode(runs, "track").collect())) == sorted(str(r).replace("i=", "sample_idx=") for r in df.collect())
    assert seq.rle_encode(df.limit(0), "track", "i", "delta").count() == 0


def test_rescale_saturates_and_handles_zero(spark):
    f = lambda v, a, b: spark.range(1).select(seq.rescale(F.lit(v), F.lit(a), F.lit(b))).first()[0]
    assert f(100, 3, 7) == 233 and f(5, 0, 7) == 0 and f(2**62, 1, 1000) == 2**63 - 1


def test_walks_stop_in_cycles(spark):
    e = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 1), ("f", 5, 6), ("f", 8, 8), ("g", 1, 2), ("g", 2, 3), ("g", 2, 3), ("g", 4, None), ("f", 9, 5), ("f", 9, 1)], "file string, a long, b long")
    assert {(r.file, r.start): r.cyclic for r in meta.cyclic(e, "file", "a", "b").collect()} == {("f", 1): True, ("f", 2): True, ("f", 3): True, ("f", 5): False, ("f", 8): True, ("g", 1): False, ("g", 2): False, ("f", 9): True}
    assert {(r.file, r.start): r.node for r in meta.first_coded(e, "file", "a", "b", "b").collect()} == {("f", 1): None, ("f", 2): None, ("f", 3): None, ("f", 5): 6, ("f", 8): None, ("g", 1): 3, ("g", 2): 3, ("f", 9): None}
    marks = spark.createDataFrame([("g", 3), ("f", 6), ("g", 8)], "file string, n long")
    assert {(r.file, r.start) for r in meta.has_flag(e, marks, "file", "a", "b", "n").collect() if r.flag} == {("g", 1), ("g", 2), ("f", 5), ("f", 9)}
    assert meta.cyclic(e.limit(0), "file", "a", "b").count() == 0


def test_walks_through_many_diamonds_are_linear():
    n = 2000
    a, b = zip(*[(i, j) for k in range(0, 3 * n, 3) for i, j in ((k, k + 1), (k, k + 2), (k + 1, k + 3), (k + 2, k + 3))], strict=True)
    got = {x: (c, e, f) for x, c, e, f in meta._walk([*a, 3 * n], [*b, None], [0] * (len(a) + 1))}
    assert got[0] == (False, 3 * n, True) and not any(c for c, _, _ in got.values())


def test_stream_of_samples_keeps_time_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    schema = "track long, ord long, duration long"
    for n in range(3):
        spark.createDataFrame([(t, n * 10 + i, i + t) for t in (1, 2) for i in range(4)], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = timed(stream).writeStream.format("memory").queryName("timed_frames").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("timed_frames").collect()
    for t in (1, 2):
        own = sorted((r.sample_idx, r.decode_time) for r in got if r.track == t)
        step, want = [i + t for i in range(4)], [0]
        for k in range(11):
            want.append(want[-1] + step[k % 4])
        assert own == list(enumerate(want))


def test_first_property_by_the_rank_of_its_sql(spark, tmp_path):
    """Part keys of a million and more outrank line numbers; a link without a line number is never first."""
    rows = [(1, 1, 1_200_000), (1, 2, 6), (1, 3, 12), (1, 1, 3_000_007), (1, 4, 1), (2, None, 6), (2, 5, 12), (3, None, 6), (3, 1, None), (4, 2, 13), (4, 2, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").withColumn("l_suppkey", F.lit(1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["meta_first_property"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(ORACLES["meta_first_property"]).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert (1, "ispe", 6) in want and (2, "ispe", 12) in want
