import json

from pyspark.sql import functions as F

from gristmill.functions.hashing import larger_root, peer_index, tuple_hash
from gristmill.operators import cart, scaleout
from gristmill.operators.aggregate import AggSpec, group_aggregate, raw_aggregate
from gristmill.plans import chunked
from gristmill.sources import generator, metrics
from gristmill.streaming import incremental


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_raw_path_exchanges_below_the_partial_aggregate(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    raw, pre = plan(raw_aggregate(df, AggSpec(["k"]))), plan(group_aggregate(df, AggSpec(["k"])))
    assert raw.index("partial_count") < raw.index("Exchange")
    assert pre.index("Exchange") < pre.index("partial_count")


def test_tasks_share_few_partitions_of_the_raw_path(spark):
    df, spec = spark.range(20_000).select((F.col("id") % 8000).alias("k")), AggSpec(["k"])
    want = sorted(group_aggregate(df, spec).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions, tasks in ((None, 4), (1, 4), (3, 4), (4, 4), (9, 9)):
            d = raw_aggregate(df, spec, partitions)
            groups = [r[1] for r in d.groupBy(F.spark_partition_id()).count().collect()]
            assert len(groups) == tasks and sum(groups) == 8000 and max(groups) < 2 * 8000 / tasks
            assert sorted(d.collect()) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_generated_keys_and_decisions(spark):
    low, high = generator.generated(spark, 400, 10, 3), generator.generated(spark, 400, 1_000_000, 3)
    assert low.count() == 10_000 and low.select("c0").distinct().count() == 10 and len(low.columns) == 16
    assert not cart.miss_ratio(low, ["c0"]).select(cart.useless(F.col("observed"), F.col("misses"), gate=1000)).first()[0]
    assert cart.miss_ratio(high, ["c0"]).select(cart.useless(F.col("observed"), F.col("misses"), gate=1000)).first()[0]
    spec = AggSpec(["c0"])
    assert sorted(cart.adaptive_aggregate(high, spec, gate=1000).collect()) == sorted(group_aggregate(high, spec).collect())


def test_tuple_hash_wraps(spark):
    rows = [(-1, 5), (2**62, -7), (0, 0), (123456789, 987654321)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long").select(tuple_hash(F.col("a"), F.col("b"))).collect()]
    m = 2**64
    for (a, b), h in zip(rows, got):
        acc = b % m
        want = acc ^ ((a + 0x517CC1B727220A95 + (acc << 6) + (acc >> 2)) % m)
        assert h % m == want


def test_chunked_result_is_the_same_for_every_policy(spark):
    df = generator.generated(spark, 80, 50, 1).withColumn("p", F.pmod("c1", F.lit(1000)))
    want = sorted(group_aggregate(df, AggSpec(["c0"])).collect())
    read = chunked.by_column(df, "p", 1000)
    for policy in (chunked.after_chunks(99, 1), chunked.after_chunks(7, 4), chunked.static(0, 3), chunked.regression(1, 4, 2)):
        run = chunked.Run()
        assert sorted(chunked.adaptive_aggregate(read, 1000, AggSpec(["c0"]), policy, run=run, checkpoints=True).collect()) == want
        assert run.ranges[0][0] == 0 and run.ranges[-1][1] == 1000
        assert all(a[1] == b[0] for a, b in zip(run.ranges, run.ranges[1:]))


def test_no_chunk_is_empty_and_each_scans_its_part(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.pmod("id", F.lit(700)).alias("g"))
    df.coalesce(1).write.option("parquet.block.size", 8192).parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    run = chunked.Run()
    read = chunked.by_column(stored, "k", 20_000)
    got = chunked.adaptive_aggregate(read, 20_000, AggSpec(["g"]), chunked.after_chunks(7, 4), run=run, hash_=F.col("g") * 6_000_000)
    assert sorted(map(tuple, got.collect())) == [(g, len(range(g, 20_000, 700))) for g in range(700)]
    assert len(run.ranges) == 11 and run.scaled_at == 7
    held = spark.read.parquet(run.states).groupBy("chunk").agg(F.sum("cnt").alias("n"), F.max("owner").alias("o")).orderBy("chunk").collect()
    assert [r.n for r in held] == [2000] * 7 + [1500] * 4
    assert [r.o for r in held] == [0] * 7 + [3] * 4
    scan = plan(read(2000, 4000))
    assert "PushedFilters: [IsNotNull(k), LessThan(k,4000), GreaterThanOrEqual(k,2000)]" in scan
    # by files: each chunk lists its own
    df.repartition(12).write.parquet(str(tmp_path / "f"))
    reader, files = chunked.by_files(spark, str(tmp_path / "f"))
    assert files == 12 and sorted(map(tuple, chunked.adaptive_aggregate(reader, files, AggSpec(["g"]), chunked.static(0, 3)).collect())) == sorted(map(tuple, got.collect()))
    assert len(reader(0, 2).inputFiles()) == 2


def test_regression_scales_out_by_its_checkpoints():
    run = chunked.Run(history=[chunked.Checkpoint(100 * i, 1000 * i) for i in range(1, 9)], total=1000)
    assert abs(chunked.fitted_groups(run.history, 1000, 0.8, as_percent=True) - 10_000) < 1e-6
    assert chunked.fitted_groups(run.history, 1000, 0.8) < 9_000
    assert chunked.fitted_groups(run.history[:1], 1000, 0.1) == 1000
    ms = [chunked.cost_ms(chunked.fitted_groups(run.history, 1000, 0.8), w, 2) for w in (1, 2, 3)]
    assert chunked.regression(ms[1] + 1, 8, 2)(run, 8, 0, 1) == 2 and chunked.regression(ms[0] + 1, 8, 2)(run, 8, 0, 1) == 1
    assert chunked.regression(1, 8, 2)(run, 8, 500, 1) == 8


def test_chunks_leave_no_row_out(spark):
    """NULL positions and positions outside [0, total) are counted, once."""
    df = spark.createDataFrame([(i % 3, p) for i, p in enumerate([None, None, -7, -1, 0, 5, 99, 100, 101, 10**12, None])], "c0 int, p long")
    want = sorted(group_aggregate(df, AggSpec(["c0"])).collect())
    for total in (1, 100):
        for policy in (chunked.after_chunks(99, 1), chunked.after_chunks(7, 4)):
            assert sorted(chunked.adaptive_aggregate(chunked.by_column(df, "p", total), total, AggSpec(["c0"]), policy).collect()) == want


def test_cart_samples_all_partitions(spark):
    """Sorted input: its first rows repeat one key, the table as a whole hardly any."""
    df = spark.range(0, 40_000, 1, 8).select(F.greatest("id", F.lit(6000)).alias("k"))
    assert cart.decide(cart.sampled(df, 6000), AggSpec(["k"]), gate=5000)
    assert not cart.decide(df.limit(6000), AggSpec(["k"]), gate=5000)


def test_schema_and_random_values(spark):
    from pyspark.sql import types as T

    from gristmill.sources.tables import require, schema_text

    kind = T._parse_datatype_string("a array<int>, s struct<x: double, y: string>, n bigint")
    d = spark.range(50).select(*[generator.random_value(f.dataType, F.col("id"), i).alias(f.name) for i, f in enumerate(kind)])
    assert schema_text(d) == "array<int>|struct<x:double,y:string>|bigint"
    require(d, "n bigint")
    try:
        require(d, "n int, z string")
        raise AssertionError
    except ValueError as e:
        assert "n: bigint, wanted int" in str(e) and "z: missing" in str(e)
    rows = d.collect()
    assert len({r.n for r in rows}) == 50 and all(0 <= r.s.x < 1 and len(r.s.y) == 1 and len(r.a) == 3 for r in rows)


def test_fit_without_variance(spark):
    r = scaleout.fit(spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double"), F.col("x"), F.col("y")).first()
    assert (r.a, r.b) == (3.0, 0.0)


def test_small_functions(spark):
    r = spark.range(1).select(larger_root(F.lit(1.0), F.lit(-3.0), F.lit(2.0)), larger_root(F.lit(1.0), F.lit(0.0), F.lit(1.0)), peer_index(F.lit(3), F.lit(1)), peer_index(F.lit(0), F.lit(1))).first()
    assert tuple(r) == (2.0, -1.0, 2, 0)


def test_cluster_config_and_log(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"coordinator": {"ip": "a", "port": "1"}, "workers": [{"ip": "b", "port": "2"}, {"ip": "c", "port": "3"}]}))
    got = sorted(map(tuple, generator.cluster_config(spark, str(tmp_path / "c.json")).collect()), key=str)
    assert got == [("coordinator", None, "a", "1"), ("worker", 0, "b", "2"), ("worker", 1, "c", "3")]
    row = metrics.log_row(spark, name="x", ms=3, nodes=[1, 2])
    metrics.write_log(row, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), header=True).first().nodes == "1,2"
    assert "ms:" in metrics.aligned(row)


def test_streaming_states(spark, tmp_path):
    df = generator.generated(spark, 20, 5, 1).select("c0")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    incremental.run_available(spark, str(tmp_path / "in"), df.schema, AggSpec(["c0"]), str(tmp_path / "states"), str(tmp_path / "cp"))
    got = sorted(map(tuple, incremental.current(spark, AggSpec(["c0"]), str(tmp_path / "states")).select("c0", "cnt").collect()))
    assert got == sorted(map(tuple, group_aggregate(df, AggSpec(["c0"])).collect()))
