"""The library's own queries with their SQL twins: ``QUERIES[name](spark, data_dir)`` and ``ORACLES[name]``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import sketch
from gristmill.functions.hashing import array_hash, feeder, finalised, is_power_of_two, larger_root, mix32, next_power_of_two, owner, parity, peer_index, tuple_hash
from gristmill.operators import cart, scaleout, shuffle
from gristmill.operators.aggregate import Agg, AggSpec, audit, group_aggregate, merge, partial, raw_aggregate
from gristmill.plans import chunked
from gristmill.sources import generator, metrics
from gristmill.sources.tables import partly_cached, require, schema_text, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("group_count", "SELECT l_orderkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_orderkey")
def group_count(spark: SparkSession, data_dir: str) -> DataFrame:
    return group_aggregate(table(spark, data_dir, "lineitem"), AggSpec(["l_orderkey"]))


# -- aggregation

_COUNT_SQL = "SELECT l_orderkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_orderkey"


def _mix_sql(key: str) -> str:
    h = f"(({key}) * 2654435761) % 4294967296"
    for shift in (16, 15):
        h = f"(xor({h}, ({h}) >> {shift}) * 1597334677) % 4294967296"
    return f"xor({h}, ({h}) >> 16)"


_HASHED = f"(SELECT l_orderkey, {_mix_sql('l_orderkey')} AS h FROM lineitem)"


def _lines(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "lineitem")


@query("group_count_multikey", "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt FROM lineitem GROUP BY ALL")
def group_count_multikey(spark, data_dir):
    return group_aggregate(_lines(spark, data_dir), AggSpec(["l_returnflag", "l_linestatus"]))


@query(
    "group_multi_agg",
    """SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, MIN(l_quantity) AS least, MAX(l_quantity) AS most,
       BIT_OR(l_linenumber) AS lines, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag""",
)
def group_multi_agg(spark, data_dir):
    aggs = [Agg("total", "sum", F.col("l_quantity").cast("bigint")), Agg("least", "min", "l_quantity"), Agg("most", "max", "l_quantity"), Agg("lines", "bit_or", "l_linenumber"), Agg("cnt")]
    return group_aggregate(_lines(spark, data_dir), AggSpec(["l_returnflag"], aggs))


@query("partial_then_merge", _COUNT_SQL)
def partial_then_merge(spark, data_dir):
    spec = AggSpec(["l_orderkey"])
    pages = _lines(spark, data_dir).withColumn("chunk", F.pmod(F.col("l_partkey"), F.lit(8)))
    return merge(partial(pages, spec, "chunk"), spec)


@query("partial_sizes", "SELECT chunk, COUNT(*) AS n_states FROM (SELECT DISTINCT l_partkey % 8 AS chunk, l_orderkey FROM lineitem) GROUP BY chunk")
def partial_sizes(spark, data_dir):
    pages = _lines(spark, data_dir).withColumn("chunk", F.pmod(F.col("l_partkey"), F.lit(8)))
    return partial(pages, AggSpec(["l_orderkey"]), "chunk").groupBy("chunk").agg(F.count(F.lit(1)).alias("n_states"))


@query("raw_partition_agg", _COUNT_SQL)
def raw_partition_agg(spark, data_dir):
    return raw_aggregate(_lines(spark, data_dir), AggSpec(["l_orderkey"]))


@query("cart_aggregate", _COUNT_SQL)
def cart_aggregate(spark, data_dir):
    return cart.adaptive_aggregate(_lines(spark, data_dir), AggSpec(["l_orderkey"]))


@query(
    "cart_decision",
    """SELECT COUNT(*) AS observed, COUNT(DISTINCT l_orderkey) AS misses, COUNT(*) > 1000 AND COUNT(DISTINCT l_orderkey) / COUNT(*) > 0.2 AS useless
       FROM lineitem WHERE l_orderkey < 5000""",
)
def cart_decision(spark, data_dir):
    seen = cart.miss_ratio(_lines(spark, data_dir).filter("l_orderkey < 5000"), ["l_orderkey"])
    return seen.withColumn("useless", cart.useless(F.col("observed"), F.col("misses"), cart.ADAPTIVE_THRESHOLD, 1000))


@query("cart_raw_taken", "SELECT o_orderkey, COUNT(*) AS cnt FROM orders GROUP BY o_orderkey")
def cart_raw_taken(spark, data_dir):
    """Every key is unique, so the sample finds pre-aggregation useless and raw rows are exchanged; the gate fits the smallest table."""
    o, spec = table(spark, data_dir, "orders"), AggSpec(["o_orderkey"])
    if not cart.decide(cart.sampled(o.select("o_orderkey"), 1400), spec, gate=1000):
        raise AssertionError("unique keys must switch pre-aggregation off")
    return cart.adaptive_aggregate(o, spec, gate=1000)


@query("radix_off", _COUNT_SQL)
def radix_off(spark, data_dir):
    """All raw rows are of one partition, which tasks share out by key: the reference point of the radix partitions."""
    return raw_aggregate(_lines(spark, data_dir), AggSpec(["l_orderkey"]), partitions=1)


@query("own_aggregate", "SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT)) AS BIGINT) AS squares, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag")
def own_aggregate(spark, data_dir):
    """A user's own update and merge, through partial states of eight chunks."""
    spec = AggSpec(["l_returnflag"], [Agg("squares", (lambda c: F.sum(c * c), F.sum), F.col("l_quantity").cast("bigint")), Agg("cnt")])
    pages = _lines(spark, data_dir).withColumn("chunk", F.pmod(F.col("l_partkey"), F.lit(8)))
    return merge(partial(pages, spec, "chunk"), spec)


@query("bounded_states", "SELECT l_orderkey // 1000 AS pages, COUNT(*) AS n_states FROM (SELECT DISTINCT l_orderkey // 1000 AS l_orderkey_, l_orderkey, l_suppkey FROM lineitem) GROUP BY 1")
def bounded_states(spark, data_dir):
    """States evicted after each range of 1,000 positions of the table's order: as many of a key as there are ranges that hold it."""
    pages = _lines(spark, data_dir).withColumn("pages", F.expr("l_orderkey div 1000"))
    return partial(pages, AggSpec(["l_orderkey", "l_suppkey"]), "pages").groupBy("pages").agg(F.count(F.lit(1)).alias("n_states"))


@query("audit_invariants", "SELECT COUNT(DISTINCT l_orderkey) AS n_groups, COUNT(*) AS n_rows FROM lineitem")
def audit_invariants(spark, data_dir):
    return audit(group_aggregate(_lines(spark, data_dir), AggSpec(["l_orderkey"])))


@query("project_tuple", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def project_tuple(spark, data_dir):
    return _lines(spark, data_dir).select("l_orderkey", "l_linenumber", "l_returnflag")


# -- partitions, ownership, shuffles


@query("radix_partition_profile", f"SELECT CAST(h >> 26 AS INTEGER) AS part, COUNT(*) AS n_rows, COUNT(DISTINCT l_orderkey) AS n_keys FROM {_HASHED} GROUP BY 1")
def radix_partition_profile(spark, data_dir):
    return shuffle.profile(_lines(spark, data_dir), mix32(F.col("l_orderkey")), 64, "l_orderkey", 32)


@query("partition_group_profile", f"SELECT CAST(h >> 28 AS INTEGER) AS grp, COUNT(*) AS n_rows FROM {_HASHED} GROUP BY 1")
def partition_group_profile(spark, data_dir):
    d = shuffle.ownership(_lines(spark, data_dir), mix32(F.col("l_orderkey")), 64, 4, 4, 32)
    return d.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows"))


@query("node_ownership", "SELECT CAST(g AS INTEGER) AS grp, n AS nodes, CAST((g * n) >> 4 AS INTEGER) AS node FROM range(16) t(g), (SELECT UNNEST([1, 2, 3, 4, 6, 16]) AS n)")
def node_ownership(spark, data_dir):
    g = spark.range(16).select(F.col("id").cast("int").alias("grp"))
    parts = [g.select("grp", F.lit(n).alias("nodes"), owner(F.col("grp"), 16, n).alias("node")) for n in (1, 2, 3, 4, 6, 16)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("node_group_counts", f"SELECT CAST(((h >> 28) * 4) >> 4 AS INTEGER) AS node, COUNT(DISTINCT l_orderkey) AS n_groups FROM {_HASHED} GROUP BY 1")
def node_group_counts(spark, data_dir):
    d = group_aggregate(_lines(spark, data_dir), AggSpec(["l_orderkey"]))
    return shuffle.ownership(d, mix32(F.col("l_orderkey")), 64, 4, 4, 32).groupBy("node").agg(F.count(F.lit(1)).alias("n_groups"))


@query("shuffle_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def shuffle_rows(spark, data_dir):
    return shuffle.redistribute(_lines(spark, data_dir), ["l_orderkey"], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])


@query("shuffle_by_two_keys", "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem")
def shuffle_by_two_keys(spark, data_dir):
    return shuffle.redistribute(_lines(spark, data_dir), ["l_orderkey", "l_suppkey"], columns=["l_orderkey", "l_suppkey", "l_quantity"])


@query(
    "thread_mapping",
    """SELECT CAST(q AS INTEGER) AS q, CAST(CASE WHEN q < 9 THEN q // 3 ELSE (q - 9) // 2 + 3 END AS INTEGER) AS feeder, CAST(CASE WHEN q < 9 THEN 3 ELSE 2 END AS INTEGER) AS grp_size,
       CAST(CASE WHEN q < 9 THEN q % 3 ELSE (q - 9) % 2 END AS INTEGER) AS local_id FROM range(11) t(q)""",
)
def thread_mapping(spark, data_dir):
    q = spark.range(11).select(F.col("id").cast("int").alias("q"))
    at, size, local = feeder(F.col("q"), 11, 4)
    return q.select("q", at.alias("feeder"), size.alias("grp_size"), local.alias("local_id"))


# -- sketches and hashes

_REG = f"""SELECT CAST(h & 255 AS INTEGER) AS reg, MAX(CAST(CASE WHEN h >> 8 = 0 THEN 24 ELSE bit_count(((h >> 8) & -(h >> 8)) - 1) + 1 END AS INTEGER)) AS rank
  FROM {_HASHED} GROUP BY 1"""
_EST = f"""SELECT CAST(floor(CASE WHEN z > 0 AND raw < 640 THEN 256.0 * ln(256.0 / z) ELSE raw END) AS BIGINT) AS estimate FROM (
  SELECT 256 - COUNT(*) AS z, CAST(0.7213 AS DOUBLE) / (1 + CAST(1.079 AS DOUBLE) / 256) * 65536 / (SUM(pow(CAST(2 AS DOUBLE), -rank)) + (256 - COUNT(*))) AS raw FROM ({_REG}))"""


@query("hll_registers", _REG)
def hll_registers(spark, data_dir):
    return sketch.registers(_lines(spark, data_dir), mix32(F.col("l_orderkey")), bits=32)


@query("hll_estimate", _EST)
def hll_estimate(spark, data_dir):
    return sketch.estimate(hll_registers(spark, data_dir))


@query("hll_merge", _REG)
def hll_merge(spark, data_dir):
    d = shuffle.ownership(_lines(spark, data_dir), mix32(F.col("l_orderkey")), 64, 4, 4, 32)
    by_group = sketch.registers(d, mix32(F.col("l_orderkey")), "node", "grp", bits=32)
    return sketch.merge_registers(sketch.merge_registers(by_group, "node"))


_GROUP_REG = f"""SELECT CAST(h >> 28 AS INTEGER) AS grp, CAST(h & 255 AS INTEGER) AS reg,
  MAX(CAST(CASE WHEN r = 0 THEN 24 ELSE bit_count((r & -r) - 1) + 1 END AS INTEGER)) AS rank FROM (SELECT h, (h & 268435455) >> 8 AS r FROM {_HASHED}) GROUP BY ALL"""


def _owned(spark: SparkSession, data_dir: str) -> DataFrame:
    return shuffle.ownership(_lines(spark, data_dir), mix32(F.col("l_orderkey")), 64, 4, 4, 32)


@query("hll_grouped", _GROUP_REG)
def hll_grouped(spark, data_dir):
    """A sketch for each of 16 partition groups, without the 4 top bits that are the same within a group."""
    return sketch.registers(_owned(spark, data_dir), mix32(F.col("l_orderkey")), "grp", bits=32, group_bits=4)


@query(
    "node_estimates",
    f"""SELECT node, CAST(floor(CASE WHEN z > 0 AND raw < 640 THEN 256.0 * ln(256.0 / z) ELSE raw END) AS BIGINT) AS estimate FROM (
      SELECT node, 256 - COUNT(*) AS z, CAST(0.7213 AS DOUBLE) / (1 + CAST(1.079 AS DOUBLE) / 256) * 65536 / (SUM(pow(CAST(2 AS DOUBLE), -rank)) + (256 - COUNT(*))) AS raw
      FROM (SELECT CAST((grp * 4) >> 4 AS INTEGER) AS node, reg, MAX(rank) AS rank FROM ({_GROUP_REG}) GROUP BY ALL) GROUP BY node)""",
)
def node_estimates(spark, data_dir):
    """Each node merges the group sketches that it owns and estimates those groups alone."""
    by_group = hll_grouped(spark, data_dir).withColumn("node", owner(F.col("grp"), 16, 4))
    return sketch.estimate(sketch.merge_registers(by_group, "node"), "node")


@query("states_with_sketch", f"SELECT CAST(h >> 28 AS INTEGER) AS grp, COUNT(DISTINCT l_orderkey) AS n_states, COUNT(*) AS n_rows, COUNT(DISTINCT h & 255) AS n_registers FROM {_HASHED} GROUP BY 1")
def states_with_sketch(spark, data_dir):
    """One pass over the states gives partitions and sketch: the sketch is of keys, however often a key was inserted."""
    states = shuffle.ownership(partial(_lines(spark, data_dir), AggSpec(["l_orderkey"])), mix32(F.col("l_orderkey")), 64, 4, 4, 32)
    return states.groupBy("grp").agg(F.count(F.lit(1)).alias("n_states"), F.sum("cnt").alias("n_rows"), F.countDistinct(sketch.register(mix32(F.col("l_orderkey")))).alias("n_registers"))


@query("ht_size", f"SELECT estimate, CAST(pow(2, ceil(log2(2 * estimate))) AS BIGINT) AS slots FROM ({_EST})")
def ht_size(spark, data_dir):
    return hll_estimate(spark, data_dir).withColumn("slots", sketch.table_slots(F.col("estimate")))


@query("native_hll", "SELECT COUNT(DISTINCT l_orderkey) AS n_groups, TRUE AS close FROM lineitem")
def native_hll(spark, data_dir):
    """Spark's own sketches of four nodes, united: whether their estimate is within three standard errors of the number of keys."""
    d = _owned(spark, data_dir)
    seen = sketch.native_estimate(sketch.native_union(sketch.native_sketch(d, "l_orderkey", "node")))
    exact = d.agg(F.countDistinct("l_orderkey").alias("n_groups"))
    return exact.crossJoin(seen).select("n_groups", (F.abs(F.col("estimate") - F.col("n_groups")) <= F.col("n_groups") * (3 * 1.04 / 16)).alias("close"))


@query(
    "tuple_hash",
    """SELECT DISTINCT l_partkey, l_orderkey, CAST(CASE WHEN u >= 9223372036854775808 THEN CAST(u AS HUGEINT) - 18446744073709551616 ELSE u END AS BIGINT) AS h FROM (
       SELECT l_partkey, l_orderkey, xor(CAST(l_orderkey AS UBIGINT), CAST((CAST(l_partkey AS HUGEINT) + 5871781006564002453 + CAST(l_orderkey AS HUGEINT) * 64 + l_orderkey // 4) % 18446744073709551616 AS UBIGINT)) AS u FROM lineitem)""",
)
def tuple_hash_query(spark, data_dir):
    d = _lines(spark, data_dir).select("l_partkey", "l_orderkey").distinct()
    return d.withColumn("h", tuple_hash(F.col("l_partkey"), F.col("l_orderkey")))


@query("power_of_two", "SELECT CAST(i AS BIGINT) AS x, CAST(pow(2, ceil(log2(i))) AS BIGINT) AS up, bit_count(i) = 1 AS is_power FROM range(1, 1001) t(i)")
def power_of_two(spark, data_dir):
    return spark.range(1, 1001).select(F.col("id").alias("x"), next_power_of_two(F.col("id")).alias("up"), is_power_of_two(F.col("id")).alias("is_power"))


def _wrap_sql(x: str) -> str:
    return f"CAST(({x}) % 18446744073709551616 AS UBIGINT)"


def _signed_sql(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN CAST({x} AS HUGEINT) - 18446744073709551616 ELSE {x} END AS BIGINT)"


_M = 0xC6A4A7935BD1E995


def _finalised_sql(table: str, x: str) -> str:
    """(x, h): the finaliser of the unsigned column x, a step a subquery."""
    mul = lambda v: _wrap_sql(f"CAST({v} AS UHUGEINT) * {_M}")
    t = f"SELECT {x} AS x, {mul(f'CAST({x} AS UBIGINT)')} AS k FROM {table}"
    t = f"SELECT x, {mul('xor(k, k >> 47)')} AS k FROM ({t})"
    t = f"SELECT x, {mul(f'xor(k, CAST({0x8445D61A4E774912 ^ (8 * _M % (1 << 64))} AS UBIGINT))')} AS k FROM ({t})"
    t = f"SELECT x, {mul('xor(k, k >> 47)')} AS k FROM ({t})"
    return f"SELECT x, xor(k, k >> 47) AS h FROM ({t})"


@query("integer_finaliser", f"SELECT x AS l_partkey, {_signed_sql('h')} AS h FROM ({_finalised_sql('(SELECT DISTINCT l_partkey FROM lineitem)', 'l_partkey')})")
def integer_finaliser(spark, data_dir):
    return _lines(spark, data_dir).select("l_partkey").distinct().withColumn("h", finalised(F.col("l_partkey")))


@query(
    "array_hash",
    f"""WITH a AS ({_finalised_sql("(SELECT DISTINCT l_partkey FROM lineitem)", "l_partkey")}), b AS ({_finalised_sql("(SELECT DISTINCT l_linenumber FROM lineitem)", "l_linenumber")}),
        s AS (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem),
        o AS (SELECT l_partkey, l_linenumber, {_wrap_sql("CAST(a.h AS UHUGEINT) + 2654435769")} AS u, b.h AS h FROM s JOIN a ON a.x = l_partkey JOIN b ON b.x = l_linenumber),
        t AS (SELECT l_partkey, l_linenumber, xor(u, {_wrap_sql("CAST(h AS UHUGEINT) + 2654435769 + CAST(u AS UHUGEINT) * 64 % 18446744073709551616 + (u >> 2)")}) AS v FROM o)
      SELECT l_partkey, l_linenumber, {_signed_sql("v")} AS h FROM t""",
)
def array_hash_query(spark, data_dir):
    d = _lines(spark, data_dir).select("l_partkey", "l_linenumber").distinct()
    return d.withColumn("h", array_hash(F.col("l_partkey"), F.col("l_linenumber")))


@query("parity", "SELECT l_linenumber & 1 AS bit, COUNT(*) AS n_rows FROM lineitem GROUP BY 1")
def parity_query(spark, data_dir):
    return _lines(spark, data_dir).groupBy(parity(F.col("l_linenumber")).alias("bit")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("larger_root", "SELECT a, b, CASE WHEN b * b < 4 * a THEN CAST(-1 AS DOUBLE) ELSE (-b + sqrt(CAST(b * b - 4 * a AS DOUBLE))) / (2 * a) END AS x FROM (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM range(1, 6) p(a), range(-6, 7) q(b))")
def larger_root_query(spark, data_dir):
    d = spark.range(1, 6).select(F.col("id").cast("int").alias("a")).crossJoin(spark.range(-6, 7).select(F.col("id").cast("int").alias("b")))
    return d.withColumn("x", larger_root(F.col("a").cast("double"), F.col("b").cast("double"), F.lit(1.0)))


@query("peer_index", "SELECT CAST(d AS INTEGER) AS node, CAST(s AS INTEGER) AS self, CAST(d - CASE WHEN d > s THEN 1 ELSE 0 END AS INTEGER) AS peer FROM range(4) a(d), range(4) b(s) WHERE d <> s")
def peer_index_query(spark, data_dir):
    d = spark.range(4).select(F.col("id").cast("int").alias("node")).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("self"))).filter("node <> self")
    return d.withColumn("peer", peer_index(F.col("node"), F.col("self")).cast("int"))


# -- adaptive execution

_TOTAL = 24_000_000


@query("task_splits", "SELECT CAST(i AS BIGINT) AS i, CAST(i * 2400000 AS BIGINT) AS lo, CAST((i + 1) * 2400000 AS BIGINT) AS hi FROM range(10) t(i)")
def task_splits(spark, data_dir):
    d = spark.range(1).select(F.lit(0).cast("bigint").alias("s"), F.lit(_TOTAL).cast("bigint").alias("e"))
    return scaleout.split(d, "s", "e", F.lit(scaleout.CHUNKS)).select("i", "lo", "hi")


@query("morsel_splits", "SELECT CAST(i * 1000 AS BIGINT) AS lo, CAST(least(i * 1000 + 1000, 24321) AS BIGINT) AS hi FROM range(25) t(i)")
def morsel_splits(spark, data_dir):
    d = spark.range(1).select(F.lit(0).cast("bigint").alias("s"), F.lit(24_321).cast("bigint").alias("e"))
    return scaleout.morsels(d, "s", "e", 1000).select("lo", "hi")


@query("initial_offers", "SELECT n AS workers, CAST(i AS BIGINT) AS i, CAST(i * 24000000 // n AS BIGINT) AS lo, CAST((i + 1) * 24000000 // n AS BIGINT) AS hi FROM (SELECT UNNEST([1, 2, 4]) AS n), range(4) t(i) WHERE i < n")
def initial_offers(spark, data_dir):
    d = spark.createDataFrame([(1,), (2,), (4,)], "workers int").withColumns({"s": F.lit(0).cast("bigint"), "e": F.lit(_TOTAL).cast("bigint")})
    return scaleout.split(d, "s", "e", F.col("workers")).select("workers", "i", "lo", "hi")


@query("remainder_offers", "SELECT CAST(i AS BIGINT) AS i, CAST(18600000 + i * 1800000 AS BIGINT) AS lo, CAST(18600000 + (i + 1) * 1800000 AS BIGINT) AS hi FROM range(3) t(i)")
def remainder_offers(spark, data_dir):
    d = spark.range(1).select(F.lit(0).cast("bigint").alias("start"), F.lit(_TOTAL).cast("bigint").alias("end"), F.lit(7).alias("chunks_done"), F.lit(1).alias("nworkers"), F.lit(4).alias("wanted"))
    return scaleout.remainder_offers(scaleout.health_check(d), F.lit(3)).select("i", "lo", "hi")


@query("health_checks", "SELECT CAST(c AS INTEGER) AS chunks_done, CAST(c * 2400000 + (24000000 - c * 2400000) // 4 AS BIGINT) AS rem_start, CAST(3 AS INTEGER) AS hint FROM range(1, 10) t(c)")
def health_checks(spark, data_dir):
    d = spark.range(1, 10).select(F.lit(0).cast("bigint").alias("start"), F.lit(_TOTAL).cast("bigint").alias("end"), F.col("id").cast("int").alias("chunks_done"), F.lit(1).alias("nworkers"), F.lit(4).alias("wanted"))
    return scaleout.health_check(d).select("chunks_done", "rem_start", "hint")


@query("static_policy", "SELECT CAST(i * 100 AS INTEGER) AS elapsed, CAST(CASE WHEN i * 100 > 500 THEN 4 ELSE 1 END AS INTEGER) AS wanted FROM range(11) t(i)")
def static_policy(spark, data_dir):
    d = spark.range(11).select((F.col("id") * 100).cast("int").alias("elapsed"))
    return d.withColumn("wanted", scaleout.static_policy(F.col("elapsed"), F.lit(500), F.lit(1), F.lit(4)))


_GRID = "(SELECT CAST(pow(10, g) AS BIGINT) AS groups, CAST(w AS INTEGER) AS w, CAST(t AS INTEGER) AS threads FROM range(1, 9) a(g), range(1, 5) b(w), (SELECT UNNEST([1, 6, 12, 32]) AS t))"
_TIME = "CAST(floor(exp(5.828258 - 0.387998 * CAST({w} AS DOUBLE) + 0.136706 * ln(CAST(groups AS DOUBLE)) - 0.887925 * ln(CAST(threads AS DOUBLE)) + 0.014630 * CAST({w} AS DOUBLE) * CAST(threads AS DOUBLE))) AS BIGINT)"


def _grid(spark: SparkSession) -> DataFrame:
    g = spark.range(1, 9).select(F.pow(F.lit(10.0), F.col("id")).cast("bigint").alias("groups"))
    return g.crossJoin(spark.range(1, 5).select(F.col("id").cast("int").alias("w"))).crossJoin(spark.createDataFrame([(1,), (6,), (12,), (32,)], "threads int"))


@query("cost_model", f"SELECT groups, w, threads, {_TIME.format(w='w')} AS ms FROM {_GRID}")
def cost_model(spark, data_dir):
    return _grid(spark).withColumn("ms", scaleout.time_ms(F.col("groups"), F.col("w"), F.col("threads")))


@query(
    "regression_policy",
    f"""SELECT groups, threads, r AS remaining_ms, CAST(coalesce((SELECT MIN(i) FROM range(1, 8) q(i) WHERE {_TIME.format(w='i')} < r), 8) AS INTEGER) AS wanted
        FROM (SELECT DISTINCT groups, threads FROM {_GRID}), (SELECT UNNEST([50, 200, 1000]) AS r)""",
)
def regression_policy(spark, data_dir):
    d = _grid(spark).select("groups", "threads").distinct().crossJoin(spark.createDataFrame([(50,), (200,), (1000,)], "remaining_ms int"))
    d = d.withColumns({"nworkers": F.lit(1), "max_workers": F.lit(8)})
    return scaleout.regression_policy(d).select("groups", "threads", "remaining_ms", "wanted")


_HIST = "(SELECT CAST(o_custkey % 20 AS BIGINT) AS page, COUNT(DISTINCT o_custkey) AS groups FROM orders WHERE o_custkey % 20 > 0 GROUP BY 1)"


def _history(spark: SparkSession, data_dir: str) -> DataFrame:
    o = table(spark, data_dir, "orders").select(F.pmod("o_custkey", F.lit(20)).alias("page"), "o_custkey").filter("page > 0").distinct()
    return o.groupBy("page").agg(F.count(F.lit(1)).alias("groups"))


def _fit_sql(x: str) -> str:
    return f"SELECT CAST(round(regr_intercept(groups, {x}) * 1000) AS BIGINT) AS a, CAST(round(regr_slope(groups, {x}) * 1000) AS BIGINT) AS b FROM {_HIST}"


@query("log_fit", _fit_sql("ln(CAST(page AS DOUBLE))"))
def log_fit(spark, data_dir):
    d = scaleout.fit(_history(spark, data_dir), F.ln(F.col("page").cast("double")), F.col("groups"))
    return d.select(F.round(F.col("a") * 1000).cast("bigint").alias("a"), F.round(F.col("b") * 1000).cast("bigint").alias("b"))


@query("linear_fit", _fit_sql("CAST(page AS DOUBLE)"))
def linear_fit(spark, data_dir):
    d = scaleout.fit(_history(spark, data_dir), F.col("page"), F.col("groups"))
    return d.select(F.round(F.col("a") * 1000).cast("bigint").alias("a"), F.round(F.col("b") * 1000).cast("bigint").alias("b"))


@query("quadratic_fit", "SELECT CAST(3 AS BIGINT) AS a, CAST(-2 AS BIGINT) AS b, CAST(5 AS BIGINT) AS c")
def quadratic_fit(spark, data_dir):
    d = spark.range(1, 17).select("id", (F.lit(3) - 2 * F.col("id") + 5 * F.col("id") * F.col("id")).alias("y"))
    return scaleout.quadratic_fit(d, F.col("id"), F.col("y")).select(*[F.round(F.col(c)).cast("bigint").alias(c) for c in "abc"])


@query("total_groups_estimate", "SELECT p AS done, CAST(floor(CASE WHEN p * 100 < 25 THEN 10 + 20 * ln(CAST(1000 AS DOUBLE)) ELSE 10.0 + 2 * 1000 END) AS BIGINT) AS groups FROM (SELECT UNNEST([CAST(0.1 AS DOUBLE), 0.2, 0.3, 0.9]) AS p)")
def total_groups_estimate(spark, data_dir):
    d = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.9,)], "done double")
    v = scaleout.total_groups(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(2.0), F.lit(1000), F.col("done"), as_percent=True)
    return d.select("done", F.floor(v).cast("bigint").alias("groups"))


@query("total_groups_default", "SELECT p AS done, CAST(floor(10 + 20 * ln(CAST(1000 AS DOUBLE))) AS BIGINT) AS groups FROM (SELECT UNNEST([CAST(0.1 AS DOUBLE), 0.2, 0.3, 0.9]) AS p)")
def total_groups_default(spark, data_dir):
    """``done`` as a fraction, which is always under 25: the logarithmic fit decides."""
    d = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.9,)], "done double")
    v = scaleout.total_groups(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(2.0), F.lit(1000), F.col("done"))
    return d.select("done", F.floor(v).cast("bigint").alias("groups"))


@query(
    "coordinator_messages",
    """SELECT c AS chunks_done, w AS worker, CASE WHEN w <= 3 THEN 'TASK_OFFER' ELSE 'NO_WORK' END AS message, CASE WHEN w <= 3 THEN lo + (w - 1) * step END AS lo,
       CASE WHEN w <= 3 THEN least(lo + w * step, 24000000) END AS hi, CASE WHEN w <= 3 THEN CAST(4 AS INTEGER) END AS nworkers, CAST(CASE WHEN w <= 3 THEN 1 ELSE 0 END AS INTEGER) AS tasks,
       CASE WHEN w <= 3 THEN least(lo + w * step, 24000000) - (lo + (w - 1) * step) ELSE 0 END AS rows
     FROM (SELECT CAST(c AS INTEGER) AS c, CAST(w AS INTEGER) AS w, CAST(c * 2400000 + (24000000 - c * 2400000) // 4 AS BIGINT) AS lo,
       CAST((24000000 - (c * 2400000 + (24000000 - c * 2400000) // 4)) // 3 AS BIGINT) AS step FROM range(1, 10) t(c), range(1, 6) u(w))""",
)
def coordinator_messages(spark, data_dir):
    """Five inactive workers, three wanted: offers, NO_WORK to the others, and what each auxiliary worker then does."""
    d = spark.range(1, 10).select(F.lit(0).cast("bigint").alias("start"), F.lit(_TOTAL).cast("bigint").alias("end"), F.col("id").cast("int").alias("chunks_done"), F.lit(1).alias("nworkers"), F.lit(4).alias("wanted"))
    return scaleout.auxiliary_worker(scaleout.coordinator_messages(scaleout.health_check(d), 5))


@query(
    "worker_state",
    """SELECT worker, seq, message, SUM(CASE message WHEN 'TASK_OFFER' THEN 1 WHEN 'TASK_OFFER_RESPONSE' THEN -1 ELSE 0 END) OVER (PARTITION BY worker ORDER BY seq)::BIGINT AS outstanding, hint > 0 AS more
       FROM (SELECT user_id % 3 AS worker, event_id AS seq, CASE WHEN value < 40 THEN 'TASK_OFFER' WHEN value < 80 THEN 'TASK_OFFER_RESPONSE' ELSE 'NO_WORK' END AS message, event_id % 2 AS hint FROM events)""",
)
def worker_state(spark, data_dir):
    """Offers and answers of three workers, as read off ``events``."""
    e = table(spark, data_dir, "events")
    kind = F.when(F.col("value") < 40, scaleout.MESSAGES[0]).when(F.col("value") < 80, scaleout.MESSAGES[1]).otherwise(scaleout.MESSAGES[4])
    d = e.select(F.pmod("user_id", F.lit(3)).alias("worker"), F.col("event_id").alias("seq"), kind.alias("message"), F.pmod("event_id", F.lit(2)).alias("hint"))
    return scaleout.outstanding(d, "seq", "worker").drop("hint")


@query("cardinality_history", f"SELECT page, groups FROM {_HIST} ORDER BY page DESC LIMIT 16")
def cardinality_history(spark, data_dir):
    return scaleout.last_history(_history(spark, data_dir), "page")


_PART_SQL = "SELECT l_partkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_partkey"


def _chunks(spark: SparkSession, data_dir: str) -> tuple:
    """(reader, total): chunks are ranges of l_orderkey, by which the table is stored, so that a chunk's filter prunes the scan."""
    d = _lines(spark, data_dir)
    total = (d.agg(F.max("l_orderkey")).first()[0] or 0) + 1  # from the footers
    return chunked.by_column(d, "l_orderkey", total), total


@query("adaptive_group_count", _COUNT_SQL)
def adaptive_group_count(spark, data_dir):
    read, total = _chunks(spark, data_dir)
    return chunked.adaptive_aggregate(read, total, AggSpec(["l_orderkey"]), chunked.after_chunks(7, 4))


@query("adaptive_regression", _PART_SQL)
def adaptive_regression(spark, data_dir):
    """Keys that repeat between chunks; the regression over the run's checkpoints decides when to scale out, and to how many workers."""
    read, total = _chunks(spark, data_dir)
    return chunked.adaptive_aggregate(read, total, AggSpec(["l_partkey"]), chunked.regression(500, 4, 2), hash_=mix32(F.col("l_partkey")), checkpoints=True)


@query(
    "run_checkpoints",
    f"""WITH t AS (SELECT CAST((MAX(l_orderkey) + 10) // 10 AS BIGINT) AS step, MAX(l_orderkey) + 1 AS total FROM lineitem),
      c AS (SELECT CAST(least((i + 1) * step, total) AS BIGINT) AS page FROM t, range(10) q(i)),
      h AS (SELECT l_orderkey, {_mix_sql("l_partkey")} AS h FROM lineitem),
      r AS (SELECT page, h & 255 AS reg, MAX(CASE WHEN h >> 8 = 0 THEN 24 ELSE bit_count(((h >> 8) & -(h >> 8)) - 1) + 1 END) AS rank FROM c JOIN h ON l_orderkey < page GROUP BY ALL),
      e AS (SELECT page, 256 - COUNT(*) AS z, CAST(0.7213 AS DOUBLE) / (1 + CAST(1.079 AS DOUBLE) / 256) * 65536 / (SUM(pow(CAST(2 AS DOUBLE), -rank)) + (256 - COUNT(*))) AS raw FROM r GROUP BY page)
    SELECT page, CAST(floor(CASE WHEN z > 0 AND raw < 640 THEN 256.0 * ln(256.0 / z) ELSE raw END) AS BIGINT) AS groups FROM e""",
)
def run_checkpoints(spark, data_dir):
    """The sketch of the keys so far after each of ten chunks, as the regression policy sees it."""
    read, total = _chunks(spark, data_dir)
    run = chunked.Run()
    chunked.adaptive_aggregate(read, total, AggSpec(["l_partkey"]), chunked.after_chunks(99, 1), run=run, hash_=mix32(F.col("l_partkey")), checkpoints=True)
    return spark.createDataFrame([(c.page, c.groups) for c in run.history], "page bigint, groups bigint")


@query(
    "rebalanced_states",
    f"""WITH t AS (SELECT CAST((MAX(l_orderkey) + 10) // 10 AS BIGINT) AS step, MAX(l_orderkey) + 1 AS total FROM lineitem),
      o AS (SELECT step, total, CAST(ceil((total - 7 * step) / 4.0) AS BIGINT) AS rest FROM t),
      s AS (SELECT DISTINCT l_partkey, CASE WHEN l_orderkey < 7 * step THEN l_orderkey // step ELSE 7 + (l_orderkey - 7 * step) // rest END AS chunk, {_mix_sql("l_partkey")} >> 28 AS grp FROM lineitem, o)
    SELECT CAST(CASE WHEN chunk < 7 THEN 0 ELSE (grp * 4) >> 4 END AS INTEGER) AS owner, CAST((grp * 4) >> 4 AS INTEGER) AS final_owner, COUNT(*) AS n_states FROM s GROUP BY ALL""",
)
def rebalanced_states(spark, data_dir):
    """States by the worker that owned their group when they were made, and its final one: where the two differ they moved at the scale-out."""
    read, total = _chunks(spark, data_dir)
    run = chunked.Run()
    chunked.adaptive_aggregate(read, total, AggSpec(["l_partkey"]), chunked.after_chunks(7, 4), run=run, hash_=mix32(F.col("l_partkey")))
    return chunked.held_states(spark, run).groupBy("owner", "final_owner").agg(F.count(F.lit(1)).alias("n_states"))


# -- sources


@query("generated_table_count", "SELECT CAST(10 AS BIGINT) AS n_groups, CAST(10000 AS BIGINT) AS n_rows")
def generated_table_count(spark, data_dir):
    return audit(group_aggregate(generator.generated(spark, 400, 10, 1), AggSpec(["c0"])))


@query("page_rows", "SELECT CAST(page AS BIGINT) AS page, COUNT(*) AS n_rows FROM (SELECT o_orderkey // 25 AS page FROM orders) GROUP BY 1")
def page_rows(spark, data_dir):
    o = table(spark, data_dir, "orders").select(generator.page_of(F.col("o_orderkey")).alias("page"))
    return o.groupBy("page").agg(F.count(F.lit(1)).alias("n_rows"))


@query("node_slices", "SELECT CAST(p AS BIGINT) AS pages, CAST(n AS BIGINT) AS nodes, CAST(p // n AS BIGINT) AS slice FROM (SELECT UNNEST([1000, 1001, 1002, 1003]) AS p), range(1, 5) t(n)")
def node_slices(spark, data_dir):
    d = spark.range(1000, 1004).select(F.col("id").alias("pages")).crossJoin(spark.range(1, 5).select(F.col("id").alias("nodes")))
    return d.withColumn("slice", generator.node_pages(F.col("pages"), F.col("nodes")))


@query("cluster_nodes", "SELECT * FROM (VALUES ('coordinator', CAST(NULL AS INTEGER), '10.0.0.1', '59000'), ('worker', 0, '10.0.0.2', '59001'), ('worker', 1, '10.0.0.3', '59002')) t(role, node, ip, port)")
def cluster_nodes(spark, data_dir):
    text = '{"coordinator": {"ip": "10.0.0.1", "port": "59000"}, "workers": [{"ip": "10.0.0.2", "port": "59001"}, {"ip": "10.0.0.3", "port": "59002"}]}'
    c = spark.range(1).select(F.from_json(F.lit(text), generator.CONFIG).alias("c")).select("c.*")
    return generator.cluster_nodes(c)


@query("partly_cached_count", _COUNT_SQL)
def partly_cached_count(spark, data_dir):
    """Half of the rows from executor memory, the others from the scan."""
    return group_aggregate(partly_cached(_lines(spark, data_dir).select("l_orderkey"), 50, F.col("l_orderkey")), AggSpec(["l_orderkey"]))


@query("schema_text", "SELECT 'bigint|bigint|int|string' AS types")
def schema_text_query(spark, data_dir):
    d = _lines(spark, data_dir).select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    require(d, "l_orderkey bigint, l_linenumber int")
    return spark.createDataFrame([(schema_text(d),)], "types string")


@query("metrics_row", "SELECT 'aggregate' AS name, CAST(COUNT(*) AS BIGINT) AS rows, '1,2' AS nodes FROM lineitem")
def metrics_row(spark, data_dir):
    with metrics.Stopwatch() as watch:
        rows = _lines(spark, data_dir).count()
    assert watch.ms >= 1
    return metrics.log_row(spark, name="aggregate", rows=rows, nodes=[1, 2])
