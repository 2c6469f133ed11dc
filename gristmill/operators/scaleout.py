"""Division of work and the scale-out policy as DataFrame expressions: chunks, offers, policies, cost model, growth fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNKS = 10
HISTORY = 16
MESSAGES = ("TASK_OFFER", "TASK_OFFER_RESPONSE", "NUM_WORKERS_UPDATE", "QUERY_END", "NO_WORK")


def split(df: DataFrame, start: str, end: str, parts: Column) -> DataFrame:
    """Half-open ranges of ceil(length / parts) that cover [start, end); empty ones are left out. Adds i, lo, hi."""
    step = F.ceil((F.col(end) - F.col(start)) / parts).cast("bigint")
    d = df.withColumn("_step", step).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)))
    lo = F.least(F.col(start) + F.col("i") * F.col("_step"), F.col(end))
    d = d.withColumn("lo", lo.cast("bigint")).withColumn("hi", F.least(F.col("lo") + F.col("_step"), F.col(end)).cast("bigint"))
    return d.filter("lo < hi").drop("_step")


def morsels(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """Ranges of ``size`` (the last one shorter) that cover [start, end)."""
    d = df.withColumn("lo", F.explode(F.when(F.col(start) < F.col(end), F.sequence(F.col(start), F.col(end) - 1, F.lit(size).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))))
    return d.withColumn("hi", F.least(F.col("lo") + size, F.col(end)))


def health_check(df: DataFrame) -> DataFrame:
    """Columns start, end, chunks_done, nworkers, wanted: what the first worker keeps and what it returns when it scales out.

    Adds chunk, next, keep_end, rem_start, rem_end, hint; without scale-out it keeps all and returns an empty range.
    """
    chunk = F.ceil((F.col("end") - F.col("start")) / CHUNKS).cast("bigint")
    nxt = F.least(F.col("start") + F.col("chunks_done") * chunk, F.col("end"))
    grow = (F.col("chunks_done") >= 1) & (F.col("wanted") > F.col("nworkers"))
    keep = F.when(grow, F.ceil((F.col("end") - nxt) / F.col("wanted"))).otherwise(F.col("end") - nxt).cast("bigint")
    d = df.withColumn("chunk", chunk).withColumn("next", nxt.cast("bigint"))
    d = d.withColumn("keep_end", F.least(nxt + keep, F.col("end")).cast("bigint"))
    d = d.withColumn("rem_start", F.col("keep_end")).withColumn("rem_end", F.col("end").cast("bigint"))
    return d.withColumn("hint", F.when(grow, F.col("wanted") - 1).otherwise(0).cast("int"))


def remainder_offers(df: DataFrame, inactive: Column) -> DataFrame:
    """The returned range over min(hint, inactive) workers."""
    d = df.withColumn("requested", F.least(F.col("hint"), inactive)).filter("requested > 0 AND rem_start < rem_end")
    return split(d, "rem_start", "rem_end", F.col("requested"))


def coordinator_messages(df: DataFrame, inactive: int) -> DataFrame:
    """What the coordinator sends for a returned range (columns of ``health_check``): (worker, message, lo, hi, nworkers) of TASK_OFFER to the
    first min(hint, inactive) of the inactive workers 1..inactive, and NO_WORK to each of the others."""
    requested = F.least(F.col("hint"), F.lit(inactive))
    d = df.withColumn("requested", requested).withColumn("worker", F.explode(F.sequence(F.lit(1), F.lit(inactive))))
    offset = F.ceil((F.col("rem_end") - F.col("rem_start")) / F.greatest(F.col("requested"), F.lit(1)))
    lo = F.col("rem_start") + (F.col("worker") - 1) * offset
    offer = (F.col("worker") <= F.col("requested")) & (F.col("rem_start") < F.col("rem_end"))
    return d.select(
        *[c for c in df.columns if c in ("chunks_done",)],
        "worker",
        F.when(offer, F.lit(MESSAGES[0])).otherwise(F.lit(MESSAGES[4])).alias("message"),
        F.when(offer, lo).cast("bigint").alias("lo"),
        F.when(offer, F.least(lo + offset, F.col("rem_end"))).cast("bigint").alias("hi"),
        F.when(offer, F.col("requested") + 1).cast("int").alias("nworkers"),
    )


def auxiliary_worker(messages: DataFrame) -> DataFrame:
    """``messages`` with what a worker that joins later does: it takes its one task and has finished, or has finished idle."""
    return messages.withColumn("tasks", (F.col("message") == MESSAGES[0]).cast("int")).withColumn("rows", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)))


def outstanding(messages: DataFrame, order: str, *by: str) -> DataFrame:
    """Columns message and hint: adds ``outstanding``, offers sent less answers so far, and ``more``, whether the worker asks for help."""
    w = Window.partitionBy(*by).orderBy(order)
    sign = F.when(F.col("message") == MESSAGES[0], 1).when(F.col("message") == MESSAGES[1], -1).otherwise(0)
    return messages.withColumn("outstanding", F.sum(sign).over(w)).withColumn("more", F.coalesce(F.col("hint") > 0, F.lit(False)))


def time_ms(groups: Column, workers: Column, threads: Column) -> Column:
    """Cost model: estimated run time, truncated to milliseconds."""
    w, t = workers.cast("double"), threads.cast("double")
    x = F.lit(5.828258) - F.lit(0.387998) * w + F.lit(0.136706) * F.ln(groups.cast("double")) - F.lit(0.887925) * F.ln(t) + F.lit(0.014630) * w * t
    return F.floor(F.exp(x)).cast("bigint")


def static_policy(elapsed: Column, timeout: Column, nworkers: Column, static_workers: Column) -> Column:
    return F.when(elapsed > timeout, static_workers).otherwise(nworkers)


def regression_policy(df: DataFrame) -> DataFrame:
    """Columns groups, nworkers, max_workers, threads, remaining_ms: adds ``wanted``, the fewest workers that finish in time, else the most.

    A higher-order filter over the candidate counts, so that no row is multiplied or shuffled.
    """
    tries = F.when(F.col("nworkers") < F.col("max_workers"), F.sequence(F.col("nworkers"), F.col("max_workers") - 1)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(tries, lambda w: time_ms(F.col("groups"), w, F.col("threads")) < F.col("remaining_ms"))
    return df.withColumn("wanted", F.coalesce(F.get(fits, F.lit(0)), F.col("max_workers")).cast("int"))


def last_history(df: DataFrame, order: str, *by: str, size: int = HISTORY) -> DataFrame:
    """The ring buffer: the last ``size`` checkpoints of each history."""
    if not by:
        return df.orderBy(F.col(order).desc()).limit(size)  # each task keeps ``size`` rows; nothing is sorted as a whole
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= size).drop("_rn")


def fit(df: DataFrame, x: Column, y: Column, *by: str) -> DataFrame:
    """(by..., a, b): least squares y = a + b * x; (mean, 0) where x hardly varies."""
    d = df.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y"))
    flat = F.var_pop("x") * F.count(F.lit(1)) < 1e-5
    mean = F.avg("y")
    return d.groupBy(*by).agg(F.when(flat, mean).otherwise(F.regr_intercept("y", "x")).alias("a"), F.when(flat, F.lit(0.0)).otherwise(F.regr_slope("y", "x")).alias("b"))


def quadratic_fit(df: DataFrame, x: Column, y: Column, *by: str) -> DataFrame:
    """(by..., a, b, c): least squares y = a + b * x + c * x^2 by Cramer's rule over sums of powers; NULL where singular."""
    d = df.select(*by, x.cast("double").alias("x"), y.cast("double").alias("y"))
    p = {i: F.sum(F.pow(F.col("x"), F.lit(float(i)))) for i in range(1, 5)}
    s = d.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), *[p[i].alias(f"s{i}") for i in p], *[F.sum(F.col("y") * F.pow(F.col("x"), F.lit(float(i)))).alias(f"t{i}") for i in range(3)])
    m = [["n", "s1", "s2"], ["s1", "s2", "s3"], ["s2", "s3", "s4"]]

    def det(r: list[list[str]]) -> Column:
        c = [[F.col(v) for v in row] for row in r]
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    def swapped(k: int) -> list[list[str]]:
        return [[f"t{i}" if j == k else v for j, v in enumerate(row)] for i, row in enumerate(m)]

    base = det(m)
    return s.select(*by, *[F.when(base == 0, None).otherwise(det(swapped(k)) / base).alias("abc"[k]) for k in range(3)])


def total_groups(log_a: Column, log_b: Column, lin_a: Column, lin_b: Column, total: Column, done: Column, as_percent: bool = False) -> Column:
    """Groups at the end of the input: the logarithmic fit while under 25 are done, else the linear one.

    ``done`` is a fraction and is compared as it is, so that the logarithmic fit always decides; as_percent compares it in percent.
    """
    pct = done * 100 if as_percent else done
    return F.when(pct < 25, log_a + log_b * F.ln(total.cast("double"))).otherwise(lin_a + lin_b * total)
