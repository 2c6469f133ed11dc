"""Adaptive aggregation: the input goes in ten chunks, and before each a policy may divide the rest among more workers.

A chunk's partial states are written to a shared folder and merged at the end: work that is done isn't repeated, whatever
becomes of the executors. Each chunk is read by a filter on a stored column (pushed to the scan, where it prunes row groups) or as a
set of files, so that no chunk reads the others' rows. A state is written with its partition group and the worker that owned the group when it
was made; after a scale-out groups have other owners, and the merge exchanges by group, so that states held by an earlier
owner go to the final one. The result is the same under any policy.
"""

from __future__ import annotations

import math
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import sketch
from gristmill.functions.hashing import owner, partition_group, radix_partition
from gristmill.operators.aggregate import AggSpec, merge, partial
from gristmill.operators.scaleout import CHUNKS, HISTORY

PARTITIONS = 64
GROUP = 4


@dataclass
class Checkpoint:
    """After a chunk: the position reached and the estimated number of groups so far."""

    page: int
    groups: int


@dataclass
class Run:
    """What a run did: chunk ranges with the workers they were divided over, checkpoints of the sketch, and the scale-out moment if there was one."""

    ranges: list[tuple[int, int, int]] = field(default_factory=list)
    scaled_at: int | None = None
    elapsed_ms: list[int] = field(default_factory=list)
    history: list[Checkpoint] = field(default_factory=list)
    total: int = 0
    states: str | None = None


#: (run, chunks done, elapsed ms, workers) -> workers wanted
Policy = Callable[[Run, int, int, int], int]


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local master gets a folder of its own, as in tests; on a cluster that is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def by_column(df: DataFrame, column: str, total: int) -> Callable[[int, int], DataFrame]:
    """Rows of [from, to) of a bigint column. Rows with a NULL position or one below 0 are of the first chunk, those from total on of the last."""
    at = F.col(column)

    def read(start: int, end: int) -> DataFrame:
        below = F.lit(True) if end >= total else at < end
        return df.filter(below | at.isNull() if start == 0 else below & (at >= start))

    return read


def by_files(spark: SparkSession, folder: str) -> tuple[Callable[[int, int], DataFrame], int]:
    """(reader of the files [from, to) of a Parquet folder in the order of their names, their number)."""
    whole = spark.read.parquet(folder)
    files = sorted(whole.inputFiles())
    return lambda start, end: spark.read.schema(whole.schema).parquet(*files[start:end]), len(files)


def _with_owner(states: DataFrame, hash_: Column, workers: int) -> DataFrame:
    grp = partition_group(radix_partition(hash_, PARTITIONS, 32), GROUP)
    return states.withColumn("grp", grp).withColumn("owner", owner(F.col("grp"), PARTITIONS // GROUP, workers))


def adaptive_aggregate(
    read: Callable[[int, int], DataFrame], total: int, spec: AggSpec, policy: Policy, workers: int = 1, run: Run | None = None, hash_: Column | None = None, checkpoints: bool = False, clock: Callable[[], float] = time.monotonic
) -> DataFrame:
    """The grouped aggregate of the positions [0, total). The policy is asked before each chunk after the first, until the workers grow once.

    hash_: 32-bit hash of the keys over the states' columns, for groups and sketch (xxhash64 of the keys by default).
    checkpoints: keep the sketch of the groups while there is one worker, for a policy that looks at ``Run.history``.
    """
    run = run if run is not None else Run()
    run.total = total
    hash_ = F.shiftrightunsigned(F.xxhash64(*spec.keys), 32) if hash_ is None else hash_
    registers: dict[int, int] = {}
    spark = read(0, 0).sparkSession
    path = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    run.states = path
    began, at, done, step = clock(), 0, 0, -(-total // CHUNKS) or 1
    first = workers
    while at < total:
        elapsed = int((clock() - began) * 1000)
        if done and run.scaled_at is None and (wanted := policy(run, done, elapsed, workers)) > workers:
            workers, run.scaled_at = wanted, done
            step = -(-(total - at) // workers)
        end = min(at + step, total)
        # states of a chunk: keys repeat between chunks, and the merge brings them together
        states = _with_owner(partial(read(at, end), spec), hash_, workers)
        states.write.mode("append").parquet(f"{path}/chunk={done}")
        run.ranges.append((at, end, workers))
        run.elapsed_ms.append(elapsed)
        if checkpoints and workers == first:
            # at most 256 rows; the registers of all chunks so far are their maximum
            for r in sketch.registers(spark.read.parquet(f"{path}/chunk={done}"), hash_, bits=32).collect():
                registers[r.reg] = max(registers.get(r.reg, 0), r.rank)
            run.history.append(Checkpoint(end, sketch.estimate_of(registers)))
        at, done = end, done + 1
    if not run.ranges:
        return merge(partial(read(0, 0), spec), spec)
    return merge(held_states(spark, run, workers).repartition("grp", *spec.keys), spec)


def held_states(spark: SparkSession, run: Run, workers: int | None = None) -> DataFrame:
    """The states of a run with their final owner: where it differs from ``owner``, the state moved at the scale-out."""
    final = workers if workers is not None else run.ranges[-1][2]
    return spark.read.parquet(run.states).withColumn("final_owner", owner(F.col("grp"), PARTITIONS // GROUP, final))


def static(timeout_ms: int, workers: int) -> Policy:
    return lambda run, done, elapsed, now: workers if elapsed > timeout_ms else now


def after_chunks(chunks: int, workers: int) -> Policy:
    """A policy that doesn't depend on the clock."""
    return lambda run, done, elapsed, now: workers if done >= chunks else now


def fitted_groups(history: list[Checkpoint], total: int, done: float, as_percent: bool = False) -> float:
    """Groups at the end of the input from the last checkpoints: by the logarithm of the position while under 25 are done, else linear."""
    last = history[-HISTORY:]
    log = (done * 100 if as_percent else done) < 25
    x = [math.log(max(c.page, 1)) if log else float(c.page) for c in last]
    y = [float(c.groups) for c in last]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    spread = sum((v - mx) ** 2 for v in x)
    slope = 0.0 if spread < 1e-5 else sum((v - mx) * (w - my) for v, w in zip(x, y)) / spread
    return my - slope * mx + slope * (math.log(total) if log else total)


def cost_ms(groups: float, workers: int, threads: int) -> int:
    return int(math.exp(5.828258 - 0.387998 * workers + 0.136706 * math.log(max(groups, 1)) - 0.887925 * math.log(threads) + 0.014630 * workers * threads))


def regression(timeout_ms: int, max_workers: int, threads: int, as_percent: bool = False) -> Policy:
    """The fewest workers that the cost model lets finish in the time left, else the most. Needs checkpoints."""

    def wanted(run: Run, done: int, elapsed: int, now: int) -> int:
        groups = fitted_groups(run.history, run.total, done / CHUNKS, as_percent)
        left = max(timeout_ms - elapsed, 0)
        return next((w for w in range(now, max_workers) if cost_ms(groups, w, threads) < left), max_workers)

    return wanted
