"""Paired comparison of runs: deltas, bootstrap intervals, permutation and signed-rank tests.

Resampling is indexed by md5 of (seed, resample, place), so it is the same on every engine and
partitioning.  A task holds a block of differences and adds up a range of resamples; no row is made of a query and a
resample.  Other Python runs on result rows alone, one per metric and two runs, for the tails of distributions that SQL lacks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged

#: Resamples of the bootstrap and permutations of the randomisation tests.
RESAMPLES = 10_000
#: Differences of a metric that a task holds.
BLOCK_PLACES = 262_144
#: Up to so many differences the signed-rank law is counted out.
EXACT_RANKS = 50
#: Hashes that are made at a time, and in a task.
_HELD_HASHES, _TASK_HASHES = 262_144, 5_000_000


def paired(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """query_id, metric, a, b, d from long rows (run, query_id, metric, value)."""
    left = metrics.where(F.col("run") == a).select("query_id", "metric", F.col("value").alias("a"))
    right = metrics.where(F.col("run") == b).select("query_id", "metric", F.col("value").alias("b"))
    return left.join(right, ["query_id", "metric"]).withColumn("d", F.col("b") - F.col("a"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """metric, n, mean_a, mean_b, delta, win, loss, tie."""
    share = lambda c: F.avg(c.cast("double"))
    out = pairs.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("delta"),
        share(F.col("b") > F.col("a")).alias("win"), share(F.col("b") < F.col("a")).alias("loss"),
    )
    return out.withColumn("tie", 1 - F.col("win") - F.col("loss"))


def _placed(pairs: DataFrame) -> DataFrame:
    """metric, i, d: a metric's differences numbered from 0 by query_id, range by range, so no task numbers them all."""
    rows = pairs.select("metric", "query_id", "d").repartitionByRange("metric", "query_id").withColumn("part", F.spark_partition_id())
    rows = staged(rows, "differences")
    before = Window.partitionBy("metric").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("metric", "part").agg(F.count("*").alias("own")).select("metric", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("metric", "part").orderBy("query_id")
    return rows.withColumn("i", F.row_number().over(own) - 1).join(offsets, ["metric", "part"]).select("metric", (F.col("i") + F.col("first")).alias("i"), "d")


def _hashes(prefix: str, resamples: range, places: range) -> np.ndarray:
    """The first 32 bits of md5(prefix:r:i), a row for each resample r."""
    at = [str(i).encode() for i in places]
    heads = [f"{prefix}:{r}:".encode() for r in resamples]
    return np.frombuffer(b"".join(md5(head + i).digest()[:4] for head in heads for i in at), dtype=">u4").astype(np.int64).reshape(len(heads), len(at))


_SUMS = "metric string, r int, total double"


def _resampled(rows: DataFrame, resamples: int, prefix: str, flips: bool) -> DataFrame:
    """metric, r, mean: of each resample, by drawing places (r, i) -> hash mod n, or by a sign for each place.

    Differences are packed into blocks of BLOCK_PLACES; a task has one block and a range of resamples, hashes the places once for all metrics,
    and keeps one sum for each resample and metric.  What is shuffled are these sums.
    """
    rows = staged(rows, "places")
    sizes = rows.groupBy("metric").agg(F.count("*").alias("n"))
    packed = rows.groupBy("metric", F.floor(F.col("i") / BLOCK_PLACES).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x"))
    packed = packed.join(sizes, "metric").select("block", F.struct("metric", "n", F.transform("x", lambda x: x["d"]).alias("d")).alias("x"))
    blocks = packed.groupBy("block").agg(F.collect_list("x").alias("of"))
    longest = sizes.agg(F.max("n")).first()[0] or 1
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, resamples * longest // _TASK_HASHES)
    step = max(1, resamples // min(tasks, resamples))
    starts = F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(step))
    cells = blocks.select("block", "of", F.explode(starts).alias("start")).repartition(min(tasks, resamples), "block", "start")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, of, start in zip(*(b.column(c).to_pylist() for c in ("block", "of", "start"))):
                end, lo = min(start + step, resamples), block * BLOCK_PLACES
                metrics = [(x["metric"], x["n"], np.array(x["d"])) for x in of]
                own = range(lo, lo + max(len(d) for _, _, d in metrics))
                places = own if flips else range(max(n for _, n, _ in metrics))
                sums = {m: np.zeros(end - start) for m, _, _ in metrics}
                wide = max(1, min(len(places), _HELD_HASHES))
                high = max(1, _HELD_HASHES // wide)
                for r in range(start, end, high):
                    these = range(r, min(r + high, end))
                    for i in range(places.start, places.stop, wide):
                        part = range(i, min(i + wide, places.stop))
                        h = _hashes(prefix, these, part)
                        for m, n, d in metrics:
                            if flips:
                                k = max(0, min(lo + len(d), part.stop) - i)
                                values = d[i - lo : i - lo + k] * np.where(h[:, :k] & 1, -1.0, 1.0)
                            else:
                                j = h[:, : max(0, n - i)] % n - lo
                                inside = (j >= 0) & (j < len(d))
                                values = np.where(inside, d[np.where(inside, j, 0)], 0.0)
                            sums[m][r - start : these.stop - start] += values.sum(1)
                names = [m for m, _, _ in metrics]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(names, dtype=object), end - start), pa.string()), pa.array(np.tile(np.arange(start, end, dtype=np.int32), len(names))), pa.array(np.concatenate([sums[m] for m in names]))],
                    names=["metric", "r", "total"],
                )

    totals = cells.mapInArrow(add, _SUMS).groupBy("metric", "r").agg(F.sum("total").alias("total"))
    return totals.join(sizes, "metric").select("metric", "r", (F.col("total") / F.col("n")).alias("m"))


def bootstrap_ci(pairs: DataFrame, resamples: int = RESAMPLES, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """metric, ci_low, ci_high: percentiles of the mean difference over resamples with replacement."""
    means = _resampled(_placed(pairs), resamples, str(seed), flips=False)
    return means.groupBy("metric").agg(F.percentile("m", F.lit((1 - ci) / 2)).alias("ci_low"), F.percentile("m", F.lit((1 + ci) / 2)).alias("ci_high"))


def permutation_p(pairs: DataFrame, permutations: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """metric, p: (hits + 1) / (permutations + 1) for sign flips of the differences."""
    rows = _placed(pairs)
    means = _resampled(rows, permutations, f"{seed}:flip", flips=True)
    observed = rows.groupBy("metric").agg(F.abs(F.avg("d")).alias("o"))
    reached = F.round(F.abs("m"), 9) >= F.round("o", 9)
    return means.join(observed, "metric").groupBy("metric").agg(((F.sum(reached.cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def _signed_ranks(pairs: DataFrame) -> DataFrame:
    """metric, n, t_plus, t_minus, z, plain: signed ranks of non-zero differences; `plain` where there are neither zeros nor ties."""
    own = Window.partitionBy("metric")
    rows = pairs.withColumn("size", F.round(F.abs("d"), 9))
    # Differences of one size have one rank, so sizes are counted before they are put in order.
    sizes = rows.where("size > 0").groupBy("metric", "size").agg(F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("bigint")).alias("up"))
    before = F.coalesce(F.sum("t").over(own.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.select("metric", "t", "up", (before + (F.col("t") + 1) / 2).alias("r"))
    sums = ranked.groupBy("metric").agg(
        F.sum("t").alias("n"), F.sum(F.col("up") * F.col("r")).alias("t_plus"), F.sum((F.col("t") - F.col("up")) * F.col("r")).alias("t_minus"),
        F.sum((F.col("t") * (F.col("t") * F.col("t") - 1)).cast("double")).alias("tie_term"), F.max("t").alias("most"),
    )
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    z = (F.least("t_plus", "t_minus") - n * (n + 1) / 4) / F.when(spread > 0, spread)
    all_ = rows.groupBy("metric").agg(F.count("*").alias("all"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return all_.join(sums, "metric", "left").select("metric", zero("n", 0), zero("t_plus", 0.0), zero("t_minus", 0.0), z.alias("z"), F.coalesce((F.col("n") == F.col("all")) & (F.col("most") == 1), F.lit(False)).alias("plain"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """metric, n, t_plus, t_minus, z: signed ranks of non-zero differences, mean ranks for ties; z is null if there are none."""
    return _signed_ranks(pairs).drop("plain")


def two_sided_p(z: float | None) -> float:
    """Normal approximation; no differences at all give 1."""
    return 1.0 if z is None else math.erfc(abs(z) / math.sqrt(2))


@cache
def rank_sum_counts(n: int) -> tuple[int, ...]:
    """Of the 2^n ways to give n ranks a sign, how many have each sum of positive ranks."""
    counts = [1]
    for rank in range(1, n + 1):
        longer = counts + [0] * rank
        counts = [c + (longer[s - rank] if s >= rank else 0) for s, c in enumerate(longer)]
    return tuple(counts)


def signed_rank_p(n: int, smaller: float, z: float | None, plain: bool) -> float:
    """Two-sided p of a signed-rank test: exact for up to EXACT_RANKS differences without zeros and ties, else by the normal law."""
    if not plain or not 0 < n <= EXACT_RANKS:
        return two_sided_p(z)
    return min(1.0, 2 * sum(rank_sum_counts(n)[: int(smaller) + 1]) / 2**n)


def wilcoxon_p(pairs: DataFrame) -> DataFrame:
    """metric, wilcoxon_p."""
    of = F.udf(signed_rank_p, "double")  # on one row per metric
    return _signed_ranks(pairs).select("metric", of("n", F.least("t_plus", "t_minus"), "z", "plain").alias("wilcoxon_p"))


def compare_all_pairs(metrics: DataFrame) -> DataFrame:
    """metric, run_a, run_b, delta, win, loss for every two runs, and the paired t statistic (null without spread)."""
    left = metrics.select(F.col("run").alias("run_a"), "query_id", "metric", F.col("value").alias("a"))
    right = metrics.select(F.col("run").alias("run_b"), "query_id", "metric", F.col("value").alias("b"))
    both = left.join(right, ["query_id", "metric"]).where("run_a < run_b").withColumn("d", F.col("b") - F.col("a"))
    spread = F.stddev_samp("d") / F.sqrt(F.count("*"))
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy("metric", "run_a", "run_b").agg(F.avg("d").alias("delta"), share(F.col("b") > F.col("a")).alias("win"), share(F.col("b") < F.col("a")).alias("loss"), F.when(F.round(spread, 9) > 0, F.avg("d") / spread).alias("t"))


def student_p(t: float | None, freedom: float) -> float | None:
    """Two-sided p of a t statistic: the tail of Student's distribution by Simpson's rule over its angle."""
    if t is None or freedom <= 0:
        return None
    # With t = sqrt(freedom) * tan(angle), the density is cos(angle) ** (freedom - 1) up to a constant.
    upto, steps = math.atan(abs(t) / math.sqrt(freedom)), 2000

    def area(end: float) -> float:
        h = end / steps
        at = [math.cos(i * h) ** (freedom - 1) for i in range(steps + 1)]
        return h / 3 * (at[0] + at[-1] + 4 * sum(at[1:-1:2]) + 2 * sum(at[2:-1:2]))

    return max(0.0, 1 - area(upto) / area(math.pi / 2))


def studentized_range_p(q: float, runs: int, freedom: float) -> float:
    """P(range of `runs` standard normals over an independent deviation of so many degrees of freedom >= q)."""
    z = np.linspace(-8, 8, 801)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    s = np.linspace(max(1e-3, 1 - 8 / math.sqrt(2 * freedom)), 1 + 8 / math.sqrt(2 * freedom), 241)
    logs = (freedom - 1) * np.log(s) - freedom * s * s / 2
    weight = np.exp(logs - logs.max())
    within = [float(np.trapezoid(runs * density * np.clip(np.interp(z + q * v, z, below, right=1.0) - below, 0, 1) ** (runs - 1), z)) for v in s]
    return float(min(1.0, max(0.0, 1 - np.trapezoid(weight * np.array(within), s) / np.trapezoid(weight, s))))


def student_test(metrics: DataFrame, max_p: float = 0.05) -> DataFrame:
    """metric, run_a, run_b, p, significant by the paired t test, of every two runs; p is null without spread."""
    counts = metrics.groupBy("metric", "run").count().groupBy("metric").agg(F.min("count").alias("n"))
    rows = compare_all_pairs(metrics).join(counts, "metric")  # a row per metric and two runs
    of = F.udf(lambda t, n: student_p(t, n - 1), "double")
    return rows.select("metric", "run_a", "run_b", of("t", "n").alias("p")).withColumn("significant", F.coalesce(F.col("p") <= max_p, F.lit(False)))


def tukey_test(metrics: DataFrame, max_p: float = 0.05) -> DataFrame:
    """metric, run_a, run_b, p, significant by Tukey's honest significant differences over all runs, queries as blocks."""
    by_query, by_run, all_ = Window.partitionBy("metric", "query_id"), Window.partitionBy("metric", "run"), Window.partitionBy("metric")
    left = metrics.select("metric", "query_id", "run", "value", F.avg("value").over(by_query).alias("q"), F.avg("value").over(by_run).alias("m"), F.avg("value").over(all_).alias("g"))
    error = left.groupBy("metric").agg(F.sum(F.pow(F.col("value") - F.col("q") - F.col("m") + F.col("g"), 2)).alias("ss"), F.count_distinct("run").alias("k"), F.count_distinct("query_id").alias("n"))
    rows = compare_all_pairs(metrics).join(error, "metric")
    freedom = (F.col("k") - 1) * (F.col("n") - 1)
    q = F.abs("delta") / F.sqrt(F.col("ss") / F.nullif(freedom, F.lit(0)) / F.col("n"))
    of = F.udf(lambda q, k, f: None if q is None or not f else studentized_range_p(q, k, f), "double")
    spread = F.when(F.round("ss", 12) > 0, q)
    return rows.select("metric", "run_a", "run_b", of(spread, "k", freedom).alias("p")).withColumn("significant", F.coalesce(F.col("p") <= max_p, F.lit(False)))


def compare_pair(metrics: DataFrame, a: str, b: str, resamples: int = RESAMPLES, seed: int = 42) -> DataFrame:
    """One row per metric: means, delta, win, loss, tie, bootstrap interval, signed-rank and permutation p of run b against run a."""
    pairs = paired(metrics, a, b)
    return pair_summary(pairs).join(bootstrap_ci(pairs, resamples, seed=seed), "metric").join(wilcoxon_p(pairs), "metric").join(permutation_p(pairs, resamples, seed), "metric")


def fisher_p(metrics: DataFrame, permutations: int = RESAMPLES, seed: int = 42, max_p: float = 0.05) -> DataFrame:
    """metric, run_a, run_b, p, significant for every two runs: the sign-flip (randomisation) test for each."""
    left = metrics.select(F.col("run").alias("run_a"), "query_id", "metric", F.col("value").alias("a"))
    right = metrics.select(F.col("run").alias("run_b"), "query_id", "metric", F.col("value").alias("b"))
    both = left.join(right, ["query_id", "metric"]).where("run_a < run_b").withColumn("d", F.col("b") - F.col("a"))
    key = F.to_json(F.struct("metric", "run_a", "run_b"))
    tested = permutation_p(both.withColumn("metric", key), permutations, seed)
    named = F.from_json("metric", "metric string, run_a string, run_b string")
    return tested.select(named.alias("k"), "p").select("k.metric", "k.run_a", "k.run_b", "p", (F.col("p") <= max_p).alias("significant"))
