"""Analytics over logs of iterations (run, iter, hpwl): schedules, plateaus, divergence, best solutions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalar import logistic

c = F.col


#: Rows of a run that are read together.
BLOCK = 10_000


def _order():
    return Window.partitionBy("run", "_block").orderBy("iter")


def _blocks(log: DataFrame, halo: int) -> DataFrame:
    """The log with _block, and _own: blocks of BLOCK rows of a run, each with the `halo` rows before it (_own false)."""
    own = F.floor((c("iter") - 1) / BLOCK)
    late = (c("iter") - 1) % BLOCK >= BLOCK - halo
    return log.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_own", c("_block") == own)


def _best_before(log: DataFrame) -> DataFrame:
    """run, _block, _least: the best value of all blocks before one."""
    own = log.groupBy("run", F.floor((c("iter") - 1) / BLOCK).alias("_block")).agg(F.min("hpwl").alias("m"))
    w = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("run", "_block", F.min("m").over(w).alias("_least"))


def wa_schedule(log: DataFrame, base: float) -> DataFrame:
    """run, iter, gamma: base * 10 ** ((overflow - 0.1) * 20 / 9 - 1), with overflow = hpwl / 1000, at most 1."""
    overflow = F.least(F.lit(1.0), c("hpwl") / 1000)
    return log.select("run", "iter", F.round(base * F.pow(F.lit(10.0), (overflow - 0.1) * 20 / 9 - 1), 6).alias("gamma"))


def weight_steps(log: DataFrame) -> DataFrame:
    """run, iter, mu: the factor of the density weight from the change of hpwl, 1.1 ** (1 - change / 100) within
    [0.75, 1.1]; null at the first row."""
    change = c("hpwl") - F.lag("hpwl").over(_order())
    mu = F.round(F.least(F.lit(1.1), F.greatest(F.lit(0.75), F.pow(F.lit(1.1), 1 - change / 100))), 6)
    return _blocks(log, 1).withColumn("mu", mu).where("_own").select("run", "iter", "mu")


def ramp(log: DataFrame) -> DataFrame:
    """run, iter, weight: a logistic ramp round iteration 100."""
    return log.select("run", "iter", F.round(logistic((c("iter") - 100) / 20.0), 6).alias("weight"))


def plateaus(log: DataFrame, window: int, threshold: float) -> DataFrame:
    """run, iter, flat: whether (max - min) / mean of the last `window` rows is below the threshold; null before."""
    w = _order().rowsBetween(-(window - 1), 0)
    spread = (F.max("hpwl").over(w) - F.min("hpwl").over(w)) / F.avg("hpwl").over(w)
    flat = F.when(F.count("*").over(w) == window, spread < threshold)
    return _blocks(log, window - 1).withColumn("flat", flat).where("_own").select("run", "iter", "flat")


def divergence(log: DataFrame, window: int, ratio: float) -> DataFrame:
    """run, iter, diverged, rises: whether the mean of the last rows is above `ratio` times the best so far, and how
    many of them rose."""
    w = _order().rowsBetween(-(window - 1), 0)
    rows = _blocks(log, window).withColumn("up", F.coalesce((c("hpwl") > F.lag("hpwl").over(_order())).cast("bigint"), F.lit(0)))
    least = F.min(F.when(c("_own"), c("hpwl"))).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"n": F.count("*").over(w), "mean": F.avg("hpwl").over(w), "rises": F.sum("up").over(w), "least": least}).where("_own")
    rows = rows.join(_best_before(log), ["run", "_block"])
    return rows.select("run", "iter", F.when(c("n") == window, c("mean") > ratio * F.least("least", "_least")).alias("diverged"), "rises")


def best_so_far(log: DataFrame) -> DataFrame:
    """run, iter, hpwl of the rows that are better than all before."""
    before = F.min("hpwl").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    rows = _blocks(log, 0).withColumn("b", before).join(_best_before(log), ["run", "_block"]).withColumn("b", F.least("b", "_least"))
    return rows.where("b is null or hpwl < b").select("run", "iter", "hpwl")


def best_solution(log: DataFrame) -> DataFrame:
    """run, iter, hpwl of the best row; of equal ones the first."""
    return log.groupBy("run").agg(F.min(F.struct("hpwl", "iter")).alias("b")).select("run", "b.iter", "b.hpwl")


def best_timing(log: DataFrame, least: float) -> DataFrame:
    """run, iter of the best row among those of at least `least`."""
    return best_solution(log.where(c("hpwl") >= least)).select("run", "iter")


def nesterov(spark, n: int) -> DataFrame:
    """k, a: the first n coefficients a' = (1 + sqrt(4 a a + 1)) / 2 from 1; a few numbers, so the driver makes them."""
    out = [1.0]
    while len(out) < n:
        out.append((1 + (4 * out[-1] ** 2 + 1) ** 0.5) / 2)
    return spark.createDataFrame([(k, round(a, 9)) for k, a in enumerate(out[:n])], "k bigint, a double")


def early_stop(log: DataFrame, lives: int = 3, patience: int = 20, window: int = 10, threshold: float = 0.05) -> DataFrame:
    """run, stop_iter: where a run would stop: after `lives` plateaus, or `patience` rows without a better one.

    The rule depends on what came before, so a run is read in order, batch by batch, with a state of a few numbers."""
    rows = log.repartition("run").sortWithinPartitions("run", "iter")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done, best, since, left, tail = None, {}, 0.0, 0, 0, []
        for b in batches:
            for r, i, v in b.itertuples(index=False):
                if r != now:
                    now, best, since, left, tail = r, float("inf"), 0, lives, []
                    done[r] = None
                if done[r] is not None:
                    continue
                best, since = (v, 0) if v < best else (best, since + 1)
                tail = [*tail, v][-window:]
                if len(tail) == window and (max(tail) - min(tail)) / (sum(tail) / window) < threshold:
                    left, tail = left - 1, []
                if not left or since >= patience:
                    done[r] = i
        yield pd.DataFrame({"run": list(done), "stop_iter": pd.array(list(done.values()), dtype="Int64")})

    return rows.select("run", "iter", "hpwl").mapInPandas(run, "run string, stop_iter bigint")
