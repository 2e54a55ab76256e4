"""Rectangles on a regular grid: density, overflow, gathers, blurs, transforms. Rectangles meet bins by explode."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def to_bins(boxes: DataFrame, bin_size: float, nx: int, ny: int, keep: list[str], inclusive: bool = False) -> DataFrame:
    """keep, ix, iy, part: one row for each bin that a box (x0, x1, y0, y1) overlaps, with the overlap's area.

    inclusive also lists bins that a box only touches at their low edge."""

    def ids(a, n):
        low = F.floor(c(f"{a}0") / bin_size)
        high = F.floor(c(f"{a}1") / bin_size) if inclusive else F.ceil(c(f"{a}1") / bin_size) - 1
        low, high = F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(n - 1), high).cast("int")
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    rows = boxes.select(*keep, "x0", "x1", "y0", "y1", F.explode(ids("x", nx)).alias("ix"))
    rows = rows.select(*keep, "x0", "x1", "y0", "y1", "ix", F.explode(ids("y", ny)).alias("iy"))
    over = lambda a: F.greatest(F.lit(0.0), F.least(c(f"{a}1"), (c(f"i{a}") + 1) * bin_size) - F.greatest(c(f"{a}0"), c(f"i{a}") * bin_size))
    return rows.select(*keep, c("ix").cast("bigint").alias("ix"), c("iy").cast("bigint").alias("iy"), (over("x") * over("y")).alias("part"))


def node_boxes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", "layer", c("lx").alias("x0"), (c("lx") + c("w")).alias("x1"), c("ly").alias("y0"), (c("ly") + c("h")).alias("y1"))


def density_map(nodes: DataFrame, bin_size: float, nx: int, ny: int) -> DataFrame:
    """ix, iy, density of the bins that any node covers."""
    parts = to_bins(node_boxes(nodes), bin_size, nx, ny, ["node_id"])
    return parts.groupBy("ix", "iy").agg((F.sum("part") / (bin_size * bin_size)).alias("density"))


def density_naive(nodes: DataFrame, bin_size: float, nx: int, ny: int, target: float) -> DataFrame:
    """ix, iy, density with boxes cut to the die and each bin clamped to [0, 1] times the target."""
    hold = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
    b = node_boxes(nodes).select("node_id", hold(c("x0"), nx * bin_size).alias("x0"), hold(c("x1"), nx * bin_size).alias("x1"), hold(c("y0"), ny * bin_size).alias("y0"), hold(c("y1"), ny * bin_size).alias("y1"))
    parts = to_bins(b.where("x1 - x0 > 1e-4 and y1 - y0 > 1e-4"), bin_size, nx, ny, ["node_id"])
    return parts.groupBy("ix", "iy").agg((F.least(F.lit(1.0), F.sum("part") / (bin_size * bin_size)) * target).alias("density"))


def density_overflow(density: DataFrame, nodes: DataFrame, bin_size: float, target: float) -> DataFrame:
    """overflow_area, overflow (over the cells' area) and the largest density."""
    area = nodes.agg(F.sum(c("w") * c("h")).alias("area"))
    over = density.agg(F.sum(F.greatest(F.lit(0.0), c("density") - target) * bin_size * bin_size).alias("overflow_area"), F.max("density").alias("max_density"))
    return over.join(area).select("overflow_area", F.round(c("overflow_area") / c("area"), 9).alias("overflow"), "max_density")


def density_gather(nodes: DataFrame, density: DataFrame, bin_size: float, nx: int, ny: int) -> DataFrame:
    """node_id, force: the density of a node's bins, weighted by overlap."""
    parts = to_bins(node_boxes(nodes), bin_size, nx, ny, ["node_id"])
    return parts.join(density, ["ix", "iy"]).groupBy("node_id").agg(F.sum(c("part") * c("density")).alias("force"))


def inflate_ratio(nodes: DataFrame, congestion: DataFrame, bin_size: float, nx: int, ny: int, how: str) -> DataFrame:
    """node_id, ratio: the congestion of the covered bins, their mean weighted by overlap or their max."""
    parts = to_bins(node_boxes(nodes), bin_size, nx, ny, ["node_id"], inclusive=how == "max").join(congestion, ["ix", "iy"])
    one = F.max("value") if how == "max" else F.round(F.sum(c("part") * c("value")) / F.sum("part"), 9)
    return parts.groupBy("node_id").agg(one.alias("ratio"))


def box_blur(density: DataFrame, reach: int, nx: int, ny: int) -> DataFrame:
    """ix, iy, value: the mean over the (2 * reach + 1)-square round each bin, zeros outside; bins spread to neighbours."""
    side = range(-reach, reach + 1)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in side for j in side]))
    spread = density.select("ix", "iy", "density", around.alias("o")).select((c("ix") + c("o.dx")).alias("ix"), (c("iy") + c("o.dy")).alias("iy"), "density")
    inside = c("ix").between(0, nx - 1) & c("iy").between(0, ny - 1)
    return spread.where(inside).groupBy("ix", "iy").agg(F.round(F.sum("density") / (len(side) * len(side)), 9).alias("value"))


def gauss_blur(density: DataFrame, nx: int, ny: int, reach: int = 3, sigma: float = 1.0) -> DataFrame:
    """ix, iy, value: the mean over the (2 * reach + 1)-square round each bin under a Gaussian whose weights sum to 1,
    zeros outside."""
    side = range(-reach, reach + 1)
    one = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in side}
    total = sum(one.values()) ** 2
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(one[i] * one[j] / total).alias("w")) for i in side for j in side]))
    spread = density.select("density", "ix", "iy", around.alias("o")).select((c("ix") + c("o.dx")).alias("ix"), (c("iy") + c("o.dy")).alias("iy"), (c("density") * c("o.w")).alias("v"))
    return spread.where(c("ix").between(0, nx - 1) & c("iy").between(0, ny - 1)).groupBy("ix", "iy").agg(F.round(F.sum("v"), 9).alias("value"))


def blur_argmax(blurred: DataFrame) -> DataFrame:
    """The bin of the largest value; of equal ones the first by ix, then iy."""
    best = F.max(F.struct("value", (-c("ix")).alias("x"), (-c("iy")).alias("y")))
    return blurred.agg(best.alias("b")).select((-c("b.x")).alias("ix"), (-c("b.y")).alias("iy"), c("b.value").alias("value"))


def initial_density(nodes: DataFrame, bin_size: float, nx: int, ny: int, target: float) -> DataFrame:
    """The clamped density of fixed nodes, those of the highest layer."""
    return density_naive(nodes.where("layer = 5"), bin_size, nx, ny, target)


def _basis(spark, n: int, name: str) -> DataFrame:
    """k, i, cosine of a length-n transform, n * n rows out of a range; broadcast for n up to 512."""
    k, i = F.floor(c("id") / n), c("id") % n
    scale = F.when(k == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))
    rows = spark.range(n * n).select(k.cast("bigint").alias(f"k{name}"), i.cast("bigint").alias(f"i{name}"), (scale * F.cos(math.pi * (2 * i + 1) * k / (2 * n))).alias(f"b{name}"))
    return F.broadcast(rows) if n <= 512 else rows


def dct2(grid: DataFrame, nx: int, ny: int, value: str = "density") -> DataFrame:
    """kx, ky, coef: the orthonormal two-dimensional cosine transform, one axis after the other, by joins with a basis."""
    spark = grid.sparkSession
    rows = grid.join(_basis(spark, nx, "x"), "ix").groupBy("kx", "iy").agg(F.sum(c(value) * c("bx")).alias("v"))
    return rows.join(_basis(spark, ny, "y"), "iy").groupBy("kx", "ky").agg(F.sum(c("v") * c("by")).alias("coef"))


def idct2(coefs: DataFrame, nx: int, ny: int, value: str = "coef") -> DataFrame:
    """ix, iy, value: the inverse of dct2()."""
    spark = coefs.sparkSession
    rows = coefs.join(_basis(spark, nx, "x"), "kx").groupBy("ix", "ky").agg(F.sum(c(value) * c("bx")).alias("v"))
    return rows.join(_basis(spark, ny, "y"), "ky").groupBy("ix", "iy").agg(F.sum(c("v") * c("by")).alias("value"))


def poisson(coefs: DataFrame, nx: int, ny: int) -> DataFrame:
    """kx, ky, coef of the potential: coefficients over the squared frequencies, none at zero frequency."""
    wx, wy = c("kx") * math.pi / nx, c("ky") * math.pi / ny
    return coefs.where("kx > 0 or ky > 0").select("kx", "ky", (c("coef") / (wx * wx + wy * wy)).alias("coef"))


def poisson_energy(grid: DataFrame, nx: int, ny: int) -> DataFrame:
    """energy: the sum of potential times density; by orthonormality, over coefficients instead of bins."""
    a = dct2(grid, nx, ny)
    w = (c("kx") * math.pi / nx) ** 2 + (c("ky") * math.pi / ny) ** 2
    return a.where("kx > 0 or ky > 0").agg(F.round(F.sum(c("coef") * c("coef") / w), 3).alias("energy"))


def potential_energy(grid: DataFrame, nx: int, ny: int) -> DataFrame:
    """The same energy in space: potential by the inverse transform, joined with the density."""
    p = idct2(poisson(dct2(grid, nx, ny), nx, ny), nx, ny)
    return p.join(grid, ["ix", "iy"]).agg(F.round(F.sum(c("value") * c("density")), 3).alias("energy"))
