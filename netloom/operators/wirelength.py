"""Wirelength of a hypergraph netlist: half perimeter in its roundings, smooth weighted averages and their gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalar import half_away, half_even

c = F.col


def tidy(x, digits: int = 6):
    """x rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def pin_positions(pins: DataFrame, nodes: DataFrame) -> DataFrame:
    """pins with their absolute centres px, py and their node's layer."""
    own = nodes.select("node_id", "lx", "ly", "w", "h", "layer")
    return pins.join(own, "node_id").select("pin_id", "net_id", "node_id", "layer", (c("lx") + c("w") / 2 + c("rel_cx")).alias("px"), (c("ly") + c("h") / 2 + c("rel_cy")).alias("py"))


def net_boxes(positions: DataFrame) -> DataFrame:
    """net_id, degree and the bounding box of each net that has pins."""
    return positions.groupBy("net_id").agg(F.count("*").alias("degree"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))


def hpwl_per_net(nets: DataFrame, positions: DataFrame) -> DataFrame:
    """net_id, hpwl_x, hpwl_y of every net; a net without pins has 0."""
    box = net_boxes(positions).select("net_id", (c("x1") - c("x0")).alias("hpwl_x"), (c("y1") - c("y0")).alias("hpwl_y"))
    return nets.select("net_id").join(box, "net_id", "left").na.fill(0.0, ["hpwl_x", "hpwl_y"])


def hpwl_exact(positions: DataFrame) -> DataFrame:
    """The design's length: each net's extent per axis rounded half to even, then summed."""
    box = net_boxes(positions)
    return box.agg(F.sum(half_even(c("x1") - c("x0")) + half_even(c("y1") - c("y0"))).alias("hpwl"))


def hpwl_masked(positions: DataFrame, most: int, scale: float = 1.0) -> DataFrame:
    """The length of nets with 2 to `most` pins, rounded half away from zero and scaled."""
    box = net_boxes(positions).where(c("degree").between(2, most))
    return box.agg((F.sum(half_away(c("x1") - c("x0")) + half_away(c("y1") - c("y0"))) * scale).alias("hpwl"), F.count("*").alias("n_nets"))


def hpwl_dbu(positions: DataFrame, unit: int = 64) -> DataFrame:
    """The length in whole database units of nets with two pins or more."""
    dbu = positions.select("net_id", (c("px") * unit).cast("bigint").alias("px"), (c("py") * unit).cast("bigint").alias("py"))
    return net_boxes(dbu).where("degree >= 2").agg(F.sum(c("x1") - c("x0") + c("y1") - c("y0")).alias("hpwl"))


def hpwl_total(positions: DataFrame) -> DataFrame:
    """The unrounded length per axis."""
    return net_boxes(positions).agg(F.sum(c("x1") - c("x0")).alias("hpwl_x"), F.sum(c("y1") - c("y0")).alias("hpwl_y"))


def _wa(positions: DataFrame, gamma: float, most: int):
    """Positions of counted nets with, per axis, the sums that the weighted average needs, in one pass per net."""
    by = Window.partitionBy("net_id")
    rows = positions.withColumn("degree", F.count("*").over(by)).where(c("degree").between(2, most))
    for a in "xy":
        p = c(f"p{a}")
        rows = rows.withColumns({f"hi_{a}": F.max(p).over(by), f"lo_{a}": F.min(p).over(by)})
        rows = rows.withColumns({f"e_{a}": F.exp((p - c(f"hi_{a}")) / gamma), f"f_{a}": F.exp((c(f"lo_{a}") - p) / gamma)})
        rows = rows.withColumns({f"se_{a}": F.sum(f"e_{a}").over(by), f"sf_{a}": F.sum(f"f_{a}").over(by), f"xe_{a}": F.sum(c(f"e_{a}") * p).over(by), f"xf_{a}": F.sum(c(f"f_{a}") * p).over(by)})
    return rows


def wa_wirelength(positions: DataFrame, gamma: float, most: int) -> DataFrame:
    """net_id, wa_x, wa_y: the weighted-average length of each counted net, its exponents measured from the extremes."""
    rows = _wa(positions, gamma, most)
    one = lambda a: F.first(c(f"xe_{a}") / c(f"se_{a}") - c(f"xf_{a}") / c(f"sf_{a}"))
    return rows.groupBy("net_id").agg(tidy(one("x")).alias("wa_x"), tidy(one("y")).alias("wa_y"))


def _pin_gradient(positions: DataFrame, gamma: float, most: int) -> DataFrame:
    rows = _wa(positions, gamma, most)

    def grad(a):
        p = c(f"p{a}")
        up = c(f"e_{a}") / c(f"se_{a}") * (1 + (p - c(f"xe_{a}") / c(f"se_{a}")) / gamma)
        down = c(f"f_{a}") / c(f"sf_{a}") * (1 - (p - c(f"xf_{a}") / c(f"sf_{a}")) / gamma)
        return up - down

    return rows.select("pin_id", "net_id", "node_id", grad("x").alias("gx"), grad("y").alias("gy"))


def wa_pin_gradient(positions: DataFrame, gamma: float, most: int) -> DataFrame:
    """pin_id, gx, gy: the gradient of the weighted-average length by each pin's place."""
    return _pin_gradient(positions, gamma, most).select("pin_id", tidy(c("gx")).alias("gx"), tidy(c("gy")).alias("gy"))


def node_gradient(positions: DataFrame, gamma: float, most: int) -> DataFrame:
    """node_id, gx, gy: pin gradients summed over each node's pins, as they come."""
    return _pin_gradient(positions, gamma, most).groupBy("node_id").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))


def wa_node_gradient(positions: DataFrame, gamma: float, most: int) -> DataFrame:
    """node_gradient(), rounded."""
    return node_gradient(positions, gamma, most).select("node_id", tidy(c("gx")).alias("gx"), tidy(c("gy")).alias("gy"))


def root_sink_wa(stars: DataFrame, gamma: float) -> DataFrame:
    """net_id, wl: the two-point weighted average from the root to each sink, weighted by the sink's layer, summed.

    Two points have the closed form d * tanh(d / 2g), which needs no exponent that could overflow."""
    two = lambda a, b: (a - b) * F.tanh((a - b) / (2 * gamma))
    weight = 1 + c("layer") / 8
    return stars.groupBy("net_id").agg(tidy(F.sum(weight * (two(c("px"), c("root_px")) + two(c("py"), c("root_py"))))).alias("wl"))


def preconditioned(gradient: DataFrame, pins: DataFrame, nodes: DataFrame, coef: float, weight: float) -> DataFrame:
    """node_id, gx, gy: node gradients over max(1, pins + coef * weight * area)."""
    n = pins.groupBy("node_id").agg(F.count("*").alias("n"))
    by = F.greatest(F.lit(1.0), c("n") + coef * weight * c("w") * c("h"))
    return gradient.join(n, "node_id").join(nodes.select("node_id", "w", "h"), "node_id").select("node_id", tidy(c("gx") / by).alias("gx"), tidy(c("gy") / by).alias("gy"))


def norm_ratio(gradient: DataFrame) -> DataFrame:
    """L1 and L2 norms of a gradient per axis, and their ratios."""
    r = gradient.agg(F.sum(F.abs("gx")).alias("a"), F.sum(F.abs("gy")).alias("b"), F.sqrt(F.sum(c("gx") * c("gx"))).alias("p"), F.sqrt(F.sum(c("gy") * c("gy"))).alias("q"))
    return r.select(F.round(c("a") / c("b"), 4).alias("l1_ratio"), F.round(c("p") / c("q"), 4).alias("l2_ratio"))
