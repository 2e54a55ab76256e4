"""Counts, masks and derived columns of a netlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalar import ceil_div, floor_div

c = F.col


def pins_per_node(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """node_id, n_pins; nodes without pins have 0."""
    n = pins.groupBy("node_id").agg(F.count("*").alias("n_pins"))
    return nodes.select("node_id").join(n, "node_id", "left").na.fill(0, ["n_pins"])


def design_stats(nodes: DataFrame, nets: DataFrame, pins: DataFrame) -> DataFrame:
    """One row: numbers of nodes, nets, pins, macros, empty and masked nets, and the cells' area."""
    a = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(c("h") > 2.01).alias("n_macros"), F.sum(c("w") * c("h")).alias("area"))
    b = nets.agg(F.count("*").alias("n_nets"), F.count_if(c("degree") == 0).alias("n_empty"), F.count_if("mask").alias("n_masked"), F.sum("degree").alias("n_pins"), F.max("degree").alias("max_degree"))
    return a.join(b)  # one row each


def macro_flags(nodes: DataFrame, share: int = 999) -> DataFrame:
    """node_id, is_macro: higher than 2.01 rows, and over ten times the mean area of the smallest `share` per mille.

    The areas' counts stand in for a sort of all nodes: a histogram of areas, cut at its rank."""
    area = c("w") * c("h")
    hist = nodes.groupBy(area.alias("a")).agg(F.count("*").alias("n"))
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("a"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    take = F.least("n", F.greatest(F.lit(0), F.floor(c("all") * share / 1000) - (c("upto") - c("n"))))
    mean = run.agg((F.sum(take * c("a")) / F.sum(take)).alias("mean"))
    return nodes.join(F.broadcast(mean)).select("node_id", ((c("h") > 2.01) & (area > 10 * c("mean") / 4)).alias("is_macro"))


def cell_clamp(nodes: DataFrame, bin_size: float) -> DataFrame:
    """node_id, cw, ch, ratio: sizes clamped to at least sqrt(2) bins, and the area over the clamped area."""
    cw, ch = F.greatest("w", F.lit(2**0.5 * bin_size)), F.greatest("h", F.lit(2**0.5 * bin_size))
    return nodes.select("node_id", F.round(cw, 6).alias("cw"), F.round(ch, 6).alias("ch"), F.round(c("w") * c("h") / (cw * ch), 6).alias("ratio"))


def filler_stats(nodes: DataFrame, die_area: float, target: float) -> DataFrame:
    """n_fillers, filler_w, filler_h: the mean width of the middle nine tenths by width, and how many such cells fill
    what the target density leaves. Widths are few, so a histogram replaces the sort of all nodes."""
    cells = nodes.where("h <= 2.01")
    hist = cells.groupBy("w").agg(F.count("*").alias("n"), F.sum(c("w") * c("h")).alias("area"))
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("w"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    low, high = F.floor(c("all") * 5 / 100), F.floor(c("all") * 95 / 100)
    take = F.greatest(F.lit(0), F.least("upto", high) - F.greatest(c("upto") - c("n"), low))
    one = run.agg((F.sum(take * c("w")) / F.sum(take)).alias("fw"), F.sum("area").alias("area"))
    room = F.greatest(F.lit(0.0), F.lit(die_area) * target - c("area"))
    return one.select(F.round(room / c("fw")).cast("bigint").alias("n_fillers"), F.round("fw", 6).alias("filler_w"), F.lit(1.0).alias("filler_h"))


def region_area(nodes: DataFrame, fence: float) -> DataFrame:
    """Per cell type: cells, area, and what they leave free of a fence of area `fence`."""
    return nodes.groupBy("celltype").agg(F.count("*").alias("n"), F.sum(c("w") * c("h")).alias("area")).withColumn("free", F.lit(fence) - c("area"))


def missing_names(pins: DataFrame, nodes: DataFrame, nets: DataFrame) -> DataFrame:
    """kind, id of nodes without pins and of nets without pins: the look-ups that find nothing."""
    a = nodes.join(pins, "node_id", "left_anti").select(F.lit("node").alias("kind"), c("node_id").alias("id"))
    b = nets.join(pins, "net_id", "left_anti").select(F.lit("net").alias("kind"), c("net_id").alias("id"))
    return a.unionByName(b)


def node_classes(nodes: DataFrame, pins: DataFrame) -> DataFrame:
    """node_id, node_type by fixed, connected and kind; the highest layer is fixed, size 1 is an IO pin."""
    joined = nodes.join(pins.select("node_id").distinct().withColumn("on", F.lit(True)), "node_id", "left")
    on, fixed, io = c("on").isNotNull(), c("layer") == 5, c("size") == 1
    kind = F.when(io & on, "IOPin").when(io, "FloatIOPin").when(fixed & on, "Fix").when(fixed, "FloatFix").when(on, "Mov").otherwise("FloatMov")
    return joined.select("node_id", kind.alias("node_type"))


def special_tags(nodes: DataFrame) -> DataFrame:
    """node_id, tag of cells by the prefix of their type's name."""
    return nodes.select("node_id", F.when(c("celltype").startswith("Brand#1"), 1).when(c("celltype").startswith("Brand#2"), 2).otherwise(0).cast("bigint").alias("tag"))


def clamp_positions(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """node_id, cx, cy: centres held inside the die by 1e-4."""
    hold = lambda p, s, most: F.least(F.greatest(p, s / 2 + 1e-4), most - s / 2 - 1e-4)
    return nodes.select("node_id", F.round(hold(c("lx") + c("w") / 2 - 8, c("w"), F.lit(width)), 6).alias("cx"), F.round(hold(c("ly") + c("h") / 2 + 8, c("h"), F.lit(height)), 6).alias("cy"))


def snapped(nodes: DataFrame, site: float, tolerance: float = 1e-4) -> DataFrame:
    """node_id and lx in sites: floored, ceiled and rounded, where a distance within the tolerance counts as none."""
    x = c("lx")
    return nodes.select("node_id", floor_div(x, site, tolerance).alias("low"), ceil_div(x, site, tolerance).alias("high"), floor_div(x, site, 0.5).alias("near"))


def scaled(nodes: DataFrame, site: float, dx: float, dy: float) -> DataFrame:
    """Geometry shifted to the origin and in units of sites."""
    return nodes.select("node_id", ((c("lx") - dx) / site).alias("lx"), ((c("ly") - dy) / site).alias("ly"), (c("w") / site).alias("w"), (c("h") / site).alias("h"))


def oriented(nodes: DataFrame) -> DataFrame:
    """node_id, orient and width, height, and the offset of a pin at (1/4, 1/2) of the cell after it.

    Orientations 0 to 7: N, W, S, E, FN, FW, FS, FE; odd ones swap the sides."""
    o, w, h = c("size") % 8, c("w"), c("h")
    x, y = w / 4, h / 2
    px = F.when(o == 0, x).when(o == 1, h - y).when(o == 2, w - x).when(o == 3, y).when(o == 4, w - x).when(o == 5, y).when(o == 6, x).otherwise(h - y)
    py = F.when(o == 0, y).when(o == 1, x).when(o == 2, h - y).when(o == 3, w - x).when(o == 4, y).when(o == 5, x).when(o == 6, h - y).otherwise(w - x)
    swap = o % 2 == 1
    return nodes.select("node_id", o.alias("orient"), F.when(swap, h).otherwise(w).alias("ow"), F.when(swap, w).otherwise(h).alias("oh"), px.alias("px"), py.alias("py"))


def spread_positions(nodes: DataFrame, width: int, height: int) -> DataFrame:
    """node_id, x, y: places that a congruential generator of the id spreads over the die."""
    k = c("node_id")
    return nodes.select("node_id", ((k * 1103515245 + 12345) % 2147483648 % width).alias("x"), ((k * 22695477 + 1) % 2147483648 % height).alias("y"))


def inflated_offsets(pins: DataFrame, nodes: DataFrame) -> DataFrame:
    """pin_id and its offset times the inflation of its node, which is 1 + layer / 8; fixed nodes keep theirs."""
    ratio = F.when(c("layer") == 5, 1.0).otherwise(1 + c("layer") / 8)
    return pins.join(nodes.select("node_id", "layer"), "node_id").select("pin_id", (c("rel_cx") * ratio).alias("rel_cx"), (c("rel_cy") * ratio).alias("rel_cy"))
