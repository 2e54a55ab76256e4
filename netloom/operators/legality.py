"""Legality checks, row structure, and rectangles against rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def boundary(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """Nodes that leave the die."""
    return nodes.where((c("lx") < 0) | (c("lx") + c("w") > width) | (c("ly") < 0) | (c("ly") + c("h") > height)).select("node_id")


def alignment(nodes: DataFrame, site: float, row: float, tolerance: float = 1e-6) -> DataFrame:
    """node_id, off_site, off_row of nodes that are off the site or row grid."""
    off = lambda x, step: F.abs(x / step - F.floor(x / step + 0.5)) > tolerance
    rows = nodes.select("node_id", off(c("lx"), site).alias("off_site"), off(c("ly"), row).alias("off_row"))
    return rows.where("off_site or off_row")


def fence(nodes: DataFrame, fences: DataFrame) -> DataFrame:
    """node_id, outside: the area of a node that the boxes of its cell type's fence leave uncovered."""
    own = nodes.join(fences, "celltype")
    over = F.greatest(F.lit(0.0), F.least(c("lx") + c("w"), c("fx1")) - F.greatest("lx", "fx0")) * F.greatest(F.lit(0.0), F.least(c("ly") + c("h"), c("fy1")) - F.greatest("ly", "fy0"))
    left = own.groupBy("node_id").agg((F.first(c("w") * c("h")) - F.sum(over)).alias("outside"))
    return left.where("outside > 0")


def fences_of(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """Two boxes for each type whose name ends in 1: the lower left and upper right quarters of the die."""
    types = nodes.select("celltype").distinct().where(c("celltype").endswith("1"))
    boxes = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("fx0", "fx1", "fy0", "fy1"), b)]) for b in ((0, width / 2, 0, height / 2), (width / 2, width, height / 2, height))])
    return types.select("celltype", F.explode(boxes).alias("b")).select("celltype", "b.*")


def in_rows(nodes: DataFrame) -> DataFrame:
    """One row for each unit row that a node stands in."""
    return nodes.select("*", F.explode(F.sequence(c("ly").cast("bigint"), (c("ly") + c("h") - 1).cast("bigint"))).alias("row"))


def row_overlaps(nodes: DataFrame) -> DataFrame:
    """row, left_id, right_id, overlap of neighbours in a row (by x, then id) that overlap."""
    w = Window.partitionBy("row").orderBy("lx", "node_id")
    rows = in_rows(nodes).select("row", c("node_id").alias("right_id"), "lx", F.lag("node_id").over(w).alias("left_id"), F.lag(c("lx") + c("w")).over(w).alias("edge"))
    return rows.where("edge > lx").select("row", "left_id", "right_id", (c("edge") - c("lx")).alias("overlap"))


def verdict(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """check_name, violations of the four checks; a check without violations has 0."""
    found = [
        ("boundary", boundary(nodes, width, height)),
        ("alignment", alignment(nodes, 2.0, 1.0)),
        ("fence", fence(nodes, fences_of(nodes, width, height))),
        ("overlap", row_overlaps(nodes)),
    ]
    out = None
    for name, df in found:
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def blanks(nodes: DataFrame, width: float) -> DataFrame:
    """row, x0, x1 of the free gaps of each row that holds a node: what the running maximum of ends leaves."""
    w = Window.partitionBy("row").orderBy("lx", "node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = in_rows(nodes).select("row", "lx", (c("lx") + c("w")).alias("end"), "node_id")
    gaps = rows.withColumn("x0", F.coalesce(F.max("end").over(w), F.lit(0.0))).where("lx > x0").select("row", "x0", c("lx").alias("x1"))
    tail = rows.groupBy("row").agg(F.max("end").alias("x0")).where(c("x0") < width).select("row", "x0", F.lit(width).alias("x1"))
    return gaps.unionByName(tail)


def free_space(nodes: DataFrame, width: float) -> DataFrame:
    """row, node_id, left, right: the space to a node's neighbours in its row, or to the row's ends; overlaps are negative."""
    w = Window.partitionBy("row").orderBy("lx", "node_id")
    rows = in_rows(nodes)
    left = c("lx") - F.coalesce(F.lag(c("lx") + c("w")).over(w), F.lit(0.0))
    right = F.coalesce(F.lead("lx").over(w), F.lit(width)) - c("lx") - c("w")
    return rows.select("row", "node_id", left.alias("left"), right.alias("right"))


def overlap_pairs(boxes: DataFrame, bucket: float, margin: float = 0.0) -> DataFrame:
    """a, b, ox, oy of pairs a < b of boxes (id, x0, x1, y0, y1) that overlap by more than 1e-3 on both axes, after both
    grow by margin.

    Boxes meet in grid buckets; a pair counts only in the bucket that holds the larger of its low corners, so no pair
    comes twice and no distinct() is needed."""
    grown = boxes.select("id", (c("x0") - margin).alias("x0"), "x1", (c("y0") - margin).alias("y0"), "y1")
    ids = lambda a: F.sequence(F.floor(c(f"{a}0") / bucket), F.floor(c(f"{a}1") / bucket))
    cells = grown.withColumn("gx", F.explode(ids("x"))).withColumn("gy", F.explode(ids("y")))
    l = cells.select("gx", "gy", *[c(n).alias(f"a_{n}") for n in ("id", "x0", "x1", "y0", "y1")])
    r = cells.select("gx", "gy", *[c(n).alias(f"b_{n}") for n in ("id", "x0", "x1", "y0", "y1")])
    pairs = l.join(r, ["gx", "gy"]).where("a_id < b_id")
    pairs = pairs.where((c("gx") == F.floor(F.greatest("a_x0", "b_x0") / bucket)) & (c("gy") == F.floor(F.greatest("a_y0", "b_y0") / bucket)))
    over = lambda a: F.least(f"a_{a}1", f"b_{a}1") - F.greatest(f"a_{a}0", f"b_{a}0")
    return pairs.select(c("a_id").alias("a"), c("b_id").alias("b"), over("x").alias("ox"), over("y").alias("oy")).where("ox > 1e-3 and oy > 1e-3")


def boxes_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(c("node_id").alias("id"), c("lx").alias("x0"), (c("lx") + c("w")).alias("x1"), c("ly").alias("y0"), (c("ly") + c("h")).alias("y1"))


def cell_overlaps(nodes: DataFrame) -> DataFrame:
    """node_id, n_overlaps, area of all overlaps of a cell with others."""
    p = overlap_pairs(boxes_of(nodes), 8.0)
    both = p.select(c("a").alias("node_id"), "ox", "oy").union(p.select(c("b").alias("node_id"), "ox", "oy"))
    return both.groupBy("node_id").agg(F.count("*").alias("n_overlaps"), F.sum(c("ox") * c("oy")).alias("area"))


def metal_spacing(nodes: DataFrame, space: float) -> DataFrame:
    """layer, a, b: shapes of one layer nearer than `space` on both axes but not of one type (one owner)."""
    p = overlap_pairs(boxes_of(nodes), 8.0, space)
    own = nodes.select("node_id", "layer", "celltype")
    a, b = own.select(c("node_id").alias("a"), c("layer").alias("layer"), c("celltype").alias("ta")), own.select(c("node_id").alias("b"), c("layer").alias("lb"), c("celltype").alias("tb"))
    return p.join(a, "a").join(b, "b").where("layer = lb and ta <> tb").select("layer", "a", "b")


#: Macros are compared within blocks of the die of this size.
BLOCK_W, BLOCK_H = 128, 64


def block_pairs(macros: DataFrame) -> DataFrame:
    """Pairs a < b of macros of one layer, type and block of the die; a block holds a bounded number of macros."""
    at = [F.floor(c("lx") / BLOCK_W).alias("bx"), F.floor(c("ly") / BLOCK_H).alias("by")]
    own = lambda p: macros.select("celltype", "layer", *at, *[c(n).alias(f"{p}_{n}") for n in ("node_id", "lx", "ly", "w", "h")])
    return own("a").join(own("b"), ["celltype", "layer", "bx", "by"]).where("a_node_id < b_node_id")


def constraint_graph(macros: DataFrame) -> DataFrame:
    """a, b, kind, gap: pairs of macros (block_pairs), apart by the axis of the larger gap; a comes first on it."""
    p = block_pairs(macros)
    gx = F.greatest(c("b_lx") - c("a_lx") - c("a_w"), c("a_lx") - c("b_lx") - c("b_w"))
    gy = F.greatest(c("b_ly") - c("a_ly") - c("a_h"), c("a_ly") - c("b_ly") - c("b_h"))
    first = F.when(gx >= gy, c("a_lx") <= c("b_lx")).otherwise(c("a_ly") <= c("b_ly"))
    return p.select(F.when(first, c("a_node_id")).otherwise(c("b_node_id")).alias("a"), F.when(first, c("b_node_id")).otherwise(c("a_node_id")).alias("b"), F.when(gx >= gy, "h").otherwise("v").alias("kind"), F.greatest(gx, gy).alias("gap"))


def floorplan(nodes: DataFrame) -> DataFrame:
    """site_w, site_h and the core box over all cells."""
    return nodes.agg(F.min("w").alias("site_w"), F.min("h").alias("site_h"), F.min("lx").alias("x0"), F.min("ly").alias("y0"), F.max(c("lx") + c("w")).alias("x1"), F.max(c("ly") + c("h")).alias("y1"))


def region_membership(nodes: DataFrame, patterns: list[tuple[str, int]]) -> DataFrame:
    """node_id, region: the last pattern (name, or prefix*) in the list that fits the cell's type, else the region 0."""
    fits = lambda p: c("celltype").startswith(p[:-1]) if p.endswith("*") else c("celltype") == p
    region = F.lit(0)
    for pattern, value in patterns:
        region = F.when(fits(pattern), value).otherwise(region)
    return nodes.select("node_id", region.cast("bigint").alias("region"))


def row_segments(nodes: DataFrame, width: int) -> DataFrame:
    """row, x0, x1 of the runs of sites that no high cell blocks, in rows that hold one: gaps and islands of sites."""
    high = in_rows(nodes.where("h > 2.01"))
    rows = high.select("row").distinct().select("row", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    blocked = high.select("row", F.explode(F.sequence(c("lx").cast("int"), (c("lx") + c("w") - 1).cast("int"))).alias("x")).distinct()
    free = rows.join(blocked, ["row", "x"], "left_anti")
    w = Window.partitionBy("row").orderBy("x")
    island = free.withColumn("g", c("x") - F.row_number().over(w))
    return island.groupBy("row", "g").agg(F.min("x").cast("bigint").alias("x0"), (F.max("x") + 1).cast("bigint").alias("x1")).drop("g")


def site_counts(nodes: DataFrame, site: float) -> DataFrame:
    """node_id, contained and overlapped sites of each box on a square site grid."""
    span = lambda f, g, a, b: F.greatest(F.lit(0), g(b / site) - f(a / site))
    x0, x1, y0, y1 = c("lx"), c("lx") + c("w"), c("ly"), c("ly") + c("h")
    inside = span(F.ceil, F.floor, x0, x1) * span(F.ceil, F.floor, y0, y1)
    over = span(F.floor, F.ceil, x0, x1) * span(F.floor, F.ceil, y0, y1)
    return nodes.select("node_id", inside.cast("bigint").alias("contained"), over.cast("bigint").alias("overlapped"))


def site_map(nodes: DataFrame) -> DataFrame:
    """x, y, flags of the unit sites that cells cover: bit 0 for low cells, bit 1 for high ones."""
    sites = nodes.select(F.when(c("h") > 2.01, 2).otherwise(1).cast("bigint").alias("flag"), F.explode(F.sequence(c("lx").cast("bigint"), (c("lx") + c("w") - 1).cast("bigint"))).alias("x"), "ly", "h")
    sites = sites.select("flag", "x", F.explode(F.sequence(c("ly").cast("bigint"), (c("ly") + c("h") - 1).cast("bigint"))).alias("y"))
    return sites.groupBy("x", "y").agg(F.bit_or("flag").alias("flags"))


def edge_spacing(nodes: DataFrame) -> DataFrame:
    """row, left_id, right_id, short: neighbours nearer than the spacing of their edge classes (layers), which is
    (1 + |difference|) / 2."""
    w = Window.partitionBy("row").orderBy("lx", "node_id")
    rows = in_rows(nodes).select("row", c("node_id").alias("right_id"), "lx", "layer", F.lag("node_id").over(w).alias("left_id"), F.lag("layer").over(w).alias("ll"), F.lag(c("lx") + c("w")).over(w).alias("edge"))
    need = (1 + F.abs(c("layer") - c("ll"))) / 2
    return rows.where((c("lx") >= c("edge")) & (c("lx") - c("edge") < need)).select("row", "left_id", "right_id", (need - c("lx") + c("edge")).alias("short"))


def issues(nodes: DataFrame, nets: DataFrame, pins: DataFrame, width: float, height: float) -> DataFrame:
    """issue, n: cells off the core's right or upper edge, sizes that are no whole sites, nets without or with many pins."""
    checks = [
        ("cell_outside", nodes.where((c("lx") + c("w") > width) | (c("ly") + c("h") > height))),
        ("odd_width", nodes.where("w % 2 <> 0")),
        ("empty_net", nets.where("degree = 0")),
        ("high_fanout", nets.where("degree > 8")),
        ("unplaced_pin", pins.join(nodes, "node_id", "left_anti")),
    ]
    out = None
    for name, df in checks:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def layer_counts(nodes: DataFrame) -> DataFrame:
    """Numbers of layers, of those of even number, and whether every cell is placed."""
    return nodes.agg(F.countDistinct("layer").alias("n_layers"), F.countDistinct(F.when(c("layer") % 2 == 0, c("layer"))).alias("n_even"), F.bool_and((c("lx") >= 0) & (c("ly") >= 0)).alias("placed"))


def io_nets(pins: DataFrame, nodes: DataFrame) -> DataFrame:
    """net_id of nets with a pin on an IO cell (size 1)."""
    return pins.join(nodes.where("size = 1"), "node_id", "left_semi").select("net_id").distinct()


def merged_rects(nodes: DataFrame) -> DataFrame:
    """row, x0, x1: cells of one row that touch or overlap become one rectangle."""
    w = Window.partitionBy("row").orderBy("lx", "node_id")
    rows = in_rows(nodes).withColumn("end", c("lx") + c("w"))
    rows = rows.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("g", F.sum(F.when(c("reach").isNull() | (c("lx") > c("reach")), 1).otherwise(0)).over(w))
    return rows.groupBy("row", "g").agg(F.min("lx").alias("x0"), F.max("end").alias("x1")).drop("g")


def box_algebra(macros: DataFrame) -> DataFrame:
    """a, b and, for macros of one type, layer and block: half perimeter of the union, L1, L2 and Linf distance, parallel run."""
    p = block_pairs(macros)
    gap = lambda a, s: F.greatest(F.lit(0.0), c(f"b_{a}") - c(f"a_{a}") - c(f"a_{s}"), c(f"a_{a}") - c(f"b_{a}") - c(f"b_{s}"))
    dx, dy = gap("lx", "w"), gap("ly", "h")
    run = lambda a, s: F.least(c(f"a_{a}") + c(f"a_{s}"), c(f"b_{a}") + c(f"b_{s}")) - F.greatest(f"a_{a}", f"b_{a}")
    hull = F.greatest(c("a_lx") + c("a_w"), c("b_lx") + c("b_w")) - F.least("a_lx", "b_lx") + F.greatest(c("a_ly") + c("a_h"), c("b_ly") + c("b_h")) - F.least("a_ly", "b_ly")
    return p.select(c("a_node_id").alias("a"), c("b_node_id").alias("b"), hull.alias("half_perimeter"), (dx + dy).alias("l1"), F.round(F.sqrt(dx * dx + dy * dy), 6).alias("l2"), F.greatest(dx, dy).alias("linf"), F.greatest(run("lx", "w"), run("ly", "h")).alias("parallel_run"))


def power_stripes(nodes: DataFrame, pitch: float, width: float) -> DataFrame:
    """node_id, row, stripe: cells that stand on a vertical stripe [k * pitch, k * pitch + width) in a row of even number."""
    rows = in_rows(nodes).where("row % 2 = 0").select("node_id", "row", "lx", "w")
    rows = rows.select("*", F.explode(F.sequence(F.floor(c("lx") / pitch), F.floor((c("lx") + c("w")) / pitch))).alias("stripe"))
    at = c("stripe") * pitch
    return rows.where((c("lx") < at + width) & (c("lx") + c("w") > at)).select("node_id", "row", "stripe")


def row_rails(nodes: DataFrame) -> DataFrame:
    """row, x0, x1, orient, conflicts: rows rebuilt to one a site row, flipped in turn, and their cells whose own rail
    (power below for even sizes) is at the other side."""
    rows = in_rows(nodes)
    wrong = (c("row") % 2 == 0) != (c("size") % 2 == 0)
    return rows.groupBy("row").agg(F.min("lx").alias("x0"), F.max(c("lx") + c("w")).alias("x1"), F.count_if(wrong).alias("conflicts")).select("row", "x0", "x1", F.when(c("row") % 2 == 0, "N").otherwise("FS").alias("orient"), "conflicts")


def oriented_shapes(nodes: DataFrame) -> DataFrame:
    """node_id, x0, x1, y0, y1: an obstacle of high cells, their lower left quarter, after the cell's orientation."""
    o, w, h = c("size") % 8, c("w"), c("h")
    swap = o % 2 == 1
    ow, oh = F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)
    right, top = o.isin(2, 3, 4, 7), o.isin(1, 2, 6, 7)
    x0, y0 = c("lx") + F.when(right, ow / 2).otherwise(0.0), c("ly") + F.when(top, oh / 2).otherwise(0.0)
    return nodes.where("h > 2.01").select("node_id", x0.alias("x0"), (x0 + ow / 2).alias("x1"), y0.alias("y0"), (y0 + oh / 2).alias("y1"))
