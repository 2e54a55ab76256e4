"""Global routing: capacities, demands of L-shaped routes, congestion, routability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalar import logistic

c = F.col
CELL = 4.0
#: Cells of lines that are broadcast at most, 8 bytes each.
BROADCAST_CELLS = 4_000_000


def gridlines(spark, n: int) -> DataFrame:
    return spark.range(n + 1).select(c("id").alias("i"), (c("id") * CELL).alias("at"))


def capacity(spark, nx: int, layers: int) -> DataFrame:
    """layer, i, capacity: the tracks of pitch (1 + layer) / 4 between gridlines i and i + 1."""
    pitch = (1 + c("layer")) / 4
    cells = spark.range(layers * nx).select((c("id") % layers).alias("layer"), F.floor(c("id") / layers).alias("i"))
    upto = lambda x: F.ceil(x / pitch)
    return cells.select("layer", "i", (upto((c("i") + 1) * CELL) - upto(c("i") * CELL)).alias("capacity"))


def wire_distance(spark, n: int) -> DataFrame:
    """i, dist between the centres of cell i and the next, of n cells between regular gridlines."""
    middle = lambda i: (i * CELL + (i + 1) * CELL) / 2
    return spark.range(n - 1).select(c("id").alias("i"), (middle(c("id") + 1) - middle(c("id"))).alias("dist"))


def segments(stars: DataFrame) -> DataFrame:
    """net_id, pin_id and the grid cells of root and sink."""
    cell = lambda x: F.floor(x / CELL).cast("bigint")
    return stars.select("net_id", "pin_id", cell(c("root_px")).alias("x0"), cell(c("root_py")).alias("y0"), cell(c("px")).alias("x1"), cell(c("py")).alias("y1"))


def l_routes(seg: DataFrame) -> DataFrame:
    """net_id, pin_id, dir, x, y: the cells of the L route that goes along x first for even pins, along y for odd ones;
    wires are counted at the cells they enter."""
    across = c("pin_id") % 2 == 0
    steps = lambda a, b: F.when(a < b, F.sequence(a + 1, b)).when(a > b, F.sequence(b, a - 1)).otherwise(F.array().cast("array<bigint>"))
    h = seg.select("net_id", "pin_id", F.lit("h").alias("dir"), F.explode(steps(c("x0"), c("x1"))).alias("x"), F.when(across, c("y0")).otherwise(c("y1")).alias("y"))
    v = seg.select("net_id", "pin_id", F.lit("v").alias("dir"), F.when(across, c("x1")).otherwise(c("x0")).alias("x"), F.explode(steps(c("y0"), c("y1"))).alias("y"))
    return h.unionByName(v)


def demand(routes: DataFrame) -> DataFrame:
    """dir, x, y, demand: wires through a cell."""
    return routes.groupBy("dir", "x", "y").agg(F.count("*").alias("demand"))


def l_wires(seg: DataFrame) -> DataFrame:
    """net_id, pin_id, dir, line, low, high: the wires of l_routes() as runs of cells along a line, a row for each wire."""
    across = c("pin_id") % 2 == 0
    wire = lambda d, line, a, b: F.when(c(a) != c(b), F.struct(F.lit(d).alias("dir"), line.alias("line"), F.when(c(a) < c(b), c(a) + 1).otherwise(c(b)).alias("low"), F.when(c(a) < c(b), c(b)).otherwise(c(a) - 1).alias("high")))
    h = wire("h", F.when(across, c("y0")).otherwise(c("y1")), "x0", "x1")
    v = wire("v", F.when(across, c("x1")).otherwise(c("x0")), "y0", "y1")
    return seg.select("net_id", "pin_id", F.explode(F.array_compact(F.array(h, v))).alias("w")).select("net_id", "pin_id", "w.*")


def wire_demand(wires: DataFrame) -> DataFrame:
    """dir, line, at, demand: wires through a cell, for the cells that have any, from where wires begin and end."""
    ends = F.explode(F.array(F.struct(c("low").alias("at"), F.lit(1).alias("d")), F.struct((c("high") + 1).alias("at"), F.lit(-1).alias("d"))))
    steps = wires.select("dir", "line", ends.alias("e")).groupBy("dir", "line", "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("dir", "line").orderBy("at")
    runs = steps.select("dir", "line", "at", F.sum("d").over(w).alias("demand"), F.lead("at").over(w).alias("next")).where("demand > 0")
    return runs.select("dir", "line", F.explode(F.sequence("at", c("next") - 1)).alias("at"), "demand")


def line_sums(dem: DataFrame, value) -> DataFrame:
    """dir, line, first, sums: the running sums of a value of whole numbers along each line, from its first cell with a
    wire to its last."""
    cells = dem.select("dir", "line", "at", value.cast("bigint").alias("value"))
    w = Window.partitionBy("dir", "line").orderBy("at")
    runs = cells.select("dir", "line", "at", F.sum("value").over(w).alias("total"), F.lead("at").over(w).alias("next"))
    spread = runs.select("dir", "line", F.explode(F.sequence("at", F.coalesce(c("next") - 1, c("at")))).alias("at"), "total")
    lines = spread.groupBy("dir", "line").agg(F.sort_array(F.collect_list(F.struct("at", "total"))).alias("x"))
    return lines.select("dir", "line", c("x")[0]["at"].alias("first"), c("x")["total"].alias("sums"))


def along(wires: DataFrame, sums: DataFrame) -> DataFrame:
    """net_id, pin_id, dir, total: the sum over the cells of each wire. Wires are looked up line by line and stay whole,
    so neither their cells nor (up to BROADCAST_CELLS cells of the grid) the wires themselves are sent."""
    few = sums.agg(F.sum(F.size("sums"))).first()[0] or 0
    rows = wires.join(F.broadcast(sums) if few <= BROADCAST_CELLS else sums, ["dir", "line"])
    upto = lambda at: F.when(at < c("first"), 0).otherwise(F.element_at("sums", (at - c("first") + 1).cast("int")))
    return rows.select("net_id", "pin_id", "dir", (upto(c("high")) - upto(c("low") - 1)).alias("total"))


def route_stats(routes: DataFrame, seg: DataFrame) -> DataFrame:
    """wirelength in cells, and a via for each bend."""
    a = routes.agg(F.count("*").alias("wirelength"))
    return a.join(seg.agg(F.count_if((c("x0") != c("x1")) & (c("y0") != c("y1"))).alias("vias")))


def best_l(seg: DataFrame, prefix: DataFrame) -> DataFrame:
    """pin_id, first, cost: the cheaper of the two L routes by prefix sums of edge costs; of equal ones along x first.

    A line's sums are one list, so the four spans of a wire are looked up in two joins."""
    line = prefix.groupBy("dir", "line").agg(F.map_from_entries(F.collect_list(F.struct("at", "total"))).alias("sums"))
    bent = seg.where("x0 <> x1 and y0 <> y1").select("pin_id", "x0", "y0", "x1", "y1")
    wires = F.array(*[F.struct(F.lit(d).alias("dir"), c(l).alias("line"), c(a).alias("a"), c(b).alias("b"), F.lit(route).alias("route")) for route, d, l, a, b in (("x", "h", "y0", "x0", "x1"), ("x", "v", "x1", "y0", "y1"), ("y", "v", "x0", "y0", "y1"), ("y", "h", "y1", "x0", "x1"))])
    spans = bent.select("pin_id", F.explode(wires).alias("w")).select("pin_id", "w.*").join(line, ["dir", "line"])
    cost = spans.select("pin_id", "route", F.abs(F.try_element_at("sums", c("b")) - F.try_element_at("sums", c("a"))).alias("cost"))
    both = cost.groupBy("pin_id").agg(F.sum(F.when(c("route") == "x", c("cost"))).alias("x"), F.sum(F.when(c("route") == "y", c("cost"))).alias("y"))
    return both.select("pin_id", F.when(c("x") <= c("y"), "x").otherwise("y").alias("first"), F.least("x", "y").alias("cost"))


def cost_prefix(dem: DataFrame, nx: int, ny: int) -> DataFrame:
    """dir, line, at, total: running sums of edge costs 1 + demand / 8 along every line of the grid."""
    spark = dem.sparkSession
    h = spark.range(nx * ny).select(F.lit("h").alias("dir"), F.floor(c("id") / nx).alias("line"), (c("id") % nx).alias("at"))
    v = spark.range(nx * ny).select(F.lit("v").alias("dir"), F.floor(c("id") / ny).alias("line"), (c("id") % ny).alias("at"))
    own = dem.select("dir", F.when(c("dir") == "h", c("y")).otherwise(c("x")).alias("line"), F.when(c("dir") == "h", c("x")).otherwise(c("y")).alias("at"), "demand")
    cells = h.unionByName(v).join(own, ["dir", "line", "at"], "left")
    w = Window.partitionBy("dir", "line").orderBy("at")
    return cells.select("dir", "line", "at", F.sum(1 + F.coalesce("demand", F.lit(0)) / 8).over(w).alias("total"))


def congestion(dem: DataFrame, cap: float) -> DataFrame:
    """x, y, h, v, total: demand over capacity less 1 where above 1, else 0, per direction and together."""
    over = lambda u: F.greatest(F.lit(0.0), u / cap - 1)
    rows = dem.groupBy("x", "y").agg(F.sum(F.when(c("dir") == "h", c("demand")).otherwise(0)).alias("dh"), F.sum(F.when(c("dir") == "v", c("demand")).otherwise(0)).alias("dv"))
    return rows.select("x", "y", over(c("dh")).alias("h"), over(c("dv")).alias("v"), over((c("dh") + c("dv")) / 2).alias("total"))


def congestion_stats(con: DataFrame) -> DataFrame:
    """The largest, mean and sample deviation of the total."""
    return con.agg(F.max("total").alias("most"), F.round(F.avg("total"), 9).alias("mean"), F.round(F.stddev_samp("total"), 9).alias("deviation"))


def overflow_nets(wires: DataFrame, dem: DataFrame, cap: int) -> DataFrame:
    """net_id of nets with a wire through a cell whose demand is above capacity."""
    full = along(wires, line_sums(dem, F.when(c("demand") > cap, 1).otherwise(0)))
    return full.where("total > 0").select("net_id").distinct()


def ace(con: DataFrame, per_mille: tuple[int, ...] = (5, 10, 20, 50, 100, 200, 500)) -> DataFrame:
    """dir, per_mille, value: the mean of the most congested cells up to each share, at place int(n * share), from 0.

    Values stand by their counts, so what is sorted are the distinct values and not the cells."""
    rows = con.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), c(d).alias("value")) for d in "hv"])).alias("r")).select("r.*")
    hist = rows.groupBy("dir", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dir").orderBy(c("value").desc())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    run = hist.select("dir", "value", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"), F.coalesce(F.sum(c("n") * c("value")).over(before), F.lit(0.0)).alias("sum"), F.sum("n").over(Window.partitionBy("dir")).alias("all"))
    picks = run.select("*", F.explode(F.array(*[F.lit(p) for p in per_mille])).alias("p")).withColumn("k", F.floor(c("all") * c("p") / 1000))
    picks = picks.where((c("above") <= c("k")) & (c("k") < c("above") + c("n")))
    mean = (c("sum") + (c("k") + 1 - c("above")) * c("value")) / (c("k") + 1)
    return picks.select("dir", c("p").cast("bigint").alias("per_mille"), F.round(mean, 9).alias("value"))


def estimated_shorts(dem: DataFrame, cap: float) -> DataFrame:
    """dir, shorts: demand above capacity, times a layer area of 4 or 2."""
    area = F.when(c("dir") == "h", 4.0).otherwise(2.0)
    return dem.groupBy("dir").agg(F.sum(F.greatest(F.lit(0.0), c("demand") - cap) * area).alias("shorts"))


def via_usage(dem: DataFrame) -> DataFrame:
    """dir, line, at, usage: 1.5 * sqrt((d + next d) / 2) between neighbours of a line."""
    line = F.when(c("dir") == "h", c("y")).otherwise(c("x")).alias("line")
    rows = dem.select("dir", line, F.when(c("dir") == "h", c("x")).otherwise(c("y")).alias("at"), "demand")
    w = Window.partitionBy("dir", "line").orderBy("at")
    rows = rows.withColumns({"next": F.lead("demand").over(w), "next_at": F.lead("at").over(w)}).where("next_at = at + 1")
    return rows.select("dir", "line", "at", F.round(1.5 * F.sqrt((c("demand") + c("next")) / 2), 6).alias("usage"))


def wire_cost(dem: DataFrame, cap: float, slope: float = 0.5, short: float = 8.0) -> DataFrame:
    """dir, x, y, cost: the distance, and a price for shorts that rises as the remaining tracks go."""
    remain = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), cap - c("demand")))
    return dem.select("dir", "x", "y", F.round(CELL + CELL * logistic(-slope * remain) * short, 6).alias("cost"))


def net_cells(positions: DataFrame) -> DataFrame:
    """net_id, n_cells and the bounding box in grid cells of a net's pins."""
    cell = lambda x: F.floor(x / CELL).cast("bigint")
    rows = positions.select("net_id", cell(c("px")).alias("x"), cell(c("py")).alias("y"))
    return rows.groupBy("net_id").agg(F.countDistinct("x", "y").alias("n_cells"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def normalised(stats: DataFrame, pitch: float) -> DataFrame:
    """wirelength in units of a track's pitch, and vias."""
    return stats.select((c("wirelength") * CELL / pitch).alias("wirelength"), "vias")


def track_of(positions: DataFrame) -> DataFrame:
    """pin_id, track: how many breakpoints 0, 3, 7, 15, 31, 63 lie at or below a pin's x: lower bounds on a sorted axis."""
    axis = F.array(*[F.lit(float(v)) for v in (0, 3, 7, 15, 31, 63)])
    return positions.select("pin_id", F.size(F.filter(axis, lambda a: a <= c("px"))).cast("bigint").alias("track"))


def two_pin_gradient(seg_source: DataFrame, gamma: float) -> DataFrame:
    """pin_id, gx, gy of the two-point weighted average between a sink and its root."""

    def g(d):
        t = F.tanh(d / (2 * gamma))
        return t + d / (2 * gamma) * (1 - t * t)

    return seg_source.select("pin_id", (F.round(g(c("px") - c("root_px")), 6) + 0.0).alias("gx"), (F.round(g(c("py") - c("root_py")), 6) + 0.0).alias("gy"))


def obstacle_tracks(nodes: DataFrame) -> DataFrame:
    """row, tracks, length: tracks of pitch 1 that high cells block in each grid row, and the blocked length on them."""
    high = nodes.where("h > 2.01").select("lx", "w", F.explode(F.sequence(c("ly").cast("bigint"), (c("ly") + c("h")).cast("bigint"))).alias("track"))
    return high.groupBy(F.floor(c("track") / 4).alias("row")).agg(F.countDistinct("track").alias("tracks"), F.sum("w").alias("length"))


def gcell_obstacles(nodes: DataFrame) -> DataFrame:
    """x, y, tracks, length: horizontal tracks of pitch 1 that high cells block in each grid cell, and the blocked length."""
    high = nodes.where("h > 2.01").select("lx", "w", F.explode(F.sequence(c("ly").cast("bigint"), (c("ly") + c("h") - 1).cast("bigint"))).alias("track"))
    cells = high.select("lx", "w", "track", F.explode(F.sequence(F.floor(c("lx") / CELL), F.ceil((c("lx") + c("w")) / CELL) - 1)).alias("x"))
    part = F.least(c("lx") + c("w"), (c("x") + 1) * CELL) - F.greatest(c("lx"), c("x") * CELL)
    return cells.groupBy("x", F.floor(c("track") / CELL).alias("y")).agg(F.countDistinct("track").alias("tracks"), F.sum(part).alias("length"))


def fixed_usage(dem: DataFrame, obstacles: DataFrame) -> DataFrame:
    """x, y, usage, length: wires along x and blocked tracks together, of cells that have either."""
    wires = dem.where("dir = 'h'").select("x", "y", "demand")
    rows = wires.join(obstacles, ["x", "y"], "full")
    return rows.select("x", "y", (F.coalesce("demand", F.lit(0)) + F.coalesce("tracks", F.lit(0))).alias("usage"), F.coalesce("length", F.lit(0.0)).alias("length"))


def bends(seg: DataFrame) -> DataFrame:
    """net_id, pin_id, x, y: the cell of each L route's via."""
    even = c("pin_id") % 2 == 0
    return seg.where("x0 <> x1 and y0 <> y1").select("net_id", "pin_id", F.when(even, c("x1")).otherwise(c("x0")).alias("x"), F.when(even, c("y0")).otherwise(c("y1")).alias("y"))


def demand_map(dem: DataFrame, seg: DataFrame, cap: int) -> DataFrame:
    """x, y, wires, vias, total, free: what goes through each cell, and what of two directions' capacity it leaves."""
    wires = dem.groupBy("x", "y").agg(F.sum("demand").alias("wires"))
    rows = wires.join(bends(seg).groupBy("x", "y").agg(F.count("*").alias("vias")), ["x", "y"], "full").na.fill(0, ["wires", "vias"])
    return rows.select("x", "y", "wires", "vias", (c("wires") + c("vias")).alias("total"), (F.lit(2 * cap) - c("wires") - c("vias")).alias("free"))


def overflow_vias(seg: DataFrame, dem: DataFrame, cap: int) -> DataFrame:
    """net_id, vias: the vias of a net in cells where a direction's demand is above capacity."""
    full = dem.where(c("demand") > cap).select("x", "y").distinct()
    return bends(seg).join(full, ["x", "y"], "left_semi").groupBy("net_id").agg(F.count("*").alias("vias"))


def route_force(wires: DataFrame, dem: DataFrame, cap: int) -> DataFrame:
    """pin_id, gx, gy: the congestion along a pin's wires, of each direction by itself: demand above capacity, over it."""
    rows = along(wires, line_sums(dem, F.greatest(F.lit(0), c("demand") - cap)))
    of = lambda d: F.round(F.sum(F.when(c("dir") == d, c("total")).otherwise(0)) / cap, 6)
    return rows.groupBy("pin_id").agg(of("h").alias("gx"), of("v").alias("gy"))


def pin_cells(positions: DataFrame) -> DataFrame:
    """pin_id, x, y: each pin's grid cell."""
    return positions.select("pin_id", F.floor(c("px") / CELL).cast("bigint").alias("x"), F.floor(c("py") / CELL).cast("bigint").alias("y"))


def net_topology(positions: DataFrame) -> DataFrame:
    """net_id, x, y, k: the distinct cells of nets with two or more, numbered by x, then y."""
    cells = positions.select("net_id", F.floor(c("px") / CELL).cast("bigint").alias("x"), F.floor(c("py") / CELL).cast("bigint").alias("y")).distinct()
    w = Window.partitionBy("net_id")
    rows = cells.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("x", "y")) - 1}).where("n > 1")
    return rows.select("net_id", "x", "y", c("k").cast("bigint").alias("k"))


def best_solution(log: DataFrame) -> DataFrame:
    """run, iter, shorts: the routing round with the fewest shorts; of equal ones the first."""
    rows = log.select("run", "iter", F.floor(c("hpwl") / 10).alias("shorts"))
    return rows.groupBy("run").agg(F.min(F.struct("shorts", "iter")).alias("b")).select("run", "b.iter", "b.shorts")


def inflation(nodes: DataFrame, ratios: DataFrame, budget: float) -> DataFrame:
    """node_id, ratio, area: cells grown by what their ratio has above 1, all scaled down together where the added area is
    above `budget`."""
    grow = F.greatest(F.lit(0.0), c("ratio") - 1)
    rows = nodes.join(ratios, "node_id").select("node_id", (c("w") * c("h")).alias("a"), grow.alias("g"))
    total = rows.agg(F.greatest(F.sum(c("a") * c("g")), F.lit(1e-9)).alias("t"))
    scale = F.least(F.lit(1.0), budget / c("t"))
    return rows.join(F.broadcast(total)).select("node_id", F.round(1 + c("g") * scale, 6).alias("ratio"), F.round(c("a") * (1 + c("g") * scale), 6).alias("area"))  # one row


def spacing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, space: what two shapes must keep apart, by the wider one's width and their parallel run, out of a table: the
    row of the last width and the column of the last run that are not above theirs."""
    widths, runs = (0.0, 2.0, 4.0), (-1000.0, 0.0, 2.0)
    table = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.5, 0.75, 1.0, 0.75, 1.0, 2.0)])
    place = lambda v, axis: F.size(F.filter(F.array(*[F.lit(x) for x in axis]), lambda x: x <= v)) - 1
    own = lambda n: nodes.select(c("node_id").alias(n), F.least("w", "h").alias(f"w{n}"))
    rows = pairs.join(own("a"), "a").join(own("b"), "b")
    at = place(F.greatest("wa", "wb"), widths) * len(runs) + place(c("parallel_run"), runs) + 1
    return rows.select("a", "b", F.element_at(table, at.cast("int")).alias("space"))
