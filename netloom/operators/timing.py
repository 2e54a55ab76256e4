"""Static timing over arcs (src, dst, delay): levels, arrivals, required times, slacks, paths, criticality, RC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.shared import Folder, cut

c = F.col


def sweep(arcs: DataFrame, begin: dict, along: dict, merge: dict, most: int = 100_000, prepare: dict | None = None) -> DataFrame:
    """node_id, level and a state of every node of arcs (src, dst, ..), in topological order.

    Nodes without fan-in have level 0 and the state `begin` (name to column); a row for each arc into a node brings
    `along`, of the source's state, the arc's columns, src and the columns of `prepare`; `merge` aggregates these. A node is done when all its arcs
    have brought theirs, so each arc is joined once, with the nodes done last; a level's table holds these and the nodes
    still waiting, and all levels are read together at the end. ValueError if the arcs hold a cycle."""
    spark, folder = arcs.sparkSession, Folder(arcs.sparkSession)
    fan_in = arcs.groupBy("dst").agg(F.count("*").alias("_in"))
    arcs = folder.put(arcs.join(fan_in, "dst"), "arcs")
    top = f"{folder.path}/levels"
    state = list(begin)
    sources = arcs.select("src").distinct().join(arcs.select(c("dst").alias("src")), "src", "left_anti")
    now = sources.select(c("src").alias("node_id"), F.lit(0).cast("bigint").alias("_in"), F.lit(0).cast("bigint").alias("_got"), *[x.alias(k) for k, x in begin.items()])
    for k in range(most):
        now.write.parquet(f"{top}/level={k}")
        if k == 0:
            schema = spark.read.parquet(f"{top}/level=0").schema
        table = spark.read.schema(schema).parquet(f"{top}/level={k}")
        done, waiting = table.where("_got = _in"), table.where("_got < _in")
        if done.isEmpty():
            if not waiting.isEmpty() or (k == 0 and not arcs.isEmpty()):
                raise ValueError("the arcs hold a cycle")
            break
        come = arcs.join(done.select(c("node_id").alias("src"), *state), "src").withColumns(prepare or {})
        come = come.select(c("dst").alias("node_id"), "_in", F.lit(1).cast("bigint").alias("_got"), *[x.alias(n) for n, x in along.items()])
        now = come.unionByName(waiting).groupBy("node_id").agg(F.max("_in").alias("_in"), F.sum("_got").alias("_got"), *[x.alias(n) for n, x in merge.items()])
        now = now.select("node_id", "_in", "_got", *[c(n).cast(schema[n].dataType).alias(n) for n in state])
    rows = spark.read.schema(schema.add("level", "long")).option("basePath", top).parquet(top)
    return rows.where("_got = _in").select("node_id", "level", *state)


def levels(arcs: DataFrame, most: int = 100_000) -> DataFrame:
    """node_id, level: the longest path from a node without fan-in."""
    rows = sweep(arcs.select("src", "dst"), {"at": F.lit(0)}, {"at": c("at")}, {"at": F.max("at")}, most)
    return rows.select("node_id", "level")


def arrivals(arcs: DataFrame) -> DataFrame:
    """node_id, level, at_early, at_late, pred: arrival times from 0 at nodes without fan-in, and the late arrival's
    predecessor; of equal arrivals the smaller one."""
    late = F.struct((c("late.at") + c("delay")).alias("at"), (-c("src")).alias("p"))
    none = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("bigint").alias("p"))
    rows = sweep(arcs, {"at_early": F.lit(0.0), "late": none}, {"at_early": c("at_early") + c("delay"), "late": late}, {"at_early": F.min("at_early"), "late": F.max("late")})
    return rows.select("node_id", "level", "at_early", c("late.at").alias("at_late"), (-c("late.p")).alias("pred"))


def required(arcs: DataFrame, period: float) -> DataFrame:
    """node_id, rat_early, rat: required times from the ends backwards; late ones, the period at nodes without fan-out,
    keep the least, early ones, 0 there, the largest."""
    back = arcs.select(c("dst").alias("src"), c("src").alias("dst"), "delay")
    begin = {"rat_early": F.lit(0.0), "rat": F.lit(float(period))}
    rows = sweep(back, begin, {n: c(n) - c("delay") for n in begin}, {"rat_early": F.max("rat_early"), "rat": F.min("rat")})
    return rows.select("node_id", "rat_early", "rat")


def slacks(arrival: DataFrame, rat: DataFrame) -> DataFrame:
    """node_id, early, slack: the early and the late slack of every node."""
    return arrival.join(rat, "node_id").select("node_id", (c("at_early") - c("rat_early")).alias("early"), (c("rat") - c("at_late")).alias("slack"))


def endpoint_slacks(arcs: DataFrame, arrival: DataFrame, period: float, hold: float) -> DataFrame:
    """node_id, early, late of nodes without fan-out."""
    ends = arrival.join(arcs, c("node_id") == c("src"), "left_anti")
    return ends.select("node_id", (c("at_early") - hold).alias("early"), (F.lit(period) - c("at_late")).alias("late"))


def wns_tns(ends: DataFrame) -> DataFrame:
    """el, wns, tns: the worst slack, and the sum of those below 0."""
    rows = ends.select(F.explode(F.array(F.struct(F.lit("early").alias("el"), c("early").alias("s")), F.struct(F.lit("late").alias("el"), c("late").alias("s")))).alias("x")).select("x.*")
    return rows.groupBy("el").agg(F.min("s").alias("wns"), F.sum(F.least(F.lit(0.0), c("s"))).alias("tns"))


def k_paths(ends: DataFrame, arrival: DataFrame, k: int) -> DataFrame:
    """rank, step, node_id: the late paths of the k worst endpoints, from the end; rank from 1 by slack, then id."""
    worst = ends.orderBy("late", "node_id").limit(k)
    worst = worst.withColumn("rank", F.row_number().over(Window.orderBy("late", "node_id")).cast("bigint"))
    here = cut(worst.select("rank", F.lit(0).cast("bigint").alias("step"), "node_id"))
    out, pred = here, arrival.select("node_id", "pred")
    while not here.isEmpty():
        here = cut(here.join(pred, "node_id").where("pred is not null").select("rank", (c("step") + 1).alias("step"), c("pred").alias("node_id")))
        out = out.unionByName(here)
    return cut(out)


def path_criticality(paths: DataFrame, arrival: DataFrame) -> DataFrame:
    """node_id, visits, criticality: over the paths through a node, the stage's delay over (1 + rank) squared."""
    at = arrival.select("node_id", "at_late")
    steps = paths.join(at, "node_id").withColumn("before", F.lead("at_late").over(Window.partitionBy("rank").orderBy("step")))
    gain = (c("at_late") - F.coalesce("before", F.lit(0.0))) / ((1 + c("rank")) * (1 + c("rank")))
    return steps.groupBy("node_id").agg(F.count("*").alias("visits"), F.round(F.sum(gain), 9).alias("criticality"))


def node_criticality(slack: DataFrame) -> DataFrame:
    """node_id, value: slacks over the largest absolute slack."""
    most = slack.agg(F.max(F.abs("slack")).alias("m"))
    return slack.join(F.broadcast(most)).select("node_id", F.round(c("slack") / c("m"), 9).alias("value"))


def star_rc(stars: DataFrame, cf: float, rf: float) -> DataFrame:
    """pin_id, load, delay, impulse of sinks in the star model: half the wire's capacitance at each end, and its
    resistance; impulse is sqrt(2 * R * load * delay - delay ** 2)."""
    wl = F.abs(c("px") - c("root_px")) + F.abs(c("py") - c("root_py"))
    rows = stars.select("pin_id", "net_id", (cf * wl / 2).alias("cap"), (rf * wl).alias("res"))
    load = c("cap") + 1
    delay = c("res") * load
    return rows.select("pin_id", load.alias("load"), delay.alias("delay"), F.round(F.sqrt(2 * c("res") * load * delay - delay * delay), 6).alias("impulse"))


def net_load(stars: DataFrame, cf: float) -> DataFrame:
    """net_id, load, n_sinks: what a net's driver sees."""
    wl = F.abs(c("px") - c("root_px")) + F.abs(c("py") - c("root_py"))
    return stars.groupBy("net_id").agg(F.sum(cf * wl + 1).alias("load"), F.count("*").alias("n_sinks"))


def chains(positions: DataFrame) -> DataFrame:
    """pin_id, net_id, k, cap, res: each net as a chain of its pins by x, then id; wires between neighbours."""
    w = Window.partitionBy("net_id").orderBy("px", "pin_id")
    wl = F.abs(c("px") - F.lag("px").over(w)) + F.abs(c("py") - F.lag("py").over(w))
    return positions.select("pin_id", "net_id", F.row_number().over(w).cast("bigint").alias("k"), F.lit(1.0).alias("cap"), F.coalesce(wl / 8, F.lit(0.0)).alias("res"))


def elmore(tree: DataFrame) -> DataFrame:
    """pin_id, load, delay of chains: load sums the caps downstream, delay the resistance times load upstream."""
    down = Window.partitionBy("net_id").orderBy(c("k").desc())
    up = Window.partitionBy("net_id").orderBy("k")
    rows = tree.withColumn("load", F.sum("cap").over(down))
    return rows.select("pin_id", "load", F.sum(c("res") * c("load")).over(up).alias("delay"))


def interpolate(x: Column, y: Column, xs: Column, ys: Column, table: Column) -> Column:
    """Bilinear value of a look-up table (row-major array) at (x, y); beyond the axes the edge cells go on.

    One index or value answers by itself; an empty table by null."""

    def cell(v, axis):
        return F.greatest(F.lit(1), F.least(F.size(axis) - 1, F.size(F.filter(axis, lambda a: a <= v))))

    def line(v, a, b, p, q):
        return F.when(a == b, p).otherwise(p + (q - p) * F.try_divide(v - a, b - a))

    i, j = cell(x, xs), cell(y, ys)
    at = lambda r, s: F.try_element_at(table, (F.least(r, F.size(xs)) - 1) * F.size(ys) + F.least(s, F.size(ys)))
    on = lambda axis, k: F.try_element_at(axis, F.least(k, F.size(axis)))
    low = line(y, on(ys, j), on(ys, j + 1), at(i, j), at(i, j + 1))
    high = line(y, on(ys, j), on(ys, j + 1), at(i + 1, j), at(i + 1, j + 1))
    return F.when(F.size(table) > 0, line(x, on(xs, i), on(xs, i + 1), low, high))


def lut_delay(arcs: DataFrame) -> DataFrame:
    """src, dst, value of a table over the arc's delay and the source's id modulo 16, inside and beyond its axes."""
    xs, ys = F.array(*[F.lit(v) for v in (1.0, 1.5, 2.5)]), F.array(*[F.lit(v) for v in (2.0, 4.0, 8.0)])
    table = F.array(*[F.lit(float(v)) for v in (1, 2, 4, 2, 4, 8, 4, 8, 16)])
    return arcs.select("src", "dst", interpolate(c("delay"), (c("src") % 16).cast("double"), xs, ys, table).alias("value"))


def slew(arcs: DataFrame) -> DataFrame:
    """dst, early, late: sqrt(s^2 + i^2) over the arcs into a node, with s of the source's id and i the delay."""
    s = (c("src") % 8) / 8
    v = F.sqrt(s * s + c("delay") * c("delay"))
    return arcs.groupBy("dst").agg(F.round(F.min(v), 6).alias("early"), F.round(F.max(v), 6).alias("late"))
