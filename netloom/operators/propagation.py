"""Timing by tables: arcs with senses, slews and delays for rise and fall, early and late; tests; trees of resistance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.timing import sweep

c = F.col
#: The corners and transitions, as suffixes of the state's columns.
STATES = [(el, rf) for el in ("early", "late") for rf in ("rise", "fall")]
#: The axes of the fixture tables: input slew and load.
SLEWS, LOADS = (0.25, 0.5, 1.0, 2.0), (1.0, 2.0, 4.0, 8.0)


def surface(kind: str, rf: str, slew, load):
    """The values that the fixture tables hold: a delay or an output slew, a little more for a rise."""
    if kind == "delay":
        return 0.5 + slew / 4 + load / 16 + slew * load / 64 + (0.125 if rf == "rise" else 0.0)
    return 0.25 + slew / 8 + load / 32 + (0.0625 if rf == "rise" else 0.0)


def place_on(axis: tuple[float, ...], v: Column) -> tuple[Column, Column]:
    """The cell of an axis, from 1, that a value lies in or is beyond, and how far along it, below 0 and above 1 too."""
    cell, along = F.lit(1), (v - axis[0]) / (axis[1] - axis[0])
    for k in range(1, len(axis) - 1):
        cell = F.when(v >= axis[k], k + 1).otherwise(cell)
        along = F.when(v >= axis[k], (v - axis[k]) / (axis[k + 1] - axis[k])).otherwise(along)
    return cell, along


def look_up(kind: str, rf: str, row: Column, up: Column, column: Column, right: Column) -> Column:
    """The value of a cell's table (row-major) between the places of a slew and a load, beyond its axes too."""
    table = F.array(*[F.lit(float(surface(kind, rf, s, l))) for s in SLEWS for l in LOADS])
    at = lambda dr, dc: F.element_at(table, ((row - 1 + dr) * len(LOADS) + column + dc).cast("int"))
    low, high = at(0, 0) + (at(0, 1) - at(0, 0)) * right, at(1, 0) + (at(1, 1) - at(1, 0)) * right
    return low + (high - low) * up


def timing_graph(arcs: DataFrame) -> DataFrame:
    """src, dst, wire, load, sense: arcs with the wire's delay, the fan-out of the source as its load, and the sense by
    which a transition passes: positive, negative or either."""
    load = arcs.groupBy("src").agg(F.count("*").cast("double").alias("load"))
    kind = (c("src") + c("dst")) % 3
    sense = F.when(kind == 0, "positive").when(kind == 1, "negative").otherwise("either")
    return arcs.join(load, "src").select("src", "dst", (c("delay") - 1).alias("wire"), "load", sense.alias("sense"))


def passes(sense: Column, before: str, after: str) -> Column:
    """Whether a transition `before` an arc may cause `after`."""
    return (sense == "either") | (sense == ("positive" if before == after else "negative"))


def propagate(graph: DataFrame, slew: float = 0.5) -> DataFrame:
    """node_id, level, and at_ and slew_ for each corner and transition, from 0 and `slew` at nodes without fan-in.

    Along an arc, each transition that its sense lets pass adds the table's delay at its slew, and the wire's, and leaves
    with the table's slew joined with the wire's in squares; early keeps the least, late the largest. A transition that
    nothing causes stays null."""
    prepare = dict(zip(("_column", "_right"), place_on(LOADS, c("load"))))
    for el, rf in STATES:
        prepare |= dict(zip((f"_row_{el}_{rf}", f"_up_{el}_{rf}"), place_on(SLEWS, c(f"slew_{el}_{rf}"))))
    begin = {f"{k}_{el}_{rf}": F.lit(0.0 if k == "at" else slew) for k in ("at", "slew") for el, rf in STATES}
    along, merge = {}, {}
    for el, after in STATES:
        pick = F.least if el == "early" else F.greatest
        at, out = [], []
        for before in ("rise", "fall"):
            ok = passes(c("sense"), before, after)
            spot = (c(f"_row_{el}_{before}"), c(f"_up_{el}_{before}"), c("_column"), c("_right"))
            at.append(F.when(ok, c(f"at_{el}_{before}") + look_up("delay", after, *spot) + c("wire")))
            out.append(F.when(ok, F.sqrt(F.pow(look_up("slew", after, *spot), F.lit(2.0)) + c("wire") * c("wire"))))
        along[f"at_{el}_{after}"], along[f"slew_{el}_{after}"] = pick(*at), pick(*out)
        keep = F.min if el == "early" else F.max
        merge |= {f"{k}_{el}_{after}": keep(f"{k}_{el}_{after}") for k in ("at", "slew")}
    return sweep(graph, begin, along, merge, prepare=prepare)


def rounded(states: DataFrame, kind: str) -> DataFrame:
    return states.select("node_id", "level", *[F.round(f"{kind}_{el}_{rf}", 6).alias(f"{kind}_{el}_{rf}") for el, rf in STATES])


def constraint_slacks(graph: DataFrame, states: DataFrame, period: float) -> DataFrame:
    """node_id, rf, hold, setup: at nodes without fan-out, arrivals against a clock edge at 0 (hold) and one period later
    (setup), by a constraint that grows with the data's slew."""
    ends = states.join(graph.select(c("src").alias("node_id")), "node_id", "left_anti")
    rows = []
    for rf in ("rise", "fall"):
        hold = c(f"at_early_{rf}") - (0.25 + c(f"slew_early_{rf}") / 4)
        setup = F.lit(period) - (0.5 + c(f"slew_late_{rf}") / 2) - c(f"at_late_{rf}")
        rows.append(F.struct(F.lit(rf).alias("rf"), F.round(hold, 6).alias("hold"), F.round(setup, 6).alias("setup")))
    return ends.select("node_id", F.explode(F.array(*rows)).alias("x")).select("node_id", "x.*")


def rc_trees(positions: DataFrame, most: int) -> DataFrame:
    """net_id, pin_id, k, parent, depth, cap, res: nets of up to `most` pins as binary trees over their pins by place, root
    first: pin k hangs on pin (k - 1) / 2, by a wire of the distance between them. A stand-in for Steiner trees."""
    w = Window.partitionBy("net_id").orderBy("px", "py", "pin_id")
    rows = positions.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("net_id"))).where(c("n") <= most)
    up = F.when(c("k") > 0, F.floor((c("k") - 1) / 2))
    own = rows.select("net_id", "pin_id", "px", "py", c("k").cast("bigint").alias("k"), up.cast("bigint").alias("parent"), F.floor(F.log2(c("k") + 1.0000001)).cast("bigint").alias("depth"))
    over = own.select("net_id", c("k").alias("parent"), c("px").alias("qx"), c("py").alias("qy"))
    wire = F.coalesce(F.abs(c("px") - c("qx")) + F.abs(c("py") - c("qy")), F.lit(0.0))
    return own.join(over, ["net_id", "parent"], "left").select("net_id", "pin_id", "k", "parent", "depth", (1 + wire / 8).alias("cap"), (wire / 4).alias("res"))


def ancestors(tree: DataFrame) -> DataFrame:
    """The tree's rows with `a`, each of their ancestors in turn, themselves too: binary places need no recursion."""
    return tree.withColumn("a", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), c("depth")), lambda j: (F.floor((c("k") + 1) / F.pow(F.lit(2.0), j)) - 1).cast("bigint"))))


def elmore(tree: DataFrame) -> DataFrame:
    """pin_id, load, delay, impulse by four passes: loads upwards, delays downwards, load times delay upwards, beta
    downwards; impulse is sqrt(2 * beta - delay ** 2)."""

    def up(df, value, name):
        got = ancestors(df).groupBy("net_id", c("a").alias("k")).agg(F.sum(value).alias(name))
        return df.join(got, ["net_id", "k"])

    def down(df, value, name):
        over = df.select("net_id", c("k").alias("a"), value.alias("_v"))
        got = ancestors(df).join(over, ["net_id", "a"]).groupBy("net_id", "k").agg(F.sum("_v").alias(name))
        return df.join(got, ["net_id", "k"])

    rows = up(tree, c("cap"), "load")
    rows = down(rows, c("res") * c("load"), "delay")
    rows = up(rows, c("cap") * c("delay"), "weighted")
    rows = down(rows, c("res") * c("weighted"), "beta")
    return rows.select("pin_id", "load", "delay", F.round(F.sqrt(F.greatest(F.lit(0.0), 2 * c("beta") - c("delay") * c("delay"))), 6).alias("impulse"))


def calibration(stars: DataFrame, trees: DataFrame) -> DataFrame:
    """net_id, load_ratio, compensation: a net's load in its tree over that in the star, and what the tree's largest delay
    has more than the star's, 0 at least."""
    tree = trees.groupBy("net_id").agg(F.max("load").alias("tl"), F.max("delay").alias("td"))
    star = stars.groupBy("net_id").agg(F.sum("load").alias("sl"), F.max("delay").alias("sd"))
    return tree.join(star, "net_id").select("net_id", F.round(c("tl") / c("sl"), 6).alias("load_ratio"), F.round(F.greatest(F.lit(0.0), c("td") - c("sd")), 6).alias("compensation"))


def point_report(arrival: DataFrame, rat: DataFrame, arcs: DataFrame, wanted: Column) -> DataFrame:
    """node_id, arrival, required, slack, load of the points asked for."""
    load = arcs.groupBy(c("src").alias("node_id")).agg(F.count("*").alias("load"))
    rows = arrival.where(wanted).join(rat.where(wanted), "node_id").join(load, "node_id", "left")
    return rows.select("node_id", c("at_late").alias("arrival"), c("rat").alias("required"), (c("rat") - c("at_late")).alias("slack"), F.coalesce("load", F.lit(0)).alias("load"))


def pin_weights(slack: DataFrame, criticality: DataFrame, mix: float, keep: float) -> DataFrame:
    """node_id, weight after two updates from 1: `keep` of the old one, the rest from slack (over the worst) and
    criticality (over the largest), mixed."""
    scale = slack.agg(F.greatest(-F.min("slack"), F.lit(1e-9)).alias("worst"))
    top = criticality.agg(F.greatest(F.max("criticality"), F.lit(1e-9)).alias("top"))
    rows = slack.join(criticality, "node_id", "left").join(F.broadcast(scale)).join(F.broadcast(top))  # one row each
    goal = 1 + mix * F.greatest(F.lit(0.0), -c("slack")) / c("worst") + (1 - mix) * F.coalesce("criticality", F.lit(0.0)) / c("top")
    once = keep * 1.0 + (1 - keep) * goal
    return rows.select("node_id", F.round(keep * once + (1 - keep) * goal, 6).alias("weight"))


def longest_bounds(edges: DataFrame, size: DataFrame, width: float) -> DataFrame:
    """node_id, low, high, slack: the least and largest place of a box along an axis when every edge (a, b) asks b to
    begin after a ends; size: node_id, s."""
    own = lambda n: size.select(c("node_id").alias(n), "s")
    forth = edges.select(c("a").alias("src"), c("b").alias("dst")).join(own("src"), "src")
    back = edges.select(c("b").alias("src"), c("a").alias("dst")).join(own("src"), "src")
    low = sweep(forth, {"at": F.lit(0.0)}, {"at": c("at") + c("s")}, {"at": F.max("at")}).select("node_id", c("at").alias("low"))
    high = sweep(back, {"at": F.lit(0.0)}, {"at": c("at") + c("s")}, {"at": F.max("at")}).select("node_id", c("at").alias("after"))
    rows = low.join(high, "node_id").join(size, "node_id").select("node_id", "low", (F.lit(width) - c("after") - c("s")).alias("high"))
    return rows.select("node_id", "low", "high", (c("high") - c("low")).alias("slack"))
