"""Detailed placement: optimal regions, swaps, reorderings, independent sets, clusters, matchings; per-row legalisation."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def net_extremes(positions: DataFrame) -> DataFrame:
    """Per net and axis the two lowest and two highest places, so a net's box without one pin needs no self-join."""
    aggs = []
    for a in "xy":
        s = F.array_sort(F.collect_list(f"p{a}"))
        aggs += [F.element_at(s, 1).alias(f"{a}lo"), F.try_element_at(s, F.lit(2)).alias(f"{a}lo2"), F.element_at(s, -1).alias(f"{a}hi"), F.try_element_at(s, F.lit(-2)).alias(f"{a}hi2")]
    return positions.groupBy("net_id").agg(F.count("*").alias("degree"), *aggs)


def optimal_region(positions: DataFrame, most: int) -> DataFrame:
    """node_id, x0, x1, y0, y1: the medians of the low and high edges of its nets' boxes without the node's own pin."""
    boxes = net_extremes(positions.join(positions.groupBy("net_id").agg(F.count("*").alias("n")).where(c("n").between(2, most)), "net_id").drop("n"))
    rows = positions.join(boxes, "net_id")
    edge = lambda a: (F.when(c(f"p{a}") == c(f"{a}lo"), c(f"{a}lo2")).otherwise(c(f"{a}lo")), F.when(c(f"p{a}") == c(f"{a}hi"), c(f"{a}hi2")).otherwise(c(f"{a}hi")))
    (x0, x1), (y0, y1) = edge("x"), edge("y")
    middle = lambda e: F.percentile(e, 0.5)
    return rows.groupBy("node_id").agg(middle(x0).alias("x0"), middle(x1).alias("x1"), middle(y0).alias("y0"), middle(y1).alias("y1"))


def row_windows(nodes: DataFrame, k: int = 3) -> DataFrame:
    """row, g, slot, node_id, lx, w: runs of k neighbours of the low cells of a row."""
    w = Window.partitionBy("ly").orderBy("lx", "node_id")
    rows = nodes.where("h <= 2.01").select("ly", "node_id", "lx", "w", (F.row_number().over(w) - 1).alias("i"))
    rows = rows.select(c("ly").cast("bigint").alias("row"), F.floor(c("i") / k).alias("g"), (c("i") % k).cast("bigint").alias("slot"), "node_id", "lx", "w")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("row", "g"))).where(c("n") == k).drop("n")


def kreorder(nodes: DataFrame, positions: DataFrame, k: int = 3) -> DataFrame:
    """row, g, perm, gain: the order of each run of k cells, packed from its left end, that shortens the row's x length
    most; the cost of a pin is its distance from the middle of its net. perm is the slots in order; ties go to the first.

    All k! orders are a small constant table."""
    spark = nodes.sparkSession
    perms = [("".join(map(str, p)), [{"slot": s, "rank": r} for r, s in enumerate(p)]) for p in itertools.permutations(range(k))]
    table = spark.createDataFrame([(n, s["slot"], s["rank"]) for n, ss in perms for s in ss], "perm string, slot bigint, rank bigint")
    win = row_windows(nodes, k)
    mid = positions.groupBy("net_id").agg(((F.min("px") + F.max("px")) / 2).alias("mid"))
    pull = positions.join(mid, "net_id").groupBy("node_id").agg(F.avg("mid").alias("goal"), F.count("*").alias("pins"))
    cells = win.join(pull, "node_id").withColumn("n", F.count("*").over(Window.partitionBy("row", "g"))).where(c("n") == k)
    left = F.min("lx").over(Window.partitionBy("row", "g"))
    tried = cells.withColumn("left", left).join(F.broadcast(table), "slot")
    before = Window.partitionBy("row", "g", "perm").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    tried = tried.withColumn("x", c("left") + F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    cost = tried.groupBy("row", "g", "perm").agg(F.round(F.sum(c("pins") * F.abs(c("x") + c("w") / 2 - c("goal"))), 6).alias("cost"))
    best = cost.groupBy("row", "g").agg(F.min(F.struct("cost", "perm")).alias("b"), F.max(F.when(c("perm") == "".join(map(str, range(k))), c("cost"))).alias("was"))
    return best.select("row", "g", "b.perm", F.round(c("was") - c("b.cost"), 6).alias("gain"))


def swap_gains(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """node_id, other, gain: for each low cell, the equal-sized cell of its grid bin whose swap shortens distances to
    their pulls most; only gains, ties to the smaller id. Candidates come from one bin, so no cell meets all."""
    pull = positions.groupBy("net_id").agg(F.avg("px").alias("mx"), F.avg("py").alias("my"))
    goal = positions.join(pull, "net_id").groupBy("node_id").agg(F.avg("mx").alias("gx"), F.avg("my").alias("gy"))
    cells = nodes.where("h <= 2.01").join(goal, "node_id").select("node_id", "w", "lx", "ly", "gx", "gy", F.floor(c("lx") / 4).alias("bx"), F.floor(c("ly") / 4).alias("by"))
    a = cells.select("bx", "by", "w", *[c(n).alias(f"a_{n}") for n in ("node_id", "lx", "ly", "gx", "gy")])
    b = cells.select("bx", "by", "w", *[c(n).alias(f"b_{n}") for n in ("node_id", "lx", "ly", "gx", "gy")])
    d = lambda p, q: F.abs(c(f"{p}_lx") - c(f"{q}_gx")) + F.abs(c(f"{p}_ly") - c(f"{q}_gy"))
    p = a.join(b, ["bx", "by", "w"]).where("a_node_id <> b_node_id")
    p = p.select(c("a_node_id").alias("node_id"), c("b_node_id").alias("other"), F.round(d("a", "a") + d("b", "b") - d("b", "a") - d("a", "b"), 6).alias("gain"))
    best = p.where("gain > 0").groupBy("node_id").agg(F.max(F.struct("gain", (-c("other")).alias("o"))).alias("b"))
    return best.select("node_id", (-c("b.o")).alias("other"), "b.gain")


def neighbours(positions: DataFrame, most: int) -> DataFrame:
    """a, b of nodes that share a net of at most `most` pins."""
    small = positions.groupBy("net_id").agg(F.count("*").alias("n")).where(c("n").between(2, most)).select("net_id")
    p = positions.join(small, "net_id").select("net_id", "node_id").distinct()
    return p.select("net_id", c("node_id").alias("a")).join(p.select("net_id", c("node_id").alias("b")), "net_id").where("a <> b").select("a", "b").distinct()


def independent_round(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id of a first round of an independent set: nodes whose scrambled rank is below all their neighbours'."""
    rank = lambda k: (k * 40503 + 7) % 65536 * 1048576 + k
    least = edges.groupBy(c("a").alias("node_id")).agg(F.min(rank(c("b"))).alias("least"))
    return nodes.join(least, "node_id", "left").where(c("least").isNull() | (rank(c("node_id")) < c("least"))).select("node_id")


def kmeans(nodes: DataFrame, k: int, rounds: int = 3) -> DataFrame:
    """centre, n, x, y after some rounds: cells put to the nearest of k centres (Manhattan, ties to the first), which move
    to their cells' mean; a centre without cells stays. The k centres are the driver's."""
    now = [((37.0 * i) % 128, (23.0 * i) % 64) for i in range(k)]
    for step in range(rounds):
        centres = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(now)])
        far = F.transform(centres, lambda m: F.struct((F.abs(c("lx") - m["x"]) + F.abs(c("ly") - m["y"])).alias("d"), m["i"].alias("i")))
        rows = nodes.select(F.array_min(far)["i"].alias("centre"), "lx", "ly")
        means = rows.groupBy("centre").agg(F.count("*").alias("n"), F.round(F.avg("lx"), 6).alias("x"), F.round(F.avg("ly"), 6).alias("y"))
        if step < rounds - 1:
            for r in means.collect():  # k rows
                now[r["centre"]] = (r["x"], r["y"])
    return means


def committed(nodes: DataFrame, swaps: DataFrame, least: float) -> DataFrame:
    """node_id, lx, ly: a new version of the places, with swaps (node_id, other, gain) applied that gain `least` or more
    and that both cells want most; all others keep their places."""
    want = swaps.where(c("gain") >= least)
    back = want.select(c("other").alias("node_id"), c("node_id").alias("other"))
    both = want.select("node_id", "other").join(back, ["node_id", "other"])
    to = nodes.select(c("node_id").alias("other"), c("lx").alias("nx"), c("ly").alias("ny"))
    rows = nodes.join(both, "node_id", "left").join(to, "other", "left")
    return rows.select("node_id", F.coalesce("nx", "lx").alias("lx"), F.coalesce("ny", "ly").alias("ly"))


def cost_matrix(nodes: DataFrame, positions: DataFrame, k: int = 3) -> DataFrame:
    """row, g, node_id, slot, cost: the distance of every cell of a run to its nets' middle at every slot of the run."""
    win = row_windows(nodes, k)
    mid = positions.groupBy("net_id").agg(((F.min("px") + F.max("px")) / 2).alias("mid"))
    pulls = positions.join(mid, "net_id").select("node_id", "mid")
    spots = win.select("row", "g", c("slot").alias("to"), c("lx").alias("x"))
    return win.drop("lx", "slot").join(spots, ["row", "g"]).join(pulls, "node_id").groupBy("row", "g", "node_id", c("to").alias("slot")).agg(F.sum(F.abs(c("x") + c("w") / 2 - c("mid"))).alias("cost"))


def matched(costs: DataFrame) -> DataFrame:
    """row, g, node_id, slot: the cheapest assignment of each run, a few cells, by trying all orders in its group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, table = sorted(pdf["node_id"].unique()), pdf.set_index(["node_id", "slot"])["cost"].to_dict()
        slots = sorted(pdf["slot"].unique())
        best = min(itertools.permutations(slots), key=lambda p: (sum(table[i, s] for i, s in zip(ids, p)), p))
        return pd.DataFrame({"row": pdf["row"].iloc[0], "g": pdf["g"].iloc[0], "node_id": ids, "slot": best})

    return costs.groupBy("row", "g").applyInPandas(one, "row bigint, g bigint, node_id bigint, slot bigint")


def abacus_rows(nodes: DataFrame, width: float) -> DataFrame:
    """node_id, x: low cells of each row moved least, in quadratic terms, so that none overlap: clusters that meet merge
    and settle at the weighted mean of their wishes, inside [0, width]. A row that is too full runs over its right end."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lx", "node_id"])
        clusters: list[list] = []  # weight, wish sum, width, first cell
        for i, (x, w) in enumerate(zip(pdf["lx"], pdf["w"])):
            clusters.append([1.0, x, w, i])
            while len(clusters) > 1:
                a, b = clusters[-2], clusters[-1]
                at = max(0.0, min(a[1] / a[0], width - a[2]))
                if at + a[2] <= max(0.0, min(b[1] / b[0], width - b[2])):
                    break
                clusters[-2:] = [[a[0] + b[0], a[1] + b[1] - b[0] * a[2], a[2] + b[2], a[3]]]
        out, ws = [0.0] * len(pdf), list(pdf["w"])
        for k, (weight, wish, span, first) in enumerate(clusters):
            x = max(0.0, min(wish / weight, width - span))
            last = clusters[k + 1][3] if k + 1 < len(clusters) else len(ws)
            for i in range(first, last):
                out[i], x = x, x + ws[i]
        return pd.DataFrame({"node_id": pdf["node_id"].to_numpy(), "x": out})

    return nodes.where("h <= 2.01").select("ly", "node_id", "lx", "w").groupBy("ly").applyInPandas(one, "node_id bigint, x double")


def displacement(nodes: DataFrame, moved: DataFrame) -> DataFrame:
    """total and largest displacement of moved cells, and the total weighted by area."""
    d = F.abs(c("x") - c("lx"))
    return moved.join(nodes, "node_id").agg(F.round(F.sum(d), 6).alias("total"), F.round(F.max(d), 6).alias("largest"), F.round(F.sum(d * c("w") * c("h")), 6).alias("weighted"))
