"""Netlist tables out of the star schema: parts are cells, line items pins, orders nets, events an iteration log.

All derived numbers are integers or dyadic fractions, so sums are exact in any order. The die grows with the number of
cells, so rows, lines and bins hold about the same at any size."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The die of up to CELLS cells; with more, both sides are a whole number of times as long.
DIE_W, DIE_H, CELLS, BIN, TARGET, MAX_DEGREE = 128, 64, 2000, 4.0, 0.875, 8


class Netlist:
    """The tables of one data folder; each is a plan that runs when it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def times(self) -> int:
        """How many times the sides of the die are as long as those of the smallest: a count from the files' footers."""
        return max(1, math.ceil(math.sqrt(self.table("part").count() / CELLS)))

    @property
    def die_w(self) -> float:
        return float(DIE_W * self.times)

    @property
    def die_h(self) -> float:
        return float(DIE_H * self.times)

    @property
    def nx(self) -> int:
        return int(self.die_w / BIN)

    @property
    def ny(self) -> int:
        return int(self.die_h / BIN)

    @cached_property
    def nodes(self) -> DataFrame:
        """node_id, lx, ly, w, h, celltype, layer, size."""
        k, s = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            k.alias("node_id"),
            ((k * 37 + s * 11) % (int(self.die_w) - 4)).cast("double").alias("lx"),
            ((k * 53 + s * 7) % (int(self.die_h) - 3)).cast("double").alias("ly"),
            (s % 4 + 1).cast("double").alias("w"),
            F.when(s >= 49, 3.0).otherwise(1.0).alias("h"),
            F.col("p_brand").alias("celltype"),
            F.floor(s / 9).cast("bigint").alias("layer"),
            s.cast("bigint").alias("size"),
        )

    @cached_property
    def pins(self) -> DataFrame:
        """pin_id, net_id, node_id, pos, rel_cx, rel_cy; a pin's place in its net makes its id."""
        order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
        rows = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", (F.row_number().over(order) - 1).cast("bigint").alias("pos"))
        return rows.select(
            (F.col("l_orderkey") * 1000 + F.col("pos")).alias("pin_id"),
            F.col("l_orderkey").alias("net_id"),
            F.col("l_partkey").alias("node_id"),
            "pos",
            ((F.col("l_quantity") - 25) / 64).alias("rel_cx"),
            ((F.col("l_linenumber") - 4) / 16).alias("rel_cy"),
        )

    @cached_property
    def pin_positions(self) -> DataFrame:
        from netloom.operators.wirelength import pin_positions

        return pin_positions(self.pins, self.nodes)

    @cached_property
    def nets(self) -> DataFrame:
        """net_id, degree, mask: all nets, those without pins too."""
        degree = self.pins.groupBy("net_id").agg(F.count("*").alias("degree"))
        ids = self.table("orders").select(F.col("o_orderkey").alias("net_id"))
        rows = ids.join(degree, "net_id", "left").select("net_id", F.coalesce("degree", F.lit(0)).alias("degree"))
        return rows.withColumn("mask", F.col("degree").between(2, MAX_DEGREE))

    @cached_property
    def stars(self) -> DataFrame:
        """Each sink pin beside its net's root: the pin of the lowest layer, then of the lowest id."""
        first = Window.partitionBy("net_id").orderBy("layer", "pin_id")
        own = self.pin_positions.withColumn("k", F.row_number().over(first))
        root = [F.first(F.when(F.col("k") == 1, F.col(c)), ignorenulls=True).over(Window.partitionBy("net_id")).alias(f"root_{c}") for c in ("pin_id", "node_id", "px", "py", "layer")]
        return own.select("*", *root).where("k > 1").drop("k")

    @cached_property
    def arcs(self) -> DataFrame:
        """src, dst, delay of the timing graph: root node to sink node of a higher layer; 1 and a 64th of the distance."""
        pairs = self.stars.where("layer > root_layer").select(F.col("root_node_id").alias("src"), F.col("node_id").alias("dst")).distinct()
        at = self.nodes.select("node_id", (F.col("lx") + F.col("w") / 2).alias("cx"), (F.col("ly") + F.col("h") / 2).alias("cy"))
        a = at.select(F.col("node_id").alias("src"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
        b = at.select(F.col("node_id").alias("dst"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
        delay = 1 + (F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by"))) / 64
        return pairs.join(a, "src").join(b, "dst").select("src", "dst", delay.alias("delay"))

    @cached_property
    def metrics(self) -> DataFrame:
        """run, iter, hpwl: the events of a kind in the order of time. Hours are numbered each for itself, after the
        events of the hours before, so no task sorts a whole run."""
        rows = self.table("events").select(F.col("event_type").alias("run"), "ts", "event_id", F.col("value").alias("hpwl"), F.date_trunc("hour", "ts").alias("hour"))
        before = Window.partitionBy("run").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
        hours = rows.groupBy("run", "hour").agg(F.count("*").alias("n")).select("run", "hour", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        own = rows.withColumn("k", F.row_number().over(Window.partitionBy("run", "hour").orderBy("ts", "event_id")))
        return own.join(hours, ["run", "hour"]).select("run", (F.col("before") + F.col("k")).alias("iter"), "hpwl")

    @cached_property
    def macros(self) -> DataFrame:
        return self.nodes.where("h > 2.01")


#: The same tables for an SQL engine; queries are put behind them.
PRELUDE = """
with die as (select 128 * f as w, 64 * f as h, 32 * f as nx, 16 * f as ny from (select greatest(1, ceil(sqrt(count(*) / 2000.0)))::bigint as f from part)),
nodes as (select p_partkey as node_id, ((p_partkey * 37 + p_size * 11) % ((select w from die) - 4))::double as lx, ((p_partkey * 53 + p_size * 7) % ((select h from die) - 3))::double as ly,
    (p_size % 4 + 1)::double as w, case when p_size >= 49 then 3.0::double else 1.0::double end as h, p_brand as celltype,
    (p_size // 9)::bigint as layer, p_size::bigint as size from part),
pins0 as (select l_orderkey, l_partkey, l_quantity, l_linenumber, (row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1)::bigint as pos from lineitem),
pins as (select l_orderkey * 1000 + pos as pin_id, l_orderkey as net_id, l_partkey as node_id, pos, (l_quantity - 25) / 64 as rel_cx, (l_linenumber - 4) / 16.0::double as rel_cy from pins0),
pp as (select pin_id, net_id, node_id, layer, lx + w / 2 + rel_cx as px, ly + h / 2 + rel_cy as py from pins join nodes using (node_id)),
deg as (select net_id, count(*) as degree from pins group by net_id),
nets as (select o_orderkey as net_id, coalesce(degree, 0)::bigint as degree, coalesce(degree, 0) between 2 and 8 as mask from orders left join deg on net_id = o_orderkey),
roots as (select net_id, pin_id as root_pin_id, node_id as root_node_id, px as root_px, py as root_py, layer as root_layer from
    (select *, row_number() over (partition by net_id order by layer, pin_id) as k from pp) where k = 1),
stars as (select pp.*, root_pin_id, root_node_id, root_px, root_py, root_layer from pp join roots using (net_id) where pin_id <> root_pin_id),
arcs as (select src, dst, 1 + (abs(a.lx + a.w / 2 - b.lx - b.w / 2) + abs(a.ly + a.h / 2 - b.ly - b.h / 2)) / 64 as delay
    from (select distinct root_node_id as src, node_id as dst from stars where layer > root_layer) join nodes a on a.node_id = src join nodes b on b.node_id = dst),
metrics as (select event_type as run, row_number() over (partition by event_type order by ts, event_id) as iter, value as hpwl from events),
macros as (select * from nodes where h > 2.01)
"""
