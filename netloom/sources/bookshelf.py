"""Bookshelf benchmarks as tables, and placements back as text. Records are split by the reader, so files of any size
are read by many tasks and no window over all lines is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines without comments, headers and blanks."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line"))
    return rows.where((c("line") != "") & ~c("line").startswith("UCLA") & ~c("line").rlike(r"^(Num|num)\w+\s*:"))


def read_aux(spark: SparkSession, path: str) -> dict[str, str]:
    """Extension to path of the files that an .aux line names, beside it."""
    line = spark.read.text(path).where("value like '%:%'").first()[0]
    top = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    return {name.rsplit(".", 1)[1]: top + name for name in line.split(":", 1)[1].split()}


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """name, w, h, kind (std, terminal or terminal_NI)."""
    p = F.split("line", r"\s+")
    return _lines(spark, path).select(p[0].alias("name"), p[1].cast("double").alias("w"), p[2].cast("double").alias("h"), F.coalesce(F.get(p, F.lit(3)), F.lit("std")).alias("kind"))


def read_nets(spark: SparkSession, path: str) -> DataFrame:
    """net, pos, node, direction, dx, dy: a record begins at each NetDegree, so a net's lines stay together.

    The driver's pin, the first of direction O, comes first, as position 0."""
    blocks = spark.read.option("lineSep", "NetDegree").text(path).where(F.trim("value").startswith(":"))
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    rows = blocks.select(lines.alias("l")).select(F.element_at(F.split(F.element_at("l", 1), r"\s+"), 3).alias("net"), F.posexplode(F.slice("l", 2, F.size("l"))).alias("k", "line"))
    p = F.split(F.regexp_replace("line", ":", " "), r"\s+")
    rows = rows.select("net", "k", p[0].alias("node"), p[1].alias("direction"), F.coalesce(F.get(p, F.lit(2)).cast("double"), F.lit(0.0)).alias("dx"), F.coalesce(F.get(p, F.lit(3)).cast("double"), F.lit(0.0)).alias("dy"))
    pins = rows.groupBy("net").agg(F.sort_array(F.collect_list(F.struct((c("direction") != "O").cast("int").alias("sink"), "k", "node", "direction", "dx", "dy"))).alias("p"))
    return pins.select("net", F.posexplode("p").alias("pos", "x")).select("net", c("pos").cast("bigint").alias("pos"), "x.node", "x.direction", "x.dx", "x.dy")


def read_pl(spark: SparkSession, path: str) -> DataFrame:
    """name, lx, ly rounded to whole numbers, orient, fixed ('', FIXED or FIXED_NI)."""
    p = F.split(F.regexp_replace("line", ":", " "), r"\s+")
    return _lines(spark, path).select(p[0].alias("name"), F.round(p[1].cast("double")).cast("bigint").alias("lx"), F.round(p[2].cast("double")).cast("bigint").alias("ly"), F.coalesce(F.get(p, F.lit(3)), F.lit("N")).alias("orient"), F.regexp_extract("line", r"/(FIXED(?:_NI)?)", 1).alias("fixed"))


def read_scl(spark: SparkSession, path: str) -> DataFrame:
    """y, height, site_w, spacing, x, n_sites of each core row; a record begins at each CoreRow."""
    rows = spark.read.option("lineSep", "CoreRow").text(path).where(F.trim("value").startswith("Horizontal"))
    number = lambda k: F.regexp_extract("value", rf"(?i){k}\s*:\s*(-?[0-9.]+)", 1).cast("double")
    return rows.select(number("Coordinate").alias("y"), number("Height").alias("height"), number("Sitewidth").alias("site_w"), number("Sitespacing").alias("spacing"), number("SubrowOrigin").alias("x"), number("NumSites").cast("bigint").alias("n_sites"))


def read_wts(spark: SparkSession, path: str) -> None:
    """Net weights are opened and ignored."""


def pl_lines(nodes: DataFrame) -> DataFrame:
    """Placement lines of name, lx, ly, orient, fixed."""
    tail = F.when(c("fixed") != "", F.concat(F.lit(" /"), c("fixed"))).otherwise("")
    return nodes.select(F.concat(F.format_string("%s\t%d\t%d\t: %s", "name", "lx", "ly", "orient"), tail).alias("value"))


def write_pl(nodes: DataFrame, path: str) -> None:
    pl_lines(nodes).write.mode("overwrite").text(path)


def read_design(spark: SparkSession, aux: str) -> dict[str, DataFrame]:
    """The tables of a benchmark by its .aux file: nodes joined with their places, nets, rows."""
    files = read_aux(spark, aux)
    nodes = read_nodes(spark, files["nodes"]).join(read_pl(spark, files["pl"]), "name", "left")
    out = {"nodes": nodes, "nets": read_nets(spark, files["nets"])}
    if "scl" in files:
        out["rows"] = read_scl(spark, files["scl"])
    return out


def unknown_nodes(design: dict[str, DataFrame]) -> DataFrame:
    """Names in nets that no node has."""
    return design["nets"].join(design["nodes"].select(c("name").alias("node")), "node", "left_anti").select("node").distinct()
