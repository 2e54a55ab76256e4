"""Readers of the other text formats of a design flow, in the subset that the tables need.

Formats with independent records are split by the reader; nested ones are tokenised file by file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines key=value."""
    p = F.split("value", "=")
    return spark.read.text(path).where("value like '%=%'").select(F.trim(p[0]).alias("key"), F.regexp_extract(p[1], r"-?[0-9.]+", 0).cast("double").alias("value"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """name, w, h."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value").rlike(r"^\S+\s+[0-9.]+\s+[0-9.]+")).select(p[0].alias("name"), p[1].cast("double").alias("w"), p[2].cast("double").alias("h"))


def read_def(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """components (name, celltype, status, x, y, orient), nets (net, pos, inst, pin), pins, rows, die; statements end
    at ';', which the reader splits at."""
    s = spark.read.option("lineSep", ";").text(path).select(F.trim(F.regexp_replace(F.regexp_replace("value", "#[^\n]*", ""), r"\s+", " ")).alias("s"))
    comp = r"^- (\S+) (\S+) .*\+ (PLACED|FIXED) \( (-?\d+) (-?\d+) \) (\w+)"
    g = lambda k, pattern: F.regexp_extract("s", pattern, k)
    components = s.where(c("s").rlike(comp) & ~c("s").rlike(r"\+ NET ")).select(g(1, comp).alias("name"), g(2, comp).alias("celltype"), g(3, comp).alias("status"), g(4, comp).cast("bigint").alias("x"), g(5, comp).cast("bigint").alias("y"), g(6, comp).alias("orient"))
    net = s.where(c("s").rlike(r"^- \S+ \( \S+ \S+ \)")).select(g(1, r"^- (\S+)").alias("net"), F.posexplode(F.regexp_extract_all("s", F.lit(r"\( (\S+ \S+) \)"), F.lit(1))).alias("pos", "p"))
    nets = net.select("net", c("pos").cast("bigint").alias("pos"), F.split("p", " ")[0].alias("inst"), F.split("p", " ")[1].alias("pin"))
    pin = r"^- (\S+) \+ NET (\S+)"
    pins = s.where(c("s").rlike(pin)).select(g(1, pin).alias("name"), g(2, pin).alias("net"), g(1, r"\+ DIRECTION (\w+)").alias("direction"))
    row = r"^ROW (\S+) (\S+) (-?\d+) (-?\d+) (\w+) DO (\d+) BY (\d+)"
    rows = s.where(c("s").rlike(row)).select(g(1, row).alias("name"), g(2, row).alias("site"), g(3, row).cast("bigint").alias("x"), g(4, row).cast("bigint").alias("y"), g(5, row).alias("orient"), g(6, row).cast("bigint").alias("n_sites"))
    die = r"DIEAREA \( (-?\d+) (-?\d+) \) \( (-?\d+) (-?\d+) \)"
    box = s.where(c("s").rlike(die)).select(*[g(i + 1, die).cast("bigint").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    return {"components": components, "nets": nets, "pins": pins, "rows": rows, "die": box}


def def_lines(components: DataFrame) -> DataFrame:
    """Component statements as DEF text."""
    return components.select(F.format_string("- %s %s + %s ( %d %d ) %s ;", "name", "celltype", "status", "x", "y", "orient").alias("value"))


def guide_lines(routes: DataFrame) -> DataFrame:
    """Routing guides of routes (net, x, y, layer) in cells of 4 units: name and boxes, a record for each net."""
    box = F.format_string("%d %d %d %d M%d", c("x") * 4, c("y") * 4, c("x") * 4 + 4, c("y") * 4 + 4, c("layer"))
    boxes = routes.select("net", box.alias("b")).groupBy("net").agg(F.array_join(F.array_sort(F.collect_set("b")), "\n").alias("b"))
    return boxes.select(F.concat(c("net"), F.lit("\n(\n"), c("b"), F.lit("\n)")).alias("value"))


def read_lef(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """macros (name, w, h) and macro_pins (macro, pin, direction, x0, y0, x1, y1); a record begins at each MACRO."""
    m = spark.read.option("lineSep", "MACRO ").text(path).where(F.col("value").rlike(r"(?s)^\S+\s.*SIZE\s"))
    name = F.regexp_extract("value", r"^(\S+)", 1)
    size = r"SIZE\s+([0-9.]+)\s+BY\s+([0-9.]+)"
    macros = m.select(name.alias("name"), F.regexp_extract("value", size, 1).cast("double").alias("w"), F.regexp_extract("value", size, 2).cast("double").alias("h"))
    pins = m.select(name.alias("macro"), F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(PIN\s+\S+\s.*?END\s+)"), F.lit(1))).alias("p"))
    rect = r"RECT\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)\s+(-?[0-9.]+)"
    g = lambda k, pattern: F.regexp_extract("p", pattern, k)
    return {"macros": macros, "macro_pins": pins.select("macro", g(1, r"PIN\s+(\S+)").alias("pin"), g(1, r"DIRECTION\s+(\w+)").alias("direction"), *[F.expr(f"try_cast(regexp_extract(p, r'{rect}', {i + 1}) as double)").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])}


def read_verilog(spark: SparkSession, path: str) -> DataFrame:
    """celltype, inst, pin, net of the instances of a structural netlist; statements end at ';'."""
    s = spark.read.option("lineSep", ";").text(path).select(F.trim(F.regexp_replace(F.regexp_replace("value", "//[^\n]*", ""), r"\s+", " ")).alias("s"))
    head = r"^(\w+) (\S+) ?\((.*\.\w+ ?\(.*)\)$"
    rows = s.where(c("s").rlike(head)).where(~c("s").rlike(r"^(module|input|output|wire|assign)\b")).select(F.regexp_extract("s", head, 1).alias("celltype"), F.regexp_extract("s", head, 2).alias("inst"), F.explode(F.regexp_extract_all(F.regexp_extract("s", head, 3), F.lit(r"(\.\w+ ?\( ?[^)]*?\))"), F.lit(1))).alias("p"))
    return rows.select("celltype", "inst", F.regexp_extract("p", r"\.(\w+)", 1).alias("pin"), F.trim(F.regexp_extract("p", r"\(([^)]*)\)", 1)).alias("net"))


def read_sdc(spark: SparkSession, path: str) -> DataFrame:
    """command, value, clock, period, min, max, rise, fall, objects: one row a command; a missing flag of a pair means both."""
    s = spark.read.text(path).select(F.trim("value").alias("s")).where(c("s").rlike("^(set_|create_clock)"))
    has = lambda f: c("s").rlike(rf"\s-{f}\b")
    either = lambda a, b: has(a) | ~has(b)
    number = F.expr(r"try_cast(regexp_extract(regexp_replace(s, r'-(clock|period|name|waveform)\s+\S+', ''), r'\s(-?[0-9][0-9.eE+-]*)', 1) as double)")
    return s.select(
        F.regexp_extract("s", r"^(\w+)", 1).alias("command"), number.alias("value"), F.regexp_extract("s", r"-clock\s+(?:\[get_clocks\s+)?(\w+)", 1).alias("clock"),
        F.expr(r"try_cast(regexp_extract(s, r'-period\s+([0-9.]+)', 1) as double)").alias("period"), either("min", "max").alias("min"), either("max", "min").alias("max"), either("rise", "fall").alias("rise"), either("fall", "rise").alias("fall"),
        F.split(F.regexp_extract("s", r"\[get_ports\s+\{?([^}\]]*)\}?\]", 1), r"\s+").alias("objects"),
    )


def read_spef(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """caps (net, node, value) and ress (net, a, b, value) in farads and ohms; a record begins at each *D_NET.

    Units and the name map come from the file's head, its first record."""
    blocks = spark.read.option("lineSep", "*D_NET").text(path)
    head = blocks.where(c("value").rlike(r"\*SPEF"))
    unit = lambda k, names: F.coalesce(F.regexp_extract("value", rf"\*{k}_UNIT\s+([0-9.]+)", 1).cast("double") * F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), F.regexp_extract("value", rf"\*{k}_UNIT\s+[0-9.]+\s+(\w+)", 1)), F.lit(1.0))
    scale = head.select(unit("C", {"FF": 1e-15, "PF": 1e-12, "F": 1.0}).alias("cu"), unit("R", {"OHM": 1.0, "KOHM": 1e3}).alias("ru"))
    names = head.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\*\d+\s+\S+)\s*$"), F.lit(1))).alias("m")).select(F.split("m", r"\s+")[0].alias("id"), F.split("m", r"\s+")[1].alias("name"))
    nets = blocks.where(~c("value").rlike(r"\*SPEF")).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("net"), F.split(F.regexp_extract("value", r"(?s)\*CAP\s(.*?)(?:\*RES|\*END)", 1), r"\r?\n").alias("caps"), F.split(F.regexp_extract("value", r"(?s)\*RES\s(.*?)\*END", 1), r"\r?\n").alias("ress"))

    def named(df, *columns):
        for col in columns:
            root = F.regexp_extract(col, r"^(\*\d+|[^:]+)", 1)
            df = df.withColumn("_r", root).join(names.withColumnsRenamed({"id": "_r", "name": "_n"}), "_r", "left").withColumn(col, F.when(c("_n").isNotNull(), F.concat("_n", F.expr(f"substring({col}, length(_r) + 1)"))).otherwise(c(col))).drop("_r", "_n")
        return df

    cap = nets.select("net", F.explode("caps").alias("l")).select("net", F.split(F.trim("l"), r"\s+").alias("p")).where(F.size("p") == 3)
    res = nets.select("net", F.explode("ress").alias("l")).select("net", F.split(F.trim("l"), r"\s+").alias("p")).where(F.size("p") == 4)
    caps = named(cap.select("net", c("p")[1].alias("node"), c("p")[2].cast("double").alias("value")), "net", "node").join(F.broadcast(scale)).select("net", "node", (c("value") * c("cu")).alias("value"))
    ress = named(res.select("net", c("p")[1].alias("a"), c("p")[2].alias("b"), c("p")[3].cast("double").alias("value")), "net", "a", "b").join(F.broadcast(scale)).select("net", "a", "b", (c("value") * c("ru")).alias("value"))
    return {"caps": caps, "ress": ress}


_LIBERTY = re.compile(r'/\*.*?\*/|"[^"]*"|[{}();:,]|[^\s{}();:,"\\]+', re.S)


def liberty_groups(text: str) -> list[tuple]:
    """Nested (kind, args, attributes, groups) of a Liberty text."""
    tokens = [t for t in _LIBERTY.findall(text) if not t.startswith("/*")]
    at = 0

    def body():
        nonlocal at
        attributes, groups = {}, []
        while at < len(tokens) and tokens[at] != "}":
            name = tokens[at]
            at += 1
            if name == ";":
                continue
            if at < len(tokens) and tokens[at] == ":":
                at += 1
                value = []
                while at < len(tokens) and tokens[at] not in (";", "}"):
                    value.append(tokens[at].strip('"'))
                    at += 1
                attributes[name] = " ".join(value)
            elif at < len(tokens) and tokens[at] == "(":
                close = tokens.index(")", at)
                args = [t.strip('"') for t in tokens[at + 1 : close] if t != ","]
                at = close + 1
                if at < len(tokens) and tokens[at] == "{":
                    at += 1
                    inner = body()
                    at += 1
                    groups.append((name, args, *inner))
                else:
                    attributes[name] = args
        return attributes, groups

    return body()[1]


def read_liberty(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """arcs (cell, from_port, to_port, timing_type, timing_sense) and luts (of each arc, kind, axes and row-major table)
    and ports (cell, port, direction, capacitance), by a recursive reading of each file."""
    numbers = lambda x: [float(v) for part in (x or []) for v in part.replace(",", " ").split()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["value"]:
                for lib in liberty_groups(text):
                    for kind, args, _, inside in lib[3]:
                        if kind != "cell":
                            continue
                        for k, port, own, more in inside:
                            if k != "pin":
                                continue
                            rows.append(("port", args[0], port[0], None, own.get("direction"), None, None, float(own.get("capacitance", 0)), [], [], []))
                            for t, _, arc, luts in (m for m in more if m[0] == "timing"):
                                rows.append(("arc", args[0], port[0], arc.get("related_pin"), arc.get("timing_type", "combinational"), arc.get("timing_sense"), None, 0.0, [], [], []))
                                for lk, _, la, _ in luts:
                                    rows.append(("lut", args[0], port[0], arc.get("related_pin"), None, None, lk, 0.0, numbers(la.get("index_1")), numbers(la.get("index_2")), numbers(la.get("values"))))
            yield pd.DataFrame(rows, columns=["what", "cell", "port", "from_port", "a", "b", "lut", "value", "x", "y", "t"])

    t = spark.read.option("wholetext", True).text(path).mapInPandas(run, "what string, cell string, port string, from_port string, a string, b string, lut string, value double, x array<double>, y array<double>, t array<double>")
    return {
        "ports": t.where("what = 'port'").select("cell", "port", c("a").alias("direction"), c("value").alias("capacitance")),
        "arcs": t.where("what = 'arc'").select("cell", "from_port", c("port").alias("to_port"), c("a").alias("timing_type"), c("b").alias("timing_sense")),
        "luts": t.where("what = 'lut'").select("cell", "from_port", c("port").alias("to_port"), c("lut").alias("kind"), c("x").alias("indices1"), c("y").alias("indices2"), c("t").alias("table")),
    }


def read_log(spark: SparkSession, path: str, header: str = "== ") -> DataFrame:
    """section, key, value of lines 'key: number' below each header; a record begins at each header."""
    s = spark.read.option("lineSep", header).text(path)
    rows = s.select(F.regexp_extract("value", r"^(\S+)", 1).alias("section"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\w[\w ]*:\s*-?[0-9.]+)"), F.lit(1))).alias("l"))
    p = F.split("l", r":\s*")
    return rows.where("section <> ''").groupBy("section", p[0].alias("key")).agg(F.max(p[1].cast("double")).alias("value"))


def write_results(df: DataFrame, path: str) -> None:
    """One row a design, as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_design(tables: dict[str, DataFrame], path: str) -> None:
    """The tables as Parquet below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_design(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def check_params(params: dict) -> dict:
    """params if they name exactly one of def and aux, and files of the extensions that their keys ask for."""
    if ("def" in params) == ("aux" in params):
        raise ValueError("give one of def and aux")
    for key in ("def", "aux", "lef", "sdc", "spef", "lib"):
        for path in [params[key]] if isinstance(params.get(key), str) else params.get(key) or []:
            if not path.endswith(f".{key}"):
                raise ValueError(f"{path} is no .{key} file")
    return params


def custom_params(text: str) -> dict:
    """Parameters out of k:v,k:v."""
    return dict(p.split(":", 1) for p in text.split(",") if p)
