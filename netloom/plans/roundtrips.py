"""Readers and writers of design formats as queries: tables go out as text of a format, and come back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.shared import Folder
from netloom.sources import bookshelf, textual
from netloom.sources.netlist import Netlist

c = F.col


def _text(n: Netlist, df: DataFrame, name: str) -> str:
    """Writes the lines `value` of df into the shared folder and gives the path."""
    path = f"{Folder(n.spark).path}/{name}"
    df.select("value").write.text(path)
    return path


def _name(p: str, col: str):
    return F.concat(F.lit(p), c(col).cast("string"))


def _one(n: Netlist, text: str) -> DataFrame:
    return n.spark.range(1).select(F.lit(text).alias("value"))


def nodes(n: Netlist) -> DataFrame:
    """Cells as a .nodes file; high ones are terminals."""
    lines = n.nodes.select(F.concat(F.lit(" "), F.format_string("c%d %.1f %.1f", "node_id", "w", "h"), F.when(c("h") > 2.01, " terminal").otherwise("")).alias("value"))
    return bookshelf.read_nodes(n.spark, _text(n, lines, "d.nodes"))


def nets(n: Netlist) -> DataFrame:
    """Nets as a .nets file, the root pin of direction O written where it stands, and read back to the front."""
    first = n.stars.select("net_id", c("root_pin_id").alias("pin_id")).distinct().withColumn("root", F.lit(True))
    rows = n.pins.join(first, ["net_id", "pin_id"], "left")
    line = F.format_string("c%d %s : %.6f %.6f", c("node_id"), F.when(c("root"), "O").otherwise("I"), c("rel_cx"), c("rel_cy"))
    blocks = rows.groupBy("net_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    value = F.concat(F.format_string("NetDegree : %d n%d\n", F.size("ls"), "net_id"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"))
    return bookshelf.read_nets(n.spark, _text(n, blocks.select(value.alias("value")), "d.nets")).select("net", "pos", "node", "direction", "dx", "dy")


def places(n: Netlist) -> DataFrame:
    """Places half a unit off as a .pl file, read back in whole numbers."""
    rows = n.nodes.select(F.format_string("c%d %.1f %.1f : %s", c("node_id"), c("lx") + 0.5, c("ly"), F.when(c("size") % 2 == 0, "N").otherwise("FS")).alias("v"), F.when(c("h") > 2.01, " /FIXED").when(c("size") == 1, " /FIXED_NI").otherwise("").alias("t"))
    read = bookshelf.read_pl(n.spark, _text(n, rows.select(F.concat("v", "t").alias("value")), "d.pl"))
    again = _text(n, bookshelf.pl_lines(read), "again.pl")
    return bookshelf.read_pl(n.spark, again)


def rows(n: Netlist) -> DataFrame:
    """The die's rows as a .scl file."""
    value = F.format_string("CoreRow Horizontal\n  Coordinate : %d\n  Height : 1\n  Sitewidth : 1\n  Sitespacing : 1\n  SubrowOrigin : 0  NumSites : %d\nEnd", c("id"), F.lit(int(n.die_w)))
    return bookshelf.read_scl(n.spark, _text(n, n.spark.range(int(n.die_h)).select(value.alias("value")), "d.scl"))


def aux(n: Netlist) -> DataFrame:
    """The files that an .aux line names; net weights are named and ignored."""
    found = bookshelf.read_aux(n.spark, _text(n, _one(n, "RowBasedPlacement : d.nodes d.nets d.wts d.pl d.scl"), "d.aux"))
    bookshelf.read_wts(n.spark, found["wts"])
    return n.spark.createDataFrame([(k, v.rsplit("/", 1)[1]) for k, v in found.items() if k != "wts"], "ext string, name string")


def components(n: Netlist) -> DataFrame:
    """Cells as DEF components, written and read."""
    own = n.nodes.select(_name("u", "node_id").alias("name"), F.regexp_replace("celltype", "#", "").alias("celltype"), F.when(c("h") > 2.01, "FIXED").otherwise("PLACED").alias("status"), c("lx").cast("bigint").alias("x"), c("ly").cast("bigint").alias("y"), F.when(c("size") % 2 == 0, "N").otherwise("FS").alias("orient"))
    return textual.read_def(n.spark, _text(n, textual.def_lines(own), "d.def"))["components"]


def def_nets(n: Netlist) -> DataFrame:
    """Nets as DEF statements."""
    blocks = n.pins.groupBy("net_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.format_string("( u%d A%d )", "node_id", "pos").alias("t")))).alias("ts"))
    value = F.concat(F.format_string("- n%d ", "net_id"), F.array_join(F.transform("ts", lambda x: x["t"]), "\n  "), F.lit(" ;"))
    return textual.read_def(n.spark, _text(n, blocks.select(value.alias("value")), "d.def"))["nets"]


def def_rows(n: Netlist) -> DataFrame:
    """The die's rows as DEF statements."""
    value = F.format_string("ROW r%d core 0 %d %s DO %d BY 1 STEP 1 0 ;", c("id"), c("id"), F.when(c("id") % 2 == 0, "N").otherwise("FS"), F.lit(int(n.die_w)))
    return textual.read_def(n.spark, _text(n, n.spark.range(int(n.die_h)).select(value.alias("value")), "d.def"))["rows"]


def macros(n: Netlist) -> DataFrame:
    """Cell types as LEF macros with a pin each."""
    types = n.nodes.groupBy(F.regexp_replace("celltype", "#", "").alias("t")).agg(F.max("w").alias("w"), F.max("h").alias("h"))
    value = F.format_string("MACRO %s\n  SIZE %.1f BY %.1f ;\n  PIN A\n    DIRECTION INPUT ;\n    PORT LAYER M1 ; RECT 0.0 0.0 %.1f 0.5 ; END\n  END A\nEND %s", c("t"), c("w"), c("h"), c("w"), c("t"))
    got = textual.read_lef(n.spark, _text(n, types.select(value.alias("value")), "d.lef"))
    return got["macros"].join(got["macro_pins"].withColumnRenamed("macro", "name"), "name")


def instances(n: Netlist) -> DataFrame:
    """Cells with their pins as structural Verilog."""
    per = n.pins.join(n.nodes.select("node_id", "celltype"), "node_id").groupBy("node_id", "celltype").agg(F.sort_array(F.collect_list(F.struct("pin_id", F.format_string(".p%d( n%d )", "pin_id", "net_id").alias("t")))).alias("ts"))
    value = F.concat(F.regexp_replace("celltype", "#", ""), F.format_string(" u%d (", "node_id"), F.array_join(F.transform("ts", lambda x: x["t"]), ",\n  "), F.lit(");"))
    return textual.read_verilog(n.spark, _text(n, per.select(value.alias("value")), "d.v"))


def commands(n: Netlist) -> DataFrame:
    """A clock, and delays and loads of IO cells, as an SDC file."""
    io = n.nodes.where("size = 1").select(F.format_string("set_input_delay %.2f -max -clock clk [get_ports u%d]", c("w") / 4, c("node_id")).alias("value"))
    load = n.nodes.where("size = 1").select(F.format_string("set_load %.1f [get_ports u%d]", "h", "node_id").alias("value"))
    got = textual.read_sdc(n.spark, _text(n, _one(n, "create_clock -name clk -period 6.5 [get_ports clk]").union(io).union(load), "d.sdc"))
    return got.select("command", "value", "clock", "period", "min", "max", "rise", "fall", F.array_join("objects", " ").alias("objects"))


def spef_caps(n: Netlist) -> DataFrame:
    """Net loads of the star model as SPEF capacitances in femtofarads, names mapped; nets without get none here."""
    head = _one(n, '*SPEF "x"\n*C_UNIT 1 FF\n*R_UNIT 1 OHM\n*NAME_MAP\n*1 first')
    rows = n.stars.groupBy("net_id").agg(F.count("*").alias("k"))
    value = F.format_string("*D_NET n%d %d\n*CONN\n*CAP\n1 n%d:1 %d\n2 *1:2 1\n*RES\n1 n%d:0 n%d:1 %d\n*END", "net_id", "k", "net_id", "k", "net_id", "net_id", "k")
    return textual.read_spef(n.spark, _text(n, head.union(rows.select(value.alias("value"))), "d.spef"))["caps"].select("net", "node", F.round(c("value") * 1e15, 6).alias("ff"))


def spef_rc(n: Netlist) -> DataFrame:
    """net_id, ff: every net's capacitance out of SPEF, joined by name; nets that the file lacks have 0."""
    caps = spef_caps(n).where("node not like 'first%'").select("net", "ff")
    return n.nets.select("net_id", _name("n", "net_id").alias("net")).join(caps, "net", "left").select("net_id", F.coalesce("ff", F.lit(0.0)).alias("ff"))


def liberty(n: Netlist) -> DataFrame:
    """A library of all cell types, each with one arc and one table."""
    types = n.nodes.groupBy(F.regexp_replace("celltype", "#", "").alias("t")).agg(F.min("w").alias("w"))
    cell = F.format_string('cell (%s) { pin (A) { direction : input; capacitance : %.2f; } pin (Z) { direction : output; timing () { related_pin : "A"; timing_sense : positive_unate; cell_rise (x) { index_1 ("1, 2"); index_2 ("1, 2"); values ("%.1f, 2", "3, 4"); } } } }', c("t"), c("w"), c("w"))
    text = types.agg(F.concat(F.lit("library (l) { "), F.array_join(F.sort_array(F.collect_list(cell)), " "), F.lit(" }")).alias("value"))
    got = textual.read_liberty(n.spark, _text(n, text, "d.lib"))
    ports = got["ports"].where("direction = 'input'").select("cell", c("port").alias("from_port"), "capacitance")
    return got["arcs"].join(got["luts"], ["cell", "from_port", "to_port"]).join(ports, ["cell", "from_port"]).select("cell", "from_port", "to_port", "timing_type", "timing_sense", "kind", "capacitance", F.element_at("table", 1).alias("first"), F.size("table").cast("bigint").alias("size"))


def pin_capacitance(n: Netlist) -> DataFrame:
    """pin_id, capacitance: each pin by its cell's type and port in the library."""
    ports = liberty(n).select("cell", "capacitance")
    own = n.nodes.select("node_id", F.regexp_replace("celltype", "#", "").alias("cell"))
    return n.pins.join(own, "node_id").join(ports, "cell").select("pin_id", "capacitance")


def library_arcs(n: Netlist) -> DataFrame:
    """node_id, corner, from_port, to_port, sense: each cell's arcs out of the library, for the early and late corner."""
    arcs = liberty(n).select("cell", "from_port", "to_port", c("timing_sense").alias("sense"))
    own = n.nodes.select("node_id", F.regexp_replace("celltype", "#", "").alias("cell"))
    return own.join(arcs, "cell").select("node_id", F.explode(F.array(F.lit("early"), F.lit("late"))).alias("corner"), "from_port", "to_port", "sense")


def constraints(n: Netlist) -> DataFrame:
    return textual.read_constraints(n.spark, _text(n, _one(n, "maximum_utilization = 87.5%\nmaximum_movement=12 rows"), "c.txt"))


def sizes(n: Netlist) -> DataFrame:
    """Cell sizes as a text file."""
    return textual.read_sizes(n.spark, _text(n, n.nodes.select(F.format_string("c%d %.1f %.1f", "node_id", "w", "h").alias("value")), "s.txt"))


def guides(n: Netlist) -> DataFrame:
    """value: a routing guide for each net, of the cells of its pins on the first layer."""
    cells = n.pin_positions.where("px >= 0 and py >= 0").select(_name("n", "net_id").alias("net"), F.floor(c("px") / 4).cast("int").alias("x"), F.floor(c("py") / 4).cast("int").alias("y"), F.lit(1).alias("layer"))
    path = _text(n, textual.guide_lines(cells), "d.guide")
    return n.spark.read.option("lineSep", "\n)\n").text(path).select(F.regexp_extract("value", r"^(\S+)", 1).alias("net"), F.size(F.split("value", "\n")).cast("bigint").alias("n_lines"))


def results(n: Netlist) -> DataFrame:
    """A row for each run as CSV with a header, read back."""
    path = f"{Folder(n.spark).path}/run_all.csv"
    textual.write_results(n.metrics.groupBy("run").agg(F.max("iter").alias("iterations"), F.min("hpwl").alias("hpwl")), path)
    return n.spark.read.option("header", True).schema("run string, iterations bigint, hpwl double").csv(path)


def snapshot(n: Netlist) -> DataFrame:
    """Nodes and nets as a snapshot, loaded again: rows of each."""
    path = f"{Folder(n.spark).path}/snapshot"
    textual.save_design({"nodes": n.nodes, "nets": n.nets}, path)
    held = textual.load_design(n.spark, path, ["nodes", "nets"])
    return held["nodes"].agg(F.count("*").alias("n"), F.sum(c("w") * c("h")).alias("v")).select(F.lit("nodes").alias("name"), "n", "v").union(held["nets"].agg(F.count("*").alias("n"), F.sum("degree").cast("double").alias("v")).select(F.lit("nets").alias("name"), "n", "v"))


def router_log(n: Netlist) -> DataFrame:
    """The runs' figures as a router's log, read back by section and key."""
    own = n.metrics.groupBy("run").agg(F.max("iter").alias("k"), F.max("hpwl").alias("v"))
    return textual.read_log(n.spark, _text(n, own.select(F.format_string("== %s\nwire length: %.2f\nvias: %d\nnoise", "run", "v", "k").alias("value")), "r.log"))


def catalog(n: Netlist) -> DataFrame:
    """design, n_bins, target: designs out of parameters, with the overrides of those that have their own."""
    designs = [textual.check_params(textual.custom_params(f"benchmark:b{i % 2},design_name:d{i},aux:d{i}.aux")) for i in range(6)]
    table = n.spark.createDataFrame([(d["benchmark"], d["design_name"]) for d in designs], "benchmark string, design string")
    own = n.spark.createDataFrame([("d1", 512, None), ("d4", None, 0.75)], "design string, bins int, goal double")
    return table.join(own, "design", "left").select("benchmark", "design", F.coalesce("bins", F.lit(1024)).cast("bigint").alias("n_bins"), F.coalesce("goal", F.lit(0.875)).alias("target"))


_ROOT = "(select distinct net_id, root_pin_id as pin_id, true as root from stars)"
#: name, reader, and the SQL behind the netlist's tables.
TRIPS = [
    ("bookshelf_nodes", nodes, "select 'c' || node_id as name, w, h, case when h > 2.01 then 'terminal' else 'std' end as kind from nodes"),
    ("bookshelf_nets", nets, f"""select 'n' || net_id as net, row_number() over (partition by net_id order by coalesce(root, false) desc, pos) - 1 as pos, 'c' || node_id as node,
      case when root then 'O' else 'I' end as direction, rel_cx as dx, rel_cy as dy from pins left join {_ROOT} using (net_id, pin_id)"""),
    ("bookshelf_places", places, "select 'c' || node_id as name, lx::bigint + 1 as lx, ly::bigint as ly, case when size % 2 = 0 then 'N' else 'FS' end as orient, case when h > 2.01 then 'FIXED' when size = 1 then 'FIXED_NI' else '' end as fixed from nodes"),
    ("bookshelf_rows", rows, "select y::double as y, 1.0::double as height, 1.0::double as site_w, 1.0::double as spacing, 0.0::double as x, $W as n_sites from range($H) t(y)"),
    ("bookshelf_files", aux, "select * from (values ('nodes', 'd.nodes'), ('nets', 'd.nets'), ('pl', 'd.pl'), ('scl', 'd.scl')) t(ext, name)"),
    ("def_components", components, "select 'u' || node_id as name, replace(celltype, '#', '') as celltype, case when h > 2.01 then 'FIXED' else 'PLACED' end as status, lx::bigint as x, ly::bigint as y, case when size % 2 = 0 then 'N' else 'FS' end as orient from nodes"),
    ("def_nets", def_nets, "select 'n' || net_id as net, pos, 'u' || node_id as inst, 'A' || pos as pin from pins"),
    ("def_rows", def_rows, "select 'r' || y as name, 'core' as site, 0::bigint as x, y, case when y % 2 = 0 then 'N' else 'FS' end as orient, $W as n_sites from range($H) t(y)"),
    ("lef_macros", macros, "select replace(celltype, '#', '') as name, max(w) as w, max(h) as h, 'A' as pin, 'INPUT' as direction, 0.0::double as x0, 0.0::double as y0, max(w) as x1, 0.5::double as y1 from nodes group by celltype"),
    ("verilog_instances", instances, "select replace(celltype, '#', '') as celltype, 'u' || node_id as inst, 'p' || pin_id as pin, 'n' || net_id as net from pins join nodes using (node_id)"),
    ("sdc_commands", commands, """select 'create_clock' as command, null::double as value, '' as clock, 6.5::double as period, true as min, true as max, true as rise, true as fall, 'clk' as objects
      union all select 'set_input_delay', w / 4, 'clk', null, false, true, true, true, 'u' || node_id from nodes where size = 1
      union all select 'set_load', h, '', null, true, true, true, true, 'u' || node_id from nodes where size = 1"""),
    ("spef_caps", spef_caps, "select 'n' || net_id as net, 'n' || net_id || ':1' as node, count(*)::double as ff from stars group by net_id union all select distinct 'n' || net_id, 'first:2', 1.0::double from stars"),
    ("spef_rc", spef_rc, "select net_id, coalesce(k, 0)::double as ff from nets left join (select net_id, count(*) as k from stars group by net_id) using (net_id)"),
    ("liberty_arcs", liberty, "select replace(celltype, '#', '') as cell, 'A' as from_port, 'Z' as to_port, 'combinational' as timing_type, 'positive_unate' as timing_sense, 'cell_rise' as kind, min(w) as capacitance, min(w) as first, 4::bigint as size from nodes group by celltype"),
    ("pin_capacitance", pin_capacitance, "select pin_id, m as capacitance from pins join nodes using (node_id) join (select celltype, min(w) as m from nodes group by celltype) using (celltype)"),
    ("library_arcs", library_arcs, "select node_id, corner, 'A' as from_port, 'Z' as to_port, 'positive_unate' as sense from nodes, (values ('early'), ('late')) t(corner)"),
    ("constraints", constraints, "select * from (values ('maximum_utilization', 87.5::double), ('maximum_movement', 12.0::double)) t(key, value)"),
    ("cell_sizes", sizes, "select 'c' || node_id as name, w, h from nodes"),
    ("routing_guides", guides, "select 'n' || net_id as net, count(distinct floor(px / 4) * 1000000 + floor(py / 4)) + 2 as n_lines from pp where px >= 0 and py >= 0 group by net_id"),
    ("result_table", results, "select run, max(iter) as iterations, min(hpwl) as hpwl from metrics group by run"),
    ("design_snapshot", snapshot, "select 'nodes' as name, count(*) as n, sum(w * h) as v from nodes union all select 'nets', count(*), sum(degree)::double from nets"),
    ("router_log", router_log, "select run as section, 'wire length' as key, round(max(hpwl), 2) as value from metrics group by run union all select run, 'vias', max(iter)::double from metrics group by run"),
    ("design_catalog", catalog, "select 'b' || (i % 2) as benchmark, 'd' || i as design, case i when 1 then 512 else 1024 end::bigint as n_bins, case i when 4 then 0.75 else 0.875 end::double as target from range(6) t(i)"),
]
