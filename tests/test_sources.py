"""Small files of each format, read and written."""

import pytest
from pyspark.sql import functions as F

from netloom.sources import bookshelf, textual
from netloom.streaming.plateau import windowed_spread


def put(path, name, text):
    (path / name).write_text(text)
    return str(path / name)


def test_bookshelf(spark, tmp_path):
    aux = put(tmp_path, "d.aux", "RowBasedPlacement : d.nodes d.nets d.wts d.pl d.scl\n")
    put(tmp_path, "d.nodes", "UCLA nodes 1.0\n# c\nNumNodes : 3\nNumTerminals : 1\n a 2 1\n b 3 1 # tail\n t 1 1 terminal_NI\n")
    put(tmp_path, "d.nets", "UCLA nets 1.0\nNumNets : 2\nNumPins : 3\nNetDegree : 2 n0\n a I : 0.5 -0.5\n b O : 1 0\nNetDegree : 1 n1\n t I\n")
    put(tmp_path, "d.wts", "")
    put(tmp_path, "d.pl", "UCLA pl 1.0\na 1.5 2 : N\nb 2.4 0 : FS /FIXED\nt 0 0 : N /FIXED_NI\n")
    put(tmp_path, "d.scl", "UCLA scl 1.0\nNumRows : 1\nCoreRow Horizontal\n Coordinate : 4\n Height : 12\n Sitewidth : 1\n Sitespacing : 1\n SubrowOrigin : 2 NumSites : 30\nEnd\n")
    d = bookshelf.read_design(spark, aux)
    nodes = {r["name"]: r for r in d["nodes"].collect()}
    assert (nodes["a"]["lx"], nodes["a"]["kind"], nodes["b"]["fixed"], nodes["t"]["fixed"], nodes["t"]["kind"]) == (2, "std", "FIXED", "FIXED_NI", "terminal_NI")
    nets = [tuple(r) for r in d["nets"].orderBy("net", "pos").collect()]
    assert nets == [("n0", 0, "b", "O", 1.0, 0.0), ("n0", 1, "a", "I", 0.5, -0.5), ("n1", 0, "t", "I", 0.0, 0.0)]
    assert tuple(d["rows"].first()) == (4.0, 12.0, 1.0, 1.0, 2.0, 30)
    assert bookshelf.unknown_nodes(d).count() == 0
    bookshelf.write_pl(d["nodes"], str(tmp_path / "out"))
    again = {r["name"]: (r["lx"], r["ly"], r["orient"], r["fixed"]) for r in bookshelf.read_pl(spark, str(tmp_path / "out")).collect()}
    assert again == {n: (r["lx"], r["ly"], r["orient"], r["fixed"]) for n, r in nodes.items()}


def test_def_lef_verilog(spark, tmp_path):
    d = textual.read_def(spark, put(tmp_path, "d.def", "VERSION 5.8 ;\nDIEAREA ( 0 0 ) ( 100 200 ) ;\nROW r0 core 0 10 N DO 30 BY 1 STEP 2 0 ;\nCOMPONENTS 2 ;\n- u1 INV + PLACED ( 1 2 ) N ;\n- u2 BUF + SOURCE DIST\n + FIXED ( 3 -4 ) FS ;\nEND COMPONENTS\nPINS 1 ;\n- p + NET n1 + DIRECTION INPUT + PLACED ( 0 0 ) N ;\nEND PINS\nNETS 1 ;\n- n1 ( PIN p ) ( u1 A ) ;\nEND NETS\n"))
    assert sorted(tuple(r) for r in d["components"].collect()) == [("u1", "INV", "PLACED", 1, 2, "N"), ("u2", "BUF", "FIXED", 3, -4, "FS")]
    assert [tuple(r) for r in d["nets"].orderBy("pos").collect()] == [("n1", 0, "PIN", "p"), ("n1", 1, "u1", "A")]
    assert tuple(d["die"].first()) == (0, 0, 100, 200) and d["rows"].first()["n_sites"] == 30 and tuple(d["pins"].first()) == ("p", "n1", "INPUT")
    lines = {r[0] for r in textual.def_lines(d["components"]).collect()}
    assert "- u2 BUF + FIXED ( 3 -4 ) FS ;" in lines
    lef = textual.read_lef(spark, put(tmp_path, "d.lef", "VERSION 5.8 ;\nMACRO INV\n SIZE 1.5 BY 2 ;\n PIN A\n  DIRECTION INPUT ;\n  PORT LAYER M1 ; RECT 0.1 0.2 0.3 0.4 ; END\n END A\nEND INV\n"))
    assert tuple(lef["macros"].first()) == ("INV", 1.5, 2.0) and tuple(lef["macro_pins"].first())[:3] == ("INV", "A", "INPUT")
    v = textual.read_verilog(spark, put(tmp_path, "d.v", "module top (a, b);\ninput a;\nINV u1 ( .A(a), .Z( n1 ) );\nBUF u2 (.A(n1),\n .Z(b));\nendmodule\n"))
    assert sorted(tuple(r) for r in v.collect()) == [("BUF", "u2", "A", "n1"), ("BUF", "u2", "Z", "b"), ("INV", "u1", "A", "a"), ("INV", "u1", "Z", "n1")]


def test_sdc_spef_liberty(spark, tmp_path):
    sdc = {r["command"]: r for r in textual.read_sdc(spark, put(tmp_path, "d.sdc", "create_clock -name clk -period 2.5 [get_ports clk]\nset_input_delay 0.3 -max -clock clk [get_ports {a b}]\nset_load 4 [get_ports z]\n")).collect()}
    assert sdc["create_clock"]["period"] == 2.5 and sdc["set_input_delay"]["value"] == 0.3 and sdc["set_input_delay"]["objects"] == ["a", "b"]
    assert not sdc["set_input_delay"]["min"] and sdc["set_input_delay"]["max"] and sdc["set_load"]["min"] and sdc["set_load"]["rise"]
    spef = textual.read_spef(spark, put(tmp_path, "d.spef", "*SPEF \"x\"\n*C_UNIT 1 PF\n*R_UNIT 1 KOHM\n*NAME_MAP\n*1 net1\n*2 u1\n*D_NET *1 5\n*CONN\n*I *2:A I\n*CAP\n1 *2:A 2.5\n*RES\n1 *1 *2:A 3\n*END\n"))
    assert [tuple(r)[:2] for r in spef["caps"].collect()] == [("net1", "u1:A")] and abs(spef["caps"].first()["value"] - 2.5e-12) < 1e-20
    assert [tuple(r) for r in spef["ress"].collect()] == [("net1", "net1", "u1:A", 3000.0)]
    lib = textual.read_liberty(spark, put(tmp_path, "d.lib", 'library (l) { cell (INV) { area : 1; pin (A) { direction : input; capacitance : 0.5; } pin (Z) { direction : output; timing () { related_pin : "A"; timing_sense : negative_unate; cell_rise (t) { index_1 ("1, 2"); index_2 ("3, 4"); values ("1, 2", "3, 4"); } } } } }'))
    assert tuple(lib["arcs"].first()) == ("INV", "A", "Z", "combinational", "negative_unate")
    assert tuple(lib["luts"].first())[4:] == ([1.0, 2.0], [3.0, 4.0], [1.0, 2.0, 3.0, 4.0])
    assert {(r["port"], r["capacitance"]) for r in lib["ports"].collect()} == {("A", 0.5), ("Z", 0.0)}


def test_logs_params_and_snapshots(spark, tmp_path):
    log = {(r["section"], r["key"]): r["value"] for r in textual.read_log(spark, put(tmp_path, "l.txt", "== d1\nwl: 10\nvias: 3\n== d2\nwl: 7.5\nnoise\n")).collect()}
    assert log == {("d1", "wl"): 10.0, ("d1", "vias"): 3.0, ("d2", "wl"): 7.5}
    c = {r["key"]: r["value"] for r in textual.read_constraints(spark, put(tmp_path, "c.txt", "max_util = 80%\nmax_move=5\n")).collect()}
    assert c == {"max_util": 80.0, "max_move": 5.0}
    assert tuple(textual.read_sizes(spark, put(tmp_path, "s.txt", "a 2 3\n")).first()) == ("a", 2.0, 3.0)
    for bad in ({}, {"def": "a.def", "aux": "a.aux"}, {"aux": "a.txt"}):
        with pytest.raises(ValueError):
            textual.check_params(bad)
    assert textual.check_params(textual.custom_params("aux:a.aux,benchmark:x"))["benchmark"] == "x"
    textual.save_design({"t": spark.range(3)}, str(tmp_path / "snap"))
    assert textual.load_design(spark, str(tmp_path / "snap"), ["t"])["t"].count() == 3
    g = textual.guide_lines(spark.createDataFrame([("n", 0, 1, 1), ("n", 1, 1, 1)], "net string, x int, y int, layer int")).first()[0]
    assert g == "n\n(\n0 4 4 8 M1\n4 4 8 8 M1\n)"


def test_spread_of_windows(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 3.0), ("a", 3600, 5.0)], "run string, s int, hpwl double").select("run", "hpwl", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r["n"], r["spread"]) for r in windowed_spread(rows).collect())
    assert got == [(1, 0.0), (2, 1.0)]
