"""Hand-made netlists and properties of the operators."""

import itertools
import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netloom.operators import convergence, detailed, grid, legality, routing, timing, wirelength

NODES = "node_id bigint, lx double, ly double, w double, h double, celltype string, layer bigint, size bigint"
few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def nodes_of(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), float(w), float(h), "T", 0, 2) for i, (x, y, w, h) in enumerate(rows)], NODES)


def positions_of(spark, nets):
    rows = [(n * 100 + k, n, n * 100 + k, 0, float(x), float(y)) for n, pins in enumerate(nets) for k, (x, y) in enumerate(pins)]
    return spark.createDataFrame(rows, "pin_id bigint, net_id bigint, node_id bigint, layer bigint, px double, py double")


def test_roundings_differ(spark):
    p = positions_of(spark, [[(0, 0), (2.5, 0.5)], [(0, 0), (3.5, 1.5)]])
    assert wirelength.hpwl_exact(p).first()[0] == 2 + 0 + 4 + 2
    assert wirelength.hpwl_masked(p, 8).first()["hpwl"] == 3 + 1 + 4 + 2


@few
@given(st.lists(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=2, max_size=5), min_size=1, max_size=4), st.integers(-9, 9))
def test_length_is_translation_invariant_and_gradients_cancel(spark, nets, d):
    a = wirelength.hpwl_total(positions_of(spark, nets)).first()
    b = wirelength.hpwl_total(positions_of(spark, [[(x + d, y - d) for x, y in n] for n in nets])).first()
    assert a == b
    g = wirelength.wa_pin_gradient(positions_of(spark, nets), 4.0, 8)
    sums = g.groupBy(F.floor(F.col("pin_id") / 100)).agg(F.sum("gx"), F.sum("gy")).collect()
    assert all(abs(r[1]) < 1e-4 and abs(r[2]) < 1e-4 for r in sums)


def test_weighted_average_tends_to_half_perimeter(spark):
    p = positions_of(spark, [[(0, 0), (3, 4), (10, 2)]])
    r = wirelength.wa_wirelength(p, 0.05, 8).first()
    assert abs(r["wa_x"] - 10) < 1e-3 and abs(r["wa_y"] - 4) < 1e-3


@few
@given(st.lists(st.tuples(st.integers(0, 28), st.integers(0, 12), st.integers(1, 4), st.integers(1, 4)), min_size=1, max_size=6))
def test_density_keeps_the_area(spark, rows):
    d = grid.density_map(nodes_of(spark, rows), 4.0, 8, 4)
    assert d.agg(F.sum(F.col("density") * 16)).first()[0] == sum(w * h for _, _, w, h in rows)


def test_box_over_four_bins_and_outside(spark):
    d = {(r["ix"], r["iy"]): r["density"] for r in grid.density_map(nodes_of(spark, [(3, 3, 2, 2), (40, 40, 1, 1)]), 4.0, 8, 4).collect()}
    assert d == {(0, 0): 1 / 16, (1, 0): 1 / 16, (0, 1): 1 / 16, (1, 1): 1 / 16}


def test_transform_is_orthonormal(spark):
    rng = np.random.default_rng(1)
    rows = [(i, j, float(rng.integers(0, 9))) for i in range(8) for j in range(4)]
    g = spark.createDataFrame(rows, "ix bigint, iy bigint, density double")
    c = grid.dct2(g, 8, 4)
    assert abs(c.agg(F.sum(F.col("coef") ** 2)).first()[0] - sum(v * v for *_, v in rows)) < 1e-6
    back = {(r["ix"], r["iy"]): r["value"] for r in grid.idct2(c, 8, 4).collect()}
    assert all(abs(back[i, j] - v) < 1e-9 for i, j, v in rows)


@few
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 8), st.integers(1, 9), st.integers(1, 9)), min_size=2, max_size=8))
def test_overlaps_match_brute_force(spark, rows):
    got = {(r["a"], r["b"], r["ox"], r["oy"]) for r in legality.overlap_pairs(legality.boxes_of(nodes_of(spark, rows)), 8.0).collect()}
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        ox, oy = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        if ox > 0 and oy > 0:
            want.add((i, j, float(ox), float(oy)))
    assert got == want


def test_rows_abutment_overlap_blanks(spark):
    n = nodes_of(spark, [(0, 0, 4, 1), (4, 0, 2, 1), (5, 0, 2, 1), (10, 1, 2, 1)])
    assert [(r["left_id"], r["right_id"], r["overlap"]) for r in legality.row_overlaps(n).collect()] == [(1, 2, 1.0)]
    assert {(r["row"], r["x0"], r["x1"]) for r in legality.blanks(n, 12.0).collect()} == {(0, 7.0, 12.0), (1, 0.0, 10.0)}


def test_table_inside_and_beyond(spark):
    arcs = spark.createDataFrame([(2, 100, 1.25), (9, 101, 3.5)], "src bigint, dst bigint, delay double")
    got = {r["src"]: r["value"] for r in timing.lut_delay(arcs).collect()}
    row, next_row = 4 + (8 - 4) * (9 - 4) / 4, 8 + (16 - 8) * (9 - 4) / 4  # at y = 9, beyond the axis
    assert got[2] == 1.5 and got[9] == row + (next_row - row) * (3.5 - 1.5)


def test_chain_of_arcs(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 1.0), (2, 3, 1.5)], "src bigint, dst bigint, delay double")
    at = timing.arrivals(arcs)
    assert {r["node_id"]: (r["level"], r["at_early"], r["at_late"]) for r in at.collect()} == {0: (0, 0, 0), 1: (1, 1, 1), 2: (2, 1, 3), 3: (3, 2.5, 4.5)}
    rat = timing.required(arcs, 4.0)
    slack = {r["node_id"]: r["slack"] for r in timing.slacks(at, rat).collect()}
    assert slack == {0: -0.5, 1: -0.5, 2: -0.5, 3: -0.5}
    path = timing.k_paths(timing.endpoint_slacks(arcs, at, 4.0, 0.0), at, 1).orderBy("step")
    assert [r["node_id"] for r in path.collect()] == [3, 2, 1, 0]


def test_cycle_is_an_error(spark):
    arcs = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src bigint, dst bigint, delay double")
    try:
        timing.levels(arcs, 4)
    except ValueError:
        return
    raise AssertionError("no error")


def test_plateau_needs_a_full_window(spark):
    log = spark.createDataFrame([("r", i, 10.0 if i > 3 else 10.0 * i) for i in range(1, 9)], "run string, iter bigint, hpwl double")
    flat = [r["flat"] for r in convergence.plateaus(log, 3, 0.1).orderBy("iter").collect()]
    assert flat[:2] == [None, None] and flat[-1] is True and flat[2] is False


def test_ace_indices(spark):
    con = spark.createDataFrame([(i, 0, float(i), 0.0, 0.0) for i in range(200)], "x bigint, y bigint, h double, v double, total double")
    got = {r["per_mille"]: r["value"] for r in routing.ace(con).where("dir = 'h'").collect()}
    assert got[5] == np.mean([199, 198]) and got[500] == np.mean(range(99, 200))


def test_abacus_leaves_no_overlap(spark):
    rng = np.random.default_rng(2)
    n = nodes_of(spark, [(int(x), 0, int(w), 1) for x, w in zip(rng.integers(0, 60, 20), rng.integers(1, 5, 20))])
    moved = detailed.abacus_rows(n, 100.0).join(n, "node_id").orderBy("x").collect()
    assert all(a["x"] + a["w"] <= b["x"] + 1e-9 for a, b in zip(moved, moved[1:])) and moved[0]["x"] >= 0 and moved[-1]["x"] + moved[-1]["w"] <= 100


def test_wires_stay_whole(spark):
    """Two rows a pin at most and one a cell of the grid, however long wires are; the sums along them are those over their cells."""
    rng = random.Random(5)
    at = lambda: rng.randrange(12)
    rows = [(i // 3, i, at(), at(), at(), at()) for i in range(150)]
    seg = spark.createDataFrame(rows, "net_id bigint, pin_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    wires, routes = routing.l_wires(seg), routing.l_routes(seg)
    dem = {(r["dir"], r["x"], r["y"]): r["demand"] for r in routing.demand(routes).collect()}
    line = lambda r: (r["dir"], r["at"], r["line"]) if r["dir"] == "h" else (r["dir"], r["line"], r["at"])
    assert {line(r): r["demand"] for r in routing.wire_demand(wires).collect()} == dem
    want, nets = {}, set()
    for r in routes.collect():
        over = max(0, dem[r["dir"], r["x"], r["y"]] - 8)
        x = want.setdefault(r["pin_id"], [0, 0])
        x[r["dir"] == "v"] += over
        nets |= {r["net_id"]} if over else set()
    got = routing.route_force(wires, routing.wire_demand(wires), 8).collect()
    assert {r["pin_id"]: (r["gx"], r["gy"]) for r in got} == {p: (round(a / 8, 6), round(b / 8, 6)) for p, (a, b) in want.items()}
    hit = {r["net_id"] for r in routing.overflow_nets(wires, routing.wire_demand(wires), 8).collect()}
    assert hit == nets and 0 < len(nets) < 50
    long = spark.createDataFrame([(1, 2, 0, 0, 10**12, 0)], seg.schema)
    assert [tuple(r) for r in routing.l_wires(long).collect()] == [(1, 2, "h", 0, 1, 10**12)]
