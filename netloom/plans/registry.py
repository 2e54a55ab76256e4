"""The netlist queries and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.functions import col as F_col

from netloom.operators import convergence as cv
from netloom.operators import detailed as dp
from netloom.operators import grid as gd
from netloom.operators import legality as lg
from netloom.operators import netstats as ns
from netloom.operators import propagation as pg
from netloom.operators import routing as rt
from netloom.operators import timing as tm
from netloom.operators import wirelength as wl
from netloom.plans import roundtrips
from netloom.sources.netlist import BIN, MAX_DEGREE, PRELUDE, TARGET, Netlist

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
GAMMA, PERIOD, CAP = 4.0, 6.0, 60


def query(name: str, build: Callable[[Netlist], DataFrame], sql: str | None = None, more: str = "") -> None:
    """Registers build(netlist), and sql behind the netlist's tables and `more` of its own; $W, $H, $NX and $NY are the die's."""
    QUERIES[name] = lambda spark, sf_dir: build(Netlist(spark, sf_dir))
    if sql:
        text = (f", {more.strip().rstrip(',')}\n" if more else "") + sql
        for mark in ("nx", "ny", "w", "h"):
            text = text.replace(f"${mark.upper()}", f"(select {mark} from die)")
        ORACLES[name] = PRELUDE + text


def _r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0.0)"


# Wirelength
BOX = "box as (select net_id, count(*) as degree, min(px) as x0, max(px) as x1, min(py) as y0, max(py) as y1 from pp group by net_id)"
query("pin_position", lambda n: n.pin_positions.select("pin_id", "px", "py"), "select pin_id, px, py from pp")
query("hpwl_per_net", lambda n: wl.hpwl_per_net(n.nets, n.pin_positions), "select net_id, coalesce(x1 - x0, 0) as hpwl_x, coalesce(y1 - y0, 0) as hpwl_y from nets left join box using (net_id)", BOX)
query("hpwl_exact", lambda n: wl.hpwl_exact(n.pin_positions), "select sum(round_even(x1 - x0, 0) + round_even(y1 - y0, 0)) as hpwl from box", BOX)
query("hpwl_masked", lambda n: wl.hpwl_masked(n.pin_positions, MAX_DEGREE), "select sum(round(x1 - x0) + round(y1 - y0)) as hpwl, count(*) as n_nets from box where degree between 2 and 8", BOX)
query("hpwl_dbu", lambda n: wl.hpwl_dbu(n.pin_positions), "select sum((x1 - x0 + y1 - y0) * 64)::bigint as hpwl from box where degree >= 2", BOX)
query("hpwl_total", lambda n: wl.hpwl_total(n.pin_positions), "select sum(x1 - x0) as hpwl_x, sum(y1 - y0) as hpwl_y from box", BOX)
WA = f"""wa0 as (select pp.*, degree, x0, x1, y0, y1, exp((px - x1) / 4) as ex, exp((x0 - px) / 4) as fx, exp((py - y1) / 4) as ey, exp((y0 - py) / 4) as fy from pp join box using (net_id) where degree between 2 and 8),
wa1 as (select *, sum(ex) over w as sex, sum(fx) over w as sfx, sum(ex * px) over w as xex, sum(fx * px) over w as xfx, sum(ey) over w as sey, sum(fy) over w as sfy, sum(ey * py) over w as xey, sum(fy * py) over w as xfy
  from wa0 window w as (partition by net_id)),
wag as (select pin_id, net_id, node_id, ex / sex * (1 + (px - xex / sex) / 4) - fx / sfx * (1 - (px - xfx / sfx) / 4) as gx, ey / sey * (1 + (py - xey / sey) / 4) - fy / sfy * (1 - (py - xfy / sfy) / 4) as gy from wa1)"""
WAG = BOX + ", " + WA
query("wa_wirelength", lambda n: wl.wa_wirelength(n.pin_positions, GAMMA, MAX_DEGREE), f"select net_id, {_r('max(xex / sex - xfx / sfx)')} as wa_x, {_r('max(xey / sey - xfy / sfy)')} as wa_y from wa1 group by net_id", WAG)
query("wa_pin_gradient", lambda n: wl.wa_pin_gradient(n.pin_positions, GAMMA, MAX_DEGREE), f"select pin_id, {_r('gx')} as gx, {_r('gy')} as gy from wag", WAG)
query("wa_node_gradient", lambda n: wl.wa_node_gradient(n.pin_positions, GAMMA, MAX_DEGREE), f"select node_id, {_r('sum(gx)')} as gx, {_r('sum(gy)')} as gy from wag group by node_id", WAG)
query("root_sink_wa", lambda n: wl.root_sink_wa(n.stars, GAMMA), f"select net_id, {_r('sum((1 + layer / 8) * ((px - root_px) * tanh((px - root_px) / 8) + (py - root_py) * tanh((py - root_py) / 8)))')} as wl from stars group by net_id")
NODE_GRAD = "ng as (select node_id, (round(sum(gx), 6) + 0.0) as gx, (round(sum(gy), 6) + 0.0) as gy, sum(gx) as rx, sum(gy) as ry from wag group by node_id), cnt as (select node_id, count(*) as n from pins group by node_id)"
query("precond_gradient", lambda n: wl.preconditioned(wl.node_gradient(n.pin_positions, GAMMA, MAX_DEGREE), n.pins, n.nodes, 0.5, 2.0), f"select node_id, {_r('rx / greatest(1.0, n + w * h)')} as gx, {_r('ry / greatest(1.0, n + w * h)')} as gy from ng join cnt using (node_id) join nodes using (node_id)", WAG + ", " + NODE_GRAD)
query("norm_ratio", lambda n: wl.norm_ratio(wl.wa_node_gradient(n.pin_positions, GAMMA, MAX_DEGREE)), "select round(sum(abs(gx)) / sum(abs(gy)), 4) as l1_ratio, round(sqrt(sum(gx * gx)) / sqrt(sum(gy * gy)), 4) as l2_ratio from ng", WAG + ", " + NODE_GRAD)

# Counts and derived columns
query("net_degree", lambda n: n.nets.select("net_id", "degree"), "select net_id, degree from nets")
query("net_mask", lambda n: n.nets.select("net_id", "mask"), "select net_id, mask from nets")
query("pins_per_node", lambda n: ns.pins_per_node(n.nodes, n.pins), "select node_id, coalesce(n, 0) as n_pins from nodes left join (select node_id, count(*) as n from pins group by node_id) using (node_id)")
query("design_stats", lambda n: ns.design_stats(n.nodes, n.nets, n.pins), """select (select count(*) from nodes) as n_nodes, (select count(*) from macros) as n_macros, (select sum(w * h) from nodes) as area,
  count(*) as n_nets, count(*) filter (degree = 0) as n_empty, count(*) filter (mask) as n_masked, sum(degree)::bigint as n_pins, max(degree) as max_degree from nets""")
query("macro_flag", lambda n: ns.macro_flags(n.nodes), """select node_id, h > 2.01 and w * h > 10 * (select avg(a) from (select w * h as a, row_number() over (order by w * h) as k, count(*) over () as n from nodes) where k <= n * 999 // 1000) / 4 as is_macro from nodes""")
query("cell_clamp", lambda n: ns.cell_clamp(n.nodes, BIN), "select node_id, round(greatest(w, sqrt(2.0) * 4), 6) as cw, round(greatest(h, sqrt(2.0) * 4), 6) as ch, round(w * h / (greatest(w, sqrt(2.0) * 4) * greatest(h, sqrt(2.0) * 4)), 6) as ratio from nodes")
query("filler_stats", lambda n: ns.filler_stats(n.nodes, n.die_w * n.die_h, TARGET), """select round(greatest(0, $W * $H * 0.875 - any_value(area)) / avg(w))::bigint as n_fillers, round(avg(w), 6) as filler_w, 1.0::double as filler_h
  from (select w, row_number() over (order by w) as k, count(*) over () as n, sum(w * h) over () as area from nodes where h <= 2.01) where k > n * 5 // 100 and k <= n * 95 // 100""")
query("region_area", lambda n: ns.region_area(n.nodes, n.die_w * n.die_h / 25), "select celltype, count(*) as n, sum(w * h) as area, ($W * $H / 25.0)::double - sum(w * h) as free from nodes group by celltype")
query("missing_names", lambda n: ns.missing_names(n.pins, n.nodes, n.nets), "select 'node' as kind, node_id as id from nodes where node_id not in (select node_id from pins) union all select 'net', net_id from nets where degree = 0")
query("node_classes", lambda n: ns.node_classes(n.nodes, n.pins), "select node_id, case when size = 1 then case when o then 'IOPin' else 'FloatIOPin' end when layer = 5 then case when o then 'Fix' else 'FloatFix' end when o then 'Mov' else 'FloatMov' end as node_type from (select *, node_id in (select node_id from pins) as o from nodes)")
query("special_tags", lambda n: ns.special_tags(n.nodes), "select node_id, (case when starts_with(celltype, 'Brand#1') then 1 when starts_with(celltype, 'Brand#2') then 2 else 0 end)::bigint as tag from nodes")
query("position_clamp", lambda n: ns.clamp_positions(n.nodes, n.die_w, n.die_h), "select node_id, round(least(greatest(lx + w / 2 - 8, w / 2 + 1e-4), $W - w / 2 - 1e-4), 6) as cx, round(least(greatest(ly + h / 2 + 8, h / 2 + 1e-4), $H - h / 2 - 1e-4), 6) as cy from nodes")
query("site_snap", lambda n: ns.snapped(n.nodes, 2.5), "select node_id, floor(lx / 2.5 + 1e-4)::bigint as low, ceil(lx / 2.5 - 1e-4)::bigint as high, floor(lx / 2.5 + 0.5)::bigint as near from nodes")
query("scaled_geometry", lambda n: ns.scaled(n.nodes, 4.0, 16.0, 8.0), "select node_id, (lx - 16) / 4 as lx, (ly - 8) / 4 as ly, w / 4 as w, h / 4 as h from nodes")
query("orientation", lambda n: ns.oriented(n.nodes), """select node_id, o as orient, case when o % 2 = 1 then h else w end as ow, case when o % 2 = 1 then w else h end as oh,
  case o when 0 then w / 4 when 1 then h - h / 2 when 2 then w - w / 4 when 3 then h / 2 when 4 then w - w / 4 when 5 then h / 2 when 6 then w / 4 else h - h / 2 end as px,
  case o when 0 then h / 2 when 1 then w / 4 when 2 then h - h / 2 when 3 then w - w / 4 when 4 then h / 2 when 5 then w / 4 when 6 then h - h / 2 else w - w / 4 end as py from (select *, size % 8 as o from nodes)""")
query("random_spread", lambda n: ns.spread_positions(n.nodes, int(n.die_w), int(n.die_h)), "select node_id, (node_id * 1103515245 + 12345) % 2147483648 % $W as x, (node_id * 22695477 + 1) % 2147483648 % $H as y from nodes")
query("inflated_pins", lambda n: ns.inflated_offsets(n.pins, n.nodes), "select pin_id, rel_cx * r as rel_cx, rel_cy * r as rel_cy from (select pin_id, rel_cx, rel_cy, case when layer = 5 then 1.0::double else 1 + layer / 8 end as r from pins join nodes using (node_id))")

# Grid
CELLS = """cells as (select node_id, layer, ix, iy, greatest(0.0, least(lx + w, (ix + 1) * 4.0) - greatest(lx, ix * 4.0)) * greatest(0.0, least(ly + h, (iy + 1) * 4.0) - greatest(ly, iy * 4.0)) as part
  from nodes, unnest(range(greatest(0, floor(lx / 4))::bigint, least($NX - 1, ceil((lx + w) / 4) - 1)::bigint + 1)) a(ix), unnest(range(greatest(0, floor(ly / 4))::bigint, least($NY - 1, ceil((ly + h) / 4) - 1)::bigint + 1)) b(iy)),
den as (select ix, iy, sum(part) / 16 as density from cells group by ix, iy)"""
density = lambda n: gd.density_map(n.nodes, BIN, n.nx, n.ny)
query("density_map", density, "select ix, iy, density from den", CELLS)
query("density_naive", lambda n: gd.density_naive(n.nodes, BIN, n.nx, n.ny, TARGET), "select ix, iy, least(1.0, density) * 0.875 as density from den", CELLS)
query("initial_density", lambda n: gd.initial_density(n.nodes, BIN, n.nx, n.ny, TARGET), "select ix, iy, least(1.0, sum(part) / 16) * 0.875 as density from cells where layer = 5 group by ix, iy", CELLS)
query("density_overflow", lambda n: gd.density_overflow(density(n), n.nodes, BIN, TARGET), "select sum(greatest(0.0, density - 0.875) * 16)::double as overflow_area, round(sum(greatest(0.0, density - 0.875) * 16) / (select sum(w * h) from nodes), 9) as overflow, max(density) as max_density from den", CELLS)
query("density_gather", lambda n: gd.density_gather(n.nodes, density(n), BIN, n.nx, n.ny), "select node_id, sum(part * density) as force from cells join den using (ix, iy) group by node_id", CELLS)
congested = lambda n: density(n).select("ix", "iy", F_col("density").alias("value"))
query("inflate_ratio_avg", lambda n: gd.inflate_ratio(n.nodes, congested(n), BIN, n.nx, n.ny, "avg"), "select node_id, round(sum(part * density) / sum(part), 9) as ratio from cells join den using (ix, iy) group by node_id", CELLS)
query("inflate_ratio_max", lambda n: gd.inflate_ratio(n.nodes, congested(n), BIN, n.nx, n.ny, "max"), """select node_id, max(density) as ratio from nodes, unnest(range(floor(lx / 4)::bigint, least($NX - 1, floor((lx + w) / 4))::bigint + 1)) a(ix), unnest(range(floor(ly / 4)::bigint, least($NY - 1, floor((ly + h) / 4))::bigint + 1)) b(iy), den
  where den.ix = a.ix and den.iy = b.iy group by node_id""", CELLS)
BLUR = "blur as (select ix + dx as ix, iy + dy as iy, sum(density) / 121 as value from den, range(-5, 6) a(dx), range(-5, 6) b(dy) where ix + dx between 0 and $NX - 1 and iy + dy between 0 and $NY - 1 group by 1, 2)"
query("box_blur", lambda n: gd.box_blur(density(n), 5, n.nx, n.ny), "select ix, iy, round(value, 9) as value from blur", CELLS + ", " + BLUR)
query("box_blur_argmax", lambda n: gd.blur_argmax(gd.box_blur(density(n), 5, n.nx, n.ny)), "select ix, iy, round(value, 9) as value from blur order by 3 desc, ix, iy limit 1", CELLS + ", " + BLUR)
GAUSS = "g1 as (select d, exp(-d * d / 2.0) / (select sum(exp(-e * e / 2.0)) from range(-3, 4) t(e)) as w from range(-3, 4) u(d))"
query("gauss_blur", lambda n: gd.gauss_blur(density(n), n.nx, n.ny), "select ix + a.d as ix, iy + b.d as iy, round(sum(density * a.w * b.w), 9) as value from den, g1 a, g1 b where ix + a.d between 0 and $NX - 1 and iy + b.d between 0 and $NY - 1 group by 1, 2", CELLS + ", " + GAUSS)
DCT = """bx as (select k, i, case when k = 0 then sqrt(1 / $NX) else sqrt(2 / $NX) end * cos(pi() * (2 * i + 1) * k / (2 * $NX)) as b from range($NX) a(k), range($NX) c(i)),
byy as (select k, i, case when k = 0 then sqrt(1 / $NY) else sqrt(2 / $NY) end * cos(pi() * (2 * i + 1) * k / (2 * $NY)) as b from range($NY) a(k), range($NY) c(i)),
dct as (select bx.k as kx, byy.k as ky, sum(density * bx.b * byy.b) as coef from den join bx on bx.i = ix join byy on byy.i = iy group by 1, 2)"""
query("dct2d", lambda n: gd.dct2(density(n), n.nx, n.ny).select("kx", "ky", wl.tidy(F_col("coef"), 5).alias("coef")), "select kx, ky, round(coef, 5) + 0.0 as coef from dct", CELLS + ", " + DCT)
query("idct2d", lambda n: gd.idct2(gd.dct2(density(n), n.nx, n.ny), n.nx, n.ny).select("ix", "iy", wl.tidy(F_col("value"), 5).alias("value")), "select ix, iy, round(coalesce(density, 0.0), 5) + 0.0 as value from range($NX) a(ix) cross join range($NY) b(iy) left join den using (ix, iy)", CELLS)
ENERGY = "select round(sum(coef * coef / (pow(kx * pi() / $NX, 2) + pow(ky * pi() / $NY, 2))), 3) as energy from dct where kx > 0 or ky > 0"
query("poisson_energy", lambda n: gd.poisson_energy(density(n), n.nx, n.ny), ENERGY, CELLS + ", " + DCT)
query("potential_energy", lambda n: gd.potential_energy(density(n), n.nx, n.ny), ENERGY, CELLS + ", " + DCT)

# Legality and rows
query("legality_boundary", lambda n: lg.boundary(n.nodes, n.die_w - 4, n.die_h - 3), "select node_id from nodes where lx + w > $W - 4 or ly + h > $H - 3")
query("legality_alignment", lambda n: lg.alignment(n.nodes, 2.0, 1.0), "select node_id, lx::bigint % 2 <> 0 as off_site, false as off_row from nodes where lx::bigint % 2 <> 0")
FENCE = """fences as (select distinct celltype, v.* from nodes, (select 0 as fx0, $W / 2 as fx1, 0 as fy0, $H / 2 as fy1 union all select $W / 2, $W, $H / 2, $H) v where ends_with(celltype, '1')),
fenced as (select node_id, any_value(w * h) - sum(greatest(0.0, least(lx + w, fx1) - greatest(lx, fx0)) * greatest(0.0, least(ly + h, fy1) - greatest(ly, fy0))) as outside from nodes join fences using (celltype) group by node_id)"""
query("legality_fence", lambda n: lg.fence(n.nodes, lg.fences_of(n.nodes, n.die_w, n.die_h)), "select node_id, outside from fenced where outside > 0", FENCE)
ROWS = """inrow as (select nodes.*, r as row from nodes, unnest(range(ly::bigint, (ly + h)::bigint)) u(r)),
adj as (select *, lag(node_id) over w as left_id, lag(lx + w) over w as edge, lag(layer) over w as ll, lead(lx) over w as next, max(lx + w) over (partition by row order by lx, node_id rows between unbounded preceding and 1 preceding) as reach
  from inrow window w as (partition by row order by lx, node_id))"""
OVER = "select row, left_id, node_id as right_id, edge - lx as overlap from adj where edge > lx"
query("legality_overlap", lambda n: lg.row_overlaps(n.nodes), OVER, ROWS)
query("legality_verdict", lambda n: lg.verdict(n.nodes, n.die_w, n.die_h), f"""select 'boundary' as check_name, count(*) as violations from nodes where lx + w > $W or ly + h > $H union all select 'alignment', count(*) from nodes where lx::bigint % 2 <> 0
  union all select 'fence', count(*) from fenced where outside > 0 union all select 'overlap', count(*) from ({OVER})""", FENCE + ", " + ROWS)
query("row_blanks", lambda n: lg.blanks(n.nodes, n.die_w), "select row, coalesce(reach, 0.0) as x0, lx as x1 from adj where lx > coalesce(reach, 0.0) union all select row, max(lx + w), $W::double from adj group by row having max(lx + w) < $W", ROWS)
query("row_free_space", lambda n: lg.free_space(n.nodes, n.die_w), "select row, node_id, lx - coalesce(edge, 0.0) as left, coalesce(next, $W) - lx - w as right from adj", ROWS)
query("macro_overlap_pairs", lambda n: lg.overlap_pairs(lg.boxes_of(n.macros), 8.0), """select a.node_id as a, b.node_id as b, least(a.lx + a.w, b.lx + b.w) - greatest(a.lx, b.lx) as ox, least(a.ly + a.h, b.ly + b.h) - greatest(a.ly, b.ly) as oy
  from macros a join macros b on a.node_id < b.node_id where ox > 1e-3 and oy > 1e-3""")
PAIRS = "prs as (select a.node_id as a, b.node_id as b, a.layer as layer, least(a.lx + a.w, b.lx + b.w) - greatest(a.lx, b.lx) as ox, least(a.ly + a.h, b.ly + b.h) - greatest(a.ly, b.ly) as oy from nodes a join nodes b on a.node_id < b.node_id and a.lx < b.lx + b.w and b.lx < a.lx + a.w and a.ly < b.ly + b.h and b.ly < a.ly + a.h)"
query("cell_overlap_pairs", lambda n: lg.cell_overlaps(n.nodes), "select node_id, count(*) as n_overlaps, sum(ox * oy) as area from (select a as node_id, ox, oy from prs union all select b, ox, oy from prs) group by node_id", PAIRS)
query("metal_spacing", lambda n: lg.metal_spacing(n.nodes, 1.0), """select a.layer as layer, a.node_id as a, b.node_id as b from nodes a join nodes b on a.node_id < b.node_id and a.layer = b.layer and a.celltype <> b.celltype
  and least(a.lx + a.w, b.lx + b.w) - greatest(a.lx, b.lx) + 1 > 1e-3 and least(a.ly + a.h, b.ly + b.h) - greatest(a.ly, b.ly) + 1 > 1e-3""")
MP = "mp as (select a.node_id as an, b.node_id as bn, a.lx as ax, a.ly as ay, a.w as aw, a.h as ah, b.lx as bx, b.ly as by_, b.w as bw, b.h as bh, greatest(b.lx - a.lx - a.w, a.lx - b.lx - b.w) as gx, greatest(b.ly - a.ly - a.h, a.ly - b.ly - b.h) as gy from macros a join macros b on a.celltype = b.celltype and a.layer = b.layer and floor(a.lx / 128) = floor(b.lx / 128) and floor(a.ly / 64) = floor(b.ly / 64) and a.node_id < b.node_id)"
query("macro_constraint_graph", lambda n: lg.constraint_graph(n.macros), """select case when f then an else bn end as a, case when f then bn else an end as b, case when gx >= gy then 'h' else 'v' end as kind, greatest(gx, gy) as gap
  from (select *, case when gx >= gy then ax <= bx else ay <= by_ end as f from mp)""", MP)
query("box_algebra", lambda n: lg.box_algebra(n.macros), """select an as a, bn as b, greatest(ax + aw, bx + bw) - least(ax, bx) + greatest(ay + ah, by_ + bh) - least(ay, by_) as half_perimeter, greatest(0.0, gx) + greatest(0.0, gy) as l1,
  round(sqrt(pow(greatest(0.0, gx), 2) + pow(greatest(0.0, gy), 2)), 6) as l2, greatest(0.0, gx, gy) as linf, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), least(ay + ah, by_ + bh) - greatest(ay, by_)) as parallel_run from mp""", MP)
query("floorplan", lambda n: lg.floorplan(n.nodes), "select min(w) as site_w, min(h) as site_h, min(lx) as x0, min(ly) as y0, max(lx + w) as x1, max(ly + h) as y1 from nodes")
PATTERNS = [("Brand#3*", 9), ("Brand#1*", 1), ("Brand#2*", 3), ("Brand#21", 2), ("Brand#33", 4)]
query("region_membership", lambda n: lg.region_membership(n.nodes, PATTERNS), "select node_id, (case when celltype = 'Brand#33' then 4 when celltype = 'Brand#21' then 2 when starts_with(celltype, 'Brand#2') then 3 when starts_with(celltype, 'Brand#1') then 1 when starts_with(celltype, 'Brand#3') then 9 else 0 end)::bigint as region from nodes")
query("row_segments", lambda n: lg.row_segments(n.nodes, int(n.die_w)), """select row, min(x) as x0, max(x) + 1 as x1 from (select row, x, x - row_number() over (partition by row order by x) as g from
  (select row, x from (select distinct row from inrow where h > 2.01), range($W) s(x) except select row, x from inrow, unnest(range(lx::bigint, (lx + w)::bigint)) s(x) where h > 2.01)) group by row, g""", ROWS)
query("site_counts", lambda n: lg.site_counts(n.nodes, 2.0), """select node_id, (greatest(0, floor((lx + w) / 2) - ceil(lx / 2)) * greatest(0, floor((ly + h) / 2) - ceil(ly / 2)))::bigint as contained,
  (greatest(0, ceil((lx + w) / 2) - floor(lx / 2)) * greatest(0, ceil((ly + h) / 2) - floor(ly / 2)))::bigint as overlapped from nodes""")
query("site_map", lambda n: lg.site_map(n.nodes), "select x, row as y, bit_or(case when h > 2.01 then 2 else 1 end)::bigint as flags from inrow, unnest(range(lx::bigint, (lx + w)::bigint)) s(x) group by 1, 2", ROWS)
query("edge_spacing", lambda n: lg.edge_spacing(n.nodes), "select row, left_id, node_id as right_id, (1 + abs(layer - ll)) / 2 - lx + edge as short from adj where lx >= edge and lx - edge < (1 + abs(layer - ll)) / 2", ROWS)
query("design_issues", lambda n: lg.issues(n.nodes, n.nets, n.pins, n.die_w - 4, n.die_h - 2), """select 'cell_outside' as issue, count(*) as n from nodes where lx + w > $W - 4 or ly + h > $H - 2 union all select 'odd_width', count(*) from nodes where w::bigint % 2 <> 0
  union all select 'empty_net', count(*) from nets where degree = 0 union all select 'high_fanout', count(*) from nets where degree > 8 union all select 'unplaced_pin', count(*) from pins where node_id not in (select node_id from nodes)""")
query("layer_counts", lambda n: lg.layer_counts(n.nodes), "select count(distinct layer) as n_layers, count(distinct layer) filter (layer % 2 = 0) as n_even, bool_and(lx >= 0 and ly >= 0) as placed from nodes")
query("io_nets", lambda n: lg.io_nets(n.pins, n.nodes), "select distinct net_id from pins where node_id in (select node_id from nodes where size = 1)")
query("merged_rects", lambda n: lg.merged_rects(n.nodes), "select row, min(lx) as x0, max(lx + w) as x1 from (select *, sum(case when reach is null or lx > reach then 1 else 0 end) over (partition by row order by lx, node_id) as g from adj) group by row, g", ROWS)

# Timing
LEVELS = "lv0 as (select distinct node_id, 0 as l from (select src as node_id from arcs union all select dst from arcs))"
for _k in range(1, 6):
    LEVELS += f",\nlv{_k} as (select distinct dst as node_id, {_k} as l from arcs join lv{_k - 1} on src = node_id)"
LEVELS += ",\nlv as (select node_id, max(l)::bigint as level from (" + " union all ".join(f"select * from lv{k}" for k in range(6)) + ") group by node_id)"
AT = LEVELS + ",\nat0 as (select node_id, level, 0.0::double as at_early, 0.0::double as at_late, null::bigint as pred from lv where level = 0)"
for _k in range(1, 6):
    AT += f""",\nat{_k} as (select * from at{_k - 1} union all select dst, level, min(a.at_early + delay), max(a.at_late + delay), arg_max(src, (a.at_late + delay, -src))
  from arcs join lv on lv.node_id = dst join at{_k - 1} a on a.node_id = src where lv.level = {_k} group by dst, lv.level)"""
AT = AT.replace("select dst, level, min", "select dst, lv.level, min") + ",\nat as (select * from at5)"
RAT = ",\nrat6 as (select node_id, 0.0::double as rat_early, 6.0::double as rat from lv where node_id not in (select src from arcs))"
for _k in range(5, -1, -1):
    RAT += f",\nrat{_k} as (select * from rat{_k + 1} union all select src, max(r.rat_early - delay), min(r.rat - delay) from arcs join rat{_k + 1} r on r.node_id = dst join lv on lv.node_id = src where lv.level = {_k} group by src)"
AT, ATR = AT.replace(" at as (", " arr as (").replace("\nat as (", "\narr as ("), None
RATS = AT + RAT + ",\nreq as (select * from rat0),\nslk as (select arr.node_id, at_early - rat_early as early, rat - at_late as slack from arr join req using (node_id)),\nends as (select node_id, at_early - 1.5 as early, 6 - at_late as late from arr where node_id not in (select src from arcs))"
at = lambda n: tm.arrivals(n.arcs)


def _ends(n):
    return tm.endpoint_slacks(n.arcs, at(n), PERIOD, 1.5)


def _slack(n):
    return tm.slacks(at(n), tm.required(n.arcs, PERIOD))


def _paths(n, k):
    a = at(n)
    return tm.k_paths(tm.endpoint_slacks(n.arcs, a, PERIOD, 1.5), a, k), a


PATHS = """worst as (select node_id, row_number() over (order by late, node_id) as rank from ends order by late, node_id limit 20),
path0 as (select rank, 0 as step, node_id from worst)"""
for _k in range(1, 6):
    PATHS += f",\npath{_k} as (select rank, {_k} as step, pred as node_id from path{_k - 1} join arr using (node_id) where pred is not null)"
PATHS += ",\npaths as (" + " union all ".join(f"select rank, step::bigint as step, node_id from path{k}" for k in range(6)) + ")"
query("timing_arcs", lambda n: n.arcs, "select src, dst, delay from arcs")
query("timing_levels", lambda n: tm.levels(n.arcs), "select node_id, level from lv", LEVELS)
query("arrival_time", at, "select node_id, level, at_early, at_late, pred from arr", AT)
query("required_time", lambda n: tm.required(n.arcs, PERIOD), "select node_id, rat_early, rat from req", RATS)
query("pin_slack", _slack, "select node_id, early, slack from slk", RATS)
query("endpoint_slack", _ends, "select node_id, early, late from ends", RATS)
query("wns_tns", lambda n: tm.wns_tns(_ends(n)), "select 'early' as el, min(early) as wns, sum(least(0.0, early)) as tns from ends union all select 'late', min(late), sum(least(0.0, late)) from ends", RATS)
query("worst_path", lambda n: _paths(n, 1)[0].select("step", "node_id"), "select step, node_id from paths where rank = 1", RATS + ", " + PATHS)
query("k_worst_paths", lambda n: _paths(n, 20)[0], "select rank, step, node_id from paths", RATS + ", " + PATHS)
query("topk_criticality", lambda n: tm.path_criticality(*_paths(n, 20)), """select node_id, count(*) as visits, round(sum((at_late - coalesce(before, 0.0)) / ((1 + rank) * (1 + rank))), 9) as criticality
  from (select *, lead(at_late) over (partition by rank order by step) as before from paths join (select node_id, at_late from arr) using (node_id)) group by node_id""", RATS + ", " + PATHS)
query("node_criticality", lambda n: tm.node_criticality(_slack(n)), "select node_id, round(slack / (select max(abs(slack)) from slk), 9) as value from slk", RATS)
query("star_rc", lambda n: tm.star_rc(n.stars, 0.25, 0.5), """select pin_id, ld as load, res * ld as delay, round(sqrt(2 * res * ld * res * ld - res * ld * res * ld), 6) as impulse
  from (select pin_id, 0.25 * (abs(px - root_px) + abs(py - root_py)) / 2 + 1 as ld, 0.5 * (abs(px - root_px) + abs(py - root_py)) as res from stars)""")
query("net_load", lambda n: tm.net_load(n.stars, 0.25), "select net_id, sum(0.25 * (abs(px - root_px) + abs(py - root_py)) + 1) as load, count(*) as n_sinks from stars group by net_id")
query("elmore_delay", lambda n: tm.elmore(tm.chains(n.pin_positions)), """select pin_id, load, sum(res * load) over (partition by net_id order by k) as delay from
  (select *, sum(1.0::double) over (partition by net_id order by k desc) as load from (select pin_id, net_id, row_number() over w as k, coalesce((abs(px - lag(px) over w) + abs(py - lag(py) over w)) / 8, 0.0) as res from pp window w as (partition by net_id order by px, pin_id)))""")
query("lut_delay", lambda n: tm.lut_delay(n.arcs), """select src, dst, lo + (hi - lo) * (delay - x0) / (x1 - x0) as value from (select *, (x0f * yl + x0f * (yh - yl) * (y - y0) / (y1 - y0)) as lo, (x1f * yl + x1f * (yh - yl) * (y - y0) / (y1 - y0)) as hi from
  (select *, case when delay >= 1.5 then 1.5 else 1.0 end::double as x0, case when delay >= 1.5 then 2.5 else 1.5 end::double as x1, case when delay >= 1.5 then 2 else 1 end::double as x0f, case when delay >= 1.5 then 4 else 2 end::double as x1f,
    case when y >= 4 then 4 else 2 end::double as y0, case when y >= 4 then 8 else 4 end::double as y1, case when y >= 4 then 2 else 1 end::double as yl, case when y >= 4 then 4 else 2 end::double as yh from (select *, src % 16 as y from arcs)))""")
query("slew_range", lambda n: tm.slew(n.arcs), "select dst, round(min(sqrt(pow((src % 8) / 8, 2) + delay * delay)), 6) as early, round(max(sqrt(pow((src % 8) / 8, 2) + delay * delay)), 6) as late from arcs group by dst")

# Routing
SEG = """seg as (select net_id, pin_id, floor(root_px / 4)::bigint as x0, floor(root_py / 4)::bigint as y0, floor(px / 4)::bigint as x1, floor(py / 4)::bigint as y1 from stars),
rts as (select net_id, pin_id, 'h' as dir, x, case when pin_id % 2 = 0 then y0 else y1 end as y from seg, unnest(case when x0 < x1 then range(x0 + 1, x1 + 1) else range(x1, x0) end) u(x)
  union all select net_id, pin_id, 'v', case when pin_id % 2 = 0 then x1 else x0 end, y from seg, unnest(case when y0 < y1 then range(y0 + 1, y1 + 1) else range(y1, y0) end) u(y)),
dem as (select dir, x, y, count(*) as demand from rts group by 1, 2, 3)"""
CON = SEG + f""",
con as (select x, y, greatest(0.0, dh / {CAP} - 1) as h, greatest(0.0, dv / {CAP} - 1) as v, greatest(0.0, (dh + dv) / 2 / {CAP} - 1) as total from (select x, y, coalesce(sum(demand) filter (dir = 'h'), 0)::bigint as dh, coalesce(sum(demand) filter (dir = 'v'), 0)::bigint as dv from dem group by x, y))"""
PREFIX = SEG + """,
grid0 as (select 'h' as dir, l as line, a as at_ from range($NY) p(l), range($NX) q(a) union all select 'v', l, a from range($NX) p(l), range($NY) q(a)),
dl as (select dir, case when dir = 'h' then y else x end as line, case when dir = 'h' then x else y end as at_, demand from dem),
pre as materialized (select dir, line, at_, sum(1 + coalesce(demand, 0) / 8) over (partition by dir, line order by at_) as total from grid0 left join dl using (dir, line, at_))"""
seg = lambda n: rt.segments(n.stars)
routes = lambda n: rt.l_routes(seg(n))
dem = lambda n: rt.demand(routes(n))
wires = lambda n: rt.l_wires(seg(n))
query("gr_capacity", lambda n: rt.capacity(n.spark, n.nx, 4), "select l as layer, i, (ceil((i + 1) * 4 / ((1 + l) / 4)) - ceil(i * 4 / ((1 + l) / 4)))::bigint as capacity from range(4) a(l), range($NX) b(i)")
query("gr_wire_dist", lambda n: rt.wire_distance(n.spark, n.nx), "select i, 4.0::double as dist from range($NX - 1) a(i)")
query("lroute_demand", dem, "select dir, x, y, demand from dem", SEG)
query("gr_wirelength_vias", lambda n: rt.route_stats(routes(n), seg(n)), "select (select count(*) from rts) as wirelength, count(*) filter (x0 <> x1 and y0 <> y1) as vias from seg", SEG)
query("gr_normalised", lambda n: rt.normalised(rt.route_stats(routes(n), seg(n)), 0.5), "select (select count(*) from rts) * 4 / 0.5::double as wirelength, count(*) filter (x0 <> x1 and y0 <> y1) as vias from seg", SEG)
query("edge_cost_prefix", lambda n: rt.cost_prefix(dem(n), n.nx, n.ny), 'select dir, line, at_ as "at", total from pre', PREFIX)
query("best_lroute", lambda n: rt.best_l(seg(n), rt.cost_prefix(dem(n), n.nx, n.ny)), """select pin_id, case when xf <= yf then 'x' else 'y' end as first, least(xf, yf) as cost from (select pin_id,
  abs(p2.total - p1.total) + abs(q2.total - q1.total) as xf, abs(r2.total - r1.total) + abs(s2.total - s1.total) as yf from seg
  join pre p1 on p1.dir = 'h' and p1.line = y0 and p1.at_ = x0 join pre p2 on p2.dir = 'h' and p2.line = y0 and p2.at_ = x1 join pre q1 on q1.dir = 'v' and q1.line = x1 and q1.at_ = y0 join pre q2 on q2.dir = 'v' and q2.line = x1 and q2.at_ = y1
  join pre r1 on r1.dir = 'v' and r1.line = x0 and r1.at_ = y0 join pre r2 on r2.dir = 'v' and r2.line = x0 and r2.at_ = y1 join pre s1 on s1.dir = 'h' and s1.line = y1 and s1.at_ = x0 join pre s2 on s2.dir = 'h' and s2.line = y1 and s2.at_ = x1 where x0 <> x1 and y0 <> y1)""", PREFIX)
query("congestion_map", lambda n: rt.congestion(dem(n), CAP), "select x, y, h, v, total from con", CON)
query("congestion_stats", lambda n: rt.congestion_stats(rt.congestion(dem(n), CAP)), "select max(total) as most, round(avg(total), 9) as mean, round(stddev_samp(total), 9) as deviation from con", CON)
query("overflow_nets", lambda n: rt.overflow_nets(wires(n), rt.wire_demand(wires(n)), CAP), f"select distinct net_id from rts join dem using (dir, x, y) where demand > {CAP}", SEG)
query("ace_routability", lambda n: rt.ace(rt.congestion(dem(n), CAP)), """select dir, p as per_mille, round(mean, 9) as value from (select dir, row_number() over w - 1 as k, avg(value) over (partition by dir order by value desc, x, y rows unbounded preceding) as mean, count(*) over (partition by dir) as n
  from (select 'h' as dir, h as value, x, y from con union all select 'v', v, x, y from con) window w as (partition by dir order by value desc, x, y)), (values (5), (10), (20), (50), (100), (200), (500)) s(p0), lateral (select p0::bigint as p) where k = n * p // 1000""", CON)
query("estimated_shorts", lambda n: rt.estimated_shorts(dem(n), CAP), f"select dir, sum(greatest(0.0, demand - {CAP}) * case when dir = 'h' then 4.0 else 2.0 end)::double as shorts from dem group by dir", SEG)
query("via_usage", lambda n: rt.via_usage(dem(n)), 'select dir, line, at_ as "at", round(1.5 * sqrt((demand + nx) / 2), 6) as usage from (select *, lead(demand) over w as nx, lead(at_) over w as na from dl window w as (partition by dir, line order by at_)) where na = at_ + 1', PREFIX)
query("wire_cost", lambda n: rt.wire_cost(dem(n), CAP), f"select dir, x, y, round(4 + 4 / (1 + exp(0.5 * greatest(-40.0, least(40.0, {CAP} - demand)))) * 8, 6) as cost from dem", SEG)
query("net_cells", lambda n: rt.net_cells(n.pin_positions), "select net_id, count(distinct x * 1000000 + y) as n_cells, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from (select net_id, floor(px / 4)::bigint as x, floor(py / 4)::bigint as y from pp) group by net_id")
query("track_lookup", lambda n: rt.track_of(n.pin_positions), "select pin_id, ((0 <= px)::int + (3 <= px)::int + (7 <= px)::int + (15 <= px)::int + (31 <= px)::int + (63 <= px)::int)::bigint as track from pp")
query("pseudo_net_gradient", lambda n: rt.two_pin_gradient(n.stars, GAMMA), f"""select pin_id, {_r('tanh(dx / 8) + dx / 8 * (1 - tanh(dx / 8) * tanh(dx / 8))')} as gx, {_r('tanh(dy / 8) + dy / 8 * (1 - tanh(dy / 8) * tanh(dy / 8))')} as gy from (select pin_id, px - root_px as dx, py - root_py as dy from stars)""")
query("obstacle_tracks", lambda n: rt.obstacle_tracks(n.nodes), "select t // 4 as row, count(distinct t) as tracks, sum(w) as length from macros, unnest(range(ly::bigint, (ly + h)::bigint + 1)) u(t) group by 1")

# Convergence
query("wa_schedule", lambda n: cv.wa_schedule(n.metrics, GAMMA), "select run, iter, round(4 * pow(10.0, (least(1.0, hpwl / 1000) - 0.1) * 20 / 9 - 1), 6) as gamma from metrics")
query("density_weight_steps", lambda n: cv.weight_steps(n.metrics), "select run, iter, round(least(1.1, greatest(0.75, pow(1.1, 1 - (hpwl - lag(hpwl) over (partition by run order by iter)) / 100))), 6) as mu from metrics")
query("route_weight_ramp", lambda n: cv.ramp(n.metrics), "select run, iter, round(1 / (1 + exp(-(iter - 100) / 20.0::double)), 6) as weight from metrics")
query("metric_plateau", lambda n: cv.plateaus(n.metrics, 10, 1.5), "select run, iter, case when count(*) over w = 10 then (max(hpwl) over w - min(hpwl) over w) / avg(hpwl) over w < 1.5 end as flat from metrics window w as (partition by run order by iter rows 9 preceding)")
query("metric_divergence", lambda n: cv.divergence(n.metrics, 10, 20.0), """select run, iter, case when count(*) over w = 10 then avg(hpwl) over w > 20 * min(hpwl) over (partition by run order by iter rows unbounded preceding) end as diverged, (sum(up) over w)::bigint as rises
  from (select *, coalesce((hpwl > lag(hpwl) over (partition by run order by iter))::int, 0) as up from metrics) window w as (partition by run order by iter rows 9 preceding)""")
query("best_so_far", lambda n: cv.best_so_far(n.metrics), "select run, iter, hpwl from (select *, min(hpwl) over (partition by run order by iter rows between unbounded preceding and 1 preceding) as b from metrics) where b is null or hpwl < b")
query("best_solution", lambda n: cv.best_solution(n.metrics), "select run, arg_min(iter, (hpwl, iter)) as iter, min(hpwl) as hpwl from metrics group by run")
query("best_timing", lambda n: cv.best_timing(n.metrics, 50.0), "select run, arg_min(iter, (hpwl, iter)) as iter from metrics where hpwl >= 50 group by run")
query("early_stop", lambda n: cv.early_stop(n.metrics))

# Detailed placement
EXT = BOX + """, ext as (select net_id, list_sort(list(px)) as xs, list_sort(list(py)) as ys, count(*) as n from pp group by net_id having count(*) between 2 and 8)"""
query("optimal_region", lambda n: dp.optimal_region(n.pin_positions, MAX_DEGREE), """select node_id, median(case when px = xs[1] then xs[2] else xs[1] end) as x0, median(case when px = xs[-1] then xs[-2] else xs[-1] end) as x1,
  median(case when py = ys[1] then ys[2] else ys[1] end) as y0, median(case when py = ys[-1] then ys[-2] else ys[-1] end) as y1 from pp join ext using (net_id) group by node_id""", EXT)
WIN = """rw0 as (select ly::bigint as row, node_id, lx, w, row_number() over (partition by ly order by lx, node_id) - 1 as i from nodes where h <= 2.01),
rw as (select row, i // 3 as g, i % 3 as slot, node_id, lx, w from rw0 qualify count(*) over (partition by row, i // 3) = 3),
mids as (select net_id, (min(px) + max(px)) / 2 as mid from pp group by net_id)"""
query("kreorder_best_perm", lambda n: dp.kreorder(n.nodes, n.pin_positions), """select row, g, arg_min(perm, (cost, perm)) as perm, round(max(cost) filter (perm = '012') - min(cost), 6) as gain from (
  select row, g, perm, round(sum(pins * abs(left_ + coalesce(before, 0) + w / 2 - goal)), 6) as cost from (select *, sum(w) over (partition by row, g, perm order by rank rows between unbounded preceding and 1 preceding) as before
    from cells3 join (values ('012', 0, 0), ('012', 1, 1), ('012', 2, 2), ('021', 0, 0), ('021', 2, 1), ('021', 1, 2), ('102', 1, 0), ('102', 0, 1), ('102', 2, 2), ('120', 1, 0), ('120', 2, 1), ('120', 0, 2), ('201', 2, 0), ('201', 0, 1), ('201', 1, 2), ('210', 2, 0), ('210', 1, 1), ('210', 0, 2)) t(perm, slot, rank) using (slot)) group by 1, 2, 3) group by row, g""",
  WIN + """, pull as (select node_id, avg(mid) as goal, count(*) as pins from pp join mids using (net_id) group by node_id),
cells3 as (select *, min(lx) over (partition by row, g) as left_ from rw join pull using (node_id) qualify count(*) over (partition by row, g) = 3)""")
SWAPS = """pl as (select net_id, avg(px) as mx, avg(py) as my from pp group by net_id), gl as (select node_id, avg(mx) as gx, avg(my) as gy from pp join pl using (net_id) group by node_id), cl as (select nodes.*, gx, gy from nodes join gl using (node_id) where h <= 2.01),
sw as (select an as node_id, arg_max(bn, (gain, -bn)) as other, max(gain) as gain from (select a.node_id as an, b.node_id as bn,
  round(abs(a.lx - a.gx) + abs(a.ly - a.gy) + (abs(b.lx - b.gx) + abs(b.ly - b.gy)) - (abs(b.lx - a.gx) + abs(b.ly - a.gy)) - (abs(a.lx - b.gx) + abs(a.ly - b.gy)), 6) as gain
  from cl a join cl b on a.w = b.w and floor(a.lx / 4) = floor(b.lx / 4) and floor(a.ly / 4) = floor(b.ly / 4) and a.node_id <> b.node_id) where gain > 0 group by an)"""
query("swap_delta_hpwl", lambda n: dp.swap_gains(n.nodes, n.pin_positions), "select node_id, other, gain from sw", SWAPS)
query("committed_swaps", lambda n: dp.committed(n.nodes, dp.swap_gains(n.nodes, n.pin_positions), 1.0), """select a.node_id, coalesce(b.lx, a.lx) as lx, coalesce(b.ly, a.ly) as ly from nodes a
  left join (select p.node_id, p.other from sw p join sw q on p.node_id = q.other and p.other = q.node_id where p.gain >= 1 and q.gain >= 1) s on s.node_id = a.node_id left join nodes b on b.node_id = s.other""", SWAPS)
NBR = "nb as (select distinct a.node_id as a, b.node_id as b from pp a join pp b using (net_id) join box using (net_id) where degree between 2 and 8 and a.node_id <> b.node_id)"
query("mis_round", lambda n: dp.independent_round(n.nodes, dp.neighbours(n.pin_positions, MAX_DEGREE)), """select node_id from nodes left join (select a, min((b * 40503 + 7) % 65536 * 1048576 + b) as least from nb group by a) on a = node_id where least is null or (node_id * 40503 + 7) % 65536 * 1048576 + node_id < least""", BOX + ", " + NBR)
query("net_neighbours", lambda n: dp.neighbours(n.pin_positions, MAX_DEGREE), "select a, b from nb", BOX + ", " + NBR)
KM = "km0 as (select i, (37 * i % 128)::double as x, (23 * i % 64)::double as y from range(12) c(i))"
for _k in range(1, 4):
    KM += f""",
ks{_k} as (select node_id, any_value(lx) as lx, any_value(ly) as ly, arg_min(i, (abs(lx - x) + abs(ly - y), i)) as centre from nodes, km{_k - 1} group by node_id),
kn{_k} as (select centre, count(*) as n, round(avg(lx), 6) as x, round(avg(ly), 6) as y from ks{_k} group by centre),
km{_k} as (select i, coalesce(kn{_k}.x, km{_k - 1}.x) as x, coalesce(kn{_k}.y, km{_k - 1}.y) as y from km{_k - 1} left join kn{_k} on centre = i)"""
query("kmeans", lambda n: dp.kmeans(n.nodes, 12), "select centre, n, x, y from kn3", KM)
query("matching_costs", lambda n: dp.cost_matrix(n.nodes, n.pin_positions), "select a.row, a.g, a.node_id, b.slot, sum(abs(b.lx + a.w / 2 - mid)) as cost from rw a join rw b on a.row = b.row and a.g = b.g join pp on pp.node_id = a.node_id join mids using (net_id) group by 1, 2, 3, 4", WIN)
query("matching", lambda n: dp.matched(dp.cost_matrix(n.nodes, n.pin_positions)))
query("abacus_rows", lambda n: dp.abacus_rows(n.nodes, 100_000.0))
query("displacement", lambda n: dp.displacement(n.nodes, dp.abacus_rows(n.nodes, 100_000.0)))

# More of routing
OBST = """obs as (select x, t // 4 as y, count(distinct t) as tracks, sum(least(lx + w, (x + 1) * 4.0) - greatest(lx, x * 4.0)) as length
  from macros, unnest(range(ly::bigint, (ly + h)::bigint)) u(t), unnest(range(floor(lx / 4)::bigint, ceil((lx + w) / 4)::bigint)) v(x) group by 1, 2)"""
BENDS = SEG + """,
bnd as (select net_id, pin_id, case when pin_id % 2 = 0 then x1 else x0 end as x, case when pin_id % 2 = 0 then y0 else y1 end as y from seg where x0 <> x1 and y0 <> y1)"""
query("gcell_obstacles", lambda n: rt.gcell_obstacles(n.nodes), "select x, y, tracks, length from obs", OBST)
query("fixed_usage", lambda n: rt.fixed_usage(dem(n), rt.gcell_obstacles(n.nodes)), "select x, y, coalesce(demand, 0) + coalesce(tracks, 0) as usage, coalesce(length, 0.0) as length from (select * from dem where dir = 'h') full join obs using (x, y)", SEG + ", " + OBST)
query("demand_map", lambda n: rt.demand_map(dem(n), seg(n), CAP), f"""select x, y, wires, vias, wires + vias as total, {2 * CAP} - wires - vias as free from (select x, y, coalesce(wires, 0)::bigint as wires, coalesce(vias, 0)::bigint as vias
  from (select x, y, sum(demand) as wires from dem group by x, y) full join (select x, y, count(*) as vias from bnd group by x, y) using (x, y))""", BENDS)
query("overflow_vias", lambda n: rt.overflow_vias(seg(n), dem(n), CAP), f"select net_id, count(*) as vias from bnd where (x, y) in (select (x, y) from dem where demand > {CAP}) group by net_id", BENDS)
query("route_force", lambda n: rt.route_force(wires(n), rt.wire_demand(wires(n)), CAP), "select pin_id, round(sum(case when dir = 'h' then h else 0.0 end), 6) as gx, round(sum(case when dir = 'v' then v else 0.0 end), 6) as gy from rts join con using (x, y) group by pin_id", CON)
query("congestion_force", lambda n: gd.density_gather(n.nodes, rt.congestion(dem(n), CAP).select(F_col("x").alias("ix"), F_col("y").alias("iy"), F_col("total").alias("density")), BIN, n.nx, n.ny).select("node_id", wl.tidy(F_col("force"), 6).alias("force")), f"select node_id, {_r('sum(part * total)')} as force from cells join con on ix = x and iy = y group by node_id", CELLS + ", " + CON)
query("pin_cells", lambda n: rt.pin_cells(n.pin_positions), "select pin_id, floor(px / 4)::bigint as x, floor(py / 4)::bigint as y from pp")
query("net_topology", lambda n: rt.net_topology(n.pin_positions), "select net_id, x, y, row_number() over (partition by net_id order by x, y) - 1 as k from (select distinct net_id, floor(px / 4)::bigint as x, floor(py / 4)::bigint as y from pp) qualify count(*) over (partition by net_id) > 1")
query("best_gr_solution", lambda n: rt.best_solution(n.metrics), "select run, arg_min(iter, (floor(hpwl / 10), iter)) as iter, min(floor(hpwl / 10))::bigint as shorts from metrics group by run")
query("cell_inflation", lambda n: rt.inflation(n.nodes, gd.inflate_ratio(n.nodes, congested(n), BIN, n.nx, n.ny, "avg"), 200.0), """select node_id, round(1 + g * s, 6) as ratio, round(a * (1 + g * s), 6) as area from (select *, least(1.0, 200.0 / greatest(sum(a * g) over (), 1e-9)) as s
  from (select node_id, any_value(w * h) as a, greatest(0.0, round(sum(part * density) / sum(part), 9) - 1) as g from cells join den using (ix, iy) join nodes using (node_id) group by node_id))""", CELLS)
query("shape_spacing", lambda n: rt.spacing(lg.box_algebra(n.macros).select("a", "b", "parallel_run"), n.nodes), """select an as a, bn as b, [0.25, 0.5, 0.75, 0.5, 0.75, 1.0, 0.75, 1.0, 2.0][((w >= 2)::int + (w >= 4)::int) * 3 + (run >= 0)::int + (run >= 2)::int + 1]::double as space from
  (select *, greatest(least(aw, ah), least(bw, bh)) as w, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), least(ay + ah, by_ + bh) - greatest(ay, by_)) as run from mp)""", MP)
query("obstacle_shapes", lambda n: lg.oriented_shapes(n.nodes), """select node_id, x0, x0 + ow / 2 as x1, y0, y0 + oh / 2 as y1 from (select node_id, ow, oh, lx + case when o in (2, 3, 4, 7) then ow / 2 else 0 end as x0, ly + case when o in (1, 2, 6, 7) then oh / 2 else 0 end as y0
  from (select *, size % 8 as o, case when size % 2 = 1 then h else w end as ow, case when size % 2 = 1 then w else h end as oh from macros))""")
query("power_stripes", lambda n: lg.power_stripes(n.nodes, 16.0, 1.0), "select node_id, row, k as stripe from inrow, unnest(range(floor(lx / 16)::bigint, floor((lx + w) / 16)::bigint + 1)) s(k) where row % 2 = 0 and lx < k * 16 + 1 and lx + w > k * 16", ROWS)
query("row_rails", lambda n: lg.row_rails(n.nodes), "select row, min(lx) as x0, max(lx + w) as x1, case when row % 2 = 0 then 'N' else 'FS' end as orient, count(*) filter ((row % 2 = 0) <> (size % 2 = 0)) as conflicts from inrow group by row", ROWS)
query("nesterov_steps", lambda n: cv.nesterov(n.spark, 30), "select k, round(a, 9) as a from s", "z as (select 1), s as (with recursive r(k, a) as (select 0::bigint, 1.0::double union all select k + 1, (1 + sqrt(4 * a * a + 1)) / 2 from r where k < 29) select * from r)")

# More of timing
GRAPH = LEVELS + """,
g as materialized (select src, dst, delay - 1 as wire, n::double as load, case (src + dst) % 3 when 0 then 'positive' when 1 then 'negative' else 'either' end as sense from arcs join (select src, count(*) as n from arcs group by src) using (src))"""
_COLS = [f"{k}_{el}_{rf}" for k in ("at", "slew") for el, rf in pg.STATES]
PROP = GRAPH + ",\npr0 as materialized (select node_id, level, " + ", ".join(f"{0.0 if x.startswith('at') else 0.5}::double as {x}" for x in _COLS) + " from lv where level = 0)"


def _along(kind: str, el: str, after: str) -> str:
    out = []
    for before in ("rise", "fall"):
        s = f"p.slew_{el}_{before}"
        if kind == "at":
            value = f"p.at_{el}_{before} + (0.5 + {s} / 4 + g.load / 16 + {s} * g.load / 64 + {0.125 if after == 'rise' else 0.0}) + g.wire"
        else:
            value = f"sqrt(pow(0.25 + {s} / 8 + g.load / 32 + {0.0625 if after == 'rise' else 0.0}, 2) + g.wire * g.wire)"
        out.append(f"case when g.sense in ('either', '{'positive' if before == after else 'negative'}') then {value} end")
    return f"{'min' if el == 'early' else 'max'}({'least' if el == 'early' else 'greatest'}({', '.join(out)})) as {kind}_{el}_{after}"


for _k in range(1, 6):
    PROP += f",\npr{_k} as materialized (select * from pr{_k - 1} union all select g.dst, lv.level, " + ", ".join(_along(k, el, rf) for k in ("at", "slew") for el, rf in pg.STATES) + f" from g join lv on lv.node_id = g.dst join pr{_k - 1} p on p.node_id = g.src where lv.level = {_k} group by g.dst, lv.level)"
states = lambda n: pg.propagate(pg.timing_graph(n.arcs))
query("timing_graph", lambda n: pg.timing_graph(n.arcs), "select src, dst, wire, load, sense from g", GRAPH)
for _kind, _label in (("at", "corner_arrivals"), ("slew", "corner_slews")):
    query(_label, lambda n, k=_kind: pg.rounded(states(n), k), "select node_id, level, " + ", ".join(f"round({x}, 6) as {x}" for x in _COLS if x.startswith(_kind)) + " from pr5", PROP)
query("constraint_slack", lambda n: (lambda g: pg.constraint_slacks(g, pg.propagate(g), 9.0))(pg.timing_graph(n.arcs)), " union all ".join(f"select node_id, '{rf}' as rf, round(at_early_{rf} - (0.25 + slew_early_{rf} / 4), 6) as hold, round(9.0 - (0.5 + slew_late_{rf} / 2) - at_late_{rf}, 6) as setup from pr5 where node_id not in (select src from arcs)" for rf in ("rise", "fall")), PROP)
TREE = """tr0 as (select net_id, pin_id, px, py, row_number() over (partition by net_id order by px, py, pin_id) - 1 as k from pp qualify count(*) over (partition by net_id) <= 8),
tr1 as (select *, case when k > 0 then (k - 1) // 2 end as parent, floor(log2(k + 1.0000001))::bigint as depth from tr0),
tre as (select a.net_id, a.pin_id, a.k, a.parent, a.depth, 1 + coalesce(abs(a.px - b.px) + abs(a.py - b.py), 0) / 8 as cap, coalesce(abs(a.px - b.px) + abs(a.py - b.py), 0) / 4 as res from tr1 a left join tr1 b on b.net_id = a.net_id and b.k = a.parent),
anc as (select net_id, k, (floor((k + 1) / pow(2, j)) - 1)::bigint as a from tre, unnest(range(depth + 1)) u(j)),
t1 as (select anc.net_id, anc.a as k, sum(cap) as load from anc join tre using (net_id, k) group by 1, 2),
t2 as (select anc.net_id, anc.k, sum(res * load) as delay from anc join tre on tre.net_id = anc.net_id and tre.k = anc.a join t1 on t1.net_id = anc.net_id and t1.k = anc.a group by 1, 2),
t3 as (select anc.net_id, anc.a as k, sum(cap * delay) as weighted from anc join tre using (net_id, k) join t2 using (net_id, k) group by 1, 2),
t4 as (select anc.net_id, anc.k, sum(res * weighted) as beta from anc join tre on tre.net_id = anc.net_id and tre.k = anc.a join t3 on t3.net_id = anc.net_id and t3.k = anc.a group by 1, 2),
elm as (select net_id, pin_id, load, delay, round(sqrt(greatest(0.0, 2 * beta - delay * delay)), 6) as impulse from tre join t1 using (net_id, k) join t2 using (net_id, k) join t4 using (net_id, k))"""
trees = lambda n: pg.rc_trees(n.pin_positions, MAX_DEGREE)
query("rc_trees", trees, "select net_id, pin_id, k, parent, depth, cap, res from tre", TREE)
query("rc_tree_delay", lambda n: pg.elmore(trees(n)), "select pin_id, load, delay, impulse from elm", TREE)
query("rc_calibration", lambda n: pg.calibration(tm.star_rc(n.stars, 0.25, 0.5).join(n.pins.select("pin_id", "net_id"), "pin_id"), pg.elmore(trees(n)).join(n.pins.select("pin_id", "net_id"), "pin_id")), """select net_id, round(max(load) / any_value(sl), 6) as load_ratio, round(greatest(0.0, max(delay) - any_value(sd)), 6) as compensation from elm
  join (select net_id, sum(0.25 * d / 2 + 1) as sl, max(0.5 * d * (0.25 * d / 2 + 1)) as sd from (select net_id, abs(px - root_px) + abs(py - root_py) as d from stars) group by net_id) using (net_id) group by net_id""", TREE)
query("point_report", lambda n: pg.point_report(at(n), tm.required(n.arcs, PERIOD), n.arcs, F_col("node_id") % 10 == 0), "select node_id, at_late as arrival, rat as required, rat - at_late as slack, coalesce(load, 0) as load from arr join req using (node_id) left join (select src as node_id, count(*) as load from arcs group by src) using (node_id) where node_id % 10 = 0", RATS)


def _near_worst(n):
    a = at(n)
    ends = tm.endpoint_slacks(n.arcs, a, PERIOD, 1.5)
    worst = ends.agg({"late": "min"}).first()[0]
    k = 0 if worst is None else ends.where(F_col("late") <= worst + 0.25).count()
    return tm.path_criticality(tm.k_paths(ends, a, k), a)


query("near_worst_criticality", _near_worst, """select node_id, count(*) as visits, round(sum((at_late - coalesce(before, 0.0)) / ((1 + rank) * (1 + rank))), 9) as criticality
  from (select *, lead(at_late) over (partition by rank order by step) as before from paths join (select node_id, at_late from arr) using (node_id)) group by node_id""", RATS + ", " + PATHS.replace("order by late, node_id limit 20", "where late <= (select min(late) from ends) + 0.25"))
query("pin_weights", lambda n: pg.pin_weights(_slack(n).select("node_id", "slack"), tm.path_criticality(*_paths(n, 20)), 0.5, 0.75), """select node_id, round(0.75 * (0.75 + 0.25 * goal) + 0.25 * goal, 6) as weight from (select slk.node_id, 1 + 0.5 * greatest(0.0, -slack) / greatest(-(select min(slack) from slk), 1e-9) + 0.5 * coalesce(cr, 0.0) / (select greatest(max(cr), 1e-9) from crt) as goal
  from slk left join crt using (node_id))""", RATS + ", " + PATHS + """, crt as (select node_id, round(sum((at_late - coalesce(before, 0.0)) / ((1 + rank) * (1 + rank))), 9) as cr
  from (select *, lead(at_late) over (partition by rank order by step) as before from paths join (select node_id, at_late from arr) using (node_id)) group by node_id)""")
EDGES = MP + """, he as (select case when ax <= bx then an else bn end as a, case when ax <= bx then bn else an end as b from mp where gx >= gy),
fw as (with recursive r(n, l) as (select distinct a, 0.0::double from he where a not in (select b from he) union all select he.b, l + w from r join he on he.a = n join macros m on m.node_id = n) select n, max(l) as low from r group by n),
bw as (with recursive r(n, l) as (select distinct b, 0.0::double from he where b not in (select a from he) union all select he.a, l + w from r join he on he.b = n join macros m on m.node_id = n) select n, max(l) as after from r group by n)"""
query("macro_bounds", lambda n: pg.longest_bounds(lg.constraint_graph(n.macros).where("kind = 'h'").select("a", "b"), n.macros.select("node_id", F_col("w").alias("s")), n.die_w), "select node_id, low, $W - after - w as high, $W - after - w - low as slack from fw join bw using (n) join macros on node_id = n", EDGES)

# Formats
for _name, _build, _sql in roundtrips.TRIPS:
    query(_name, _build, _sql)
