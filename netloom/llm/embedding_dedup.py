"""Near duplicates of embeddings: robust-pruned graphs on overlapping cluster shards, searched for all within a range."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import components, thinned
from netloom.plans.shared import Folder

#: Vectors that centres are fitted on at most, vectors a shard should hold, shards that a vector enters.
SAMPLE, SHARD, OVERLAP = 20_000, 800, 3
#: Neighbours of a node, the pruning factor, the width of the search, and the width of similarity it roams below the range.
DEGREE, ALPHA, BEAM, SLACK = 24, 1.2, 32, 0.02
#: Nodes that enter a graph together, and similarities that a search holds at once.
TOGETHER, HELD = 256, 1 << 22
#: Vectors of the recall audit at most, and the recall that a search must reach.
AUDITED, RECALL = 500, 0.9


def robust_prune(v: np.ndarray, pool: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """The neighbours of a node out of a pool, nearest first: each one kept drops those that it is nearer to by alpha."""
    order = np.argsort(-sims, kind="stable")
    pool, far = pool[order], np.sqrt(np.maximum(2 - 2 * sims[order], 0))
    open_, kept = np.ones(len(pool), dtype=bool), []
    between = np.sqrt(np.maximum(2 - 2 * (v[pool] @ v[pool].T), 0))
    for i in range(len(pool)):
        if open_[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            open_ &= alpha * between[i] > far
    return pool[kept]


def medoid(v: np.ndarray) -> int:
    """The node nearest to the mean."""
    return int(np.argmax(v @ v.mean(0)))


class Search:
    """Greedy searches of a block of queries over a graph: lists of neighbours (-1: none) as rows of a table.

    A node is measured once for each query; sims has -inf for those not measured."""

    def __init__(self, v: np.ndarray, near: np.ndarray, queries: np.ndarray, start: int):
        self.v, self.near, self.queries = v, near, queries
        self.sims = np.full((len(queries), len(v)), -np.inf)
        self.done = np.zeros(self.sims.shape, dtype=bool)
        self.sims[:, start] = queries @ v[start]

    def open(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Measures the neighbours of (query row, node) pairs, a bounded number at a time."""
        self.done[rows, nodes] = True
        for low in range(0, len(nodes), 2048):
            near = self.near[nodes[low : low + 2048]]
            at, k = np.nonzero(near >= 0)
            r, t = rows[low : low + 2048][at], near[at, k]
            new = np.isneginf(self.sims[r, t])
            r, t = r[new], t[new]
            self.sims[r, t] = np.einsum("ij,ij->i", self.queries[r], self.v[t])

    def walk(self, beam: int) -> None:
        """Opens the nearest node measured until the `beam` nearest are all open."""
        active = np.arange(len(self.queries))
        width = min(beam, len(self.v))
        while len(active):
            pool = self.sims[active]
            top = np.argpartition(-pool, width - 1, axis=1)[:, :width]
            value = np.take_along_axis(pool, top, 1)
            value[self.done[active[:, None], top] | np.isneginf(value)] = -np.inf
            pick = value.argmax(1)
            more = ~np.isneginf(value[np.arange(len(active)), pick])
            active, nodes = active[more], top[np.arange(len(pick)), pick][more]
            if len(active):
                self.open(active, nodes)

    def roam(self, least: float) -> None:
        """Opens every node measured as near enough, until there is no other."""
        while True:
            rows, nodes = np.nonzero((self.sims >= least) & ~self.done)
            if not len(rows):
                return
            self.open(rows, nodes)


def build_graph(v: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> np.ndarray:
    """The lists of neighbours of a graph over unit vectors, built node by node: each searches the graph so far from the
    medoid, keeps a pruned list of what it met, and enters the lists of those, which are pruned where they grow too
    long. Nodes enter in growing groups, whose members know each other too."""
    n = len(v)
    near, many = np.full((n, 2 * degree), -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n < 2:
        return near
    start = medoid(v)
    order = np.random.default_rng(7).permutation(n)
    order = order[order != start]
    low = 0
    while low < len(order):
        own = order[low : low + max(1, min(TOGETHER, low + 1, HELD // n))]
        low += len(own)
        search = Search(v, near, v[own], start)
        search.walk(beam)
        sims = search.sims
        sims[:, own] = v[own] @ v[own].T
        sims[np.arange(len(own)), own] = -np.inf
        for row, node in zip(sims, own.tolist()):
            met = np.flatnonzero(~np.isneginf(row))
            if len(met) > 2 * degree:
                met = met[np.argpartition(-row[met], 2 * degree)[: 2 * degree]]
            kept = robust_prune(v, met, row[met], degree)
            fresh = kept[~np.isin(kept, near[node, : many[node]])]
            room = min(len(fresh), near.shape[1] - many[node])
            near[node, many[node] : many[node] + room] = fresh[:room]
            many[node] += room
            for t in kept.tolist():
                if node in near[t, : many[t]]:
                    continue
                if many[t] == near.shape[1]:
                    pool = np.append(near[t], node)
                    short = robust_prune(v, pool, v[pool] @ v[t], degree)
                    near[t] = -1
                    near[t, : len(short)], many[t] = short, len(short)
                else:
                    near[t, many[t]] = node
                    many[t] += 1
    return near


def range_search(v: np.ndarray, near: np.ndarray, queries: np.ndarray, least: float, start: int, beam: int = BEAM):
    """Blocks of (query row, node) with similarity `least` or more: greedy search from `start`, then the range is roamed."""
    step = max(1, min(256, HELD // max(1, len(v))))
    for low in range(0, len(queries), step):
        search = Search(v, near, queries[low : low + step], start)
        search.walk(beam)
        search.roam(least - SLACK)
        r, nodes = np.nonzero(search.sims >= least - 1e-6)
        yield r + low, nodes


def fit_centres(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres of unit rows by a few rounds of k-means."""
    rng = np.random.default_rng(seed)
    c = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = np.concatenate([(rows[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(rows), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, rows)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, v, k, good) of every row: v as doubles, k a hash of label and v, good whether it can link."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select("vec_id", "label", v.alias("v")).withColumn("dim", F.coalesce(F.size("v"), F.lit(-1)))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.col("dim") > 0) & finite & F.exists("v", lambda x: x != 0.0)
    return rows.select("vec_id", "label", "dim", "v", F.xxhash64("label", "v").alias("k"), F.coalesce(good, F.lit(False)).alias("good"))


def classes_of(vectors: DataFrame) -> DataFrame:
    """(label, dim, v, k, rep, n): vectors that are equal in label and every component are one class."""
    return _rows(vectors).where("good").groupBy("label", "dim", "v", "k").agg(F.min("vec_id").cast("bigint").alias("rep"), F.count("*").alias("n"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> None:
    """Joins a[i] and b[i] in a forest in which each root is the smallest of its tree."""
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)


def _apart(centres: np.ndarray, least: float) -> np.ndarray:
    """The centres without those that are as near as a link to an earlier one."""
    kept: list[int] = []
    for i in range(len(centres)):
        if not kept or (centres[kept] @ centres[i]).max() < least:
            kept.append(i)
    return centres[kept]


def link_classes(classes: DataFrame, folder: Folder, least: float, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """(k, own, far, a, b) for each class and shard it enters: far counts the vectors of other classes that it links with,
    where the shard is its own; a and b are two representatives that links join, all such rows together a forest of
    each shard.

    Per label and dimension, vectors enter the `overlap` shards whose centres are nearest, and every one whose centre is
    little farther than a link; centres as near as a link are one, so a dense group isn't cut up. Each shard builds a
    robust-pruned graph; a vector's list of neighbours is the union over its shards. Every vector then searches its own
    shard, the nearest, from the medoid, and exact cosines decide. What leaves a shard is a row a member, however many
    pairs are near."""
    spark = classes.sparkSession
    sizes = {(r["label"], r["dim"]): r["c"] for r in classes.groupBy("label", "dim").agg(F.count("*").alias("c")).collect()}
    total = max(1, sum(sizes.values()))
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / total))).select("label", "dim", "v").limit(2 * SAMPLE).collect()
    centres = {}
    for key, c in sizes.items():
        own = [r["v"] for r in sample if (r["label"], r["dim"]) == key]
        if own:
            rows = _unit(np.array(own))
            centres[key] = _apart(fit_centres(rows, max(1, min(len(rows) // 4 or 1, -(-c * overlap // SHARD)))), least)
    share = spark.sparkContext.broadcast(centres)
    near_centre = 1 - 2.25 * (1 - least)  # one and a half times the distance of a link
    kind = classes.schema["label"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            labels, dims, v = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist()
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            rows, shard, first = [], [], []
            for key, at in groups.items():
                c = share.value.get(key)
                if c is None:
                    top = np.zeros((len(at), 1), dtype=np.int64)
                else:
                    s = _unit(np.array([v[i] for i in at])) @ c.T
                    order = np.argsort(-s, axis=1, kind="stable")
                    ranked = np.take_along_axis(s, order, 1)
                    at_all = (np.arange(len(c)) < overlap) | (ranked >= near_centre)
                    i, j = np.nonzero(at_all)
                    rows.append(np.array(at)[i])
                    shard.append(order[i, j])
                    first.append(j == 0)
                    continue
                rows.append(np.repeat(at, top.shape[1]))
                shard.append(top.ravel())
                first.append(np.ones(len(at), dtype=bool))
            if rows:
                out = b.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(shard).astype(np.int32)), pa.array(np.concatenate(first))], names=[*out.schema.names, "shard", "own"])

    members = classes.select("label", "dim", "k", "rep", "n", "v").mapInArrow(assign, f"label {kind}, dim int, k bigint, rep bigint, n bigint, v array<double>, shard int, own boolean")
    dealt = folder.put(members, "members")

    def build(table: pa.Table) -> pa.Table:
        k = table["k"].to_numpy()
        near = build_graph(_unit(_matrix(table["v"])), beam=beam)
        a, at = np.nonzero(near >= 0)
        return pa.table({"k": pa.array(k[a], pa.int64()), "b": pa.array(k[near[a, at]], pa.int64())})

    lists = dealt.select("label", "dim", "shard", "k", "v").groupBy("label", "dim", "shard").applyInArrow(build, "k bigint, b bigint").groupBy("k").agg(F.collect_set("b").alias("near"))

    def search(table: pa.Table) -> pa.Table:
        k, rep, n, own = (table[x].to_numpy() for x in ("k", "rep", "n", "own"))
        raw = _matrix(table["v"])
        v = _unit(raw)
        by_k = np.argsort(k, kind="stable")
        lists = [np.array(x or [], dtype=np.int64) for x in table["near"].to_pylist()]
        near = np.full((len(k), max([1, *map(len, lists)])), -1, dtype=np.int64)
        for i, ends in enumerate(lists):
            if len(ends):
                at = by_k[np.minimum(np.searchsorted(k[by_k], ends), len(k) - 1)]
                at = at[k[at] == ends]  # neighbours that other shards found and this one holds too
                near[i, : len(at)] = at
        queries = np.flatnonzero(own)
        length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        far = np.zeros(len(k), dtype=np.int64)
        by_rep = np.argsort(rep, kind="stable")
        place = np.empty(len(k), dtype=np.int64)
        place[by_rep] = np.arange(len(k))
        parent = np.arange(len(k))
        for q, t in range_search(v, near, v[queries], least, medoid(v), beam):
            q = queries[q]
            cos = np.concatenate([np.einsum("ij,ij->i", raw[q[i : i + 65536]], raw[t[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.empty(0)]) / (length[q] * length[t])
            good = (cos >= least) & (q != t)
            q, t = q[good], t[good]
            np.add.at(far, q, n[t])
            _roots(len(k), place[q], place[t], parent)
        for i in range(len(parent)):  # a root is never after its tree
            parent[i] = parent[parent[i]]
        root = rep[by_rep][parent][place]
        return pa.table({"k": pa.array(k), "own": pa.array(own), "far": pa.array(far), "a": pa.array(rep), "b": pa.array(root)})

    full = dealt.join(lists, "k", "left").select("label", "dim", "shard", "k", "rep", "n", "own", "v", "near")
    return full.groupBy("label", "dim", "shard").applyInArrow(search, "k bigint, own boolean, far bigint, a bigint, b bigint")


def audit_recall(classes: DataFrame, found: DataFrame, least: float, most: int = AUDITED) -> float:
    """The mean, over queried classes with links, of the share of their links that `found` (k, far) counts; the truth is
    brute force. Queried are classes whose rep is divisible by 100, `most` at most, picked by a hash.

    They meet all others in blocks, so the cost grows with the rows."""
    spark = classes.sparkSession
    asked = classes.where("rep % 100 = 0")
    picked = thinned(asked, "rep", most).orderBy(F.xxhash64("rep"), "k").limit(most).select("k", "label", "dim", "v").collect()
    if not picked:
        return 1.0
    groups: dict = {}
    for r in picked:
        groups.setdefault((r["label"], r["dim"]), []).append(r)
    share = spark.sparkContext.broadcast({k: (np.array([r["k"] for r in x]), np.array([r["v"] for r in x], dtype=np.float64)) for k, x in groups.items()})

    def run(batches):
        for b in batches:
            out = []
            for key, own in b.groupby(["label", "dim"]):
                got = share.value.get(key)
                if got is not None:
                    near = _unit(got[1]) @ _unit(np.stack(own["v"].to_numpy())).T >= least + 1e-9
                    near &= got[0][:, None] != own["k"].to_numpy()[None]
                    out.append(pd.DataFrame({"k": got[0], "truth": near.astype(np.int64) @ own["n"].to_numpy()}))
            if out:
                yield pd.concat(out)

    truth = classes.select("k", "label", "dim", "n", "v").mapInPandas(run, "k bigint, truth bigint").groupBy("k").agg(F.sum("truth").alias("truth")).where("truth > 0")
    r = truth.join(found, "k", "left").agg(F.avg(F.least(F.lit(1.0), F.coalesce("far", F.lit(0)) / F.col("truth"))).alias("r")).first()
    return 1.0 if r["r"] is None else r["r"]


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine, in double precision, is `least` or more. Null ids, null
    labels, and vectors that are null, empty, zero or hold a null, NaN or infinity link with nothing; vectors of different
    lengths don't link. Equal vectors are one class, searched once, and count each other as links. Rows that repeat a
    vec_id have a row and links each, and one component. The recall of the graph search is audited against brute
    force; below RECALL it runs again with twice the overlap and beam, and below it still, it fails."""
    folder = Folder(vectors.sparkSession)
    classes = folder.put(classes_of(vectors), "classes")
    for widen in (1, 2, 4):
        links = folder.put(link_classes(classes, folder, least, OVERLAP * widen, BEAM * widen), f"links{widen}")
        folder.drop("members")
        far = links.where("own").select("k", "far")
        if (recall := audit_recall(classes, far, least)) >= RECALL:
            break
    else:
        raise RuntimeError(f"recall {recall:.3f} is below {RECALL}")
    reach = components(links.select("a", "b")).withColumnRenamed("id", "rep")
    facts = classes.select("k", "label", "dim", "rep", "n").join(far, "k").join(reach, "rep", "left")
    facts = facts.select("k", "label", "dim", (F.col("n") - 1 + F.col("far")).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = _rows(vectors)
    found = rows.where("good").select("vec_id", "k", "label", "dim").join(facts, ["k", "label", "dim"]).select("vec_id", "n_links", "component_id")
    single = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    return found.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98),
r(id, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from r join l on l.a = r.id),
c as (select id as vec_id, min(root) as component_id from r group by id),
n as (select a as vec_id, count(*) as n_links from l group by a)
select c.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, c.vec_id = component_id as kept from c left join n using (vec_id)
"""
