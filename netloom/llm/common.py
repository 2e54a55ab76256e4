"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.shared import Folder

MULT = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULT, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []
#: Bytes of a batch of texts that a task takes up at once.
TAKEN = 4 << 20
#: Links that one task follows at most.
ONE_TASK = 1_000_000


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a Parquet table in the shared folder, which cuts its lineage and outlives a lost executor."""
    return Folder(df.sparkSession).put(df, name)


def thinned(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of df, about 4 * `rows` of them, whose hash of key is lowest: what a bounded sample is picked from, so
    that partitions don't each send as many rows as the sample has. All rows if there are no more."""
    share = min(1.0, 4 * rows / max(1, df.count()))
    return df if share == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (MULT, INVERSE):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, a run of bytes other than space and \\t to \\r, in order."""
    b = np.frombuffer(text, dtype=np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    edge = np.empty(len(b) + 1, dtype=np.int8)
    solid = (~_SPACE[b]).view(np.int8)
    edge[0], edge[-1] = solid[0], -solid[-1]
    np.subtract(solid[1:], solid[:-1], out=edge[1:-1])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(b) + 1)
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks_of(texts: list[bytes], most: int = 1 << 20):
    """Runs (from, to) of texts of about `most` bytes together; a longer text is a run of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in one array and, of each text, its number of words.

    A separator stands between texts; counts come from the places of the separators."""
    joined = b" ".join(texts)
    h = word_hashes(joined)
    counts = np.empty(len(texts), dtype=np.int64)
    b = np.frombuffer(joined, dtype=np.uint8)
    if not len(b):
        counts[:] = 0
        return h, counts
    solid = ~_SPACE[b]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    before = np.concatenate(([0], np.cumsum(first, dtype=np.int64)))
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    counts[:] = before[np.minimum(begin + lens, len(b))] - before[np.minimum(begin, len(b))]
    return h, counts


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of b in slices of about TAKEN bytes, as texts become strings and arrays many times their size."""
    step = max(1, b.num_rows * TAKEN // max(1, b.nbytes))
    for low in range(0, b.num_rows, step):
        yield b.slice(low, step)


def repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..: counts[0] numbers, then counts[1] from starts[1] on, and so on."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, at the place of its first word; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(MULT) + words[i : i + m]
    return mixed(h)


def reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links (u, v), sorted, and the smallest id that links reach from each."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id that links reach.

    Up to `one_task` distinct links, which are 16 bytes each, are followed by one task. More are followed by all:
    it alternates large-star and small-star steps over tables in the shared folder until the links no longer change;
    what comes to the driver is a count and a sum. Loops and nulls are ignored; no links give an empty table.
    A star step groups by node with min() only, so a node with very many links needs no list of them."""
    folder = Folder(edges.sparkSession)
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    pairs = folder.put(pairs.distinct(), "0")
    if pairs.count() <= one_task:

        def follow(batches):
            held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if held:
                ids, low = reached(*(np.concatenate(x) for x in zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(low, pa.int64())], names=["id", "component"])

        return pairs.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInArrow(follow, "id bigint, component bigint")

    def mark(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    was = mark(pairs)
    for k in range(rounds):
        if not was[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = folder.put(small, f"{k + 1}")
        folder.drop(f"{k}")
        now = mark(pairs)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    top = pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return top.union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
