"""Near-duplicate join on word shingles: exact Jaccard links by prefix filters under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import MULT, blocks_of, components, gram_hashes, hashed_texts, mixed, repeat_ranges, slices
from netloom.plans.shared import Folder

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Orders of the tokens; a pair must share prefix tokens under each.
ORDERS = 2
#: Tokens with a place of their own in the orders, by frequency; all others count as rare. The bound keeps the list,
#: which every executor holds, at 9 bytes times this; it changes the orders only, never the links.
FREQUENT = 300_000
#: Sets that share a token from which on they are grouped round leaders first, and rows of a token that meet in one block.
CROWD, BLOCK = 8, 2048
#: Of how many crowded tokens one serves to gather crowds by.
SERVING = 8
#: Bits of the bitmap that a prefix token carries, and of that which a crowded one does.
SHORT, WIDE = 128, 1024
#: Shared prefix tokens that a pair is asked for at most under an order; parts of a prefix that a token's place is kept by.
ASKED, PARTS = 4, 16
#: Pairs that a head's text serves in one task, and ids (with their groups) that are broadcast at most.
SERVED, BROADCAST_IDS = 1000, 500_000
#: Pairs that a task looks at together, and that it holds uncounted.
LOOKED_AT, HELD = 100_000, 500_000
_SALTS = [np.uint64((0x9FB21C651E98DF25 * (2 * i + 1)) & ((1 << 64) - 1)) for i in range(ORDERS + 2)]


# sets of texts
def laid_sets(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of blocks of texts: their sets of shingle hashes laid end to end, each sorted and distinct, and their sizes.

    A set holds the runs of n words; of fewer words, one hash of them all; of none, nothing. A-Z are lower-cased."""
    raw = [(t or "").encode().translate(_LOWER) for t in texts]
    for low, high in blocks_of(raw):
        words, counts = hashed_texts(raw[low:high])
        begin = np.cumsum(counts) - counts
        some = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        start = np.cumsum(some) - some
        flat = np.empty(int(some.sum()), np.uint64)
        long = np.flatnonzero(counts >= n)
        if len(long):
            at = repeat_ranges(start[long], some[long])
            flat[at] = gram_hashes(words, n)[repeat_ranges(begin[long], some[long])]
        for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
            c = int(counts[i])
            flat[start[i]] = gram_hashes(words[begin[i] : begin[i] + c], c)[0] ^ np.uint64(0x5851F42D4C957F2D * c & ((1 << 64) - 1))
        for a, z in zip(start[long].tolist(), (start + some)[long].tolist()):
            flat[a:z].sort()
        new = np.ones(len(flat), dtype=bool)
        new[1:] = flat[1:] != flat[:-1]
        new[start[some > 0]] = True
        before = np.concatenate(([0], np.cumsum(new)))
        yield flat[new], before[start + some] - before[start]


def sets_of(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for flat, sizes in laid_sets(texts, n):
        yield from np.split(flat, np.cumsum(sizes)[:-1])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _per_set(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums, modulo 2 ** 64, of values over sets laid end to end."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def signatures(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; sets with the same size and both hashes count as equal."""
    out = []
    for salt in _SALTS[ORDERS:]:
        out.append(mixed(_per_set(mixed(flat ^ salt), sizes) * np.uint64(MULT) + sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def bitmaps(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The parity of each set's tokens that fall on each of m bits, m a power of two, twice the size at least: two sets
    differ in as many tokens, at least, as their bitmaps do in bits."""
    m = 1 << np.ceil(np.log2(np.maximum(32, sizes)) + 1).astype(np.int64)
    first = np.cumsum(m) - m
    spot = (mixed(flat ^ _SALTS[0]) & np.repeat((m - 1).astype(np.uint64), sizes)).astype(np.int64) + np.repeat(first, sizes)
    packed = np.packbits((np.bincount(spot, minlength=int(m.sum())) & 1).astype(np.uint8), bitorder="little")
    return [packed[a : a + k].tobytes() for a, k in zip((first >> 3).tolist(), (m >> 3).tolist())]


def short_bitmaps(flat: np.ndarray, sizes: np.ndarray, width: int) -> list[bytes]:
    """bitmaps() of `width` bits for each set."""
    spot = (mixed(flat ^ _SALTS[0]) & np.uint64(width - 1)).astype(np.int64) + width * np.repeat(np.arange(len(sizes)), sizes)
    packed = np.packbits((np.bincount(spot, minlength=width * len(sizes)) & 1).astype(np.uint8), bitorder="little")
    return [packed[a : a + width // 8].tobytes() for a in range(0, len(packed), width // 8)]


def laid_bitmaps(column: pa.Array) -> np.ndarray:
    """Bitmaps of SHORT or WIDE bits as rows of WIDE bits; what a short one lacks is 0."""
    lens = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    out = np.zeros((len(column), WIDE // 8), np.uint8)
    for size in (SHORT // 8, WIDE // 8):
        own = lens == size
        out[own, :size] = flat[np.repeat(own, lens)].reshape(-1, size)
    return out.view(np.uint64)


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the longer folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a, b = b, a
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def near_enough(n: int, m: int, apart: int, percent: int) -> bool:
    """Whether sets of sizes n and m that differ in `apart` tokens at least may still link: a link's difference is at
    most (100 - percent) / (100 + percent) of the sizes' sum."""
    return (100 + percent) * apart <= (100 - percent) * (n + m)


# orders and prefixes
def orders_of(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The places of tokens under each order: rarer ranks first, and a different scramble within a rank."""
    high = np.zeros(len(s), dtype=np.uint64)
    if len(frequent):
        where = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        high = np.where(frequent[where] == s, rank[where], 0).astype(np.uint64) << np.uint64(58)
    return [high | (mixed(s ^ _SALTS[i]) >> np.uint64(6)) for i in range(ORDERS)]


def prefix_size(n, percent: int):
    """How many tokens come first in an order that a set of n must share one of: one more than a partner may lack."""
    return n - -(-percent * n // 100) + 1


def shared_tokens(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens the prefixes of two linked sets share at least, under any order.

    Of the two prefixes let A's end first. B's prefix then holds every token of B up to there, and A lacks at most its
    size less the overlap that a link needs; so all of A's prefix but these is shared."""
    return np.maximum(1, overlap_of(n, m, percent) + 1 + (-percent * np.maximum(n, m)) // 100)


def overlap_of(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many tokens two linked sets share at least."""
    return -(-percent * (n + m) // (100 + percent))


def placed(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """A set's size and the part of its prefix that holds the token at `place` of its order, as one number."""
    return n * PARTS + PARTS * place // prefix_size(n, percent)


def soon_enough(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one token's places x and y, see placed(), in two sets: whether it may be among the first tokens that the sets
    share if they link, and how many of these are asked for, ASKED at most.

    After the k-th shared token either set still holds all but k of those that a link needs; so it stands before
    place n - overlap + k. A place is taken for the first of its part, so none is left out."""
    n, m = x // PARTS, y // PARTS
    asked = np.minimum(ASKED, shared_tokens(n, m, percent))
    room = asked - overlap_of(n, m, percent)
    first = lambda z, k: -(-(z % PARTS) * prefix_size(k, percent) // PARTS)
    return (first(x, n) < n + room) & (first(y, m) < m + room), asked


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def _sketch(docs: DataFrame, n: int) -> DataFrame:
    """One pass over the texts: (doc_id, n, s1, s2, bits, short, wide) of every row, and rows (tokens, counts) of tokens that recur.

    Counts come by lossy counting: a task gathers three million tokens and sends those it met twice or more, or oftener
    the more it gathered."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ["doc_id", "n", "s1", "s2", "bits", "short", "wide", "tokens", "counts"]

    def run(batches):
        held, size = [], 0

        def recurring():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 2 + size // 1_000_000
            rows = [*[None] * 7, tokens[often].tobytes(), counts[often].astype(np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(rows, kinds)], names=names)

        for b in (x for big in batches for x in slices(big)):
            at = 0
            for flat, sizes in laid_sets(b.column(1).to_pylist(), n):
                s1, s2 = signatures(flat, sizes)
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k), pa.array(sizes), pa.array(s1), pa.array(s2), pa.array(bitmaps(flat, sizes), pa.binary()), pa.array(short_bitmaps(flat, sizes, SHORT), pa.binary()), pa.array(short_bitmaps(flat, sizes, WIDE), pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
                at += k
                held.append(flat)
                size += len(flat)
                if size > 3_000_000:
                    yield recurring()
                    held, size = [], 0
        if held:
            yield recurring()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, bits binary, short binary, wide binary, tokens binary, counts binary")


def frequent_tokens(sketch: DataFrame, folder: Folder, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the largest sums, sorted, and a rank by the logarithm of their count; down to a sum that leaves
    `most` at most."""

    def run(batches):
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield _batch(token=np.frombuffer(t, np.int64), c=np.frombuffer(c, np.int64))

    sums = sketch.where("tokens is not null").select("tokens", "counts").mapInArrow(run, "token bigint, c bigint")
    counts = folder.put(sums.groupBy("token").agg(F.sum("c").alias("c")).where("c >= 8"), "counts")
    level = F.floor(16 * F.log2(F.col("c").cast("double")))
    levels = {r["l"]: r["n"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()}  # 16 for each doubling
    least, taken = 1 << 30, 0
    for l in sorted(levels, reverse=True):
        taken += levels[l]
        if taken > most:
            break
        least = l
    top = counts.where(level >= int(least)).toPandas()
    folder.drop("counts")
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.minimum(1 + np.log2(np.maximum(top["c"].to_numpy(np.float64), 1)).astype(np.int64), 62) if len(top) else np.empty(0, np.int64)
    return tokens[order], rank[order]


def _prefix_rows(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(token, sig, n) for each prefix token of each order; the order's number is in the lowest bit of token, n is
    placed(). Equal sets that a task meets together send one set of rows."""
    share = docs.sparkSession.sparkContext.broadcast((frequent, rank))

    def run(batches):
        frequent, rank = share.value
        for b in (x for big in batches for x in slices(big)):
            for flat, sizes in laid_sets(b.column(0).to_pylist(), n):
                sig, _ = signatures(flat, sizes)
                _, one = np.unique(sig, return_index=True)
                one = np.sort(one[sizes[one] > 0])
                if not len(one):
                    continue
                keep, start = prefix_size(sizes, percent), np.cumsum(sizes) - sizes
                tokens, places = [], []
                k = np.repeat(one, keep[one])
                inside = np.arange(len(k)) - np.repeat(np.cumsum(keep[one]) - keep[one], keep[one])
                for i, order in enumerate(orders_of(flat, frequent, rank)):
                    own = [a + np.argpartition(order[a : a + c], k - 1)[:k] if k < c else np.arange(a, a + c) for a, c, k in zip(start[one].tolist(), sizes[one].tolist(), keep[one].tolist())]
                    own = np.concatenate(own)
                    own = own[np.lexsort((order[own], k))]
                    tokens.append((flat[own] & ~np.uint64(1)) | np.uint64(i))
                    places.append(placed(sizes[k], inside, percent))
                yield _batch(token=_long(np.concatenate(tokens)), sig=np.tile(sig[k], ORDERS), n=np.concatenate(places))

    return docs.select("text").mapInArrow(run, "token bigint, sig bigint, n bigint")


def _shared(rows: DataFrame) -> DataFrame:
    """(token, sig, n, at, many): the rows of tokens that several sets have in their prefix, each set once; `at` numbers
    a token's rows from 0, many tells whether it has more than CROWD. A token's rows are streamed: CROWD of them are
    held at most."""
    dealt = rows.repartition("token").sortWithinPartitions("token", "sig")

    def run(batches):
        held = None  # the rows of the last token that did not go out yet: token, sig, n, at
        last, crowded = None, False  # the last row, and whether its token has more than CROWD

        def sent(token, sig, n, at, whole):
            """The rows of tokens with several, and the rest of the last token's unless it is whole."""
            nonlocal held, crowded
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(token)))
            top = at[begin + size - 1]  # the place of each token's last row
            many = np.repeat(top >= CROWD, size)
            out = np.repeat(top > 0, size)
            crowded = bool(top[-1] >= CROWD)
            if not whole and not crowded:
                held = tuple(x[begin[-1] :] for x in (token, sig, n, at))
                out[begin[-1] :] = False
            else:
                held = None
            if out.any():
                return _batch(token=token[out], sig=sig[out], n=n[out], at=at[out], many=many[out])

        for b in batches:
            if not b.num_rows:
                continue
            token, sig, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keep = np.ones(len(token), dtype=bool)
            keep[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            if last and last[0] == token[0] and last[1] == sig[0]:
                keep[0] = False
            token, sig, n = token[keep], sig[keep], n[keep]
            if not len(token):
                continue
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(new)
            at = np.arange(len(token)) - np.repeat(begin, np.diff(np.append(begin, len(token))))
            if last and last[0] == token[0]:
                at[: begin[1] if len(begin) > 1 else len(at)] += last[2] + 1
            last = (token[-1], sig[-1], int(at[-1]))
            if held:
                token, sig, n, at = (np.concatenate(x) for x in zip(held, (token, sig, n, at)))
            if (out := sent(token, sig, n, at, False)) is not None:
                yield out
        if held and (out := sent(*held, True)) is not None:
            yield out

    return dealt.mapInArrow(run, "token bigint, sig bigint, n bigint, at bigint, many boolean")


def _in_blocks(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows (token, node, n, g, short) dealt into cells (token, cell, side): any two of a token's rows with different groups
    meet in one cell, as rows of side 0, or as one of side 1 and one of side 2.

    Only the tokens of `hot`, which have more than BLOCK rows, have several cells. The rows of such a token's largest
    group fall into blocks that meet the blocks of all other rows, but not each other; so what is sent grows with the
    rows of a token as long as most of them are of one group."""
    if hot is None:
        return rows.select("token", F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("side"), "node", "n", "g", "short")
    plain = rows.join(hot, "token", "left_anti").select("token", F.lit(0).cast("bigint").alias("cell"), F.lit(0).alias("side"), "node", "n", "g", "short")
    crowded = rows.join(hot, "token")
    sizes = crowded.groupBy("token", "g").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "g")).alias("top"), F.sum("c").alias("all"))
    parts = lambda c: F.ceil(c / BLOCK)
    sizes = sizes.where(F.col("all") > F.col("top.c")).select("token", F.col("top.g").alias("main"), parts(F.col("top.c")).alias("mains"), parts(F.col("all") - F.col("top.c")).alias("others"))
    x = crowded.join(sizes, "token")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("g") == F.col("main"), F.col("mains")).otherwise(F.col("others")))
    x = x.withColumn("own", own)
    wide = F.col("mains") + F.col("others")
    cell = lambda i, j, side: F.struct((i * wide + j).alias("cell"), side.alias("side"))
    upto = lambda c: F.sequence(F.lit(0).cast("bigint"), c - 1)
    of_main = F.transform(upto(F.col("others")), lambda j: cell(F.col("own"), F.col("mains") + j, F.lit(1)))
    with_main = F.transform(upto(F.col("mains")), lambda i: cell(i, F.col("mains") + F.col("own"), F.lit(2)))
    with_others = F.transform(upto(F.col("others")), lambda j: cell(F.col("mains") + F.least(j, F.col("own")), F.col("mains") + F.greatest(j, F.col("own")), F.when(j == F.col("own"), 0).when(F.col("own") < j, 1).otherwise(2)))
    cells = F.when(F.col("g") == F.col("main"), of_main).otherwise(F.concat(with_main, with_others))
    split = x.withColumn("x", F.explode(cells)).select("token", "x.cell", "x.side", "node", "n", "g", "short")
    return plain.unionByName(split)


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of rows (token, cell, side, node, n, g, short) of different groups whose sizes and short bitmaps
    allow a link, and that share, under every order, as many of the first tokens of their prefixes as are asked for
    (see soon_enough()). A cell's rows come one after the other and meet in blocks, by numpy; what leaves is counted by pair first."""
    dealt = rows.repartition("token", "cell").sortWithinPartitions("token", "cell")

    def run(batches):
        out: list[tuple] = []
        size = 0

        def counted():
            a, b, o, need = (np.concatenate([x[i] for x in out]) for i in range(4))
            order = np.lexsort((b, a))
            a, b, o, need = a[order], b[order], o[order], need[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            begin = np.flatnonzero(new)
            sums = [np.add.reduceat((o == i).astype(np.int64), begin) for i in range(ORDERS)]
            return _batch(a=a[begin], b=b[begin], need=np.minimum.reduceat(need, begin), **{f"c{i}": x for i, x in enumerate(sums)})

        def keep(whole, i, j):
            nonlocal size
            token, node, n, g = whole[0], whole[3], whole[4], whole[5]
            ok = (g[i] != g[j]) & (node[i] != node[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            ok, asked = soon_enough(whole[7][i], whole[7][j], percent)
            i, j, asked = i[ok], j[ok], asked[ok]
            apart = np.bitwise_count(whole[6][i] ^ whole[6][j]).sum(axis=1, dtype=np.int64)
            ok = near_enough(n[i], n[j], apart, percent)
            i, j = i[ok], j[ok]
            if len(i):
                out.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), token[i] & (ORDERS - 1), asked[ok]))
                size += len(i)

        def pairs(whole):
            """Of complete cells; yields when many pairs are held."""
            nonlocal out, size
            token, cell, side = whole[:3]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
            begin = np.flatnonzero(new)
            many = np.diff(np.append(begin, len(token)))
            few = (many <= 64) & (np.maximum.reduceat(side, begin) == 0)
            for width in np.unique(many[few]):
                if width < 2:
                    continue
                first = begin[few & (many == width)]
                x, y = np.triu_indices(width, 1)
                step = max(1, LOOKED_AT // len(x))
                for k in range(0, len(first), step):
                    own = first[k : k + step, None]
                    keep(whole, (own + x).ravel(), (own + y).ravel())
                    if size > HELD:
                        yield counted()
                        out, size = [], 0
            for a, c in zip(begin[~few].tolist(), many[~few].tolist()):
                at = np.arange(a, a + c)
                same, one, two = (at[side[at] == k] for k in range(3))
                for left, right in ((same, same), (one, two)):
                    step = max(1, LOOKED_AT // max(1, len(right)))
                    for k in range(0, len(left), step):
                        x = left[k : k + step]
                        y = right[k:] if left is right else right
                        if not len(y):
                            continue
                        u, v = np.repeat(x, len(y)), np.tile(y, len(x))
                        if left is right:
                            ok = u < v
                            u, v = u[ok], v[ok]
                        keep(whole, u, v)
                        if size > HELD:
                            yield counted()
                            out, size = [], 0

        held: list[list] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            now[4] = now[4] // PARTS  # the size by itself
            now += [laid_bitmaps(batch.column(6)), batch.column(4).to_numpy(zero_copy_only=False)]
            held.append(now)
            if len(held) > 1 and (now[0][-1], now[1][-1]) == (held[0][0][0], held[0][1][0]):
                continue  # the cell goes on
            whole = [np.concatenate([h[i] for h in held]) for i in range(8)]
            last = np.flatnonzero((whole[0] != whole[0][-1]) | (whole[1] != whole[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from pairs([w[:cut] for w in whole])
            held = [[w[cut:] for w in whole]]
        if held:
            yield from pairs([np.concatenate([h[i] for h in held]) for i in range(8)])
        if out:
            yield counted()

    counts = ", ".join(f"c{i} bigint" for i in range(ORDERS))
    found = dealt.select("token", "cell", "side", "node", "n", "g", "short").mapInArrow(run, f"a bigint, b bigint, need bigint, {counts}")
    found = found.groupBy("a", "b").agg(F.min("need").alias("need"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(ORDERS)])
    return found.where(" and ".join(f"c{i} >= need" for i in range(ORDERS))).select("a", "b")


# verification
def _plausible(pairs: DataFrame, classes: DataFrame, percent: int, folder: Folder, name: str) -> DataFrame:
    """(a, b, apart): the pairs (a, b) whose sizes and bitmaps allow a link, and in how many bits these differ. Only
    classes that some pair has are sent."""
    pairs = folder.put(pairs, f"{name}_met")
    ids = folder.put(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), f"{name}_met_ids")
    classes = classes.join(_small(ids), "node", "left_semi")
    of = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches):
        for b in batches:
            n, m, x, y = (b.column(i).to_pylist() for i in range(2, 6))
            apart = list(map(bits_apart, x, y))
            ok = [near_enough(*row, percent) for row in zip(n, m, apart)]
            yield _batch(a=b.column(0), b=b.column(1), apart=pa.array(apart, pa.int64())).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint, apart bigint").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _once(rows: DataFrame, folder: Folder, name: str) -> DataFrame:
    """rows (node, text), each once. Only texts of nodes that have several rows are dealt out for that."""
    again = folder.put(rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node"), f"{name}_again")
    if again.isEmpty():
        return rows
    again = _small(again)
    return folder.put(rows.join(again, "node", "left_anti").unionByName(rows.join(again, "node", "left_semi").dropDuplicates(["node", "text"])), f"{name}_once")


def _heads_and_tails(pairs: DataFrame, docs: DataFrame, folder: Folder, name: str) -> DataFrame:
    """Rows (a, part, b, text) of pairs of documents: b is null with the text of a, once for SERVED pairs; all others have
    the text of b, once a pair. a is the document of a pair that has more of them, so that what many are compared with
    neither travels often nor falls to one task. Where the pairs are few enough to be broadcast, a text crosses no
    shuffle on the way here."""
    both = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    wanted = folder.put(both.groupBy("doc_id").agg(F.count("*").alias("c")), f"{name}_ids")
    rows = folder.put(docs.where("text is not null").join(_small(wanted.select("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text"), f"{name}_texts")
    texts = _once(rows, folder, name)
    of = lambda x: _small(wanted).select(F.col("doc_id").alias(x), F.col("c").alias(f"c{x}"))
    by_a = F.col("ca") >= F.col("cb")
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("b"))
    parts = _small(folder.put(pairs.groupBy("a").agg(F.ceil(F.count("*") / SERVED).alias("parts")), f"{name}_parts"))
    heads = texts.join(parts, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"), "text")
    sent = _small(folder.put(pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"), f"{name}_sent"))
    tails = texts.join(sent, F.col("node") == F.col("b")).select("a", "part", "b", "text")
    return heads.unionByName(tails)


def _linked(pairs: DataFrame, docs: DataFrame, folder: Folder, name: str, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that link, judged on whole texts."""
    rows = _heads_and_tails(pairs, docs, folder, name).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        last, head = None, []
        for big in batches:
            for rows in slices(big):
                out = []
                for a, part, b, s in zip(*(rows.column(i).to_pylist() for i in range(3)), sets_of(rows.column(3).to_pylist(), n)):
                    if (a, part) != last:
                        last, head = (a, part), []
                    if b is None:
                        head.append(s)
                    elif any(linked(h, s, percent) for h in head):
                        out.append((min(a, b), max(a, b)))
                yield _batch(a=pa.array([r[0] for r in out], pa.int64()), b=pa.array([r[1] for r in out], pa.int64()))

    found = folder.put(rows.mapInArrow(run, "a bigint, b bigint").distinct(), name)
    folder.drop(*(f"{name}_{x}" for x in ("ids", "texts", "again", "once", "parts", "sent")))
    return found


def _serving(shared: DataFrame) -> DataFrame:
    """(token, node): the rows of crowded tokens, of one token in SERVING; enough to gather crowds by."""
    return shared.where("many").where(F.pmod(F.xxhash64("token"), F.lit(SERVING)) == 0).select("token", "node")


def _leaders(shared: DataFrame) -> DataFrame:
    """(a, b): each set a of a crowded token, with that token's two leaders b: those that share the most such tokens, as
    an original of many near copies does."""
    rows = _serving(shared)
    rows = rows.join(rows.groupBy("node").agg(F.count("*").alias("score")), "node")
    head = lambda *tie: F.max(F.struct("score", *tie, F.col("node").alias("b")))
    heads = rows.groupBy("token").agg(head().alias("x"), head(F.bitwise_not("node").alias("t")).alias("y"))
    heads = heads.select("token", F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
    return rows.join(heads, "token").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _others(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): each set a of a crowded token that is not of the token's largest group, with one set b of that group;
    another one for each token."""
    rows = _serving(shared).join(_small(groups).withColumnRenamed("id", "node"), "node", "left").select("token", "node", F.coalesce("component", "node").alias("g"))
    one = rows.groupBy("token", "g").agg(F.count("*").alias("c"), F.max(F.struct(F.xxhash64("token", "node").alias("h"), F.col("node").alias("b"))).alias("x"))
    one = one.groupBy("token").agg(F.max(F.struct("c", "g", "x.b")).alias("y")).select("token", "y.g", "y.b").withColumnRenamed("g", "main")
    return rows.join(one, "token").where("g <> main").select(F.col("node").alias("a"), "b").distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


class Join:
    """The join of docs (doc_id, text) with themselves, step by step over tables in the shared folder.

    Equal sets are one class, whose node is its smallest doc_id; documents with the same doc_id are one node."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.folder = Folder(docs.sparkSession)
        self.docs, self.n, self.percent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), n, percent
        put = self.folder.put
        self.sketch = put(_sketch(self.docs, n), "sketch")
        self.rows = self.sketch.where("n is not null").select("doc_id", "n", "s1", "s2")
        classes = self.sketch.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), *[F.first(x).alias(x) for x in ("bits", "short", "wide")])
        self.classes = put(classes, "classes")
        frequent, rank = frequent_tokens(self.sketch, self.folder)
        shared = _shared(_prefix_rows(self.docs, n, percent, frequent, rank))
        shared = shared.join(self.classes.select(F.col("s1").alias("sig"), "node", "short", "wide"), "sig")
        self.shared = put(shared.select("token", "node", "n", "at", "many", F.when(F.col("many"), F.col("wide")).otherwise(F.col("short")).alias("short")), "shared")

    def pairs(self, groups: DataFrame | None, name: str) -> DataFrame:
        """(a, b): candidates that pass the filters of all orders and the bitmaps, of different groups (id, component) only;
        rows of crowded tokens that one group has to itself are not dealt."""
        rows = self.shared.withColumn("g", F.col("node"))
        if groups is not None:
            rows = self.shared.join(_small(groups).withColumnRenamed("id", "node"), "node", "left").withColumn("g", F.coalesce("component", "node"))
            crowded = rows.where("many")
            several = self.folder.put(crowded.groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("z")).where("a < z").select("token"), f"{name}_tokens")
            rows = rows.where("not many").unionByName(crowded.join(_small(several), "token", "left_semi").select(*rows.columns))
        rows = rows.select("token", "node", "n", "g", "short")
        hot = self.shared.where(F.col("at") == BLOCK).select("token").distinct()
        rows = _in_blocks(rows, None if hot.isEmpty() else hot)
        found = self.folder.put(_plausible(_candidates(rows, self.percent), self.classes, self.percent, self.folder, name), name)
        self.folder.drop(f"{name}_tokens", f"{name}_met", f"{name}_met_ids")
        return found

    def gathered(self, stars: DataFrame, name: str) -> DataFrame:
        """The links of stars (a, b) by which each a is joined to the b that its bitmap is nearest to."""
        near = _plausible(stars, self.classes, self.percent, self.folder, name).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("x"))
        pairs = self.folder.put(near.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct(), f"{name}_stars")
        found = self.verified(pairs, name)
        self.folder.drop(f"{name}_stars", f"{name}_met", f"{name}_met_ids")
        return found

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        return _linked(pairs, self.docs, self.folder, name, self.n, self.percent)

    def forget(self) -> None:
        """Drops what only the search needs."""
        self.folder.drop("shared")


def all_links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc_id, node) of every row, and every link (a, b), a < b, between nodes, each verified.

    A node stands for documents with equal sets, by its smallest doc_id; rows without words, or whose set no row with a
    doc_id has, have the node null. Links within a group of near copies are all there, so links may be far more
    than documents; near_duplicates() needs only some of them."""
    join = Join(docs, n, percent)
    links = join.verified(join.pairs(None, "pairs").select("a", "b"), "links")
    join.forget()
    return join.rows.join(join.classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"], "left").select("doc_id", "node"), links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text): component_id is the smallest doc_id that
    links reach. Two documents link when their sets of n-word shingles (words lower-cased in A-Z) have a Jaccard
    similarity of percent / 100 or more.

    Equal sets are one class from the start. Candidates share enough prefix tokens under every order. Where very many
    sets share a token they are compared with its leaders first, then those left out with members of its largest
    group, which gathers large groups of near copies in linear time; after that, classes of different groups are
    candidates, and sizes and bitmaps must allow the link.
    Of these pairs a tree is verified, then all that still lie in different groups. So no link between different
    groups is missed, and no pairs within a group are written out.

    Null and empty texts have an empty set: n_shingles 0, linked with nothing. Shorter texts count their whole
    sequence as one shingle. Repeated rows give a row each, and documents with the same doc_id are one that holds all
    their sets; rows with a null doc_id have the component of the documents with an equal set, or null if there is none."""
    join = Join(docs, n, percent)
    put = join.folder.put
    first = join.gathered(_leaders(join.shared), "first")
    groups = put(components(first), "groups")
    first = first.union(join.gathered(_others(join.shared, groups), "again"))
    groups = put(components(first), "groups_again")
    pairs = join.pairs(groups, "pairs")
    join.forget()
    tree = put(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"), "tree")  # most pairs fall into one group by these
    second = join.verified(tree, "second")
    groups = put(components(first.union(second)), "regrouped")
    of = lambda x: groups.select(F.col("id").alias(x), F.col("component").alias(f"g{x}"))
    apart = F.coalesce("ga", "a") != F.coalesce("gb", "b")
    rest = put(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).join(tree, ["a", "b"], "left_anti").select("a", "b"), "rest")
    third = join.verified(rest, "third")
    join.folder.drop("groups", "groups_again", "pairs", "tree", "rest", "regrouped")

    of_rows = join.rows.join(join.classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"]).where("doc_id is not null").select("doc_id", "node")
    several = of_rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("doc_id", "a")
    same = of_rows.join(several, "doc_id").select("a", F.col("node").alias("b"))
    whole = components(first.union(second).union(third).union(same)).withColumnRenamed("id", "node")
    named = join.classes.select("n", "s1", "s2", "node").join(whole, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    found = join.rows.join(named, ["n", "s1", "s2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id, and of equal ids any one.

    Rows without words, and rows with a null doc_id, stay as they are."""
    found = near_duplicates(docs.select("doc_id", "text"), n, percent)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return left.withColumn("_again", F.when(worded, again).otherwise(1)).where("_again = 1").drop("_again").select(*docs.columns)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose four-word shingles agree to 85 percent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, 4, 85)
