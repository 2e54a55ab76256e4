"""Substring dedup: words covered by long runs that an earlier document holds too, found by FM-indexes of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import blocks_of, gram_hashes, hashed_texts, repeat_ranges, word_hashes
from netloom.llm.fm_index import FMIndex

#: Words of an anchor, windows of one fragment at most, and bytes of text for each shard.
ANCHOR, FRAGMENT, SHARD_BYTES = 5, 20, 16_000_000
#: Words that stream through an index at once.
STREAMED = 1 << 17
#: Anchors and words that a task gathers before it sends them on.
GATHERED_ANCHORS, GATHERED_WORDS = 1_500_000, 1_000_000


def window_anchors(words: np.ndarray, window: int) -> np.ndarray:
    """The smallest hash of ANCHOR words within each window of words: equal windows have equal anchors."""
    k = min(ANCHOR, window)
    g = gram_hashes(words, k)
    span = window - k + 1
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least, width = g, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    rest = span - width
    return np.minimum(least[:n], least[rest : rest + n])


def fragments(anchors: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the runs of windows with one anchor; whole: whether a window counts.

    A run of more than FRAGMENT windows falls into several."""
    n = len(anchors)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(new)
    lens = np.diff(np.append(starts, n))
    good = whole[starts]
    starts, lens = starts[good], lens[good]
    if len(lens) and lens.max() > FRAGMENT:
        parts = -(-lens // FRAGMENT)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + FRAGMENT * inner
        lens = np.minimum(np.repeat(lens, parts) - FRAGMENT * inner, FRAGMENT)
    return starts, lens


def _whole(counts: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each word of texts laid end to end stays inside its text."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return (np.arange(total) + window <= ends)[: max(0, total - window + 1)]


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _anchor_rows(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """(r, direct, anchors, keys): the distinct anchors of documents, dealt by r, a range of the anchors.

    Anchors that a task meets in several documents are known to repeat: their keys go on as `direct` rows, and one of
    them, under key 0, tells the others. So a very common passage sends one entry a task, not one a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            a, k = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            order = np.lexsort((k, a))
            a, k = a[order], k[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
            a, k = a[new], k[new]
            first = np.ones(len(a), dtype=bool)
            first[1:] = a[1:] != a[:-1]
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1
            rows = [(int(a[0] % np.uint64(shards)), True, _bytes(a[many]), _bytes(k[many]))]
            k = np.where(many, 0, k)[first]
            a = a[first]
            to = (a >> np.uint64(20)) % np.uint64(shards)
            order = np.argsort(to, kind="stable")
            a, k, to = a[order], k[order], to[order]
            cuts = np.searchsorted(to, np.arange(shards + 1).astype(np.uint64))
            for r in range(shards):
                if cuts[r] < cuts[r + 1]:
                    rows.append((r, False, _bytes(a[cuts[r] : cuts[r + 1]]), _bytes(k[cuts[r] : cuts[r + 1]])))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["r", "direct", "anchors", "keys"])

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            texts = [t.encode() for t in b.column(1).to_pylist()]
            for low, high in blocks_of(texts):
                words, counts = hashed_texts(texts[low:high])
                whole = _whole(counts, window)
                a = window_anchors(words, window)
                starts, _ = fragments(a, whole)
                if len(starts):
                    owner = np.searchsorted(np.cumsum(counts), starts, side="right")
                    held.append((a[starts], keys[low:high][owner]))
                    size += len(starts)
                if size > GATHERED_ANCHORS:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    return docs.select("key", "text").mapInArrow(run, "r int, direct boolean, anchors binary, keys binary")


def _repeated(table: pa.Table) -> pa.Table:
    """(key, anchor) of the anchors of one range that several documents hold."""
    out_a, out_k, a, k = [], [], [], []
    for direct, x, y in zip(table["direct"].to_pylist(), table["anchors"].to_pylist(), table["keys"].to_pylist()):
        (out_a if direct else a).append(np.frombuffer(x, np.uint64))
        (out_k if direct else k).append(np.frombuffer(y, np.int64))
    if a:
        anchors, keys = np.concatenate(a), np.concatenate(k)
        order = np.argsort(anchors, kind="stable")
        anchors, keys = anchors[order], keys[order]
        first = np.ones(len(anchors), dtype=bool)
        first[1:] = anchors[1:] != anchors[:-1]
        group = np.cumsum(first) - 1
        several = ((np.bincount(group) > 1) | (np.bincount(group, weights=keys == 0) > 0))[group] & (keys != 0)
        out_a.append(anchors[several])
        out_k.append(keys[several])
    a, k = np.concatenate(out_a), np.concatenate(out_k)
    return pa.table({"key": pa.array(k), "anchor": pa.array(a.view(np.int64))})


def _fragment_rows(docs: DataFrame, window: int, shards: int) -> DataFrame:
    """(shard, lens, words, ids, keys, starts): the fragments of documents whose anchors repeat, by shard.

    docs: key, doc_id, text and the repeated anchors of each. Words travel as 48 bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sent() -> pa.RecordBatch:
            shard, lens, ids, keys, starts = (np.concatenate([h[i] for h in held]) for i in range(5))
            words = np.concatenate([h[5] for h in held])
            order = np.argsort(shard, kind="stable")
            begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
            rows = []
            shard, lens, ids, keys, starts, begin = (x[order] for x in (shard, lens, ids, keys, starts, begin))
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            for low, high in zip(cuts, np.append(cuts[1:], len(shard))):
                n = lens[low:high]
                at = np.arange(n.sum()) + np.repeat(begin[low:high] - (np.cumsum(n) - n), n)
                packed = words[at].view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((int(shard[low]), _bytes(n.astype(np.uint8)), _bytes(packed), _bytes(ids[low:high]), _bytes(keys[low:high]), _bytes(starts[low:high].astype(np.int32))))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 5))], names=["shard", "lens", "words", "ids", "keys", "starts"])

        for big in batches:
            for low in range(0, big.num_rows, 64):
                b = big.slice(low, 64)
                for key, doc, text, own in zip(*(c.to_pylist() for c in b.columns)):
                    words = word_hashes(text.encode())
                    a = window_anchors(words, window)
                    starts, n = fragments(a, np.ones(len(a), dtype=bool))
                    keep = np.isin(a[starts], np.array(own, dtype=np.int64).view(np.uint64))
                    starts, n = starts[keep], n[keep] + window - 1
                    if not len(starts):
                        continue
                    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
                    shard = ((a[starts] >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
                    held.append((shard, n, np.full(len(n), doc), np.full(len(n), key), starts, words[at]))
                    size += int(n.sum())
                    if size > GATHERED_WORDS:
                        yield sent()
                        held, size = [], 0
        if held:
            yield sent()

    return docs.select("key", "doc_id", "text", "own").mapInArrow(run, "shard int, lens binary, words binary, ids binary, keys binary, starts binary")


def repeats_in_shard(lens: np.ndarray, words: np.ndarray, ids: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fragment, window in it) of the windows that a fragment with a smaller id holds too.

    Equal fragments are indexed once, with their smallest id. The fragments then stream through the index, STREAMED words
    at a time, as patterns of matching statistics: where the longest match reaches a window, its occurrences are an
    interval of the suffixes, whose smallest owner is the first document that holds it. Intervals of different windows
    are apart, so one pass takes their minima."""
    begin = np.cumsum(lens) - lens
    within = np.arange(lens.sum()) - np.repeat(begin, lens)
    odd = (within.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix = (words + odd) * (odd | np.uint64(1))
    mix ^= mix >> np.uint64(31)
    mix *= np.uint64(0xD6E8FEB86659FD93)
    h = np.add.reduceat(mix ^ (mix >> np.uint64(29)), begin) + lens.astype(np.uint64)
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    n = lens[first]
    text = words[repeat_ranges(begin[first], n)]
    index = FMIndex(text, np.cumsum(n), np.repeat(least, n))
    windows = n - window + 1
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    place = np.repeat(np.cumsum(n) - n, windows) + inner  # of each window in the text
    low, high = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    for i in range(0, len(text), STREAMED):
        own = slice(*np.searchsorted(place, (i, i + STREAMED)))
        length, l, r = index.matching_statistics(text[i : i + STREAMED + window - 1], window, True)
        at = place[own] - i
        if (length[at] < window).any():
            raise RuntimeError("a fragment of the index is not found in it")
        low[own], high[own] = l[at], r[at]
    cuts, one, back = np.unique(low, return_index=True, return_inverse=True)
    bounds = np.stack([cuts, high[one]], 1).ravel()
    minima = np.minimum.reduceat(np.append(index.owner, np.iinfo(np.int64).max), bounds)[::2]
    of_window = minima[back]
    offset = np.cumsum(windows) - windows
    for i in range(0, len(lens), 1 << 16):
        own = np.arange(i, min(len(lens), i + (1 << 16)))
        count = windows[same[own]]
        which = np.repeat(own, count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = of_window[np.repeat(offset[same[own]], count) + inside] < ids[which]
        yield which[hit], inside[hit]


def _search(window: int):
    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        lens = join("lens", np.uint8).astype(np.int64)
        packed = join("words", np.uint8).reshape(-1, 6)
        words = np.zeros((len(packed), 8), np.uint8)
        words[:, :6] = packed
        words = words.view(np.uint64).ravel()
        del packed
        ids, keys, starts = join("ids", np.int64), join("keys", np.int64), join("starts", np.int32)
        out_k, out_s, out_n = [], [], []
        for which, inside in repeats_in_shard(lens, words, ids, window):
            if not len(which):
                continue
            cut = np.ones(len(which), dtype=bool)
            cut[1:] = (which[1:] != which[:-1]) | (inside[1:] != inside[:-1] + 1)
            begin = np.flatnonzero(cut)
            out_k.append(keys[which[begin]])
            out_s.append(starts[which[begin]] + inside[begin])
            out_n.append(np.diff(np.append(begin, len(which))) + window - 1)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        return pa.table({"key": pa.array(cat(out_k, np.int64)), "start": pa.array(cat(out_s, np.int32)), "n": pa.array(cat(out_n, np.int32))})

    return run


def repeated_intervals(docs: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """(rows, intervals): docs (doc_id, text) with a key of each row's id and text, and (key, start, n) in words: every
    run of n >= window words whose windows all occur in a document with a smaller doc_id. Runs may overlap.

    A window's anchor decides its shard, so all copies of a window meet in one; what repeats nowhere by its anchor is
    never sent. The number of shards follows the bytes of text, so a shard's index stays the same size. Documents whose
    whole text an earlier one has are not searched: all their windows repeat (see remove_repeats). Rows with a null
    doc_id or text take no part."""
    facts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    shards = max(8, -(-facts["b"] // SHARD_BYTES))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    usable = rows.where("doc_id is not null and text is not null")
    by = usable.select("doc_id", "key", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"))
    firsts = by.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "c", "first")
    copies = by.join(firsts, ["h", "c"]).where("doc_id > first").select("key").distinct()
    anchors = _anchor_rows(usable, window, shards).groupBy("r").applyInArrow(_repeated, "key bigint, anchor bigint")
    own = anchors.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_set("anchor").alias("own"))
    known = rows.join(own, "key")  # dealt as remove_repeats() deals them, so the texts move once
    found = _fragment_rows(known, window, shards).groupBy("shard").applyInArrow(_search(window), "key bigint, start int, n int")
    marks = found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs")).withColumn("copy", F.lit(False))
    all_of = copies.select("key", F.lit(None).cast("array<struct<start:int,n:int>>").alias("runs"), F.lit(True).alias("copy"))
    return rows, marks.unionByName(all_of)


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs (doc_id, text): kept is its words, joined by one space,
    without those covered by a window of `window` words that a document with a smaller doc_id holds too.

    Null and empty texts have no words; texts shorter than a window lose none; a row whose doc_id is null loses none.
    Repeated rows give a row each, and rows of one doc_id never cost each other words."""
    rows, marks = repeated_intervals(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for low in range(0, big.num_rows, 256):
                b = big.slice(low, 256)
                n_words, n_removed, kept = [], [], []
                for text, runs, copy in zip(*(b.column(c).to_pylist() for c in ("text", "runs", "copy"))):
                    words = (text or "").encode().split()
                    n = len(words)
                    if copy and n >= window:
                        gone, words = n, []
                    elif runs:
                        edge = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(edge, [r["start"] for r in runs], 1)
                        np.add.at(edge, [r["start"] + r["n"] for r in runs], -1)
                        left = np.cumsum(edge[:-1]) == 0
                        words = [w for w, x in zip(words, left.tolist()) if x]
                        gone = n - len(words)
                    else:
                        gone = 0
                    n_words.append(n)
                    n_removed.append(gone)
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(marks, "key", "left").select("doc_id", "text", "runs", "copy").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def brute_force(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """The result for (doc_id, text) pairs by looking at every window, for tests."""
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What all documents keep when windows of 13 words that an earlier document holds go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
