"""Unigram encoding and decoding with the pieces and scores of a public .model file, which is read and never trained."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the query looks for its model; the environment may name another folder.
MODEL = os.path.join(os.environ.get("NETLOOM_TOKENIZERS", "/opt/tokenizers"), "piece_bpe_32k.model")
#: Fixed values of the format: kinds of pieces, the whitespace mark, and what an unknown character costs.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK, UNKNOWN_COST = "▁", 10.0
#: Distinct words whose pieces a worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {5: 4, 1: 8}[kind]
            yield key >> 3, data[at : at + n]
            at += n


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], bool]:
    """The pieces (text, score, kind) of a model file, and whether a mark is put before the text."""
    pieces, prefix = [], True
    for k, v in _fields(data):
        if k == 1:
            got = dict(_fields(v))
            pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif k == 3:
            prefix = bool(dict(_fields(v)).get(3, 1))
    return pieces, prefix


class DoubleArray:
    """A trie of byte strings in two arrays: the child of state s by byte b is base[s] + b + 1 if check of it is s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for w, value in words.items():
            s = 0
            for b in w:
                t = children[s].get(b)
                if t is None:
                    t = children[s][b] = len(children)
                    children.append({})
                    values.append(-1)
                s = t
            values[s] = value
        size = 1 << 16
        used = bytearray(size)
        used[0] = 1
        base, check, value = [0] * size, [-1] * size, [-1] * size
        places, todo = [0] * len(children), [0]
        free = dense = 1  # before these, no slot is free, or few are
        for s in todo:
            own, at = children[s], places[s]
            value[at] = values[s]
            if not own:
                continue
            keys = sorted(own)
            free = used.find(0, free)
            slot = used.find(0, max(free if len(keys) == 1 else dense, keys[0] + 1))
            tries = 0
            while True:
                x = slot - keys[0] - 1
                while x + 258 > len(used) or slot < 0:
                    more = len(used)
                    used += bytes(more)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                    slot = slot if slot >= 0 else more
                    x = slot - keys[0] - 1
                if not any(used[x + k + 1] for k in keys):
                    break
                slot = used.find(0, slot + 1)
                tries += 1
            if tries > 50:
                dense = slot
            base[at] = x
            for k in keys:
                to = x + k + 1
                used[to], check[to], places[own[k]] = 1, at, to
                todo.append(own[k])
        self.base, self.check, self.value = array("i", base), array("i", check), array("i", value)

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each word that starts at `at`."""
        base, check, value, s = self.base, self.check, self.value, 0
        for i in range(at, len(text)):
            t = base[s] + text[i] + 1
            if check[t] != s:
                return
            s = t
            if value[s] >= 0:
                yield i + 1, value[s]


class Unigram:
    """Encodes and decodes by the pieces of a model file."""

    def __init__(self, data: bytes):
        self.pieces, self.prefix = read_model(data)
        self.scores = [p[1] for p in self.pieces]
        words = {t.encode(): i for i, (t, _, k) in enumerate(self.pieces) if k in (NORMAL, USER) and t}
        normal = [s for _, s, k in self.pieces if k == NORMAL]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_COST
        self.bytes = {int(t[1:-1], 16): i for i, (t, _, k) in enumerate(self.pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.trie = DoubleArray(words)
        #: Without a piece that goes on over a mark, or that holds a line break, the best path must stop there.
        inner = any(MARK in t.lstrip(MARK) for t, _, k in self.pieces if k in (NORMAL, USER))
        breaks = "".join(c for c in "\n\t\r" if not any(c in t for t, _, k in self.pieces if k in (NORMAL, USER)))
        self.parts = None if inner else re.compile(f"[{breaks}]|{MARK}*[^{MARK}{breaks}]+|{MARK}+" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memory: dict[str, bytes] = {}  # a word's ids, four bytes each
        self.tables = [np.frombuffer(x, dtype=np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.score_of = np.array(self.scores, dtype=np.float64)
        self.written = pa.array([bytes([self.byte_of[i]]) if k == BYTE else t.replace(MARK, " ").encode() if k in (NORMAL, USER) else " ⁇ ".encode() if k == UNKNOWN else b"" for i, (t, _, k) in enumerate(self.pieces)], pa.large_binary())

    def best(self, part: str) -> tuple[int, ...]:
        """The ids of the best path through one part; of equal scores the earlier last cut wins. Linear in its length."""
        text = part.encode()
        n = len(text)
        score, back, piece = array("d", [float("-inf")]) * (n + 1), array("q", [0]) * (n + 1), array("q", [-1]) * (n + 1)
        score[0] = 0.0
        at, scores, prefixes = 0, self.scores, self.trie.prefixes
        while at < n:
            first = text[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            here, single = score[at], False
            for end, i in prefixes(text, at):
                single = single or end == at + width
                if (s := here + scores[i]) > score[end]:
                    score[end], back[end], piece[end] = s, at, i
            if not single and (s := here + self.unknown_score) > score[at + width]:
                score[at + width], back[at + width], piece[at + width] = s, at, -1
            at += width
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in reversed(text[back[at] : at])]
            else:
                out.append(self.unknown)
            at = back[at]
        return tuple(reversed(out))

    def best_of_many(self, parts: list[str]) -> list[bytes]:
        """best() of each part as int32 in a row, with all of them moving through the trie together."""
        raw = [p.encode() for p in parts]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list = [None] * len(parts)
        order = np.argsort(-lens, kind="stable")
        for low in range(0, len(order), 8192):
            rows = order[low : low + 8192]
            n = lens[rows]
            wide = int(n[0])
            grid = np.frombuffer(b"".join(raw[i].ljust(wide + 1, b"\0") for i in rows), dtype=np.uint8).reshape(len(rows), wide + 1).astype(np.int32)
            for i, path in zip(rows.tolist(), self._paths(grid, n)):
                out[i] = _packed(self.best(parts[i])) if path is None else path
        return out

    def _paths(self, grid: np.ndarray, n: np.ndarray) -> list[bytes | None]:
        """The best paths through rows of bytes, longest first; None where a path needs an unknown character."""
        base, check, value = self.tables
        many, wide = len(n), grid.shape[1] - 1
        score = np.full((many, wide + 5), -np.inf)
        back = np.zeros((many, wide + 5), dtype=np.int32)
        piece = np.full((many, wide + 5), -1, dtype=np.int32)
        score[:, 0] = 0
        for at in range(wide):
            live = int(np.searchsorted(-n, -at, side="left"))  # rows longer than `at`
            first = grid[:live, at]
            rows = np.flatnonzero((first & 0xC0) != 0x80)
            if not len(rows):
                continue
            first = first[rows]
            width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            single = np.zeros(live, dtype=bool)
            start_rows, start_width = rows, width
            state = np.zeros(len(rows), dtype=np.int32)
            end = at
            while len(rows) and end < wide:
                to = base[state] + grid[rows, end] + 1
                fits = (check[to] == state) & (n[rows] > end)
                rows, state, width = rows[fits], to[fits], width[fits]
                end += 1
                ids = value[state]
                whole = np.flatnonzero(ids >= 0)
                r = rows[whole]
                i = ids[whole]
                single[r[width[whole] == end - at]] = True
                s = score[r, at] + self.score_of[i]
                better = s > score[r, end]
                r = r[better]
                score[r, end], back[r, end], piece[r, end] = s[better], at, i[better]
            lone = ~single[start_rows]
            r, end = start_rows[lone], at + start_width[lone]
            s = score[r, at] + self.unknown_score
            better = s > score[r, end]
            r, end = r[better], end[better]
            score[r, end], back[r, end], piece[r, end] = s[better], at, -1
        steps, rows, at = [], np.arange(many), n.copy()
        odd = np.zeros(many, dtype=bool)
        while True:
            got = np.where(at > 0, piece[rows, at], -2)
            if (got == -2).all():
                break
            odd |= got == -1
            steps.append(got)
            at = np.where(at > 0, back[rows, at], 0)
        table = np.ascontiguousarray(np.array(steps[::-1], dtype=np.int32).reshape(len(steps), many).T)
        taken = table >= 0
        ids, ends = table[taken].tobytes(), (4 * np.cumsum(taken.sum(axis=1))).tolist()
        return [None if o else ids[a:z] for o, a, z in zip(odd.tolist(), [0, *ends], ends)]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """encode() of each text."""
        return [np.frombuffer(x, dtype=np.int32).tolist() for x in self.packed_many(texts)]

    def packed_many(self, texts: list[str]) -> list[bytes]:
        """encode() of each text, as int32 in a row; the words that are new are looked up together."""
        memory = self.memory
        if self.parts is None:
            return [_packed(self.encode(t)) for t in texts]
        if len(memory) >= REMEMBERED:
            memory.clear()
        split = [self.parts.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*split).difference(memory)
        short = [p for p in new if len(p) <= REMEMBERED_CHARS]
        memory.update(zip(short, self.best_of_many(short)))
        if len(short) == len(new):
            return [b"".join(map(memory.__getitem__, parts)) for parts in split]
        return [b"".join([memory[p] if p in memory else _packed(self.best(p)) for p in parts]) for parts in split]

    def encode(self, text: str) -> list[int]:
        """The ids of a text: spaces become marks, a mark stands before it if the model says so; an empty text has none."""
        if not text:
            return []
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        out: list[int] = []
        for part in self.parts.findall(marked) if self.parts else [marked]:
            out += self.best(part)
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces and the others' UTF-8 in a row, marks as spaces, without the prefix's mark."""
        return self.decode_many(np.array(ids, dtype=np.int32), [len(ids)])[0]

    def decode_many(self, flat: np.ndarray, counts: list[int] | np.ndarray) -> list[str]:
        """decode() of runs of `counts` ids each, which lie end to end in flat; the pieces' bytes are gathered at once."""
        gathered = self.written.take(pa.array(flat))
        _, offsets, raw = gathered.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(flat) + 1][np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].tolist() if len(flat) else [0] * (len(counts) + 1)
        view = memoryview(raw) if raw is not None else b""
        out = [str(view[a:z], "utf-8", "replace") for a, z in zip(ends, ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in out] if self.prefix else out


def _packed(ids) -> bytes:
    return array("i", ids).tobytes()


@lru_cache(maxsize=2)
def loaded(data: bytes) -> Unigram:
    return Unigram(data)


def model_bytes(path: str = MODEL) -> bytes:
    """A model file, half a megabyte, as the driver reads it; it goes to the executors with the function."""
    with open(path, "rb") as f:
        return f.read()


def _kept(df: DataFrame, keep: list[str], new: set[str]) -> list[str]:
    """keep without the names of new columns, which take their place."""
    return [c for c in keep if c not in new]


def encode(docs: DataFrame, data: bytes, keep: list[str] = ()) -> DataFrame:
    """Columns `keep`, and ids array<int>, n_ids and n_byte_ids; a kept column with one of these names gives way.

    A null text has null ids and counts 0; an empty one has no ids; repeated rows have a row each. Texts are encoded
    whole; the best path is found part by part, as no piece crosses a part's edge, so a very long text needs memory for
    its longest part only."""
    keep = _kept(docs, keep, {"ids", "n_ids", "n_byte_ids"})
    rows = docs.select(*[f"`{c}`" for c in keep], docs["text"].alias("_text"))
    fields = [f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    share = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(share.value)
        is_byte = np.zeros(len(model.pieces), dtype=np.int64)
        is_byte[list(model.byte_of)] = 1
        for big in batches:
            for low in range(0, big.num_rows, 256):
                b = big.slice(low, 256)
                texts = b.column(b.num_columns - 1).to_pylist()
                coded = model.packed_many([t or "" for t in texts])
                flat = np.frombuffer(b"".join(coded), dtype=np.int32)
                ends = np.concatenate(([0], np.cumsum([len(c) // 4 for c in coded], dtype=np.int64)))
                taken = np.concatenate(([0], np.cumsum(is_byte[flat])))
                n_bytes = np.diff(taken[ends])
                offsets = pa.array(ends.astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(np.diff(ends)), pa.array(n_bytes)], names=[*b.schema.names[:-1], "ids", "n_ids", "n_byte_ids"])

    return rows.mapInArrow(run, ", ".join([*fields, "ids array<int>", "n_ids bigint", "n_byte_ids bigint"]))


def decode(coded: DataFrame, data: bytes, keep: list[str] = ()) -> DataFrame:
    """Columns `keep`, and decoded: the text of column ids, marks as spaces, byte pieces joined to their characters; a
    kept column named decoded gives way.

    Null ids have a null text, no ids an empty one; ids that the model doesn't have count as unknown, null ids within a
    list as nothing; bytes that are no UTF-8 become U+FFFD. Control pieces have no text."""
    keep = _kept(coded, keep, {"decoded"})
    rows = coded.select(*[f"`{c}`" for c in keep], coded["ids"].alias("_ids"))
    fields = [f"`{coded.schema[c].name}` {coded.schema[c].dataType.simpleString()}" for c in keep]
    share = coded.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(share.value)
        n = len(model.pieces)
        for big in batches:
            for low in range(0, big.num_rows, 256):
                b = big.slice(low, 256)
                column = b.column(b.num_columns - 1)
                inner = column.flatten()
                counts = column.value_lengths().fill_null(0).to_numpy()
                if inner.null_count:
                    of = np.repeat(np.arange(len(column)), counts)[inner.is_valid().to_numpy(zero_copy_only=False)]
                    inner, counts = inner.drop_null(), np.bincount(of, minlength=len(column))
                flat = inner.to_numpy()
                decoded = model.decode_many(np.where((flat < 0) | (flat >= n), model.unknown, flat).astype(np.int32), counts)
                out = [t if v else None for t, v in zip(decoded, column.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], names=[*b.schema.names[:-1], "decoded"])

    return rows.mapInArrow(run, ", ".join([*fields, "decoded string"]))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    data = model_bytes()
    coded = encode(docs, data, ["doc_id", "text"])
    back = decode(coded, data, ["doc_id", "text", "ids", "n_ids", "n_byte_ids"])
    return back.select("doc_id", "ids", "n_ids", "n_byte_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
