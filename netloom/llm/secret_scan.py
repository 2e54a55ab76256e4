"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: What the models judge: a whole run of these characters, of TOKEN_LEAST or more; shorter ones can't reach LEAST_RATIO.
TOKEN_LEAST = 12
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LEAST)
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A token is a secret from this log-likelihood ratio on: the odds against a random token are taken as e ** 20.
LEAST_RATIO = 20.0


def _codes(token: str) -> np.ndarray:
    table = np.zeros(128, dtype=np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return np.concatenate(([0], table[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8) & 127]))


def fit_markov(samples: Iterable[tuple[str, int]], ordinary: np.ndarray | None = None) -> np.ndarray:
    """log P(next | last, random) - log P(next | last, ordinary) from labelled strings (1: random), with add-one smoothing.

    `ordinary` are bigrams of more ordinary strings. Row and column 0 stand for the start and for characters outside the alphabet. Classes without samples are uniform."""
    size = len(ALPHABET) + 1
    counts = np.ones((2, size, size))
    texts: tuple[list[str], list[str]] = ([], [])
    for text, label in samples:
        texts[int(label)].append(text)
    for own, count in zip(texts, counts):
        count[:, 1:] += _bigrams(own).reshape(size, size)[:, 1:]
    if ordinary is not None:
        counts[0, :, 1:] += ordinary[:, 1:]
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def ratio(model: np.ndarray, token: str) -> float:
    """The log-likelihood ratio of a token: above 0 if it is likelier random."""
    c = _codes(token)
    return float(model[c[:-1], c[1:]].sum())


def random_strings(n: int = 4000, seed: int = 17) -> list[str]:
    """Labelled samples of the random class: hexadecimal, base-64, base-62 and upper-case keys of 16 to 64 characters."""
    rng = random.Random(seed)
    kinds = ("0123456789abcdef", ALPHABET[:64], ALPHABET[:62], ALPHABET[:26] + "0123456789")
    return ["".join(rng.choices(kinds[i % 4], k=rng.randint(16, 64))) for i in range(n)]


def identifiers(texts: Iterable[str | None], seed: int = 23) -> list[str]:
    """Labelled samples of the ordinary class: the words of texts, alone, in capitals, and joined as identifiers, paths and
    numbers are."""
    rng = random.Random(seed)
    out = []
    for text in texts:
        words = re.findall(r"[A-Za-z]{2,}", text or "")
        out += words
        for i in range(0, len(words) - 3, 4):
            four = words[i : i + 4]
            out.append(rng.choice(("_", "-", "/", "")).join(four[: rng.randint(2, 4)]) + rng.choice(("", "", str(rng.randint(0, 9999)))))
            out.append("".join(w.capitalize() for w in four[: rng.randint(2, 4)]))
            out.append(rng.choice(("_", " ")).join(four).upper())
    return out


def _bigrams(strings: list[str]) -> np.ndarray:
    size = len(ALPHABET) + 1
    c = _codes(" ".join(strings))
    return np.bincount(c[:-1] * size + c[1:], minlength=size * size)


def ordinary_bigrams(docs: DataFrame) -> np.ndarray:
    """Bigrams of the identifiers of all whole texts, summed on the executors; a text gives the same ones wherever it lies."""
    size = len(ALPHABET) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += _bigrams(identifiers([TOKEN.sub(" ", ASSIGN.sub(" ", x.as_py()))]))
        cells = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    out = np.zeros(size * size, dtype=np.int64)
    counted = docs.where("text is not null").select("text").mapInArrow(run, "cell bigint, n bigint")
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 68 * 68 rows at most
        out[r["cell"]] = r["n"]
    return out.reshape(size, size)


def fit_on(docs: DataFrame) -> np.ndarray:
    """The model of the labelled random strings against the identifiers of all docs."""
    return fit_markov([(s, 1) for s in random_strings()], ordinary_bigrams(docs))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; a span is the whole match."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "apikey" in low or "api_key" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def all_spans(text: str, model: np.ndarray, least: float = LEAST_RATIO) -> list[tuple[int, int, int]]:
    """base_spans(), and the tokens outside them that the models call random."""
    base = base_spans(text)
    added, at, reach = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and ratio(model, m[0]) >= least:
            added.append((m.start(), 3, m.end()))
    return sorted(base + added) if added else base


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, model: np.ndarray, keep: list[str] = (), least: float = LEAST_RATIO) -> DataFrame:
    """Columns `keep`, and secrets: array of (kind, start, end) in code points (end exclusive) by start, then kind. A kept
    column named secrets gives way.

    A null text counts as empty; an empty one has no spans. Texts are read whole, one after the other. Every row gives
    one row, repeated ones too."""
    keep = [c for c in keep if c != "secrets"]
    kept = [f"`{c}`" for c in keep]
    fields = [docs.schema[c] for c in keep]
    rows = docs.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["secrets array<struct<kind:string,start:bigint,end:bigint>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t.as_py() or "", model, least)] for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*b.schema.names[:-1], "secrets"])

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, model: np.ndarray, mark: str = "[SECRET]", least: float = LEAST_RATIO) -> DataFrame:
    """docs with every span of its text (spans that touch or overlap are one) replaced by `mark`, and n_chars set anew.

    A null text stays null and keeps its n_chars; every row stays, repeated ones too."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(names.index("text")):
                t = x.as_py()
                spans = all_spans(t, model, least) if t else []
                if spans:
                    parts, at = [], 0
                    for s, _, e in spans:
                        if s > at or not parts:
                            parts += [t[at:s], mark]
                        at = max(at, e)
                    t = "".join([*parts, t[at:]])
                out.append(t)
            columns = list(b.columns)
            i = names.index("text")
            columns[i] = pa.array(out, columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in names else out


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The spans of all documents and their digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, fit_on(docs), ["doc_id"])
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("secrets", line), ",").alias("spans"))


def brute_digest(text: str | None) -> str:
    """base_sha256 by a plain reading of the patterns, for tests."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return hashlib.sha256(joined(sorted(spans)).encode()).hexdigest()
