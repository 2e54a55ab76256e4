"""Chat formatting: each assistant turn is an example of its own, the conversation up to it with only that reply trainable."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's own marks.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that texts may not hold as they are: the template's marks, and those of common chat models.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)
SCHEMA = "conv_id bigint, seq bigint, text string, loss_start bigint, loss_end bigint"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
#: Characters of examples that a task holds before it sends them on.
HELD_CHARS = 4_000_000


def escape(text: str) -> str:
    """text with each backslash doubled and a backslash after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """One row for each target turn: (conv_id, seq, text, loss_start, loss_end), where text is the formatted conversation
    up to that turn and only [loss_start, loss_end) of it, the reply's escaped text in code points, is trainable; all
    turns before it are its context. seq numbers a conversation's rows. Turns that no target follows come in one last
    row, the whole conversation without a span, so that no turn is lost.

    Turns go by turn, then role, then text (nulls first); null roles and texts count as empty; rows with a null conv_id
    form one conversation; repeated rows are turns of their own. A conversation is streamed from a sorted partition: a
    task holds its formatted string so far and HELD_CHARS of examples, however many turns there are. What is written is
    the sum of all prefixes, as the method has it."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _KINDS)], names=["conv_id", "seq", "text", "loss_start", "loss_end"])

        last, seq, prefix, rest = None, 0, "", []  # rest: segments since the last example
        begun = False
        for b in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or conv != last:
                    if rest:
                        out.append((last, seq, prefix + "".join(rest), None, None))
                        held += len(out[-1][2])
                    begun, last, seq, prefix, rest = True, conv, 0, "", []
                head = f"{TURN}{escape(role)}{TEXT}"
                rest.append(f"{head}{escape(text)}{END}")
                if role == target:
                    begin = len(prefix) + sum(map(len, rest[:-1])) + len(head)
                    prefix, rest = prefix + "".join(rest), []
                    out.append((conv, seq, prefix, begin, len(prefix) - len(END)))
                    seq += 1
                    held += len(prefix)
                if held > HELD_CHARS:
                    yield sent()
                    out, held = [], 0
        if rest:
            out.append((last, seq, prefix + "".join(rest), None, None))
        if out:
            yield sent()

    return dealt.mapInArrow(run, SCHEMA)


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the examples alone: the
    turns from a conversation's last row, the losses from the span of each. formatted_chars counts all rows' texts.

    made has to come from examples() as it is, or be dealt and sorted by conv_id and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held = None  # conv_id, the last text, characters and digest of the losses, characters of all texts

        def done(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        def facts():
            turns, digest = 0, hashlib.sha256()
            for m in _SEGMENT.finditer(held[1]):
                turns += 1
                digest.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            return held[0], turns, digest.hexdigest(), held[2], held[3].hexdigest(), held[4]

        for b in batches:
            rows = []
            for conv, text, low, high in zip(*(b.column(n).to_pylist() for n in ("conv_id", "text", "loss_start", "loss_end"))):
                if held is None or conv != held[0]:
                    if held:
                        rows.append(facts())
                    held = [conv, "", 0, hashlib.sha256(), 0]
                held[1] = text
                if low is not None:
                    reply = unescape(text[low:high])
                    held[2] += len(reply)
                    held[3].update(reply.encode())
                held[4] += len(text)
            yield done(rows)
        if held:
            yield done([facts()])

    return made.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of conversation -1, whose turns say the control strings themselves."""
    own = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return read_back(examples(rows.unionByName(own)))


OP10_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l as (select *, length('<|turn|><|text|><|end|>') + length(role) + length(text)
    + len(regexp_extract_all(text, '\\\\|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|<\\|(?:turn|text|end|im_start|im_end|endoftext)\\|>')) as n from c),
p as (select *, sum(n) over w as upto, row_number() over w = count(*) over (partition by conv_id) as final from l
  window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (role = 'assistant' or final)::bigint as formatted_chars
from p group by conv_id
"""
