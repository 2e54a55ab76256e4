"""Benchmark decontamination by template windows with typed slots, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, words of it that are no slots for a match by template, words of an item that a document must hold
#: to be a leak, and words of an item that can be told from chance at all.
WINDOW, PLAIN, LEAST_WORDS, LEAST_ITEM = 8, 4, 13, 5
#: The words taken as units.
UNITS = "km cm mm kg mg ml lb oz ft mi mph kmh hz khz mhz ghz kb mb gb tb hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres mile miles gram grams liter liters litre litres pound pounds dollar dollars euro euros cent cents percent degrees".split()
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: The filter's words in the plan at most, and benchmark windows that are broadcast at most.
LITERAL_WORDS, BROADCAST_WINDOWS = 1 << 15, 200_000
_TOKENS = r"[0-9][0-9.,:/]*|\p{L}+"


def raw_tokens(text: Column) -> Column:
    """Numbers and runs of letters, as they stand; of a null text, none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKENS), F.lit(0))


def template(tokens: Column) -> Column:
    """Tokens with typed placeholders for numbers, units and names (a capital and small letters), else in lower case."""

    def one(t):
        low = F.lower(t)
        tail = F.substring(t, 2, 1 << 30)
        return F.when((t >= "0") & (t < ":"), NUMBER).when(low.isin(UNITS), UNIT).when((low != t) & (F.lower(tail) == tail), NAME).otherwise(low)

    return F.transform(tokens, one)


def fold(token: Column) -> Column:
    """A token whatever its case; sharp s counts as the two letters that upper case has for it."""
    return F.replace(F.lower(token), F.lit("ß"), F.lit("ss"))


def caseless_template(tokens: Column) -> Column:
    """Tokens with typed placeholders for numbers and units, else folded: without names, which only case tells."""
    return F.transform(tokens, lambda t: F.when((t >= "0") & (t < ":"), NUMBER).when(F.lower(t).isin(UNITS), UNIT).otherwise(fold(t)))


def _starts(n: Column, window: int | Column) -> Column:
    return F.when(n >= window, F.sequence(F.lit(1), n - window + 1)).otherwise(F.array().cast("array<int>"))


def _is_slot(t: Column) -> Column:
    return t.startswith("<")


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once a row; a plain column might be worked out again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(raw: Column, t: Column, window: Column, body) -> Column:
    """body(place, words, raw words) of every window."""
    return F.transform(_starts(F.size(raw), window), lambda i: body(i, F.slice(t, i, window), F.slice(raw, i, window)))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, item_id, place, words, slots, size, strict): every window of the items' templates, with names and without.

    A strict window has too few plain words, or is a whole item of less than `window` words: it is met only by the very
    same words, whatever their case. Items of less than LEAST_ITEM words and null items have no windows."""
    n = F.size("raw")
    rows = items.select("item_id", raw_tokens(F.col("text")).alias("raw")).where(n >= LEAST_ITEM).withColumn("width", F.least(F.lit(window), n))
    one = lambda i, w, r: F.struct(i.alias("place"), w.alias("words"), r.alias("slots"))
    found = F.array_distinct(F.concat(*[_let(f(F.col("raw")), lambda t: _cut(F.col("raw"), t, F.col("width"), one)) for f in (template, caseless_template)]))
    rows = rows.select("item_id", n.alias("size"), F.explode(found).alias("x")).select("item_id", "size", "x.*")
    strict = (F.size("words") < window) | (F.size(F.filter("words", lambda w: ~_is_slot(w))) < PLAIN)
    return rows.select(F.xxhash64("words").alias("h"), "item_id", "place", "words", "slots", "size", strict.alias("strict"))


def _filter_words(windows: DataFrame, count: int) -> list[int]:
    """A Bloom filter of the windows' hashes as 64-bit words, 64 bits a hash up to the bound of LITERAL_WORDS."""
    size = min(LITERAL_WORDS, 1 << max(4, math.ceil(math.log2(max(1, count)))))
    h = F.col("h")
    bits = windows.select(F.explode(F.array(*[F.struct(_word(h, k, size).alias("w"), _bit(h, k).alias("b")) for k in range(3)])).alias("x"))
    rows = bits.groupBy("x.w").agg(F.expr("bit_or(x.b)").alias("b")).collect()  # LITERAL_WORDS rows at most
    out = [0] * size
    for r in rows:
        out[r["w"]] = r["b"]
    return out


def _word(h: Column, k: int, size: int) -> Column:
    return F.shiftright(h, 20 * k).bitwiseAND(F.lit(size - 1)).cast("int")


def _bit(h: Column, k: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 58 - 5 * k).bitwiseAND(F.lit(63)).cast("int"))


def _agreeing(met: DataFrame, window: int, least_words: int) -> DataFrame:
    """The leaks among windows met: passages with enough words that agree, where a slot is taken by itself.

    An item's value agrees with itself and with the other value that stands for it most often in the passage (its own
    goes first, then the smallest, where two are as frequent). Slots with any other value don't count as words, the rest
    of their windows does; two values of an item may have the same value in a document."""
    passages = met.groupBy("doc_id", "item_id", "shift").agg(
        F.first("size").alias("size"), F.collect_set("place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"])
    values = F.array_distinct(F.transform("pairs", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    passages = passages.withColumn("v", values)
    counted = F.transform("v", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.size(F.filter("pairs", lambda p: same(p, x))).alias("n")))
    goes_first = lambda y, x: (y["n"] > x["n"]) | ((y["n"] == x["n"]) & ((y["a"] == y["b"]) | (y["b"] < x["b"])))
    beaten = lambda v: F.filter(v, lambda x: (x["a"] != x["b"]) & F.exists(v, lambda y: (y["a"] == x["a"]) & (y["b"] != x["b"]) & goes_first(y, x)))
    several = F.size("v") != F.size(F.array_distinct(F.transform("v", lambda x: x["a"])))
    wrong = F.when(several, _let(counted, beaten)).otherwise(F.array().cast("array<struct<a:string,b:string,n:int>>"))
    passages = passages.withColumn("wrong", wrong)
    n_wrong = F.size(F.filter("pairs", lambda p: F.exists("wrong", lambda x: same(p, x))))
    n_covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda i: F.sequence(i, F.least(i + window - 1, F.col("size")))))))
    passages = passages.withColumn("n_words", n_covered - n_wrong).where(F.col("n_words") >= F.least(F.lit(least_words), F.col("size")))
    count = lambda x: F.size(x).cast("bigint")
    rows = passages.select("doc_id", "item_id", "n_words", count("places").alias("n_windows"), count("pairs").alias("n_slots"), count(F.filter("pairs", lambda p: p["a"] != p["b"])).alias("n_changed"))
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_words", -F.col("n_changed"), "n_slots", "n_changed")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_windows", "x.n_slots", "x.n_changed")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_slots, n_changed): the benchmark items that documents hold, copied or with other
    numbers, names or units, in whatever case.

    Numbers, names and units become typed slots; windows of `window` template words, with names as slots and without,
    are looked up in the items' by a Bloom filter, then a hash join, then word by word. Windows with few plain words, and
    whole items shorter than a window (LEAST_ITEM words at least), are met by the very same words only. The windows of
    one document and item with one shift between their places are a passage; its slots must agree, and one that doesn't
    is only itself no word of the passage (_agreeing). A passage counts if its windows cover least_words words of the
    item (or the whole item, if that is shorter). n_changed counts the slots whose value is another; of an item's
    passages in a document the one with the most windows counts.

    Texts are read whole, and only documents with windows that the filter passes go on. Null and empty texts hold
    nothing; documents with the same doc_id count as one."""
    listed = benchmark_windows(items, window).persist()
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.size("words")).alias("widths")).first()
    count = facts["n"]
    if not count:
        listed.unpersist()
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_windows bigint, n_slots bigint, n_changed bigint")
    words = _filter_words(listed, count)
    listed.unpersist()
    size = len(words)
    table = F.from_json(F.lit(str(words)), "array<bigint>")  # one literal

    def maybe(h, bits):
        out = F.lit(True)
        for k in range(3):
            out = out & (F.element_at(bits, _word(h, k, size) + 1).bitwiseAND(_bit(h, k)) != 0)
        return out

    def hits(raw, t, width, bits):
        """The windows that the filter passes."""
        hashed = _cut(raw, t, F.lit(width), lambda i, w, r: F.struct(i.alias("at"), F.xxhash64(w).alias("h")))
        return F.transform(F.filter(hashed, lambda x: maybe(x["h"], bits)), lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), F.slice(t, x["at"], width).alias("t"), F.slice(raw, x["at"], width).alias("raw")))

    def looking(raw, width, bits):
        return lambda t: hits(raw, t, width, bits)

    looked = [(f, w) for w in sorted(facts["widths"]) for f in ((template, caseless_template) if w == window else (caseless_template,))]
    at_all = lambda bits: lambda raw: F.array_distinct(F.concat(*[_let(f(raw), looking(raw, w, bits)) for f, w in looked]))
    found = _let(table, lambda bits: _let(raw_tokens(F.col("text")), at_all(bits)))  # the literal stands in the plan once: the driver writes the plan out again and again
    rows = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.h", "x.at", "x.t", "x.raw")
    own = benchmark_windows(items, window)
    met = rows.join(F.broadcast(own) if count <= BROADCAST_WINDOWS else own, "h").where(F.col("t") == F.col("words"))
    met = met.where(~F.col("strict") | (F.transform("raw", fold) == F.transform("slots", fold)))
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: _is_slot(F.element_at("t", i)))
    pairs = F.transform(places, lambda i: F.struct((F.col("place") + i).alias("p"), fold(F.element_at("slots", i)).alias("a"), fold(F.element_at("raw", i)).alias("b")))
    met = met.select("doc_id", "item_id", "size", (F.col("at") - F.col("place")).alias("shift"), "place", pairs.alias("pairs"))
    return _agreeing(met, window, least_words)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null doc_id stay."""
    return docs.join(find_leaks(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """The leaks of all benchmark items in all documents: one row for each document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UNIT_SQL = ", ".join(f"'{u}'" for u in UNITS)
_SLOT_SQL = f"when t >= '0' and t < ':' then '<num>' when lower(t) in ({_UNIT_SQL}) then '<unit>'"
_TEMPLATES_SQL = f"""list_transform(raw, lambda t: case {_SLOT_SQL} when lower(t) <> t and lower(t[2:]) = t[2:] then '<name>' else lower(t) end) as t0,
  list_transform(raw, lambda t: case {_SLOT_SQL} else replace(lower(t), 'ß', 'ss') end) as t1, list_transform(raw, lambda t: replace(lower(t), 'ß', 'ss')) as f"""
_RAW_SQL = "regexp_extract_all(coalesce(text, ''), '[0-9][0-9.,:/]*|\\p{L}+') as raw"
OP8_SQL = f"""
with b0 as (select item_id, {_RAW_SQL} from benchmark),
b1 as (select item_id, len(raw) as size, least(8, len(raw)) as w, {_TEMPLATES_SQL} from b0 where len(raw) >= 5),
b2 as (select item_id, size, w, t0 as t, f from b1 where w = 8 union all select item_id, size, w, t1, f from b1),
b3 as (select distinct item_id, size, w, i as place, t[i:i+w-1] as words, f[i:i+w-1] as slots from b2, unnest(range(1, size - w + 2)) u(i)),
b as (select *, w < 8 or len(list_filter(words, lambda x: not starts_with(x, '<'))) < 4 as strict from b3),
d0 as (select doc_id, {_RAW_SQL} from documents),
d1 as (select doc_id, {_TEMPLATES_SQL} from d0),
d2 as (select doc_id, t0 as t, f from d1 union all select doc_id, t1, f from d1),
d as (select distinct doc_id, i as pos, t[i:i+w-1] as words, f[i:i+w-1] as raw from d2, (select distinct w from b) ws, unnest(range(1, len(t) - w + 2)) u(i)),
m as (select doc_id, item_id, size, w, pos - place as shift, place, slots, raw, words from d join b using (words) where not strict or slots = raw),
p as (select distinct doc_id, item_id, shift, place + k as p, slots[k] as a, raw[k] as b from m, unnest(range(1, w + 1)) u(k) where starts_with(words[k], '<')),
v0 as (select doc_id, item_id, shift, a, b, count(*) as n from p group by all),
v as (select *, row_number() over (partition by doc_id, item_id, shift, a order by n desc, a = b desc, b) as k from v0),
c as (select doc_id, item_id, shift, count(*) as n_slots, count(*) filter (a <> b) as n_changed, count(*) filter (a <> b and k > 1) as n_wrong
  from p join v using (doc_id, item_id, shift, a, b) group by all),
o as (select doc_id, item_id, shift, any_value(size) as size, count(distinct place) as n_windows, count(distinct place + k) as n_covered from m, unnest(range(w)) u(k) group by all),
x as (select o.*, coalesce(n_slots, 0) as n_slots, coalesce(n_changed, 0) as n_changed, n_covered - coalesce(n_wrong, 0) as n_words from o left join c using (doc_id, item_id, shift)),
y as (select *, row_number() over (partition by doc_id, item_id order by n_windows desc, n_words desc, n_changed, n_slots desc) as k from x where n_words >= least(13, size))
select doc_id, item_id, n_windows, n_slots, n_changed from y where k = 1
"""
