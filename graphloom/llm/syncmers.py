"""Document fingerprints from closed syncmers of words.

A k-mer of K words is an anchor if the smallest of its inner runs of S words, by hash, lies at its
start or end. Whether a k-mer is an anchor depends on its own words only, so an edit changes the
anchors that it touches and no others. The anchors' hashes fall into SLOTS slots by their top
bits; the fingerprint keeps each slot's smallest hash with the place where it first stands, 40 bits
of hash and 24 of place. Two fingerprints are alike in the slots that hold the same anchor at
places whose offset is that of most shared anchors (their median, give or take DRIFT words), as a
share of the slots that either fills.

Defined results: null counts as empty; a text of 1 to K - 1 words has one anchor, all its words;
a text without words has an empty fingerprint, and two empty fingerprints have likeness 1; equal
texts have equal fingerprints; only words count, so texts that differ in separators are alike.
Successors go by ascending key, null keys last, equal keys by text (those of a heavy key, and rows
without one, by a hash of the text first); repeated rows follow each other; a single row is its own
successor. In a very long text, anchors beyond word 2^24 all have that place. An empty table gives an
empty result; extra columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

K, S = 4, 2
SLOTS = 64
PLACE_BITS = 24
DRIFT = 16


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array of packed anchors, at most one per slot, ascending."""
    w, m = f"_{out}_w", f"_{out}_m"
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)))
    n = F.size(w)
    # Hashes of the inner runs; place i holds words i and i + 1.
    runs = F.transform(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    df = df.withColumn(m, F.when(n >= K, runs).otherwise(F.array().cast("array<bigint>")))
    inner = F.slice(m, F.lit(1), F.greatest(F.size(m) - 2, F.lit(0)))
    mask = (1 << PLACE_BITS) - 1

    def packed(h: Column, i: Column) -> Column:
        return h.bitwiseAND(F.lit(~mask)).bitwiseOR(F.least(i, F.lit(mask)).cast("bigint"))

    def anchor(x: Column, i: Column) -> Column:
        mid, last = F.get(m, i + 1), F.get(m, i + 2)
        return F.when(~((mid < x) & (mid < last)), packed(F.xxhash64(x, last), i))

    short = F.when(n > 0, F.array(packed(F.xxhash64(F.concat_ws(",", F.transform(w, lambda x: x.cast("string")))), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    anchors = F.when(n >= K, F.sort_array(F.array_compact(F.transform(inner, anchor)))).otherwise(short)
    df = df.withColumn(out, anchors).drop(w, m)
    slot = lambda x: F.shiftrightunsigned(x, 64 - SLOTS.bit_length() + 1)
    first = F.filter(out, lambda x, i: (i == 0) | (slot(F.get(out, F.greatest(i - 1, F.lit(0)))) != slot(x)))
    return df.withColumn(out, first)


def text_form(fingerprint: Column) -> Column:
    """Sixteen hexadecimal digits per anchor."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with out: the likeness of two fingerprint columns, 0 to 1; null where either is null."""
    mask = (1 << PLACE_BITS) - 1
    s = f"_{out}_s"
    place = lambda x: x.bitwiseAND(F.lit(mask))
    anchor = lambda x: x.bitwiseAND(F.lit(~mask))
    slot = lambda x: F.shiftrightunsigned(x, 64 - SLOTS.bit_length() + 1)
    by_anchor = lambda c: F.map_from_arrays(F.transform(c, anchor), F.transform(c, place))
    # Offsets of the shared anchors, ascending.
    df = df.withColumn(f"{s}m", by_anchor(F.col(b)))
    shared = F.filter(F.col(a), lambda x: F.map_contains_key(F.col(f"{s}m"), anchor(x)))
    df = df.withColumn(s, F.sort_array(F.transform(shared, lambda x: F.try_element_at(F.col(f"{s}m"), anchor(x)) - place(x))))
    middle = F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
    matched = F.size(F.filter(s, lambda x: F.abs(x - middle) <= DRIFT))
    filled = F.size(F.array_union(F.transform(F.col(a), slot), F.transform(F.col(b), slot)))
    value = F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(None).cast("double")).when(filled == 0, F.lit(1.0)).otherwise(matched / filled)
    return df.withColumn(out, value.cast("double")).drop(s, f"{s}m")


#: Parts that the rows of a heavy key, or those without one, are spread over.
SALTS = 64


def _bounds(keys: DataFrame, parts: int) -> tuple[list[int], list[int]]:
    """Ascending cut points of about equal shares of the keys, one number per part; and those keys that fill whole shares."""
    found = keys.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    found = found or []
    return sorted(set(found)), sorted(k for k, n in Counter(found).items() if n > 1)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """Number of cut points at or below key, by two short searches; null keys go last."""
    if not bounds:
        return F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("bigint") for g in groups])
    table = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in g]) for g in groups])
    coarse = F.size(F.filter(heads, lambda b: b <= key))
    fine = F.size(F.filter(F.get(table, F.greatest(coarse - 1, F.lit(0))), lambda b: b <= key))
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(F.greatest(coarse - 1, F.lit(0)) * step + fine)


def with_successor(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """key, text, fp of every row, with next_text and next_fp of the row that follows it.

    Rows are split into ranges of the key, and each range also gets the next range's first row, so
    no range holds more than its share. Rows of one heavy key, and those without a key, follow each
    other by a hash of the text, then by the text, and so are spread over SALTS parts.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, heavy = _bounds(docs.select("key"), parts)
    # A heavy key is its range's first one, so its salted parts come before the range's rest.
    spread = F.col("key").isNull() | F.coalesce(F.col("key").isin(heavy), F.lit(False)) if heavy else F.col("key").isNull()
    salt = F.when(spread, F.pmod(F.xxhash64("text"), F.lit(SALTS))).otherwise(SALTS)
    rows = docs.withColumn("part", (_bucket(F.col("key"), bounds) * (SALTS + 1) + salt).cast("int"))
    heads = rows.groupBy("part").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text")).alias("head"))
    heads = heads.select("part", "head.key", "head.text")
    order = Window.orderBy("part")  # one row per range
    count = F.max("part").over(Window.partitionBy())
    before = F.coalesce(F.lag("part").over(order), count)
    halo = heads.select(before.alias("part"), "key", "text")
    halo = with_fingerprint(halo, "text", "fp").withColumn("halo", F.lit(1))
    full = rows.withColumn("halo", F.lit(0)).unionByName(halo)
    w = Window.partitionBy("part").orderBy("halo", F.col("key").asc_nulls_last(), "text")
    full = full.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)})
    return full.where("halo = 0").drop("halo", "part")


def fingerprint_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last quarter of its characters replaced by as many from the start of
    the next text (or all of it).
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_successor(with_fingerprint(rows, "text", "fp"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.left("next_text", quarter))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fp")
    rows = with_likeness(with_likeness(rows, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return rows.select(
        F.col("key").alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("fp")).alias("fingerprint"), text_form(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
