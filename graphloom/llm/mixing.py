"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in a hashed order, are one stream of words cut into equal blocks. A
source needs so many block draws that its words come to its target. The draws of all sources lie
side by side on a line of N points; slot k of the schedule takes point k * A mod N, where A is
coprime to N and nearest above N over the golden ratio, so every point is met exactly once, in
golden-ratio order, and any stretch of the schedule has the sources near their weights. A slot's
rank among its source's slots names the block that it takes; after the last block the source
starts again. Only DataFrame functions are used.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; they share share * total
words; a target stops at cap times its source's size and the excess goes to the rest by weight.

Defined results: null or empty texts have size 0 and are taken 0 times; a source without words has
target 0; repeated rows stand side by side in the stream and count each; a very long text spans many
blocks; ties in the hashed order are broken by the key, then by a hash of the row; with no rows at
all, the result is empty; extra columns, whatever their names, are carried but don't change what is
taken.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.plans.session import cut

from .lines import WORD, host_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 64
#: Documents of a source are ordered by the MD5 of their key, within ranges of its first hexadecimal
#: digits; slots are ranked within ranges of SPAN. Neither number changes a result.
BUCKET_DIGITS = 4
SPAN = 65536
GOLDEN = 0.6180339887498949


def golden_step(n: int) -> int:
    """The least step from floor(n * GOLDEN) on, 1 at least, that is coprime to n."""
    a = max(1, int(n * GOLDEN))
    while gcd(a, n) != 1:
        a += 1
    return a


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """host, source_size, target, blocks, draws and first (the draws of the sources before it), per source.

    sized: source, host (its null-safe key), size. Works on one row per source.
    """
    per = sized.groupBy("source", "host").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    level = (share * F.col("total") - F.coalesce(F.sum("limit").over(fill), F.lit(0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(fill), F.lit(0)))
    per = per.withColumn("level", level).withColumn("top", F.max("level").over(everything))
    per = per.withColumn("target", F.least(F.col("limit").cast("double"), F.col("top") * F.col("weight")))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / block))
    per = per.withColumn("draws", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("host", "source_size", "target", "blocks", "draws", F.coalesce(F.sum("draws").over(before), F.lit(0)).alias("first"))


def schedule(per: DataFrame) -> DataFrame:
    """The mix: host, slot, turn (rank among its source's slots) and block, one row per slot."""
    spark = per.sparkSession
    n = per.agg(F.sum("draws")).first()[0] or 0  # one number
    if n == 0:
        return spark.createDataFrame([], "host string, slot long, turn long, block long")
    step = golden_step(n)
    back = pow(step, -1, n) if n > 1 else 0
    # Two steps of up to 4096 each, as a source's draws grow with the corpus.
    wide = F.explode(F.sequence(F.lit(0), ((F.col("draws") - 1) / (1 << 24)).cast("long")))
    starts = per.where("draws > 0").select("host", "blocks", "draws", "first", wide.alias("b")).repartition("host", "b")
    narrow = F.sequence(F.col("b") * 4096, F.least(F.col("b") * 4096 + 4095, ((F.col("draws") - 1) / 4096).cast("long")))
    starts = starts.select("host", "blocks", "draws", "first", F.explode(narrow).alias("c")).repartition("host", "c")
    lo = F.col("c") * 4096
    point = F.explode(F.sequence(lo, F.least(lo + 4095, F.col("draws") - 1)))
    points = starts.select("host", "blocks", "first", point.alias("o")).withColumn("p", F.col("first") + F.col("o"))
    if n <= 3_000_000_000:
        slot = (F.col("p") * F.lit(back)) % F.lit(n)
    else:
        slot = ((F.col("p").cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")) % F.lit(n).cast("decimal(19,0)")).cast("long")
    slots = points.select("host", "blocks", slot.alias("slot")).withColumn("span", F.floor(F.col("slot") / SPAN))
    counts = slots.groupBy("host", "span").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("host").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("host", "span", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("host", "span").orderBy("slot")
    ranked = slots.withColumn("r", F.row_number().over(within)).join(counts.hint("merge"), ["host", "span"])
    return ranked.select("host", "slot", (F.col("base") + F.col("r") - 1).alias("turn"), ((F.col("base") + F.col("r") - 1) % F.col("blocks")).alias("block"))


def _positions(sized: DataFrame) -> DataFrame:
    """sized with at: words of its source that stand before the row in the hashed order."""
    hashed = sized.withColumn("h", F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.left("h", F.lit(BUCKET_DIGITS)))
    sums = hashed.groupBy("host", "bucket").agg(F.sum("size").alias("m"))
    earlier = Window.partitionBy("host").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("host", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("host", "bucket").orderBy("h", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("r", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(sums.hint("merge"), ["host", "bucket"]).select("key", "row", "host", "source", "size", (F.col("base") + F.col("r")).alias("at"))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(docs: DataFrame, text: str, whole: bool) -> Column:
    """A hash of the text, or of all columns of a row."""
    if not whole:
        return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    # Maps can't be hashed, their JSON text can.
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes])


def _mixed(docs: DataFrame, key: str, text: str, source: str, whole: bool, weights, share: float, cap: int, block: int) -> DataFrame:
    """key, row (the row's hash), host, size, source_size, target, taken and at, one row per input row."""
    src = F.col(f"`{source}`").cast("string")
    sized = docs.select(F.col(f"`{key}`").alias("key"), _digest(docs, text, whole).alias("row"), src.alias("source"), host_key(src).alias("host"), size_of(F.col(f"`{text}`").cast("string")).alias("size"))
    sized = cut(sized)  # four short columns; the texts are read once
    per = cut(targets(sized, weights, share, cap, block))  # one row per source
    uses = schedule(per).groupBy("host", "block").agg(F.count("*").alias("uses"))
    placed = _positions(sized)
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    parts = placed.select("key", "row", "host", "size", "at", F.explode_outer(spans).alias("block"))
    lo, hi = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.withColumn("overlap", F.coalesce(hi - lo, F.lit(0)))
    # Sizes behind an explode are estimated far too low; the hints keep sides that grow from being broadcast.
    joined = parts.join(uses.hint("merge"), ["host", "block"], "left")
    # Rows without words share their place with others; what they take is 0 for each.
    taken = joined.where("size > 0").groupBy("host", "at").agg(F.first("key").alias("key"), F.first("row").alias("row"), F.first("size").alias("size"), F.sum(F.col("overlap") * F.coalesce(F.col("uses"), F.lit(0))).alias("taken"))
    none = placed.where("size = 0").select("host", "at", "key", "row", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).join(per.select("host", "source_size", "target"), "host")


def mix_report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """key, size, source_size, target, taken, host and at (the row's place in its source), one row per input row."""
    rows = _mixed(docs, key, text, source, False, weights, share, cap, block)
    return rows.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "host", "at")


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """The mixed documents, columns as in docs.

    A document that is taken q times in full and m words besides gives q rows with its text and,
    if m > 0, one with its first m words, joined by blanks; one that isn't taken gives none. A row is
    known by its key and a hash of all its columns, so rows that share a key, or have none, are each
    taken with their own text.
    """
    columns = docs.columns
    report = _mixed(docs, key, text, source, True, weights, share, cap, block).where("taken > 0")
    report = report.select("key", "row", F.floor(F.col("taken") / F.col("size")).alias("whole"), (F.col("taken") % F.col("size")).alias("rest"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(f"`{key}`").alias("key"), _digest(docs, text, True).alias("row"))
    # Rows equal in all columns stand once here and once each in the report.
    rows = rows.dropDuplicates(["key", "row"])
    joined = rows.alias("d").join(report.alias("r"), F.col("d.key").eqNullSafe(F.col("r.key")) & (F.col("d.row") == F.col("r.row"))).select("d.doc", "r.whole", "r.rest")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    given = F.col("doc")[text]
    part = F.array_join(F.slice(F.regexp_extract_all(given, F.lit(f"({WORD})")), F.lit(1), F.greatest(F.col("rest"), F.lit(1)).cast("int")), " ")
    copies = copies.withColumn("now", F.when(F.col("copy") <= F.col("whole"), given).otherwise(part))
    out = []
    for c in columns:
        if c == text:
            out.append(F.col("now").alias(c))
        elif c == "n_chars":
            out.append(F.length("now").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("doc")[c].alias(c))
    return copies.select(*out)
