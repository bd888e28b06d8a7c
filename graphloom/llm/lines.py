"""Cross-document line statistics: quality rules, and line dedup by site-relative frequency.

Both operators see a document as lines split at line feeds. A line is normalised by lower-casing
it, turning each run of separators into one blank and trimming it; lines without a word are never
counted nor removed. Documents with the same text at the same host count once, so that exact
copies of a page don't make its lines look like boilerplate. Only DataFrame functions are used.

Defined results: null text has no lines and stays null; an empty text stays empty; a very long text is
one row of line hashes; a null host is a host of its own; repeated rows get the same verdict; ties
can't occur, as limits are compared with counts only; an empty table gives an empty result; columns
other than the named ones, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, words

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def host_key(host: Column) -> Column:
    """A key that equals itself for null hosts, too."""
    return F.coalesce(F.concat(F.lit("s"), host.cast("string")), F.lit("n"))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SEPARATORS, " ")))


def line_key(line: Column) -> Column:
    """Hash of the normalised line; null for lines without a word."""
    plain = normalised(line)
    return F.when(plain != "", F.xxhash64(plain))


def _texts(docs: DataFrame, text: str, host: str) -> DataFrame:
    """host, text key and line keys with their word counts, once per distinct text of a host."""
    lines = F.transform(split_lines(F.col(text)), lambda x: F.struct(line_key(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    return docs.select(host_key(F.col(host)).alias("host"), F.xxhash64(F.col(text)).alias("txt"), lines.alias("lines")).dropDuplicates(["host", "txt"])


def _occurrences(texts: DataFrame) -> DataFrame:
    """One row per host, text and line: its occurrences and their words. Needs no further shuffle."""
    return (
        texts.select("host", "txt", F.explode("lines").alias("l"))
        .where("l.line is not null")
        .groupBy("host", "txt", F.col("l.line").alias("line"))
        .agg(F.count("*").alias("times"), F.sum("l.n").alias("words"))
    )


SALTS = 64


def frequent_lines(texts: DataFrame, min_documents: int, share: float) -> DataFrame:
    """host and line of the lines in more than min_documents texts and more than share of a host's."""
    counts = _occurrences(texts).groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > min_documents)
    if not share:
        return counts.select("host", "line")
    # A host's total goes to SALTS places, so its lines needn't meet in one task.
    totals = texts.groupBy("host").agg(F.count("*").alias("total")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counts = counts.withColumn("salt", F.pmod("line", F.lit(SALTS)).cast("int"))
    return counts.join(totals, ["host", "salt"]).where(F.col("documents") > share * F.col("total")).select("host", "line")


def _removals(docs: DataFrame, text: str, host: str, min_documents: int, share: float) -> DataFrame:
    """host, txt, removed line keys, and the lines and words that go with them; texts that lose none are absent."""
    texts = _texts(docs, text, host)
    hits = _occurrences(texts).join(frequent_lines(texts, min_documents, share), ["host", "line"])
    return hits.groupBy("host", "txt").agg(F.collect_set("line").alias("gone"), F.sum("times").alias("gone_lines"), F.sum("words").alias("gone_words"))


def _without(text: Column, gone: Column) -> Column:
    kept = F.filter(split_lines(text), lambda x: ~F.coalesce(F.array_contains(gone, line_key(x)), F.lit(False)))
    return F.when(gone.isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))


# ---------------------------------------------------------------- quality rules

MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A line goes if more than so many documents of its host have it; at any share, as a share would
#: raise the limit with the host. Depletion below keeps this from gutting documents.
LIMIT_DOCUMENTS = 10
LIMIT_SHARE = 0.0
#: A document is depleted if less than this share of its words, or fewer than MIN_WORDS, are left.
MIN_LEFT = 0.5


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Windows of five words are compared by a 64-bit hash; only documents in which two windows agree
    take the detour over sorted positions.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(F.col(text)))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    n = F.size("_h")
    window = lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2), F.get("_h", i + 3), F.get("_h", i + 4))
    d = d.withColumn("_v", F.when(n >= 5, F.transform(F.slice("_h", F.lit(1), F.greatest(n - 4, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    at = F.transform("_v", lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_v")) < F.size("_v"), F.array_sort(at)))
    same = lambda e, j: F.coalesce(F.get("_s", j)["v"] == e["v"], F.lit(False))
    twice = F.filter("_s", lambda e, k: ((k > 0) & same(e, F.greatest(k - 1, F.lit(0)))) | same(e, k + 1))
    starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"), (i + 5).alias("end")), lambda a: a["n"])
    lines = F.filter(split_lines(F.col(text)), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_l", lines)
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_w", "_h", "_v", "_s", "_l")
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _verdict(n_words: Column, gone_words: Column) -> Column:
    left = n_words - gone_words
    return (left >= MIN_WORDS) & (left >= MIN_LEFT * n_words)


def quality_report(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_documents: int = LIMIT_DOCUMENTS, share: float = LIMIT_SHARE) -> DataFrame:
    """Features and verdict of every row: key, the features, base_failed, kept, n_removed_lines, n_left_words."""
    docs = docs.select(F.col(key), F.col(text).cast("string").alias("text"), F.col(host).alias("source"))
    base = with_features(docs).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", host_key(F.col("source")).alias("host"), F.xxhash64("text").alias("txt"))
    gone = _removals(docs, "text", "source", min_documents, share).drop("gone")
    full = base.join(gone, ["host", "txt"], "left")
    lost = F.coalesce(F.col("gone_words"), F.lit(0))
    return full.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & _verdict(F.col("n_words"), lost)).alias("kept"),
        F.coalesce(F.col("gone_lines"), F.lit(0)).alias("n_removed_lines"),
        (F.col("n_words") - lost).alias("n_left_words"),
    )


def apply_quality(docs: DataFrame, text: str = "text", host: str = "source", min_documents: int = LIMIT_DOCUMENTS, share: float = LIMIT_SHARE) -> DataFrame:
    """The rows that pass, without their lines above the limits; columns as in docs."""
    columns = docs.columns
    gone = _removals(docs, text, host, min_documents, share).drop("gone_lines").withColumnsRenamed({"host": "_host", "txt": "_txt"})
    base = with_features(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("_src")))
    # The row number keeps the optimiser from evaluating the features again inside the filter.
    base = base.withColumn("_number", F.monotonically_increasing_id()).where("not base_failed and _number >= 0").select("_row", "n_words", host_key(F.col("_src")).alias("_host"), F.xxhash64("text").alias("_txt"))
    kept = base.join(gone, ["_host", "_txt"], "left").where(_verdict(F.col("n_words"), F.coalesce(F.col("gone_words"), F.lit(0))))
    return _rewritten(kept, columns, text)


def _rewritten(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of _row, the text without the lines in gone; n_chars follows where there is one."""
    clean = _without(F.col("_row")[text], F.col("gone"))
    rows = rows.withColumn("_clean", clean)
    out = []
    for c in columns:
        if c == text:
            out.append(F.col("_clean").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("gone").isNull(), F.col("_row")[c]).otherwise(F.length("_clean").cast(rows.schema["_row"].dataType[c].dataType)).alias(c))
        else:
            out.append(F.col("_row")[c].alias(c))
    return rows.select(*out)


# ---------------------------------------------------------------- line dedup

#: Lines in more than this share of a host's pages, and in more than RATIO_MIN_PAGES, are boilerplate.
#: On hosts of 8,000 to 89,000 pages (check_l) license lines stand in 0.6 to 1.1 % of the pages, the
#: most frequent lines in 11 to 13 %.
BOILERPLATE_RATIO = 0.005
RATIO_MIN_PAGES = 3


def line_dedup(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = BOILERPLATE_RATIO, min_pages: int = RATIO_MIN_PAGES, counts: bool = False) -> DataFrame:
    """docs without the lines that more than ratio of their host's pages have.

    Every row stays, even if no line is left. With counts, n_lines and n_dropped are added (lines
    with a word, and how many of them went).
    """
    columns = docs.columns
    gone = _removals(docs, text, host, min_pages, ratio).drop("gone_words").withColumnsRenamed({"host": "_host", "txt": "_txt"})
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), host_key(F.col(f"`{host}`")).alias("_host"), F.xxhash64(F.col(f"`{text}`")).alias("_txt"))
    rows = base.join(gone, ["_host", "_txt"], "left")
    out = _rewritten(rows, columns, text) if not counts else None
    if out is not None:
        return out
    n_lines = F.size(F.filter(split_lines(F.col("_row")[text]), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))).cast("long")
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in columns if c not in (text, "n_lines", "n_dropped")],
        _without(F.col("_row")[text], F.col("gone")).alias(text),
        n_lines.alias("n_lines"),
        F.coalesce(F.col("gone_lines"), F.lit(0)).alias("n_dropped"),
    )
