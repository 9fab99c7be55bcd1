"""Benchmark decontamination by winnowing, in DataFrame functions only (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import let, row_key, settle, without

#: Words of a hit span, of a hashed gram, and grams of a winnowing window: GRAM + WINDOW - 1 = SPAN,
#: so two texts that share SPAN words in a row share the least gram hash of those words.
SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: Benchmark fingerprints up to which they are put into the scan's filter; beyond it a semi-join finds the documents.
INLINE = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and everything beyond ASCII; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def upto(n: Column) -> Column:
    """0 .. n - 1, empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column) -> Column:
    """A hash of every GRAM words in a row, from the words' hashes."""
    return F.transform(upto(F.size(hashes) - GRAM + 1), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(GRAM)]))


def winnow(hashes: Column) -> Column:
    """The distinct least hashes of every WINDOW grams in a row."""
    return F.array_distinct(F.transform(upto(F.size(hashes) - WINDOW + 1), lambda i: F.least(*[F.get(hashes, i + j) for j in range(WINDOW)])))


def fingerprints(text: Column) -> Column:
    """The winnowed hashes of a text; each step is computed once (see ``let``)."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda h: let(grams(h), winnow))


def with_fingerprints(df: DataFrame) -> DataFrame:
    """Adds words, and fps: the winnowed hashes."""
    return df.withColumn("words", words(F.col("text"))).withColumn("fps", fingerprints(F.col("text")))


def windows(words_: Column, n: int) -> Column:
    """All runs of n words, as text; words hold no space."""
    return let(words_, lambda w: F.transform(upto(F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i + 1, n))))


def hits(docs: DataFrame, benchmark: DataFrame, inline: int = INLINE) -> DataFrame:
    """Spans of documents that occur in benchmark items: doc_id, key, start, length, item_id (one row for each).

    ``key`` tells apart rows of one doc_id with different texts. An item of SPAN words or more hits
    by any SPAN words of it in a row; an item of 1 to SPAN - 1 words by all its words in a row.
    """
    items = settle(with_fingerprints(benchmark.select("item_id", "text")).select("item_id", "words", "fps").filter(F.size("words") > 0), "items")
    spans = items.select("item_id", F.explode(windows(F.col("words"), SPAN)).alias("span")).distinct()
    short = items.filter(F.size("words") < SPAN).select("item_id", F.size("words").alias("n"), F.concat_ws(" ", "words").alias("span")).distinct()
    marks = items.select(F.explode("fps").alias("fp")).distinct()
    rows = docs.select("doc_id", row_key().alias("key"), "text")
    few = [r.fp for r in marks.limit(inline + 1).collect()]
    prepared = with_fingerprints(rows)
    if len(few) <= inline:
        found = prepared.filter(F.exists("fps", lambda x: x.isin(few))) if few else prepared.limit(0)
    else:
        known = prepared.select("doc_id", "key", F.explode("fps").alias("fp")).join(marks, "fp").select("doc_id", "key").distinct()
        found = rows.join(known.select(F.col("doc_id").alias("d"), F.col("key").alias("k")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi").withColumn("words", words(F.col("text")))
    out = found.select("doc_id", "key", F.posexplode(windows(F.col("words"), SPAN)).alias("start", "span")).join(spans, "span").select("doc_id", "key", "start", F.lit(SPAN).alias("length"), "item_id")
    for n in sorted(r.n for r in short.select("n").distinct().collect()):  # at most SPAN - 1 lengths
        own = short.filter(F.col("n") == n).select("item_id", "span")
        every = F.transform(windows(words(F.col("text")), n), lambda w, i: F.struct(i.alias("start"), w.alias("span")))
        told = [r.span for r in own.select("span").distinct().limit(inline + 1).collect()]
        if len(told) <= inline:  # only what is found becomes a row
            every = F.filter(every, lambda x: x.span.isin(told))
        at = rows.select("doc_id", "key", F.explode(every).alias("x")).select("doc_id", "key", "x.start", "x.span")
        out = out.unionByName(at.join(own, "span").select("doc_id", "key", "start", F.lit(n).alias("length"), "item_id"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, inline: int = INLINE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in a hit span; n_items counts the items with a hit span; the hash is of
    their ids, sorted as text and joined by commas (of the empty text if there are none). Null and
    empty texts have no words and are never hit; equal rows give equal rows; empty tables and items
    without words hit nothing; other columns are left out.
    """
    spans = hits(docs, benchmark, inline)
    span = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.stop - F.greatest(s.start, a.end))).alias("n"), F.greatest(a.end, s.stop).alias("end"))).n
    by_doc = spans.groupBy("doc_id", "key").agg(span.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    by_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), covered.cast("long").alias("hit"), F.size("ids").cast("long").alias("items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("sha"))
    every = docs.select("doc_id", row_key().alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = every.join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))


def drop_hit(docs: DataFrame, benchmark: DataFrame, inline: int = INLINE) -> DataFrame:
    """All columns of the rows without a hit span (see ``decontaminate``).

    Rows are told apart by id and text, so of two texts under one id, or under none, only the hit
    one goes; repeated rows are treated alike; an empty table gives an empty result.
    """
    return without(docs, hits(docs, benchmark, inline))
