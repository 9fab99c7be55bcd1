"""Line dedup by distinct-site spread, in DataFrame functions only (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import row_key, settle

#: A line on this many sites is boilerplate; sketches have 2**SKETCH registers; a line whose estimate
#: lies within this share of the threshold gets an exact count.
SITES, SKETCH, MARGIN = 4, 10, 0.25
#: Boilerplate lines up to which their hashes stand in the scan's expressions; beyond it they are joined,
#: and the rows of a hash are spread over SALTS tasks.
INLINE, SALTS = 20_000, 16


def hashes(line: Column) -> list[Column]:
    """128 bits of hash of a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def one_of(value: str, numbers: list[int]) -> str:
    """SQL that tells whether a long is one of ``numbers``; the optimizer makes a hash set of them."""
    return f"{value} IN ({', '.join(f'{n}L' for n in numbers)})"


def spread_lines(docs: DataFrame, sites: int = SITES, sketch: int = SKETCH, margin: float = MARGIN, inline: int = INLINE) -> DataFrame:
    """Lines (h1, h2: 128 bits of hash) on ``sites`` sources or more, and the least doc_id that has them.

    HyperLogLog sketches of the sources are merged per line hash; far from the threshold the
    estimate decides, near it the distinct sources are counted. Lines without a visible character
    and null sources don't count. An empty table has no such lines.
    """
    line = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "").select("doc_id", "source", *hashes(F.col("line")))
    sketches = line.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", sketch)).alias("spread"), F.min("doc_id").alias("first"))
    each = settle(sketches.filter(F.col("spread") > sites * (1 - margin)), "spread")
    sure = each.filter(F.col("spread") >= sites * (1 + margin)).select("h1", "h2", "first")
    near = each.filter(F.col("spread") < sites * (1 + margin)).select("h1", "h2", "first")
    few = [r.h1 for r in near.select("h1").limit(inline + 1).collect()]
    if not few:
        return sure
    some = line.filter(F.expr(one_of("h1", few))) if len(few) <= inline else line
    # A line's rows are one for each source before they meet the lines that are counted.
    own = some.groupBy("h1", "h2", "source").agg(F.count("*").alias("rows")).join(near, ["h1", "h2"])
    counted = own.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("source").alias("n")).filter(F.col("n") >= sites)
    return sure.unionByName(counted.select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, sites: int = SITES, sketch: int = SKETCH, margin: float = MARGIN, inline: int = INLINE) -> DataFrame:
    """All columns of ``docs``, text without boilerplate, and n_lines, n_removed.

    A line on ``sites`` sources or more stays in the document with the least doc_id that has it (all
    rows of that id) and goes from every other. Null texts stay null with no lines; an empty text
    has one line, which stays; equal rows are treated alike; a null doc_id is never the first, unless
    no row of the line has one. Texts of any length are cut whole. Clashing names of other columns
    are no matter unless they are n_lines or n_removed, which are replaced. n_chars, if there, is
    set to the new length. An empty table gives an empty result.

    Up to ``inline`` boilerplate lines are looked up where the texts are read, so no text is moved;
    beyond it their hashes are joined to those of the texts' lines.
    """
    extra = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    known = spread_lines(docs, sites, sketch, margin, inline)
    few = known.select("h1", "h2", F.xxhash64("first", "h1").alias("own")).limit(inline + 1).collect()
    rows = docs.select(*extra, F.split("text", "\n").alias("__lines"))
    if not few:
        cut = rows.withColumn("__kept", F.col("__lines"))
    elif len(few) <= inline:
        in_list = [one_of(h, [r[k] for r in few]) for k, h in enumerate(("xxhash64(x)", "xxhash64(x, 1)", "xxhash64(doc_id, xxhash64(x))"))]
        cut = rows.withColumn("__kept", F.expr(f"filter(__lines, x -> NOT ({in_list[0]} AND {in_list[1]} AND NOT {in_list[2]}))"))
    else:
        cut = joined(docs, rows, settle(known, "boilerplate"))
    n = F.coalesce(F.greatest(F.size("__lines"), F.lit(0)), F.lit(0))
    left = F.coalesce(F.greatest(F.size("__kept"), F.lit(0)), F.lit(0))
    out = cut.withColumn("__text", F.array_join("__kept", "\n"))
    cols = [F.col("__text").alias("text") if c == "text" else F.char_length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in extra]
    return out.select(*cols, n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"))


def joined(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with __kept, the lines that stay, by a join of line hashes; the rows of a hash are salted."""
    line = docs.select("doc_id", row_key().alias("__key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    line = line.select("doc_id", "__key", "at", *hashes(F.col("line")), F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = line.join(salted, ["h1", "h2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = far.groupBy("doc_id", "__key").agg(F.collect_set("at").alias("__gone")).select(F.col("doc_id").alias("__d"), F.col("__key").alias("__k"), "__gone")
    told = rows.withColumn("__key", row_key()).join(gone, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    return told.withColumn("__kept", F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x, i: ~F.array_contains("__gone", i))))
