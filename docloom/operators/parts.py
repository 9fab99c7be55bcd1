"""Split documents: modes, limits, scaffolds and sections of parts."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import escape_html

UNIT = "[a-z][a-z-]{0,23}"


def unit_of(unit: Column) -> Column:
    return F.when(unit.rlike(rf"^{UNIT}\z"), unit).otherwise(F.lit("part"))


def part_id(unit: Column, index: Column) -> Column:
    return F.concat(unit, F.lit("-"), F.greatest(index.cast("int"), F.lit(1)).cast("string"))


def capital(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def section(unit: Column, index: Column, total: Column, children: Column, error: Column | None = None, tail: Column | None = None) -> Column:
    """One part as one element: its blocks, what is still open, or its error, or a note that it is being read."""
    index = F.greatest(index.cast("int"), F.lit(1))
    label = F.concat(capital(unit), F.lit(" "), index.cast("string"), F.when(total > 1, F.concat(F.lit(" of "), total.cast("string"))).otherwise(F.lit("")))
    error = F.lit(None).cast("string") if error is None else error
    body = F.concat(F.array_join(children, ""), F.coalesce(tail, F.lit("")) if tail is not None else F.lit(""))
    failed = F.concat(F.lit('<p class="error" role="alert">'), escape_html(error), F.lit("</p>"))
    reading = F.concat(F.lit('<p class="loading">Converting '), F.lower(label), F.lit("…</p>"))
    note = F.when(F.coalesce(error, F.lit("")) != "", failed).when(body == "", reading).otherwise(F.lit(""))
    head = F.concat(F.lit('<section id="'), part_id(unit, index), F.lit('" class="part" data-part="'), index.cast("string"), F.lit('" aria-label="'), label, F.lit('">'))
    return F.concat(head, body, note, F.lit("</section>"))


def section_html(unit: str, index: int, total: int, children: list[str], error: str | None = None, tail: str = "") -> str:
    """``section`` in plain Python, for streams that hold a part's state."""
    label = f"{unit[:1].upper()}{unit[1:]} {index}" + (f" of {total}" if total > 1 else "")
    body = "".join(children) + tail
    if error:
        body += f'<p class="error" role="alert">{html.escape(error).replace("&#x27;", "&#39;")}</p>'
    elif not body:
        body = f'<p class="loading">Converting {label.lower()}…</p>'
    return f'<section id="{unit}-{index}" class="part" data-part="{index}" aria-label="{label}">{body}</section>'


def failure(unit: str, index: int, reason: str) -> str:
    """What stands in the place of a part that could not be converted."""
    return f"{unit[:1].upper()}{unit[1:]} {index} could not be converted. {reason}"


def plan(sources: DataFrame, mode: str = "auto", max_parts: int = 100) -> DataFrame:
    """Adds path (whole, split or error) and message to documents with count, unit, media_type and split_error.

    A limit holds in every mode. Errors of a splitter count in split mode alone.
    """
    n, unit = F.col("count"), unit_of(F.coalesce(F.col("unit"), F.lit("part")))
    many = F.concat(F.lit("The document has "), n.cast("string"), F.lit(" "), unit, F.lit("s; the limit is "), F.lit(str(max_parts)), F.lit("."))
    none = F.concat(F.lit("No splitter is available for "), F.col("media_type"), F.lit("."))
    message = F.when(F.lit(mode == "split") & F.col("split_error").isNotNull(), F.col("split_error")).when(F.lit(mode == "split") & n.isNull(), none).when(n > max_parts, many)
    path = F.when(message.isNotNull(), "error").when(F.lit(mode != "whole") & (n > (0 if mode == "split" else 1)), "split").otherwise("whole")
    return sources.withColumn("message", message).withColumn("path", path)


def scaffold(sources: DataFrame) -> DataFrame:
    """Opening events of split documents: an empty section per part, in order, then the progress note."""
    unit = unit_of(F.col("unit"))
    rows = sources.select("doc_id", unit.alias("unit"), F.col("count").alias("total"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("index"))
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    parts = rows.select("doc_id", F.col("index").cast("long").alias("pos"), F.lit("append").alias("type"), part_id(F.col("unit"), F.col("index")).alias("id"), section(F.col("unit"), F.col("index"), F.col("total"), none).alias("html"), null.alias("phase"), null.alias("message"))
    note = sources.select("doc_id", (F.col("count") + 1).cast("long").alias("pos"), F.lit("progress").alias("type"), null.alias("id"), null.alias("html"), F.concat(F.lit("Converting "), F.col("count").cast("string"), F.lit(" "), unit, F.when(F.col("count") == 1, F.lit("")).otherwise(F.lit("s"))).alias("phase"), null.alias("message"))
    return parts.unionByName(note)


def part_events(parts: DataFrame) -> DataFrame:
    """A replace event for each converted part (doc_id, unit, index, total, blocks, error), in reading order.

    A failed part shows its error in place, and the others stay.
    """
    unit = unit_of(F.col("unit"))
    reason = F.concat(capital(unit), F.lit(" "), F.col("index").cast("string"), F.lit(" could not be converted. "), F.col("error"))
    children = F.when(F.col("error").isNull(), F.col("blocks")).otherwise(F.array().cast("array<string>"))
    null = F.lit(None).cast("string")
    return parts.select("doc_id", (F.col("total") + 1 + F.col("index")).cast("long").alias("pos"), F.lit("replace").alias("type"), part_id(unit, F.col("index")).alias("id"), section(unit, F.col("index"), F.col("total"), children, reason).alias("html"), null.alias("phase"), null.alias("message"))


def backoff_ms(attempt: Column) -> Column:
    """The wait before a further attempt (from 0): doubling from 600 ms, 5 s at most."""
    return F.least(F.lit(600) * F.pow(F.lit(2), attempt), F.lit(5000)).cast("long")
