"""Layout elements: decoded from a model's text, rendered in order, runs of list items joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.layout import decode_div, render
from docloom.operators.html import cut_blocks, join_chunks


def elements(chunks: DataFrame) -> DataFrame:
    """(doc_id, pos, element) from chunks of model text; a div may be split over any chunks."""
    cut = join_chunks(chunks).select("doc_id", cut_blocks(F.col("text")).alias("c"))
    rest = F.regexp_replace("c.rest", r"^\s+|\s+\z", "")
    every = F.concat("c.blocks", F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>")))
    return cut.select("doc_id", F.posexplode(every).alias("pos", "html")).select("doc_id", "pos", decode_div(F.col("html")).alias("element"))


def to_html(rows: DataFrame, furniture: bool = False) -> DataFrame:
    """(doc_id, pos, html): elements rendered; list items that follow each other become one list.

    Elements that show nothing don't end a run. Gaps and islands over one window per document.
    """
    shown = rows.select("doc_id", "pos", F.col("element.label").alias("label"), render(F.col("element"), furniture).alias("html")).filter("html <> ''")
    order = Window.partitionBy("doc_id").orderBy("pos")
    item = F.col("label") == "List-item"
    starts = ~(item & (F.coalesce(F.lag("label").over(order), F.lit("")) == "List-item"))
    islands = shown.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda x: x.html), "")
    out = islands.groupBy("doc_id", "island").agg(F.min("pos").alias("pos"), F.first("label").alias("label"), joined.alias("html"))
    return out.select("doc_id", "pos", F.when(item, F.concat(F.lit("<ul>"), F.col("html"), F.lit("</ul>"))).otherwise(F.col("html")).alias("html"))
