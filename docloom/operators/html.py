"""HTML operators as Arrow UDFs: sanitize, cut and normalize in one call, so a text crosses to Python once."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import lexer, sanitizer
from docloom.functions.text import with_root_id, wrap_table
from docloom.session import shipped


def sanitize(html: Column, handlers: tuple = ()) -> Column:
    """Allowed markup alone; a null stays null."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda x: None if x is None else sanitizer.sanitize(x, handlers))

    return run(html)


def clean_blocks(html: Column, handlers: tuple = ()) -> Column:
    """Sanitized, complete, balanced top-level blocks of a text, cut before they are sanitized."""

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        def one(x):
            cut, rest = lexer.cut_blocks(lexer.strip_fence(x or ""))
            return [b for part in [*cut, rest] if part for b in lexer.normalize(sanitizer.sanitize(part, handlers))]

        return col.map(one)

    return run(html)


def cut_blocks(html: Column) -> Column:
    """struct<blocks, rest> of a text as it is."""

    @F.pandas_udf("blocks array<string>, rest string")
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(b, r) for b, r in (lexer.cut_blocks(x or "") for x in col)], columns=["blocks", "rest"])

    return run(html)


def cut_markdown(text: Column) -> Column:
    """All markdown blocks of a whole text, fences included."""

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        def one(x):
            blocks, rest = lexer.cut_markdown(x or "")
            return [*blocks, rest] if rest.strip() else blocks

        return col.map(one)

    return run(text)


def is_single_block(html: Column, ident: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lexer.is_single_block(x or "", y or "") for x, y in zip(a, b)], dtype=bool)

    return run(html, ident)


def normalize(html: Column) -> Column:
    """Complete balanced elements of markup; what isn't degrades to its text."""

    @F.arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([lexer.normalize(x or "") for x in col.to_pylist()], pa.list_(pa.string()))

    return shipped(run)(html)


def is_complete(html: Column) -> Column:
    """Whether markup is one element, balanced by name."""

    @F.arrow_udf("boolean")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([lexer.is_complete(x or "") for x in col.to_pylist()], pa.bool_())

    return shipped(run)(html)


def provisional(rest: Column) -> Column:
    """struct<html, children> of an open container closed for now; null fields if nothing can be shown."""

    @F.pandas_udf("html string, children int")
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([lexer.provisional(x or "") or (None, None) for x in col], columns=["html", "children"]).astype({"children": "Int32"})

    return run(rest)


def number_blocks(df: DataFrame, blocks: str = "blocks", ident: str = "doc_id") -> DataFrame:
    """One row per block: doc id, pos, id (block-N) and HTML with that id on its root; tables get a scroll box."""
    rows = df.select(ident, F.posexplode(blocks).alias("pos", "raw"))
    name = F.concat(F.lit("block-"), (F.col("pos") + 1).cast("string"))
    return rows.select(ident, "pos", name.alias("id"), with_root_id(wrap_table(F.col("raw")), name).alias("html"))


def join_chunks(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): the chunks of each document (or of each value of ``keys``) in order. What is cut afterwards doesn't depend on chunk borders."""
    keys = keys or ("doc_id",)
    ordered = F.array_sort(F.collect_list(F.struct("chunk_seq", "delta")))
    return chunks.groupBy(*keys).agg(ordered.alias("parts")).select(*keys, F.array_join(F.transform("parts", lambda x: x.delta), "").alias("text"))
