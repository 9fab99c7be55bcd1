"""Token counts of a sentence-piece vocabulary without materialised ids (operator 8)."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import kept, settle, ship, text_pieces

#: What the vocabulary writes for a space.
MARK = "▁"
#: Distinct pre-tokens, and characters of them, that a task gathers before it hands them on.
KEPT, KEPT_CHARS = 200_000, 4_000_000
#: The most frequent pre-tokens, of HOT_CHARS characters at most, are told to every task; the others are joined.
HOT, HOT_CHARS = 500_000, 32
#: A pre-token: marks and what follows up to the next mark, or a line feed, which no longer piece has.
PRE = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@kept
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces) or any("\n" in p for p in pieces):
        raise ValueError("a piece crosses a word's start or holds a line feed: pre-tokens can't be counted apart")
    return model


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a whole text, in order."""
    return PRE.findall(MARK + text.replace(" ", MARK)) if text else []


def n_pieces(pre: str, path: str) -> int:
    """Pieces of a pre-token.

    The encoder puts a mark before its input. A pre-token with a mark gives up its first one for
    that; one without is counted after a line feed, which stops every merge, less the feed's own.
    """
    model = load(path)
    if pre[0] != MARK:
        return len(model.encode("\n" + pre)) - len(model.encode("\n"))
    return len(model.encode(pre[1:].replace(MARK, " "))) if len(pre) > 1 else 1


def count_text(text: str, path: str) -> int:
    """Pieces of a whole text, pre-token by pre-token."""
    return sum(n * n_pieces(pre, path) for pre, n in Counter(pre_tokens(text)).items())


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """(pre, freq, n): the distinct pre-tokens of all texts, how often they occur, and their pieces, counted once each."""

    def gather(batches):
        schema = pa.schema([("pre", pa.string()), ("freq", pa.int64())])
        own, chars = Counter(), 0

        def told():
            for names in (list(own)[k : k + 20_000] for k in range(0, len(own), 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([own[x] for x in names], pa.int64())], schema=schema)

        for batch in batches:
            for part in text_pieces(batch):
                for text in part.column("text").to_pylist():
                    own.update(pre_tokens(text or ""))
                    chars = max(chars, len(text or ""))  # bounds the longest pre-token
                if len(own) > KEPT or chars > KEPT_CHARS:
                    yield from told()
                    own.clear()
                    chars = 0
        yield from told()

    def count(batches):
        for batch in batches:
            n = [n_pieces(x, path) for x in batch.column("pre").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["pre", "freq", "n"])

    every = docs.select("text").mapInArrow(gather, "pre string, freq long").groupBy("pre").agg(F.sum("freq").alias("freq"))
    return settle(every.mapInArrow(count, "pre string, freq long, n long"), "pieces")


def hottest(table: DataFrame, most: int) -> tuple[dict[str, int], bool]:
    """Pieces of the most frequent pre-tokens, ``most`` of them at most, and whether these are all.

    The least frequency is a power of 2, found from how many pre-tokens have each (64 numbers).
    """
    short = F.length("pre") <= HOT_CHARS
    sizes = {r.bits: r["count"] for r in table.groupBy(F.when(short, F.floor(F.log2(F.col("freq").cast("double")) + F.lit(1e-9)).cast("int")).alias("bits")).count().collect()}
    total, least = 0, 64
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    rows = table.filter(short & (F.col("freq") >= (1 << min(least, 62)))).select("pre", "n").toArrow()
    return dict(zip(rows.column("pre").to_pylist(), rows.column("n").to_pylist())), total == sum(sizes.values())


def token_counts(docs: DataFrame, path: str, limit: int = 4096, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The pieces of each distinct pre-token of the corpus are counted once. Those of the ``hot`` most
    frequent are told to every task, which multiplies them with its documents' frequencies; what is left
    of a document's pre-tokens is joined to the table, one row for each with its frequency, and summed.
    No id list of a document is made. A null text is empty (0 bytes, 0 tokens); repeated rows give
    repeated rows; other columns are left out, whatever their names; an empty table gives an empty result;
    texts of any length are counted whole.
    """
    spark = docs.sparkSession
    ship(spark)
    table = piece_table(docs, path)
    known, complete = hottest(table, hot)
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        from pyspark import TaskContext

        get, row = shared.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in text_pieces(batch):
                sums, rare, times = [], [], []
                for text in part.column("text").to_pylist():
                    own = pre_tokens(text or "")
                    n = list(map(get, own))
                    left = Counter(x for x, k in zip(own, n) if k is None) if None in n else {}
                    sums.append(sum(filter(None, n)))
                    rare.append(list(left))
                    times.append(list(left.values()))
                size = pa.compute.binary_length(part.column("text")).fill_null(0).cast(pa.int64())
                rows = pa.array(range(row, row + len(sums)), pa.int64())
                row += len(sums)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": size, "sum": pa.array(sums, pa.int64()), "row": rows, "rare": pa.array(rare, pa.list_(pa.string())), "times": pa.array(times, pa.list_(pa.int32()))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, sum long, row long, rare array<string>, times array<int>")
    n_tokens = F.col("sum")
    if not complete:
        counted = settle(counted, "counted")
        left = counted.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pre"), F.col("x.times").alias("times"))
        more = left.join(table.select("pre", "n"), "pre").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"))
        counted = counted.join(more, "row", "left")
        n_tokens = n_tokens + F.coalesce("more", F.lit(0))
    return counted.select("doc_id", "n_bytes", n_tokens.cast("long").alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
