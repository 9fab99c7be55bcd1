"""Main text of web pages by nearest-URL page differencing (operator 1)."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.cascade import host, path
from docloom.llm.common import settle, ship
from docloom.llm.markup import lines_of

#: Neighbours on either side in URL order that may become the partner of a class of equal pages, and
#: what the rows of a class are spread over when they learn its result. From the share COPY of shared
#: lines on, a partner may be another version of the page.
REACH, SALTS, COPY = 2, 32, 0.9
#: Shared lines stay where their block path holds this many times their characters in own lines.
OWN_TIMES = 3


def lcs(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both (Hunt and Szymanski's matching)."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    ends: list[int] = []
    links: list = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def kept_lines(place: np.ndarray, paths: list, chars: np.ndarray, shared: np.ndarray | None) -> np.ndarray:
    """Which lines are the main text.

    Lines beside the main text go, and so do those shared with the partner page, wherever they
    stand, unless the block path of a shared line holds OWN_TIMES its characters in lines of the
    page's own (a phrase of the text that the partner has too); inside article and main elements as
    many characters are enough. If the partner shares nearly all, any own line in the block path is: it
    may be another version of the same text, or a short text in the same frame. Without a partner
    (None), or if it has every line, the tags decide: the lines of article and
    main elements are the text if they have at least as many characters as the others.
    """
    body = place > 0
    if shared is None or not (body & ~shared).any():
        inside = place == 2
        return inside if inside.any() and chars[inside].sum() >= chars[place == 1].sum() else place > 0
    own: dict = {}
    both: dict = {}
    for p, k, c, s in zip(paths, place.tolist(), chars.tolist(), shared.tolist()):
        (both if s else own)[p, k] = (both if s else own).get((p, k), 0) + c
    near = (shared & body).sum() >= COPY * body.sum()
    rescued = np.array([own.get((p, k), 0) >= 1 if near else own.get((p, k), 0) >= (1 if k == 2 else OWN_TIMES) * both.get((p, k), 0) for p, k in zip(paths, place.tolist())], bool)
    return (place > 0) & (~shared | rescued)


def partner(page: tuple, near: list[tuple]) -> np.ndarray | None:
    """Which body lines of ``page`` its partner shares: the nearest page by URL path that hasn't nearly all
    of them, else the nearest; None if there is none. All pages are of different classes."""
    _, _, own_path, lines = page
    first = None
    for _, _, _, other in sorted(near, key=lambda x: -common_prefix(x[2], own_path)):
        shared = np.zeros(len(lines), bool)
        shared[lcs(lines["hash"].tolist(), other["hash"].tolist())] = True
        if shared.sum() < COPY * len(lines):
            return shared
        first = shared if first is None else first
    return first


LINE = np.dtype([("hash", "<i8"), ("path", "<i8"), ("chars", "<i4"), ("place", "i1")])


def packed(page: str) -> np.ndarray:
    """The body lines of a page: those that don't stand beside the main text."""
    return packed_lines([x for x in lines_of(page) if x[2]])


def packed_lines(lines: list[tuple[str, str, int]]) -> np.ndarray:
    import xxhash

    return np.array([(xxhash.xxh3_64_intdigest(t) - (1 << 63), xxhash.xxh3_64_intdigest(p) - (1 << 63), len(t), k) for t, p, k in lines], LINE)


def class_of(site: str | None, lines: np.ndarray) -> int:
    """Pages of a host with equal body lines are one class."""
    import xxhash

    return xxhash.xxh3_64_intdigest((site or "").encode() + b"\n" + lines.tobytes()) - (1 << 63)


def keep_lists(pages: DataFrame) -> DataFrame:
    """(key, kept) for pages whose partner changes what the tags alone keep: the places, among the body
    lines, of those to keep.

    A page's record is its line hashes, not its text. Pages of a host with equal body lines are one
    class, which stands under the least path of its pages; classes are paired, so that a run of copies
    of any length meets other pages, and every page of a class gets the same. The classes' records are dealt out by ranges of host, path
    and id, so a host of any size is spread over many tasks. Each task pairs the records whose neighbours are its own;
    those within REACH of a border between two ranges are paired with their neighbours on both sides, a border at a time.
    The driver gets the number of each range's records alone.
    """
    def pack(batches):
        for b in batches:
            lines = [packed(x or "") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("key", "host", "path")} | {"cls": pa.array([class_of(h, x) for h, x in zip(b.column("host").to_pylist(), lines)], pa.int64()), "lines": pa.array([x.tobytes() for x in lines], pa.binary())})

    packs = pages.select(F.xxhash64(F.col("page_id").cast("string"), "url", "html").alias("key"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html").mapInArrow(pack, "key long, host string, path string, cls long, lines binary")
    all_ = settle(packs, "lines")
    rows = all_.groupBy("cls").agg(F.first("host").alias("host"), F.min("path").alias("path"), F.first("lines").alias("lines")).select(F.col("cls").alias("key"), "host", "path", "lines")
    # checkpoint() keeps partitions and their order as they are.
    dealt = rows.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").checkpoint()

    def count(batches):
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [sum(b.num_rows for b in batches)]})

    sizes = {r.part: r.n for r in dealt.select("key").mapInArrow(count, "part long, n long").collect()}
    first, borders, total = {}, [], 0
    for part in sorted(sizes):
        first[part] = total
        if sizes[part] and total:
            borders.append(total)
        total += sizes[part]
    borders = np.array(borders, np.int64)

    def near(rank: int, reach: int) -> list[int]:
        """Borders less than ``reach`` places from a record: the record after a border has the border's number."""
        return borders[np.searchsorted(borders, rank - reach, "right") : np.searchsorted(borders, rank + reach, "right")].tolist()

    def judged(page: tuple, others: list[tuple]):
        """(key, places kept), or None if nothing but the tags decides."""
        lines = page[3]
        if not len(lines):
            return None
        args = lines["place"], lines["path"].tolist(), lines["chars"]
        keep = kept_lines(*args, partner(page, [x for x in others if x[1] == page[1]]))
        return (page[0], np.flatnonzero(keep).astype(np.int32)) if (keep != kept_lines(*args, None)).any() else None

    schema = pa.schema([("key", pa.int64()), ("kept", pa.list_(pa.int32())), ("border", pa.int64()), ("rank", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary())])

    def pair(batches):
        from pyspark import TaskContext

        rank = first.get(TaskContext.get().partitionId(), 0)
        window: deque = deque(maxlen=2 * REACH + 1)
        out = []
        for r in chain((r for b in batches for r in b.to_pylist()), [None] * REACH):
            if r is not None:
                out += [r | {"border": x, "rank": rank} for x in near(rank, 2 * REACH)]
                r = rank, (r["key"], r["host"], r["path"], np.frombuffer(r["lines"], LINE))
                rank += 1
            window.append(r)
            middle = window[-1 - REACH] if len(window) > REACH else None
            if middle and not near(middle[0], REACH):
                told = judged(middle[1], [x[1] for x in window if x and x is not middle])
                out += [{"key": told[0], "kept": told[1]}] if told else []
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    def pair_at_border(rows: pa.Table) -> pa.Table:
        known = sorted((r["rank"], (r["key"], r["host"], r["path"], np.frombuffer(r["lines"], LINE))) for r in rows.to_pylist())
        border = rows.column("border")[0].as_py()
        own = [(i, x) for i, x in known if near(i, REACH)[:1] == [border]]
        told = [t for i, x in own if (t := judged(x, [y for j, y in known if j != i and abs(j - i) <= REACH]))]
        return pa.table({"key": pa.array([k for k, _ in told], pa.int64()), "kept": pa.array([x for _, x in told], pa.list_(pa.int32()))})

    every = settle(dealt.mapInArrow(pair, "key long, kept array<int>, border long, rank long, host string, path string, lines binary"), "paired")
    inner = every.filter("border is null").select("key", "kept")
    told = inner.unionByName(every.filter("border is not null").groupBy("border").applyInArrow(pair_at_border, "key long, kept array<int>"))
    # A class may have any number of pages, so its result is joined on as many salts.
    salted = told.select(F.col("key").alias("cls"), "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return all_.select("key", "cls", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["cls", "salt"]).select("key", "kept")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Pages are paired with the nearest page by URL path on their host; their text lines are aligned by
    longest common subsequence, and shared lines are deleted, inside article and main elements too (see
    ``kept_lines``). A null or empty page has an empty text; a page whose host has no other body lines keeps
    what the tags say; copies within a host get equal texts; repeated rows give equal texts; other columns are left
    out, whatever their names; an empty table gives an empty result. Whole pages of any length are read. Of neighbours
    whose paths are equally near, the one that stands first in order of path and class is the partner.
    """
    ship(pages.sparkSession)
    kept = keep_lists(pages).groupBy("key").agg(F.first("kept").alias("kept"))  # equal rows are told the same
    rows = pages.select("page_id", "url", "html", F.xxhash64(F.col("page_id").cast("string"), "url", "html").alias("key")).join(kept, "key", "left").select("page_id", "url", "html", "kept")

    def run(batches):
        for b in batches:
            texts = []
            for page, told in zip(b.column("html").to_pylist(), b.column("kept").to_pylist()):
                lines = lines_of(page or "")
                place = np.array([k for _, _, k in lines], np.int8)
                if told is None:
                    keep = kept_lines(place, [p for _, p, _ in lines], np.array([len(t) for t, _, _ in lines], int), None)
                else:
                    keep = np.zeros(len(lines), bool)
                    keep[np.flatnonzero(place)[told]] = True
                texts.append("\n".join(t for (t, _, _), k in zip(lines, keep) if k))
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
