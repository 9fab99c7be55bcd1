"""N-gram Jaccard join by rare-first prefix filtering (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import LOWER, forget, lay_out, lean, mix64, pack, row_key, settle, ship, small_batches, sum_vectors, text_pieces, unpack, utf8, without, words_of
from docloom.llm.graph import components

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Shingle frequencies are kept in 2**ORDER_BITS hashed counters; they only order the shingles, so
#: sharing a counter costs speed and no link.
ORDER_BITS, CHUNK = 22, 1 << 16
#: Members of a key beyond which they are dealt out by size before they meet.
MANY = 64
#: Bytes of text that are worked on at a time: what a task holds is some 100 times as much.
PIECE = 500_000
#: Bits of the bitmaps that spare the shuffle what can't matter; a join decides what they let through.
SIEVE_BITS = 26


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    buf, starts, ends = lay_out(texts)
    begin, _, word = words_of(LOWER[buf])
    first = np.searchsorted(begin, starts)
    last = np.searchsorted(begin, ends)
    with np.errstate(over="ignore"):
        gram = word[: max(len(word) - SHINGLE + 1, 0)].copy()
        for j in range(1, SHINGLE):
            gram = mix64(gram * np.uint64(0x100000001B3) + word[j : j + len(gram)])
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(gram[a : b - SHINGLE + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for w in word[a:b]:
                    whole = mix64(np.array([whole * np.uint64(0x100000001B3) + w]))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)) - (1 << 63)


def mark_of(cls: int, rep) -> int:
    """Stands for a class and the row that speaks for it."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{cls} {rep}")


def part_counts(shingles: np.ndarray) -> int:
    """Shingles in each of 8 hash ranges, a byte each; all ones if one has over 254."""
    n = np.bincount((shingles >> np.uint64(19)) & np.uint64(7), minlength=8)
    packed = (1 << 64) - 1 if n.max(initial=0) > 254 else int(n.astype("<u1").view("<u8")[0])
    return packed - (1 << 64) if packed >= 1 << 63 else packed


def spots(values: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each value in a bitmap."""
    h = mix64(values.astype(np.uint64))
    return np.stack((h >> np.uint64(64 - bits), mix64(h) >> np.uint64(64 - bits))).astype(np.int64)


def sieve_of(df: DataFrame, values, bits: int = SIEVE_BITS):
    """A bitmap of 2**bits bits of ``values(batch)``, a 64-bit number for each row, as a broadcast test.

    The numbers are made where they are marked: one Python worker a task, not a chain of two.
    """
    bits = max(16, min(bits, int(np.ceil(np.log2(max(df.count(), 1) * 12)))))

    def mark(batches):
        from pyspark import TaskContext

        lean()
        own = np.zeros(1 << bits, bool)
        for b in batches:
            own[spots(values(b), bits).ravel()] = True
        packed = np.packbits(own, bitorder="little").view(np.uint8)
        step = min(CHUNK, len(packed))
        part = TaskContext.get().partitionId()
        for k in range(0, len(packed), step):
            if packed[k : k + step].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k // step], pa.int32()), "part": pa.array([part], pa.int64()), "vec": pa.array([packed[k : k + step].tobytes()], pa.binary())})

    step = min(CHUNK, (1 << bits) // 8)

    def join(rows: pa.Table) -> pa.Table:
        total = np.zeros(step, np.uint8)
        for v in rows.column("vec"):
            total |= np.frombuffer(v.as_buffer(), np.uint8)
        return rows.slice(0, 1).set_column(2, "vec", pa.array([total.tobytes()], pa.binary()))

    marked = df.mapInArrow(mark, "chunk int, part long, vec binary").withColumn("part", F.col("part") % 64)
    schema = "chunk int, part long, vec binary"
    marked = marked.groupBy("chunk", "part").applyInArrow(join, schema).withColumn("part", F.lit(0).cast("long")).groupBy("chunk").applyInArrow(join, schema)
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in marked.toLocalIterator():
        whole[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(bytes(r.vec), np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    def test(values: np.ndarray) -> np.ndarray:
        at = spots(values, bits)
        hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return hit.all(0)

    return test


def describe(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Each row (doc_id, key) with its class (equal sets share one), the sets, and the hashed shingle frequencies.

    Texts are read once; every later step reads the sets.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.select("doc_id").limit(0).toArrow().schema.field(0).type

    def run(batches):
        from pyspark import TaskContext

        lean()
        counts = np.zeros(1 << ORDER_BITS, np.uint32)
        schema = pa.schema([("doc_id", arrow), ("key", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("parts", pa.int64()), ("shingles", pa.binary()), ("chunk", pa.int32()), ("part", pa.int64()), ("vec", pa.binary())])
        for batch in batches:
            for piece in text_pieces(batch, most_bytes=PIECE):
                sets = shingle_sets(utf8(piece.column("text")))
                if any(map(len, sets)):
                    at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - ORDER_BITS), return_counts=True)
                    counts[at.astype(np.int64)] += n.astype(np.uint32)
                size, cls, parts = [len(s) for s in sets], [class_of(s) if len(s) else None for s in sets], [part_counts(s) for s in sets]
                none = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("key"), *(pa.array(x, pa.int64()) for x in (size, cls, parts)), pa.array([s.tobytes() for s in sets], pa.binary()), *none], schema=schema)
        part = TaskContext.get().partitionId()
        for k in range(0, len(counts), CHUNK):
            if counts[k : k + CHUNK].any():
                yield pa.RecordBatch.from_pylist([{"chunk": k // CHUNK, "part": part, "vec": pack(counts[k : k + CHUNK].astype("<u4"))}], schema)

    both = settle(docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, n long, cls long, parts long, shingles binary, chunk int, part long, vec binary"), "sets")
    order = np.zeros(1 << ORDER_BITS, np.uint32)
    for r in sum_vectors(both.filter("chunk is not null").select("chunk", "part", "vec"), ["chunk"], "<u4").toLocalIterator():  # 2**ORDER_BITS counters in all
        order[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = unpack(bytes(r.vec), "<u4")
    rows = both.filter("chunk is null")
    return rows.select("doc_id", "key", "n", "cls", "parts"), rows.filter("n > 0").select("doc_id", "cls", "n", "shingles"), order


def marks_of(batch: pa.RecordBatch, row: str) -> np.ndarray:
    """The marks (see ``mark_of``) of a batch's classes with the rows in column ``row``."""
    return np.array([mark_of(c, r) for c, r in zip(batch.column("cls").to_pylist(), batch.column(row).to_pylist())], np.uint64)


def speakers(classes: DataFrame):
    """A test of rows by their marks: the row that speaks for each of ``classes`` passes, and few others."""
    return sieve_of(classes.select("cls", "rep"), lambda b: marks_of(b, "rep"))


def flat_sets(batch: pa.RecordBatch, speaks):
    """The sets of the rows that speak for their classes as one array, with each row's size, a few MB at a time."""
    own = batch.filter(pa.array(speaks(marks_of(batch, "doc_id")), pa.bool_())) if batch.num_rows else batch
    for piece in text_pieces(own, "shingles", 4 * PIECE):
        raw = piece.column("shingles").to_pylist()
        yield piece, np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64)


def prefixes(sets: DataFrame, order, speaks, sieve=None) -> DataFrame:
    """(key, cls, n, pos): the rarest shingles of each set, as many as two linked sets must share one of; without a sieve the keys alone."""

    def run(batches):
        lean()
        for batch in batches:
            for piece, flat, size in flat_sets(batch, speaks):
                row = np.repeat(np.arange(len(size)), size)
                seen = np.minimum(order.value[(flat >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], (1 << 22) - 1)
                rank = seen.astype(np.uint64) << np.uint64(42) | mix64(flat) >> np.uint64(22)
                by = np.lexsort((rank, row))
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                near = pos < np.repeat(size - (PERCENT * size + 99) // 100 + 1, size)
                key, row, pos = flat[by][near], row[near], pos[near]
                if not sieve:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])
                    continue
                hit = sieve(key)
                key, row, pos = key[hit], row[hit], pos[hit]
                cls = piece.column("cls").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls[row]), pa.array(size[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["key", "cls", "n", "pos"])

    return sets.select("doc_id", "cls", "shingles").mapInArrow(run, "key long, cls long, n int, pos int" if sieve else "key long")


def needed(n):
    """The least overlap of two linked sets with n shingles together: 100 * o >= PERCENT * (n - o)."""
    return F.ceil(n * F.lit(PERCENT) / F.lit(100 + PERCENT) - F.lit(1e-9))


def may_link(a: str, b: str):
    """Length and positional filters: what two sets can share if the key is the first that they share."""
    na, nb, pa_, pb = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (a, b))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= needed(na + nb))


def far_apart(a: str, b: str):
    """Suffix filter in one level: both sets fall into 8 hash ranges, and the ranges' sizes bound what differs."""
    ca, cb = F.col(f"{a}_parts"), F.col(f"{b}_parts")
    byte = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))
    apart = sum((F.abs(byte(ca, k) - byte(cb, k)) for k in range(1, 8)), F.abs(byte(ca, 0) - byte(cb, 0)))
    n = F.col(f"{a}_n") + F.col(f"{b}_n")
    return (ca != -1) & (cb != -1) & (apart > n - 2 * needed(n))


def verify(sets: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, each compared once, shingle by shingle."""
    side = lambda t: classes.select(F.col("cls").alias(t), F.col("n").alias(f"{t}_n"), F.col("parts").alias(f"{t}_parts"))
    pairs = settle(pairs.join(side("a"), "a").join(side("b"), "b").filter(~far_apart("a", "b")).select("a", "b"), "pairs")
    of = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()

    # One row of each wanted class passes, but for the sieve's few false hits, whose sets are equal or not asked for.
    sieve = speakers(classes.join(of, "cls"))

    def wanted(batches):
        lean()
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["cls", "shingles"]).filter(pa.array(sieve(marks_of(batch, "doc_id")), pa.bool_()))

    some = settle(sets.select("doc_id", "cls", "shingles").mapInArrow(wanted, "cls long, shingles binary"), "shingles")

    def compare(batches):
        lean()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(some.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(some.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    out = settle(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct(), "verified")
    forget(some)
    return out


def size_class(n):
    """Sets that link lie in the same class of sizes or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100 / PERCENT)) + F.lit(1e-9)).cast("int")


def link_classes(sets: DataFrame, rows: DataFrame, order: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(classes, comps): each class with its least doc_id; and (node, comp) of the linked classes.

    Prefix shingles that one class alone has are dropped. Round one links each class that holds a
    key with the key's most central class (the one with the fewest rarer shingles), so a group of
    near copies costs as many pairs as it has members. Round two compares, within a key, what is
    still in different components: no link between different texts is lost, and no pair inside a component
    is made. Under a key that many classes hold, sets too different in size never meet.
    """
    spark = rows.sparkSession
    classes = settle(rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parts").alias("parts")), "classes")
    order = spark.sparkContext.broadcast(order)
    speaks = speakers(classes)
    # More than one row a key: of several classes, or of one whose speaking row is repeated.
    keys = settle(prefixes(sets, order, speaks).select("key").groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "keys")
    some = settle(prefixes(sets, order, speaks, sieve_of(keys, lambda b: b.column(0).to_numpy().view(np.uint64))).groupBy("key", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "some")
    members = some.groupBy("key").agg(F.count("*").cast("int").alias("members")).filter("members > 1")
    held = settle(some.join(members, "key"), "held")
    forget(keys)
    forget(some)
    centre = held.groupBy("key").agg(F.min(F.struct("pos", "cls", "n")).alias("c")).select("key", "c.pos", "c.cls", "c.n")
    first = held.alias("x").join(centre.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") != F.col("y.cls")) & may_link("x", "y"))
    tried = settle(first.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct(), "tried")
    links = verify(sets, classes, tried)
    comps = settle(components(links), "comps")
    # A key of two members has been tried.
    named = held.filter("members > 2").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")).withColumn("size", size_class(F.col("n")))
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key")
    # Under a key of many members, a set lies in its own block of sizes and the next; two sets meet in the block of the larger one.
    blocks = F.when(F.col("members") > MANY, F.array(F.col("size"), F.col("size") + 1)).otherwise(F.array(F.lit(-1)))
    open_ = settle(named.join(mixed, "key").withColumn("block", F.explode(blocks)).select("key", "cls", "n", "pos", "comp", "size", "block"), "open")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.comp") < F.col("y.comp"))
    once = (F.col("x.block") < 0) | (F.col("x.block") == F.greatest("x.size", "y.size"))
    second = open_.alias("x").join(open_.alias("y"), meet & once & may_link("x", "y"))
    rest = second.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verify(sets, classes, rest)
    return classes, settle(components(links.unionByName(more)), "comps") if not more.isEmpty() else comps


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when their sets of SHINGLE-word shingles have a Jaccard similarity of PERCENT
    hundredths or more; a component's id is its least doc_id. Exact copies of a set are one class
    and cost nothing more. A text of fewer words is one shingle; null texts and texts without words
    have no shingles and are alone; repeated rows repeat; other columns are left out; an empty
    table gives an empty result. Whole texts count, and no group is capped.
    """
    return row_components(docs).drop("key")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """All columns of the row that speaks for its component: least id (nulls last), then least row key.

    Rows are told apart by id and text, so another text under the same id is touched only if it
    links. Rows repeated under an id that speaks are one document and stay; of rows without an id,
    only one stays where no linked row has an id. Texts without words are alone and stay; an empty
    table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        rows, sets, order = describe(docs)
        classes, comps = link_classes(sets, rows, order)
    least = rows.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s"))
    named = least.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    of = named.join(named.groupBy("comp").agg(F.min("s").alias("speaks")), "comp").select("cls", "speaks")
    lost = rows.join(of, "cls").filter(~(F.col("speaks.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("speaks.key") == F.col("key")))).select("doc_id", "key")
    left = without(docs, settle(lost, "lost"))
    # Left without an id are the texts that speak, each as often as it is repeated.
    bare = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    return left.filter(~bare).unionByName(left.filter(bare).dropDuplicates(["text"]))


def row_components(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component_id of each row."""
    with small_batches(docs.sparkSession):
        rows, sets, order = describe(docs)
        classes, comps = link_classes(sets, rows, order)
    named = classes.select("cls", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = named.join(ids, "comp").select("cls", "component_id")
    return rows.join(of, "cls", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
