"""Quality rules: an isolation forest on rule statistics (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import settle, ship

#: Trees, rows of a tree's subsample, and documents of the bounded sample that the subsamples come from.
TREES, SUBSAMPLE, SAMPLE = 100, 256, 8192
#: Base rules: fewest words, and the share of words in repeated windows (in hundredths) above which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of labelled good rows that the threshold must keep, and bins of the score histogram.
KEEP_GOOD, BINS = 0.98, 1000

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
NOT_SHOUT = bytes(b for b in range(256) if b not in b"!?")
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
HEADS = bytes(b for b in range(256) if not 128 <= b < 192)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the forest sees: by how much a text exceeds each rule's allowance. What a rule
#: allows is no oddity, so it is 0 and can't be split; sizes aren't among them.
ALLOWED = {"symbols_a_word": 0.1, "capital_words": 0.2, "shouts_a_char": 0.01, "digits_a_char": 0.15, "dup_lines": 0.3, "repeats": 0.2, "long_words": 10.0, "short_words": -3.0}
STATS = tuple(ALLOWED)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    n = len(ids)
    if n < 2_000_000:
        gram = (at[:-2] * n + at[1:-1]) * n + at[2:]
    else:
        _, two = np.unique(at[:-2] * n + at[1:-1], return_inverse=True)
        gram = two * n + at[2:]
    order = np.argsort(gram, kind="stable")
    same = gram[order][1:] == gram[order][:-1]
    twice = np.zeros(len(gram), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for j in range(3):
        hit[j : j + len(gram)] |= twice
    return int(hit.sum())


def statistics(text: bytes) -> tuple:
    """COUNTS, then STATS, of one whole text."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - len(text.translate(None, HEADS))
    symbols = len(text.translate(None, NOT_SYMBOL))
    lines = [x for x in text.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    size, some = max(len(text), 1), max(n, 1)
    capital = sum(len(w) > 1 and w.isupper() for w in words)
    mean = chars / some if n else 5.0
    seen = (symbols / some, capital / some, len(text.translate(None, NOT_SHOUT)) / size, len(text.translate(None, NOT_DIGIT)) / size, dup / max(len(lines), 1), repeat / some, mean, -mean)
    return (n, chars, symbols, dup, repeat, *(max(0.0, x - y) for x, y in zip(seen, ALLOWED.values())))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and STATS of each row; a null text has no words."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            cols = list(zip(*rows)) or [()] * (len(COUNTS) + len(STATS))
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(STATS)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {c: pa.array(x, k) for c, x, k in zip((*COUNTS, *STATS), cols, kinds)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in STATS))


def expected_path(n):
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    out = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays: a node's feature (-1: leaf), split, children, and path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.most = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = [self.grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)]

    def grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, split, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for x, v in ((feature, -1), (split, 0.0), (left, at), (right, at), (path, depth + float(expected_path(len(part))))):
                x.append(v)
            low, high = part.min(0), part.max(0)
            open_ = np.flatnonzero(high > low)
            if depth < self.most and len(part) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(low[f], high[f]))
                under = part[:, f] <= cut
                feature[at], split[at] = f, cut
                left[at] = node(part[under], depth + 1)
                right[at] = node(part[~under], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(split), np.array(left), np.array(right), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that few random splits isolate."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.most):
                f = feature[at]
                under = rows[at_row, np.maximum(f, 0)] <= split[at]
                at = np.where(f < 0, at, np.where(under, left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(expected_path(self.size)), 1e-9))


def sample_of(stats: DataFrame, most: int) -> np.ndarray:
    """About ``most`` rows (never more than twice) by a hash of the id, the same at every run."""
    n = stats.count()
    share = min(1.0, most / max(n, 1))
    rows = stats.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30)) <= int(share * (1 << 30))).select("doc_id", *STATS).limit(2 * most).toPandas()
    return rows.sort_values(["doc_id", *STATS])[list(STATS)].to_numpy(float)


def threshold(scored: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """The score above which a document goes: of all BINS borders that keep the share ``keep_good``
    of the labelled good rows, the one with the best balanced accuracy. All labelled rows count, as a histogram.
    Without good or without bad rows nothing goes."""
    joined = scored.join(labels.filter("quality is not null").select(F.col("doc_id").alias("__id"), "quality"), F.col("doc_id") == F.col("__id"))
    bins = joined.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), "quality").count().collect()  # at most 2 * BINS rows
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        (good if r.quality else bad)[r.bin] += r["count"]
    if not good.sum() or not bad.sum():
        return 1.0
    kept = np.cumsum(good) / good.sum()
    caught = 1 - np.cumsum(bad) / bad.sum()
    allowed = np.where(kept >= keep_good, kept + caught, -1)
    best = np.flatnonzero(allowed == allowed.max())
    at = int(best[len(best) // 2])  # the middle of the borders that do equally well
    return (at + 1) / BINS if caught[at] > 0 else 1.0


def judge(docs: DataFrame, labels: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, sample: int = SAMPLE, keep_good: float = KEEP_GOOD) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, kept, score.

    base_failed: fewer than 50 words, or more than half the words in repeated windows. kept is false
    for those, else the forest's verdict. The forest is grown on a sample of at most 2 * ``sample``
    documents; the threshold comes from all labelled rows and every document is scored. Null and
    empty texts fail the base rules; equal rows give equal verdicts; without labels of both kinds
    the base rules decide alone; an empty table gives an empty result; texts of any length are read whole; equal scores fall on the same side
    of the threshold; other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)
    stats = settle(rule_statistics(docs), "stats")
    sound = f"n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words"
    rows = sample_of(stats.filter(sound), sample)
    forest = Forest(rows, trees, subsample) if len(rows) else None

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in STATS])
            score = forest.score(x) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    scored = settle(stats.mapInArrow(run, f"doc_id {kind}, {counts}, " + ", ".join(f"{c} double" for c in STATS) + ", score double").select("doc_id", *COUNTS, "score"), "scored")
    limit = threshold(scored.filter(sound), labels, keep_good)
    failed = ~F.expr(sound)
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("score") < limit)).alias("kept"), "score")
