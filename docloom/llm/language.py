"""Language ID by a bidirectional gated recurrent network over bytes (operator 10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import lay_out, lean, mod_of_id, ship, text_pieces, utf8

#: Units of each direction; bytes of a text that are labelled together, the bytes on either side that are read with them
#: so that a state is never begun anew in mid-text, and how many such stretches run side by side.
UNITS, STEPS, WARM, SIDE = 8, 1024, 48, 1024
#: Bounded training sample: bytes of whole texts a language, languages that have so many (more languages share as
#: many together), and the least documents of each; then steps of training, texts in each, bytes of each, and rate.
BYTES_A_LANG, LANGS, LEAST_DOCS, ROUNDS, BATCH, STRETCH, RATE = 1_000_000, 256, 2, 240, 144, 96, 0.02


def stretches(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int = STEPS, warm: int = WARM):
    """All whole texts in stretches of ``steps`` bytes with up to ``warm`` bytes of the text before and after.

    Bytes (stretches, at most steps + 2 * warm), how many are the text's, which of them are to be labelled
    (from, to), and the text's number.
    """
    n = -(-(ends - starts) // steps)
    text = np.repeat(np.arange(len(starts)), n)
    begin = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * steps
    low, high = np.maximum(begin - warm, starts[text]), np.minimum(begin + steps + warm, ends[text])
    size = high - low
    at = low[:, None] + np.arange(int(size.max(initial=1)))
    rows = buf[np.minimum(at, len(buf) - 1)]
    rows[np.arange(rows.shape[1]) >= size[:, None]] = 0
    return rows, size, begin - low, np.minimum(begin + steps, ends[text]) - low, text


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Two gated recurrent layers, one from each end, and a softmax at every position."""

    def __init__(self, langs: list[str], units: int = UNITS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs, self.units = langs, units
        w = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {"x" + d: w(3 * units, 256, s=0.3), "g" + d: w(2 * units, units, s=units**-0.5), "c" + d: w(units, units, s=units**-0.5), "o" + d: w(len(langs), units, s=units**-0.5)}
        self.p["bias"] = np.zeros((len(langs), 1), np.float32)

    def step(self, d: str, x: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple:
        """The next state over one byte of each stretch, and what it was made of; a state stays where there is no byte."""
        u, p = self.units, self.p
        a = p["x" + d].take(x, axis=1)
        zr = sigmoid(a[: 2 * u] + p["g" + d] @ h)
        rh = zr[u:] * h
        c = np.tanh(a[2 * u :] + p["c" + d] @ rh)
        z = zr[:u] * live
        return h + z * (c - h), zr, z, rh, c

    def direction(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """States of one direction over x (steps, stretches)."""
        h = np.zeros((self.units, x.shape[1]), np.float32)
        states, trail = [None] * len(x), []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            new, zr, z, rh, c = self.step(d, x[t], live[t], h)
            if keep:
                trail.append((t, h, zr, z, rh, c))
            h = states[t] = new
        return states, trail

    def probabilities(self, rows: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each stretch the sum over its positions from ``first`` to ``last`` of the languages' probabilities."""
        out = np.zeros((len(rows), len(self.langs)))
        order = np.argsort(-size, kind="stable")
        for s in range(0, len(rows), SIDE):
            own = order[s : s + SIDE]
            steps = int(size[own].max())
            at = np.arange(steps)[:, None]
            x = np.ascontiguousarray(rows[own, :steps].T)
            live = (at < size[own]).astype(np.float32)
            asked = ((at >= first[own]) & (at < last[own])).astype(np.float32)
            back, _ = self.direction("b", x, live)
            total = np.zeros((len(self.langs), len(own)), np.float32)
            for t, h in self.ahead(x, live):
                logit = self.p["of"] @ h + self.p["ob"] @ back[t] + self.p["bias"]
                e = np.exp(logit - logit.max(0))
                total += e * (asked[t] / e.sum(0))
                back[t] = None
            out[own] = total.T
        return out

    def ahead(self, x: np.ndarray, live: np.ndarray):
        """The states of the forward direction one after the other."""
        h = np.zeros((self.units, x.shape[1]), np.float32)
        for t in range(len(x)):
            h = self.step("f", x[t], live[t], h)[0]
            yield t, h

    def gradients(self, rows: np.ndarray, size: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross entropy at the positions."""
        u, p = self.units, self.p
        x = np.ascontiguousarray(rows.T)
        live = (np.arange(len(x))[:, None] < size).astype(np.float32)
        run = {d: self.direction(d, x, live, keep=True) for d in "fb"}
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        dh = {"f": [None] * len(x), "b": [None] * len(x)}
        total = max(float(live.sum()), 1.0)
        for t in range(len(x)):
            f, b = run["f"][0][t], run["b"][0][t]
            logit = p["of"] @ f + p["ob"] @ b + p["bias"]
            e = np.exp(logit - logit.max(0))
            err = e / e.sum(0)
            err[target, np.arange(len(target))] -= 1
            err *= live[t] / total
            grad["of"] += err @ f.T
            grad["ob"] += err @ b.T
            grad["bias"] += err.sum(1, keepdims=True)
            dh["f"][t], dh["b"][t] = p["of"].T @ err, p["ob"].T @ err
        for d in "fb":
            carry = np.zeros((u, x.shape[1]), np.float32)
            for t, h, zr, z, rh, c in reversed(run[d][1]):
                g = carry + dh[d][t]
                dc = g * z * (1 - c * c)
                dz = g * (c - h) * live[t]
                drh = p["c" + d].T @ dc
                r = zr[u:]
                dzr = np.concatenate((dz, drh * h)) * zr * (1 - zr)
                carry = g * (1 - z) + drh * r + p["g" + d].T @ dzr
                grad["g" + d] += dzr @ h.T
                grad["c" + d] += dc @ rh.T
                da = np.concatenate((dzr, dc))
                for k in range(3 * u):
                    grad["x" + d][k] += np.bincount(x[t], da[k], 256)
        return grad

    def fit(self, texts: list[bytes], target: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH, steps: int = STRETCH, rate: float = RATE, seed: int = 5) -> Net:
        """Steps of gradient descent with moments on stretches from anywhere in the texts; languages weigh alike."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(target == k) for k in range(len(self.langs))]
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            own = [int(rng.choice(of[k])) for k in rng.permutation(np.arange(batch) + int(rng.integers(len(of)))) % len(of) if len(of[k])]
            rows, size = np.zeros((len(own), steps), np.uint8), np.zeros(len(own), np.int64)
            for i, k in enumerate(own):
                at = int(rng.integers(0, max(len(texts[k]) - steps, 0) + 1))
                cut = np.frombuffer(texts[k], np.uint8, min(steps, len(texts[k]) - at), at)
                rows[i, : len(cut)], size[i] = cut, len(cut)
            grad = self.gradients(rows, size, target[own])
            scale = rate * min(1.0, 3 * (1 - (step - 1) / rounds))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.p[k] -= (scale * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, bytes_a_lang: int = BYTES_A_LANG, rounds: int = ROUNDS) -> Net | None:
    """Learns from rows with a language and crc32(doc_id) mod 4 other than 2.

    The sample has about ``bytes_a_lang`` bytes of each language in whole texts, chosen by a hash of the id, and
    LEAST_DOCS texts at least; with more than LANGS languages, all of them share what LANGS would
    have. It goes to the driver; no language is left out. Stretches are drawn from everywhere in its texts.
    """
    own = docs.filter((mod_of_id("doc_id", 4) != 2) & F.col("lang").isNotNull() & (F.length("text") > 0))
    n = {r.lang: r for r in own.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).collect()}
    if not n:
        return None
    langs = sorted(n)
    bytes_a_lang = min(bytes_a_lang, max(1, bytes_a_lang * LANGS // len(langs)))
    share = {x: min(1.0, max(bytes_a_lang / n[x].bytes, LEAST_DOCS / n[x].rows)) for x in langs}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(23)), F.lit(1 << 30))
    told = F.create_map(*[F.lit(v) for x in langs for v in (x, int(share[x] * (1 << 30)))])
    chosen = own.filter(place <= F.element_at(told, F.col("lang"))).select("doc_id", "lang", "text")
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    rows = chosen.collect()
    if {r.lang for r in rows} != set(langs):  # a language of a few rows that the hash passed by
        missed = own.filter(~F.col("lang").isin(sorted({r.lang for r in rows}))).withColumn("__k", F.row_number().over(first))
        rows += missed.filter(F.col("__k") <= LEAST_DOCS).select("doc_id", "lang", "text").collect()
    rows = sorted(rows, key=lambda r: (str(r.doc_id), r.lang, r.text))
    at = {x: k for k, x in enumerate(langs)}
    return Net(langs).fit([r.text.encode() for r in rows], np.array([at[r.lang] for r in rows]), rounds)


def labels(texts: list[bytes], net: Net | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each whole text."""
    pred, score = np.array(["und"] * len(texts), object), np.zeros(len(texts))
    letters = np.array([any(c.isalpha() for c in t) for t in (x.decode() for x in texts)], bool) if net else np.zeros(len(texts), bool)
    if letters.any():
        own = np.flatnonzero(letters)
        buf, starts, ends = lay_out([texts[i] for i in own])
        rows, size, first, last, text = stretches(buf, starts, ends)
        pool = np.zeros((len(own), len(net.langs)))
        np.add.at(pool, text, net.probabilities(rows, size, first, last))
        pool /= (ends - starts)[:, None]
        best = pool.argmax(1)
        pred[own] = [net.langs[k] for k in best]
        score[own] = np.clip(pool[np.arange(len(own)), best], 0, 1)
    return pred, score


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Every byte of every text is labelled, in the light of what stands before and after it; a text's score
    for a language is the mean of its positions' probabilities. Texts of any length are read whole. Texts that are null or have no letter are ``und`` with score 0, as is
    everything if nothing was learned; equal texts get equal answers; ties go to the first language
    by name; other columns are left out; an empty table gives an empty result.
    """

    def run(batches):
        lean()
        for batch in batches:
            for part in text_pieces(batch, most_bytes=1_000_000):
                pred, score = labels(utf8(part.column("text")), net)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(pred.tolist(), pa.string()), "score": pa.array(score)})

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", (mod_of_id("doc_id", 4) == 2).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def drop_unknown(docs: DataFrame, net: Net | None, least: float) -> DataFrame:
    """All columns of the rows whose language is learned and scores ``least`` or more (see ``identify``).

    Rows are judged where they are read: nothing is joined or shuffled, so null and repeated ids are
    no matter. If nothing was learned, every row goes; an empty table gives an empty result.
    """

    def run(batches):
        lean()
        for batch in batches:
            for part in text_pieces(batch, most_bytes=1_000_000):
                pred, score = labels(utf8(part.column("text")), net)
                yield part.filter(pa.array((pred != "und") & (score >= least), pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
