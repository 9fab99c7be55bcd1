"""Language-model scores by online logistic context mixing (operator 2).

A byte is coded as the decisions on its way down a Huffman tree. Each decision is predicted by the
counts that its contexts have seen at that node: the last 3 bytes, the last 5, and the word so
far. Two sets of gated weights (by what the contexts know, and by depth), learned on every decision
of all training texts, mix the predictions in the logistic domain, and several top weights mix the two results. Within each text
the share of each top is refined with every byte by how well it did so far (a Bayesian mixture, whose
product over the text is a sum of the tops' whole products). Counts come from all training
documents, one for each context and byte that occurs there, however many these are: they are dealt
out by context, and groups of texts ask for what they need. Texts of any length are scored whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import IS_SPACE, LOWER, Powers, forget, lay_out, mix64, mod_of_id, pack, prefix_hash, settle, ship, sum_vectors, text_pieces, unpack, utf8, words_of

#: Bytes that no UTF-8 text has: they stand before each text, and the first after a text is its end.
END, PAD = 255, 8
#: Context lengths in bytes (0: the word so far).
CONTEXTS = (3, 5, 0)
LONG = max(CONTEXTS)
#: Bytes of text that a task works on at a time, that ask for their counts together, and for which a
#: context length has one part of its counts: the parts grow in number with the corpus, not in size.
PIECE, GROUP, PART = 1_000_000, 6_000_000, 10_000_000
#: Distinct grams of a group whose decisions are gone through at a time.
BLOCK = 250_000
#: Count added to both sides of a prediction; stretch is kept in steps of 1 / SCALE.
PRIOR, SCALE = 0.1, 16.0
#: Gates: how much the longest context and the word know (4 levels each), and depth.
LEVELS, DEPTHS = 4, 24
#: What the learned top weights are multiplied by to make the tops that the refinement chooses from.
TOPS = (0.75, 1.0, 1.25)
#: Steps of stretch that the decisions are tallied in: half a unit, and how many there are.
STEP, STEPS = 8, 33
#: What a weighted context can tell a tally (no count, or a level and a step), and what all three can.
STATES = 1 + (LEVELS - 1) * STEPS
CELLS = STEPS * STATES * STATES
#: Strength with which weights are held to where they begin, in decisions, and rounds of Newton's method.
HOLD, ROUNDS = 50.0, 12
#: The number of a group that is told plain counts.
SAMPLE = -1
#: Bytes of training text for which what is asked and told moves in one more slice, and the most slices.
SLICE, SLICES = 32_000_000, 8
#: Words at least this frequent are looked up in memory: there can be no more than 1 / HOT of them.
HOT = 2.0**-20


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, nodes and bits of the code of 256 byte counts (one is added to each); ties by least byte."""
    heap = [(int(c) + 1 << 16, i, (i,)) for i, c in enumerate(counts)]
    # Counts are flattened so that no code grows beyond DEPTHS.
    floor = max(sum(x for x, _, _ in heap) >> 20, 1)
    heap = [(max(c, floor), i, s) for c, i, s in heap]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    node = 0
    while len(heap) > 1:
        (a, i, left), (b, j, right) = heapq.heappop(heap), heapq.heappop(heap)
        for s in left:
            paths[s].append((node, 0))
        for s in right:
            paths[s].append((node, 1))
        heapq.heappush(heap, (a + b, min(i, j), left + right))
        node += 1
    size = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((size.max(), 256), np.int64), np.zeros((size.max(), 256), np.int8)
    for s, p in enumerate(paths):
        for d, (n, b) in enumerate(reversed(p)):
            nodes[d, s], bits[d, s] = n, b
    return size, nodes, bits


class Code:
    """The code tree. Leaves are numbered from left to right, so the bytes below a node are a range of leaves."""

    def __init__(self, counts: np.ndarray):
        size, nodes, bits = huffman(counts)
        depth = len(nodes)
        order = sorted(range(256), key=lambda s: bits[: size[s], s].tolist())
        self.leaf = np.empty(256, np.uint64)
        self.leaf[order] = np.arange(256, dtype=np.uint64)
        self.depth, self.size, self.bits = depth, size[order], bits[:, order]
        #: How many decisions two leaves have in common.
        self.common = np.argmax(self.bits[:, :, None] != self.bits[:, None, :], axis=0).astype(np.int8)


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each coded byte (each text's bytes and its end): byte and LONG before it, the nearest first, as
    one number; and the hash of its word so far."""
    coded = ends - starts + 1
    brk = IS_SPACE[buf] | (buf == END)
    first = np.flatnonzero(brk[:-1]) + 1  # where words, which may be empty, begin
    size = np.diff(np.append(first, len(buf)))
    sums, (_, down) = prefix_hash(buf), Powers.of(len(buf) + 1)
    word = sums[first[0] : -1] - np.repeat(sums[first], size)
    word *= np.repeat(down[first], size)
    del sums, brk, size
    at = ragged(starts, coded)
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))  # the eight bytes from each place on
    return eight[at - LONG] & np.uint64((1 << 8 * (LONG + 1)) - 1), word[at - first[0]]


def context_grams(k: int, key: np.ndarray, word: np.ndarray, code: Code) -> np.ndarray:
    """Context and, in the low byte, the leaf of the byte coded in it."""
    length = CONTEXTS[k]
    leaf = code.leaf[(key >> np.uint64(8 * LONG)).view(np.int64)]
    ctx = (key >> np.uint64(8 * (LONG - length))) & np.uint64((1 << 8 * length) - 1) if length else word
    return (ctx << np.uint64(8)) | leaf


def run_lengths(ordered: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    if weight is None:
        return ordered[first], np.diff(np.append(first, len(ordered)))
    return ordered[first], np.add.reduceat(weight, first) if len(first) else weight


def part_of(gram: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(gram >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of hashes in which equal ones stand together, where each distinct one begins in it, and how many
    of each there are.

    Sorting numbers is much faster than ordering places, so places stand in the low bits of what is sorted.
    """
    n = len(values)
    bits = np.uint64(max(n - 1, 0).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    both = np.sort(values & ~low | np.arange(n, dtype=np.uint64))
    order = (both & low).view(np.int64)
    near = (both[1:] ^ both[:-1]) <= low
    del both
    values = values[order]
    same = values[1:] == values[:-1]
    if not np.array_equal(near, same):  # two hashes differ in the low bits alone
        again = np.argsort(values, kind="stable")
        order, values = order[again], values[again]
        same = values[1:] == values[:-1]
    first = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), ~same)))
    return order, first, np.diff(np.append(first, n))


def numbers(order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of each value among the distinct ones."""
    out = np.empty(len(order), np.int32)
    out[order] = np.repeat(np.arange(len(size), dtype=np.int32), size)
    return out


def ordered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each value's place among them: most are found by a table of hashes."""
    own, _ = run_lengths(np.sort(values))
    shift = np.uint64(62 - len(own).bit_length())
    table = np.zeros(4 << len(own).bit_length(), np.int32)
    table[(own * np.uint64(0x9E3779B97F4A7C15)) >> shift] = np.arange(len(own), dtype=np.int32)
    at = table[(values * np.uint64(0x9E3779B97F4A7C15)) >> shift]
    far = np.flatnonzero(own[at] != values) if len(own) else at
    at[far] = np.searchsorted(own, values[far])
    return own, at


class Grams:
    """The distinct grams (byte, LONG before it, word so far) of a group's texts, how often they are there, and with
    ``places`` where: most bytes repeat one of them, so a gram's contexts are looked up once and its decisions made
    once, however often it stands there."""

    def __init__(self, texts: list[bytes], places: bool = False):
        held, self.pieces = [], []
        for piece in pieces_of(texts):
            buf, starts, ends = lay_out([texts[i] for i in piece], bytes([END]) * PAD)
            key, word = grams(buf, starts, ends)
            mark = self.mark(key, word)
            order, first, size = distinct(mark)
            one = order[first]
            held.append((key[one], word[one], size.astype(np.int32), np.searchsorted(mark[one] >> np.uint64(61), np.arange(9))))
            if places:
                begin = np.cumsum(ends - starts + 1) - (ends - starts + 1)
                self.pieces.append((numbers(order, size), begin, np.empty(len(one), np.int32)))
            del buf, key, word, mark, order, first, size, one
        # The pieces' grams lie by mark: an eighth of all marks at a time is put together.
        keys, words, times, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for r in range(8 if held else 0):
            key, word, size = (np.concatenate([x[i][x[3][r] : x[3][r + 1]] for x in held]) for i in range(3))
            order, first, every = distinct(self.mark(key, word))
            one = order[first]
            keys.append(key[one])
            words.append(word[one])
            times.append(np.add.reduceat(size[order], first, dtype=np.int64) if len(first) else times[0])
            at, done = numbers(order, every) + np.int32(n), 0
            n += len(one)
            for x, (*_, number) in zip(held, self.pieces):
                a, b = x[3][r : r + 2]
                number[a:b] = at[done : done + b - a]
                done += b - a
        self.key, self.word, self.times = np.concatenate(keys), np.concatenate(words), np.concatenate(times)

    @staticmethod
    def mark(key: np.ndarray, word: np.ndarray) -> np.ndarray:
        return key * np.uint64(0x9E3779B97F4A7C15) ^ word * np.uint64(0xD6E8FEB86659FD93)

    def context(self, k: int, code: Code) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct grams of a context length, and the place among them of each gram."""
        return ordered(context_grams(k, self.key, self.word, code))

    def sums(self, worth: np.ndarray) -> np.ndarray:
        """Each text's sum of what its grams are worth (values, grams), as (values, texts)."""
        out = [np.zeros((len(worth), 0))]
        for number, begin, at in self.pieces:
            out.append(np.stack([np.add.reduceat(x[at][number], begin, dtype=np.float64) for x in worth]))
        return np.concatenate(out, axis=1)


def pieces_of(texts: list[bytes]):
    """Places of texts with about PIECE bytes together."""
    own, total = [], 0
    for i, t in enumerate(texts):
        if own and total + len(t) > PIECE:
            yield own
            own, total = [], 0
        own.append(i)
        total += len(t)
    if own:
        yield own


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their counts."""
    g = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
    g, at = ordered(g)
    return g, np.bincount(at, np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)]), len(g)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the like bytes of all together, compressed."""
    return pack(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)


def unplanes(packed: bytes, dtype: str) -> np.ndarray:
    flat = unpack(packed, "u1")
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def path_counts(gram: np.ndarray, n: np.ndarray, code: Code):
    """For each depth (places of grams in the sorted distinct grams, what their contexts have seen there, 0 and 1).

    Grams of a context whose leaves lie below the same node stand side by side, so a node's counts are
    sums over a run of grams, which ends where two neighbours have fewer decisions in common.
    """
    leaf = (gram & np.uint64(255)).view(np.int64)
    base = gram >> np.uint64(8)
    common = np.where(base[1:] == base[:-1], code.common[leaf[:-1], leaf[1:]], np.int8(-1))
    at, size = np.arange(len(gram)), code.size[leaf]
    for d in range(code.depth):
        own = size > d
        if not own.all():
            kept = np.flatnonzero(own)
            common = np.where(np.diff(kept) > 1, np.int8(-1), common[kept[:-1]])
            at, size, leaf, n = at[kept], size[kept], leaf[kept], n[kept]
        if not len(at):
            return
        first = np.flatnonzero(np.concatenate(([True], common < d)))
        run = np.diff(np.append(first, len(at)))
        every, one = np.add.reduceat(n, first), np.add.reduceat(np.where(code.bits[d][leaf] == 1, n, 0), first)
        yield at, np.repeat(every - one, run), np.repeat(one, run)


def path_starts(gram: np.ndarray, code: Code) -> np.ndarray:
    """Where each gram's values begin if the values of a gram lie side by side, and how many there are."""
    return np.concatenate(([0], np.cumsum(code.size[(gram & np.uint64(255)).view(np.int64)])))


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def by_depth(size: np.ndarray) -> np.ndarray:
    """The order of values that lie gram by gram in which all of one depth lie together: neighbours' are alike."""
    return np.argsort(ragged(np.zeros(len(size), np.int64), size).astype(np.uint8), kind="stable")


def packed_counts(none: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The stretched prediction in the low byte, how much is known in the high one."""
    none, one = none.astype(np.float32), one.astype(np.float32)
    stretch = np.clip(np.rint(np.log((one + np.float32(PRIOR)) / (none + np.float32(PRIOR))) * SCALE), -127, 127).astype(np.int16)
    seen = none + one
    level = (seen >= 1).astype(np.int16) + (seen >= 3) + (seen >= 12)
    return (level << 8) | (stretch & 255)


class Answers:
    """What a group of texts was told about its grams: values on their ways down, for each context length."""

    def __init__(self, code: Code, grams: Grams, parts: int):
        self.code, self.grams, self.parts = code, grams, parts
        self.gram, self.number = zip(*(grams.context(k, code) for k in range(len(CONTEXTS))))
        small = np.uint16 if parts <= 1 << 16 else np.int64  # numbers of 16 bits are dealt out, not compared
        self.order = [np.argsort(part_of(g, parts).astype(small), kind="stable") for g in self.gram]
        self.first = []
        for g, order in zip(self.gram, self.order):
            size = code.size[(g[order] & np.uint64(255)).view(np.int64)]
            first = np.empty(len(g), np.int64)
            first[order] = np.cumsum(size) - size
            self.first.append(first)
        self.flat: list = [None] * len(self.gram)

    def asked(self, k: int):
        """(part, places of its grams) for each part that the group asks."""
        part = part_of(self.gram[k], self.parts)[self.order[k]]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(part[a]), self.order[k][a:b]

    def tell(self, k: int, blobs: dict[int, np.ndarray]) -> None:
        """The values that the parts gave, by part."""
        flat = []
        for p, at in self.asked(k):
            own = np.empty(len(blobs[p]), blobs[p].dtype)
            own[by_depth(self.code.size[(self.gram[k][at] & np.uint64(255)).view(np.int64)])] = blobs[p]
            flat.append(own)
        self.flat[k] = np.concatenate(flat) if flat else np.zeros(0, np.int16)

    def ways(self):
        """The grams, BLOCK at a time, by falling code length: their places, leaves, how many are still coded at each
        depth, and where each context's values begin."""
        for begin in range(0, len(self.grams.key), BLOCK):
            leaf = self.code.leaf[(self.grams.key[begin : begin + BLOCK] >> np.uint64(8 * LONG)).view(np.int64)].view(np.int64)
            size = self.code.size[leaf].astype(np.int8)
            rank = np.argsort(-size, kind="stable")
            left = len(leaf) - np.cumsum(np.bincount(size, minlength=self.code.depth + 1))
            yield rank + begin, leaf[rank], left, [first[number[rank + begin]] for first, number in zip(self.first, self.number)]


def tally_states() -> list[np.ndarray]:
    """For each context, what its value (see ``packed_counts``; 1 << 16 more if the bit is 1) adds to a cell's number.

    Stretches count towards the bit that came: a decision for 0 is one for 1 with all of them turned round.
    """
    value = np.arange(1 << 17)
    stretch, level = (value & 255).astype(np.uint8).view(np.int8), (value >> 8) & (LEVELS - 1)
    step = np.rint(np.where(value >> 16, stretch, -stretch.astype(np.int16)) / STEP).astype(np.int32) + STEPS // 2
    step = np.clip(step, 0, STEPS - 1)
    state = np.where(level > 0, 1 + (level - 1) * STEPS + step, 0).astype(np.int32)
    return [step * (STATES * STATES), state * STATES, state]


def tally(told: Answers, total: np.ndarray) -> None:
    """Adds every decision of a group's texts to ``total`` (depth, cell): how often what was told came, with the bit."""
    states = tally_states()
    code = told.code
    for rank, leaf, left, at in told.ways():
        times = told.grams.times[rank]
        for d in range(code.depth):
            m = int(left[d])
            if not m:
                break
            bit = code.bits[d][leaf[:m]].astype(np.int32) << 16
            cell = sum(states[k][told.flat[k][a[:m] + d].view(np.uint16) | bit] for k, a in enumerate(at))
            if m < BLOCK // 4:
                np.add.at(total[d], cell, times[:m].astype(total.dtype))
            else:
                total[d] += np.bincount(cell, times[:m], CELLS).astype(total.dtype)


def newton(x: np.ndarray, n: np.ndarray, gate: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each gate the weights (gates, inputs) under which n times each column of ``x`` being positive is likeliest."""
    start = start.astype(np.float64)
    w, k, gates = start.copy(), len(x), len(start)
    for _ in range(ROUNDS):
        z = np.clip((w[gate] * x.T).sum(1), -30, 30)
        miss = 1 / (1 + np.exp(z))
        slope = np.stack([np.bincount(gate, n * miss * x[i], gates) for i in range(k)], 1) - HOLD * (w - start)
        bend = np.empty((gates, k, k))
        for i in range(k):
            for j in range(i + 1):
                bend[:, i, j] = bend[:, j, i] = np.bincount(gate, n * miss * (1 - miss) * x[i] * x[j], gates)
        step = np.linalg.solve(bend + HOLD * np.eye(k), slope[:, :, None])[:, :, 0]
        w += step / np.maximum(np.abs(step).max(1, keepdims=True) / 0.5, 1)
    return w


class Model:
    """The code tree and the weights."""

    def __init__(self, code: Code):
        self.code = code
        n = len(CONTEXTS)
        self.by_known = np.full((LEVELS * LEVELS, n), 0.3, np.float32)
        self.by_depth = np.full((DEPTHS * LEVELS, n), 0.3, np.float32)
        self.top = np.array([0.5, 0.5], np.float32)

    def learn(self, tallies: np.ndarray) -> Model:
        """Both weight sets by Newton's method on all tallied decisions (see ``tally``), then the pair on top."""
        depth, cell = np.nonzero(tallies)
        if not len(depth):
            return self
        n = tallies[depth, cell].astype(np.float64)
        rest, word = np.divmod(cell, STATES)
        step, long = np.divmod(rest, STATES)
        level = [(s + STEPS - 1) // STEPS for s in (long, word)]
        x = np.stack([(step - STEPS // 2) * STEP / SCALE, *(np.where(s > 0, ((s - 1) % STEPS - STEPS // 2) * STEP / SCALE, 0.0) for s in (long, word))])
        gates = (level[0] * LEVELS + level[1], np.minimum(depth, DEPTHS - 1) * LEVELS + level[1])
        for gate, weights in zip(gates, (self.by_known, self.by_depth)):
            weights[:] = newton(x, n, gate, weights)
        z = np.stack([(weights[gate] * x.T).sum(1) for gate, weights in zip(gates, (self.by_known, self.by_depth))])
        self.top = newton(z, n, np.zeros(len(n), np.int64), self.top[None])[0].astype(np.float32)
        return self

    def worth(self, told: Answers) -> np.ndarray:
        """-ln of each gram's probability under each top (TOPS, grams).

        Both weight sets and the learned pair on top are linear in the inputs, so at one depth they
        are one weight for each context and pair of levels. Grams stand by falling code length: those
        that are still being coded at a depth are the first ones.
        """
        worth = np.empty((len(TOPS), len(told.grams.key)), np.float32)
        last = len(CONTEXTS) - 1
        level = np.arange(LEVELS * LEVELS) % LEVELS
        for rank, leaf, left, at in told.ways():
            out = np.zeros((len(TOPS), len(rank)), np.float32)
            for d in range(self.code.depth):
                m = int(left[d])
                if not m:
                    break
                weights = (self.top[0] * self.by_known + self.top[1] * self.by_depth[min(d, DEPTHS - 1) * LEVELS + level]) / SCALE
                seen = [told.flat[k][a[:m] + d] for k, a in enumerate(at)]
                gate = (seen[last - 1] >> 8) * LEVELS + (seen[last] >> 8)
                z = weights[:, 0].astype(np.float32)[gate] * seen[0].astype(np.int8)
                for k in range(1, len(seen)):
                    z += weights[:, k].astype(np.float32)[gate] * seen[k].astype(np.int8)
                np.negative(z, out=z, where=self.code.bits[d][leaf[:m]] == 1)
                np.clip(z, -60, 60, out=z)
                for k, t in enumerate(TOPS):
                    out[k, :m] += np.log(np.float32(1) + np.exp(np.float32(t) * z))
            worth[:, rank] = out
        return worth

    def log10(self, told: Answers) -> np.ndarray:
        """log10 of the probability of each whole text of a group, its end included."""
        total = told.grams.sums(self.worth(told))
        best = total.min(0)
        return (np.log(np.exp(best - total).mean(0)) - best) / np.log(10)


def word_counts(training: DataFrame) -> tuple[DataFrame, int, int]:
    """Word counts of the training texts (h, c), tokens, and texts."""

    def run(batches):
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("texts", pa.int64())])
        texts, kept, n = 0, [], 0
        for batch in batches:
            for piece in text_pieces(batch):
                raw = utf8(piece.column("text"))
                texts += len(raw)
                kept.append(run_lengths(np.sort(words_of(LOWER[lay_out(raw)[0]])[2])))
                n += len(kept[-1][0])
                if n > 4_000_000:
                    kept = [added(kept)]
                    n = 0
        h, c = added(kept)
        for s in range(0, len(h), 100_000):
            own = h[s : s + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(c[s : s + 100_000].astype(np.int64)), pa.nulls(len(own), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"texts": texts}], schema)

    both = settle(training.select("text").mapInArrow(run, "h long, c long, texts long"), "counts")
    texts = both.agg(F.sum("texts")).first()[0] or 0
    words = settle(both.filter("texts is null").groupBy("h").agg(F.sum("c").alias("c")), "words", tidy=True)
    forget(both)
    total = words.agg(F.sum("c")).first()[0] or 0
    return words, total + texts, texts


def ask(docs: DataFrame, code: Code, parts: int) -> DataFrame:
    """(grp, k, part, blob): groups of rows of ``docs`` as they are read (k = -1), and for each context
    length and part the grams that a group has, with their training counts."""

    def run(batches):
        from pyspark import TaskContext

        schema = pa.schema([("grp", pa.int64()), ("k", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
        here, n = TaskContext.get().partitionId(), 0
        held: list = [[], []]

        def group(own: list):
            nonlocal n
            rows = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            own.clear()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows)
            held_out = rows.column("held_out")[0].as_py()
            grp = (here << 32) + 2 * n + int(held_out)  # held-out texts: odd
            n += 1
            told = Answers(code, Grams(utf8(rows.column("text"))), parts)
            yield pa.RecordBatch.from_pylist([{"grp": grp, "k": -1, "part": -1, "blob": sink.getvalue().to_pybytes()}], schema)
            for k, g in enumerate(told.gram):
                c = np.zeros(len(g), np.int64) if held_out else np.bincount(told.number[k], told.grams.times, len(g))
                out = []
                for p, at in told.asked(k):
                    out.append({"grp": grp, "k": k, "part": p, "blob": blob_of(g[at], c[at])})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

        total = [0, 0]
        for batch in batches:
            for kind in (0, 1):  # texts to learn from and held-out ones lie in different groups
                own = batch.filter(pa.compute.equal(batch.column("held_out"), bool(kind)))
                for piece in text_pieces(own, most_bytes=PIECE):
                    size = int(pa.compute.sum(pa.compute.binary_length(piece.column("text"))).as_py() or 0)
                    if held[kind] and total[kind] + size > GROUP:
                        yield from group(held[kind])
                        total[kind] = 0
                    held[kind].append(piece)
                    total[kind] += size
        for rows in held:
            if rows:
                yield from group(rows)

    return docs.mapInArrow(run, "grp long, k int, part int, blob binary")


def blob_of(gram: np.ndarray, n: np.ndarray) -> bytes:
    step = planes(np.diff(gram, prepend=np.uint64(0)))
    return len(step).to_bytes(4, "little") + step + planes(n.astype("<u4"))


def of_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    return np.cumsum(unplanes(blob[4:cut], "<u8"), dtype=np.uint64), unplanes(blob[cut:], "<u4").astype(np.int64)


def answer(asked: DataFrame, code: Code) -> DataFrame:
    """(grp, k, part, blob): what each part knows of the grams it was asked for, in their order.

    The group SAMPLE gets counts, others what ``packed_counts`` makes of them. A group of texts that are
    learned from is told what is known without the occurrence that asks, as if it were yet to be seen: a text
    is not predicted by itself, but by all others, its copies among them.
    """

    def run(rows: pa.Table) -> pa.Table:
        asked = [of_blob(x.as_py()) for x in rows.column("blob")]
        groups = rows.column("grp").to_pylist()
        gram, place = ordered(np.concatenate([g for g, _ in asked]))
        n = np.bincount(place, np.concatenate([own for _, own in asked]), len(gram)).astype(np.int64)
        first = path_starts(gram, code)
        sample = np.zeros((2, int(first[-1])), np.uint32) if SAMPLE in groups else None
        k = rows.column("k")[0].as_py()
        plain, without = np.empty(int(first[-1]), np.int16), np.empty(int(first[-1]), np.int16)
        leaf = (gram & np.uint64(255)).view(np.int64)
        for d, (at, none, one) in enumerate(path_counts(gram, n, code)):
            to, bit = first[at] + d, code.bits[d][leaf[at]] == 1
            plain[to] = packed_counts(none, one)
            without[to] = packed_counts(np.maximum(none - ~bit, 0), np.maximum(one - bit, 0))
            if k == 0:  # its level is no gate
                plain[to] &= 255
                without[to] &= 255
            if sample is not None:
                sample[0, to], sample[1, to] = none, one
        out, begin = [], 0
        for grp, (g, own) in zip(groups, asked):
            i = place[begin : begin + len(g)]
            begin += len(g)
            at = ragged(first[i], code.size[leaf[i]])
            value = without if len(own) and own.min() > 0 else plain
            out.append(planes(sample[:, at].astype("<u4").ravel()) if grp == SAMPLE else planes(value[at][by_depth(code.size[leaf[i]])].astype("<i2")))
        return pa.table({"grp": rows.column("grp"), "k": rows.column("k"), "part": rows.column("part"), "blob": pa.array(out, pa.binary())})

    return asked.filter("k >= 0").groupBy("k", "part").applyInArrow(run, "grp long, k int, part int, blob binary")


def learned_texts(training: DataFrame) -> DataFrame:
    """The texts that shape the code tree: all training texts, whole."""
    return training.select("text")


def byte_counts(texts: DataFrame | list[bytes]) -> np.ndarray:
    """How often each byte occurs in the texts; END once for each text."""

    def count(some: list[bytes]) -> np.ndarray:
        own = np.bincount(np.frombuffer(b"".join(some), np.uint8), minlength=256)
        own[END] += len(some)
        return own

    if not isinstance(texts, DataFrame):
        return count(texts)

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for piece in text_pieces(batch):
                total += count(utf8(piece.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["byte", "n"])

    total = np.zeros(256, np.int64)
    for r in texts.mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        total[r.byte] = r.n
    return total


def told_group(rows: pa.Table, code: Code, parts: int, places: bool = False) -> tuple[pa.RecordBatch, Answers]:
    """A group's texts and what it was told, from its rows (k, part, blob)."""
    blobs: list[dict] = [{} for _ in CONTEXTS]
    for k, p, x in zip(*(rows.column(c).to_pylist() for c in ("k", "part", "blob"))):
        if k < 0:
            batch = pa.ipc.open_stream(x).read_next_batch()
        else:
            blobs[k][p] = unplanes(x, "<i2")
    told = Answers(code, Grams(utf8(batch.column("text")), places), parts)
    for k in range(len(CONTEXTS)):
        told.tell(k, blobs[k])
        blobs[k] = {}
    return batch, told


def tallies(groups: DataFrame, code: Code, parts: int) -> np.ndarray:
    """The tally (depth, cell) of every decision of the groups' texts."""

    def run(rows: pa.Table) -> pa.Table:
        grp = rows.column("grp")[0].as_py()
        _, told = told_group(rows, code, parts)
        del rows
        total = np.zeros((code.depth, CELLS), np.uint32)
        tally(told, total)
        own = np.flatnonzero(total.any(1))
        return pa.table({"depth": pa.array(own.astype(np.int32)), "part": pa.array([grp % 4093] * len(own), pa.int64()), "vec": pa.array([pack(total[d].astype(np.int64)) for d in own], pa.binary())})

    total = np.zeros((code.depth, CELLS), np.int64)
    summed = settle(sum_vectors(groups.groupBy("grp").applyInArrow(run, "depth int, part long, vec binary"), ["depth"]), "tally", tidy=True)
    for r in summed.toLocalIterator():  # at most as many as the tree is deep
        total[r.depth] = unpack(bytes(r.vec), "int64")
    forget(summed)
    return total


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; all others are learned from, and each of
    their bytes is scored by what the model knows without that byte's own occurrence. The
    base score takes frequent words from memory (see HOT) and joins the others on their hash. A null
    or empty text has one token, its end; without training documents every token is unknown and
    each decision even; repeated rows get equal scores; texts of any length are scored whole; other columns are left out, whatever their names; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    training = docs.filter(mod_of_id("doc_id", 7) != 2).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bytes_ = byte_counts(learned_texts(training))
    code = Code(bytes_)
    size = int(bytes_.sum())
    words, tokens, texts = word_counts(training)
    kinds = words.count() + (texts > 0)
    parts, slices = max(1, -(-size // PART)), max(1, min(SLICES, -(-size // SLICE)))
    # What is asked and told is some times the texts: it moves slice by slice, and each slice goes once it is answered.
    lot = F.pmod(F.xxhash64("grp"), F.lit(slices)).cast("int")
    rows = ask(docs.select("doc_id", (mod_of_id("doc_id", 7) == 2).alias("held_out"), "text"), code, parts)
    both = settle(rows.withColumn("slice", F.when(F.col("k") < 0, -1 - lot).otherwise((F.col("part") * len(CONTEXTS) + F.col("k")) % slices)), "asked", ["slice"])
    known = []
    for s in range(slices):
        asked = both.filter(F.col("slice") == s).select("grp", "k", "part", "blob")
        known.append(settle(answer(asked, code).withColumn("lot", lot), "known", ["lot"], tidy=True))
        forget(both, only=f"slice={s}")

    def lots(b: int) -> DataFrame:
        """The groups of a lot: texts and all that they were told."""
        out = both.filter(F.col("slice") == -1 - b).select("grp", "k", "part", "blob")
        for told in known:
            out = out.unionByName(told.filter(F.col("lot") == b).select("grp", "k", "part", "blob"))
        return out

    model = Model(code).learn(sum(tallies(lots(b).filter("grp % 2 = 0"), code, parts) for b in range(slices)))
    least = max(1, int(np.ceil(tokens * HOT)))
    frequent = words.filter(F.col("c") >= least).toArrow()  # at most 1 / HOT words
    hot, hot_n = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(hot)
    shared = sc.broadcast((model, hot[order], hot_n[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        model, hot, hot_n = shared.value
        worth = np.log10(hot_n + 1.0)
        batch, told = told_group(rows, model.code, parts, places=True)
        del rows
        scores = model.log10(told)
        del told
        out, done = [], 0
        for piece in text_pieces(batch, most_bytes=PIECE):
            raw = utf8(piece.column("text"))
            buf, starts, ends = lay_out(raw)
            begin, _, h = words_of(LOWER[buf])
            doc = np.searchsorted(starts, begin, "right") - 1
            order, first, size = distinct(h)
            one, number = order[first], numbers(order, size)
            at, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            if len(hot):
                own = np.minimum(np.searchsorted(hot, h[one]), len(hot) - 1)
                at, known = own[number], (hot[own] == h[one])[number]
            n = len(raw)
            base = np.bincount(doc[known], worth[at[known]], n) if known.any() else np.zeros(n)
            seen = np.bincount(doc[known], minlength=n)
            far, far_doc = h[~known], doc[~known]
            rank = np.lexsort((far, far_doc))
            far, far_doc = far[rank], far_doc[rank]
            first = np.flatnonzero(np.concatenate(([True], (far[1:] != far[:-1]) | (far_doc[1:] != far_doc[:-1])))) if len(far) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(far))).astype(np.int32)
            offset = np.searchsorted(far_doc[first], np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offset), pa.array(x)) for x in (far[first].view(np.int64), times)]
            size = np.maximum(ends - starts, 1)
            value = scores[done : done + n]
            done += n
            out.append(pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(np.bincount(doc, minlength=n) + 1), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(value), pa.array(-value / np.log10(2) / size), *lists], names=["doc_id", "held_out", "n_tokens", "seen", "base", "score", "bits_per_byte", "far", "times"]))
        return pa.Table.from_batches(out)

    scored = f"doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, score double, bits_per_byte double, far array<long>, times array<int>"
    main = None
    for b in range(slices):
        own = settle(lots(b).groupBy("grp").applyInArrow(run, scored).withColumn("row", F.monotonically_increasing_id() * slices + b), "scored", tidy=True)
        for told in known:
            forget(told, only=f"lot={b}")
        forget(both, only=f"slice={-1 - b}")
        main = own if main is None else main.unionByName(own)
    rare = main.select("row", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row", F.col("x.far").alias("h"), F.col("x.times").alias("f"))
    joined = rare.join(words.filter(F.col("c") < least), "h")
    extra = joined.groupBy("row").agg(F.sum(F.col("f") * F.log10(F.col("c") + F.lit(1.0))).alias("more"), F.sum("f").alias("found"))
    end = float(np.log10(texts + 1.0))
    return main.drop("far", "times").join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("found", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))).alias("base_score"), "score", "bits_per_byte")
