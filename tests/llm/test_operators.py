"""The training-data operators against plain Python, on small and on awkward tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, cascade, forest, graph, jaccard, language, lines, markup, mixing, pages, pieces, queries, winnow

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, note string"


def some_docs(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    texts = [None, "", " \n\t", "a", "One two.", "x" * 5000, "line\nline\nother\n"]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[:-3] + ["zz", "yy"]), " ".join(w[:30] + ["new"] + w[30:])]
    texts += [" ".join(rng.choices(words, k=rng.randint(3, 400))) for _ in range(20)]
    texts += ["<|endoftext|> mid <|endoftext|>\n\n  end  ", "漢字 かな " * 50]
    rows = [(i, t, rng.choice(["en", "fr", None]), f"s{i % 6}", len(t or ""), "n") for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def compare_sql(spark, name, fn=None):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, con.sql(queries.ORACLES[name]).project(", ".join(cols)).fetchall()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    compare_sql(spark, name)


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = {r[0]: r[1] or "" for r in some_docs()}
    assert len(bpe.shared_chunks(docs, path)) > 5
    for shared in (bpe.SHARED, 3, 0):
        got = bpe.encode_decode(docs, path, full=True, shared=shared).collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in some_docs())
        for r in got:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded == library.decode(ids, skip_special_tokens=False) == texts[r.doc_id]
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_repairs_joins():
    """Any cuts give the library's ids; wrong witnesses make a join go on, up to the whole text."""
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library, encoder, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(11)
    for k in range(400):
        text = "".join(rng.choices(["rain ", "the", " don't", "é", "漢字", "  ", "\n", " 12", "3.", "<|endoftext|>", "!", " a b c d e"], k=rng.randint(0, 60)))
        raw = text.encode()
        places = [0, *sorted(rng.sample(range(1, len(raw)), min(6, len(raw) - 1))), len(raw)] if len(raw) > 1 else [0, len(raw)]
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.text(raw, places), "<u4").tolist() == ids
        if k % 4 == 0:
            wrong = bpe.Encoder(path)
            for a, b in zip(places, places[1:]):
                own = wrong.chunk(raw[a:b])
                if own.first:
                    setattr(own, rng.choice(["left", "right"]), b"wrong ids")
            assert np.frombuffer(wrong.text(raw, places), "<u4").tolist() == ids


def test_token_counts(docs, empty):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {r[0]: r[1] or "" for r in some_docs()}
    for hot in (pieces.HOT, 40, 0):  # all pre-tokens told to every task, some, none
        got = pieces.token_counts(docs, path, 100, hot).collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in some_docs())
        for r in got:
            n = len(model.encode(texts[r.doc_id]))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 100)
    table = pieces.piece_table(docs, path).collect()
    expected = collections.Counter(x for r in some_docs() for x in pieces.pre_tokens(r[1] or ""))
    assert {r.pre: r.freq for r in table} == expected and len(table) == len(expected)
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choices(" ▁\nab.漢é\t\x00", k=rng.randint(0, 25)))
        assert pieces.count_text(t, path) == len(model.encode(t))
    assert pieces.token_counts(empty, path).count() == 0


def plain_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs, empty):
    expected = plain_components(some_docs())
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(some_docs()) and len({v[1] for v in expected.values()}) < len(expected)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert jaccard.jaccard_components(empty).count() == 0


def test_near_copies_take_one_worker_a_task(docs, monkeypatch):
    """No stage of the join pipes one Python worker into another: each costs an executor its memory."""
    plans, own = [], type(docs).mapInArrow

    def watched(self, *a, **k):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return own(self, *a, **k)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    assert jaccard.jaccard_components(docs).count() == docs.count()
    assert len(plans) > 5 and not [p for p in plans if "MapInArrow" in p]


def test_lean_workers():
    """A task that needs room clears the models that other operators keep in its worker."""
    from docloom.llm import common

    load = common.kept(lambda path: [path])
    first = load("a")
    assert load("a") is first
    common.lean()
    assert load("a") is not first
    common.MODELS.remove(load)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 105), (105, 101), (7, 7)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100}


def test_winnowing_finds_every_span(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([12, 30, 10, 4, 1, 9])] + [(90, None), (91, "...")]
    texts = []
    for i in range(40):
        w = rng.choices(vocabulary, k=40)
        source = items[i % 6][1].split()
        n = min(len(source), rng.choice([9, 10, 11, 20]))
        at = rng.randint(0, len(source) - n)
        w[10:10] = source[at : at + n]
        texts.append((i, "  " + "; ".join(w).upper()))
    texts += [(50, None), (51, ""), (52, "W3"), (50, texts[0][1])]
    item_words = {i: (t or "").lower().split() if t != "..." else [] for i, t in items}
    for inline in (100_000, 0):
        got = sorted(map(tuple, winnow.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), inline).collect()))
        expected = []
        for d, t in texts:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
            hit, ids = set(), set()
            for i, x in item_words.items():
                n = min(len(x), 10)
                spans = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
                for k in range(len(w) - n + 1) if n else ():
                    if tuple(w[k : k + n]) in spans:
                        hit |= set(range(k, k + n))
                        ids.add(str(i))
            expected.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
        assert got == sorted(expected)


def test_cascade(spark):
    rows = [(i, f"http://h{i % 50}.example.net/en/{i}") for i in range(3000)] + [(9001, None), (9002, "no scheme"), (9003, "x://A.Example.ORG/es/1?q"), (1, "http://h1.example.net/en/1")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = F.crc32(F.col("path").cast("binary")) % 7 == 0
    keys = df.select(F.concat(cascade.host(F.col("url")), cascade.path(F.col("url"))).alias("key"), cascade.path(F.col("url")).alias("path")).filter(listed).select("key")
    for share, told, own in ((1 << 24, 1 << 26, listed), (2048, 1 << 26, listed), (2048, 0, keys.unionByName(keys).unionByName(spark.createDataFrame([("not.here/x",)], "key string")))):
        got = cascade.filter_urls(df, own, share_bits=share, told_bits=told)
        assert got.count() == len(rows)
        free = got.filter("rule is null")
        assert free.filter((F.col("verdict") == "block") != F.coalesce(listed, F.lit(False))).count() == 0
        assert free.filter("verdict = 'block'").count() > 100
    special = {r.page_id: r for r in got.filter("page_id > 9000").collect()}
    assert (special[9001].host, special[9001].path, special[9001].rule) == ("", "", None)
    assert cascade.filter_urls(df, keys.limit(0)).filter("rule is null and verdict = 'block'").count() == 0
    assert cascade.filter_urls(df.limit(0), listed).count() == 0
    assert (special[9003].host, special[9003].path, special[9003].rule, special[9003].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")


def test_line_dedup(spark, docs, empty):
    rows = [(i, "Subscribe now\nown " + str(i) + "\n\nSubscribe now", "en", f"s{i}", 1, "x") for i in range(5)] + [(9, "Subscribe now", "en", None, 1, "x"), (10, None, "en", "s1", 1, "x")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].text == rows[0][1] and got[3].text == "own 3\n" and got[9].text == "" and got[10].text is None
    assert (got[3].n_lines, got[3].n_removed, got[3].n_chars) == (4, 2, 6)
    assert lines.dedup_lines(docs).count() == docs.count() and lines.dedup_lines(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    texts = {r[0]: r[1] or "" for r in some_docs()}
    for r in forest.judge(docs, labels).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        repeat = len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})
        own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), repeat)
        assert r.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r.base_failed and r.kept)
    assert forest.judge(empty, labels).count() == 0


def test_forest_against_plain_python(spark):
    """A row's score is 2 ** -(mean path / expected path), its path walked node by node; the threshold is the best border that is allowed."""
    rng = np.random.default_rng(4)
    rows = np.round(rng.random((300, 4)), 1)
    made = forest.Forest(rows, trees=20, subsample=64)
    for row, score in zip(rows[:40].tolist(), made.score(rows[:40]).tolist()):
        total = 0.0
        for feature, split, left, right, path in made.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= split[at] else right[at]
            total += path[at]
        n = 64
        mean = 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
        assert math.isclose(score, 2 ** (-total / 20 / mean), rel_tol=1e-9)
    assert made.score(rows[:1])[0] == made.score(np.repeat(rows[:1], 3, axis=0))[2]
    data = [(i, round(random.Random(i).random() * (0.6 if i % 3 else 1), 2)) for i in range(200)]
    quality = {i: int(i % 3 > 0) for i, _ in data}
    got = forest.threshold(spark.createDataFrame(data, "doc_id long, score double"), spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int"))
    bins = lambda x: min(int(math.floor(x * forest.BINS)), forest.BINS - 1)

    def worth(border):
        kept = np.mean([bins(x) <= border for i, x in data if quality[i]])
        return kept + np.mean([bins(x) > border for i, x in data if not quality[i]]) if kept >= forest.KEEP_GOOD else -1

    best = max(worth(k) for k in range(forest.BINS))
    assert math.isclose(worth(round(got * forest.BINS) - 1), best)


def test_quality_separates(spark):
    got = queries.op7_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.1


def test_language(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    net = language.train(docs, rounds=5)
    rows = {r.doc_id: r for r in language.identify(docs, net).collect()}
    assert rows[0].lang_pred == rows[2].lang_pred == "und" and rows[3].lang_pred in ("en", "fr") and 0 <= rows[3].score <= 1
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert language.train(empty) is None and language.identify(empty, None).count() == 0


def test_language_against_plain_python(spark, docs):
    """Byte by byte in scalar arithmetic, over texts shorter and longer than a stretch, ties to the first language by name."""
    net = language.train(docs, rounds=5)
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    u = net.units
    sig = lambda v: 1 / (1 + math.exp(-v))

    def states(d, raw):
        h, out = [0.0] * u, []
        for byte in raw if d == "f" else raw[::-1]:
            gate = [sig(p["x" + d][k][byte] + sum(w * v for w, v in zip(p["g" + d][k], h))) for k in range(2 * u)]
            rh = [gate[u + k] * h[k] for k in range(u)]
            c = [math.tanh(p["x" + d][2 * u + k][byte] + sum(w * v for w, v in zip(p["c" + d][k], rh))) for k in range(u)]
            h = [h[k] + gate[k] * (c[k] - h[k]) for k in range(u)]
            out.append(h)
        return out if d == "f" else out[::-1]

    def plain(text):
        raw, total = text.encode(), [0.0] * len(net.langs)
        for begin in range(0, len(raw), language.STEPS):
            low, high = max(0, begin - language.WARM), min(len(raw), begin + language.STEPS + language.WARM)
            f, b = states("f", raw[low:high]), states("b", raw[low:high])
            for t in range(begin - low, min(begin + language.STEPS, len(raw)) - low):
                logit = [sum(w * v for w, v in zip(p["of"][k], f[t])) + sum(w * v for w, v in zip(p["ob"][k], b[t])) + p["bias"][k][0] for k in range(len(net.langs))]
                top = max(logit)
                e = [math.exp(v - top) for v in logit]
                total = [x + v / sum(e) for x, v in zip(total, e)]
        return [x / len(raw) for x in total]

    texts = {r[0]: r[1] for r in some_docs()}
    got = language.identify(docs, net).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in some_docs())
    for r in got:
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in texts[r.doc_id] or "") and r.score == 0
            continue
        if r.doc_id % 3 == 0 or len(texts[r.doc_id]) > language.STEPS:
            own = plain(texts[r.doc_id])
            assert math.isclose(r.score, max(own), abs_tol=1e-4) and own[net.langs.index(r.lang_pred)] > max(own) - 1e-4
    even = language.Net(["a", "b"])
    even.p["of"][:] = even.p["ob"][:] = 0
    assert language.labels([b"text"], even)[0].tolist() == ["a"]


def test_languages_beyond_256(spark):
    rows = [(i, f"text number {i}", f"l{i % 300:03}", "s", 1, "n") for i in range(1200)]
    net = language.train(spark.createDataFrame(rows, SCHEMA), rounds=1)
    assert net.langs == [f"l{k:03}" for k in range(300)]


def test_gradient():
    rng = np.random.default_rng(0)
    net = language.Net(["a", "b"], units=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, size, target = rng.integers(0, 256, (4, 6), dtype=np.uint8), np.array([6, 6, 4, 2]), np.array([0, 1, 1, 0])

    def loss():
        return -sum(np.log(net_position(net, x[i : i + 1, : size[i]])[target[i]]).sum() for i in range(4)) / size.sum()

    grad = net.gradients(x, size, target)
    for key in ("gf", "cb", "of", "bias"):
        at = tuple(s // 2 for s in net.p[key].shape)
        net.p[key][at] += 1e-3
        high = loss()
        net.p[key][at] -= 2e-3
        low = loss()
        net.p[key][at] += 1e-3
        assert math.isclose((high - low) / 2e-3, grad[key][at], rel_tol=2e-2, abs_tol=1e-4)


def net_position(net, rows):
    live = np.ones((rows.shape[1], 1), np.float32)
    f, _ = net.direction("f", np.ascontiguousarray(rows.T), live)
    b, _ = net.direction("b", np.ascontiguousarray(rows.T), live)
    logit = np.concatenate([net.p["of"] @ f[t] + net.p["ob"] @ b[t] + net.p["bias"] for t in range(len(f))], axis=1)
    e = np.exp(logit - logit.max(0))
    return e / e.sum(0)


def test_scores(docs, empty):
    rows = some_docs()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    words = {i: [*(t or "").encode().lower().split(), b"\x00end"] for i, t, *_ in rows}
    counts = collections.Counter(w for i, *_ in rows if not held[i] for w in words[i])
    total, distinct = sum(counts.values()), len(counts)
    for r in mixing.score(docs).collect():
        w = words[r.doc_id]
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)
    assert mixing.score(empty).count() == 0


def test_scores_against_plain_python(spark, docs, monkeypatch):
    """Every decision of every byte from counts in dictionaries; a text that is learned from is taken out byte by byte."""
    rows = some_docs()
    sample = [(r[1] or "").encode() for r in rows[:20]]
    monkeypatch.setattr(mixing, "learned_texts", lambda *_: sample)
    monkeypatch.setattr(mixing.Model, "learn", lambda self, *_: self)
    code = mixing.Code(np.bincount(np.frombuffer(b"".join(t + bytes([mixing.END]) for t in sample), np.uint8), minlength=256))
    model = mixing.Model(code)
    seen = collections.defaultdict(lambda: [0, 0])

    def decisions(text):
        raw, word = bytes([mixing.END]) * mixing.PAD + (text or "").encode() + bytes([mixing.END]), b""
        for i in range(mixing.PAD, len(raw)):
            word = b"" if raw[i - 1] in b" \t\n\v\f\r\xff" else word + raw[i - 1 : i]
            leaf = int(code.leaf[raw[i]])
            bits = tuple(code.bits[: code.size[leaf], leaf].tolist())
            for d, bit in enumerate(bits):
                yield d, bit, [(k, ctx, bits[:d]) for k, ctx in enumerate((raw[i - 3 : i], raw[i - 5 : i], word))]

    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows}
    for r in rows:
        for _, bit, nodes in decisions(r[1]) if not held[r[0]] else ():
            for node in nodes:
                seen[node][bit] += 1

    def plain(text, own):
        total = [0.0] * len(mixing.TOPS)
        for d, bit, nodes in decisions(text):
            stretch, level = [], []
            for node in nodes:
                n = list(seen[node]) if node in seen else [0, 0]
                n[bit] = max(n[bit] - own, 0)
                stretch.append(max(-127, min(127, round(math.log((n[1] + mixing.PRIOR) / (n[0] + mixing.PRIOR)) * mixing.SCALE))))
                level.append(sum(sum(n) >= x for x in (1, 3, 12)))
            known = model.by_known[level[1] * mixing.LEVELS + level[2]]
            deep = model.by_depth[min(d, mixing.DEPTHS - 1) * mixing.LEVELS + level[2]]
            z = sum((model.top[0] * a + model.top[1] * b) * x / mixing.SCALE for a, b, x in zip(known, deep, stretch))
            for k, t in enumerate(mixing.TOPS):
                total[k] += math.log1p(math.exp(t * (-z if bit else z)))
        best = min(total)
        return (math.log(sum(math.exp(best - x) for x in total) / len(total)) - best) / math.log(10)

    texts = {r[0]: r[1] for r in rows}
    got = mixing.score(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert len({held[r.doc_id] for r in got}) == 2
    for r in got:
        if r.doc_id % 2 or held[r.doc_id] or len(texts[r.doc_id] or "") > 2000:
            assert math.isclose(r.score, plain(texts[r.doc_id], int(not held[r.doc_id])), rel_tol=2e-4, abs_tol=1e-3), r.doc_id


def test_every_decision_is_learned_from(spark):
    """The code tree and the weights see each byte of all training texts, however long and many: no sample does."""
    rng = random.Random(8)
    texts = ["".join(rng.choices("abé \n" if i % 3 else "xyz ", k=rng.choice([0, 40, 9000]))) for i in range(40)] + ["q" * 5000 + "Z" + "q" * 5000, None]
    training = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = mixing.byte_counts(mixing.learned_texts(training))
    raw = [(t or "").encode() for t in texts]
    assert counts.tolist() == np.bincount(np.frombuffer(b"".join(t + bytes([mixing.END]) for t in raw), np.uint8), minlength=256).tolist()
    code = mixing.Code(counts)
    rows = mixing.settle(mixing.ask(training.select("doc_id", F.lit(False).alias("held_out"), "text"), code, 3), "asked")
    told = rows.filter("k < 0").unionByName(mixing.answer(rows, code))
    tallies = mixing.tallies(told, code, 3)
    size = dict(zip(range(256), code.size[code.leaf.astype(int)].tolist()))
    assert tallies.sum() == sum(n * size[b] for b, n in enumerate(counts.tolist()))
    model = mixing.Model(code).learn(tallies)
    assert not np.allclose(model.by_known, 0.3) and np.isfinite(model.by_known).all() and np.isfinite(model.by_depth).all() and np.isfinite(model.top).all()


def test_newton():
    """Weights of gated decisions against plain gradient ascent."""
    rng = np.random.default_rng(5)
    x, gate, n = rng.normal(0.3, 1, (3, 60)), rng.integers(0, 2, 60), rng.integers(1, 200, 60).astype(float)
    got = mixing.newton(x, n, gate, np.full((2, 3), 0.3, np.float32))
    w = np.full((2, 3), 0.3)
    for _ in range(20000):
        pull = n / (1 + np.exp((w[gate] * x.T).sum(1)))
        w += 2e-4 * (np.stack([np.bincount(gate, pull * x[i], 2) for i in range(3)], 1) - mixing.HOLD * (w - np.float32(0.3)))
    assert np.allclose(got, w, atol=1e-4)


def test_context_counts(spark):
    """What a context has seen at a node is counted exactly, on however many texts and parts."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("abé \n", k=rng.randint(0, 300))) if i % 3 else "".join(map(chr, rng.choices(range(32, 900), k=900))) for i in range(60)]
    held = [i % 5 == 0 for i in range(60)]
    code = mixing.Code(np.bincount(np.frombuffer("".join(texts).encode(), np.uint8), minlength=256))
    seen = collections.defaultdict(lambda: [0, 0])
    ways = {}
    for t, h in zip(texts, held):
        raw = bytes([mixing.END]) * mixing.PAD + t.encode() + bytes([mixing.END])
        for i in range(mixing.PAD, len(raw)):
            word = b"" if raw[i - 1] in b" \t\n\v\f\r\xff" else word + raw[i - 1 : i]
            leaf = int(code.leaf[raw[i]])
            bits = tuple(code.bits[: code.size[leaf], leaf].tolist())
            for k, ctx in enumerate((raw[i - 3 : i], raw[i - 5 : i], word)):
                ways[k, ctx, leaf] = bits
                for d, b in enumerate(bits if not h else ()):
                    seen[k, ctx, bits[:d]][b] += 1
    df = spark.createDataFrame(list(zip(range(60), held, texts)), "doc_id long, held_out boolean, text string")
    got = {}
    for parts, rows in ((1, df.coalesce(1)), (7, df.repartition(4))):
        asked = mixing.settle(mixing.ask(rows, code, parts))
        own = {(r.grp, r.k, r.part): bytes(r.blob) for r in asked.filter("k >= 0").collect()}
        for grp in {g for g, _, _ in own}:
            told = mixing.answer(asked.withColumn("grp", F.when(F.col("grp") == grp, mixing.SAMPLE).otherwise(F.col("grp"))), code)
            for r in told.filter(F.col("grp") == mixing.SAMPLE).collect():
                gram, _ = mixing.of_blob(own[grp, r.k, r.part])
                none, one = mixing.unplanes(bytes(r.blob), "<u4").reshape(2, -1).tolist()
                at = 0
                for g in gram.tolist():
                    n = int(code.size[g & 255])
                    value = (tuple(none[at : at + n]), tuple(one[at : at + n]))
                    assert got.setdefault((r.k, g), value) == value
                    at += n
    expected = sorted((k, leaf, (tuple(seen[k, ctx, bits[:d]][0] for d in range(len(bits))), tuple(seen[k, ctx, bits[:d]][1] for d in range(len(bits))))) for (k, ctx, leaf), bits in ways.items())
    assert sorted((k, g & 255, value) for (k, g), value in got.items()) == expected


def test_distinct_grams_of_a_group(monkeypatch):
    """A gram stands once in its group, however often its bytes do, with its times and places; hashes that differ in the low bits stay apart."""
    monkeypatch.setattr(mixing, "PIECE", 400)
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rng = random.Random(9)
    texts = ["".join(rng.choices(["word ", "longerword ", "é", "\n"], k=rng.choice([0, 3, 60]))).encode() for _ in range(40)]
    held = mixing.Grams(texts, places=True)
    plain = []
    for t in texts:
        raw, word = bytes([mixing.END]) * mixing.PAD + t + bytes([mixing.END]), b""
        for i in range(mixing.PAD, len(raw)):
            word = b"" if raw[i - 1] in b" \t\n\v\f\r\xff" else word + raw[i - 1 : i]
            plain.append((raw[i - 5 : i + 1], word))
    counts = collections.Counter(plain)
    assert len(held.key) == len(counts) < len(plain) / 2 and sorted(held.times.tolist()) == sorted(counts.values())
    at = np.concatenate([number[own] for own, _, number in held.pieces])
    assert [int(held.key[i]).to_bytes(6, "little") for i in at] == [k for k, _ in plain]
    assert len({(w, int(held.word[i])) for i, (_, w) in zip(at, plain)}) == len({w for _, w in plain})
    worth = np.random.default_rng(1).random((2, len(held.key)))
    ends = np.cumsum([len(t) + 1 for t in texts])
    assert np.allclose(held.sums(worth), np.add.reduceat(worth[:, at], ends - [len(t) + 1 for t in texts], axis=1))
    near = np.array([1 << 60, (1 << 60) + 1, 1 << 60, 5, (1 << 60) + 1], np.uint64)
    order, first, size = mixing.distinct(near)
    assert sorted(zip(near[order[first]].tolist(), size.tolist())) == [(5, 1), (1 << 60, 2), ((1 << 60) + 1, 2)]
    assert near[order[first]][mixing.numbers(order, size)].tolist() == near.tolist()
    own, place = mixing.ordered(near)
    assert own[place].tolist() == near.tolist() and own.tolist() == sorted(set(near.tolist()))
    assert len(mixing.Grams([]).key) == 0


def test_code_is_complete():
    size, nodes, bits = mixing.huffman(np.array([1000, 3, 0, 7] + [0] * 252))
    assert math.isclose(sum(2.0 ** -int(s) for s in size), 1.0) and size.max() <= mixing.DEPTHS


def test_markup():
    page = "<html><head><title>T</title><style>x</style></head><body><nav><a href=/>Menu</a></nav><div class='cookie-notice'>We use</div><article><h1>A &amp; B</h1><p>one<br>two  <b>three</b><p>four<script>'</p>'</script> five<!-- no --></article><section id=comments><p>First!</p></section><footer>&copy; x</footer>"
    text = [t for t, _, k in markup.lines_of(page) if k]
    assert text == ["A & B", "one two three", "four five"]
    assert [k for *_, k in markup.lines_of("<div role=main><p>a&nbsp; b</p></div><div role='Main'>c</div><p role=\"note\">d")] == [2, 2, 1]
    assert markup.lines_of("<p>a&nbsp; b")[0][0] == "a b"
    assert markup.lines_of("") == [] and [t for t, *_ in markup.lines_of("plain <b>text")] == ["plain text"]


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randint(0, 9)), rng.choices("abcd", k=rng.randint(0, 9))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pages.lcs(a, b)) == best[-1][-1]


def test_differencing(spark):
    frame = "<html><body><div class=x><p>Site name</p></div><div class=body>{}</div><div class=low><p>All rights here</p></div></body></html>"
    rows = [(i, f"http://a.org/x/{i}", frame.format("".join(f"<p>own {i} line {j} with words</p>" for j in range(6)) + "<p>Phrase</p>")) for i in range(40)]
    rows += [(100, None, None), (101, "http://b.org/", "<p>alone</p>"), (102, "http://c.org/1", ""), rows[0]]
    got = {r.page_id: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(40):
        assert got[i].text == "\n".join([f"own {i} line {j} with words" for j in range(6)] + ["Phrase"])
    assert got[100].text == got[102].text == "" and got[101].text == "alone" and got[100].n_chars == 0


def plain_texts(rows):
    """The whole extraction in plain Python: classes of equal pages, their neighbours in URL order, LCS, and what stays."""
    packed = {}
    for i, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        own = markup.lines_of(html or "")
        packed[i, url, html] = (host, path, own, tuple((t, p, k) for t, p, k in own if k))
    classes = {}
    for host, path, _, body in packed.values():
        classes[host, body] = min(classes.get((host, body), path), path)
    order = sorted((host, path, pages.class_of(host, pages.packed_lines(body)), body) for (host, body), path in classes.items())
    out = {}
    for row, (host, path, own, body) in packed.items():
        at = next(k for k, x in enumerate(order) if x[0] == host and x[3] == body)
        near = [order[k] for k in range(max(0, at - pages.REACH), min(len(order), at + pages.REACH + 1)) if k != at and order[k][0] == host]
        shared = None
        for _, other, _, lines in sorted(near, key=lambda x: -len(os.path.commonprefix([x[1], order[at][1]]))):
            common = np.zeros(len(body), bool)
            common[pages.lcs([t for t, _, _ in body], [t for t, _, _ in lines])] = True
            if shared is None or common.sum() < pages.COPY * len(body):
                shared = common
            if common.sum() < pages.COPY * len(body):
                break
        keep = pages.kept_lines(np.array([k for *_, k in body], np.int8), [p for _, p, _ in body], np.array([len(t) for t, *_ in body], int), shared)
        out[row] = "\n".join(t for (t, _, _), x in zip(body, keep) if x)
    return out


def test_extraction_against_plain_python(spark):
    """Also with fewer rows a range than a record has neighbours, and one host with most pages."""
    rng = random.Random(21)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    rows = []
    for i in range(60):
        host = "big.org" if i % 3 else f"h{i % 5}.org"
        frame = [f"<div class=n{k}><p>frame {host} {k}</p></div>" for k in range(3)]
        body = "".join(f"<p>{words(6)}</p>" for _ in range(rng.randint(0, 4))) + ("<p>a phrase of all</p>" if i % 4 == 0 else "")
        tag = rng.choice(["div class=b", "article", "main"])
        rows.append((i, f"http://{host}/{rng.choice('ab')}/{i // 2}", f"<body>{''.join(frame)}<{tag}>{body}</{tag.split()[0]}><footer>f</footer></body>" if i % 11 else None))
    rows += [rows[4], (100, rows[5][1], rows[5][2]), (101, None, "<p>x"), (102, None, "<p>x")]
    expected = plain_texts(rows)
    schema = "page_id long, url string, html string"
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = pages.main_text(spark.createDataFrame(rows, schema).repartition(3)).collect()
        assert sorted((r.page_id, r.text) for r in got) == sorted((r[0], expected[r]) for r in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert any("frame" in (r[2] or "") and "frame" not in expected[r] and expected[r] for r in rows)
    assert pages.main_text(spark.createDataFrame([], schema)).count() == 0
    wide = spark.createDataFrame([(*r, "k", "c", "x") for r in rows[:5]], schema + ", key string, cls string, text string")
    assert {r.page_id for r in pages.main_text(wide).collect()} == {r[0] for r in rows[:5]}


def test_differencing_beside_and_inside_article(spark):
    page = "<html><body><article><p>Teaser of the site</p></article><div class=body>{}</div><article><p>Own end {}</p></article></body></html>"
    rows = [(i, f"http://a.org/x/{i}", page.format("".join(f"<p>story {i} line {j}</p>" for j in range(6)), i)) for i in range(6)]
    inside = "<html><body><article><div class=sign><p>Sign up for our letters today</p></div><p>{}</p></article></body></html>"
    rows += [(10 + i, f"http://b.org/x/{i}", inside.format("</p><p>".join(f"text {i} line {j}" for j in range(5)))) for i in range(3)]
    rows += [(20, "http://c.org/1", page.format("<p>a story that is longer than both small articles are</p>", 1))]
    got = {r.page_id: r.text.split("\n") for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(6):
        assert [f"story {i} line {j}" for j in range(6)] == [x for x in got[i] if x.startswith("story")] and f"Own end {i}" in got[i]
    for i in range(3):
        assert got[10 + i] == [f"text {i} line {j}" for j in range(5)]
    assert "a story that is longer than both small articles are" in got[20]


def test_differencing_of_copies_and_short_pages(spark):
    frame = "<html><body>" + "".join(f"<div class=f{chr(97 + j)}><p>frame line {j}</p></div>" for j in range(12)) + "<div class=body><p>{}</p></div></body></html>"
    rows = [(i, f"http://a.org/x/{i:02}", frame.format("the copied story")) for i in range(9)]
    rows += [(20 + i, f"http://a.org/y/{i}", frame.format(f"short story {i}")) for i in range(4)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: "the copied story" for i in range(9)} | {20 + i: f"short story {i}" for i in range(4)}
    for tag in ("div", "article"):  # versions of one text keep it
        story = [f"line {j} of the story" for j in range(20)]
        rows = [(i, f"http://b.org/{i}", f"<html><body><{tag}><p>" + "</p><p>".join([*story, f"version {i}"]) + f"</p></{tag}></body></html>") for i in range(7)]
        got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: "\n".join([*story, f"version {i}"]) for i in range(7)}


def test_awkward_tables(spark):
    """A text of 1 MB, one word of 1 MB, repeated rows, and columns named like the operators' own: every row once, whole texts."""
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(2000)]
    long = " ".join(rng.choices(words, k=200_000))
    item = " ".join(rng.choices(words, k=12))
    texts = [long + " " + item, "z" * 1_000_000, "a line\n" * 20_000, "", None, "short text here", "short text here"]
    extra = ("key", "cls", "n", "held_out", "score", "row", "n_lines", "n_words", "n_tokens", "k", "part", "raw", "h", "fps", "words", "spread", "first")
    rows = [(i, t, rng.choice(["en", "fr"]), f"s{i}", 1, *extra) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0", 1, *extra)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in extra)).repartition(3)
    ids = sorted(r[0] for r in rows)
    told = lambda df: sorted(df.collect(), key=lambda r: r.doc_id)
    size = [len((r[1] or "").encode()) for r in sorted(rows, key=lambda r: r[0])]
    got = told(pieces.token_counts(wide, queries.vocabulary("piece_bpe_32k.model")))
    assert [r.doc_id for r in got] == ids and [r.n_bytes for r in got] == size and got[0].n_tokens == got[1].n_tokens > 200_000
    got = told(bpe.encode_decode(wide, queries.vocabulary("byte_bpe_50k.json")))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert [r.decoded_sha256 for r in got] == [digest(r[1]) for r in sorted(rows, key=lambda r: r[0])]
    got = told(mixing.score(wide))
    assert [r.doc_id for r in got] == ids and got[0].n_tokens == 200_013 and got[0].score == got[1].score
    got = told(language.identify(wide, language.train(wide, rounds=2)))
    assert [r.doc_id for r in got] == ids and [r.lang_pred == "und" for r in got] == [not any(map(str.isalpha, r[1] or "")) for r in sorted(rows, key=lambda r: r[0])]
    got = told(forest.judge(wide, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert [r.n_words for r in got][:3] == [200_012, 200_012, 1] and [r.kept for r in got] == [not r.base_failed for r in got]
    got = told(winnow.decontaminate(wide, spark.createDataFrame([(7, item)], "item_id long, text string")))
    assert [r.n_hit for r in got] == [12, 12, 0, 0, 0, 0, 0, 0] and got[0].n_words == 200_012
    assert winnow.decontaminate(wide, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0
    got = told(lines.dedup_lines(wide))
    assert [r.n_lines for r in got] == [1, 1, 1, 20_001, 1, 0, 1, 1] and got[0].key == "key" and [r.doc_id for r in got] == ids
    got = told(jaccard.jaccard_components(wide))
    assert [(r.doc_id, r.component_id) for r in got] == [(i, 5 if i == 6 else i) for i in ids] and got[2].n_shingles == 1
    long_pages = [(i, f"http://a.org/{i}", f"<body><article><p>{t or ''}</p></article></body>") for i, t in enumerate(texts)]
    got = pages.main_text(spark.createDataFrame(long_pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: " ".join((t or "").split()) for i, t in enumerate(texts)}
    got = cascade.filter_urls(spark.createDataFrame([(1, "http://a-b.net/" + "p" * 1_000_000, "x"), (1, "http://a-b.net/" + "p" * 1_000_000, "x"), (2, None, "x")], "page_id long, url string, key string"), cascade.by_host())
    assert sorted((r.page_id, len(r.path), r.verdict) for r in got.collect()) == [(1, 1_000_001, "block")] * 2 + [(2, 0, "allow")]


def test_dropping_rows(spark, docs, empty):
    """Null and shared ids, repeated rows, and columns named like the operators' own."""
    schema = "doc_id long, text string, score string, key string, cls string, n string"
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    one, two, three, four = text(), text(), text(), text()
    item = text()
    rows = [(i, t, "s", "k", "c", "n") for i, t in ((1, one), (2, one + " x"), (None, one), (None, two), (2, three), (3, four), (3, four), (4, None), (5, ""), (6, None))]
    own = sorted(jaccard.drop_near_copies(spark.createDataFrame(rows, schema)).collect(), key=repr)
    assert own == sorted([r for r in rows if r not in (rows[1], rows[2])], key=repr)
    hit = [(i, t, "s", "k", "c", "n") for i, t in ((1, one + " " + item), (1, two), (None, item), (None, three), (2, four), (2, four), (3, None), (4, ""))]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    for inline in (1000, 0):
        left = winnow.drop_hit(spark.createDataFrame(hit, schema), benchmark, inline)
        assert sorted(left.collect(), key=repr) == sorted([r for r in hit if item not in (r[1] or "")], key=repr)
    net = language.train(docs, rounds=5)
    fits = {r.doc_id: r.lang_pred != "und" and r.score >= 0.5 for r in language.identify(docs, net).collect()}
    assert len(set(fits.values())) == 2
    assert sorted(map(tuple, language.drop_unknown(docs, net, 0.5).collect()), key=repr) == sorted((tuple(r) for r in some_docs() if fits[r[0]]), key=repr)
    assert language.drop_unknown(docs, None, 0.5).count() == 0
    assert all(f(empty).count() == 0 for f in (jaccard.drop_near_copies, lambda d: winnow.drop_hit(d, benchmark), lambda d: language.drop_unknown(d, net, 0.5)))


def test_one_row_of_a_group(spark):
    schema = "doc_id long, text string, n int"
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    one, two, three = text(), text(), text()
    rows = [(None, one, 1), (None, one, 2), (None, one + " x", 3), (7, two, 4), (7, two + " y", 5), (None, two, 6), (None, three, 7), (None, None, 8), (None, " ", 9), (None, " ", 10)]
    got = [tuple(r) for r in jaccard.drop_near_copies(spark.createDataFrame(rows, schema).repartition(3)).collect()]
    assert len([r for r in got if r[2] <= 3]) == 1 and len([r for r in got if 4 <= r[2] <= 6]) == 1
    assert sorted(r[2] for r in got if r[2] > 6) == [7, 8, 9, 10] and [r[0] for r in got if 4 <= r[2] <= 6] == [7]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    ids = []
    for name, stage in cp.STAGES:
        kept = stage(spark, kept, SF)
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        if name != "bpe":
            assert kept.columns == docs.columns
    assert all(b <= a for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 100
    assert ids[-1] == {r.doc_id for r in cp.run(spark, SF).collect()}


def test_pipeline_against_plain_python(spark, tmp_path):
    """run() holds what line dedup, Jaccard join, decontamination and BPE in plain Python make of the rows that the trained net keeps."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(14)) for i in range(4)]
    bases = [text(60) for _ in range(5)]
    texts = [text(60) for _ in range(30)] + ["", "123 456", "Subscribe now"]
    for b in bases:
        texts += [b, b.upper(), b + " zz", " ".join(b.split()[:40])]
    texts += [text(20) + " " + x + " " + text(20) for _, x in items] + [text(20) + " " + " ".join(x.split()[:9]) for _, x in items]
    rows = [(i, ("Subscribe now\n" if i % 3 == 0 else "") + ("Follow us\n" if i < 2 else "") + t, rng.choice(["en", "fr"]), f"s{i % 7}", 0, "n") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {r.doc_id: (r.text, r.source) for r in cp.language_id(spark, docs, str(tmp_path)).collect()}
    assert 40 < len(left) < len(rows)
    sites, first = collections.defaultdict(set), {}
    for i in sorted(left):
        for line in left[i][0].split("\n"):
            if line.strip(" "):
                sites[line].add(left[i][1])
                first.setdefault(line, i)
    own = {i: "\n".join(x for x in t.split("\n") if len(sites[x]) < lines.SITES or first[x] == i) for i, (t, _) in left.items()}
    own = {i: t for i, t in own.items() if t.strip(" ")}
    groups = plain_components([(i, t) for i, t in own.items()])
    one = {i: t for i, t in own.items() if groups[i][1] == i}
    spans = {tuple(x.split()[k : k + 10]) for _, x in items for k in range(len(x.split()) - 9)}
    clean = {}
    for i, t in one.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        if not any(tuple(w[k : k + 10]) in spans for k in range(len(w) - 9)):
            clean[i] = t
    assert len(left) > len(one) > len(clean) and any(own[i] != left[i][0] for i in own)
    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    expected = []
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = cp.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(expected)
