"""URL lists, top-k, toxicity, quality, and the pipeline."""

import datetime
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrain.llm import common, decontaminate, quality, simhash, suffixes, topk, toxicity, urls

# --- URL lists


def plain_verdict(url, day, entries):
    if not url or day is None:
        return (False, None, None, None)
    bare = url.lower().strip("".join(map(chr, range(33)))).replace("\\", "/")
    bare = bare.split(":", 1)[1].lstrip("/") if re.match("https?:", bare) else bare.lstrip("/") if bare.startswith("//") else bare
    cut = re.split("[/?#]", bare)[0]
    host = cut.split("@")[-1].split(":")[0].rstrip(".")
    rest = bare.split("?")[0].split("#")[0]
    path = rest[rest.index("/") :] if "/" in rest else ""
    labels = host.split(".")
    keys = {host + path, *(".".join(labels[i:]) for i in range(max(1, len(labels) - 1)))}
    found = []
    entries = [(e[0], e[1] and e[1].lower(), *e[2:]) for e in entries]
    for name, key in {(e[0], e[1]) for e in entries if None not in e}:
        state, since = False, None
        for d in sorted({e[3] for e in entries if e[:2] == (name, key) and None not in e}):
            if d <= day:
                gone = any(e[2] == "remove" for e in entries if e == (name, key, e[2], d))
                if not gone and not state:
                    since = d
                state = not gone
        if state and key in keys:
            found.append((-len(key), key, name, since))
    return (True, min(found)[2], min(found)[1], min(found)[3]) if found else (False, None, None, None)


def test_url_lists(spark):
    rng = random.Random(1)
    day = lambda: datetime.date(2024, 1, 1) + datetime.timedelta(rng.randint(0, 200))
    hosts = ["a.example.com", "example.com", "b.example.com", "x.org", "www.x.org", "localhost"]
    entries = [(rng.choice(["l1", "l2"]), rng.choice([*hosts, "X.org", "x.org/bad", "A.example.com/p/q"]), rng.choice(["add", "add", "remove"]), day()) for _ in range(60)]
    entries += [entries[0], (None, "x.org", "add", day()), ("l1", "x.org", "add", None)]
    caps = [(i, rng.choice(["http://", "https://u@", "", "//", " HTTP:\\\\", "\thttp:/"]) + rng.choice(hosts) + rng.choice(["", "/", "/bad", ".", "\\bad", "\\@good.com/", "/p/q?x=1", "?a@b", ":80/bad#f "]), day()) for i in range(400)]
    caps += [(903, "http://x.org/" + "p" * 100_000, day())]
    caps += [caps[0], (900, None, day()), (901, "x.org", None), (902, "", day()), (None, "http://x.org", day())]
    df = spark.createDataFrame(caps, "page_id long, url string, fetched_at date").withColumn("blocked", F.lit("clash"))
    es = spark.createDataFrame(entries, "list string, key string, action string, listed_on date")
    got = urls.filter_urls(df, es).collect()
    want = sorted(repr((i, u, *plain_verdict(u, d, entries))) for i, u, d in caps)
    assert sorted(repr((r.page_id, r.url, r.blocked, r.matched_list, r.matched_key, r.listed_since)) for r in got) == want
    assert any(r.blocked for r in got)
    twice = [("l", "Example.com", "add", datetime.date(2024, 1, 1)), ("l", "example.com", "remove", datetime.date(2024, 2, 1))]
    one = spark.createDataFrame([(1, "http://example.com", datetime.date(2024, 3, 1))], df.drop("blocked").schema)
    assert urls.filter_urls(one, spark.createDataFrame(twice, es.schema)).where("blocked").count() == 0
    assert urls.filter_urls(df, es.limit(0)).where("blocked").count() == 0 and urls.filter_urls(df.limit(0), es).count() == 0


# --- top-k


@pytest.mark.parametrize("shard, block", [(64, 1000), (10, 3)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (300, 6)) / 16
    v[7] = v[50]
    v[100] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1050, [None] * 6), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [1.0, 2.0]), (1201, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")), shard=shard, block=block).collect()
    q = {i: np.floor(256 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()}
    want = set()
    for a, x in q.items():
        if a % 50 == 0:
            best = sorted((-int(x @ y), b) for b, y in q.items() if b != a and len(y) == len(x))[:5]
            want |= {(a, n, b, -s) for n, (s, b) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_large_numbers_and_repeated_rows(spark):
    rng = random.Random(6)
    rows = [(0, [1e30, 1e30]), (1, [1e30, 2.0]), (2, [1.0, 2.0]), (3, [-1e30, 5.0]), (4, [1e300, 1e308]), (50, [2.0**40 + 0.5, -(2.0**39)])]
    rows += [(i, [rng.uniform(-1, 1) * 2.0**33, float(rng.randint(-9, 9))]) for i in range(60, 120)] + [(200, [1e30, 1e30])] * 9 + [(0, [1e30, 1e30])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = lambda x: int(Fraction(x) * 256 // 1)
    q = [(i, [*map(whole, x)]) for i, x in rows]
    want = []
    for a, x in dict(q).items():
        if a % 50 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y)), b) for b, y in q if b != a)[:5]
            want += [(a, n, b, max(-(2**63), min(2**63 - 1, -s))) for n, (s, b) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    v = np.zeros((10_000, 4))
    v[:, 0] = rng.permutation(10_000)
    shard = topk.Shard(np.arange(10_000), v)
    scores, ids = shard.search(np.array([1.0, 0, 0, 0]), -1, 5)
    assert sorted(scores.tolist()) == [9995, 9996, 9997, 9998, 9999]
    assert shard.scored[0] < 100


# --- toxicity


def labelled(rng, n=1500):
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["zork", "blarg", "quux"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        w = rng.choices(words, k=rng.randint(3, 40))
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def plain_toxicity(docs, labels):
    """Scores by dense vectors over all words of the examples: the operator's rules, without an index."""
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1:
            known[i] = max(y, known.get(i, 0))
    counts = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in docs]
    own = sorted(((i, known[i], c) for i, c in counts if i in known), key=lambda e: (e[0] * 0x9E3779B97F4A7C15 % (1 << 64), e[1], sorted(e[2].items())))
    aside = [e for y in (0, 1) for e in [x for x in own if x[1] == y][toxicity.ASIDE - 1 :: toxicity.ASIDE]]
    examples = sorted((e for e in own if not any(e is x for x in aside)), key=lambda e: e[:2])
    words = sorted({w for *_, c in examples for w in c})
    n = [sum(y == label for _, y, _ in examples) for label in (0, 1)]
    weight = []
    for w in words:
        o = [sum(w in c for _, y, c in examples if y == label) for label in (0, 1)]
        table = [[o[0], n[0] - o[0]], [o[1], n[1] - o[1]]]
        g = sum(2 * x * math.log(x * sum(n) / (sum(table[i]) * (table[0][j] + table[1][j]))) for i in (0, 1) for j in (0, 1) if (x := table[i][j]))
        weight.append(math.log((1 + len(docs)) / sum(w in c for _, c in counts)) * (0.2 + math.sqrt(max(0, g - 8))))

    def unit(c):
        v = np.array([(1 + math.log(c[w])) * x if w in c else 0.0 for w, x in zip(words, weight)])
        return v / np.linalg.norm(v) if v.any() else v

    dense = np.array([unit(c) for *_, c in examples])
    prior = (sum(known.values()) + 1) / (len(known) + 2)
    stands = [sum(y == label for y in known.values()) / max(1, sum(e[1] == label for e in own)) for label in (0, 1)]

    def vote(c):
        cos = np.round(dense @ unit(c), 9)
        near = [i for i in sorted(range(len(cos)), key=lambda i: (-cos[i], i)) if cos[i] > 0][: toxicity.NEIGHBOURS]
        v = [0.05 * (1 - prior), 0.05 * prior]
        for i in near:
            v[examples[i][1]] += stands[examples[i][1]] * cos[i] / (1.02 - cos[i])
        return v[1] / sum(v), [(examples[i][0], cos[i]) for i in near]

    pairs = sorted((vote(c)[0], y, stands[y]) for _, y, c in aside if vote(c)[1])
    level = [max(min(sum(w * y for _, y, w in pairs[i : j + 1]) / sum(w for *_, w in pairs[i : j + 1]) for j in range(b, len(pairs))) for i in range(b + 1)) for b in range(len(pairs))]
    pools = {}
    for (v, _, w), p in zip(pairs, level):
        pools.setdefault(round(p, 12), []).append((v, w))
    at = sorted((sum(v * w for v, w in vs) / sum(w for _, w in vs), p) for p, vs in pools.items())
    return [(i, float(np.interp(vote(c)[0], *zip(*at))) if vote(c)[1] else prior, vote(c)[1]) for i, c in counts]


def test_toxicity_is_the_plain_one(spark):
    docs, labels = labelled(random.Random(8), 400)
    docs += [(7001, None), (7002, "unheard zork"), (7003, docs[4][1]), (5, docs[6][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score(df, toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    want = plain_toxicity(docs, labels)
    key = lambda r: (r[0], round(r[1], 6))
    got, want = sorted(((r.doc_id, r.score, r.evidence) for r in got), key=key), sorted(want, key=key)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-7)
        assert [e.similarity for e in g[2]] == pytest.approx([x for _, x in w[2][:3]], abs=1e-8)


def test_toxicity(spark):
    docs, labels = labelled(random.Random(3))
    odd = [(5000, None), (5001, ""), (None, "zork zork"), (5002, "zork " * 50_000), (0, docs[0][1]), (5003, "!?")]
    df = spark.createDataFrame([*docs, *odd], "doc_id long, text string")
    ls = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    index = toxicity.learn(df, ls)
    assert {"zork", "blarg", "quux"} <= set(index.words) and len(index.words) == 303
    got = toxicity.score(df, index).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    right = [r.predicted == held[r.doc_id] for r in got if r.doc_id in held]
    assert sum(right) / len(right) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[5002].predicted == 1 and by[None].evidence
    assert all(by[i].score == index.prior and by[i].evidence == [] for i in (5000, 5001, 5003))
    assert all(r.evidence for r in got if r.doc_id is not None and r.doc_id < 5000)
    none = toxicity.learn(df, ls.limit(0))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(df.limit(0), index).count() == 0
    one = toxicity.learn(df, ls.where("toxic = 1"))
    assert all(r.score > 0.5 for r in toxicity.score(df, one).collect())


@pytest.mark.parametrize("frequent, block", [(384, 128), (8, 16), (0, 7)])
def test_blocks_give_the_exact_neighbours(monkeypatch, frequent, block):
    monkeypatch.setattr(toxicity, "_FREQUENT", frequent)
    rng = random.Random(4)
    names = [f"t{i}" for i in range(60)]
    examples = [(i, rng.randint(0, 1), {t: rng.randint(1, 4) for t in rng.sample(names, rng.randint(0, 9))}) for i in range(900)]
    examples += [(i + 2000, 0, examples[i][2]) for i in range(60)]
    index = toxicity.Index({t: rng.uniform(1, 5) ** 2 for t in names}, examples, block=block)
    dense = np.zeros((len(index.ids), len(names)))
    for i, n in enumerate(index.ends):
        at = slice(n - index.lengths[i], n)
        dense[i, index.own[at]] = index.own_weight[at]
    queries = [*(c for *_, c in examples[:150]), {"other": 1}, {}]
    for c, got in zip(queries, index.nearest(queries), strict=True):
        ids, q = index.vector(c)
        s = np.round(dense[:, ids] @ q, 9) if len(ids) else np.zeros(len(dense))
        want = sorted((-x, index.ids[i]) for i, x in enumerate(s) if x > 0)[: toxicity.NEIGHBOURS]
        assert [x for x, _ in got] == pytest.approx([-x for x, _ in want], abs=1e-8)
        assert len({index.ids[i] for _, i in got}) == len(got)


def test_blocks_that_cannot_reach_the_kth_are_skipped():
    rng = random.Random(9)
    topics = [[f"{t}{i}" for i in range(30)] for t in "abcd"]
    examples = [(i, i % 2, dict.fromkeys(rng.sample(topics[i % 4], 12), 1)) for i in range(400)]
    index = toxicity.Index(dict.fromkeys([w for t in topics for w in t], 1.0), examples, block=20)
    near = index.nearest([dict.fromkeys(rng.sample(topics[1], 12), 1) for _ in range(5)])
    assert all(len(x) == toxicity.NEIGHBOURS and all(index.ids[i] % 4 == 1 for _, i in x) for x in near)
    assert index.opened[0] <= index.opened[1] / 2


# --- quality


def test_quality(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        w = rng.choices(words, k=rng.randint(20, 60))
        docs.append((i, " ".join(w if good else [x + rng.choice(["###", "$$", "|"]) for x in w]), "en", "a" if good == (rng.random() < 0.8) else "b"))
        labels.append((i, int(good)))
    odd = [(5000, None, None, None), (5001, "", "en", "a"), (None, docs[0][1], "en", "a"), (0, *docs[0][1:])]
    odd += [(5002, "word line\n" * 20_000, "en", "b")]
    df = spark.createDataFrame([*docs, *odd], "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))
    ls = spark.createDataFrame([*labels, (1, None), (4, 7)], "doc_id long, quality int")
    held = {i: y for i, y in labels if i % 3 == 0}
    seen = quality.features(df)
    model = quality.learn(seen, ls.where("doc_id % 3 = 1"))
    got = quality.score(seen, model).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    right = [r.predicted == held[r.doc_id] for r in got if r.doc_id in held]
    assert sum(right) / len(right) > 0.95
    # both views are calibrated, on some 60 rows: means of scores are about the share of good ones
    for name in ("score", "text_score", "meta_score"):
        assert np.mean([r[name] for r in got if r.doc_id in held]) == pytest.approx(np.mean([*held.values()]), abs=0.15)
    none = quality.learn(seen, ls.limit(0))
    assert quality.score(seen, none).select("score").distinct().count() == 1
    assert quality.score(quality.features(df.limit(0)), model).count() == 0


def plain_views(text, source, lang):
    words, lines, n = re.findall(r"\w+", text), text.split("\n"), len(text)
    a, b = [0.0] * 268, [0.0] * 88
    if n:
        m = max(1, len(words))
        size = [len(w) for w in words] or [0]
        most = [words.count(w) for w in set(words)]
        mean = sum(size) / len(size)
        a[:12] = [
            sum(not re.match(r"[\w\s.,;:!?'\"()-]", c) for c in text) / n * 10, text.count("|") / n * 20, sum(c in "!?" for c in text) / n * 20, sum(c in ".," for c in text) / n * 10,
            sum(w.isupper() for w in words) / m, sum(c.isdigit() for c in text) / n * 5, len(set(words)) / m, max(most, default=0) / m, mean / 10,
            math.sqrt(sum((x - mean) ** 2 for x in size) / len(size)) / 10, sum(c * c for c in most) / m**2 * 10, min(len(words), 200) / 200,
        ]
        for w in words:
            a[12 + zlib.crc32(w.lower().encode()) % 256] += 5 / m
    size = [len(x) for x in lines]
    mean = sum(size) / len(size)
    again = [x for x in lines if lines.count(x) > 1]
    b[:8] = [
        math.log1p(n) / 10, math.log1p(len(lines)) / 5, math.log1p(mean) / 8, math.log1p(math.sqrt(sum((x - mean) ** 2 for x in size) / len(size))) / 8,
        1 - len(set(lines)) / len(lines), max(lines.count(x) for x in lines) / len(lines), size.count(0) / len(lines), sum(map(len, again)) / max(1, n),
    ]
    b[8 + zlib.crc32((source or "").encode()) % 64] = b[72 + zlib.crc32((lang or "").encode()) % 16] = 1.0
    return a, b


def test_quality_is_the_plain_one(spark):
    rng = random.Random(15)
    words = ["ab", "Cde", "XY", "x|", "9", "no!", "é,", "$"]
    rows = [(i, rng.choice([None, "", *["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 5))) for _ in range(6)]]), rng.choice(["en", None]), rng.choice("ab")) for i in range(400)]
    rows += [rows[7], (8, "another", "en", "a"), (None, "no id", None, None)]
    good = {i: int(len(t or "") % 3 > 0) for i, t, *_ in rows[:120]}
    views = [plain_views(t or "", s, la) for _, t, la, s in rows]
    views = [np.array([v[k] for v in views], np.float32).astype(float) for k in (0, 1)]
    known = np.array([i in good for i, *_ in rows])
    own = sorted(np.flatnonzero(known), key=lambda j: (zlib.crc32(str(rows[j][0]).encode()), rows[j][0], good[rows[j][0]], views[0][j].tolist(), views[1][j].tolist()))
    y = np.array([float(good[rows[j][0]]) for j in own])
    one = lambda x, w: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ w[:-1]) + w[-1]))))
    inside = [j for k, j in enumerate(own) if k % 5 != 4]
    weights = [quality.fit(v[inside], y[[k for k in range(len(own)) if k % 5 != 4]]) for v in views]
    for _ in range(quality.ROUNDS):
        new = []
        for learner in (0, 1):
            v, w, other = views[learner], weights[learner], weights[1 - learner]
            train = [(v[j], good[rows[j][0]], 1.0) for j in inside]
            sure = [(j, int(p > 0.5)) for j in np.flatnonzero(~known) for p in [one(views[1 - learner][j], other)] if max(p, 1 - p) >= quality.SURE]
            for label in (0, 1):
                part = [j for j, t in sure if t == label]
                train += [(v[j], label, quality.HEAVY * sum(good[rows[k][0]] == label for k in inside) / len(part)) for j in part]
            ridge = np.array([1.0] * v.shape[1] + [1e-3])
            grad, curve = ridge * w, np.diag(ridge)
            for x, t, h in train:
                p, x1 = one(x, w), np.append(x, 1.0)
                grad, curve = grad + h * (p - t) * x1, curve + h / 4 * np.outer(x1, x1)
            new.append(w - np.linalg.solve(curve, grad))
        weights = new
    aside, t = [j for k, j in enumerate(own) if k % 5 == 4], y[4::5]
    z = [np.array([max(-30, min(30, v[j] @ w[:-1] + w[-1])) for j in range(len(rows))]) for v, w in zip(views, weights)]
    cal = [quality.fit(x[aside][:, None], t, 0.01) for x in z]
    z = [np.clip(x * c[0] + c[1], -30, 30) for x, c in zip(z, cal)]
    both = quality.fit(np.column_stack([x[aside] for x in z]), t, 0.1)
    want = [1 / (1 + np.exp(-x)) for x in (z[0] * both[0] + z[1] * both[1] + both[2], *z)]
    seen = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = quality.score(seen, quality.learn(seen, spark.createDataFrame([*good.items()], "doc_id long, quality int"))).collect()
    key = lambda r: (repr(r[0]), r[1])
    got, want = sorted(((r.doc_id, r.score, r.text_score, r.meta_score) for r in got), key=key), sorted(zip([r[0] for r in rows], *want), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:], abs=1e-6)


def test_digits_of_the_whole_text_count():
    table = "abc 12345\n" * 2000  # as wide as a stride of 10 steps
    assert quality.text_features(table)[5] == pytest.approx(0.5 * 5)


# --- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    stock = {"en": ["the", "tion", "ing", "and", "er"], "de": ["der", "sch", "ein", "ung", "ich"]}
    text = lambda la, n: " ".join("".join(rng.choices(stock[la], k=rng.randint(1, 3))) + str(rng.randint(0, 99) or "") for _ in range(n))
    shared = text("en", 40)
    rows = [(i, text(la, 50), la) for i, la in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[3][1], "de"), (201, text("en", 30) + "\n" + shared, "en"), (202, text("en", 30) + "\n" + shared, "en"), (203, "123 456", "en"), (204, None, "en")]
    item = " ".join(rows[10][1].split(" ")[5:25])
    docs = spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, t, la in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held, at = {}, common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        at = common.stored(stage(spark, at, folder))
        held[name] = at.collect()
        if name != "BPE":
            assert at.columns == docs.columns
    ids = {n: {r.doc_id for r in rs} for n, rs in held.items()}
    every = {r[0] for r in rows}
    assert every - ids["language ID"] == {203, 204}
    from test_text_operators import plain_languages

    plain = {i: la for i, la, *_ in plain_languages(rows, 12.0)}
    assert all(r.lang == plain[r.doc_id] for r in held["language ID"])
    fp = {i: int(simhash.fingerprints([t.encode()])[0]) for i, t, _ in rows if i in ids["language ID"]}
    kept = set()
    for i in sorted(fp):
        if not any((fp[i] ^ fp[j]).bit_count() <= 2 for j in sorted(fp) if j < i):
            kept.add(i)
    assert ids["SimHash near-dedup"] == kept and 200 not in kept
    seen = set()
    for i, t in sorted((r.doc_id, r.text.encode()) for r in held["SimHash near-dedup"]):
        spans = []
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                spans.append((k, k + 100))
            seen.add(t[k : k + 100])
        left = suffixes.cut(t, spans)[0].decode(errors="ignore")
        assert {r.doc_id: r.text for r in held["suffix-array dedup"]}[i] == left
    assert ids["suffix-array dedup"] - ids["benchmark decontamination"] == {10}
    words = decontaminate.words(rows[10][1].encode())
    assert len(words) >= 50
    assert ids["BPE"] == ids["benchmark decontamination"]
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "ids_sha256").collect()} == {(r.doc_id, r.ids_sha256) for r in held["BPE"]}


def test_pipeline_cases(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(1, "one item of a benchmark"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    long = "many words of a long text that repeat " * 3000
    rows = [(1, "a text in some words", "en", "s"), (1, "a text in some words", "en", "s"), (2, None, "en", None), (3, "", None, "s"), (None, "words without an id", None, "s"), (4, long, "en", "s"), (5, "42", "en", "s")]
    # neither n_chars nor clean names of further columns
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("lang_pred", "n_hit", "bucket", "th", "fp", "n_tokens", "__text")})
    for df, some in ((docs, True), (docs.limit(0), False)):
        at = df
        for name, stage in corpus_pipeline.STAGES:
            at = common.stored(stage(spark, at, folder))
            assert at.columns == list(corpus_pipeline.COLUMNS) or name == "BPE"
            assert (at.count() > 0) == some
    ids = sorted(repr(r.doc_id) for r in common.stored(corpus_pipeline.near_duplicates(spark, docs, folder)).collect())
    assert ids == sorted(map(repr, [1, 2, 4, 5, None]))


def test_teaching_keeps_what_labels_tell():
    # many rows of which the teacher is sure, few of one label: a full Newton step would overshoot here
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.85).astype(float)
    a = np.zeros((400, 268))
    a[:, 0] = y + rng.normal(scale=0.2, size=400)
    b = np.zeros((400, 88))
    b[:, 0] = y + rng.normal(scale=0.9, size=400)
    more = (rng.random(4000) < 0.85).astype(float)
    pool = np.zeros((4000, 268)), np.zeros((4000, 88))
    pool[0][:, 0], pool[1][:, 0] = more + rng.normal(scale=0.2, size=4000), more + rng.normal(scale=0.9, size=4000)
    model = quality.co_train((a, b), y, lambda w: quality.taught(pool, w, quality.SURE))
    assert (((model.scores(*pool)[0] >= 0.5) == more).mean()) > 0.97
