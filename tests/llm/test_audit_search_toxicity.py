"""Divergence audit, ranked search and toxicity against brute force, on odd rows and on ties."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.llm import divergence as dv
from rillet.llm import lexical_search as ls
from rillet.llm import queries
from rillet.llm import toxicity as tx
from rillet.llm.terms import LETTERS, LETTERS_DIGITS, term_runs

SCHEMA = ("doc_id bigint, text string, lang string, source string, n bigint, ids string, term string, rank int, item_id string, "
          "score string, value string, y string, share string, held_out string")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_terms(text, digits):
    kind = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" if digits else r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return re.findall(kind, (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, clashing columns."""
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "Ärger", "ÉTÉ", "x1", "x2", "don't", "日本", "a-b", "IDIOT"] + [f"w{i}" for i in range(30)]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 60), p=p / p.sum())) for _ in range(150)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4]) for i, t in enumerate(texts)]
    rows += [(200, None, "en", "a"), (201, "", "xx", "only empty"), (202, " \x00 12 ", None, None), (None, "the of w1", "en", "a"),
             (None, None, None, None), (203, "the x1 " * 30_000, "en", "b"), (7, texts[7], "de", "c"), (7, texts[8], "de", "c"),
             *[(300 + i, "the w1 w2", "en", "hot") for i in range(40)]]
    return spark.createDataFrame([(*r, 1, "i", "t", 1, "m", "s", "v", "y", "h", "o") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_terms_are_those_of_the_pattern():
    for text in ("A-b C3 ÀÉ\x00x\x7fy 日本語1", "", "  ", "don't STOP", "a" * 50 + " b" * 500):
        for table, digits in ((LETTERS, False), (LETTERS_DIGITS, True)):
            got = [w.decode() for run in term_runs(text.encode(), table, piece=16) for w in run]
            assert got == brute_terms(text, digits)


def brute_divergence(rows, min_docs, top):
    rows = [(g or "", s or "", brute_terms(t, False)) for _, t, g, s in rows]
    df = Counter((g, w) for g, _, ws in rows for w in set(ws))
    kept = defaultdict(list)
    for (g, w), n in df.items():
        if n >= min_docs:
            kept[g].append(w)
    count = Counter((g, s, w) for g, s, ws in rows for w in ws)
    groups = {(g, s) for g, s, _ in rows}

    def price(counts, terms):
        total = sum(counts.get(w, 0) for w in terms)
        return {w: 1 + 10**9 * (counts.get(w, 0) + 2) // (total + 2 * len(terms)) for w in terms}

    def apart(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    prices = {(g, s): price({w: count[g, s, w] for w in kept[g]}, kept[g]) for g, s in groups}
    for g, s in groups:
        whole = price({w: sum(count[g, t, w] for h, t in groups if h == g) for w in kept[g]}, kept[g])
        pairs = [(-sum(apart(prices[g, s][w], prices[g, t][w]) for w in kept[g]), t.encode()) for h, t in groups if h == g and t != s]
        terms = [(-apart(prices[g, s][w], whole[w]), w.encode()) for w in kept[g] if count[g, s, w] and prices[g, s][w] > whole[w]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(g, s, part, t.decode(), -v, i + 1) for i, (v, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "block", "tile", "held"), [(10, 1 << 15, 16, 10_000), (2, 4, 2, 3), (1000, 8, 1, 50)])
def test_divergence_by_brute_force(odd, none, monkeypatch, min_docs, block, tile, held):
    for name, value in (("BLOCK_IDS", block), ("TILE", tile), ("HELD", held)):
        monkeypatch.setattr(dv, name, value)
    want = brute_divergence(rows_of(odd), min_docs, 10)
    assert sorted(map(tuple, dv.divergence(odd, min_docs).collect())) == want
    if min_docs == 2:
        assert dv.divergence(none).count() == 0
        assert dv.divergence(none).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_prices_are_exact_for_counts_beyond_floats():
    for total, size, count in itertools.product((0, 5, 10**13 + 7, 9 * 10**15 - 1), (1, 3, 10**7), (0, 1, 12_345_678_901)):
        count = min(count, total)
        assert dv.prices(np.array([count]), total, size)[0] == 1 + 10**9 * (count + 2) // (total + 2 * size)


def test_galloping_finds_what_both_have():
    rng = np.random.default_rng(4)
    for n, m, top in ((0, 5, 9), (1, 1, 1), (3, 4000, 5000), (700, 900, 1000), (2000, 2001, 10**9), (600, 600, 600)):
        a, b = (np.sort(rng.choice(np.arange(top) if top < 10**6 else rng.integers(0, top, 10 * k).tolist(), k, replace=False)) if k else
                np.zeros(0, np.int64) for k in (min(n, top), min(m, top)))
        a, b = np.unique(a), np.unique(b)
        x, y = dv.gallop(a, b, run=8)
        assert (a[x] == b[y]).all() and np.array_equal(a[x], np.intersect1d(a, b))


def brute_search(rows, items, top):
    docs = [(i, Counter(brute_terms(t, True))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(brute_terms(t, True))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                    for w in terms if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize(("tree", "leaf", "top", "block"), [(8192, 16, 50, 200_000), (20, 2, 3, 4), (64, 1, 7, 10)])
def test_search_by_brute_force(spark, odd, none, monkeypatch, tree, leaf, top, block):
    for name, value in (("TREE_DOCS", tree), ("LEAF", leaf), ("BLOCK_TERMS", block), ("SALTS", 3)):
        monkeypatch.setattr(ls, name, value)
    items = [(1, "the w1, the W2!"), (2, "Ärger über ÉTÉ x1"), (3, None), (4, ""), (5, "unknown"), (None, "the"), (1, "w3"),
             (6, " ".join(f"w{i}" for i in range(30))), (7, "日本 1 2 x2")]
    asked = spark.createDataFrame([(i, t, 1, "s") for i, t in items], "item_id bigint, text string, doc_id int, term string")
    want = brute_search(rows_of(odd), items, top)
    got = [tuple(r) for r in ls.ranked_search(odd, asked, top).collect()]
    key = lambda r: (r[0], r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    if top == 50:
        assert ls.ranked_search(none, asked).count() == 0
        assert ls.ranked_search(odd, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 12, 600)
    ranks = np.concatenate([np.sort(rng.choice(40, k, replace=False, p=(p := 1 / np.arange(1, 41)) / p.sum())) for k in sizes])
    tree = ls.DocumentTree(ranks, rng.integers(1, 9, ranks.size), np.cumsum(sizes), rng.integers(50, 400, 600), 40)
    asked, weight = np.array([1, 5, 17, 30]), np.array([10, 400, 900, 2000])
    below = {}
    for node in range(len(tree.children) - 1, -1, -1):
        docs = tree.documents[node]
        below[node] = docs if docs is not None else np.concatenate([below[c] for c in tree.children[node]])
        assert tree.bounds(np.array([node]), asked, weight)[0] >= tree.exact(below[node], asked, weight).max()
    assert sorted(below[0]) == list(range(600))
    seen = []
    exact = tree.exact
    tree.exact = lambda docs, *a: seen.extend(docs) or exact(docs, *a)
    best = ls.Best(5)
    tree.search(asked, weight, best, np.zeros(600, np.int64), np.arange(600))
    every = exact(np.arange(600), asked, weight)
    assert best.id.tolist() == np.lexsort((np.arange(600), -every))[:5].tolist() and len(seen) < 300


def brute_features(text, names):
    words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))
    found = Counter()
    for word, n in words.items():
        raw = b"<" + word.encode()[:64] + b">"
        for part in {raw, *(raw[i:j] for i in range(len(raw)) for j in range(i + 4, min(i + 10, len(raw)) + 1))}:
            found[part] += n
    total = words.total()
    return [i for i, (p, level) in enumerate(names)
            if found[p] > 0 and (level == 0 or (level == 1 and found[p] > 1) or (level == 2 and 100 * found[p] >= total))]


def test_features_by_brute_force():
    names = [(p, level) for p in (b"<idio", b"diot>", b"<idiot>", b"rgerl", b"<x>", "<été>".encode()) for level in range(3)]
    features = tx.Features(names)
    for text in ("", "an IDIOT", "idiot idiots " * 3 + "word " * 700, "x été ÉTÉ Ärgerlich", "idiot " + "w " * 300):
        assert features.of(text.encode()) == brute_features(text, names)


def test_unlabelled_toxic_rows_do_not_pull_the_margin_down():
    """The risk estimator's point: with a third of the unlabelled rows positive, positives still score over a half."""
    rng = np.random.default_rng(8)
    positive = [np.array([0, *rng.integers(1, 20, 3)]) for _ in range(300)]
    clean = [rng.integers(1, 20, 4) for _ in range(600)]
    hidden = [np.array([0, *rng.integers(1, 20, 3)]) for _ in range(300)]
    w = tx.fit_margin(positive, clean + hidden, 20, prior=1 / 3, seed=0)
    margin = [w[x].sum() + w[-1] for x in hidden], [w[x].sum() + w[-1] for x in clean]
    assert min(margin[0]) > 0 > max(margin[1])


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_finds_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    got = queries.QUERIES["op11_toxicity"](spark, d).toPandas()
    assert got["doc_id"].is_unique and len(got) == 10_000 and got["score"].between(0, 1).all()
    assert got["held_out"].tolist() == [held(i) for i in got["doc_id"]]
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    told = got[got["held_out"] & got["doc_id"].isin(labels.index)]
    toxic = told["doc_id"].map(labels) == 1
    assert told.loc[toxic, "predicted"].mean() > 0.85 and told.loc[~toxic, "predicted"].mean() < 0.02


def test_toxicity_of_odd_rows(spark, odd, none):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 12)) + (" you moron" if i % 4 == 0 else "") for i in range(400)]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in enumerate(texts)], "doc_id bigint, text string, score int, y string")
    told = [(i, 1 if i % 4 == 0 else 0, 5) for i in range(300)]
    told += [(None, 1, 5), (5, None, 5), (9999, 1, 5), (0, 0, 5), (0, 1, 5)]
    labels = spark.createDataFrame(told, "doc_id bigint, toxic int, held_out int")
    got = {r.doc_id: r for r in tx.toxicity(docs, labels).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    # Labels of held-out rows are never read: other ones give the same scores.
    other = spark.createDataFrame([(i, 1 - y if i is not None and held(i) else y, 5) for i, y, _ in told if y is not None], labels.schema)
    assert {i: r.score for i, r in got.items()} == {r.doc_id: r.score for r in tx.toxicity(docs, other).collect()}
    # Whatever the table: a row for each row, null and empty texts alike, equal rows alike.
    rows = tx.toxicity(odd, labels.unionByName(odd.select("doc_id", F.lit(0).alias("toxic"), F.lit(1).alias("held_out")))).collect()
    assert len(rows) == odd.count() and {r.held_out for r in rows if r.doc_id is None} == {True}
    score = {r.doc_id: r.score for r in rows}
    assert score[200] == score[201] == score[202]
    assert [r.score for r in tx.toxicity(odd, labels.limit(0)).collect()] == [0.0] * odd.count()
    assert tx.toxicity(none, labels).count() == tx.toxicity(none, labels.limit(0)).count() == 0
