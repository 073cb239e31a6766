"""The operators against brute force on small tables with nulls, empty texts, repeats and clashing columns."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rillet.llm import anchors, bwt, queries
from rillet.llm import exact_dedup as ed
from rillet.llm import language_id as li
from rillet.llm import line_dedup as ld
from rillet.llm import minhash_dedup as md
from rillet.llm import quality_classifier as qc
from rillet.llm import quality_rules as qr
from rillet.llm import sentencepiece_codec as sc
from rillet.llm import source_mix as sm
from rillet.llm import suffix_dedup as sd
from rillet.llm import token_shards as ts
from rillet.plans import physical_plan

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept string, host string"
LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(3000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, LONG, "en", "a"), (2, LONG, "en", "a"), (3, LONG + " end", None, None), (4, None, "de", "b"),
        (5, "", "de", "b"), (6, " \t\n ", "de", None), (7, "one", "en", "a"), (8, "ONE", "en", "a"), (9, "one two", "fr", "b"),
        (10, "x" * 700, "en", "b"), (11, "ab" * 300, "en", "b"), (12, "▁mark \x00 é中\U0001f600\n\n z  ", "fr", "c"),
        (None, LONG[:400], "en", "a"), (None, None, None, None), (7, "one", "en", "a")]
    return spark.createDataFrame([(i, t, g, s, 1, "d", "k", "h") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_string_classes_are_those_of_equal_strings():
    rng = np.random.default_rng(1)
    for trial in range(120):
        text = rng.integers(1, rng.integers(2, 5), rng.integers(1, 200)).astype(np.uint8)
        if trial % 3 == 0:
            text = np.tile(text[: max(1, text.size // 7)], 8)
        length = int(rng.integers(1, 30))
        raw = text.tobytes()
        pairs = set(zip(bwt.string_classes(text, length).tolist(), [raw[i:i + length] for i in range(text.size)], strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_runs_hold_every_window_once():
    rng = np.random.default_rng(2)
    for _ in range(40):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 400)).astype(np.uint8)) for _ in range(5)]
        raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
        start, n, _, _ = anchors.runs(raw, ends, 100)
        got = sorted(p for s, k in zip(start.tolist(), n.tolist(), strict=True) for p in range(s, s + k))
        assert got == [int(e) - len(t) + p for t, e in zip(texts, ends, strict=True) for p in range(max(0, len(t) - 99))]


def brute_spans(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        left = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix_dedup(spark, odd, none, hot, monkeypatch):
    monkeypatch.setattr(sd, "HOT_RUNS", hot)  # 1: every shared anchor is parted by a second one
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           sd.repeated_spans(odd.where("doc_id IS NOT NULL")).collect()}
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    assert got == brute_spans(texts.items())
    lone = sd.repeated_spans(odd).where("doc_id IS NULL").collect()
    assert sorted((r.n_bytes, r.n_removed) for r in lone) == [(0, 0), (400, 0)]
    whole = {r.doc_id: r for r in sd.repeated_spans(odd.where("doc_id IN (1, 2)"), with_text=True).collect()}
    assert bytes(whole[2].kept_bytes) == b"" and all(
        hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in whole.values())
    assert sd.repeated_spans(none).count() == 0


def test_suffix_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op1_suffix_dedup"](spark, SMALL).collect()}
    assert got == brute_spans((r.doc_id, r.text) for r in docs.collect())


def test_a_line_in_many_documents_is_never_transformed_whole(spark, monkeypatch):
    bound, transform = 1 << 14, sd.first_windows

    def bounded(texts, *rest):
        assert sum(map(len, texts)) <= bound, sum(map(len, texts))
        return transform(texts, *rest)

    for name, value in (("HOT_RUNS", 20), ("CHUNK", bound), ("first_windows", bounded)):
        monkeypatch.setattr(sd, name, value)
    rng = np.random.default_rng(7)
    line, near = ("".join(map(chr, rng.integers(97, 123, n))) for n in (90, 60))
    # Neighbours of its own in most documents, the same on one side in some, the line twice in some.
    texts = ["".join(map(chr, rng.integers(97, 123, 150))) + (near if i % 5 == 0 else "") + line
             + "".join(map(chr, rng.integers(97, 123, 150))) + (line if i % 9 == 0 else "") for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeated_spans(docs).collect()}
    want = brute_spans(enumerate(texts))
    assert got == want and sum(n for _, n, _, _ in want.values()) > 0


def brute_components(rows, n_words=2):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets[i] = set(zip(*[w[k:] for k in range(n_words)], strict=False)) if len(w) >= n_words else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


def test_minhash_dedup(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.QUERIES["op4_minhash_dedup"](spark, SMALL).collect()}
    assert got == brute_components((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in md.near_duplicates(odd, n_words=2).collect()}
    assert got == brute_components({r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}.items())
    assert md.near_duplicates(none).count() == 0
    assert md.keep_one_of_each(none).columns == none.columns


def test_links_between_others_than_the_smallest_member_are_found(spark):
    base = [f"t{i}" for i in range(200)]
    chain = [" ".join(base[k * 12:] + [f"u{j}" for j in range(k * 12)]) for k in range(8)]
    docs = spark.createDataFrame([(10 - k, t) for k, t in enumerate(chain)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in md.near_duplicates(docs, n_words=2).collect()}
    assert got == brute_components(((10 - k, t) for k, t in enumerate(chain)))


def test_exact_dedup(spark, odd, none, tmp_path):
    got = ed.exact_dedup(odd).collect()
    assert len(got) == odd.count()
    norm = {}
    for r in odd.collect():
        t = re.sub("[\x20\x09-\x0d]+", " ", r.text or "")
        norm.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(r.doc_id)
    for r in got:
        ids = norm[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(norm)  # of repeated rows one stays
    left = ed.keep_first(odd)
    assert left.columns == odd.columns and left.count() == len(norm)
    assert ed.exact_dedup(none).count() == 0
    index = ed.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    ed.exact_dedup(odd.where("doc_id <= 3"), index).count()
    again = {r.doc_id: r for r in ed.exact_dedup(odd.where("doc_id IN (2, 3, 9)"), ed.DigestIndex(spark, f"file://{tmp_path}/index", 4)).collect()}
    assert (again[2].kept, again[2].keep_id, again[3].kept, again[9].kept) == (False, 1, False, True)


def test_exact_dedup_feeds_later_ranges_through_the_index(spark, odd, none, monkeypatch):
    held, append = [], ed.DigestIndex.append

    def counted(self, groups):
        held.append(self.table().count())
        append(self, groups)

    monkeypatch.setattr(ed.DigestIndex, "append", counted)
    queries.QUERIES["op3_exact_dedup"](spark, SMALL).count()
    assert held[0] == 0 and len(held) == 3 and min(held[1:]) > 0
    rows = spark.createDataFrame([(i, f"text {i % 7}" if i % 2 else "same") for i in range(60)], "doc_id bigint, text string")
    for docs in (odd, rows, none):
        want = sorted(map(str, ed.exact_dedup(docs).collect()))
        assert sorted(map(str, ed.exact_dedup_in_ranges(docs, 4).collect())) == want


def test_quality_rules(odd, none):
    got = {r.doc_id: r for r in qr.quality_rules(odd).collect()}
    assert qr.quality_rules(odd).count() == odd.count()
    assert got[4].n_words == got[5].n_words == got[6].n_words == 0 and got[4].base_failed
    assert got[3].host == "" and got[3].n_words == 3001
    assert not got[1].base_failed or got[1].n_repeat_words > 0
    assert qr.quality_rules(none).count() == 0
    kept = qr.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (4, 5, 6, 7, 8, 9)").count() == 0


def test_repeat_words_by_brute_force(spark):
    texts = ["a b c a b c", "a a a a a", "a b c d a b c x a b", "a b", "", " ".join("ab"[i % 2] for i in range(101))]
    got = {r.doc_id: r.n_repeat_words for r in qr.quality_rules(spark.createDataFrame(
        [(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        assert got[i] == len({p + k for p in range(len(w) - 2) if n[tuple(w[p:p + 3])] > 1 for k in range(3)})


def test_line_dedup(spark, none):
    pages = [(i, f"http://A.example/{i}", f"<p>menu</p><p>page {i}</p><script>x</script>") for i in range(6)]
    pages += [(9, None, None), (10, "http://b.example", "<p>menu</p>"), (0, "http://a.example/0", "<p>menu</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = ld.line_dedup(df, "page_id", ld.host_of(F.col("url")), ld.lines_of_html(F.col("html"))).collect()
    assert sorted((r.page_id, r.n_dropped, r.text) for r in got if r.host == "a.example") == sorted(
        [(i, 1, f"page {i}") for i in range(6)] + [(0, 1, "")])
    assert [(r.host_pages, r.text) for r in got if r.page_id == 10] == [(1, "menu")]
    assert [r.n_lines for r in got if r.page_id == 9] == [0]
    assert ld.line_dedup(df.limit(0), "page_id", F.col("url"), ld.lines_of_html(F.col("html"))).count() == 0


def test_token_shards(spark, odd, none):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(ts.default_tokenizer())
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    start, want = 0, []
    for known, i, t in rows:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i if known else None, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    got = [tuple(r) for r in ts.tokenised(odd, block_tokens=500).orderBy("start").collect()]
    assert got == want
    assert ts.tokenised(none).count() == 0
    from rillet.session import scratch_path
    path = scratch_path(spark, "shards")
    ts.write_shards(odd.where("doc_id = 9"), path)
    assert [r.ids for r in ts.read_shards(spark, path).collect()] == [[*own.encode("one two").ids, 2]]


def test_token_shards_hold_the_ids_of_the_plainly_loaded_tokenizer(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(ts.default_tokenizer())
    texts = ["plain words", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  <|endoftext|>\n z",
             "<|endoftext|", "a <|endoftext|>b <|endoftext|> a", "plain words again", None]
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [tuple(r) for r in ts.tokenised(docs).orderBy("start").collect()] == want


@pytest.mark.parametrize("text", ["a  b", " a", "\n a\n\n b ", "it's  <|endoftext|> a", "a \x1cb", "", "x  y", "don't 'll  \t z"])
def test_word_cache_gives_the_tokenizers_ids(text):
    cached = ts.tokenizer(ts.default_tokenizer())
    assert cached.encode([text, text])[1] == cached._whole([text])[0]


def test_pack_round_trip():
    rng = np.random.default_rng(3)
    for high in (3, 300, 70_000, 1 << 24, (1 << 32) - 1):
        for n in (0, 1, 5, 1000):
            ids = rng.integers(0, high, n, dtype=np.uint32, endpoint=True)
            assert (ts.unpack(*ts.pack(ids), n) == ids).all()


def test_viterbi_by_brute_force():
    model = sc.piece_model(sc.default_model())

    def best(word):
        score = [0.0] + [-1e300] * len(word)
        for end in range(1, len(word) + 1):
            score[end] = score[end - 1] + model.byte_score * len(word[end - 1].encode())
            for at in range(end):
                if word[at:end] in model.scores:
                    score[end] = max(score[end], score[at] + model.scores[word[at:end]][0])
        return score[-1]

    names = {i: (p, s) for p, (s, i) in model.scores.items()}
    for word in ["▁hello", "▁internationalisation", "▁été中z", "xq\U0001f600ab", "▁"]:
        ids = model.viterbi(word)
        total = sum(names[i][1] if i in names else model.byte_score for i in ids)
        assert abs(total - best(word)) < 1e-9


def test_sentencepiece_round_trip(odd, none):
    got = sc.encode_decode_digests(odd).collect()
    assert len(got) == odd.count() and all(r.round_trip for r in got)
    back = sc.decode(sc.encode(odd), text="back").select("text", "back").collect()
    assert all(r.text == r.back for r in back)
    assert sc.encode_decode_digests(none).count() == 0


def brute_pieces(text, size=32_000):
    """Ids of a text by the best sum of scores over all pieces of the file, position by position over the whole text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sc.default_model())
    pieces, bytes_, rank = {}, {}, 0
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rank += 1
            pieces[piece] = (-float(np.log(rank + 2.7)), i)
    worst, longest = -float(np.log(rank + 2.7)) - 2.0, max(map(len, pieces))
    if not text:
        return []
    chars = list("\0" + text.replace("▁", "\U0010fffe").replace(" ", "▁"))
    chars[0] = "▁"
    best, back = [0.0], [None]
    for end in range(1, len(chars) + 1):
        found, how = -1e300, None
        for n in range(min(longest, end), 0, -1):
            piece = "".join(chars[end - n:end])
            if piece in pieces and best[end - n] + pieces[piece][0] > found:
                found, how = best[end - n] + pieces[piece][0], (end - n, [pieces[piece][1]])
        raw = {"\U0010fffe": "▁", "▁": " "}.get(chars[end - 1], chars[end - 1]).encode()
        cost = best[end - 1] + worst * (len(raw) if chars[end - 1] != "▁" else 3)
        if cost > found:
            found, how = cost, (end - 1, [bytes_[b] for b in raw])
        best.append(found)
        back.append(how)
    ids, at = [], len(chars)
    while at:
        at, part = back[at]
        ids = part + ids
    return ids


def test_sentencepiece_by_brute_force(spark):
    indented = ["def f(x):\n    if x:\n        return  x\n\n\n" + " " * 37 + "y = 1  ", "   ", " ", "  lead", "tail  ", "a ▁ b▁▁c  ▁",
                "é日本  \t tab\x00", "\n", " \n ", "a\n  b", "x" * 40 + "   " + "…" * 3, "word " * 30]
    texts = indented + [r.text[:1500] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(12).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in sc.encode_decode_digests(docs).collect()}
    model = sc.piece_model(sc.default_model())
    score = {i: s for s, i in model.scores.values()}
    for i, text in enumerate(texts):
        ids, want = model.encode(text), brute_pieces(text)
        # Runs of blanks can be cut in several ways of one score; the sums agree, and elsewhere the ids do.
        assert sum(score.get(x, model.byte_score) for x in ids.tolist()) == pytest.approx(
            sum(score.get(x, model.byte_score) for x in want)), text
        if "   " not in text:
            assert ids.tolist() == want, text
        assert (got[i].n_tokens, got[i].ids_crc32, got[i].round_trip) == (ids.size, zlib.crc32(ids.tobytes()), True)
    assert got[0].n_tokens < 40  # runs of blanks are single pieces


def test_language_id(spark, odd, none):
    got = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    rows = {r.doc_id: r for r in li.language_id(odd).collect()}
    assert rows[4].lang_pred == rows[5].lang_pred == "und" and rows[4].score == 0
    assert rows[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    assert li.language_id(none).count() == 0
    code = li.codewords(5)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= code.shape[1] // 2


def test_quality_classifier(spark, odd, none):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_quality_classifier"](spark, d).join(
        spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert ((got["quality"] == 1) == got["kept"]).mean() > 0.95
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = qc.quality_classifier(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows)
    assert qc.quality_classifier(none, labels).count() == 0


def brute_grams(text, lower):
    """Hash buckets of all single code points, pairs and triples, with plain integers."""
    word = (1 << 64) - 1
    p = [ord(c) for c in (text.lower() if lower else text)]
    one = [x * 0x9E3779B97F4A7C15 & word for x in p]
    two = [(a >> 7) ^ (b * 0xC2B2AE3D27D4EB4F & word) for a, b in zip(one, p[1:], strict=False)]
    three = [(a * 0x165667B19E3779F9 & word) ^ (b * 0x27D4EB2F165667C5 & word) for a, b in zip(two, p[2:], strict=False)]
    return Counter(x >> 48 for x in [*one, *[x * 0x2545F4914F6CDD1D & word for x in two],
                                     *[x * 0x9FB21C651E98DF25 & word for x in three]])


def test_language_id_by_brute_force(spark):
    """The registered query against counting, bit classifiers and decoding one text at a time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas().sort_values("doc_id")
    counts, limit = {}, 1000
    learn = docs[[zlib.crc32(str(i).encode()) % 3 != 1 for i in docs["doc_id"]] & (docs["text"] != "")]
    for lang, group in learn.groupby("lang"):
        first = sorted(group["doc_id"], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:limit]
        counts[lang] = sum((brute_grams(t, True) for t in group.set_index("doc_id").loc[first, "text"]), Counter())
    langs = sorted(counts)
    p = np.array([[counts[g][b] + 0.5 for b in range(1 << 16)] for g in langs])
    p /= p.sum(axis=1, keepdims=True)
    bits = [c for c in li.codewords(len(langs)).T if len(set(c)) == 2]
    score = {}
    for text in docs["text"]:
        grams = brute_grams(text, True)
        n = max(sum(grams.values()), 1)
        loss = np.zeros(len(langs))
        total = 0.0
        for c in bits:
            w = np.log(p[c > 0].mean(axis=0)) - np.log(p[c < 0].mean(axis=0))
            expected = p @ w
            low, high = expected[c < 0].max(), expected[c > 0].min()
            half = max((high - low) / 2, 1e-3)
            margin = (sum(w[b] * k for b, k in grams.items()) / n - (high + low) / 2) / half
            loss += np.log1p(np.exp(-3 * c * margin)) * half
            total += half
        share = np.exp(-4 * (loss / total - min(loss / total)))
        score[text] = (langs[int(np.argmax(share))], 1 / share.sum())
    for r in queries.QUERIES["op8_language_id"](spark, SMALL).collect():
        text = docs.set_index("doc_id")["text"][r.doc_id]
        assert r.lang_pred == score[text][0] and r.score == pytest.approx(score[text][1], abs=1e-4)


def test_quality_classifier_by_brute_force(spark):
    """Evidence and posteriors of the registered query against plain sums, one document at a time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    counts, half = [Counter(), Counter()], docs["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 2)
    for i, t, h in zip(docs["doc_id"], docs["text"], half, strict=True):
        if i in labels.index and h == 0 and t:
            counts[labels[i]] += brute_grams(t, False)
    p = np.array([[c[b] + 0.5 for b in range(1 << 16)] for c in counts])
    w = np.diff(np.log(p / p.sum(axis=1, keepdims=True)), axis=0)[0]

    def margin(text):
        grams = brute_grams(text, False)
        return sum(w[b] * n for b, n in grams.items()) / max(sum(grams.values()), 1)

    docs["margin"] = docs["text"].map(margin)
    held_ = docs[docs["doc_id"].isin(labels.index) & (half == 1) & (docs["text"] != "")]
    model = qc.EvidenceModel(np.ones((2, 4)))
    y = held_["doc_id"].map(labels).to_numpy()
    at = np.lexsort((held_["margin"], y))
    model.calibrate(held_["margin"].to_numpy()[at], y[at].astype(float))
    docs["evidence"] = 1 / (1 + np.exp(-(model.slope * docs["margin"] + model.shift)))
    mean = docs["evidence"].mean()

    def shrunk(parts, parent):  # rows: n, s, and the parent's mean
        within = parent * (1 - parent)
        spread = max((parts["n"] * (parts["s"] / parts["n"] - parent) ** 2).sum() - within.sum(), 0) / parts["n"].sum()
        k = (parts["n"] * within).sum() / parts["n"].sum() / spread if spread > 1e-9 else 1e4
        k = min(max(k, 1.0), 1e4)
        return (parts["s"] + k * parent) / (parts["n"] + k)

    hosts = docs.groupby("source")["evidence"].agg(n="size", s="sum")
    host = shrunk(hosts, hosts["n"] * 0 + mean)
    paths = docs.groupby(["source", "lang"])["evidence"].agg(n="size", s="sum")
    path = shrunk(paths, paths.index.get_level_values(0).map(host).to_series(index=paths.index))
    logit = lambda x: np.log(x / (1 - x))
    for r in queries.QUERIES["op10_quality_classifier"](spark, SMALL).collect():
        assert r.evidence == pytest.approx(docs.set_index("doc_id")["evidence"][r.doc_id], abs=1e-4)
        assert r.host_posterior == pytest.approx(host[r.host], abs=1e-4) and r.path_posterior == pytest.approx(path[r.host, r.path], abs=1e-4)
        z = logit(min(max(r.evidence, 1e-6), 1 - 1e-6)) + logit(r.path_posterior) - logit(r.corpus_mean if "corpus_mean" in r else mean)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4) and r.kept == (r.score >= 0.5 - 1e-9)


def test_source_mix(spark, odd, none):
    rows = sm.mix_documents(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert sm.mix_documents(none).count() == 0 and sm.keep_drawn(odd).columns == odd.columns
    assert sm.keep_drawn(none).count() == 0
    assert sm.keep_drawn(odd.withColumnRenamed("digest", "probability").withColumnRenamed("host", "lang_class")).count() > 0
    cells = np.array([5.0, 3.0, 2.0, 9.0])
    w = sm.rake(cells, [(np.array([0, 0, 1, 1]), np.array([0.4, 0.6])), (np.array([0, 1, 0, 1]), np.array([0.5, 0.5]))], 200)
    assert np.allclose([w[:2].sum(), w[[0, 2]].sum()], [0.4, 0.5])
    assert np.isclose(w[0] * w[3] / (w[1] * w[2]), 5 * 9 / (3 * 2))  # raking keeps the odds ratio
    p = sm.inclusion(np.array([3.0, 1.0, 0.5]), np.array([10.0, 10.0, 10.0]), 0.6)
    assert p[0] == 1 and np.isclose((p * 10).sum(), 18) and np.isclose(p[1], 2 * p[2])


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_against_sql(spark, key):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.execute(queries.ORACLE[key]).df()
    got = queries.QUERIES[key](spark, SMALL).toPandas()
    order, cols = got.columns[0], sorted(got.columns)
    assert cols == sorted(want.columns)
    if got[order].duplicated().any():
        order = cols
    a, b = (x.sort_values(order)[cols].reset_index(drop=True) for x in (got, want))
    assert a.astype(str).equals(b.astype(str))


def sql_over(docs, key):
    """An operator's SQL over the given documents."""
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(queries.ORACLE[key]).df().set_index("doc_id")


def test_pipeline_by_brute_force(spark):
    """Each stage by SQL or by hand over what the stage before left; nothing of the library's but the ids of a text."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").toPandas()
    left = docs[docs["doc_id"].map(sql_over(docs, "op5_quality_rules")["kept"])].sort_values("doc_id")
    key = left["text"].map(lambda t: re.sub("[\x20\x09-\x0d]+", " ", t))
    left = left[~key.duplicated()]
    comp = brute_components(zip(left["doc_id"], left["text"], strict=True), 5)
    left = left[[comp[i][2] for i in left["doc_id"]]]
    left = left[left["doc_id"].map(sql_over(left, "op2_source_mix")["kept"])]
    assert 20 < len(left) < len(docs)
    model = sc.piece_model(sc.default_model())  # held against brute force above
    want = {i: zlib.crc32(model.encode(t).tobytes()) for i, t in zip(left["doc_id"], left["text"], strict=True)}
    got = cp.run(spark, SMALL).collect()
    assert {r.doc_id: r.ids_crc32 for r in got} == want and all(r.round_trip for r in got)


def test_pipeline_of_odd_rows_and_of_none(spark, odd, none, tmp_path):
    import corpus_pipeline as cp

    words = " ".join(f"u{i}" for i in range(60))
    more = [(20, words, "en", "a"), (21, words + " ", "en", None), (21, words, None, "a"), (None, words + " more", "en", "a"),
            (None, None, None, None), (22, " ".join(f"v{i * i}" for i in range(70)), None, "b"), (22, " ".join(f"v{i * i}" for i in range(70)), None, "b")]
    docs = odd.unionByName(spark.createDataFrame([(*r, 1, "d", "k", "h") for r in more], odd.schema))
    docs = docs.withColumnsRenamed({"digest": "__id", "kept": "probability", "host": "source_class"}).withColumn("n_words", F.lit(1))
    left = docs
    for name, stage in cp.STAGES[:-1]:
        before = Counter(map(tuple, left.collect()))
        left = stage(spark, left, str(tmp_path))
        rows = Counter(map(tuple, left.collect()))
        assert left.columns == docs.columns and not rows - before, name  # rows of the stage before, none made or changed
    texts = Counter(r.doc_id for r in left.collect())
    assert texts[4] == texts[5] == texts[7] == 0 and texts[21] == 0 and texts[20] <= 1 and texts[22] <= 1 and texts[None] >= 1
    last = cp.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in last) == texts and all(r.round_trip for r in last)
    for name, stage in cp.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 15, 16, 17, 200, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 5:], rng.integers(0, 1 << 63, n // 5).astype(np.uint64)])
        x, y = md.shingles.odd_sketch(a), md.shingles.odd_sketch(b)
        assert x.size == y.size >= 2 and 64 * x.size >= 4 * n
        assert np.bitwise_count(x ^ y).sum() <= np.setxor1d(a, b).size
    assert md.shingles.odd_sketch(np.zeros(0, np.uint64)).tolist() == [0, 0]


def test_texts_without_a_candidate_stay_out_of_the_shuffle(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    needed = docs.select("doc_id").where("doc_id % 7 = 0").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = md.only_needed(docs, needed)
        plan = physical_plan(found, "simple")
        texts = plan.index("Exchange hashpartitioning(doc_id")
        assert plan.index("SortMergeJoin") < texts < plan.index("BroadcastHashJoin") < plan.index("text#", texts + 200)
        assert sorted(r[0] for r in found.collect()) == sorted(r[0] for r in needed.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_knows_digests_whose_rows_had_no_id(spark, tmp_path):
    index = ed.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    schema = "doc_id bigint, text string"
    first = ed.exact_dedup(spark.createDataFrame([(None, "only null"), (3, "b")], schema), index).collect()
    assert sorted(r["kept"] for r in first) == [True, True]
    again = ed.DigestIndex(spark, str(tmp_path / "index"), buckets=9)  # an index keeps the buckets it was made with
    assert again.buckets == 4
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in ed.exact_dedup(
        spark.createDataFrame([(5, "only null"), (6, "b"), (7, "new")], schema), again).collect()}
    assert got == {5: (None, False), 6: (3, False), 7: (7, True)}


def test_filters_allow_columns_named_as_their_helpers(spark):
    text = " ".join(f"u{i}" for i in range(80))
    docs = spark.createDataFrame(
        [(1, text, "a", 1, "d", "k"), (1, text + " end", "a", 2, "d", "k"), (2, text, "b", 3, "d", "k"), (3, "x", "b", 4, "d", "k")],
        "doc_id bigint, text string, source string, __id int, __digest string, __kept string")
    assert {r["__id"] for r in ed.keep_first(docs).collect()} == {1, 2, 4}
    assert {r["__id"] for r in qr.keep_good(docs, reject_rate=1.1).collect()} == {1, 2, 3}
    assert sorted(r["doc_id"] for r in md.keep_one_of_each(docs).collect()) == [1, 1, 3]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mix_reaches_the_target_of_every_source_language_and_topic(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    targets = sm.document_targets(docs)
    assert len(targets["source"]) == 20 and abs(sum(targets["source"].values()) - 1) < 1e-9
    rows = sm.mix_documents(docs).toPandas()
    expected = rows["n_tokens"] * rows["probability"]
    assert 0.5 < expected.sum() / rows["n_tokens"].sum() <= 0.9
    drawn_ = rows[rows["kept"]]
    for name, target in targets.items():
        reached = expected.groupby(rows[f"{name}_class"]).sum() / expected.sum()
        for value, share in target.items():
            assert abs(reached[value] - share) < 0.001  # as probabilities
        if sf == "sf0.1":  # as drawn: enough documents for the draw to be near its mean
            got = drawn_.groupby(f"{name}_class")["n_tokens"].sum() / drawn_["n_tokens"].sum()
            assert all(abs(got[v] - share) < 0.01 for v, share in target.items())


def test_small_sources_share_a_class(spark, monkeypatch):
    monkeypatch.setattr(sm, "NAMED_SHARE", 0.2)
    docs = spark.createDataFrame([(i, "w " * (40 if i % 2 else 4), "en", f"s{i % 6}" if i % 2 else None) for i in range(60)],
                                 "doc_id bigint, text string, lang string, source string")
    target = sm.document_targets(docs)["source"]
    assert set(target) == {"s1", "s3", "s5", sm.REST} and target["s1"] < 1 / 3 and sum(target.values()) == pytest.approx(1)
    assert sm.mix_documents(docs).count() == 60
