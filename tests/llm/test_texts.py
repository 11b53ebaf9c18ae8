"""Tokens, packing, media, pages, languages and toxicity against libraries, round trips and held-out rows."""

import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packloom.llm import boosting, bpe, dom, htmltext, jpeg, langid, packing, queries, toxicity

FOLDER = "/root/testdata/sf0.001"
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", "  ", "Hello World's 123 <|endoftext|>x", "<|startoftext|>", "I'LL 'S ﬁ İ Σας ßİ", "à̕  x\x1c\x85y᠎", "日本語 text", "😀ok😀😀", "a" * 300, "<|<|endoftext|>|>", "\n\n  \t x  "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = spark.createDataFrame([(10_000 + k, x, None, None, 0) for k, x in enumerate(ODD)] + [(20_000, None, None, None, None), (None, "word", "en", "src0", 4)], rows.schema)
    return rows.union(extra).withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("clash"))


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_bpe_equals_library(docs, texts):
    library = Tokenizer.from_file(WORDS)
    for r in bpe.encode_and_decode(docs, WORDS).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeéß'.,!0 日İΣ́<|>\n", max_size=60) | st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40) | st.text(alphabet="etaoinshr", max_size=80))
def test_bpe_equals_library_on_any_text(text):
    library = _library()
    ids, decoded = bpe.load(WORDS).encode(text)
    expected = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected and decoded == library.decode(expected, skip_special_tokens=False)


def test_bpe_equals_library_on_every_character():
    library, own = _library(), bpe.load(WORDS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}b 1{chr(c)}" for c in points[k : k + 50_000]]
        for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(text)[0], "<u4").tolist() == expected.ids, ascii(text)


def _library(made=[]):  # noqa: B006
    if not made:
        made.append(Tokenizer.from_file(WORDS))
    return made[0]


@pytest.mark.parametrize("shares", [None, {"src0": 0.5, "src1": 0.1}])
def test_packing(docs, texts, shares):
    rows = packing.pack(docs.where("doc_id is not null").repartition(3), BYTES, shares=shares).toPandas()
    library = Tokenizer.from_file(BYTES)
    for doc_id, g in rows.sort_values("start").groupby("doc_id"):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(g["ids"]), "<u4").tolist() == ids and (g["doc_tokens"] == len(ids)).all()
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert set(rows["doc_id"]) == set(texts) - {None}
    full = rows.groupby("sequence_id")["length"].sum()
    assert (full.iloc[:-1] == 1024).all() and full.index.tolist() == list(range(len(full)))
    ordered = rows.sort_values(["sequence_id", "offset"])
    ends = ordered["offset"] + ordered["length"]
    first = ordered["sequence_id"].diff() != 0
    assert ((ordered["offset"] == ends.shift(fill_value=0)) | first).all() and (ordered["offset"][first] == 0).all()
    if shares is None:
        share = rows.groupby("queue")["length"].sum() / rows["length"].sum() * 1024
        middle = rows[(rows["sequence_id"] > 0) & (rows["sequence_id"] < len(full) - 3)]
        counts = middle.groupby(["sequence_id", "queue"])["length"].sum().unstack(fill_value=0)
        assert (abs(counts - share) <= 2.5).all().all()


@pytest.mark.parametrize("operator", ["bpe", "media", "language", "pages", "toxicity"])
def test_empty_repeated_and_long_rows(spark, operator):
    """An empty table gives no rows; rows of one id keep their own results; long texts go through."""
    schema = "doc_id long, text string, lang string"
    run = {
        "bpe": lambda df: bpe.encode_and_decode(df, WORDS).select("doc_id", "n_tokens"),
        "media": lambda df: jpeg.media_columns(df).select("doc_id", "n_bytes"),
        "language": lambda df: langid.learn_and_identify(df).select("doc_id", "lang_pred"),
        "pages": lambda df: htmltext.extract(df.withColumn("url", F.lit("u")), htmltext.train(), "doc_id", "url", "text").select("doc_id", "n_chars"),
        "toxicity": lambda df: toxicity.score(df, toxicity.Model({"bad": 35.0}, -30.0)).select("doc_id", "predicted"),
    }[operator]
    assert run(spark.createDataFrame([], schema)).count() == 0
    long = "some words of a text, and more. " * 30_000
    rows = [(7, "one bad text here.", "en"), (7, "two", "en"), (7, "two", "en"), (None, None, None), (8, "", None), (9, long, "en")]
    found = run(spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("n_tokens", "score", "page", "feature", "id", "held_out")})).collect()
    assert len(found) == 6 and len({tuple(r) for r in found if r[0] == 7}) <= 2
    assert next(r[1] for r in found if r[0] == 9) == {"bpe": len(_library().encode(long).ids), "media": len(long), "language": "en", "pages": len(long.strip()), "toxicity": 0}[operator]


def test_packing_edges(spark, monkeypatch):
    schema = "doc_id long, text string, source string"
    assert packing.pack(spark.createDataFrame([], schema), BYTES).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None, None), (1, None, None), (2, "x " * 5000, "a")], schema), BYTES)
    assert one.agg(F.sum("length")).first()[0] == 1 + 1 + len(Tokenizer.from_file(BYTES).encode("x " * 5000, add_special_tokens=False).ids) + 1
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    many = packing.pack(spark.createDataFrame([(k, "some words " * k, f"s{k}") for k in range(1, 40)], schema), BYTES).toPandas()
    assert many["queue"].nunique() <= 3 and (many.groupby("sequence_id")["length"].sum().iloc[:-1] == 1024).all()


def plain_round_robin(totals, shares, windows, length):
    """Token by token: each window's quantum is credited, whole tokens are served, the rest goes to the greatest remainders."""
    from fractions import Fraction

    deficit, left, out = [Fraction(0)] * len(totals), list(totals), []
    for _ in range(windows):
        deficit = [d + Fraction(s * length, sum(shares)) for d, s in zip(deficit, shares, strict=True)]
        window = [0] * len(totals)
        for q in range(len(totals)):
            while deficit[q] >= 1:
                deficit[q] -= 1
                window[q] += 1
        while sum(window) < length:
            q = max(range(len(totals)), key=lambda i: (deficit[i], -i))
            deficit[q] -= 1
            window[q] += 1
        while sum(window) > length:
            q = min((i for i in range(len(totals)) if window[i]), key=lambda i: (deficit[i], i))
            deficit[q] += 1
            window[q] -= 1
        left = [n - w for n, w in zip(left, window, strict=True)]
        if min(left) < 0:
            break
        out.append(window)
    return out


@pytest.mark.parametrize("weights", [[37, 400, 3, 160], [1, 1, 1], [5], [1000, 1, 1, 1, 1, 1, 30], [7, 7, 7, 1, 2, 3] * 10])
def test_schedule_equals_plain_round_robin(weights):
    """Each queue's tokens of each window, over several periods, until one runs dry."""
    length, totals = 64, [w * 300 for w in weights]
    plan = packing.Schedule(totals, [float(w) for w in weights], length)
    shares = packing._to_period(np.array(weights, float), packing.PERIOD * length)
    expected = plain_round_robin(totals, shares.tolist(), 200, length)
    assert len(expected) > 100 or len(weights) < 4
    for q in range(len(weights)):
        served = plan.served_before(q, np.arange(len(expected) + 1))
        assert np.diff(served).tolist() == [w[q] for w in expected]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 50)), min_size=1, max_size=9), st.sampled_from([4, 16, 64]))
def test_schedule_places_every_token_once(queues, length):
    totals, weights = [t for t, _ in queues], [float(w) for _, w in queues]
    plan = packing.Schedule(totals, weights, length)
    places = [plan.place(q, np.arange(t)) for q, t in enumerate(totals)]
    assert sorted(np.concatenate(places).tolist()) == list(range(sum(totals)))
    for q, (t, place) in enumerate(zip(totals, places, strict=True)):
        assert (np.diff(place) > 0).all()
        x = np.arange(0, sum(totals) + 1, 3)
        assert plan.served_by(q, x).tolist() == [(place < k).sum() for k in x]
        doc, first, size, window, offset = plan.pieces(q, np.array([0, t // 2]), np.array([max(1, t // 2), t]))
        assert (window * length + offset == place[first]).all() and ((first + size <= t) & (offset + size <= length)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
def test_jpeg_round_trip(payloads):
    media = jpeg.encode_payloads(payloads)
    for data, file in zip(payloads, jpeg.describe(media), strict=True):
        n, back = jpeg.payload_of(file)
        assert n == len(data) and back[:n] == data and len(back) % 64 == 0 and len(back) > 0 and not any(back[n:])


def test_jpeg_damage_and_size():
    good, big = jpeg.encode_payloads([b"x" * 100, bytes(range(256)) * 3000])
    found = jpeg.describe([good, None, b"", b"abc", good[:-4], good[:60], good.replace(b"\xff\xc0", b"\xff\xc2", 1), big])
    assert ["error" in f for f in found] == [False, True, True, True, True, True, True, False]
    assert found[7]["thumbnail"].shape == (found[7]["height"] // 8, found[7]["width"] // 8) and jpeg.payload_of(found[7])[1] == bytes(range(256)) * 3000


def test_jpeg_of_long_text_needs_little_memory(monkeypatch):
    """Lanes in groups give the same file and the same bytes; a text of 8 MB stays within 20 bytes a byte."""
    import tracemalloc

    data = random.Random(3).randbytes(100_000)
    whole = jpeg.encode_payloads([data, b"x", data[:999]])
    monkeypatch.setattr(jpeg, "LANES", 37)
    assert jpeg.encode_payloads([data, b"x", data[:999]]) == whole
    assert [jpeg.payload_of(f)[1][: len(d)] for f, d in zip(jpeg.describe(whole), (data, b"x", data[:999]), strict=True)] == [data, b"x", data[:999]]
    monkeypatch.undo()
    long = b"Some words of a long text. " * 300_000
    tracemalloc.start()
    n, back = jpeg.payload_of(jpeg.describe(jpeg.encode_payloads([long]))[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back[:n] == long and peak < 20 * len(long) + 60e6


def test_jpeg_without_restarts():
    """A hand-made grey image of two blocks, predicted from one another: DC 5, then 5 - 3, no AC."""
    head = jpeg.encode_payloads([b"a" * 128])[0]
    scan = head.index(b"\xff\xda")
    tables = jpeg._segment(0xC4, jpeg._table(0x00, {2: [0, 2, 3]})) + jpeg._segment(0xC4, jpeg._table(0x10, {1: [0x00]}))
    start = head[: head.index(b"\xff\xc4")]
    bits = "10" + "101" + "0" + "01" + "00" + "0"  # size 3: 5; end; size 2: -3; end
    body = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    file = start + tables + head[scan : scan + 10] + body + b"\xff\xd9"
    out = jpeg.describe([file])[0]
    assert out["coefficients"][:, 0].tolist() == [5, 2] and out["thumbnail"].tolist() == [[129, 128]]


def test_media_query(spark, docs, texts):
    for r in jpeg.media_columns(docs, keep_media=True).collect():
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])


def test_pages(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet")
    extra = spark.createDataFrame([(10_000, "u", None), (10_001, None, ""), (10_002, "u", "<"), (10_003, "u", "<div>" * 3000 + "deep"), (None, "u", "plain text only, nothing else here.")], rows.schema)
    found = {r["page_id"]: r["text"] for r in htmltext.extract(rows.union(extra).withColumn("text", F.lit("clash")), htmltext.train()).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))
        assert found[r["page_id"]] == " ".join(unescape(body).split())
    assert found[10_000] == found[10_001] == ""
    assert htmltext.extract(rows.limit(0), htmltext.train()).count() == 0


def test_pages_held_out():
    """Layouts that the trees have not seen."""
    shared = lost = extra = 0
    for seed in range(10**7, 10**7 + 150):
        html, expected = htmltext.sample_page(seed)
        got, want = (re.findall(r"\S+", t) for t in (htmltext.main_text([dom.Page(html)], htmltext.train())[0], expected))
        both = sum((__import__("collections").Counter(got) & __import__("collections").Counter(want)).values())
        shared, lost, extra = shared + both, lost + len(want) - both, extra + len(got) - both
    assert shared / (shared + lost) > 0.97 and shared / (shared + extra) > 0.95


def test_decoding_is_consistent():
    parent, own = np.array([-1, 0, 1, 1, 0]), np.array([False, False, True, True, True])
    kept = htmltext.decode(parent, own, np.array([0.5, 0.95, 0.9, 0.45, 0.1]))
    assert kept[2:].tolist() == [True, True, False]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_decoding_equals_all_labellings(data):
    """Keep, drop or leave to the children, for every block of small trees: no consistent labelling is likelier."""
    from itertools import product

    n = data.draw(st.integers(1, 7))
    parent = np.array([-1] + [data.draw(st.integers(0, i - 1)) for i in range(1, n)])
    p = np.array([data.draw(st.floats(0.001, 0.999)) for _ in range(n)])
    inner = set(parent.tolist())
    own = np.array([i not in inner and data.draw(st.booleans()) for i in range(n)])
    order = [0]  # blocks come in document order: parents first, subtrees together
    for i in order:
        order[order.index(i) + 1 : order.index(i) + 1] = np.flatnonzero(parent == i).tolist()
    place = {b: k for k, b in enumerate(order)}
    parent = np.array([-1 if parent[b] < 0 else place[int(parent[b])] for b in order])
    p, own = p[order], own[order]
    filled = own.copy()
    for i in range(n - 1, 0, -1):
        filled[parent[i]] |= filled[i]

    def cost(labels):
        total = 0.0
        for i, x in enumerate(labels):
            above = labels[parent[i]] if i else 2
            if above != 2 and x != above or x == 2 and own[i]:
                return np.inf
            total += filled[i] * (-np.log(p[i]) if x == 1 else -np.log1p(-p[i]) if x == 0 else htmltext.MIXED_COST)
        return total

    kept = htmltext.decode(parent, own, p)
    best = min(map(cost, product((0, 1, 2), repeat=n)))
    of_result = min(cost(x) for x in product((0, 1, 2), repeat=n) if all((x[i] == 1) == kept[i] for i in range(n) if own[i]))
    assert abs(best - of_result) < 1e-9


def test_boosted_trees():
    """A rule of two features is learned; one split equals a search over all cuts."""
    rng = np.random.default_rng(5)
    x = np.column_stack((rng.random(2_000), rng.integers(0, 2, 2_000), rng.random(2_000))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    p = boosting.Boosted().fit(x, y).probability(x)
    assert ((p > 0.5) == y).mean() > 0.99
    one = boosting.Boosted(depth=1).fit(x[:, :1], (x[:, 0] > 0.3).astype(float), trees=1, rate=1.0)
    gain = lambda c: sum(((y0 := (x[:, 0] > 0.3)[m].astype(float) - 0.7).sum()) ** 2 / len(y0) for m in (x[:, 0] > c, x[:, 0] <= c))
    cuts = np.unique(np.quantile(x[:, 0], np.linspace(0, 1, boosting.BINS + 1)[1:-1]))
    assert abs(one.cut[0][0] - max(cuts, key=gain)) < 1e-6


def test_page_attributes():
    """Words in values hide nothing; hidden elements and their blocks are gone; only script-like text is skipped."""
    html = '<article title="ten hidden gems"><p class="post hidden xs" data-x="display:none">kept</p><p hidden>a<p>b<span hidden>c</span><div style="x:y; display : none">d<p>e</p></div><math>m</math><object>o</object><noscript>n</noscript><video>v</video></article>'
    assert " ".join(t for t in dom.Page(html).texts if t) == "kept b monv"
    found = htmltext.main_text([dom.Page(html.replace("kept", "A sentence that is kept, as all articles are. " * 5))], htmltext.train())
    assert found[0].startswith("A sentence that is kept")
    assert [t for t in dom.Page('a < b <!---->c<!-->d<x y=">">e</x><p z=\'1>2\' w = "3" v=4>f</p >g<a b="h>i').texts if t] == ["a < b cde", "f", "gi"]


@pytest.mark.parametrize("piece", ["<a ", "<div>", "</p>", "<li>", "<a>x", "<title>", "<button ", '<a b="x>', "<!--", "<", "</a", "<div hidden>", "<tr><td>", "<a" + "=" * 50, "<p>x<div>"])
def test_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    page = dom.Page("<div>" * 20_000 + piece * (1_000_000 // len(piece)))
    dom.features(page.columns())
    assert time.perf_counter() - began < 8  # a second or less on an idle core


def test_page_parser():
    p = dom.Page("<p>a<b>b</b> c<br>d<p>e<ul><li>f<li>g</ul>h<script>x</script><!-- y --><DIV hidden>z</DIV>&amp;i")
    assert [t for t in p.texts if t] == ["ab c d", "e", "f", "g", "h&i"]


def test_language(spark, docs):
    rows = langid.learn_and_identify(docs.withColumn("lang_pred", F.lit("clash"))).toPandas()
    truth = docs.select("doc_id", "lang").toPandas().dropna()
    joined = rows.merge(truth, on="doc_id")
    assert (joined[joined["held_out"]]["lang_pred"] == joined[joined["held_out"]]["lang"]).mean() > 0.95
    byid = rows.dropna(subset=["doc_id"]).set_index("doc_id")
    assert byid.loc[20_000, "lang_pred"] == byid.loc[10_000, "lang_pred"] == "und" and rows["score"].between(0, 1).all()
    assert langid.learn_and_identify(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.learn_and_identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_distances(text, profiles):
    """Out-of-place distances with n-grams as strings and ranks as list positions; ties as in the operator."""
    from collections import Counter

    grams = lambda t: Counter(w[i : i + n] for w in ["".join(c if c.isalpha() else " " for c in t.lower())] for n in (1, 2, 3, 4) for w in [" " + " ".join(w.split()) + " "] for i in range(len(w) - n + 1) if w[i : i + n].strip() and " " not in w[i : i + n][1:-1])
    key = {g: int(k) for t in [text, *profiles.values()] for g in grams(t) for k in [_gram_key(g)]}
    top = lambda t: [g for g, _ in sorted(grams(t).items(), key=lambda x: (-x[1], key[x[0]]))][: langid.PROFILE]
    mine, out = top(text), {}
    for name, t in profiles.items():
        ranks = {g: r for r, g in enumerate(top(t))}
        out[name] = sum(abs(ranks[g] - r) if g in ranks else langid.PROFILE for r, g in enumerate(mine)) / len(mine) / langid.PROFILE
    return out


def _gram_key(gram):
    """The operator's hash of one n-gram."""
    h = np.array([ord(c) for c in gram], np.uint32)
    cp, h = h, h * np.uint32(0x9E3779B1)
    for n in range(2, len(gram) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + cp[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
    return h[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdé ,.\n", min_size=1, max_size=400).filter(lambda t: any(c.isalpha() for c in t)), min_size=3, max_size=3))
def test_language_distances_equal_brute_force(texts):
    profiles = {"a": texts[1], "b": texts[2]}
    model = langid.Classifier({n: langid.most_frequent(*langid.ngrams(t)) for n, t in profiles.items()})
    expected = plain_distances(texts[0], profiles)
    assert np.allclose(model.distances(texts[0]), [expected[n] for n in model.names])


def test_language_profiles_equal_whole_counts(spark, monkeypatch):
    """Sums that are passed on early change no profile; too many languages are an error."""
    rows = [(k, f"{'abc' if k % 2 else 'xyz'} word{k % 7} thing", "odd" if k % 2 else "even") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    whole = langid.learn_profiles(df)
    monkeypatch.setattr(langid, "HELD", 40)
    early = langid.learn_profiles(df)
    assert {k: v.tolist() for k, v in whole.items()} == {k: v.tolist() for k, v in early.items()}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        langid.learn_profiles(df)


def test_language_distance_by_hand():
    model = langid.Classifier({"a": langid.most_frequent(*langid.ngrams("aaa bbb")), "b": langid.most_frequent(*langid.ngrams("xyz xyz xyz"))})
    assert model.predict("aaa bbb")[0] == "a" and model.predict("aaa bbb")[2] == 0 and model.predict("...")[0] == "und"


def test_noisy_or_gradient():
    """The likelihood against plain products, its gradient against differences."""
    rng = np.random.default_rng(8)
    y, plain = np.array([1, 0, 1, 0, 1, 1, 0, 0, 1, 0], bool), rng.integers(0, 3, 10).astype(float)
    docs = [[sorted(rng.choice(6, rng.integers(1, 4), replace=False).tolist()) for _ in range(rng.integers(1, 5))] for _ in y]
    bags = toxicity.Bags(y, plain, [(np.array([len(s) for s in d]), np.array([f for s in d for f in s])) for d in docs])
    w, b = rng.normal(size=6) * 0.5, -1.0
    loss = 0.0
    for label, rest, d in zip(y, plain, docs, strict=True):
        none = np.prod([1 - 1 / (1 + np.exp(-(w[s].sum() + b))) for s in d]) * (1 - 1 / (1 + np.exp(-b))) ** rest
        loss -= np.log(1 - none if label else none)
    assert abs(bags.loss(w, b) - loss) < 1e-9
    gw, gb = bags.gradient(w, b)
    step = 1e-6
    near = [(bags.loss(w + step * e, b) - bags.loss(w - step * e, b)) / (2 * step) for e in np.eye(6)]
    assert np.allclose(gw, near, atol=1e-5) and abs(gb - (bags.loss(w, b + step) - bags.loss(w, b - step)) / (2 * step)) < 1e-5


def test_toxicity_of_repeated_and_long_rows(spark):
    """A repeated id teaches once, long texts are scored whole, ties and repeated rows score alike."""
    rows = [(i, ("vile talk here. " if i % 2 else "kind words here. ") + f"filler{i % 5}.") for i in range(300)] + [(1, "vile talk here. again.")] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, labels)
    found = toxicity.score(spark.createDataFrame([(3, "vile talk."), (3, "vile talk."), (4, "kind words here.")], "doc_id long, text string"), model).collect()
    assert [r["predicted"] for r in found] == [1, 1, 0] and found[0]["score"] == found[1]["score"]
    # a noisy-or adds up what little every sentence has: of 20,000 sentences at exp(-14) it stays small, at exp(-6) it does not
    long, model = "kind words here. " * 20_000, toxicity.Model({"vile": 18.0}, -14.0)
    found = toxicity.score(spark.createDataFrame([(1, long), (2, long + "vile talk here.")], "doc_id long, text string"), model).collect()
    assert [r["predicted"] for r in found] == [0, 1] and abs(found[0]["score"] - (1 - (1 - 1 / (1 + np.exp(14))) ** 20_000)) < 1e-9
    assert [o["start"] for o in found[1]["offending"]] == [len(long)]
    assert toxicity.Scorer(toxicity.Model({}, -6.0)).score(long) > 0.99


def test_toxicity(spark):
    rng = random.Random(1)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        if toxic:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(["nastyword", "viletalk", "uglycreature"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, "viletalk"), (1003, "viletalk. " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("label", F.lit(9))
    known = spark.createDataFrame([*labels, (1001, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.learn(docs, known)).toPandas().merge(known.toPandas(), on="doc_id", how="left").dropna(subset=["doc_id"]).set_index("doc_id")
    held = found[found["held_out"] & (found.index < 600)]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert found.loc[[1000, 1001, 1002], "score"].tolist() == [0, 0, 0] and found.loc[1003, "predicted"] == 1
    hit = next(r for r in found[(found["predicted"] == 1) & (found.index < 600)].itertuples())
    text = dict(rows)[hit.Index]
    assert any(w in text[o["start"] : o["end"]] for o in hit.offending for w in ("nastyword", "viletalk", "uglycreature"))
    nothing = toxicity.score(docs, toxicity.learn(docs, known.limit(0)))
    assert nothing.where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.Model({}, 0.0)).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("shares", [None, {"s1": 0.5, "s2": 0.25, "s3": 0.01}])
def test_packing_many_sources(spark, monkeypatch, shares):
    """More sources than queues: windows keep every source's share, given ones too, and all tokens."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    rows = [(100 * k + i, "some words here " * (40 * k if shares is None else 400), f"s{k}") for k in range(1, 9) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = packing.pack(df, BYTES, shares=shares).toPandas()
    library = Tokenizer.from_file(BYTES)
    for doc_id, text, _ in rows:
        g = found[found["doc_id"] == doc_id].sort_values("start")
        assert np.frombuffer(b"".join(g["ids"]), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert (found.groupby("sequence_id")["length"].sum().iloc[:-1] == 1024).all()
    found["source"] = found["doc_id"] // 100
    counts = found.groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    part = found.groupby("source")["length"].sum() if shares is None else pd.Series({k: shares.get(f"s{k}", 0.01) for k in range(1, 9)})
    whole = counts.iloc[1:-3] if shares is None else counts.iloc[:4]
    assert len(whole) > 2 and (abs(whole - 1024 * part / part.sum()) <= 4).all().all()


def test_grouped_schedule_uses_every_place_once():
    totals, weights = [37, 400, 3, 160, 90, 10], [1.0, 4.0, 3.0, 1.0, 9.0, 2.0]
    plan = packing.GroupedSchedule(totals, weights, [0, 2, 5], 64)
    used = []
    for q, t in enumerate(totals):
        doc, first, size, window, offset = plan.pieces(q, np.array([0]), np.array([t]))
        assert first.tolist() == [0, *np.cumsum(size)[:-1]] and size.sum() == t
        used += [w * 64 + o + k for w, o, n in zip(window, offset, size, strict=True) for k in range(n)]
    assert sorted(used) == list(range(700))
