"""The operators: against SQL or brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkgrid.llm import bpe, components, html_text, line_dedup, mixing, near_dedup, quality_model, quality_rules, repeats, spelling, spotsigs, suffix_tree, topk, url_rules
from inkgrid.llm._text import flat, ragged, runs, shingles, spans_hash, words
from inkgrid.llm.queries import ORACLE, QUERIES

from ..oracle import same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "one two three four", "One  TWO three four", "x " * 4000, "é\x0bß\x1c日本 \t\n tail", "same line of text here\nother\nsame line of text here", "same line of text here\nmore"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, sources and texts, a repeated row, and columns named like results and helpers."""
    rows = [(k, t, "en", f"s{k % 3}", 1) for k, t in enumerate(ODD)] + [(None, "same line of text here\nx", None, None, None), (5, "one two three four", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in ("score", "kept", "n_words", "size", "_row", "_d", "doc", "rep", "n", "token_ids_", "component_id")})


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, name, QUERIES[name], ORACLE[name])


def docs_of(spark, texts, schema="doc_id long, text string, source string"):
    return spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], schema)


# texts


def test_words_and_hashes():
    texts = ["a  bc\td", "", "A bc", " x ", "é ß"]
    raw, off = flat(pa.array([*texts, None]))
    s, e, first = words(raw, off)
    got = [[bytes(raw[a:b]).decode() for a, b in zip(s[first[k] : first[k + 1]], e[first[k] : first[k + 1]])] for k in range(len(texts) + 1)]
    assert got == [WORD.findall(t) for t in texts] + [[]]
    h = spans_hash(raw, s, e)
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == len(h) - 2
    assert spans_hash(raw, s, e, fold=False)[0] != spans_hash(raw, s, e, fold=False)[3]
    assert [list(r) for r in (ragged(np.array([5, 0]), np.array([2, 3])),)] == [[5, 6, 0, 1, 2]]


def test_long_words_hash_alike(monkeypatch):
    import inkgrid.llm._text as text

    words_ = ["w" * n for n in (1, 50, 700)] * 3
    raw, off = flat(pa.array([" ".join(words_)]))
    s, e, _ = words(raw, off)
    whole = spans_hash(raw, s, e)
    monkeypatch.setattr(text, "PIECE", 64)
    assert (text.spans_hash(raw, s, e) == whole).all()
    assert list(runs(np.array([0, 10, 5000, 5001]), 100))[-1][1] == 3


def test_shingles_stay_in_documents():
    raw, off = flat(pa.array(["a b c d e f", "a b", "a b c d e", ""]))
    s, e, first = words(raw, off)
    doc, h = shingles(spans_hash(raw, s, e), first)
    assert Counter(doc.tolist()) == {0: 2, 1: 1, 2: 1} and h[doc == 2][0] in h[doc == 0]


# 1


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First   paragraph of<br>the text, long enough to be content.<p>Second <b>one</b>.</p>
<div class="ad">Buy now</div><ul><li>item</ul><section id="comments"><p>Nice post</p></section></article><aside>Side</aside><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst paragraph of the text, long enough to be content.\n\nSecond one.\n\nitem"
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<nav>x</nav>")
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First paragraph" in html_text.main_text(plain) and "Menu" not in html_text.main_text(plain) and "Nice post" not in html_text.main_text(plain)
    assert html_text.main_text("<article><p>cut off in the mid &am") == "cut off in the mid &am"
    assert html_text.main_text("<div class=ad>ad<article><p>text of the page</p></article>") == "text of the page"


LONG = "A paragraph with enough words in it to be taken for running text by anyone who counts letters and tags."


def test_density_selects_regions():
    """No name or element marks what goes here: links, tags and the density of text do."""
    links = "".join(f"<div><a href=x>Link {k}</a></div>" for k in range(6))
    page = f"<body><main><div>{links}</div><div><h1>Head</h1><p>{LONG}<p>{LONG}<p>Bye.</div><div><span>a</span> <i>b</i><p><b>c</b> <i>d</i></div></main></body>"
    assert html_text.main_text(page) == f"Head\n\n{LONG}\n\n{LONG}\n\nBye."
    page = f"<body><div>{links}</div><h1>Head</h1><div><p>{LONG}<p>{LONG}<p>Two.<p>Closing</div><div><a href=x>Next page of all</a></div></body>"
    assert html_text.main_text(page) == f"Head\n\n{LONG}\n\n{LONG}\n\nTwo.\n\nClosing"
    rest = html_text.main_text(f"<body><div class=menu><p>Menu one<p>Menu two</div><div><p>{LONG}</div><div class=comments><p>Posted by Bob<p>{LONG}</div></body>")
    assert rest == LONG


def test_names_are_a_weak_prior():
    want = f"Head\n\n{LONG}\n\nBye."
    body = f"<h1>Head</h1><p>{LONG}</p><p>Bye.</p>"
    for page in (f"<form>{{}}</form>", "<table class=header><tr><td>{}</table>", "<div class='page-content notice'>{}</div>", "<form><div>{}</div></form>"):
        assert html_text.main_text("<body><nav><a href=x>Menu</a></nav>" + page.format(f"<article>{body}</article>")) == want
        assert html_text.main_text("<body><nav><a href=x>Menu</a></nav>" + page.format(body) + "<footer>me</footer>") == want
    assert html_text.main_text(f"<article><div class='entry-header'><h1>Head</h1></div><p class='share-price'>{LONG}<blockquote class=notice>Bye.</blockquote></article>") == want
    assert html_text.main_text(f"<article>{body}<section id='comment-list'><article><p>{LONG}</article></section></article>") == want
    assert html_text.main_text(f"<nav>a</nav><footer><p>{LONG}</footer>") == ""


def test_long_and_deep_pages():
    deep = "<div><b>" * 20_000 + f"<p>{LONG}" + "</u></p></em>" * 20_000
    assert html_text.main_text(deep) == LONG
    assert html_text.main_text("<article>" + f"<p>{LONG}" * 20_000 + "</article>").count("\n\n") == 19_999


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = html_text.extract(pages).collect()
    assert len(got) == 3 and sorted(r.n_chars for r in got)[0] == 0 and got[0].n_chars == len(got[0].text)
    assert html_text.with_text(pages).columns == pages.columns


# 2


def test_quality_held_out(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_model.classify(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if r.quality is not None and got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_quality_equals_direct_sizes(spark):
    """The model's features and scores against a direct computation with the library, text by text."""
    import zstandard

    good, bad = [f"the quiet river runs {k} past old {k % 7} houses and gardens" for k in range(400)], [f"## buy $$ now {k} !! click && win {k % 5} ** prize" for k in range(400)]
    model = quality_model.QualityModel(good=quality_model.dictionary([t.encode() for t in good]), bad=quality_model.dictionary([t.encode() for t in bad]))
    texts = [b"", good[3].encode() * 30, bad[4].encode() * 30, (good[5] + bad[6]).encode()]
    tools = []
    for data in (model.good, model.bad):
        kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == (0xEC30A437).to_bytes(4, "little") else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdCompressionDict(data, dict_type=kind)
        d.precompute_compress(level=quality_model.LEVEL)
        tools.append(zstandard.ZstdCompressor(level=quality_model.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
    for t, got in zip(texts, model.features(texts), strict=True):
        parts = [t[i : i + quality_model.BLOCK] for i in range(0, max(1, len(t)), quality_model.BLOCK)]
        g, b, n = [len(tools[0].compress(p)) - len(tools[0].compress(b"")) for p in parts], [len(tools[1].compress(p)) - len(tools[1].compress(b"")) for p in parts], [len(p) for p in parts]
        share = lambda x, y: (x - y) / (x + y + quality_model.SHRINK)
        want = [share(sum(b), sum(g)), min(map(share, b, g)), share(sum(n), sum(g)), min(map(share, n, g))]
        assert got.tolist() == pytest.approx(want)
    x = model.features([t.encode() for t in good[200:] + bad[200:]])
    y = np.repeat([1, 0], 200)
    model.calibrate(x, y, np.ones(400))
    scores = model.score([t.encode() for t in good[:200] + bad[:200]])
    assert (scores[:200] > 0.5).all() and (scores[200:] < 0.5).all()
    # the fit is a minimum: no small step along any weight lowers the penalised loss
    a = model._design(x)
    loss = lambda w: np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w)).sum() + 0.05 * w @ w
    assert all(loss(model.weights + s * e) >= loss(model.weights) - 1e-9 for e in np.eye(len(model.weights)) for s in (-1e-3, 1e-3))


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(k, k % 2) for k in range(11)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.classify(odd, labels).collect()
    assert len(got) == 13 and all(r.score is not None for r in got)
    assert quality_model.keep_good(odd, labels).columns == odd.columns
    none = quality_model.classify(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.classify(odd.limit(0), labels).count() == 0


# 3


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, cover, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            cover |= set(range(i, i + 5))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_counts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    got = quality_rules.count_texts(pa.array(texts))
    assert [[int(got[k][i]) for k in quality_rules.COUNTS[:5]] for i in range(len(texts))] == [brute_counts(t) for t in texts]


def test_rules(spark, odd, sf_dir):
    got = quality_rules.judge(odd).collect()
    assert len(got) == 13 and not any(r.kept for r in got if r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in QUERIES["op3_quality_rules"](spark, sf_dir).collect()}
    good = [kept[k] for k, q in labels.items() if q == 1]
    bad = [kept[k] for k, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.3
    assert quality_rules.judge(odd.limit(0)).count() == 0


def brute_em(votes, rounds=400):
    """Posteriors of documents with these votes, document by document, in plain Python."""
    good = [(0.5 + sum(v == 1 for v in d)) / (1 + sum(v != 0 for v in d)) for d in votes]
    rules = range(len(votes[0]))
    for _ in range(rounds):
        rate = []
        for r in rules:
            bad_on_bad = sum(1 - g for d, g in zip(votes, good) if d[r] == -1)
            bad_on_good = sum(g for d, g in zip(votes, good) if d[r] == -1)
            cast_bad = sum(1 - g for d, g in zip(votes, good) if d[r])
            cast_good = sum(g for d, g in zip(votes, good) if d[r])
            on_bad, on_good = (bad_on_bad + 0.5) / (cast_bad + 1), (bad_on_good + 0.5) / (cast_good + 1)
            rate.append((on_bad, on_good) if on_bad >= on_good else ((on_bad + on_good) / 2,) * 2)
        share = (sum(good) + 1) / (len(good) + 2)
        for i, d in enumerate(votes):
            odds = math.log(share / (1 - share))
            for v, (on_bad, on_good) in zip(d, rate):
                odds += math.log(on_good / on_bad) if v == -1 else math.log((1 - on_good) / (1 - on_bad)) if v == 1 else 0
            good[i] = 1 / (1 + math.exp(-odds))
    return good


def test_rules_outvote_one_another(spark, sf_dir):
    """Brute-force EM agrees on every verdict; of documents with bad votes some stay and some go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = [f"vote_{r.name}" for r in quality_rules.RULES]
    got = [r for r in quality_rules.judge(docs).collect() if not r.base_failed]
    want = brute_em([[r[n] for n in names] for r in got])
    assert [r.p_good for r in got] == pytest.approx(want, abs=1e-6) and [r.kept for r in got] == [p >= 0.5 for p in want]
    # one bad vote each: the accurate rule's drops the document, the careless rule's does not
    rules = [quality_rules.Rule("x", "n_words in (30, 31)", "n_words > 31"), quality_rules.Rule("y", "n_words = 30", "n_words > 31"), quality_rules.Rule("careless", "n_words % 3 = 0 and n_words > 31", "n_words > 0")]
    texts = [" ".join(f"v{j}" for j in range(n)) for n in [30] * 30 + [31] * 10 + list(range(32, 62)) * 5]
    one = {(r.vote_x, r.vote_y, r.vote_careless): r.kept for r in quality_rules.judge(docs_of(spark, texts), rules=rules).collect()}
    assert one == {(-1, -1, 1): False, (-1, 0, 1): False, (1, 1, -1): True, (1, 1, 1): True}


def test_estimates_recover_accuracies():
    rnd = np.random.default_rng(1)
    good = rnd.random(20_000) < 0.8
    votes = np.stack([np.where(rnd.random(20_000) < 0.2, 0, np.where(rnd.random(20_000) < np.where(good, low, high), -1, 1)) for low, high in ((0.02, 0.7), (0.05, 0.5), (0.01, 0.3))], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, rates = quality_rules.estimate(patterns.astype(float), counts.astype(float))
    assert abs(share - 0.8) < 0.07 and abs(rates[0, 0] - 0.7) < 0.1 and rates[0, 1] < 0.06


# 4


def test_url_rules(spark):
    urls = ["https://a.b.example.org/es/x", "http://EXAMPLE.org/en/12?q#f", "http://notexample.org/es/", "http://example.org", "ftp://x.com/de/1", "no scheme", None, "http://org/", "http:///x", "https://shop.com/fr/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    assert got[0] == ("a.b.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3] == ("example.org", "", None, "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("", "", None, "allow") == got[6] and got[7][2] == "org/" and got[9][2:] == ("com/fr/", "allow")
    twice = url_rules.annotate(pages.union(pages).withColumns({"host": F.lit(1), "_h": F.lit(2), "verdict": F.lit(3)}))
    assert twice.count() == 20 and "_h" in twice.columns
    assert url_rules.judge(pages, []).filter("rule is not null").count() == 0 and url_rules.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_rules.judge(pages, [url_rules.UrlRule("A.b", "/", "allow")])


# 5


def brute_classes(texts: dict):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def family(seed: int, n: int, length: int = 120, swaps: int = 2) -> list[str]:
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rnd.randrange(swaps + 1)):
            own[rnd.randrange(length)] = f"v{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark):
    texts = family(1, 150, swaps=4) + family(2, 5) + family(3, 40, length=12, swaps=1) + ODD + ["lonely text of some words that nobody repeats"] * 3
    random.Random(5).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classes(docs_of(spark, texts)).collect()}
    assert got == brute_classes(dict(enumerate(texts)))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Many blocks and crowded buckets, and rows of one id with several texts, each of which links."""
    monkeypatch.setattr(near_dedup, "BLOCK", 1500)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    texts = family(11, 120, swaps=6) + family(12, 60, length=14, swaps=1) + family(13, 2, length=200) + family(14, 2, length=200)
    rows = list(enumerate(texts)) + [(1000, texts[180]), (1000, texts[182]), (1001, texts[183])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.classes(docs).collect()}
    want = brute_classes(dict(list(enumerate(texts)) + [(1002, texts[180]), (1003, texts[182]), (1001, texts[183])]))
    joined = {want[k][1] for k in (180, 181, 182, 183, 1001, 1002, 1003)}
    assert len(joined) > 1 and {got[k] for k in (180, 181, 182, 183, 1000, 1001)} == {180}
    assert all(got[k] == want[k][1] for k in range(180))


def test_near_duplicates_odd(spark, odd):
    got = near_dedup.classes(odd).collect()
    assert len(got) == 13
    nameless = [r for r in got if r.doc_id is None]
    assert len(nameless) == 1 and nameless[0].component_id is None and nameless[0].kept
    assert {r.component_id for r in got if r.doc_id == 6} == {5} and len([r for r in got if r.doc_id == 5]) == 2
    assert near_dedup.keep_first(odd).columns == odd.columns and near_dedup.classes(odd.limit(0)).count() == 0


def test_estimates():
    raw, off = flat(pa.array(family(7, 2, length=600, swaps=8)))
    doc, key, n = next(iter(near_dedup.document_sets(pa.array(family(7, 2, length=600, swaps=8)))))
    regs = near_dedup.registers(doc, key, n)
    a, b = set(key[doc == 0].tolist()), set(key[doc == 1].tolist())
    e = near_dedup.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(e - len(a & b) / len(a | b)) < 0.1
    assert near_dedup.band_hashes(regs).shape == (2, near_dedup.BANDS) and len(off) == 3 and len(raw)


def test_component_table(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4), (None, 1), (2, 1)], "a long, b long")
    assert {r.node: r.component for r in components.components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 4: 4}


# 6


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64)
    tree = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(np.unique(keys)).dump())
    place = tree.index(np.unique(keys))
    assert sorted(place.tolist()) == list(range(len(np.unique(keys))))
    assert line_dedup.PerfectHash.build(np.zeros(0, np.uint64)).index(keys[:3]).tolist() == [-1, -1, -1]


def test_line_index():
    """All distinct hashes are indexed; counts and first documents come back, foreign hashes seldom seem known."""
    rnd = np.random.default_rng(4)
    keys = np.unique(rnd.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64))
    holders, first = rnd.integers(1, 400, len(keys)), rnd.integers(0, 10**12, len(keys))
    index = line_dedup.LineIndex.build(keys, holders, first)
    found, got = index.probe(keys)
    assert (found == (holders > 1)).all() and (got == np.where(holders > 1, first, 0)).all()
    assert index.prints.nbytes == 2 * len(keys) and index.counts.nbytes == len(keys) and len(index.firsts) == (holders > 1).sum()
    assert index.probe(rnd.integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64))[0].mean() < 0.01


def test_line_dedup_many_shards(spark, sf_dir, monkeypatch):
    """Dozens of shards and batches equal the SQL."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 100)
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "20")
    try:
        same(spark, sf_dir, "op6_line_dedup", QUERIES["op6_line_dedup"], ORACLE["op6_line_dedup"])
    finally:
        conf.set(key, before)


def test_line_dedup_odd(spark, odd):
    got = line_dedup.dedup_lines(odd)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert rows[(9, "same line of text here\nother\nsame line of text here")].n_dropped == 0
    assert rows[(10, "more")].n_dropped == 1 and rows[(None, "x")].n_dropped == 1
    assert (0, "") in rows and rows[(3, "\n\n")].n_lines == 3
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 7


def test_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(docs_of(spark, [None, "", "zzz unseen zzz"]).select(F.col("doc_id") + 10**6, "text"))
    texts = {r.doc_id: WORD.findall((r.text or "").translate(LOWER)) + [None] for r in docs.collect()}
    train = Counter(t for k, v in texts.items() if zlib.crc32(str(k).encode()) % 10 for t in v)
    total, kinds = sum(train.values()), len(train)
    got = suffix_tree.score(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        own = texts[r.doc_id]
        assert r.n_tokens == len(own) and r.n_known == sum(t in train for t in own) and r.train_tokens == total
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_scores(train, texts, depth=10**6):
    """(scores of texts, sums of the states' distributions) by a direct count: the rules of the module's text, without shards."""
    grams, follow = Counter(), {}
    longest = min(depth, max(map(len, train)))
    for t in train:
        for n in range(1, longest + 2):
            for i in range(n - 1, len(t)):
                grams[tuple(t[i - n + 1 : i + 1])] += 1
                follow.setdefault(tuple(t[i - n + 1 : i]), set()).add(t[i])
    total, kinds, states = sum(map(len, train)), len(follow[()]), {}

    def p(context, t):
        if not context:
            return (grams[(t,)] + suffix_tree.ALPHA) / (total + suffix_tree.ALPHA * (kinds + 1))
        found = state(context)
        if found is None:
            return p(context[1:], t)
        other, many = found
        c = grams[(*context, t)]
        if c >= suffix_tree.MIN_MOVE:
            return (c + many * p(context[1:], t)) / (grams[context] + many)
        return other * p(context[1:], t)

    def candidate(context):
        return grams[context] >= (suffix_tree.MIN_SEEN if len(context) == 1 else suffix_tree.MIN_LONG) and len(context) <= depth and (len(context) == 1 or state(context[1:]) is not None and candidate(context[:-1]))

    def state(context):
        """(factor of other tokens, kept kinds), or None."""
        if context not in states:
            states[context] = None
            if candidate(context):
                seen = grams[context]
                kept = {t: grams[(*context, t)] for t in follow[context] if grams[(*context, t)] >= suffix_tree.MIN_MOVE}
                q = {t: p(context[1:], t) for t in kept}
                c, other = sum(kept.values()), max(1 - sum(q.values()), 1e-12)
                gain = sum(n / seen * math.log(n / seen / q[t]) for t, n in kept.items()) + ((1 - c / seen) * math.log((1 - c / seen) / other) if c < seen else 0)
                if kept and gain >= suffix_tree.MIN_DIVERGENCE and gain * seen >= suffix_tree.MIN_GAIN:
                    states[context] = max(seen - c + len(kept) * other, 1e-9 * seen) / (seen + len(kept)) / other, len(kept)
        return states[context]

    scores = [sum(math.log10(p(tuple(t[max(0, i - longest) : i]), t[i])) for i in range(len(t))) for t in texts]
    unseen = suffix_tree.ALPHA / (total + suffix_tree.ALPHA * (kinds + 1))
    sums = {}
    for context, found in list(states.items()):
        if found is not None:
            factor, short = found[0], context[1:]
            while short:
                factor, short = factor * (states.get(short) or (1,))[0], short[1:]
            sums[context] = sum(p(context, t) for t in follow[()]) + factor * unseen
    return scores, sums


@pytest.mark.parametrize("depth", [None, 1])
def test_model_equals_direct_count(spark, depth, monkeypatch):
    """Many small chunks and shards, contexts of several words; every state's probabilities sum to one."""
    monkeypatch.setattr(suffix_tree, "CHUNK", 2000)
    rnd = random.Random(3)
    phrase = [f"p{k}" for k in range(12)]
    texts = [sum((rnd.choice((phrase[k % 9 : k % 9 + 4], [f"w{min(rnd.randrange(40), rnd.randrange(40))}"])) for k in range(rnd.randrange(30))), []) for _ in range(300)]
    texts += [phrase * 2] * 3 + [["a"] * 200]
    texts += [[x, "y", "z", f"q{x}"] for x in ("x1", "x2") for _ in range(12)] + [["u", "z", "v"]] * 40
    got = {r.doc_id: r for r in suffix_tree.score(docs_of(spark, [" ".join(t) for t in texts]), depth=depth).collect()}
    ended = [[*t, None] for t in texts]
    want, sums = brute_scores([t for k, t in enumerate(ended) if not got[k].held_out], ended, depth or 10**6)
    assert [got[k].score for k in range(len(texts))] == pytest.approx(want, abs=1e-3)
    assert list(sums.values()) == pytest.approx([1] * len(sums)) and max(map(len, sums)) >= (depth or 3)


def test_evidence_is_the_same_in_a_large_corpus(spark):
    """Contexts of a dozen occurrences stay states beside millions of other tokens."""
    rows = [("rare gem of a find" if k % 2 else "quite another text", k) for k in range(40)]
    scores = []
    for more in (0, 2):
        docs = spark.createDataFrame(rows + [("f " * 1_000_000, 10_001 + k) for k in range(more)], "text string, doc_id long")
        scores.append({r.doc_id: r.score - r.base_score for r in suffix_tree.score(docs).collect()})
    assert all(scores[1][k] > 1 for k in range(40)) and scores[0].keys() < scores[1].keys()


def test_language_model_odd(spark, odd):
    assert suffix_tree.score(odd).count() == 13 and suffix_tree.score(odd.limit(0)).count() == 0
    only_held = suffix_tree.score(docs_of(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert only_held[0].held_out and only_held[0].score == 0 and only_held[0].train_tokens == 0


# 8


def brute_top(rows, k=5):
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q, x in fine.items():
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in fine.items() if i != q and len(y) == len(x))
            for n, (s, i) in enumerate(scored[:k]):
                want[q, n + 1] = (i, max(min(-s, 2**63 - 1), -(2**63)))
    return want


@pytest.mark.parametrize("shard", [40, 8192])
def test_top_k(spark, shard, monkeypatch):
    """One shard and many, with few queries in a block."""
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    rnd = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rnd.normal(size=4)]) for k in range(300)] + [(300 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(200)]
    rows += [(1000, None), (1050, []), (1100, [1.0, None, 0.0, 0.0]), (1150, [float("nan"), 0.0, 0.0, 0.0]), (1200, [1.0, 2.0]), (1201, [2.0, 1.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors.withColumns({"shard": F.lit(1), "id": F.lit(2)})).collect()}
    assert got == brute_top(rows)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 3)
    rows = [(50 * k, [x, 1.0]) for k, x in enumerate((1e15, 3.5, -1e15, 1e15, 2.0**50, 1e16, 0.25))]
    rows += [(k, [1e15 + 0.125 * k, 0.5]) for k in range(1, 9)] + [(99, [1e308, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors).collect()}
    assert got == brute_top(rows[:-1])


def test_ball_tree_leaves_nodes_out():
    rnd = np.random.default_rng(5)
    points = np.floor(256 * np.concatenate([rnd.normal(size=(500, 3)) + 20 * c for c in np.eye(3)]))
    tree = topk.BallTree.build(np.arange(1500), points)
    want = sorted((-int(s), i) for i, s in enumerate(points @ points[3]) if i != 3)[:5]
    assert tree.search(points[3], 3, 5, -np.inf) == [(i, -s) for s, i in want]
    assert tree.search(points[3], 3, 5, float(-want[1][0])) == [(i, -s) for s, i in want[:2]]
    assert tree.search(points[3], 3, 5, 1e12) == []


# 9


def test_bpe_equals_library(spark, sf_dir):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    ranges = [(32, 127), (0, 0x530), (0x530, 0xD800), (0xE000, 0x11000)]
    texts = [t for t in ODD if t] + ["", "a<|endoftext|> b<|endoftext|>", "it's we'll 'S 123", "a" * 5000, " " * 99 + "x", "\x85\xa0 x"]
    texts += ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(40)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(50).collect()]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    own = bpe.Bpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    ids, ends = own.encode(texts)
    back = own.decode(ids, ends)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[k] : ends[k + 1]].tolist() == e.ids
        assert back[k] == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_long_words_and_new_letters():
    """Long words merge over a linked list, in time that grows with their length; letters of newer Unicode count as signs."""
    from tokenizers import Tokenizer

    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(rnd.choice("etaoins") for _ in range(n)) for n in (255, 256, 257, 300, 5000)] + ["a" * 700, "ab" * 400, "é" * 300, "日本語" * 200]
    texts += ["".join(rnd.choice(letters) for _ in range(3000)), "x\U000323b0y \U0001e6c0\U0001e6c1 1\u0c5c", "word " + "z" * 300 + " word"]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    own = bpe.Bpe(open(bpe.default_vocabulary(), encoding="utf-8").read())
    for _ in range(2):  # the second time from the table of words
        ids, ends = own.encode(texts)
        for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[ends[k] : ends[k + 1]].tolist() == e.ids
    large = "".join(rnd.choice("etaoinshrdlu") for _ in range(1 << 20))
    began = time.process_time()
    ids, _ = own.encode([large])
    assert time.process_time() - began < 60 and own.decode(ids, np.array([0, len(ids)])) == [large]
    assert ids.tolist() == library.encode(large, add_special_tokens=False).ids


def test_bpe_columns(spark, odd):
    coded = bpe.encode_documents(spark, odd)
    back = coded.select("text", bpe.decode_column(spark, F.col("token_ids")).alias("b")).collect()
    assert all((r.text or "") == r.b for r in back) and coded.columns == [*odd.columns, "token_ids"]
    rows = bpe.round_trip(spark, odd).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 13 and all((r.n_tokens == 0) == (r.ids_sha256 == empty) for r in rows)
    assert spark.range(1).select(bpe.decode_column(spark, F.array(F.lit(10**8), F.lit(-1)))).first()[0] == ""


# 10


def test_mix_properties(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.plan(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.plan(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got} and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * total, rel=0.02)
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns and rows.count() == sum(1 if r.size == 0 else r.taken // r.size for r in got)


def test_mix_odd(spark, odd):
    got = mixing.plan(odd).collect()
    assert len(got) == 13 and all(r.size == len(WORD.findall(t or "")) for r, t in ((r, ODD[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id != 5))
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.plan(odd.limit(0)).count() == 0 and mixing.mix(odd.limit(0)).count() == 0


def test_mix_equal_finish_times(spark):
    """Copies of equal time are taken together or not at all; reruns agree."""
    docs = spark.createDataFrame([(k % 4, "same text of five words", f"s{k % 3}") for k in range(60)], "doc_id long, text string, source string")
    got = [mixing.plan(docs.repartition(n)).collect() for n in (1, 5)]
    key = lambda rows: sorted((r.doc_id, r.source_size, r.target, r.taken) for r in rows)
    assert key(got[0]) == key(got[1]) and all(r.taken <= 2 * r.size for r in got[0])
    assert mixing.mix(docs).count() == sum(r.taken // r.size for r in got[0])


# all


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in QUERIES["op2_quality_classifier"](spark, sf_dir).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, p in scores.items() if p == 1}
    lines = corpus_pipeline.lines(spark, docs, sf_dir)
    assert lines.columns == docs.columns and lines.count() == docs.count() and lines.filter(F.col("n_chars") != F.length("text")).count() == 0
    first = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    classes = brute_classes({r.doc_id: r.text for r in docs.collect()})
    assert sorted(r.doc_id for r in first.collect()) == sorted(k for k, (_, c) in classes.items() if k == c)
    mixed = corpus_pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(len(r.token_ids) == r.n_tokens for r in out)


# 11


def near_words(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(docs, least_n=3):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if k >= least_n and len(w) >= 5}
    near = {w: [v for v in n if near_words(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("buckets", [1 << 17, 50])
def test_variants_equal_brute_force(spark, monkeypatch, buckets):
    monkeypatch.setattr(spelling, "BUCKET_KEYS", buckets)
    rnd = random.Random(11)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 8))) for _ in range(40)]
    texts = []
    for _ in range(120):
        words_ = []
        for _ in range(60):
            w = rnd.choice(base)
            k = rnd.randrange(len(w))
            words_.append(rnd.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rnd.choice("abÉ") + w[k:], w[:k] + "b" + w[k + 1 :]]))
        texts.append(rnd.choice([" ", "\n", "1", "×-"]).join(words_))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "aaaaa aaaaab aaaaa aaaaa"), (3, None), (4, ""), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "key", "form", "id", "bucket")})
    got = sorted(tuple(r) for r in spelling.variants(docs).collect())
    assert got == brute_variants(rows) and any(r[5] for r in got) and any(r[2] != (r[1] or r[0]) for r in got)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_long_runs_and_chains(spark):
    long = "ab" * 20000
    texts = [" ".join([long] * 6 + [long + "c"] * 12 + [long[1:]] * 3)] + ["grape grope gripe"] * 3 + ["grope"] * 9 + ["gropes"] * 30
    got = {r["word"]: r for r in spelling.variants(docs_of(spark, texts), every=None).collect()}
    assert got[long]["form"] == long + "c" and got[long[1:]]["root"] == long + "c" and got[long]["n_near"] == 2
    assert got["grape"]["form"] == "grope" and got["grape"]["root"] == "gropes" and got["grope"]["form_n"] == 30 and got["gropes"]["form"] is None


def test_pieces_and_flushes_do_not_change_counts(spark, monkeypatch):
    text = "alpha, Beta gammaÉ " * 300
    whole = spelling.text_runs(text.encode().lower().decode())
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert spelling.text_runs(text.encode().lower().decode()) == whole == {"alpha": 300, "beta": 300, "gammaÉ": 300}


def test_equal_hashes_make_no_neighbours():
    """Rows that share a key by collision only: their strings differ, so they are not neighbours."""
    table = pa.table({"bucket": [0] * 4, "place": [1, 1, 1, -1], "id": [1, 2, 3, 4], "word": ["axc", "ayc", "qqq", "zz"], "n": [5, 7, 100, 9]})
    assert sorted(spelling._neighbours(table).to_pylist(), key=lambda r: r["id"]) == [{"id": 1, "n_near": 1, "best_n": 7, "best_id": 2}, {"id": 2, "n_near": 1, "best_n": 5, "best_id": 1}]


# 12


def brute_runs(words_):
    n, out = len(words_), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words_[i] == words_[i + q]:
                i += 1
            size = i - s + q
            if size >= max(6, 4 * q) and not any(words_[s : s + size - r] == words_[s + r : s + size] for r in range(1, q)):
                out.append((s, size, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words_ = WORD.findall(text or "")
    n = len(words_)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words_ = words_[:a] + [words_[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words_)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words_) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(kept))


def test_runs_equal_brute_force(spark, odd):
    rnd = random.Random(12)
    texts = []
    for _ in range(300):
        n, letters = rnd.choice([0, 1, 5, 6, 7, 30, 90, 200]), rnd.choice(["a", "ab", "abé", "abcdefghijkl"])
        w = [rnd.choice(letters) for _ in range(n)]
        if n > 8 and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = 1 + rnd.randrange(max(1, (n - a) // 3))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        texts.append(rnd.choice([" ", "\n", " \x0b"]).join(w))
    docs = docs_of(spark, texts)
    got = [tuple(r) for r in repeats.digest(docs).collect()]
    assert sorted(got) == [brute_digest(k, t) for k, t in enumerate(texts)]
    assert sum(r[1] > 1 for r in got) > 20
    many = sorted((tuple(r) for r in repeats.digest(odd).collect()), key=repr)
    assert many == sorted((brute_digest(r["doc_id"], r["text"]) for r in odd.collect()), key=repr)
    assert repeats.digest(odd.limit(0)).collect() == []


def test_runs_of_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    want = {r["doc_id"]: brute_digest(r["doc_id"], r["text"]) for r in docs.collect()}
    assert got == want


def test_refinement_moves_little(monkeypatch):
    """The smaller pieces alone are passed on: a periodic text of n words moves each only a few times."""
    moved = []
    plain = repeats.Classes.move
    monkeypatch.setattr(repeats.Classes, "move", lambda self, m, g, k: (moved.append(len(m)), plain(self, m, g, k))[1])
    words_ = [str(k % 500).encode() for k in range(20000)]
    assert repeats.found_runs([words_])[0].tolist() == [[0, 20000, 500]]
    assert sum(moved) < 40000


def test_runs_and_collapsed_text(spark):
    docs = docs_of(spark, ["so so so so so so good", "a b a b a b a b a", "x y z"])
    got = {r["doc_id"]: (r["collapsed"], [tuple(x) for x in r["runs"]]) for r in repeats.periodic(docs).collect()}
    assert got == {0: ("so good", [(0, 6, 1)]), 1: ("a b", [(0, 9, 2)]), 2: ("x y z", [])}


# 13


def test_fingerprints_on_odd_tables(spark, odd):
    got = spotsigs.compare_edited(odd).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect() if r["doc_id"] is not None), key=lambda r: -r[0])
    rows = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == odd.count() and sum(r["doc_id"] is None for r in got) == 1
    for (k, text), (other, after) in zip(texts, texts[1:], strict=False):
        third = len(text) // 3
        if k != other and len({t for i, t in texts if i == other}) == 1 and sum(i == k for i, _ in texts) == 1:
            assert rows[k]["edited_sha256"] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
            assert rows[k]["n_chars"] == len(text)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert spotsigs.compare_edited(odd.limit(0)).collect() == []


@pytest.mark.parametrize("parts", ["1", "7", "64"])
def test_next_document_over_buckets(spark, parts):
    """As one window over all rows would find it, whatever the buckets; a third of the rows under one id, and null ids."""
    rnd = random.Random(13)
    rows = [(rnd.choice([rnd.randrange(-(10**12), 10**12), 7, 7, None]) if k % 2 else k, f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["text"]: r["next_text"] for r in spotsigs.with_next(docs, "doc_id", "h", ["text"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = [r["text"] for r in docs.orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc()).collect()]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_signatures_of_a_text(spark):
    text = "The quick brown fox and the lazy dog. The quick brown fox"
    chains = {" quick brown", "the quick brown", "and lazy dog", "the lazy dog"}
    row = docs_of(spark, [text, "", "alone", "The QUICK brown fox, and the lazy dog: the quick (brown) fox!"]).select(spotsigs.signatures(F.col("text")).alias("s")).collect()
    assert set(row[0]["s"]) == {hashlib.md5(c.encode()).hexdigest()[:8] for c in chains}
    assert row[1]["s"] == [hashlib.md5(b"").hexdigest()[:8]] and row[2]["s"] == [hashlib.md5(b"alone").hexdigest()[:8]]
    assert row[3]["s"] == row[0]["s"]
    assert len(docs_of(spark, ["the " * 50000 + "end of it", "word " * 50000]).select(spotsigs.signatures(F.col("text")).alias("s")).collect()) == 2


def test_likeness_is_jaccard_and_prunes_by_size(spark):
    rnd = random.Random(3)
    pool = [f"{k:08x}" for k in range(40)]
    pairs = [(sorted(rnd.sample(pool, rnd.randint(1, 40))), sorted(rnd.sample(pool, rnd.randint(1, 40)))) for _ in range(300)]
    pairs.append((pool, pool))
    rows = spark.createDataFrame([("".join(a), "".join(b)) for a, b in pairs], "a string, b string")
    for least in (0.0, 0.3, 0.75):
        got = [r[0] for r in rows.select(spotsigs.likeness(F.col("a"), F.col("b"), least)).collect()]
        for (a, b), x in zip(pairs, got, strict=True):
            want = len(set(a) & set(b)) / len(set(a) | set(b))
            assert abs(x - want) < 1e-12 if want >= least else x in (0.0, want)
