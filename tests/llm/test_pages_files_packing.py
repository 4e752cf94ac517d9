"""Extraction, licences and packing: exact results on pages and files, round trips of tokens."""

import html
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
from telesift.llm import extract, licences, packing


def article(page):
    """The article of the generated pages, by their own mark."""
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_extract_query_returns_the_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    found = {r.page_id: r for r in entry_points.queries()["op4_extract"](spark, sf).collect()}
    assert len(found) == len(pages)
    for p in pages:
        r = found[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, article(p.html), len(article(p.html)))


PAGES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("just words", "just words"),
    ("<html><body><nav><a>x y z</a></nav><footer>f</footer></body>", ""),
    ("<body><div id=menu>a b c</div><div class='content'><h1>Big title</h1><p>Some words &amp; more&nbsp;there<p>text that\n goes on</div><div class='comments'>I like it a lot</div>", "Big title\nSome words & more there\ntext that goes on"),
    ("<body><main><header><h1>T x</h1></header><p>aa bb<br>cc <i>d</i>e</p><ul><li>one</li><li>two</li></ul><section id=post-comments><p>no</p></section></main><aside>x</aside>", "T x\naa bb cc de\none\ntwo"),
    ("<body class='with-sidebar'><article><p>a &lt;b&gt; c</p><script>var t='</p>';</script><style>p{}</style><form>type here</form><p>1 < 2 &copy;</p><div class=ad>buy</div></article><p>after", "a <b> c\n1 < 2 ©"),
    ("<article><div class='cookie-notice'>we use cookies</div><p>x<!-- y <p> --></p><![CDATA[z]]></article>", "x\nz"),
    ("<article><p>unclosed <b>bold <p class='ad'>advert <p>last", "unclosed bold\nlast"),
]


def test_extract_odd_pages(spark):
    for page, want in PAGES:
        assert extract.main_text(page, extract.DEFAULT) == want, page
    t = spark.createDataFrame([(i, p, "u", "old") for i, (p, _) in enumerate(PAGES)] * 2, "page_id long, html string, url string, text string")
    out = extract.extract(t, extract.learned(t))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 2 * len(PAGES)
    assert extract.learned(t.limit(0)) == extract.DEFAULT and extract.extract(t.limit(0), extract.DEFAULT).count() == 0


def test_best_run_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(-3, 4, rng.integers(0, 9)).tolist()
        sums = {(i, j): sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        lo, hi = extract.best_run(s)
        assert sum(s[lo:hi]) == max([0, *sums.values()])


FILES = [
    ("a/LICENSE", "Released under the MIT License.", "MIT", "own"),
    ("a/b/c.py", "x = 1", "Apache-2.0", "inherited"),
    ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.", "Apache-2.0", "own"),
    ("a/d/e/f.py", "", "MIT", "inherited"),
    ("f/g", None, "GPL-3.0", "inherited"),
    ("a/b/h", "Code. Licensed under CC BY-NC 4.0.\nmore text here and there and many more words than the line has", "CC-BY-NC-4.0", "own"),
    (None, "Licensed to nobody, under the table", None, "none"),
    ("a/b/c.py", "x = 1", "Apache-2.0", "inherited"),
    ("z", "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "own"),
    ("top.txt", "word " * 50_000, "GPL-3.0", "inherited"),
]


def test_licences_and_inheritance(spark):
    t = spark.createDataFrame([(p, x, "s", 1) for p, x, _, _ in FILES], "path string, text string, score string, origin int")
    got = Counter((r.path, r.licence, r.origin) for r in licences.licences(t).collect())
    assert got == Counter((p, lic, origin) for p, _, lic, origin in FILES)
    assert licences.licences(t.limit(0)).count() == 0


def test_strong_terms_lose_no_sentence(docs):
    """Scoring every sentence finds the same as scoring those with a strong term."""
    texts = [r.text or "" for r in docs.select("text").collect()]
    vocabulary = sorted(set().union(*(licences.terms(x.lower()) for _, x in licences.TEMPLATES)))
    df, n = licences.frequencies(docs, vocabulary)
    m = licences.Matcher(licences.TEMPLATES, df, n, licences.THRESHOLD)
    got = {r.doc_id: r.licence for r in licences.own_licences(docs.selectExpr("doc_id", "cast(doc_id as string) path", "text")).collect()}
    for r, text in zip(docs.select("doc_id").collect(), texts, strict=True):
        best = min(((-s, i) for x in licences.SENTENCE.split(text.lower()) if licences.TERM.search(x) for i, s in [m.best(x)] if s >= m.threshold), default=None)
        assert got[r.doc_id] == (m.names[best[1]] if best else None)


def test_licence_query_covers_all_documents(spark, sf, docs):
    found = entry_points.queries()["op6_licences"](spark, sf).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == docs.count()
    for r in docs.collect():
        for line, name in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the MIT License.", "MIT")):
            if line in (r.text or "").split("\n"):
                assert name in by[r.doc_id].licences


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, pieces, most=4096):
    model = Tokenizer.from_file(VOCABULARY)
    want, got = Counter(), defaultdict(list)
    for doc, text in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc, len(ids)] += 1
        got[doc, len(ids)].append(ids)
    for p in pieces:
        assert any(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for ids in got[p.doc_id, p.doc_tokens])
        want[p.doc_id, p.doc_tokens] -= p.length / p.doc_tokens
    assert all(abs(v) < 1e-9 for v in want.values())
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= most
    return [sum(n for _, n in s) for s in by.values()]


def test_packing_query_round_trip(spark, sf, docs):
    sizes = check_pieces([(r.doc_id, r.text) for r in docs.collect()], entry_points.queries()["op7_packing"](spark, sf).collect())
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes)


def test_packing_odd_rows(odd, empty, spark):
    check_pieces([(r.doc_id, r.text) for r in odd.collect()], packing.pack(odd, VOCABULARY).collect())
    assert packing.pack(empty, VOCABULARY).count() == 0
    texts = ["<|endoftext|> A<|STARTOFTEXT|>b", "don't we'll 'S it's", "ΑΣ Σ ΟΔΟΣ. İx", "éa, É.", "!?. ., a.,b", "a b c\x1cd\x0be", "  \n\n ", "Ⅷ ²3 四五", "x" * 9000]
    rows = [(i, t) for i, t in enumerate(texts)]
    check_pieces(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY).collect())


@pytest.mark.parametrize(("limits", "cut"), [((100, 3, 60), True), ((100, 4, 50), False)])
def test_all_three_limits_hold(limits, cut):
    rng = np.random.default_rng(2)
    packer, items = packing.Packer(0, limits, cut), []
    for i in range(300):
        n = int(rng.integers(1, 60))
        items.append((i, b"\0\0\0\0" * n, 0, n, int(rng.integers(0, min(n, 50) + 1)), n))
    done = [*packer.pack(items[:150]), *packer.pack(items[150:]), *packer.finish()]
    by = defaultdict(list)
    for doc, start, length, _, _, loss, sequence, _ in done:
        by[sequence].append((length, loss))
    assert sum(n for s in by.values() for n, _ in s) == sum(x[3] for x in items)
    assert all(sum(n for n, _ in s) <= limits[0] and len(s) <= limits[1] for s in by.values())
    assert all(sum(x for _, x in s) <= limits[2] + (1 if cut else 0) for s in by.values())


BODY = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page", [
    f"<body><!-- <main> --><div><p>{BODY}</p></div></body>",
    f"<body><script>var a='<main>'</script><p>{BODY}</p></body>",
    f"<body><main></main><div><p>{BODY}</p></div></body>",
    f"<body><div><p>{BODY}</p></div><article class='comment'><p>nice post, thanks</p></article></body>",
    f"<body><div class='comments'><article>first!</article></div><div><p>{BODY}</p></div></body>",
])
def test_marks_are_those_of_parsed_elements(page):
    assert extract.main_text(page, dict(extract.DEFAULT)) == BODY


def test_very_long_pages_take_linear_time():
    start = time.time()
    assert extract.main_text("<div>" * 20_000 + "<p>x y</p>" + "</x>" * 20_000, dict(extract.DEFAULT)) in ("", "x y")
    assert extract.main_text("<b>" * 20_000 + "<p>x y</p>" * 2_000, dict(extract.DEFAULT)) is not None
    assert time.time() - start < 5
