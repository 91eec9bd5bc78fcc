"""Quality rules, rollups, HTML extraction, URL filters and license scans."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetide.llm import htmltext, licenses, quality, queries, rollups, urlfilter
from facetide.session import fresh_folder

WORD = re.compile("[^\x20\x09-\x0d]+")


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_rules_as_brute_force(spark, documents, odd_rows, words_of, folder):
    rows = [*odd_rows, (20, "a b c a b c\nx\n\nx\n x"), (21, "#*$ %& |<> ## Ü"), (22, "l 1\nl 1\nl 1\r\n")]
    got = sorted(tuple(r)[1:6] for r in quality.rules(documents(rows)).collect())
    assert got == sorted(rules(t) for _, t in rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(r)[1:6] == rules(texts[r.id]) for r in quality.rules(docs).collect())


def test_forest_and_threshold(spark, documents, words_of, odd_rows):
    rows = [(i, " ".join(w + ("###" if i % 10 == 0 else "") for w in words_of(i, 80))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(300) if i % 2 == 0], "doc_id long, quality int")
    got = {r.id: r for r in quality.judged(documents(rows), labels).collect()}
    assert sum(got[i].kept == (i % 10 != 0) for i, _ in rows) >= 0.9 * len(rows)
    assert not any(r.base_failed for r in got.values())
    out = quality.judged(documents(odd_rows), labels.where("doc_id < 0")).collect()
    assert len(out) == len(odd_rows) and all(r.kept != r.base_failed for r in out)
    assert quality.judged(documents([]), labels).collect() == []


def test_all_rows_grow_the_forest(spark):
    counts = spark.range(30_000).select("id", *[(F.xxhash64(F.lit(s), "id") % 500 + 501).alias(s) for s in quality.STATISTICS])
    forest = quality.grown(counts)
    assert forest.rows.sum() == 30_000 and forest.rows.min() > 200  # more than 100 trees of 256 rows take
    assert quality.grown(counts.limit(300)).rows.sum() == 300 * 86
    few = quality.grown(counts.limit(100))
    assert few.rows.tolist() == [100] * quality.TREES and quality.grown(counts.limit(0)).rows.sum() == 0
    odd = quality.anomaly(forest, quality.features({s: np.array([700, 90_000 if s != "n_words" else 1]) for s in quality.STATISTICS}))
    assert odd[0] < odd[1]


def test_threshold_heeds_every_labelled_row(spark):
    rng = np.random.default_rng(3)
    scores, good = np.round(rng.random(40_000), 4), rng.random(40_000) < 0.6
    good[scores > 0.7] = rng.random((scores > 0.7).sum()) < 0.2
    known = spark.createDataFrame(pa.table({"anomaly": scores, "good": good.astype("int32")}))
    values = np.unique(scores)
    errors = [quality.GOOD_WEIGHT * good[scores > v].sum() + (~good[scores <= v]).sum() for v in values]
    best = int(np.argmin(errors))
    assert quality.threshold(known) == pytest.approx((values[best] + values[best + 1]) / 2, abs=1e-12)
    assert quality.threshold(known.where("good = 1")) == quality.threshold(known.limit(0)) == 1.0



def test_rollup_batches(spark, documents, odd_rows):
    docs = documents(odd_rows)
    counted = rollups.counted(docs, {rollups.WORDS: ""})
    rollup = rollups.Rollup(spark, fresh_folder(spark, "rollup"))
    assert rollup.totals().collect() == []
    assert rollup.commit("one", rollups.delta(None, counted))
    assert not rollup.commit("one", rollups.delta(None, counted))
    expected = collections.defaultdict(lambda: [0, 0, 0])
    for i, text in odd_rows:
        of = expected[f"s{i % 3}", "en", rollups.WORDS]
        for k, x in enumerate((1, len(text or ""), len(WORD.findall(text or "")))):
            of[k] += x
    read = lambda: {tuple(r)[:3]: list(r)[3:] for r in rollup.totals().collect()}
    assert read() == expected
    third = counted.where("source = 's2'")
    assert rollup.commit("two", rollups.delta(third, third.selectExpr("id", "source", "lang", "tokenizer", "n_chars", "n_tokens + 1 AS n_tokens")))
    n, chars, tokens = expected["s2", "en", rollups.WORDS]
    assert read()["s2", "en", rollups.WORDS] == [n, chars, tokens + n]
    assert rollup.commit("three", rollups.delta(counted.where("source = 's1'"), None))
    assert ("s1", "en", rollups.WORDS) not in read()
    assert rollup.commit("none", rollups.delta(None, counted.where("false")))
    assert rollup.committed() == ["none", "one", "three", "two"]


def test_token_count_query(spark, folder):
    from facetide.llm import packing

    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i].text, i)
    encode = packing.encoder(queries.public_tokenizers.path("word_bpe_49k.json")).encode
    expected = collections.defaultdict(lambda: [0, 0, 0])
    for i in first.values():
        text = docs[i].text or ""
        for name, n in ((rollups.WORDS, len(WORD.findall(text))), ("word_bpe_49k", len(encode([text.encode()])[0]))):
            of = expected[docs[i].source, docs[i].lang, name]
            for k, x in enumerate((1, len(text), n)):
                of[k] += x
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op4_token_counts(spark, folder).collect()}
    assert got == {k: v for k, v in expected.items() if v[0]} | {k: v for k, v in got.items() if k[2] == rollups.WORDS and k not in expected}
    assert {k[2] for k in got} == {rollups.WORDS, "word_bpe_49k"}


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div id="top-nav"><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></div><div class="cookie-notice">We use cookies.</div>
%s<div class="sidebar"><p>Other <a href="x">things</a> to <a href="y">read</a></p></div><form><p>Sign in here now</p></form>
<section class="comments"><p>First! What a long and telling comment this is, with many, many words in it.</p></section><footer>&copy; all</footer>"""
BODY = "<h1>A &amp; B\n title</h1><p>The <b>first</b> part  of it,&nbsp;long enough to count as running text.<br>It goes on.<p>Second &lt;part&gt; with <a href=z>one link</a>, and more words that follow it.</p>"
MAIN = "A & B title\nThe first part of it, long enough to count as running text. It goes on.\nSecond <part> with one link, and more words that follow it."


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<div class=content><div>%s</div></div>", "<main>%s", "%s"])
def test_main_text(frame):
    assert htmltext.extract(PAGE % (frame % BODY)) == MAIN


@pytest.mark.parametrize("name", ["content-with-sidebar", "post tag-news", "main-content no-sidebar", "article-header", "has-related-content", "search-results-page", "page-header-fixed layout"])
def test_names_that_only_hold_such_a_word(name):
    article = "".join(f"<p>Paragraph {i} of a text that is long enough to be the article of its page.</p>" for i in range(8))
    page = f"<html><body><div class='menu'><a href='/'>Home</a></div><div class='{name}'>{article}</div><div class='sidebar'><p>An advert in a sidebar.</p></div></body></html>"
    text = htmltext.extract(page)
    assert text.count("Paragraph") == 8 and "advert" not in text and "Home" not in text
    comments = f"<div class='comments'>{article}{article}</div>"
    assert "Paragraph" not in htmltext.extract(f"<html><body><div class='text'><p>The short article itself, of one sentence.</p></div>{comments}</body></html>")


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<html><body></body></html>"), (4, "<nav><a href=x>only</a></nav>"), (5, "plain  text\n here"), (6, "<p>a<p>b</div></p></body>"), (7, "<b" * 50), (8, "<div>" * 3000 + "deep text" + "</div>" * 3000)]
    pages = spark.createDataFrame([(i, "u", h, "x") for i, h in rows], "page_id long, url string, html string, n string")
    got = {r.page_id: r for r in htmltext.main_texts(pages).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 5, 6, 8)] == ["", "", "", "", "plain text here", "a\nb", "deep text"]
    assert all(r.n_chars == len(r.text) and r.n == "x" for r in got.values())
    assert htmltext.main_texts(pages.where("false")).collect() == []


def test_given_pages(spark, folder):
    """The article of every given page, block by block."""
    import html

    for r in queries.op5_html_extraction(spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(x for x in parts if x)


def test_rules_of_hosts_and_paths(spark):
    urls = {
        "https://www.Example.ORG/es/1": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/1?x": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://myexample.org/es/9#t": ("myexample.org", "/es/9", "org/", "allow"),
        "https://a.b.com/de/x": ("a.b.com", "/de/x", "com/de/", "block"),
        "https://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "https://b.com/fr": ("b.com", "/fr", None, "allow"),
        "x://org": ("org", "", None, "allow"),
        "no scheme.org/es/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    none = spark.createDataFrame([], "id long, bad boolean")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(pages, none).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert urlfilter.judged(pages.where("false"), none).collect() == []


def test_templates_are_learned(spark):
    rows, bad = [], []
    for i in range(400):
        kind = ("news", "spam", f"user{chr(97 + i % 26)}{chr(97 + i // 26)}")[i % 3]
        rows.append((i, f"https://h.net/{kind}/{i}/view"))
        bad.append((i, kind == "spam"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.id: r for r in urlfilter.judged(pages, spark.createDataFrame(bad[:200], "id long, bad boolean")).collect()}
    assert {got[i].template for i in got} == {"/news/#/view", "/spam/#/view", "/*/#/view"}
    assert all((got[i].verdict == "block") == b for i, b in bad)


def test_url_segments_vary_at_any_depth(spark):
    """A template that is wholly bad below the third segment is rejected, also where no page of a segment has a label."""
    name = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:03}")
    urls = [f"https://deep.net/one/two/three/four/{name(k)}/{last}" for k in range(120) for last in ("view", "read")]
    pages = spark.createDataFrame([*enumerate(urls), (1000, "https://deep.net/one/two/three/four")], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0) for i in range(160)], "id long, bad boolean")
    got = {r.id: (r.template, r.verdict) for r in urlfilter.judged(pages, labels).collect()}
    begin = "/one/two/three/four"
    assert got.pop(1000)[0] == begin
    assert got == {i: (f"{begin}/*/{('view', 'read')[i % 2]}", ("block", "allow")[i % 2]) for i in range(240)}


def test_license_texts_and_wrapped_notices(documents, words_of):
    """Whole terms and headers, notices without a license word, and notices broken over lines, each inside other text."""
    t = licenses.TEMPLATES
    texts = [*licenses.TEXTS, ("All-Rights-Reserved", "All rights reserved.")]
    wrap = lambda text, n: "\n".join(" ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    other = lambda n: " ".join(words_of(n, 400))
    cases = [(name, text) for name, text in texts] + [(name, wrap(text, 3)) for name, text in [*t.items(), *texts]]
    rows = [(k, f"{other(k)}\n{text}\n\n{other(k + 500)}") for k, (_, text) in enumerate(cases)]
    got = collections.defaultdict(list)
    for r in licenses.found_licenses(documents(rows)).collect():
        got[r.id].append((r.license, r.wording.split()[0]))
    assert dict(got) == {k: [(name, re.findall(r"\w+(?:[-.]\w+)*", text)[0])] for k, (name, text) in enumerate(cases)}


def test_licenses(spark, documents, odd_rows):
    t = licenses.TEMPLATES
    rows = [*odd_rows, *((100 + k, f"Foo bar.\n{x}\nMore.") for k, x in enumerate(t.values()))]
    rows += [(200, f"{t['MIT']} {t['CC-BY-NC-4.0']}"), (201, "Licensed under the Apache License, Version 1.1."), (202, "We license no one."), (203, t["MIT"].upper() + "\nx\n" + t["GPL-3.0"])]
    got = collections.defaultdict(list)
    texts = dict(rows)
    for r in licenses.found_licenses(documents(rows)).collect():
        got[r.id].append(r.license)
        assert texts[r.id][r.start : r.end] == r.wording
    expected = {100 + k: [name] for k, name in enumerate(t)} | {200: ["MIT", "CC-BY-NC-4.0"], 203: ["MIT", "GPL-3.0"]}
    assert dict(got) == expected
    assert licenses.found_licenses(documents([])).collect() == []
