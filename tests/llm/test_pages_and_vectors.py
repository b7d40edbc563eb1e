import html
import random
import re

import numpy as np

from codegauge.llm.html_dom import parse
from codegauge.llm.html_extraction import Weights, _labels, _unmarked, extract_text, forest, marginals, page_texts, trained
from codegauge.llm.html_extraction import EDGE_FEATURES, NODE_FEATURES
from codegauge.llm.html_pages import labelled_page
from codegauge.llm.nearest import RandomForest, grow, nearest
from tests.conftest import SMALL

PAGE = """<!DOCTYPE html><html><head><title>t &lt;</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use &amp; keep cookies <button>OK</button></div>
<article><h1>Title &amp; more</h1><p>First   para\n with <b>bold</b>&nbsp;text &eacute;&#233;.<p>Second<br>line one two three.
<div class="ad">Buy now</div><ul><li>item one<li>item two</ul><script>var t="</p>";</script></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I disagree with all of this.</p></div></section>
<aside class="sidebar"><p>Side text</p></aside><form><label>Mail</label><input></form><footer>&copy; x &middot; y</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int")


def test_page_in_full():
    assert page_texts([PAGE], trained(), {})[0].split("\n") == [
        "Title & more", "First para with bold text éé.", "Second line one two three.", "item one", "item two"]


def test_head_without_end_and_body_tags():
    def said(page):
        return [t for t in parse(page, {}).text if t]
    assert said("<html><head><title>t</title><meta charset=x><article><p>one<p>two</article>") == ["one", "two"]
    assert said("<head><style>a{}</style>\n <link rel=x>\nplain text <b>bold</b>") == ["plain text bold"]
    assert said("<head><title>t</title><a href=x>link</a> and</head> more") == ["link and more"]
    assert said("<head><title>t</title>\n<script>x</script></head><body>text") == ["text"]
    assert said("<p>before<head><title>t</title></head>after") == ["beforeafter"]


def test_attributes_end_where_they_end():
    def said(page):
        return [t for t in parse(page, {}).text if t]
    assert said("<article><p data-x=it's>Hello one two three.</p><p>It's me and text</p></article>") == ["Hello one two three.", "It's me and text"]
    assert said('<p title="a"">first words</p><p>more</p>') == ["first words", "more"]
    assert said("<p title='a>b' x = \"c>d\" y=a\"b>one</p>") == ["one"]
    assert said('<p "quoted" \'name\'>two</p><p class=>three</p>') == ["two", "three"]
    assert said("<p>four <a href=x title=\"open > to the end") == ["four"]


def test_content_of_embedded_elements_stays():
    def said(page):
        return [t for t in parse(page, {}).text if t]
    assert said("<p>b <object>fall back</object> and <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>") == ["b fall back and x=1"]
    assert said("<p>see <video src=x>no video</video>, <canvas>a chart</canvas>, <noscript>plain</noscript>.</p>") == ["see no video, a chart, plain."]
    assert said("<noscript>Switch scripts on</noscript><p>text</p>") == ["Switch scripts on", "text"]
    page = "<body><noscript>Please switch scripts on.</noscript><article><h1>A title of words</h1><p>Text with a <math><mi>y</mi></math> in it, and some more words.</p></article></body>"
    assert page_texts([page], trained(), {})[0] == "A title of words\nText with a y in it, and some more words."


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    weights = Weights(rng.normal(size=NODE_FEATURES), rng.normal(size=(EDGE_FEATURES, 2, 2)))
    f = forest([parse("<div><p>a</p><ul><li>b</ul></div>c", {}), parse("x<nav>y</nav>", {})])
    p, pair = marginals(f, weights)
    local, couple = f.features @ weights.node, np.tensordot(f.edge, weights.edge, axes=1)
    n, total, one = len(p), 0.0, np.zeros(len(p))
    for bits in range(2**n):
        y = [bits >> k & 1 for k in range(n)]
        mass = np.exp(sum(local[k] * y[k] + (couple[k, y[f.parent[k]], y[k]] if f.parent[k] >= 0 else 0) for k in range(n)))
        total += mass
        one += mass * np.array(y)
    assert np.allclose(p, one / total)
    inner = f.parent >= 0
    assert np.allclose(pair[inner].sum(axis=(1, 2)), 1) and np.allclose(pair[inner][:, :, 1].sum(axis=1), p[inner])


def test_held_out_labelled_pages():
    rng = random.Random(77)
    trees = [parse(labelled_page(rng), {}) for _ in range(200)]
    f = forest([_unmarked(t) for t in trees])
    y = _labels(trees, f)
    p, _ = marginals(f, trained())
    assert ((p > 0.5) == y)[f.is_text].mean() > 0.99


def test_awkward_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "x", ""), (3, "x", "plain text only"), (4, "x", "<<<>>&&;<a href='" * 50),
            (5, "x", "<div>" * 3_000 + "deep" + "</div>" * 10), (6, "x", "<article>" + "<p>long words here.</p>" * 20_000 + "</article>"),
            (7, "x", "<article></article><nav>m</nav>"), (8, "x", "<!-- never closed <p>x"), (9, "x", "<article><p>\x00 a &#0; &#x110000; &bogus; b</article>")]
    out = extract_text(pages(spark, rows)).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    by = {r["page_id"]: r["text"] for r in out}
    assert by[2] == by[None] == by[7] == by[8] == "" and by[6].count("\n") == 19_999
    assert extract_text(pages(spark, [])).collect() == []


def test_every_page_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in table.collect()}
    for r in extract_text(table).collect():
        inner = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


# --- vectors ----------------------------------------------------------------------------------------------------

def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")


def brute(rows, every, k):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in good if j != i)
            out[i] = [j for _, j in near[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    expected, found = brute(rows, 50, 5), answers(nearest(table))
    assert found.keys() == expected.keys()
    assert np.mean([len(set(found[q]) & set(expected[q])) / 5 for q in expected]) >= 0.9


def test_recall_where_leaves_are_few_against_many_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.2 * rng.normal(size=16)).tolist()) for k in range(6_000)]
    expected, found = brute(rows, 500, 5), answers(nearest(frame(spark, rows), 500))
    assert np.mean([len(set(found[q]) & set(expected[q])) / 5 for q in expected]) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=8).tolist()
    rows = [(k, one) for k in range(0, 300)] + [(1_000 + k, rng.normal(size=8).tolist()) for k in range(60)]
    bad = [(2_000, None), (2_050, [0.0] * 8), (2_100, [1.0] * 7 + [float("nan")]), (2_150, [1.0] * 7 + [float("inf")]), (2_200, [1.0] * 7 + [None]),
           (2_250, [1.0] * 5), (2_300, []), (None, one), (1_001, rows[301][1])]
    found, expected = answers(nearest(frame(spark, rows + bad), share=1.0)), brute(rows, 50, 5)
    assert found == expected and found[0] == [1, 2, 3, 4, 5] and found[50] == [0, 1, 2, 3, 4]


def test_few_rows_and_none(spark):
    assert answers(nearest(frame(spark, [(0, [1.0, 0.0]), (50, [1.0, 1.0])]))) == {0: [50], 50: [0]}
    assert nearest(frame(spark, [(0, [1.0, 0.0])])).collect() == [] and nearest(frame(spark, [])).collect() == []


def test_forest_reaches_every_leaf():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(500, 6))
    forest_ = RandomForest([grow(points, 20, rng) for _ in range(3)])
    leaves = int(forest_.offsets[-1])
    assert sorted(forest_.search(points[0], leaves + 5)) == list(range(leaves))
    for k, tree in enumerate(forest_.trees):
        place = tree.place(points)
        assert np.bincount(place, minlength=tree.leaves).max() <= 20 and (np.bincount(place) > 0).all()
        assert int(place[7] + forest_.offsets[k]) in forest_.search(points[7], 3)
    assert grow(np.ones((50, 4)), 5, rng).leaves == 1
