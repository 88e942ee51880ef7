"""Pages, vectors and the pipeline."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.nearest import neighbours
from tidemark.llm.pages import Page, extracted, main_text
from tidemark.llm.queries import QUERIES

BASE = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Site</a><h2>Head</h2></header>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>%s<script>var t="</p>";</script><footer>&copy; 2020 someone</footer></body></html>"""


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("   ", ""), ("<p>Hello", "Hello"), ("just words &amp; more", "just words & more"), ("<title>only</title>", ""),
    (PAGE % "<article><h1>A &lt; B</h1><p><b>Bold.<br><p>Second\n  para&nbsp;graph.</article>", "A < B\nBold.\nSecond para graph."),
    (PAGE % "<div class=ad>Buy this now please</div><main><p>Words of the text, many words.</p><ul><li>x<li>y</ul></main>", "Words of the text, many words.\nx\ny"),
    (PAGE % "<div id=content><p>First paragraph of some length.</p><p>Second paragraph of some length.</p></div><div class='comments'><p>A reader says a lot "
     "of words here, more than the article itself has in it.</p></div>", "First paragraph of some length.\nSecond paragraph of some length."),
    (PAGE % "<div class='cookie-banner'>We use cookies a lot</div><article><p>Text &#233;&#x65e5;</p><form><input><p>Name</form><aside>Side</aside></article>", "Text é日"),
    (PAGE % "<div class='sidebar wrapper'><article><p>Inside a wrapper.</article></div>", "Inside a wrapper."),
    (PAGE % "<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n y</pre></article>", "a\nb\nc\nx y"),
    (PAGE % "<article>Before<p>One<!-- <p>no</p> --> two</p>after</article>", "Before\nOne two\nafter"),
])
def test_main_text(html, text):
    assert main_text(html) == text


TEXT = "".join(f"<p>Paragraph {i} of the article, long enough to be the text of a page.</p>" for i in range(4))
LINES = "\n".join(f"Paragraph {i} of the article, long enough to be the text of a page." for i in range(4))


@pytest.mark.parametrize("wrapper", [
    "<div class='content no-sidebar'>%s</div>", "<div class=has-sidebar>%s</div>", "<div id=search-results>%s</div>", "<div class='post comments-open'>%s</div>",
    "<div class='elementor-element elementor-widget elementor-widget-text-editor'><div class=elementor-widget-container>%s</div></div>",
    "<article><div class='elementor-widget elementor-widget-text-editor'>%s</div></article>", "<div class=form>%s</div>", "<div class='widget widget_text'>%s</div>",
    "<article class=comments-closed>%s</article>", "<div class=search><div class=privacy>%s</div></div>",
    "<article>%s<div class=share-buttons><a href=x>Post it</a><a href=y>Mail it</a></div></article>",
    "<div class=content>%s</div><div class=sidebar><p>Some words beside it.</p></div>", "<div class=content>%s</div><div class=cookie-banner>We use cookies</div>",
])
def test_names_in_wrappers(wrapper):
    assert main_text(PAGE % (wrapper % TEXT)) == LINES
    assert main_text(PAGE % (wrapper % TEXT + "<div class=ad>Buy this</div>")) == LINES


SHORT = "<p>A short one.</p>"


@pytest.mark.parametrize(("inside", "text"), [
    ("<form id=aspnetForm><input type=hidden value=1>%s<select><option>x</select></form>", LINES),
    ("<form><div><article>%s</article></div></form>", LINES),
    ("<form><nav><a href=x>Menu</a></nav><div class=content>%s</div><footer>By them</footer></form>", LINES),
    ("<div class=content>%s</div><form><p>Your name</p><input></form>", LINES),
    ("<article>%s</article><article><h2>Second</h2><p>Another article of the page.</p></article>", LINES + "\nSecond\nAnother article of the page."),
    ("<main><h1>Title</h1><article>%s</article><article><p>Another article of the page.</p></article></main>", "Title\n" + LINES + "\nAnother article of the page."),
    ("<main><article>%s</article><ul><li><a href=a>Next one</a><li><a href=b>One before</a></ul></main>", LINES),
    ("<article>%s</article><article><a href=x>A teaser that is all link</a></article>", LINES),
    ("<section>%s</section><section>" + SHORT + "</section>", LINES + "\nA short one."),
    ("<div>%s</div><div>" + SHORT + "</div>", LINES + "\nA short one."),
    ("<h1>A title</h1><div id=content>%s</div>", "A title\n" + LINES),
    ("<h1>A title</h1><div><div>%s</div></div><ul><li><a href=a>Elsewhere</a><li><a href=b>And there</a></ul>", "A title\n" + LINES),
    ("Loose words <b>before</b> it<div>%s</div>", "Loose words before it\n" + LINES),
])
def test_nothing_else_is_dropped(inside, text):
    assert main_text(PAGE % (inside % TEXT)) == text


def by_definition(html):
    """Composite text density of every node of a tree without parts to leave out, from its definition."""
    import math
    import xml.etree.ElementTree as ET

    root = ET.fromstring(html)

    def count(node):
        tags = sum(1 for _ in node.iter()) - 1
        chars = len("".join("".join(node.itertext()).split()))
        links = [a for a in node.iter("a") if a is not node]
        return chars, max(tags, 1), sum(len("".join("".join(a.itertext()).split())) for a in ([node] if node.tag == "a" else links)), len(links)

    whole = count(root)
    ratio = whole[2] / max(whole[0], 1)

    def density(node):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return max(0.0, c / t * (math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base))

    sums = {node: sum(density(child) for child in node) for node in root.iter()}
    best = max(sums.values())
    return next(" ".join("".join(node.itertext()).split()) for node in root.iter() if sums[node] == best)


def test_densest_subtree_by_definition():
    rng = np.random.default_rng(6)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(1, 30)))
            return f"<a>{words}</a>" if rng.random() < 0.25 else f"<p>{words}</p>"
        return "<div>" + "".join(tree(depth - 1) for _ in range(rng.integers(1, 5))) + "</div>"

    for _ in range(150):
        html = "<body>" + "".join(tree(3) for _ in range(3)) + "</body>"
        page = Page(html)
        link = [False] * len(page.tag)
        for i in range(1, len(link)):
            link[i] = link[page.parent[i]] or page.tag[i] == "a"
        best = page.measured([len("".join(x.split())) for _, x in page.texts], link, frozenset())[4]
        under = [False] * len(link)
        for i in range(len(link)):
            under[i] = i == best or (i > 0 and under[page.parent[i]])
        assert " ".join(" ".join(x for i, x in page.texts if under[i]).split()) == " ".join(by_definition(html.replace("</", " </")).split())


def test_hostile_pages_end_soon():
    start = time.time()
    for html in ("<" * 50_000, "<p " * 50_000, "<div>" * 20_000 + "x", "<a href='" * 20_000 + ">", "<!--" * 20_000, "&" * 50_000, "</p>" * 50_000, "<b>" * 20_000):
        main_text(html)
    assert time.time() - start < 60


def test_extracted(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x y"), (3, "u", "<p>x y"), (3, "u", "<p>x y"), (4, "u", PAGE % ("<article><p>" + "word " * 200_000 + "</article>"))]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(map(tuple, extracted(pages).collect()), key=str)
    assert [(r[0], r[3]) for r in got] == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 999_999), (None, 3)]
    assert extracted(pages.limit(0)).count() == 0
    given = spark.read.parquet(f"{BASE}/pages.parquet")
    out = QUERIES["op8_html_extraction"](spark, BASE)
    assert out.count() == given.count() and out.where("n_chars = 0 or text like '%<p%' or text like '%track(%'").count() == 0


def brute_nearest(rows, k=20):
    table = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in table:
        if i % 20 == 0:
            scored = sorted((-float(np.dot(v, w)), j) for j, w in table if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_neighbours_of_few_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(1, 200)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for i in range(60)]
    rows += [(20, rows[19][1]), (400, None), (401, [0.0] * 6), (402, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [1.0] * 5), (405, [1.0, 2.0]), (406, []), (None, [1.0] * 6)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, leaf string, rank int").repartition(4)
    found = neighbours(table, F.col("vec_id") % 20 == 0, recall=1.0).collect()
    want = brute_nearest([r for r in rows if r[1] is None or len(r[1]) == 6])
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(want)
    hits = 0
    for q, near in by.items():
        near.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in near] == list(range(1, 21))
        assert all(a["score"] > b["score"] or (a["score"] == b["score"] and a["vec_id"] < b["vec_id"]) for a, b in zip(near, near[1:]))
        hits += len({r["vec_id"] for r in near} & {j for j, _ in want[q]})
    assert hits >= 0.95 * 20 * len(want)
    few = neighbours(table.where("vec_id <= 20"), F.col("vec_id") % 20 == 0).collect()
    assert {r["vec_id"] for r in few} == set(range(1, 20)) and len(few) == 19
    assert neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours(table.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall(spark):
    base = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{base}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, base).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        recall.append(len(found[ids[q]] & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_pipeline(spark, tmp_path):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    given, seen = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, BASE)
        assert name == "encode" or out.columns == given
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0 and seen[4] == seen[5]


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none):
    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (odd, odd.select(plain), none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, BASE).write.format("noop").mode("overwrite").save()
