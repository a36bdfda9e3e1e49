import math
import random
import time

import numpy as np
import pytest
from conftest import WORDS, prose
from pyspark.sql import functions as F

from opsloom.llm import quotes, resampling, templates, vector_search
from opsloom.llm.store import kept

VECTORS = "vec_id long, embedding array<float>, rank int, v string"


def vector_rows():
    pick = np.random.default_rng(4)
    rows = [(i, [float(x) for x in pick.standard_normal(16).astype(np.float32)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]                       # copies
    rows += [(2000, rows[0][1]), (2001, [2 * x for x in rows[0][1]]), (2050, [1.0, 2.0]), (2051, [2.0, 1.0])]
    rows += [(3000, None), (3050, []), (3051, [0.0] * 16), (3100, [1.0] * 15 + [float("nan")]),
             (3101, [1.0] * 15 + [None]), (3102, [1.0] * 15 + [float("inf")]), (None, [1.0] * 16), (5, rows[5][1])]
    return rows


def brute_nearest(rows, every, k):
    good = {i: v for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(good):
        if q % every:
            continue
        scored = []
        for i, v in good.items():
            if i != q and len(v) == len(good[q]):
                a, b = np.array(good[q], float), np.array(v, float)
                scored.append((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i))
        scored.sort(key=lambda s: (round(s[0], 12), s[1]))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_vectors(table, block):
    rows = vector_rows()
    docs = table([(i, v, 0, "") for i, v in rows], VECTORS)
    got = sorted(vector_search.nearest(docs, every=50, k=5, query_block=block).collect())
    want = brute_nearest(rows, 50, 5)
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.98 * len(want)
    exact = {(q, i): s for q, _, i, s in brute_nearest(rows, 50, 10_000)}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-9 for r in got)
    assert [(r.query_id, r["rank"]) for r in got] == [(q, n) for q, n, *_ in want]
    assert vector_search.nearest(table([], VECTORS)).count() == 0


def test_codes_bound_inner_products():
    pick = np.random.default_rng(0)
    x, q = pick.standard_normal((500, 48)), pick.standard_normal((20, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q /= np.linalg.norm(q, axis=1)[:, None]
    centre, turn = x.mean(axis=0), vector_search.rotation(48)
    rough, bound = vector_search.estimate(*vector_search.encode(x, centre, turn), 48, (q - centre) @ turn)
    exact = (x - centre) @ (q - centre).T
    assert (np.abs(rough - exact) <= bound).mean() > 0.99
    assert np.corrcoef(rough.ravel(), exact.ravel())[0, 1] > 0.75


def labelled_docs():
    pick = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        kind = ("target", "target", "junk", "toxic")[i % 4]
        text = prose(i, pick.randint(20, 120))
        if kind == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split(" "))
        if kind == "toxic":
            words = text.split(" ")
            for _ in range(max(2, len(words) // 12)):
                words[pick.randrange(len(words))] = pick.choice(["vilexo", "vilexa", "grobunt"])
            text = " ".join(words)
        rows.append((i, text, 0, 0.0))
        if i % 3:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    rows += [(5000, None, 0, 0.0), (5001, "", 0, 0.0), (5002, prose(9, 20_000), 0, 0.0), (1, rows[1][1], 0, 0.0)]
    return rows, labels + [(None, 1, 0), (99_999, 1, 0), (3, None, None)]


def test_resampling_on_unseen_rows(table):
    rows, labels = labelled_docs()
    docs = table(rows, "doc_id long, text string, uid long, log_weight double")
    marks = resampling.label_kinds(table(labels, "doc_id long, quality int, toxic int"))
    out = resampling.selected_documents(docs, marks)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    unseen = [i for i in range(0, 1200, 3)]
    wanted = [i for i in unseen if i % 4 < 2]
    assert len(kept & set(wanted)) >= 0.97 * len(wanted)
    assert len(kept & (set(unseen) - set(wanted))) <= 0.03 * len(unseen)
    assert {5000, 5001, 5002} <= kept
    few = resampling.resample(docs, marks, k=17)
    assert few.count() == 17 and resampling.resample(docs, marks, k=0).count() == 0
    assert resampling.resample(docs, marks, k=10**9).count() == len(rows)
    assert resampling.resample(docs.limit(0), marks).count() == 0
    assert resampling.resample(docs, marks.limit(0)).count() == len(rows)


def test_gumbel_top_k_is_exact_and_follows_weights(spark, table):
    spread = table([(i, i, float(i % 7)) for i in range(30_000)], "uid long, order long, log_weight double")
    top = resampling.gumbel_top_k(spread, 5000)
    every = spread.withColumn("sample_key", F.col("log_weight") + resampling.gumbel(7, F.col("order"), F.col("log_weight")))
    want = {r.uid for r in every.orderBy(F.desc("sample_key")).limit(5000).collect()}
    assert {r.uid for r in top.collect()} == want
    same = table([(i, 1, 0.0) for i in range(25_000)], "uid long, order long, log_weight double")
    assert sorted(r.uid for r in resampling.gumbel_top_k(same, 11).collect()) == list(range(11))
    noise = np.array([r[0] for r in every.select(F.col("sample_key") - F.col("log_weight")).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.var() - math.pi**2 / 6) < 0.08


def test_too_many_kinds_are_refused(table):
    docs = table([(i, f"text {i}") for i in range(70)], "doc_id long, text string")
    kinds = table([(i, f"kind {i}") for i in range(70)], "doc_id long, kind string")
    with pytest.raises(ValueError, match="64 kinds"):
        resampling.fit_ratio_model(docs, kinds)


def test_too_many_widths_are_refused(table):
    vectors = table([(i, [1.0] * (i + 1), 0, "") for i in range(1001)], VECTORS)
    with pytest.raises(ValueError, match="1000 widths"):
        vector_search.nearest(vectors)


PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>if (a<b) "</p>";</script></head>
<body><div class=top><span>My site</span> <b>slogan</b></div><div id='x{n}'>
<p>Start {n} of &eacute;t&#233; &amp; co<br>next   line<p>second <i>part</i> {n}</div>
<div class="comments"><p>I like it</div><form><p>mail</form><table><tr><td>Imprint<td>Contact</table></body>"""


def page_rows():
    rows = [(i, "http://www.a.example/p", PAGE.format(n=i), "") for i in range(8)]
    rows += [(100 + i, "https://a.example:80/q", PAGE.format(n=100), "") for i in range(40)]      # copies
    rows += [(200, "http://b.example/", "<p>alone <b>bold", ""), (201, None, None, ""), (202, "x", "", ""),
             (203, "http://c.example/", "<article><h1>Head</h1><p>Text</p><aside>no</aside></article><p>after", ""),
             (204, "http://c.example/", "<p>" * 3000 + "deep", ""), (205, "http://c.example/", "a < b <!-- <p> --> &lt;c&gt; <", "")]
    return rows


def test_main_texts(table):
    pages = table(page_rows(), "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in templates.main_texts(pages).collect()}
    for i in [*range(8), *range(100, 140)]:
        n = min(i, 100)
        assert got[i].text == f"Start {n} of été & co next line second part {n}"
        assert got[i].n_chars == len(got[i].text)
    assert got[200].text == "alone bold" and got[201].text == got[202].text == "" and got[202].n_chars == 0
    assert got[203].text == "Head Text" and got[204].text == "deep" and got[205].text == "a < b <c> <"
    assert templates.main_texts(pages.limit(0)).count() == 0


def test_paragraphs_shared_by_articles_stay(table):
    rows = [(i, "http://s.example/", f"<nav>n</nav><article><p>own {i}</p><p>shared by all</p></article>", "") for i in range(30)]
    got = templates.main_texts(table(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.text == f"own {r.page_id} shared by all" for r in got)


def text_of(page):
    return templates.main_text(templates.parse(page))


def test_attribute_words_spare_main_text():
    for wrapper in ('class="content no-sidebar"', 'id="layout-with-nav"', 'class="sidebar"'):
        assert text_of(f"<div {wrapper}><article><p>Text</article></div><p>after") == "Text"
    inner = '<h2 id="legal-framework">a</h2><section id="related-work">b</section><p class="side-effects notice">c</p>'
    assert text_of(f"<article>{inner}<div class=comments>no</div></article>") == "a b c"
    assert text_of(f'{inner.replace(" notice", "")}<div class="box Sidebar">no</div><div id=nav>no</div>') == "a b c"


def test_adverts_notices_and_comments_inside_articles():
    aside = ('<div class="advert">no</div><div class="cookie-notice">no</div><ul class="share"><li>no</ul><div class="comment-body">no</div>'
             '<div class="comment-list">no</div><div class="comments-area">no</div><div id="comments">no</div>')
    assert text_of(f"<article>Text{aside}<p class=notice>too</p></article>") == "Text too"
    assert text_of('<main><p>Text</p><article class="related-post">no</article></main>') == "Text"


def test_text_outside_articles():
    long = "long text " * 20
    assert text_of(f'<div id="content">{long}</div><article class="teaser">Other post</article>') == long.strip()
    assert text_of(f"<div>{long}</div><article>Short post</article>") == long.strip() + " Short post"
    assert text_of('<body><div id="legal"><p>Terms</p></div></body>') == "Terms"
    frame = '<div class="main-sidebar">no</div><div class="site-header">no</div><div class="page-footer">no</div>'
    assert text_of(f"<body>{frame}<p>Text</p></body>") == "Text"


def test_boxes_inside_articles_need_many_pages(table):
    def texts(n):
        rows = [(i, "http://q.example/", f"<article><p>own {i}</p><div>box</div></article>", "") for i in range(n)]
        return [r.text for r in templates.main_texts(table(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()]

    assert texts(5) == [f"own {i} box" for i in range(5)] and texts(12) == [f"own {i}" for i in range(12)]


@pytest.mark.parametrize("page", [
    "<div>" * 60_000 + "</span>" * 60_000 + "x", '<div class="nav">' * 60_000 + "<article>x</article>", "<p><div>" + "<span>" * 60_000 + "<hr>" * 60_000 + "x",
    "<li><ul>" + "<div>" * 60_000 + "<li></li>" * 60_000 + "x", "<a>" * 200_000 + "x"])
def test_odd_pages_take_linear_time(page):
    began = time.time()
    root = templates.parse(page)
    templates.hash_subtrees(root)
    templates.template_candidates(root)
    assert templates.main_text(root) == "x" and time.time() - began < 20


def brute_templates(rows):
    """(host, text) of outermost repeated divs, counted over the pages' different main texts."""
    seen = {}
    for host, own, boxes in rows:
        for box in boxes:
            seen.setdefault((host, box), set()).add(own)
    return {k for k, v in seen.items() if len(v) >= 3}


def test_counts_per_host_equal_brute_force(table):
    pick = random.Random(4)
    rows = [(pick.choice("abc"), f"own {pick.randint(0, 25)}", [f"box {pick.randint(0, 12)}" for _ in range(pick.randint(0, 4))]) for _ in range(120)]
    pages = [(i, f"http://{h}.example/", f"<article>{own}</article>" + "".join(f"<div>{b}</div>" for b in boxes), "") for i, (h, own, boxes) in enumerate(rows)]
    df = table(pages, "page_id long, url string, html string, text string")
    found = df.select(templates.host_of(F.col("url")).alias("host"), "html", F.col("page_id").alias("uid")).select("uid", "host", "html").mapInArrow(
        templates._subtrees, "uid long, host string, main long, subtrees array<long>")
    got = {(r.host, r.subtree) for r in templates.template_subtrees(found).collect()}
    want = set()
    for host, box in brute_templates([(f"{h}.example", own, boxes) for h, own, boxes in rows]):
        root = templates.parse(f"<div>{box}</div>")
        templates.hash_subtrees(root)
        want.add((host, root.children[0].key))
    articles = set()
    for h, own, _ in rows:
        root = templates.parse(f"<article>{own}</article>")
        templates.hash_subtrees(root)
        articles.add((f"{h}.example", root.children[0].key))
    assert got - articles == want and want


def test_section_templates_of_a_large_host(table):
    page = "<div><p>notice {s}</p></div><div><p>own {i} text</p></div>"
    rows = [(i, "http://l.example/", page.format(s=i // 4, i=i), "") for i in range(400)]
    got = templates.main_texts(table(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.text == f"own {r.page_id} text" for r in got)


def test_long_template_parts_go(table):
    legal = " ".join(f"clause {k} of the terms" for k in range(300))
    rows = [(i, "http://t.example/", f"<div>{legal}</div><div><p>own {i}</p></div>", "") for i in range(5)]
    got = templates.main_texts(table(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.text == f"own {r.page_id}" for r in got)
    long, holder = "<div>" + legal + "</div>", "<div><article>x</article></div>"
    root = templates.parse(long + holder)
    templates.hash_subtrees(root)
    found = templates.template_candidates(root)
    assert root.children[0].key in found and root.children[1].key not in found


def test_articles_in_page_order_without_comments():
    noise = "<script>" + "x" * 900 + "</script>"
    assert text_of(f"<article>{noise}one</article><p>no</p><article>two, longer</article><article>3</article>") == "one two, longer 3"
    comment = '<article class="comment">a reader says very much more than the article</article>'
    assert text_of(f"<article>Text{comment}</article>") == "Text"
    assert text_of(f"<article>Text</article>{comment}<div class=comments>{comment}</div>") == "Text"


def test_articles_of_the_template_go(table):
    rows = [(i, "http://u.example/", f"<article>own text of page {i}</article><article>offer</article>", "") for i in range(5)]
    got = templates.main_texts(table(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.text == f"own text of page {r.page_id}" for r in got)


MAILS = [
    ("a", 1, "Hello all\n\nwhen do we meet?"),
    ("b", 5, "On Monday.\n\nOn 1 May A wrote:\n> Hello all\n>\n> when do we  MEET?"),
    ("c", 9, "> On Monday.\n> > when do we meet?\nFine for me"),
    ("d", 9, ">> when do we meet?\n\nI answer the first"),
    ("e", 12, "> quoted from nowhere\nalone"),
    ("f", 20, "Hello all"), ("g", 30, "> Hello all\nhi back"), ("h", 3, "> Fine for me\ntoo early"),
    ("i", 40, None), ("j", 41, ""), ("k", None, "> Hello all\nno time"), (None, 50, "> Hello all"),
    ("a", 1, "Hello all\n\nwhen do we meet?"), ("l", 60, "> Fine for me\n> alone\nto two, the longer"),
]


@pytest.mark.parametrize("span", [quotes.SPAN, 4])
def test_quotations_link_messages(spark, span):
    mails = spark.createDataFrame([(*m, "x") for m in MAILS], "id string, sent long, text string, parent string")
    got = {r.id: r for r in quotes.conversations(mails, span=span).collect()}
    assert {k: r.parent for k, r in got.items()} == {
        "a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": None, "g": "f", "h": None, "i": None, "j": None,
        "k": None, "l": "c"}
    assert [(got[k].conversation, got[k].position, got[k].depth) for k in "abcdl"] == [
        ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 1), ("a", 5, 3)]
    assert got["b"].text == "On Monday." and got["c"].text == "Fine for me" and got["i"].text == ""
    assert got["a"].text == "Hello all\n\nwhen do we meet?"


def test_long_chains_and_hot_passages(spark):
    rows = [(0, 0, "start 0")] + [(i, i, f"start {i}\n> start {i - 1}") for i in range(1, 300)]
    rows += [(1000 + i, 1000 + i, "thanks") for i in range(200)] + [(3000 + i, 1100, f"> thanks\nre {i}") for i in range(50)]
    got = {r.id: r for r in quotes.conversations(
        spark.createDataFrame(rows, "id long, sent long, text string"), span=64).collect()}
    assert all(got[i].conversation == 0 and got[i].position == i + 1 and got[i].depth == i for i in range(300))
    assert all(got[3000 + i].parent == 1099 for i in range(50))
    assert quotes.conversations(spark.createDataFrame([], "id long, sent long, text string")).count() == 0


def read(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(quotes.read_lines(F.col("text")).alias("lines"))
    row = kept(df, "lines").select("lines", quotes.passages(F.col("lines")).alias("found")).first()
    return [(x.level, x.line) for x in row.lines], sorted((x.level, x.form) for x in row.found)


def test_lines_and_passages(spark):
    lines, found = read(spark, "Hi\r\nOn Monday she wrote:\n\n> a  B\n> c\n>> d\n> \n> e\nOn Monday he wrote:\nbye\u0001")
    assert lines == [(0, "Hi\r"), (-1, "On Monday she wrote:"), (0, ""), (1, "a  B"), (1, "c"), (2, "d"), (1, ""), (1, "e"),
                     (0, "On Monday he wrote:"), (0, "bye\u0001")]
    assert found == [(0, "bye"), (0, "hi"), (0, "on monday he wrote:"), (0, "on monday he wrote: bye"),
                     (1, "a b"), (1, "a b c"), (1, "c"), (1, "e"), (2, "d")]


def test_deep_and_long_quotations(spark):
    lines, found = read(spark, ">" * 1_000_000 + " deep")
    assert lines == [(1_000_000, "deep")] and found == [(1_000_000, "deep")]
    lines, found = read(spark, " " * 300_000 + "x")
    assert lines[0][0] == 0
    text = "\n".join(">" * (1 + i % 500) + f" line {i}" for i in range(20_000))
    began = time.time()
    lines, found = read(spark, text)
    assert len(found) == 20_000 and time.time() - began < 30


def test_words_fixture_is_plain():
    assert len(set(WORDS)) == len(WORDS)
