import html
import random
import re

import pytest

from quire.llm import html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site</h1><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies. Please accept them all, it is good for you and for us.</p></div>
<main><article><header><h1>The &eacute;vent</h1></header><!-- note <p>no</p> -->
<p>First   paragraph &amp; more<br>of it.</p><div class="ad">Buy this now, it is really very good and cheap today.</div>
<p>Second <b>bold <i>both</b> text.<ul><li>one<li>two</ul><script>var x = "</p><p>nope</p>";</script>
x < 3 &lt;b&gt;<section id="comments"><h3>Comments</h3><p>I think this is great and long enough to look like real text. Yes.</p></section></article></main>
<aside><p>Related: another long story that you would surely like to read as well.</p></aside>
<form><label>Name</label><textarea>write here</textarea><button>Send</button></form>
<footer><p>Copyright. All rights reserved. Long enough text to be mistaken for content.</p></footer></body></html>"""


def test_a_page():
    assert html_text.main_text(PAGE).split("\n") == ["The évent", "First paragraph & more of it.", "Second bold both text.", "one", "two", "x < 3 <b>"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("<", ""),
        ("<p>", ""),
        ("<!-- never closed <p>x</p>", ""),
        ("<script>never closed", ""),
        ("<article><p>A long enough sentence, clearly. &am &quo &copy</p>", "A long enough sentence, clearly. &am &quo ©"),
        ("<article><p>one<p>two<div>three</div>four</article>", "one\ntwo\nthree\nfour"),
        ("<article><p title='a > b' class=\"x\">in</p><p hidden>out</p><p style='display: none'>out</p></article>", "in"),
        ("<article><p>a <a href='x'>link</a> in a sentence.</p></article>", "a link in a sentence."),
        ("<nav>" + "<a href=x>menu</a> " * 50 + "</nav>", ""),
    ],
)
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


def test_cuts_are_least():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 7)
        excess = [rng.randint(-9, 9) for _ in range(n)]
        links = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]

        def cost(side, excess=excess, links=links):
            lost = sum(max(0, -e) if s else max(0, e) for e, s in zip(excess, side, strict=True))
            return lost + sum(w for a, b, w in links if side[a] != side[b])

        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(excess, links)) == least


def test_smoothness_keeps_a_doubtful_block():
    found, _ = html_text.blocks("<div><p>" + "Long text of the page goes here and on. " * 6 + "</p><p>short</p><p>" + "More of that text is found here as well. " * 6 + "</p></div>")
    odds = [html_text.block_odds(b) for b in found]
    assert odds[1] < odds[0] and html_text.main_text("<div>" + "".join(f"<p>{b.text}</p>" for b in found) + "</div>").count("\n") == 2


def test_query_finds_the_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op6_main_text(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, None, "t"), (2, "", "t"), (2, "", "t"), (3, "<p>" * 30_000 + "deep", "t"), (4, "<div>" * 3000 + "<article>text of it</article>", "t"), (5, "<" * 50_000, "t"), (6, "<article><p>ok", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract(df).orderBy("page_id").collect()
    assert [r.n_chars for r in got][:3] == [0, 0, 0] and got[0].text == "" and got[-1].text == "ok" and len(got) == 7
    assert html_text.extract(df.limit(0)).count() == 0


def test_many_blocks_are_quick():
    import time

    began = time.time()
    text = html_text.main_text("<div>" + "".join(f"<p>{'word ' * (k % 9)}{k}</p>" for k in range(4000)) + "</div>")
    assert time.time() - began < 30 and text.count("\n") > 100


STORY = "The council met on Tuesday and agreed on a plan for the old harbour. " * 5
BAR = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="no-sidebar">{BAR}<h1>Plan agreed</h1><p>{STORY}</p></body>',
        f'<body><form id="aspnetForm">{BAR}<h1>Plan agreed</h1><p>{STORY}</p></form></body>',
        f'<body><div class="page menu-closed">{BAR}<h1>Plan agreed</h1><p>{STORY}</p></div></body>',
        f'<body>{BAR}<article class="post has-comments"><h1>Plan agreed</h1><p>{STORY}</p></article></body>',
        f'<body class="comments-open">{BAR}<div id=wrap class=sidebar-left><div><h1>Plan agreed</h1><p>{STORY}</p></div><div class="sidebar"><p>Read this too, it is a long line about something else.</p></div></div></body>',
        f'<body>{BAR}<article><h1>Plan agreed</h1><p>{STORY}</p><section class="comments"><p>I am against it, as it costs too much for all of us here.</p></section></article></body>',
        f'<body>{BAR}<form><h1>Plan agreed</h1><p>{STORY}</p><object>{BAR}</object></form><form><label>Name</label><p>Write to us.</p></form></body>',
    ],
)
def test_names_of_the_whole_page_are_no_evidence(page):
    assert html_text.main_text(page) == "Plan agreed\n" + STORY.strip()


def test_formulas_stay_in_their_sentence():
    page = f"<article><p>{STORY}</p><p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> be the number of all boats.</p></article>"
    assert html_text.main_text(page).split("\n")[1] == "Let x+1 be the number of all boats."


@pytest.mark.parametrize(
    "page",
    ["<a b" * 250_000, "<a b" * 250_000 + ">", "<svg>" * 100_000, "<x-y>" * 50_000 + "<p>text</p>" * 1000, "<b>" * 50_000 + "x<p>y" * 1000, "</i>" * 200_000, "<p " + "a" * 500_000 + ">", "<p>x</p><div>" * 50_000, "&" * 500_000, "<!--" * 100_000],
)
def test_hostile_pages_take_linear_time(page):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    html_text.main_text(page)
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 20 and most < 500_000_000
