"""Main text: what stays, what goes, and the wrapper's part in it."""

import random
import time

import pytest

from tessera.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div>Read us daily</div>
<div class="post"><h1>T{0}</h1><p>First &amp; <b>bold</b>
 {0}.<p>Second&nbsp;line {0}<br>goes on {1}</p><div class="ad">Buy {0}</div><p>Third {1} paragraph</p></div>
<div id="comments"><p>Reader {0} says {1}</p></div><form><p>Mail</p><input></form><footer>&copy; {1}</footer></body></html>"""


def expected(k, w):
    return f"T{k}\nFirst & bold {k}.\nSecond line {k} goes on {w}\nThird {w} paragraph"


def pages(spark, n=12, host="h.example"):
    rows = [(k, f"https://{host}/{k}", PAGE.format(k, "abcdefghijkl"[k % 12] * 30)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_wrapper_drops_constant_text(spark):
    rows, df = pages(spark)
    got = {r.page_id: r for r in html.main_text(df).collect()}
    for k, url, _ in rows:
        assert got[k].text == expected(k, "abcdefghijkl"[k % 12] * 30)
        assert got[k].n_chars == len(got[k].text) and got[k].url == url


def test_odd_rows(spark):
    rows = [(1, None, "<p>alone</p>"), (2, "not a url", None), (3, "https://x.example/", ""), (3, "https://x.example/", ""), (4, "https://y.example/", "plain &lt; text < 3"), (None, "https://y.example/", "<p>a<p>b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((str(r.page_id), r.text) for r in html.main_text(df).collect())
    assert got == [("1", "alone"), ("2", ""), ("3", ""), ("3", ""), ("4", "plain < text < 3"), ("None", "a\nb")]
    assert html.main_text(df.where("false")).count() == 0


def test_copies_keep_their_text(spark):
    same = PAGE.format(7, "z" * 30)
    df = spark.createDataFrame([(k, "https://c.example/a", same) for k in range(9)], "page_id long, url string, html string")
    for r in html.main_text(df).collect():
        assert "Third" in r.text and "Reader" not in r.text and "cookies" not in r.text


def test_article_wins():
    page = "<body><div class=sidebar><p>side</p></div><main><article><header><h1>H</h1></header><p>text<ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table></article><aside>x</aside></main><p>tail</p>"
    assert html.extract(page) == "H\ntext\none\ntwo\na b"


def test_headline_and_lead_beside_the_body_stay(spark):
    page = "<body><div class=menu><p>m{0}</p></div><p>Always here</p><div><h1><a href=x>Title {0}</a></h1><p>lead {0}</p><div class=body>{1}<p>end {0}</p></div></div></body>"
    rows = [(k, f"https://d.example/{k}", page.format(k, f"long text {k} " * 200)) for k in range(12)]
    df = spark.createDataFrame([*rows, (99, None, page.format(99, "long text 99 " * 200))], "page_id long, url string, html string")
    for r in html.main_text(df).collect():
        lines = r.text.split("\n")
        assert lines[-4:] == [f"Title {r.page_id}", f"lead {r.page_id}", ("long text %d " % r.page_id * 200).strip(), f"end {r.page_id}"]
        assert lines[:-4] == (["Always here"] if r.page_id == 99 else [])  # only a wrapper tells template


def test_all_outermost_articles_stay(spark):
    page = "<body><article><p>short {0}</p></article><article><p>{1}</p></article></body>"
    df = spark.createDataFrame([(k, f"https://a.example/{k}", page.format(k, f"long {k} " * 99)) for k in range(12)], "page_id long, url string, html string")
    for r in html.main_text(df).collect():
        assert r.text.split("\n") == [f"short {r.page_id}", (f"long {r.page_id} " * 99).strip()]


MEANINGLESS = """<html><body><div class=q1><div class=q2><a href=/>Home of {0}</a> <a href=/b>Topics {1}</a></div></div><p class=q3>Subscribe to our letter today and get the news</p>
<div class=q4><div class=q5><h1>Headline {0}</h1><p>Lead {0} {1}.</p><div class=q6><p>{2}</p><p>{3}</p></div></div><div class=q7>Short {1}</div></div>
<div class=q8>{4}</div><div class=q9>All rights reserved by example</div></body></html>"""


def test_statistics_decide_where_names_mean_nothing(spark):
    """Menus are linked, boilerplate is constant, comments are records, a short block beside the text is none: no tag or class says so."""
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for k in range(40):
        comments = "".join(f"<div class=q10><div class=q11>user{rng.randrange(99)}</div><div class=q12>{words(9)}</div></div>" for _ in range(rng.randint(2, 9)))
        name, word, a, b = f"n{k}", words(1), words(60), words(80)
        rows.append((k, f"https://m.example/{k}", MEANINGLESS.format(name, word, a, b, comments)))
        want[k] = f"Headline {name}\nLead {name} {word}.\n{a}\n{b}"
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    alone = {k: html.extract(page) for k, _, page in rows}
    assert sum(alone[k] == want[k] for k in want) == 0  # the wrapper makes the difference


def test_a_notice_on_some_pages_goes_and_copies_stay(spark):
    page = "<body>{1}<div class=t><h1>T {0}</h1><p>text {0} goes on for a while and says {0}</p></div></body>"
    notice = "<div class=z><p>This site moves next week, tell your friends</p></div>"
    rows = [(k, f"https://n.example/{k}", page.format(k, notice if k % 5 == 0 else "")) for k in range(60)]
    rows += [(100 + k, f"https://n.example/c{k}", page.format(7, "")) for k in range(30)]
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id if r.page_id < 100 else 7
        assert r.text == f"T {k}\ntext {k} goes on for a while and says {k}"


def test_small_hosts_have_template_too(spark):
    rows = [(k, f"https://s.example/{k}", f"<body><div class=x>Welcome to this place</div><div><h1>A {k}</h1><p>{'word %d ' % k * 30}</p></div></body>") for k in range(2)]
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == f"A {r.page_id}\n{('word %d ' % r.page_id * 30).strip()}"


def test_foreign_and_unclosed_elements():
    assert html.extract('<p>one</p><svg width="1"/><p>two</p>') == "one\ntwo"
    assert html.extract("<p>one</p><svg><svg><text>x</text></svg><text>y</text></svg><p>two</p>") == "one\ntwo"
    assert html.extract("<p>one<object><p>two</p>") == "one\ntwo"
    assert html.extract("<p>one</p><script>if (a < b) { '<p>no</p>' }</script><p>two</p>") == "one\ntwo"
    assert html.extract("<main><div class=legal><p>law</p></div><p>text</p></main>") == "law\ntext"
    deep = "<div>" * 400 + "<p>in</p><div class=ad><div>buy</div></div><p>out</p>" + "</div>" * 400
    assert html.extract(deep).split() == ["in", "out"]


def test_broken_markup_is_linear():
    for piece in ("<a <a ", "<div ", "<p class=\"x", "<!-- ", "<script>", "</p>", "&amp", "<", "<div>", "<ul><li>", "<svg>", "<svg/>", "<object>"):
        html.extract(piece * 20000 if piece != "<div " else piece * 500)


def parsed(page):
    t = html.tree([html.parse(page)])
    html.numbered(t)
    return t


def test_long_pages_align_fast():
    began = time.time()
    a = parsed("<body>" + "".join(f"<h2>t{i}</h2><p>x{i}</p>" for i in range(3000)))
    b = parsed("<body>" + "".join(f"<p>x{i}</p><h2>t{i}</h2>" for i in range(3000)))
    assert html.simple_tree_match(a, b)
    a, b = (parsed("<body>" + "".join(f"<div class=c{i * k % 3001}><p>x</p></div>" for i in range(3000))) for k in (1, 7))
    pairs = html.simple_tree_match(a, b)
    places = [(p.id, q.id) for p, q in pairs if p.tag == "div"]
    assert len(places) >= 100 and sorted(places) == places and [q for _, q in places] == sorted(q for _, q in places)
    assert time.time() - began < 20


def test_simple_tree_matching_is_optimal():
    """Against every way to pair children in order."""

    def best(a, b):
        if a.label != b.label:
            return 0

        def rest(x, y):
            if not x or not y:
                return 0
            return max(rest(x[1:], y), rest(x, y[1:]), best(x[0], y[0]) + rest(x[1:], y[1:]) if x[0].label == y[0].label else 0)

        return 1 + rest(a.kids, b.kids)

    rng = random.Random(5)

    def page(depth=0):
        return "".join(f"<{t}>{page(depth + 1) if depth < 3 and rng.random() < 0.6 else 'x'}</{t}>" for t in (rng.choice(("div", "section", "ul", "h2")) for _ in range(rng.randint(0, 4))))

    for _ in range(300):
        a, b = parsed(page()), parsed(page())
        pairs = html.simple_tree_match(a, b)
        assert len(pairs) == best(a, b) and len({p.id for p, _ in pairs}) == len({q.id for _, q in pairs}) == len(pairs)
        assert all(p.label == q.label for p, q in pairs)


ARTICLES = ["A sentence of the article that every copy has. " * 6, "Another paragraph which they share as well. " * 5, "And the end of it. " * 9]
FRAME = "<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy {0} now</div>{1}<footer>imprint</footer></body></html>"


@pytest.mark.parametrize("n", [2, 4, 5, 9, 30])
@pytest.mark.parametrize("open_", ["<article>", "<div class=x7>"])
def test_near_copies_keep_their_article_whatever_their_number(spark, n, open_):
    close = "</article>" if open_ == "<article>" else "</div>"
    body = "".join(f"<p>{t}</p>" for t in ARTICLES)
    rows = [(k, f"https://near.example/{k}", FRAME.format(k, f"{open_}<h1>One title</h1>{body}<p>Printed at {k} o clock.</p>{close}")) for k in range(n)]
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.split("\n") == ["One title", *(t.strip() for t in ARTICLES), f"Printed at {r.page_id} o clock."]


def test_a_shared_notice_in_different_articles_goes(spark):
    """What pages share inside their content is template where most of the rest differs."""
    notice = "Sign up today for our letter and read more of this."
    rows = [(k, f"https://notice.example/{k}", FRAME.format(k, f"<article><h1>Title {k}</h1><p>{f'Words of page {k} only. ' * 12}</p><p>{notice}</p></article>")) for k in range(12)]
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.split("\n") == [f"Title {r.page_id}", (f"Words of page {r.page_id} only. " * 12).strip()]


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<section id=discussion><h2>Discussion</h2><p>We find this.</p></section>", "Discussion\nWe find this."), ('<section class="notice"><p>Note the date.</p></section>', "Note the date."), ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p>", "Energy is E=m here."),
        ('<div class="comments"><p>nice</p></div>', ""), ('<div class="related"><a href=/a>One more</a> <a href=/b>Two more</a></div>', ""), ('<p>x <math><semantics><mi>y</mi><annotation encoding="tex">\\y</annotation></semantics></math></p>', "x y"),
    ],
)
def test_words_inside_an_article(inside, text):
    page = f"<body><article><h1>T</h1><p>{'Some text. ' * 20}</p>{inside}</article></body>"
    assert html.extract(page) == "\n".join(filter(None, ["T", ("Some text. " * 20).strip(), text]))


def test_alignment_of_many_siblings_is_optimal():
    """Siblings of very many labels: as many nodes as the whole table of a plain program gives."""
    rng = random.Random(8)
    for n in (5, 40, 120):
        x, y = ([html.Tree(f"l{rng.randrange(n // 2 + 1)}", "div", False, 0, [], [html.Tree("p", "p", False, 0, [], [])] * rng.randrange(3)) for _ in range(n)] for _ in range(2))
        a, b = (html.Tree("body", "body", False, 0, [], k) for k in (x, y))
        best = [[0] * (n + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(n):
                met = 1 + min(len(x[i].kids), len(y[j].kids)) if x[i].label == y[j].label else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + met)
        assert len(html.simple_tree_match(a, b)) == 1 + best[n][n]


@pytest.mark.parametrize("nodes", [html.NODES, 20])
def test_every_layout_of_a_host_is_in_a_wrapper(spark, monkeypatch, nodes):
    """Forty layouts of three pages, each with a note of its own below the text, in one wrapper or in several."""
    monkeypatch.setattr(html, "NODES", nodes)
    text = lambda k, i: [f"Words of page {k} {i} about things {j} " * 8 for j in range(2)]
    page = lambda k, i: f'<body><h1>T{k}.{i}</h1><div class="c"><p>{text(k, i)[0]}</p><p>{text(k, i)[1]}</p></div><div class="x{k}"><p>{"The same words again. " * 12}{k}</p></div></body>'
    rows = [(10 * k + i, f"http://h.org/{k}/{i}", page(k, i)) for k in range(40) for i in range(3)] + [(999, "http://other.org", page(0, 9))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in range(40):
        for i in range(3):
            assert got[10 * k + i] == "\n".join([f"T{k}.{i}", *(t.strip() for t in text(k, i))])
