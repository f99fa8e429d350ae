"""Main text by wrappers: alignment against brute force, renamed hosts, and edge cases."""

import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import html

SCHEMA = "page_id long, url string, html string"


def host(*pages):
    wrapper = None
    for page in dict.fromkeys(pages):
        wrapper = html.joined(wrapper, html.unpacked(html.packed(html.described(page))))
    return html.Wrapper(html.unpacked(html.packed(wrapper)))


def of(label, *kids):
    g = html.Group(label)
    g.kids = list(kids)
    return g


# -- alignment


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(max_examples=300, deadline=None)
def test_matching_is_a_longest_common_subsequence(a, b):
    found = html.matching([of(x) for x in a], [of(x) for x in b])
    assert all(a[i] == b[j] for i, j in found) and found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
    inside = lambda s, t: all(c in it for it in [iter(t)] for c in s)
    assert len(found) == max(n for n in range(len(a) + 1) for s in combinations(a, n) if inside(s, b))


def test_long_lists_are_matched_too():
    rnd = random.Random(1)
    a, b = ("".join(rnd.choice("abcde") for _ in range(600)) for _ in range(2))
    found = html.matching([of(x) for x in a], [of(x) for x in b])
    assert all(a[i] == b[j] for i, j in found) and found == sorted(found)


_PAGE = st.recursive(st.just("#"), lambda kids: st.tuples(st.sampled_from(["div", "div.x", "p", "ul", "h1"]), st.lists(kids, max_size=4)), max_leaves=12)


def stream(node):
    return "#" if node == "#" else f"<{node[0]}>{''.join(map(stream, node[1]))}</{node[0]}>"


def tree(node):
    g = of(node if node == "#" else node[0])
    for kid in [] if node == "#" else node[1]:
        g.kids.append(tree(kid))
        for x, y in html.square(g.kids):
            html.merge(x, y, True)
    return g


@given(st.lists(st.lists(_PAGE, max_size=5), min_size=1, max_size=5))
@settings(max_examples=250, deadline=None)
def test_wrappers_accept_all_their_pages(pages):
    """As regular expressions, matched by Python's own."""
    wrapper = None
    for kids in pages:
        wrapper = html.joined(wrapper, html.unpacked(html.packed(tree(("", kids)))))
    pattern = html.expression(html.unpacked(html.packed(wrapper)))
    for kids in pages:
        assert re.fullmatch(pattern.replace(".", r"\."), "".join(map(stream, kids))), pattern


def test_expressions():
    page = lambda *kids: html.described("<b-x>" + "".join(kids))
    both = html.joined(page("<h1>a</h1><p>b<p>c<ul><li>d<li>e</ul>"), page("<h1>a</h1><p>b</p><div>c</div>"))
    assert html.expression(both) == "(<b-x>(<h1>(#)</h1>)(<p>(#)</p>)+(<ul>(<li>(#)</li>)+</ul>)?(<div>(#)</div>)?</b-x>)"
    assert html.expression(page("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p><p>g</p>")) == "(<b-x>((<h2>(#)</h2>)(<p>(#)</p>)+)+</b-x>)"


# -- what wrappers decide

PROSE = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna".split()


def article(rnd, n=4):
    return [" ".join(rnd.choices(PROSE, k=rnd.randrange(12, 40))) for _ in range(n)]


def site(rnd, names, said):
    """A page whose elements are all called as ``names`` says."""
    n = lambda k: names[k]
    return (
        f"<html><head><title>x</title></head><body><{n(0)}><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></{n(0)}>"
        f"<{n(1)}>{' '.join(rnd.choices(PROSE, k=8))}</{n(1)}><{n(2)}><h1>{said[0]}</h1>{''.join(f'<p>{t}</p>' for t in said[1:])}</{n(2)}><{n(3)}>All rights reserved {rnd.random()}</{n(3)}></body></html>"
    )


@pytest.mark.parametrize("names", [("nav", "div class=ad", "article", "footer"), ("div class=aa", "div class=bb", "div class=cc", "div class=dd"), ("div", "div", "div", "div"), ("section", "x-y", "section", "section")])
def test_no_name_is_needed(names):
    rnd = random.Random(2)
    said = [article(rnd, 1 + rnd.randrange(2, 6)) for _ in range(6)]
    opens = [n for n in names]
    pages = [re.sub(r"</(\w[\w-]*) class=\w+>", r"</\1>", site(rnd, opens, s)) for s in said]
    w = host(*pages)
    assert [w.text(p) for p in pages] == ["\n".join(s) for s in said]


def test_constant_slots_and_menus_go_everywhere():
    rnd = random.Random(3)
    said = [article(rnd) for _ in range(5)]
    page = lambda s: f"<body><div><a href=/>Home</a> <a href=/b>Story</a></div><h1>{s[0]}</h1>{''.join(f'<p>{t}' for t in s[1:])}<div>Share this page with your friends</div>"
    w = host(*map(page, said))
    assert [w.text(page(s)) for s in said] == ["\n".join(s) for s in said]


@pytest.mark.parametrize("name", ["related-work", "menu-review", "share-price", "story-social", "comment-on-law", "ad-hoc", "x"])
def test_names_alone_delete_nothing(name):
    assert host(page := f"<article><h1>T</h1><p>One two three.</p><div class={name}><p>Some text.</p></div></article>").text(page) == "T\nOne two three.\nSome text."


def test_small_groups_of_hinting_names_go():
    text = "<p>" + " ".join(PROSE) + "</p>"
    for inner in ("<div class=ad>Buy</div>", "<div class='related-posts'><a href=x>Else</a></div>", "<section id=comments>" + "<div class=c><b>Me</b><p>Great, really great!</p></div>" * 40 + "</section>", "<aside>Side</aside>", "<form>Mail?</form>", "<div hidden>x</div>", "<div role=navigation>x</div>"):
        page = f"<article><h1>T</h1>{text}{inner}</article><div class=ad>{text}</div>"
        assert host(page).text(page) == "T\n" + " ".join(PROSE), inner
    page = f"<article><h1>T</h1><div class=comment>{text}</div></article>"
    assert host(page).text(page) == "T\n" + " ".join(PROSE)


def test_two_layouts_of_one_host():
    rnd = random.Random(4)
    many = [site(rnd, ("nav", "div class=bb", "div class=cc", "footer"), s).replace("</div class=bb>", "</div>").replace("</div class=cc>", "</div>") for s in (article(rnd) for _ in range(5))]
    own = article(rnd)
    other = f"<body><nav>x</nav><table><tr><td><h1>{own[0]}</h1>{''.join(f'<p>{t}</p>' for t in own[1:])}</td></tr></table></body>"
    assert host(*many, other).text(other) == "\n".join(own)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
    <header>Site</header><nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><div class="side-bar ad">Buy</div><div class="cookie-notice">Accept</div>
    <article class="post"><h1>Title &amp; more</h1><p><b>First&nbsp; one<br>and <p>Second <i>in</i>line a &lt; b &#233;<form>Mail?</form><p>foo <img src=x> bar <wbr>x<ul><li>x<li>y</ul>
    <div class="related-posts">Else</div><table><tr><td>1<td>2</table><section id="comments"><p>Great!</p></section></article><footer>Foot</footer>"""
    assert host(page).text(page) == "Title & more\nFirst one and\nSecond inline a < b é\nfoo bar x\nx\ny\n1\n2"


def test_deep_long_and_wide_pages(spark):
    deep = "<div><section>" * 10_000 + "<p>Down here.</p>" + "</section></div>" * 10_000
    long = "<article>" + "".join(f"<p>Paragraph {i} of many words that go on.</p>" for i in range(30_000)) + "</article>"
    wide = "<article>" + "".join(f"<{t} class=c{i % 7}>t{i}</{t}>" for i, t in enumerate(random.Random(5).choices(["p", "div", "ul", "h2"], k=4_000))) + "</article>"
    rows = [(i, f"http://h{i % 2}.example/{i}", p) for i, p in enumerate([deep, long, wide, deep, "<p>x"])]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == got[3] == "Down here." and got[1].count("\n") == 29_999 and got[2].split("\n") == [f"t{i}" for i in range(4_000)] and got[4] == "x"


def test_wide_wrappers_lose_their_classes(monkeypatch):
    monkeypatch.setattr(html, "WIDEST", 12)
    rnd = random.Random(6)
    said = [article(rnd) for _ in range(8)]
    name = lambda: "".join(rnd.choices("abcdef", k=9))
    pages = [f"<body><nav>x</nav><div class={name()}><h1>{s[0]}</h1>" + "".join(f"<p class={name()}>{t}</p>" for t in s[1:]) + f"</div><footer class={name()}>f</footer>" for s in said]
    w = host(*pages)
    assert w.root.label == "bare" and len(html.groups(w.root)) < 40
    assert [w.text(p) for p in pages] == ["\n".join(s) for s in said]


def test_copies_of_a_page_are_no_template(spark):
    page = lambda *said: "<body>" + "".join(f"<div class=d{'abc'[k]}><p>{t}</p></div>" for k, t in enumerate(said) if t)
    rnd = random.Random(7)
    long = [article(rnd, 1)[0] for _ in range(3)]
    near = " ".join(PROSE * 8)
    copies = [("a.x", page("On the top", "An article."))] * 4
    mixed = [("b.x", page("Top", t)) for t in long] + [("b.x", page("Quoted page.", "", "A quote."))] * 4
    bare = [("b.x", page("Top"))]
    alike = [("c.x", page(near, f"Edited {i}.")) for i in range(4)]  # near copies, which count once
    rows = [(i, f"http://{host}/{i}", html_) for i, (host, html_) in enumerate(copies + mixed + bare + alike)]
    got = [r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]
    assert got[:4] == ["On the top\nAn article."] * 4
    assert got[4:7] == long
    assert all("A quote." in t for t in got[7:11])
    assert got[11] == "Top"
    assert all(near in t for t in got[12:])


def test_extract_edge_cases(spark):
    rows = [(1, "https://u@A.example:80/x", "<p>One<p>Two"), (2, None, None), (3, "not a url", ""), (4, "http://a.example/y", "<p>One<p>Other"), (4, "http://a.example/y", "<div>plain <b>x"), (5, "http://t.example", "<a href='"), (6, "http://t.example/1", "a < b & c &copy x"), (None, "http://z", "<article><p>in</article>out")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"host": F.lit("clash"), "at": F.lit(1), "salt": F.lit(1), "wrapper": F.lit(2)})
    out = {(r.page_id, r.text): r for r in html.extract(df).collect()}
    assert {k[1] for k in out} == {"One\nTwo", "", "One\nOther", "plain x", "a < b & c © x", "in"}
    assert all(r.n_chars == len(r.text) for r in out.values()) and html.extract(df.limit(0)).count() == 0


def test_wrappers_of_many_tasks(spark, monkeypatch):
    """However pages are dealt to tasks, and with a salted join instead of a broadcast, the texts are the same."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {tuple(r) for r in html.extract(pages).collect()}
    monkeypatch.setattr(html, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(html, "HELD", 2)
    assert {tuple(r) for r in html.extract(pages.repartition(23)).collect()} == want and len(want) > 40
