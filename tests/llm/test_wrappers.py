import html
import random
import re

import pytest

from sparklogs.llm import wrappers

PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{margin:0}}</style><script>var x = "</p>";</script></head><body class="page with-sidebar">
<header><h1>The Daily</h1><nav><ul><li><a href="/">Home {i}</a></li><li><a href="/b">News</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies {i}</div><!-- <p>not this</p> -->
<{main}><h1>{t}</h1><p>By <a href="/who">author {i}</a>, &copy;&nbsp;2024</p>{body}<div class="ad">Buy {i}!</div><aside>See {i} too</aside><form><label>Mail</label><input><button>Send {i}</button></form></{end}>
<div id="sidebar-{i}"><p>Most read {i}</p></div>
<section class="comments"><p>First! {i}</p><article class="comment"><p>I don't agree with number {i} at all, and here is a much longer text than the article has, to show it.</p></article></section>
<p>All rights reserved</p><footer><p>Contact {i}</p></footer></body></html>"""


def pages(n, main="article"):
    end = main.split()[0]
    out = []
    for i in range(n):
        body = "".join(f"<p>Paragraph {j} of {i}" + ("</p>" if j % 2 else "") for j in range(i % 4)) + f"<ul><li>one {i}<li>two</ul>Tail &lt;{i}&gt;"
        out.append(PAGE.format(t=f"Title {i}", i=i, body=body, main=main, end=end))
    return out


def expected(i):
    return "\n\n".join([f"Title {i}", f"By author {i}, © 2024", *[f"Paragraph {j} of {i}" for j in range(i % 4)], f"one {i}", "two", f"Tail <{i}>"])


@pytest.mark.parametrize("main", ["article", "main", 'div class="story"', "div"])
def test_extraction(spark, main):
    rows = [(i, f"https://User@News.example.org:80/{i}", p) for i, p in enumerate(pages(12, main))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(frame).collect()}
    assert got == {i: expected(i) for i in range(12)}


def test_constant_nodes_are_template():
    """Without an article, what is the same on two pages goes; within one, only after SUPPORT different texts."""
    plain = ["<div><p>Welcome to the site</p></div><div><h2>Story {i}</h2><p>Text {i}</p></div>".replace("{i}", str(i)) for i in range(9)]
    trees = [wrappers.measured(wrappers.shape(wrappers.parse(p))) for p in plain]
    wrapper = trees[0]
    for t in trees[1:]:
        wrappers.merge(wrapper, t)
    assert wrappers.main_text(plain[3]) == "Welcome to the site\n\nStory 3\n\nText 3"
    assert wrappers.main_text(plain[3], wrapper, 9) == "Story 3\n\nText 3"
    assert wrappers.main_text(plain[3], wrapper, 1).startswith("Welcome")
    within = [f"<article><div>Subscribe today</div><h2>Story {i}</h2><p>Text {i}</p></article>" for i in range(9)]
    wrapper = wrappers.load(wrappers.dump(wrappers.measured(wrappers.shape(wrappers.parse(within[0])))))
    for p in within[1:]:
        wrappers.merge(wrapper, wrappers.measured(wrappers.shape(wrappers.parse(p))))
    assert wrappers.main_text(within[3], wrapper, 9) == "Story 3\n\nText 3"
    assert wrappers.main_text(within[3], wrapper, wrappers.SUPPORT - 1).startswith("Subscribe")


def brute_match(a, b):
    """Size of the largest match, by trying all."""
    if a.key != b.key:
        return 0

    def best(xs, ys):
        if not xs or not ys:
            return 0
        return max(best(xs[1:], ys), best(xs, ys[1:]), brute_match(xs[0], ys[0]) + best(xs[1:], ys[1:]))

    return 1 + best(a.children, b.children)


def test_tree_matching_against_brute_force():
    rng = random.Random(4)

    def tree(depth):
        return wrappers.Shape(rng.choice("ab") if depth else "r", [tree(depth + 1) for _ in range(rng.randrange(4))] if depth < 3 else [])

    for _ in range(200):
        a, b = tree(0), tree(0)
        pairs = wrappers.match(a, b)
        assert len(pairs) == brute_match(a, b) and all(x.key == y.key for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})


def test_many_different_children_stay_cheap():
    """Thousands of blocks whose names differ: matched from the left, and the wrapper stays bounded."""
    letters = "abcdefghij"
    name = lambda i: "".join(letters[int(c)] for c in str(i))
    page = lambda k: "<h1>T%d</h1>" % k + "".join(f'<div class="{name(i * k)}x"><p>{i}</p></div>' for i in range(3000))
    trees = [wrappers.measured(wrappers.shape(wrappers.parse(page(k)))) for k in (1, 2, 3)]
    wrapper = trees[0]
    for t in trees[1:]:
        wrappers.merge(wrapper, t)
    assert len(wrapper.children) == wrappers.CHILDREN
    assert wrappers.main_text(page(3), wrapper, 3).count("\n\n") == 2999  # all but the one that is the same on all pages
    assert [n.key for n in wrappers.shape(wrappers.parse("<div id=c-a8f3e>x</div><div id=c-b7>y</div>")).nodes()] == ["body", "div c-0"]
    few = [wrappers.Shape(k) for k in "abcab"], [wrappers.Shape(k) for k in "bcaab"]
    assert [x.key for x, _ in wrappers._greedy(*few)] == ["a", "b"]


def test_articles_side_by_side():
    page = "<main><article><h2>A</h2><p>one</p></article><article><p>two, which is longer</p></article><article class='teaser'>no</article></main>"
    assert wrappers.main_text(page) == "A\n\none\n\ntwo, which is longer"


def test_markup_as_browsers_read_it():
    text = wrappers.main_text
    assert text("<article>a &lt; b<br>c<b>d</b><p>e<ul><li>f<li>g</ul>h</article> out") == "a < b cd\n\ne\n\nf\n\ng\n\nh"
    assert text("<article><table><tr><td>1<td>2<tr><td>3</table><dl><dt>k<dd>v</dl></article>") == "1\n\n2\n\n3\n\nk\n\nv"
    assert text("<article><p>x<script>if (a < b) '</p>'</script>y<!-- <p>z --> w</p><style>q</style>") == "xy w"
    assert text('<article><p title="a>b">x</p><p class="ad">no</p><span class="ads">no</span>y</article>') == "x\n\ny"
    assert text("<article><h1>A</h1><p>cut &amp") == "A\n\ncut &" and text("<article><p>cut <b") == "cut" and text("<p>a<!-- open") == "a"
    assert text("") == text("<html></html>") == text("<article></article>") == "" and text("no markup at all") == "no markup at all"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep" and text("<b>" * 3000 + "deep") == "deep"
    assert text("<article>é\n\t  x\r\n</article>") == "é x"
    assert text("<form><article><p>all in a form</p></article></form>") == "all in a form"
    assert text("<article><header><h1>T</h1></header><p>x</p><footer>f</footer></article>") == "T\n\nx"
    long = "<article>" + "".join(f"<p>word{i} <b>and</b> more</p>" for i in range(60_000)) + "</article>"
    assert text(long).count("\n\n") == 59_999


def test_shapes_and_names():
    tree = wrappers.shape(wrappers.parse('<div id="post-12" class="a  b"><h2>x</h2><p>1<h2>y</h2><p>2</div><div><p>3</div><div><p>4</div>'))
    assert [n.key for n in tree.nodes()] == ["body", "div a b post-0", "h2", "p", "div", "p"]
    assert [n.key for n in wrappers.unnamed(tree.name).nodes()] == [n.key for n in tree.nodes()]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, text string, wrapper string, node int"
    rows = [(1, None, "<article><p>a</p></article>"), (1, None, "<article><p>a</p></article>"), (None, "not a url", None), (2, "http://h/1", None), (3, "http://h/2", "<p>x</p>"), (4, "", "")]
    frame = spark.createDataFrame([(*r, "h", "t", "w", 1) for r in rows], schema)
    out = wrappers.extract(frame)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out.collect()) == [("1", "a", 1), ("1", "a", 1), ("2", "", 0), ("3", "x", 1), ("4", "", 0), ("None", "", 0)]
    assert wrappers.extract(frame.limit(0)).count() == 0


def test_order_of_pages_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "SHAPES", 3)
    monkeypatch.setattr(wrappers, "HELD", 4)
    rows = []
    for i, p in enumerate(pages(20)):
        rows.append((i, f"http://h{i % 2}.example.org/{i}", p + "".join(f"<div><p class='x{'yz'[k % 2] * k}'>{i}</p></div>" for k in range(i % 7))))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = sorted(map(tuple, wrappers.wrappers(wrappers.hosts(frame.repartition(5))).collect()))
    b = sorted(map(tuple, wrappers.wrappers(wrappers.hosts(frame.coalesce(1).orderBy("html"))).collect()))
    assert [x[:2] for x in a] == [x[:2] for x in b] and len(a) == 2
    assert {r.page_id: r.text for r in wrappers.extract(frame).collect()} == {i: expected(i) for i in range(20)}


def test_given_pages(sf):
    """Every page of the table: the blocks of its one article, cut out by a pattern."""

    def brute(page):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"(?s)<article>(.*?)</article>", page)[1])
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
        return "\n\n".join(p for p in parts if p)

    pages = {r.page_id: r.html for r in sf("pages").collect()}
    assert {r.page_id: r.text for r in wrappers.extract(sf("pages")).collect()} == {i: brute(p) for i, p in pages.items()}


def plain_pairs(xs, ys, sizes):
    """Places of the pairs of children by the whole table of best sums."""
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in range(len(xs) - 1, -1, -1):
        for j in range(len(ys) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], sizes[i][j] + best[i + 1][j + 1] if sizes[i][j] else 0)
    i, j, out = 0, 0, []
    while i < len(xs) and j < len(ys):
        if sizes[i][j] and best[i][j] == sizes[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


@pytest.mark.parametrize("rows", [2, 32])
@pytest.mark.parametrize("n, keys", [(3, "ab"), (12, "a"), (40, "abc"), (600, "abcd")])
def test_match_is_the_largest_at_any_width(monkeypatch, rows, n, keys):
    """The same pairs as from the whole table of best sums, ties included, below and above the 262,144 pairs of a former switch."""
    monkeypatch.setattr(wrappers, "ROWS", rows)
    monkeypatch.setattr(wrappers, "SUMS", rows)
    rng = random.Random(n)
    for _ in range(1 if n > 100 else 30):
        tree = lambda: wrappers.Shape("r", [wrappers.Shape(rng.choice(keys), [wrappers.Shape(k) for k in "uvw"[: rng.randrange(4)]]) for _ in range(n)])
        a, b = tree(), tree()
        if rng.random() < 0.5:
            b.children[: n // 4] = [wrappers.load(wrappers.dump(c)) for c in a.children[: n // 4]]
        sizes = [[(x.key == y.key) * (1 + min(len(x.children), len(y.children))) for y in b.children] for x in a.children]
        numbers = {id(c): i for t in (a, b) for i, c in enumerate(t.children)}
        assert sorted((numbers[id(x)], numbers[id(y)]) for x, y in wrappers.match(a, b) if id(x) in numbers) == plain_pairs(a.children, b.children, sizes)


@pytest.mark.parametrize("n", [100, 600])
def test_width_of_pages_does_not_matter(spark, n):
    """A block that stands first on one page and last on the other: the others are template at any number of them."""
    letters = "abcdefghij"
    same = "".join(f'<div class="x{"".join(letters[int(c)] for c in str(i))}">Part {i}</div>' for i in range(n))
    rows = [(1, "http://h/1", f'<div class="a">Story 1</div>{same}'), (2, "http://h/2", f'{same}<div class="a">Story 2</div>')]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {1: "Story 1", 2: "Story 2"}


def test_wrappers_take_in_every_block(spark):
    """Template behind thousands of other blocks of the host is template."""
    letters = "abcdefghij"
    wide = "".join(f'<div class="aa{"".join(letters[int(c)] for c in str(i))}">{i}</div>' for i in range(wrappers.CHILDREN + 100))
    few = [f'<div class="y">Story {i}</div><div class="z">The same on each</div>' for i in range(3)]
    rows = [(i, f"http://h/{i}", p) for i, p in enumerate([*few, few[0] + "<p>more</p>", wide])]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == ["Story 0", "Story 1", "Story 2", "Story 0\n\nmore"]
    assert got[4].count("\n\n") == wrappers.CHILDREN + 99


def test_wide_and_deep_pages_are_matched():
    row = "".join(f"<div class={c}>x</div>" for c in "abcdefghijklm")
    a, b = ("".join(x + "<div class=q>" for _ in range(wrappers.DEPTH)) for x in (row, row[20:] + "<div class=a>x</div>"))
    a, b = wrappers.shape(wrappers.parse(a)), wrappers.shape(wrappers.parse(b))
    assert len(wrappers.match(a, b)) > 12 * (wrappers.DEPTH - 5)
