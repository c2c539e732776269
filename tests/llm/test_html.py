import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import html as H
from palimpsest.llm.html import extract, matching, op9_html, texts_of


def page(n, article=True):
    body = f"<h1>Title {n}</h1><p>First <b>bold</b> para{n}&nbsp;x &amp; y<br>more</p><ul><li>one {n}<li>two</ul><script>var a='<p>no</p>'</script><p>Last&#33;</p>"
    body = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><header>Site</header><div class='ad'>Buy</div><p>Constant strap</p>{body}<div id='comments'>c{n}</div><aside>s</aside><form><p>f</p></form><footer>&copy; f</footer></body></html>"


def content(n):
    return f"Title {n} First bold para{n} x & y more one {n} two Last!"


def test_marked_articles():
    assert texts_of([page(n) for n in range(5)]) == [content(n) for n in range(5)]
    assert texts_of([page(1)]) == [content(1)]


def test_wrapper_decides_inside_articles():
    """What most articles of a host share, and there are many of them, is template there too; what some share is not."""
    pages = [f"<article><p>Title {n}</p><p>Body {n}</p>{'<h2>Some</h2>' if n < 4 else ''}<div><p>Share this</p></div></article>" for n in range(12)]
    assert texts_of(pages) == [f"Title {n} Body {n}" + " Some" * (n < 4) for n in range(12)]
    same = [f"<article><p>Title</p><p>Body</p><p>{n}</p></article>" for n in range(12)]  # near copies of one article
    assert texts_of(same) == [f"Title Body {n}" for n in range(12)]


def test_wrapper_finds_constant_blocks():
    """Without a marked article, what all pages of the host share is template."""
    got = texts_of([page(n, False) for n in range(5)])
    assert got == [f"Title {n} First bold para{n} x & y more one {n}" for n in range(5)]
    assert texts_of([page(7, False)]) == ["Constant strap " + content(7)]


def test_shifted_siblings_of_equal_label():
    """A promo before the menu on some pages: the menu matches the menu, by its text and by its subtrees."""
    menu = "<div><p>Home</p><p>News</p><p>Shop</p></div>"
    pages = [("" if n % 2 else f"<div><p>Promo {n}</p></div>") + menu + f"<div><p>Body {n}</p><p>end {n}</p></div>" for n in range(6)]
    assert texts_of(pages) == [("" if n % 2 else f"Promo {n} ") + f"Body {n} end {n}" for n in range(6)]


def test_copies_are_no_template():
    assert texts_of([page(7, False)] * 5) == ["Constant strap " + content(7)] * 5


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a b"), ("<article><p>a</article>", "a"), ("a &lt; b &#x41; &eacute;", "a < b A é"), ("<p>x<!-- <p>no</p> -->y</p>", "xy"), ("<p>a</p><script>if (a<b) '</p>'</script>b", "a b"),
        ("<article><p>a</p><div class='comment'>no</div><nav>no</nav><p>b</p></article>", "a b"), ("<td>1<td>2<tr><td>3", "1 2 3"), ("<p>a<span hidden>no</span>b</p>", "a b"), ("<b>unclosed", "unclosed"), ("<" * 2000, "<" * 2000),
        ("<div>" * 3000 + "deep", "deep"), ("<p title='a>b'>q</p>", "q"), ("a<br/>b", "a b"), ("<textarea>no</textarea>t", "t"), ("<select><option>no</select>t", "t"),
    ],
)
def test_single_pages(html, text):
    assert texts_of([html]) == [text]


def node(label):
    n = H.Node(label, label, False, False)
    return n


def parent(labels):
    n = node("")
    n.kids = [node(x) for x in labels]
    return n


def test_matching_is_largest():
    def brute(a, b):
        if not a or not b:
            return 0
        return max(brute(a[1:], b), brute(a, b[1:]), (a[0] == b[0]) + brute(a[1:], b[1:]) if a[0] == b[0] else 0)

    for a, b in [("abcabc", "bcab"), ("aab", "baa"), ("", "a"), ("abcd", "dcba"), ("axbxc", "abc")]:
        got = matching(parent(a), parent(b), {})
        assert len(got) == brute(a, b) and got == sorted(got) and all(a[i] == b[j] for i, j in got)


def weight(a, b):
    """By the definition, over all order-preserving matchings."""

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), (weight(x[0], y[0]) + best(x[1:], y[1:])) if x[0].label == y[0].label else 0)

    return 1 + (a.text == b.text) + best(a.kids, b.kids)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_matching_is_heaviest(seed):
    rng = random.Random(seed)

    def tree(depth):
        n = H.Node("x", rng.choice("ab"), False, False)
        n.kids = [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []
        if not n.kids:
            n.label, n.text = "#", rng.choice("xyz")
        return n

    a, b = tree(3), tree(3)
    pairs = matching(a, b, {})
    with pytest.MonkeyPatch.context() as m:
        m.setattr(H, "SMALL", 0)
        assert matching(a, b, {}) == pairs
    assert pairs == sorted(pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert sum(weight(a.kids[i], b.kids[j]) for i, j in pairs) == weight(a, b) - 1 - (a.text == b.text)


def test_wide_pages():
    """600 blocks of template and more, one page with another head and tail."""
    fixed = "".join(f"<p>fixed {k}</p>" for k in range(600))
    pages = [("<p>extra</p>" if n == 2 else "") + fixed + f"<p>body {n}</p>" for n in range(5)]
    assert texts_of(pages) == [("extra " if n == 2 else "") + f"body {n}" for n in range(5)]


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a" * 500_000 + ">", "<a \"" * 250_000 + ">", '<a ">"' * 170_000, "<script>" * 120_000, "<!--" * 250_000, "<" * 500_000, "<script></script " * 60_000, "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 100_000 + "<li></li>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "<p " + "a=1 " * 250_000 + ">", "<span hidden>" * 40_000 + "<div></div>" * 40_000], ids=lambda t: t[:14])
def test_linear(html):
    began = time.perf_counter()
    H.parse(html)
    assert time.perf_counter() - began < 10


def test_table(spark, sf, monkeypatch):
    rows = [(n, f"http://{'hot' if n % 3 else 'h' + str(n)}.example/{n}", page(n), "x") for n in range(300)] + [(1, "http://hot.example/1", page(1), "x"), (400, None, None, "x"), (None, "nonsense", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    said = lambda n: content(n).removesuffix(" two Last!" if n % 3 else "")  # noqa: E731  # on the hot host these blocks are on all articles
    got = extract(pages, ["page_id", "url"]).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in got) == sorted((-1 if i is None else i, "" if not h else said(i)) for i, _, h, _ in rows)
    monkeypatch.setattr(H, "COPIES", 2)  # pages of three copies and more are read once
    copies = rows + [(500 + n, "http://hot.example/2", page(1), "x") for n in range(9)] + [(500, "http://hot.example/2", page(1), "x")] * 3
    got = extract(spark.createDataFrame(copies, pages.schema), ["page_id", "url"]).collect()
    assert sorted((-1 if r.page_id is None else r.page_id, r.text) for r in got) == sorted((-1 if i is None else i, "" if not h else said(i if i < 500 else 1)) for i, _, h, _ in copies)
    assert extract(pages.limit(0), ["page_id"]).collect() == []
    out = op9_html(spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
