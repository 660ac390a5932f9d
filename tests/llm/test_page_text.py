"""Main text of hosts of generated pages: what stays and what goes, whatever the number of pages."""

import time

import pytest

from framelark.llm import page_tree

PARA = "<p>Paragraph {0} of the text, long enough to be one, number {0}.</p>"


def texts(pages):
    trees, w = [page_tree.parse(p) for p in pages], None
    for t in trees:
        one = page_tree.wrapper_of(t, page_tree.print_of(t))
        w = one if w is None else page_tree.merge(w, one)
    verdicts = page_tree.judge(w)
    return [page_tree.extract(t, verdicts) for t in trees]


def article(inside, n):
    return [f"<html><body><nav><ul><li><a>home</a></ul></nav><article><h1>Title {i}</h1>{PARA.format(i)}{inside.format(i)}{PARA.format(i + 1000)}</article><footer>f</footer></body></html>" for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_text_of_an_article_stays(n):
    kept = {
        "<h2>Summary</h2>": ["Summary"],
        "<p>All pages say this.</p>": ["All pages say this."],
        "<h2>References</h2><ul><li><a href=x>One {0}</a><li><a href=y>Two</a><li><a href=z>Three</a></ul>": ["References", "One {0}", "Two", "Three"],
        '<section class="legal-notice-board"><p>Board {0}</p></section>': ["Board {0}"],
        '<div class="banner-story"><p>Story {0}</p></div>': ["Story {0}"],
        "<p>So <math><mrow><mi>x</mi><mo>=</mo><mn>{0}</mn></mrow><annotation>tex</annotation></math> holds.</p>": ["So x={0} holds."],
    }
    for inside, want in kept.items():
        for i, got in enumerate(texts(article(inside, n))):
            assert got == [f"Title {i}", f"Paragraph {i} of the text, long enough to be one, number {i}.", *(x.format(i) for x in want), f"Paragraph {i + 1000} of the text, long enough to be one, number {i + 1000}."], inside


@pytest.mark.parametrize("n", [2, 3, 7])
def test_a_notice_of_its_own_stays_and_a_shared_one_goes(n):
    for i, got in enumerate(texts(article('<section class="notice"><p>A notice about court case {0}</p></section>', n))):
        assert got[2] == f"A notice about court case {i}"
    for got in texts(article('<div class="notice"><p>We use cookies.</p></div>', n)):
        assert len(got) == 3 and "We use cookies." not in got


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_other_kinds_in_an_article_go(n):
    for inside in (
        '<div class="comment-list"><div class="comment-item"><p>me {0}</p></div><div class="comment-item"><p>too</p></div></div>',
        '<div class="ad-slot promo"><p>Buy {0}</p></div>',
        '<div class="sponsored"><p>Deal {0}</p></div>',
        '<div class="side-bar"><p>More {0}</p></div>',
        '<div id="page-footer"><p>Contact {0}</p></div>',
        '<div class="comments"><p>first {0}</p></div>',
        "<aside>Beside {0}</aside>",
        "<form><p>Search {0}</p></form>",
    ):
        for got in texts(article(inside, n)):
            assert len(got) == 3, (inside, got)


def test_deep_pages_take_time_in_proportion():
    def took(depth, tag):
        page = f"<{tag}>a" * depth
        began = time.perf_counter()
        tree = page_tree.parse(page)
        assert sum(len(x[1]) for x in page_tree.walk(tree)) == (depth if tag == "div" else 1)
        return time.perf_counter() - began

    for tag in ("div", "b"):
        took(1000, tag)
        assert took(40_000, tag) < 12 * took(10_000, tag) + 0.2
    assert page_tree.parse("<div>" * 5000 + "x" + "</p></span></div>" * 5000)[2]


def test_parsing_of_open_tags():
    t = page_tree.parse("<p>a <b>b <p>c</b> d</p><ul><li>x<li><i>y</ul><table><tr><td>1<td>2<tr><td>3</table><a>l <div>m</div></a> n")
    flat = [(x[0], [s for _, s, _ in x[1]]) for x in page_tree.walk(t) if x[1]]
    assert flat == [("#", ["l", "n"]), ("p", ["a b"]), ("p", ["c d"]), ("li", ["x"]), ("li", ["y"]), ("td", ["1"]), ("td", ["2"]), ("td", ["3"]), ("div", ["m"])]
