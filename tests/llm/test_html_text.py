import time
from collections import Counter

import pytest

from corpusloom.llm import html_text
from corpusloom.llm.html_text import DEFAULT, Weights, main_text, parse


@pytest.mark.parametrize("weights", [DEFAULT, Weights({"word": 0.6, "link word": -1.0, "other tag": -2.0})])
@pytest.mark.parametrize("block", ["<div class='newsletter'><form><p>{}</p></form></div>", "<aside><ul><li>{}</li></ul></aside>"])
def test_a_long_skipped_block_does_not_cut_an_article(weights, block):
    intro, body = " ".join(f"i{n}" for n in range(40)), " ".join(f"b{n}" for n in range(200))
    source = f"<body><nav><a>home</a></nav><div><p>{intro}</p>{block.format('advert ' * 60)}<p>{body}</p></div><footer>end</footer></body>"
    page = parse(source)
    assert page.marked == 0
    assert main_text(page, weights) == f"{intro} {body}"


@pytest.mark.parametrize("bad", ["<a ", '<a ="', "<!", '<a =">" ', "<p a='", "<div>", "<!--", '<a b=">', "</p>", "<script>", "&amp"])
def test_hostile_pages_take_linear_time(bad):
    page = bad * (1_000_000 // len(bad))
    start = time.process_time()
    html_text.main_text(html_text.parse(page), html_text.DEFAULT)
    assert time.process_time() - start < 10


def test_ends_of_tags():
    parts = lambda h: [(k, t) for k, t in zip(html_text.parse(h).kinds, html_text.parse(h).texts)]
    assert parts('<p title="a > b">x</p>') == [("p", None), ("word", "x"), ("/p", None)]
    assert parts("<p title=it's>x</p>") == [("p", None), ("word", "x"), ("/p", None)]
    assert parts("a < b <i>c</i>") == [("word", "a < b "), ("i", None), ("word", "c"), ("/i", None)]
    # an unquoted address that ends with a slash doesn't close its element, a slash of the tag's own does
    assert parts("<a href=/b/>x</a>")[1] == ("link word", "x")
    assert parts("<a href='/b'/>x")[1] == ("word", "x")


def test_scan_decides_without_the_mark():
    body = " ".join(f"sentence {i} of the story" for i in range(60))
    page = f"<body><div><a href=x>home</a><a href=y>news</a></div><article><h1>Title</h1><p>{body}</p></article><div><a href=z>next page</a></div></body>"
    weights = html_text.weigh(sum((html_text.tally(html_text.parse(page)) for _ in range(20)), Counter()))
    want = f"Title {body}"
    assert html_text.main_text(html_text.parse(page), weights) == want
    assert html_text.main_text(html_text.parse(page.replace("article>", "div>")), weights) == want


def test_lists_within_the_mark_stay():
    items = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(30))
    page = f"<nav><ul>{items}</ul></nav><article><p>{'word ' * 40}</p><ul>{items}</ul><p>the end of it</p></article>"
    got = html_text.main_text(html_text.parse(page), html_text.weigh(html_text.tally(html_text.parse(page))))
    assert got.startswith("word") and "item 0 item 1" in got and got.endswith("item 29 the end of it")
