"""Hand-made pages by layout, each compared by its whole text."""

import pytest

from tracelake.llm.dom import parse
from tracelake.llm.html_extract import extract, model

LINE = "The council met on Tuesday to discuss the new bridge, and after three hours of debate the members agreed to fund it."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer><p>Copyright 2020 Example Ltd. All rights reserved.</p></footer>"
ASIDE = '<aside class="sidebar"><h3>Related</h3><p>More about bridges can be found here and elsewhere.</p></aside>'
COMMENTS = (
    '<section class="comments"><article><p>Great piece, thank you very much for writing this.</p></article>'
    "<article><h4>Bob</h4><p>I do not agree with a word of it, and I will say why at some length here.</p></article></section>"
)

# (page, blocks beside the paragraphs before them, and after them)
LAYOUTS = {
    "article": (NAV + "<article>{}</article>" + FOOT, [], []),
    "headed": (NAV + "<article><h1>Bridge news</h1>{}</article>" + FOOT, ["Bridge news"], []),
    "main": (NAV + "<main>{}</main>" + ASIDE + FOOT, [], []),
    "comments after": (NAV + "<article>{}</article>" + COMMENTS + FOOT, [], []),
    "comments inside": (NAV + "<article><h1>Bridge news</h1>{}" + COMMENTS + "</article>" + FOOT, ["Bridge news"], []),
    "named div": ('<div class="menu"><a href=/>Home</a> <a href=/n>News</a></div><div class="content">{}</div><div class="footer">Copyright</div>', [], []),
    "bare divs": ("<div><a href=/>Home</a> <a href=/n>News</a></div><div>{}</div>", [], []),
    "bare divs, one link": ("<div><a href=/>Home</a></div><div>{}</div>", [], []),
    "table": ("<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{}</td></tr></table>", [], []),
    "name like a hint": (NAV + "<article><h1>Bridge news</h1>{}<p class='tags-intro'>Last words of it.</p></article>" + FOOT, ["Bridge news"], ["Last words of it."]),
    "apostrophe": (NAV + "<article><h1>Bridge news</h1><p title=it's>First words.</p>{}</article>" + FOOT, ["Bridge news", "First words."], []),
    "advert inside": (NAV + "<article><h1>Bridge news</h1><p>First words.</p><div class=ad>Buy a bridge</div>{}</article>" + FOOT, ["Bridge news", "First words."], []),
    "wrapped": ('<div id="page">' + NAV + '<div class="container"><article>{}</article>' + ASIDE + "</div>" + FOOT + "</div>", [], []),
    "header inside": ("<header><h1>The Daily</h1>" + NAV + "</header><article><header><h1>Bridge news</h1></header>{}</article>" + FOOT, ["Bridge news"], []),
    "cookies and forms": ('<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>' + NAV + "<article>{}</article><form><label>Mail</label><input></form>", [], []),
    "nothing else": ("{}", [], []),
    "lists": (NAV + "<article>{}<ul><li>one thing<li>two things</ul><blockquote>Said he.</blockquote></article>" + FOOT, [], ["one thing", "two things", "Said he."]),
}


@pytest.mark.parametrize("count", [1, 2, 6, 20])
@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name, count):
    page, before, after = LAYOUTS[name]
    texts = [" ".join([LINE] * (1, 2, 5, 3)[i % 4]) + f" Part {i}." for i in range(count)]
    html = "<!DOCTYPE html><html><head><title>T</title></head><body>" + page.format("".join(f"<p>{t}</p>" for t in texts)) + "</body></html>"
    assert extract([html], model()) == ["\n".join(before + texts + after)]


def test_pages_without_an_article():
    assert extract([f"<body>{NAV}{FOOT}</body>", f"<body>{NAV}{ASIDE}</body>", ""], model()) == ["", "", ""]


def test_a_very_long_page():
    texts = [f"{LINE} Part {i}." for i in range(20000)]
    html = f"<body>{NAV}<article>" + "".join(f"<p>{t}</p>" for t in texts) + f"</article>{FOOT}</body>"
    assert extract([html], model()) == ["\n".join(texts)]


def test_attributes_are_read_as_the_standard_has_it():
    def elements(html):
        tree = parse(html)
        return list(zip(tree.tags, tree.names))[1:]

    assert elements("<p title=it's class=a>x</p><p id='b'>y</p>") == [("p", "a"), ("p", "b")]
    assert elements('<p data-class="no" CLASS = "x y" title="a > b">z</p>') == [("p", "x y")]
    assert elements("<p class=a/>x<b id=>y</b>") == [("p", "a/"), ("b", "")]
    assert elements("<!--><p>x<!--a--!><i>") == [("p", ""), ("i", "")]
    assert elements("<script>a='</scripts>'</script ><b>") == [("script", ""), ("b", "")]
    assert elements("<svg><path d='x'/></svg><div/>t") == [("svg", ""), ("path", ""), ("div", "")]
    assert elements('<p "x\' y>z</p><i>') == [("p", ""), ("i", "")]
