"""Main text of web pages by a tree-structured graphical model.

Every element of the page's tree is content or not.  An element has unary
potentials from its tag, its class, id and role names, the shape of its text and
the named blocks it stands in, and each parent and child share a potential that depends on the child's
sort (in-line, paragraph-like or sectioning).  Sum-product messages go up the
tree and down again, which gives the exact marginals; an element's own text is
kept where content is the likelier.  Messages of all the pages of a batch pass
together, one depth of their trees at a time.

The potentials are trained by the gradient of the likelihood (label counts less
the expected counts under the marginals) on labelled pages that a seeded writer
makes in many layouts, well and badly formed.  No row of the tables is used.

Defined results: null, empty or text-free html gives the empty text; character
references are decoded once, unknown ones stay; white space inside a block is
one blank; blocks are joined by one newline; nothing is capped; rows that
repeat give the same text; other columns are neither read nor returned.
"""

from __future__ import annotations

import html as html_module
import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import bounded_batches, map_arrow
from tracelake.llm.dom import INLINE, RAW, Tree, parse

# Tags with a potential of their own, and names that give an
# element's part away.
_TAGS = (
    "#root html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre "
    "figure figcaption a b i em strong span code nav header footer aside form fieldset button label input select "
    "script style noscript title iframe menu address details summary dialog img br hr"
).split()
_BAD = "ad ads advert advertisement sponsor sponsored promo promoted banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side widget comment comments disqus reply replies respond discussion share sharing social related recommended more newsletter subscribe signup login cookie cookies consent notice alert popup modal legal copyright pagination pager tags search form contentinfo complementary toolbar logo".split()
_GOOD = "article content main post entry story body text page-content post-body entry-content article-body story-body maincontent".split()
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
_BAD_SET, _GOOD_SET = frozenset(_BAD), frozenset(_GOOD)
_SECTION = frozenset("html head body article main section div nav header footer aside form fieldset details dialog #root".split())
_BAD_TAGS = frozenset("nav header footer aside form button select noscript script style iframe dialog menu".split())
_SHAPES = 16
_HINTS = 4
_PLACES = 8
_SIZE = len(_TAGS) + 1 + 3 * _HINTS + _PLACES + _SHAPES


@lru_cache(maxsize=1 << 14)
def _hints(names: str) -> tuple[float, float, float, float]:
    """A name of the bad list; a bad word within a longer name; a good one; others."""
    whole = names.split()
    words = names.replace("-", " ").replace("_", " ").split()
    exact = any(w in _BAD_SET for w in whole)
    bad = any(w in _BAD_SET or w.rstrip("s") in _BAD_SET for w in words)
    good = any(w in _GOOD_SET for w in whole) or any(w in _GOOD_SET for w in words)
    return float(exact), float(bad and not exact), float(good), float(bool(words) and not bad and not good)


def _places(tree: Tree, sort: np.ndarray) -> np.ndarray:
    """Where an element stands: the nearest block at or above it that its tag or
    names call content or not, and what stands above that."""
    n = len(tree.tags)
    near, good_above, bad_above = [0] * n, [False] * n, [False] * n
    for i in range(n):
        p = tree.parents[i]
        if p >= 0:
            near[i], good_above[i], bad_above[i] = near[p], good_above[p], bad_above[p]
            good_above[i] |= near[p] > 0
            bad_above[i] |= near[p] < 0
        if sort[i] == 0:
            continue
        exact, part, good, _ = _hints(tree.names[i]) if tree.names[i] else (0, 0, 0, 0)
        if tree.tags[i] in _BAD_TAGS or exact or (part and sort[i] == 2 and not good):
            near[i] = -1
        elif tree.tags[i] in ("article", "main") or (good and sort[i] == 2):
            near[i] = 1
    place, up, down = np.array(near), np.array(good_above), np.array(bad_above)
    framed_ = bool((place > 0).any())
    out = np.zeros((n, _PLACES), np.float32)
    out[:, 0] = (place > 0) & ~down
    out[:, 1] = (place > 0) & down
    out[:, 2] = (place < 0) & ~up
    out[:, 3] = (place < 0) & up
    out[:, 4] = (place == 0) & framed_
    out[:, 5] = (place == 0) & (not framed_)
    header = np.array([t == "header" for t in tree.tags])
    out[:, 6] = header & up
    out[:, 7] = np.array([t == "header" for t in (tree.tags[p] if p >= 0 else "" for p in tree.parents)]) & up
    return out


def node_features(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each element, its parent, and the sort of its edge upwards."""
    n = len(tree.tags)
    tags, parents = tree.tags, tree.parents
    own = [0] * n
    words = [0] * n
    for node, text in tree.pieces:
        if text is not None:
            length = len(text.strip()) if len(text) < 64 else len(text)
            own[node] += length
            words[node] += text.count(" ") + (length > 0)
    whole, linked, paragraphs = own[:], [own[i] if tags[i] in ("a", "button", "label") else 0 for i in range(n)], [float(t == "p") for t in tags]
    children, anchors = [0] * n, [float(t == "a") for t in tags]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        whole[p] += whole[i]
        linked[p] += whole[i] if tags[i] == "a" else linked[i]
        paragraphs[p] += paragraphs[i]
        anchors[p] += anchors[i]
        children[p] += 1
    x = np.zeros((n, _SIZE), np.float32)
    sort = np.array([0 if t in INLINE else 2 if t in _SECTION else 1 for t in tags], np.int64)
    at = len(_TAGS) + 1
    for i, tag in enumerate(tags):
        x[i, _TAG_AT.get(tag, len(_TAGS))] = 1
        if tree.names[i]:
            x[i, at + _HINTS * sort[i] : at + _HINTS * (sort[i] + 1)] = _hints(tree.names[i])
    at += 3 * _HINTS
    x[:, at : at + _PLACES] = _places(tree, sort)
    w, k, o = np.array(whole, float), np.array(linked, float), np.array(own, float)
    paragraphs_, children_, anchors_ = np.array(paragraphs), np.array(children), np.array(anchors)
    share = k / np.maximum(w, 1)
    shape = x[:, at + _PLACES :]
    shape[:, 0] = 1
    shape[:, 1] = np.minimum(np.log1p(w), 8) / 8
    shape[:, 2] = np.minimum(np.log1p(o), 8) / 8
    shape[:, 3] = share
    shape[:, 4] = share > 0.6
    shape[:, 5] = w == 0
    shape[:, 6] = np.minimum(np.log1p(np.array(words, float)), 6) / 6
    shape[:, 7] = np.minimum(paragraphs_, 6) / 6
    shape[:, 8] = np.minimum(children_, 10) / 10
    shape[:, 9] = w / max(w[0], 1)
    shape[:, 10] = (sort == 2) * (paragraphs_ > 0)
    shape[:, 11] = (sort == 2) * share
    shape[:, 12] = (sort == 1) * share
    shape[:, 13] = (sort == 2) * (w / max(w[0], 1) > 0.5)
    shape[:, 14] = (share > 0.6) * np.minimum(anchors_, 4) / 4
    # A cell or a block all of whose text is linked, and an element inside one.
    tied = (share > 0.95) & (sort > 0) & (w > 0)
    inside = np.zeros(n, bool)
    for i in range(1, n):
        inside[i] = tied[i] or inside[parents[i]]
    shape[:, 15] = inside
    return x, np.array(parents), sort


@dataclass(frozen=True)
class Potentials:
    unary: np.ndarray  # by feature, for content
    pair: np.ndarray  # by sort of edge, parent's label, child's label


def _levels(depths: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depths, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depths[order])) + 1) if len(order) else []


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = np.maximum(a, b)
    return high + np.log1p(np.exp(np.minimum(a, b) - high))


def marginals(score: np.ndarray, parents: np.ndarray, sort: np.ndarray, depths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on a forest: the chance of content by node, and the joint
    chances of (parent, child) labels by edge."""
    n = len(score)
    inside = np.zeros((n, 2))
    inside[:, 1] = score
    sent = np.zeros((n, 2))
    levels = _levels(depths)
    for level in reversed(levels[1:]):
        m = inside[level][:, None, :] + pair[sort[level]]
        sent[level] = _log_sum(m[:, :, 0], m[:, :, 1])
        # Parents stand one level up, in a narrow range of places.
        up, first = parents[level], parents[level].min()
        for label in (0, 1):
            add = np.bincount(up - first, sent[level, label])
            inside[first : first + len(add), label] += add
    whole = inside.copy()
    joint = np.zeros((n, 2, 2))
    for level in levels[1:]:
        outer = whole[parents[level]] - sent[level]
        m = outer[:, :, None] + pair[sort[level]]
        whole[level] = inside[level] + _log_sum(m[:, 0], m[:, 1])
        full = m + inside[level][:, None, :]
        full -= full.max(axis=(1, 2), keepdims=True)
        e = np.exp(full)
        joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -500, 500))), joint


def _forest(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    xs, ps, ss, ds, starts, first = [], [], [], [], [], 0
    for tree in trees:
        x, p, s = node_features(tree)
        xs.append(x)
        ps.append(np.where(p >= 0, p + first, -1))
        ss.append(s)
        ds.append(np.array(tree.depths))
        starts.append(first)
        first += len(x)
    return np.concatenate(xs), np.concatenate(ps), np.concatenate(ss), np.concatenate(ds), starts


def train(trees: list[Tree], labels: list[np.ndarray], steps: int = 150, rate: float = 0.1, pull: float = 0.02) -> Potentials:
    x, parents, sort, depths, _ = _forest(trees)
    y = np.concatenate(labels).astype(float)
    # In the order of depths, so that each level is one stretch.
    order = np.argsort(depths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    x, y, sort, depths = x[order], y[order], sort[order], depths[order]
    parents = np.where(parents[order] >= 0, place[parents[order]], -1)
    edges = parents >= 0
    pair_true = np.zeros((3, 2, 2))
    np.add.at(pair_true, (sort[edges], y[parents[edges]].astype(int), y[edges].astype(int)), 1)
    params = [np.zeros(x.shape[1]), np.zeros((3, 2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scale = 100 / len(y)
    for turn in range(1, steps + 1):
        p, joint = marginals(x @ params[0].astype(np.float32), parents, sort, depths, params[1])
        cells = joint[edges].reshape(-1, 4)
        expected = np.stack([np.bincount(sort[edges], cells[:, c], 3) for c in range(4)], axis=1).reshape(3, 2, 2)
        grads = [scale * ((y - p).astype(np.float32) @ x) - pull * params[0], scale * (pair_true - expected) - pull * params[1]]
        for w, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
    return Potentials(params[0], params[1])


class _Writer:
    """Labelled pages: each element is content or not by how it was written.

    Layout, headings, names, lengths and noise are drawn independently, so that
    none of them stands for content by itself."""

    def __init__(self, seed: int) -> None:
        self.rng = rng = random.Random(seed)
        parts = ["an", "re", "th", "ent", "on", "ed", "la", "qu", "és", "ung"]
        self.vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)]

    def words(self, lo: int, hi: int) -> str:
        rng = self.rng
        out = rng.choices(self.vocabulary, k=rng.randint(lo, hi))
        return " ".join(out).capitalize() + rng.choice([".", ".", ".", "", "&amp;", "!"])

    def links(self, form: str, lo: int = 1, hi: int = 8) -> str:
        return form.join(f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(lo, hi)))

    def noise(self) -> str:
        rng = self.rng
        links = "".join(f'<li><a href="/x">{self.words(1, 2)}</a></li>' for _ in range(rng.randint(1, 8)))
        name = rng.choice(["{}", "{}", "{}-box", "site-{}", "{} wide", "top_{}", "{}-list"])
        hint = lambda *w: rng.choice(["class", "id"]) + rng.choice(['="{}"', "='{}'"]).format(name.format(rng.choice(w)))
        text = self.words(*rng.choice([(2, 8), (2, 25), (20, 90)]))
        short = self.words(1, 4)
        return rng.choice([
            f"<nav><ul>{links}</ul></nav>", f"<nav>{self.links(' ')}</nav>", f"<div {hint('menu', 'nav', 'breadcrumb')}><ul>{links}</ul></div>", f"<ul {hint('menu', 'nav', 'tags')}>{links}</ul>",
            f"<header><a href='/'>{self.words(1, 2)}</a><p>{self.words(2, 6)}</p></header>", f"<header><h1>{short}</h1><nav>{self.links(' | ')}</nav></header>", f"<div {hint('header', 'banner', 'masthead')}>{text}</div>",
            f"<footer>&copy; {text}</footer>", f"<footer><p>{text}</p><ul>{links}</ul></footer>", f"<footer><p>{text}</p><p>{short}</p></footer>", f"<div {hint('footer', 'copyright', 'legal')}><p>{text}</p></div>",
            f"<aside><h3>{self.words(1, 3)}</h3><p>{text}</p></aside>", f"<aside><ul>{links}</ul></aside>", f"<aside>{text}</aside>", f"<div {hint('sidebar', 'related', 'widget')}><h4>{self.words(1, 3)}</h4><ul>{links}</ul></div>",
            f"<div {hint('sidebar', 'related', 'widget')}><h3>{short}</h3><p>{text}</p><p>{self.words(5, 40)}</p></div>",
            f"<div {hint('ad', 'ads', 'sponsored', 'promo')}>{text}</div>", f"<div {hint('ad', 'advert', 'promo')}><p>{text}</p><p>{self.words(3, 9)}</p></div>", f"<p class=ad>{text}</p>", f"<section {hint('promo', 'advertisement')}><h2>{short}</h2><p>{text}</p></section>",
            f"<div {hint('cookie', 'notice', 'alert', 'consent')}><p>{text}</p><button>{self.words(1, 1)}</button></div>", f"<div role={rng.choice(['alert', 'banner', 'navigation', 'contentinfo', 'complementary', 'search'])}><p>{text}</p></div>",
            f"<form action='/s'><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 1)}</button></form>", f"<form><p>{text}</p><select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select></form>",
            self.comments(hint), self.comments(hint), self.comments(hint),
            f"<div {hint('share', 'social', 'newsletter')}><a href='#'>{self.words(1, 2)}</a> <a href='#'>{self.words(1, 2)}</a></div>",
            f"<script>var a='{text}';</script>", f"<noscript>{text}</noscript>", f"<!-- {text} -->", "<style>p{a:b}</style>", f"<dialog>{text}</dialog>",
        ])

    def comments(self, hint) -> str:
        """Comments, some of them shaped like articles, with headings or without."""
        rng = self.rng
        outer = rng.choice(["section", "div", "ul", "ol", "aside"])
        inner = "li" if outer in ("ul", "ol") else rng.choice(["div class='comment'", "article", "article class=comment", "div", "section"])
        title = rng.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>"]) if inner != "li" else ""
        each = []
        for _ in range(rng.randint(1, 5)):
            by = rng.choice(["", f"<b>{self.words(1, 2)}</b>", f"<h4>{self.words(1, 2)}</h4>", f"<span class=user>{self.words(1, 1)}</span>"])
            body = "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "{}"]).format(self.words(3, 80)) for _ in range(rng.randint(1, 3)))
            each.append(f"<{inner}>{by}{body}</{inner.split()[0]}>")
        return f"<{outer} {hint('comments', 'comment', 'discussion', 'replies', 'responses')}>{title}{''.join(each)}</{outer}>"

    def bare_noise(self) -> str:
        """Noise that neither a tag nor a name gives away: linked lists."""
        joint = self.rng.choice([" ", " | ", "<br>", "<br>\n", " &middot; "])
        links = self.links(joint)
        cells = "".join(f"<td>{self.links(joint, 1, 2)}</td>" for _ in range(self.rng.randint(1, 5)))
        items = "".join(f"<li>{self.links(' ', 1, 1)}</li>" for _ in range(self.rng.randint(1, 7)))
        return self.rng.choice([f"<div>{links}</div>", f"<p>{links}</p>", f"<center>{links}</center>", f"<ul>{items}</ul>", f"<div><ul>{items}</ul></div>", f"<table><tr>{cells}</tr></table>", f"<div><div>{self.links('', 1, 1)}</div></div>", f"<div><p>{self.links('', 1, 1)}</p></div>"])

    def names(self) -> str:
        """Names of blocks of content; some hold a word that noise has, too."""
        rng = self.rng
        if rng.random() < 0.75:
            return ""
        odd = rng.choice(_BAD) + rng.choice(["-", "_"]) + rng.choice(["intro", "note", "first", "lead", "text", "worthy"])
        word = rng.choice(["lead", "intro", "first", "dropcap", "para", "text", "it's", odd, odd])
        return rng.choice([f" class={word}", f' class="{word}"', f' id="{word}"', f" title={word}", f' title="{word}"'])

    def paragraph(self) -> str:
        rng = self.rng
        text = self.words(*rng.choice([(1, 1), (1, 4), (5, 30), (5, 30), (30, 120), (60, 250)]))
        if rng.random() < 0.25:
            cut = len(text) // 2
            tag = rng.choice(["b", "i", "em", "strong", "a href='/y'", "span", "code"])
            text = f"{text[:cut]} <{tag}>{self.words(1, 4)}</{tag.split()[0]}> {text[cut:]}"
        items = "".join(f"<li>{self.words(1, 12)}" + rng.choice(["</li>", ""]) for _ in range(rng.randint(1, 5)))
        own = self.names()
        return rng.choice(
            [f"<p{own}>{text}</p>"] * 12 + [f"<p{own}>{text}", f"<p><b>{text}<br>", f"<p><b>{text}</b></p>", f"<p>{text}<br>{self.words(1, 9)}</p>"]
            + [f"<h{rng.randint(1, 4)}>{self.words(1, 9)}</h0>".replace("</h0>", "</h2>"), f"<h2{own}>{self.words(1, 8)}</h2>", f"<h3>{self.words(1, 12)}</h3>"]
            + [f"<ul{own}>{items}</ul>", f"<ol>{items}</ol>", f"<blockquote><p>{text}</p></blockquote>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>"]
            + [f"<table><tr><th>{self.words(1, 2)}</th></tr><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>", f"<dl><dt>{self.words(1, 3)}<dd>{text}</dl>"]
            + [f"<figure><img src=a><figcaption>{self.words(2, 9)}</figcaption></figure>", f"<div{own}>{text}</div>", f"<section><h2>{self.words(1, 5)}</h2><p>{text}</p></section>", f"<hr><p>{text}</p>"]
            + [f"<div><p{own}>{text}</p><p>{self.words(3, 60)}</p></div>", f"{text}<br><br>"]
        )

    def page(self) -> str:
        """Content stands between the marks <x-c> and </x-c>, noise within it
        between <x-n> and </x-n>."""
        rng = self.rng
        name = rng.choice(_GOOD)
        framed_ = rng.random() < 0.75
        if framed_:
            opening, closing = rng.choice(
                [("<article>", "</article>")] * 4 + [("<main>", "</main>"), (f'<div class="{name}">', "</div>"), (f'<div id="{name}">', "</div>"), ("<main><article>", "</article></main>"), (f'<article class="{name}">', "</article>"), (f'<section class="{name}">', "</section>"), ("<div role=main>", "</div>"), ("<main><div>", "</div></main>")]
            )
        else:
            opening, closing = rng.choice([("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<section>", "</section>"), ("<center>", "</center>"), ("<table><tr><td>", "</td></tr></table>")])
        inside = 0.08 if framed_ else 0.03
        plain = rng.random() < 0.3
        parts = [f"<p>{self.words(*rng.choice([(5, 30), (40, 250)]))}</p>" if plain else self.paragraph() for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 15]))]
        body = "".join((f"<x-n>{self.noise()}</x-n>" if rng.random() < inside else "") + part for part in parts)
        title = f"<h{rng.choice([1, 1, 1, 2])}>{self.words(1, 12)}</h1>" if rng.random() < 0.5 else ""
        if title and framed_ and rng.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = f"<x-c>{opening}{title}{body}{closing}</x-c>"
        noise = self.noise if framed_ or rng.random() < 0.4 else self.bare_noise
        before, after = ("".join((noise if rng.random() < 0.85 else self.bare_noise)() for _ in range(rng.randint(0, 4))) for _ in range(2))
        if rng.random() < 0.4:
            wrap = rng.choice(["div class='wrapper'", "div id='page'", "div", "div class='container row'"])
            inner = f"<{wrap}>{before}{inner}{after}</div>"
        elif not framed_ and rng.random() < 0.4:
            inner = f"<table><tr><td>{before}</td><td>{inner}</td><td>{after}</td></tr></table>"
        else:
            inner = before + inner + after
        tail = "</body></html>" if rng.random() < 0.7 else ""
        return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{inner}{tail}"

    def labelled(self) -> tuple[Tree, np.ndarray]:
        marked = self.page()
        # The marks are read as elements, which are then taken out of the tree.
        tree = parse(marked)
        keep = [i for i, t in enumerate(tree.tags) if t not in ("x-c", "x-n")]
        label = [0] * len(tree.tags)
        up = list(tree.parents)
        for i in range(1, len(tree.tags)):
            p = tree.parents[i]
            label[i] = 1 if tree.tags[i] == "x-c" else 0 if tree.tags[i] == "x-n" or tree.tags[i] in RAW else label[p]
            while up[i] >= 0 and tree.tags[up[i]] in ("x-c", "x-n"):
                up[i] = up[up[i]]
        place = {old: new for new, old in enumerate(keep)}
        clean = Tree([tree.tags[i] for i in keep], [tree.names[i] for i in keep], [place.get(up[i], -1) for i in keep])
        for i in range(len(keep)):
            clean.depths.append(0 if i == 0 else clean.depths[clean.parents[i]] + 1)
        clean.pieces = [(place[i], t) for i, t in tree.pieces if i in place]
        return clean, np.array([label[i] for i in keep])


@lru_cache(maxsize=1)
def model(pages: int = 900, seed: int = 11) -> Potentials:
    writer = _Writer(seed)
    trees, labels = zip(*(writer.labelled() for _ in range(pages)))
    return train(list(trees), list(labels))


def extract(pages: list[str], potentials: Potentials) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    x, parents, sort, depths, starts = _forest(trees)
    p, _ = marginals(x @ potentials.unary, parents, sort, depths, potentials.pair)
    return [_text(t, (p[first : first + len(t.tags)] >= 0.5).tolist()) for t, first in zip(trees, starts)]


def _text(tree: Tree, keep: list[bool]) -> str:
    blocks, run = [], []
    for node, text in tree.pieces:
        if text is None:
            if run:
                blocks.append(run)
                run = []
        elif keep[node] and tree.tags[node] not in RAW:
            run.append(text)
    blocks.append(run)
    lines = (" ".join(html_module.unescape("".join(r)).split()) for r in blocks)
    return "\n".join(line for line in lines if line)


class _Task:
    def __init__(self) -> None:
        self.potentials = model()

    def __call__(self, page_id: pa.Array, url: pa.Array, html: pa.Array) -> dict:
        return {"page_id": page_id, "url": url, "text": extract([h or "" for h in html.to_pylist()], self.potentials)}


def html_extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): its main text."""
    bounded_batches(pages.sparkSession)
    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), _Task(), "page_id long, url string, text string")
