from __future__ import annotations

import math
import os
import random
import time

import pytest

from lamina.llm import html_text as H

PROSE = "A sentence of the main text, with some words in it. " * 4


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p></p><script>x</script>", ""),
        ("just text &amp; &eacute;&#33; ", "just text & é!"),
        ("<article><h1>T</h1><p>a<b>b</b>\n c<br>d</article>", "T ab c d"),
        ("<article><p><b>one<br><p>two</p><p>three", "one two three"),
        ("<article><p>a &lt;b&gt; &amp;amp;</p></article>", "a <b> &amp;"),
        ("<article><p>x<script>var t='</p>'</script>y<style>p{}</style></p></article>", "xy"),
        ("<article><p>a<!-- no --> b</p><div class='ad-box'>buy</div><p>c</p></article>", "a b c"),
        ("<article><p>a</p><section id='comments'><p>me too</p></section><aside>b</aside></article>", "a"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
        ("<ARTICLE><P>upper</P></ARTICLE>", "upper"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article><p title='a > b'>attribute</p></article>", "attribute"),
        ("<article><p>cut <a href='x", "cut"),
        ("<article><p>a <b title=\"x>b</b> c</p></article>", "a b c"),
    ],
)
def test_small_pages(page, text):
    assert H.main_text(page) == text


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>{body}<footer>(c) someone</footer></body></html>"


def test_boilerplate_around_an_article():
    assert H.main_text(page(f"<div class=ad>Buy, now.</div><article><h1>Title</h1><p>{PROSE}</p><p>End</p></article>")) == f"Title {PROSE.strip()} End"


def test_paths_choose_the_container_without_an_article():
    body = f"<div class=x><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=y><h2>Title</h2><p>{PROSE}</p><p>{PROSE}</p><p>End.</p></div><div>small print</div>"
    assert H.main_text(page(body)) == f"Title {PROSE.strip()} {PROSE.strip()} End."


@pytest.mark.parametrize(
    "attributes,kept",
    [
        ("style='overflow:hidden'", True),
        ('title="the hidden truth"', True),
        ('data-id="menu"', True),
        ("data-class=ad x-role=menu", True),
        ("title='say id=\"menu\"'", True),
        ("alt=hidden data-hidden", True),
        ("aria-hidden=false", True),
        ("title=\"x\"class='ad'", False),
        ("data-x='1' HIDDEN", False),
        ("hidden=''", False),
        ("a=b/ ID = menu", False),
        ("style='overflow:hidden' role=navigation", False),
        ("aria-hidden='true'", False),
    ],
)
def test_only_whole_attribute_names_count(attributes, kept):
    assert H.main_text(f"<article><p>a</p><div {attributes}>b</div></article>") == ("a b" if kept else "a")
    assert H.main_text(f"<article><p>a <span {attributes}>b</span></p></article>") == ("a b" if kept else "a")


def test_a_quote_that_does_not_close_holds_no_attributes():
    assert H.main_text('<article><p title="the hidden truth>a</p></article>') == "a"


def test_body_with_a_style_is_not_hidden():
    assert H.main_text(f'<html><body style="overflow:hidden"><p>{PROSE}</p></body></html>') == PROSE.strip()


@pytest.mark.parametrize("short", [400, 600, 3000])
def test_blocks_beside_a_long_one_stay_at_any_number_of_paths(short):
    long = "word and more words, " * 1000
    divs = [f"<div>block {i} has some words, and then a few others. {'x' * 60}</div>" for i in range(short)]
    divs.insert(short // 2, f"<div>{long}</div>")
    assert H.main_text("<html><body>" + "".join(divs) + "</body></html>").count("has some words") == short


def tree(rng, depth, kinds):
    """A well-formed page part: (tag, class, children or text)."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        tag, name = rng.choice(kinds), rng.choice(["", "", "", "a", "b", "ad", "has-sidebar", "menu"])
        if tag in ("p", "h1", "li") or depth == 0:
            links, text = rng.random() < 0.2, "a, word. " * rng.randrange(1, 30)
            out.append((rng.choice(["p", "h1", "li"]), name, text, links))
        else:
            out.append((tag, name, tree(rng, depth - 1, kinds), False))
    return out


def written(part):
    out = []
    for tag, name, inside, links in part:
        body = written(inside) if isinstance(inside, list) else f"<a href=x>{inside}</a>" if links else inside
        out.append(f"<{tag}{f' class={name}' if name else ''}>{body}</{tag}>")
    return "".join(out)


def brute(part):
    """The main text by the definitions, on tuples of elements and over all pairs of paths."""
    blocks, elements = [], {}

    def walk(part, above):
        for tag, name, inside, links in part:
            path = (*above, (tag, name))
            elements[path] = elements.get(path, 0) + 1
            if isinstance(inside, list):
                walk(inside, path)
            else:
                blocks.append((path, inside.strip(), links))

    walk(part, ())
    plain = {}
    for path, text, links in blocks:
        row = plain.setdefault(path, [0, 0, 0, 0])
        row[0] += 0 if links else len(text)
        row[1] += 0 if links else text.count(".") + text.count(",")
        row[2] += 1
        row[3] += len(text) if links else 0
    scores = {}
    for p in plain:
        near = [(math.exp(-d * d / 2), plain[q]) for q in plain if (d := len(p) + len(q) - 2 * len(os.path.commonprefix([p, q]))) <= 4]
        total = sum(w for w, _ in near)
        scores[p] = (1 + sum(w * r[0] / r[2] for w, r in near) / total) * (1 + sum(w * r[1] / r[2] for w, r in near) / total) * plain[p][2]
    every = sorted(elements)
    inside = lambda path, what: sum(r[what] for q, r in plain.items() if q[: len(path)] == path)
    is_marked = lambda e: e[0] in ("nav", "footer", "aside") or (e[0] not in ("article", "main") and e[1] in ("ad", "menu"))
    sure = [p for p in every if p[-1][0] in ("article", "main", "h1") and inside(p, 0) and not any(map(is_marked, p))]
    wrapper = {p for p in every if inside(p, 0) >= 0.9 * inside((), 0) and all(q[: len(p)] == p for q in sure)}
    marks = {p: sum(is_marked(p[i]) and p[: i + 1] not in wrapper for i in range(len(p))) for p in [(), *every]}
    region = {}
    for kind in ("article", "main"):
        own = {p: next((p[: i + 1] for i in range(len(p)) if p[i][0] == kind and not marks[p[: i + 1]]), None) for p in every}
        if any(r and inside(r, 0) for r in own.values()):
            region = own
            break
    outside = bool(region)
    scores = {p: s * math.exp(-6) ** (marks[p] + (outside and not region[p])) for p, s in scores.items()}
    mean = sum(scores.values()) / len(scores)
    threshold = min(max(scores.values()), 0.8 * math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores)))
    selected = {p for p, s in scores.items() if s >= threshold}
    if outside:
        content = {p for p in plain if region[p] and (not marks[p] or p in selected)}
    else:
        mass = lambda path: sum(scores[q] for q in selected if q[: len(path)] == path)
        titles = lambda path: sum(r[0] for q, r in plain.items() if q[: len(path)] == path and q[-1][0] == "h1" and not marks[q])
        root = ()
        while True:
            down = [p for p in every if p[:-1] == root and mass(p) >= 0.9 * mass(()) and elements[p] == 1 and titles(p) == titles(root)]
            if not down or (down[0] in plain and down[0][-1][0] not in ("article", "main", "section", "div", "body", "td", "li", "blockquote")):
                break
            root = down[0]
        menu = lambda path: inside(path, 3) >= 0.8 * (inside(path, 0) + inside(path, 3))
        content = {
            p
            for p in plain
            if p[: len(root)] == root and (p in selected or (marks[p] <= marks[root] and not (len(p) > len(root) and menu(p[: len(root) + 1]))))
        }
    return " ".join(text for path, text, _ in blocks if path in content)


@pytest.mark.parametrize("kinds", [["div", "section", "p"], ["div", "nav", "p", "aside"], ["div", "article", "p", "aside"], ["main", "section", "p", "footer", "article"]])
def test_against_brute_force(kinds):
    rng = random.Random(len(kinds) + len(kinds[1]))
    for _ in range(150):
        part = tree(rng, 4, kinds)
        assert H.main_text(written(part)) == brute(part), written(part)


def test_wrappers_named_like_boilerplate_are_not():
    for name in ("layout has-sidebar", "page with-header", "sidebar"):
        assert H.main_text(f'<body><div class="{name}"><h1>T</h1><p>{PROSE}</p><div class=ad>Buy, now.</div></div></body>') == f"T {PROSE.strip()}"


def test_all_articles_stay():
    assert H.main_text(page(f"<article class=a><p>{PROSE}</p></article><p>between</p><article class=b><p>Two</p></article>")) == f"{PROSE.strip()} Two"
    assert H.main_text(page(f"<article><p>{PROSE}</p></article><section id=comments><article><p>{PROSE * 9}</p></article></section>")) == PROSE.strip()


def test_elements_inside_left_out_inline_elements():
    assert H.main_text("<article><p><span class=ad>buy <span>now</span> today</span> x</p></article>") == "x"
    assert H.main_text("<article><p>a <span class=ad>buy <span>now</p><p>b</p></article>") == "a b"


@pytest.mark.parametrize("body", ["<div>" * 12_000 + PROSE, "<ul><li>x" * 12_000, "<b><div>y" * 12_000, "</i></div><p>z" * 12_000, "".join(f"<div class=c{i}>t{i}." for i in range(12_000))])
def test_deep_pages_take_no_longer(body):
    began = time.perf_counter()
    assert H.main_text(body)
    assert time.perf_counter() - began < 5  # some tenths of a second on a free machine


def test_whole_table(spark):
    rows = [(1, "u", page(f"<article><p>{PROSE * 2000}</p></article>")), (1, "u", None), (None, None, "<p>x")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, len((PROSE * 2000).strip())]
    assert H.extract(pages.limit(0)).count() == 0
