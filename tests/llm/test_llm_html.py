"""HTML extraction: names, host counts against a plain count, and parsing in linear time against a walk."""

import random
import time

import pytest

from foliant.llm import op3_html_extraction as H

SCHEMA = "page_id long, url string, html string"


def extract(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in H.extract_pages(spark.createDataFrame(rows, SCHEMA), **options).collect()}


@pytest.mark.parametrize(
    "name,stays",
    [
        ("ad-slot", False), ("site-footer", False), ("comment-list", False), ("share-buttons", False), ("social_share", False), ("related-posts", False), ("cookie_notice", False), ("newsletter-signup-box", False),
        ("market-share", True), ("notice-board", True), ("content-box", True), ("entry", True), ("shared-history", True), ("reply-to-critics", True),
    ],
)
def test_names_of_containers(spark, name, stays):
    page = f'<article><h1>Title</h1><p>First part.</p><div class="x {name}"><p>Boxed words.</p></div><section id="{name}">More.</section><p class="{name}">A paragraph stays.</p></article>'
    want = ["Title", "First part.", *(["Boxed words.", "More."] if stays else []), "A paragraph stays."]
    assert extract(spark, [(1, None, page)])[1].split("\n") == want


def test_wrappers_of_compound_names_stay(spark):
    page = '<body class="nav-open"><div class="page has-sidebar"><div class="site-nav"><ul><li>Home</li></ul></div><div class="content-with-sidebar"><h1>Head</h1><p>Body.</p></div><div class="widget-area">Side</div></div></body>'
    comments = '<article><p>Text.</p><ol class="comment-list"><li><article class="comment-body"><h1>Me</h1>First!</article></li></ol></article>'
    assert extract(spark, [(1, None, page), (2, None, comments)]) == {1: "Head\nBody.", 2: "Text."}


@pytest.mark.parametrize("others", [30, 180])
def test_a_box_on_many_pages_goes_whatever_the_size_of_the_host(spark, others):
    box = "<table><tr><td>Order the handbook</td></tr></table>"
    rows = [(i, f"http://h.org/{i}", f"<article><p>Own words of page {i}, enough of them.</p>{box if i < 20 else ''}</article>") for i in range(20 + others)]
    rows += [(9000 + i, f"http://other{i}.org/", f"<article><p>Page {i} elsewhere, also long enough.</p>{box}</article>") for i in range(20)]
    got = extract(spark, rows)
    assert not any("handbook" in got[i] for i in range(20 + others)) and all("handbook" in got[9000 + i] for i in range(20))
    assert all(f"Own words of page {i}," in got[i] for i in range(20 + others))


def test_counts_are_those_of_a_plain_count(spark):
    rnd = random.Random(4)
    boxes = [f"<div><p>box {k} {'word ' * (k % 3 + 1)}</p></div>" for k in range(12)]
    rows, held = [], {}
    for i in range(150):
        site = rnd.choice(["a.org", "b.org", "c.org"])
        own = [k for k in range(12) if rnd.random() < (k + 1) / 40]
        rows.append((i, f"https://{site}/p{i}", f"<article><p>{'Words of its own, number ' + str(i) + '. '} {'x' * 200}</p>{''.join(boxes[k] for k in own)}</article>"))
        for k in own:
            held.setdefault((site, k), set()).add(i)
    got = extract(spark, rows)
    for i, url, _ in rows:
        site = url.split("/")[2]
        for k in range(12):
            if i in held.get((site, k), ()):
                assert (f"box {k} " in got[i] + " ") == (len(held[site, k]) < 5), (i, k)


def test_a_page_under_many_addresses_keeps_its_article(spark):
    rows = [(i, f"http://h.org/{i}", f"<nav>{i}</nav><article><div><p>The same long article on every page.</p></div></article>") for i in range(9)]
    assert set(extract(spark, rows).values()) == {"The same long article on every page."}


def walk(text):
    """The tree that the rules of implied ends give, found by walking up the open elements for every tag."""
    root = H.Node("#root")
    stack = [root]
    for m in H._PART.finditer(text):
        if m[5] is not None:
            stack[-1].items.append(m[5])
        elif m[3] is not None:
            tag = m[3].lower()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                continue
            for closes, fences in ([({"p"}, H.BLOCK)] if tag in H.BLOCK and tag != "br" else []) + ([(H.CLOSES[tag], H.FENCES.get(tag, ("table",)))] if tag in H.CLOSES else []):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in closes:
                        del stack[k:]
                        break
                    if stack[k].tag in fences:
                        break
            node = H.Node(tag)
            stack[-1].items.append(node)
            if tag not in H.VOID and not m[4].endswith("/"):
                stack.append(node)
    return root


def shape(n):
    return n.tag, [shape(x) if isinstance(x, H.Node) else x for x in n.items]


def test_parsing_is_the_walk():
    rnd = random.Random(3)
    tags = "p div td th tr table tbody li ul dt dd dl b article option br".split()
    for _ in range(3000):
        text = "".join(rnd.choice([f"<{rnd.choice(tags)}>", f"</{rnd.choice(tags)}>", f"<{rnd.choice(tags)}/>", "x"]) for _ in range(rnd.randint(0, 25)))
        assert shape(H.parse(text)) == shape(walk(text)), text


@pytest.mark.parametrize("text", ["<td><table>" + "<b>" * 120_000 + "<td/>" * 120_000, "<dd><dl>" + "<b>" * 120_000 + "<dt/>" * 120_000, "<li><ul>" + "<i>" * 120_000 + "<li/>" * 120_000, "<p><b>" * 80_000 + "<div/>" * 80_000])
def test_a_megabyte_of_open_tags_takes_seconds(text):
    began = time.time()
    root = H.parse(text)
    H.hash_subtrees(root)
    H.text_of(H.contents(root), set())
    assert time.time() - began < 15
