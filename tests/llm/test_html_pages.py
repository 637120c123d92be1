"""Main text against a slow, independent reading of the method, on pages without article elements; deep and broken markup; odd names."""

import html
import math
import random
import re
import time

import pytest

from dossio.llm import html_extract

PARTS = re.compile(r"<(/?)(\w+)[^>]*>|([^<]+)")
DROPPED = {"nav", "footer", "script", "style", "head"}


def slow_text(page):
    """Counts by walking each node's whole subtree, again for every node."""
    root = up = {"tag": "root", "down": [], "up": None}
    for close, tag, text in PARTS.findall(page):
        if text:
            up["down"].append(html.unescape(text))
        elif close:
            up = up["up"]
        else:
            node = {"tag": tag, "down": [], "up": up}
            up["down"].append(node)
            up = node
    below = lambda n: [x for x in n["down"] if isinstance(x, dict)]
    every = lambda n: [n, *(y for x in below(n) for y in every(x))]

    def marked(n):
        while n is not None:
            if n["tag"] in DROPPED or n["tag"] == "a":
                return True
            n = n["up"]
        return False

    def size(n, only_links):
        own = sum(len("".join(x.split())) for x in n["down"] if isinstance(x, str)) if not only_links or marked(n) else 0
        return own + sum(size(x, only_links) for x in below(n))

    def is_tag(n):
        return n["tag"] == "a" or any(x["tag"] in html_extract.BLOCKS for x in every(n))

    def count(n, only_links):
        return sum(1 for x in every(n)[1:] if is_tag(x) and (not only_links or marked(x)))

    body = next(n for n in every(root) if n["tag"] == "body")
    share = size(body, True) / max(1, size(body, False))

    def density(n):
        c, t, lc, lt = size(n, False), max(1, count(n, False)), size(n, True), max(1, count(n, True))
        if not c or not is_tag(n) or any(k["tag"] in DROPPED for k in chain(n)):
            return 0.0
        return c / t * max(0.0, math.log(c * t / (max(1, lc) * lt))) / math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e**math.e))

    def chain(n):
        while n is not None:
            yield n
            n = n["up"]

    best, most = None, -1.0
    for n in every(body):
        if any(k["tag"] in DROPPED for k in chain(n)) or not is_tag(n):
            continue
        total = sum(density(x) for x in below(n))
        if total == 0.0 and size(n, False) > size(n, True):
            total = density(n)
        if total > most:
            best, most = n, total
    path = []
    for n in chain(best):
        path.append(n)
        if n is body:
            break
    least = min(density(n) for n in path)
    while best is not body and any(x is not best and density(x) > 0 and density(x) >= least for x in below(best["up"])):
        best = best["up"]
    lines, held = [], []

    def flush():
        if line := " ".join("".join(held).split()):
            lines.append(line)
        held.clear()

    def walk(n):
        if n["tag"] in DROPPED:
            return
        block = n["tag"] in html_extract.BLOCKS
        if block:
            flush()
        for x in n["down"]:
            held.append(x) if isinstance(x, str) else walk(x)
        if block:
            flush()

    walk(best)
    flush()
    return "\n".join(lines)


def random_page(rnd):
    say = lambda n: " ".join(rnd.choice(["river", "house", "walk &amp; tree", "blue", "of", "the", "caf&eacute;"]) for _ in range(n))
    inline = lambda: rnd.choice([say(rnd.randint(2, 30)), f"<b>{say(3)}</b> {say(8)}", f"<a>{say(2)}</a>", f"{say(9)} <a>{say(1)}</a> {say(4)}"])

    def block(depth):
        if depth == 0 or rnd.random() < 0.4:
            return f"<p>{inline()}</p>"
        kind = rnd.choice(["div", "section", "div", "ul"])
        inner = "".join(block(depth - 1) if kind != "ul" else f"<li>{inline()}</li>" for _ in range(rnd.randint(1, 5)))
        return f"<{kind}>{inner}</{kind}>"

    nav = "<nav><ul>" + "".join(f"<li><a>{say(2)}</a></li>" for _ in range(rnd.randint(1, 8))) + "</ul></nav>"
    return f"<html><head><title>x</title></head><body>{nav}{''.join(block(3) for _ in range(rnd.randint(1, 6)))}<footer>{say(5)}</footer></body></html>"


def test_against_a_slow_reading():
    rnd = random.Random(7)
    for _ in range(150):
        page = random_page(rnd)
        assert html_extract.main_text(page) == slow_text(page)


TEXT = [f"Paragraph {i} has quite a few words to read here." for i in range(4)]
BODY = "<h1>Title of it</h1>" + "".join(f"<p>{x}</p>" for x in TEXT)


@pytest.mark.parametrize("name", ["sidebarLeft", "cookieBanner", "left-sidebar", "adSlot", "shareBar", "newsletterSignup"])
def test_names_in_camel_case_are_asides(name):
    page = f'<body><div class="{name}"><p>Something else that one could take for text, as it is long.</p></div><div class="content">{BODY}</div></body>'
    assert html_extract.main_text(page).splitlines() == ["Title of it", *TEXT]


def test_an_article_element_is_no_proof():
    """A teaser in an article element beside the text, and text that no article element holds."""
    page = f"<body><div class=teasers><article><a href=x>Read this too</a></article></div><div class=content>{BODY}</div></body>"
    assert html_extract.main_text(page).splitlines() == ["Title of it", *TEXT]


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "deep text here" + "</div>" * 20_000,
        "<body>" + "<span>" * 10_000 + "text in spans " + "</b>" * 10_000 + "</body>",
        "<body><b><table><tr><td>" + "<span>" * 10_000 + "cell text" + "</b>" * 10_000,
        "<p>" * 20_000 + "last paragraph",
        "<ul>" + "<li>" * 20_000 + "item",
        "</div>" * 20_000 + "after stray ends",
        "<a>" * 10_000 + "</i>" * 10_000 + "<p>some words</p>",
        '<div class="sidebar">' * 3_000 + "hidden or not" + "</div>" * 3_000,
    ],
)
def test_deep_and_broken_markup_takes_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 3
