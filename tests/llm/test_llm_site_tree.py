import math
import random
import time
from collections import Counter, defaultdict

import pytest

from shelfline.llm import site_style

SHORT = "A short article of a few words."
COMMENTS = "".join(f"<article class=comment><p>{'what somebody else said ' * 4}{i}</p></article>" for i in range(8))

PAGES = [
    (f"<article><p>{SHORT}</p></article><section class=comments>{COMMENTS}</section>", SHORT),
    (f"<article><p>{SHORT}</p><section class=comments>{COMMENTS}</section></article>", SHORT),
    (f"<div class=x><p>{SHORT}</p></div><ol class='comment-list'>{COMMENTS}</ol>", SHORT),
    (f"<div class=x><p>{SHORT}</p></div><div id=disqus>{COMMENTS}</div>", SHORT),
    (f"<article><p>{SHORT}</p></article><aside>{'more to read ' * 80}</aside>", SHORT),
    (f"<div><p>{SHORT}</p></div><footer>{'all rights reserved ' * 80}</footer>", SHORT),
    (f"<form>{'search ' * 90}</form><p>{SHORT}</p><div class=ad>{'buy ' * 90}</div>", SHORT),
    (f"<div class=widget><article><p>{SHORT}</p><nav>next</nav></article><p>by the way</p></div><p>tail</p>", SHORT),
    (f"<section class=comments>{COMMENTS}</section>", ""),
    (f"<head><title>T</title><body><p>{SHORT}", SHORT),
    (f"<head><meta charset=x><p>{SHORT}</p>", SHORT),
    (f"<html><head><link rel=x><script>1</script>{SHORT}", SHORT),
    (f"<button>menu<p>{SHORT}</p>", f"menu\n{SHORT}"),
    (f"<button>menu<div>icon</div></button><p>{SHORT}</p>", SHORT),
    (f"<div><button>open</div><p>{SHORT}</p>", f"open\n{SHORT}"),
    ("<nav>a</nav><footer>b</footer>", "a\nb"),
    ("<script>x</script><style>y</style>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_declared_branches_go_whatever_their_length(page, text):
    assert site_style.main_text(page) == text


@pytest.mark.parametrize("tag", ["div", "span", "li", "td", "p", "button", "article class=nav", "a href=x"])
def test_pages_of_many_open_elements_take_linear_time(tag):
    times = []
    for n in (5_000, 50_000):
        start = time.perf_counter()
        assert site_style.main_text(f"<{tag}>t" * n)
        times.append(time.perf_counter() - start)
    assert times[1] < 40 * times[0]
    assert times[1] < 8


def pages_of(host, seed, n):
    """Random pages as nested (style, children or text)."""
    rng = random.Random(seed)

    def branch(depth):
        style = f"{rng.choice(['div', 'ul', 'section'])} c{rng.randrange(3)}"
        if depth == 3 or rng.random() < 0.3:
            return style, f"text {rng.randrange(4)}"
        return style, [branch(depth + 1) for _ in range(rng.randrange(1, 4))]

    menu = branch(1)
    return [(f"http://{host}/{i}", [menu, *[branch(1) for _ in range(rng.randrange(3))]]) for i in range(n)]


def rendered(branches):
    out = ""
    for style, inner in branches:
        tag, name = style.split()
        out += f"<{tag} class={name}>{inner if isinstance(inner, str) else rendered(inner)}</{tag}>"
    return out


def brute_importance(pages):
    """(host, pages, importance) of every node, from plain lists of texts and styles."""
    variants = defaultdict(set)
    for url, branches in pages:
        seen = defaultdict(lambda: ([], []))

        def visit(path, branch, seen=seen):
            style, inner = branch
            path = (*path, style)
            children, texts = seen[path]
            if isinstance(inner, str):
                texts.append(inner)
                return [inner]
            found = []
            for child in inner:
                if not children or children[-1] != child[0]:
                    children.append(child[0])
                found += visit(path, child)
            texts += found
            return found

        for branch in branches:
            visit((), branch)
        html = rendered(branches)
        for path, (children, texts) in seen.items():
            variants[url.split("/")[2], path].add((html, tuple(children), tuple(texts)))
    out = []
    for (host, _), found in variants.items():
        m = len(found)
        entropies = []
        for which in (1, 2):
            shares = [n / m for n in Counter(v[which] for v in found).values()]
            entropies.append(-sum(p * math.log(p, m) for p in shares) if m > 1 else 1.0)
        out.append((host, m, round(max(entropies), 9) + 0.0))
    return sorted(out)


def test_the_tree_equals_a_brute_force_one(llm):
    pages = pages_of("a.example", 1, 30) + pages_of("b.example", 2, 7) + pages_of("c.example", 3, 1)
    pages += pages[:3]  # the same pages once more
    rows = [(url, rendered(branches)) for url, branches in pages]
    frame = llm.createDataFrame(rows, "url string, html string").repartition(3)
    found = site_style.node_importance(frame).collect()
    assert sorted((r["host"], r["pages"], round(r["importance"], 9) + 0.0) for r in found) == brute_importance(pages)


def test_comments_go_on_every_page_of_a_host(llm):
    def page(i):
        said = "".join(f"<p>{'reader words ' * 8}{i} {j}</p>" for j in range(8))
        return f"<body><article><h1>Title {i}</h1><p>story {i}</p></article><section class=comments>{said}</section>"

    frame = llm.createDataFrame([(f"http://a.example/{i}", page(i)) for i in range(12)], "url string, html string")
    found = site_style.extract_main_text(frame, ["url"]).collect()
    assert sorted(r["text"] for r in found) == sorted(f"Title {i}\nstory {i}" for i in range(12))
