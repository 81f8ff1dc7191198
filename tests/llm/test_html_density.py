"""Extraction by density: the line rule by force, and pages whose tags no longer tell."""

import math
import re

import numpy as np
import pytest
from conftest import DATA

from sparkloom.llm import html_text

PARA = "Many words that belong to the article stand here, one after the other. " * 4


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").select("html").collect()]


def renamed(html, tags):
    return re.sub(rf"<(/?)(?:{tags})\b", r"<\1div", html)


def lines_of(html):
    parser = html_text.Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    parser.settle()
    return parser.lines


def densities_by_force(lines):
    """A line at a time, with loops."""
    ratio = [math.sqrt((len(x[0]) - x[2]) / max(1, x[1])) for x in lines]
    out = []
    for i, line in enumerate(lines):
        near = [(j, math.exp(-0.5 * (i - j) ** 2)) for j in range(max(0, i - 3), min(len(lines), i + 4))]
        smooth = sum(w * ratio[j] for j, w in near) / sum(w for _, w in near)
        prose = sum(w * (1 - lines[j][2] / len(lines[j][0])) for j, w in near) / sum(w for _, w in near)
        out.append(prose * max(smooth, element_by_force(lines, line[3])))
    return out


def element_by_force(lines, e):
    best, discount = 0.0, 1.0
    while e is not None:
        mine = [x for x in lines if x[3] is e]
        if mine:
            best = max(best, discount * math.sqrt(sum(len(x[0]) - x[2] for x in mine) / max(1, sum(x[1] for x in mine))))
        discount *= 0.75
        e = e.parent if e.parent is not None and e.parent.tag not in ("html", "body") else None
    return best


def content_by_force(lines):
    """Clusters by trying every split of the sorted densities; then regions, a gap at a time."""
    density = densities_by_force(lines)
    weight = [0.12 if x[3].frame else 1.5 if x[3].inside else 0.5 if x[3].doubtful else 1.0 for x in lines]
    free = [k for k, x in enumerate(lines) if not x[3].frame]
    if not free:
        return [False] * len(lines)
    low, high, cut = min(density), max(density), -1.0
    for _ in range(20):
        below, above = [d for d in density if d <= (low + high) / 2], [d for d in density if d > (low + high) / 2]
        if not below or not above:
            low = high = -1.0
            break
        low, high = sum(below) / len(below), sum(above) / len(above)
    cut = max(0.05, min((low + high) / 2, max(weight[k] * element_by_force(lines, lines[k][3]) for k in free) / 2))
    region = [w * d > cut for w, d in zip(weight, density)]
    dense = [k for k, r in enumerate(region) if r]
    for k, line in enumerate(lines):
        before, after = [d for d in dense if d < k], [d for d in dense if d > k]
        if k not in dense and before and after and not line[3].frame:
            region[k] = line[3].scope is lines[before[-1]][3].scope is lines[after[0]][3].scope
    for k in reversed(range(len(lines) - 1)):
        region[k] = region[k] or bool(lines[k][4] and region[k + 1] and not lines[k][3].frame)
    return region


def test_line_rule_by_force(pages):
    for html in [*pages[:40], *(renamed(p, "article|nav") for p in pages[40:60]), *(plain(p) for p in pages[60:80]), "<p>a<div>b<a href=x>c d</a><ul><li>e<li>f</ul></div>", "<nav>a</nav>"]:
        lines = lines_of(html)
        density = html_text.line_densities(lines, 1.0)
        assert np.allclose(density, densities_by_force(lines))
        assert html_text.content_lines(lines, density).tolist() == content_by_force(lines)


def plain(html):
    """Without any tag, class, id or role that tells of frames or articles."""
    return re.sub(r' (?:class|id|role)="[^"]*"', "", renamed(html, "article|main|nav|header|footer|aside"))


def test_pages_without_markup_keep_their_blocks(pages):
    total = lost = added = 0
    for html in pages:
        want, got = html_text.main_text(html).split("\n\n"), html_text.main_text(plain(html)).split("\n\n")
        total, lost, added = total + len(want), lost + len(set(want) - set(got)), added + len(set(got) - set(want))
    assert lost <= 0.1 * total and added <= 0.1 * total


def test_density_and_clusters_decide_with_all_markup(pages, monkeypatch):
    """The pages as they are: with one density for all lines, or without clusters, every page's text is another."""
    given = [html_text.main_text(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(html_text, "line_densities", lambda lines, sigma: np.ones(len(lines)))
        assert all(a != html_text.main_text(p) for a, p in zip(given, pages))
    monkeypatch.setattr(html_text, "two_means", lambda x: -1.0)
    assert all(a != html_text.main_text(p) for a, p in zip(given, pages))


@pytest.mark.parametrize("name", ["share-price", "banner-history", "menu-of-the-day", "promo-code-study", "alert-fatigue", "related-work", "social-history", "notice-period", "signup-figures", "header-bidding"])
def test_prose_with_a_telling_word_in_its_name_stays(name):
    for page in (f"<article><p>{PARA}</p><div class='{name}'><p>part {PARA}</p></div><p>{PARA}</p></article>", f"<div><p>{PARA}</p></div><div class='{name}'><p>part {PARA}</p></div>"):
        assert f"part {PARA.strip()}" in html_text.main_text(f"<body><nav><a href='x'>menu</a></nav>{page}<footer>foot</footer></body>").split("\n\n")


@pytest.mark.parametrize("name", ["site-footer", "navBar", "cookie-notice", "ad-container", "sidebar-left", "related-posts", "share buttons", "banner2", "top-menu"])
def test_frames_by_name_go(name):
    assert html_text.main_text(f"<body><div><p>{PARA}</p></div><div class='{name}'><p>part {PARA}</p></div></body>") == PARA.strip()


def test_pages_without_article_tags_keep_their_blocks(pages):
    total = lost = added = 0
    for html in pages:
        want, got = html_text.main_text(html).split("\n\n"), html_text.main_text(renamed(html, "article|main")).split("\n\n")
        total, lost, added = total + len(want), lost + len(set(want) - set(got)), added + len(set(got) - set(want))
    assert lost <= 0.1 * total and added <= 0.1 * total


def test_density_decides(pages, monkeypatch):
    """Menus in plain elements go by their density alone: without it they are extracted."""
    plain = [renamed(p, "article|nav") for p in pages[:50]]
    menus = [re.findall(r"<li><a [^>]*>([^<]+)</a>", p) for p in plain]
    with_density = [html_text.main_text(p) for p in plain]
    assert not any(m in t.split("\n\n") for t, words in zip(with_density, menus) for m in words)
    monkeypatch.setattr(html_text, "smoothed", lambda x, sigma: np.ones(len(x)))
    monkeypatch.setattr(html_text.np, "sqrt", lambda x: np.ones_like(np.asarray(x, float)))
    without = [html_text.main_text(p) for p in plain]
    assert all(a != b for a, b in zip(with_density, without))


def test_parts_of_an_article_stay():
    body = f"<h1>Title</h1><p>{PARA}</p><p><a href='y'>a paragraph that is one link</a></p><section id='legal'><p>legal</p></section><div class='side-by-side'><p>two</p></div><div class='tags-article'><p>three</p></div><p>{PARA}</p><ul><li>a<li>b</ul>"
    want = ["Title", PARA.strip(), "a paragraph that is one link", "legal", "two", "three", PARA.strip(), "a", "b"]
    assert html_text.main_text(f"<body><nav><a href='x'>menu</a></nav><article>{body}</article><footer>foot</footer>").split("\n\n") == want
    assert html_text.main_text(f"<body><div class='menu-open'><article>{body}</article></div>").split("\n\n") == want


def test_comments_and_frames_are_left_out():
    reply = f"<article class='comment'><p>{PARA}{PARA}</p></article>"
    page = f"<div class='cookie-notice'>{PARA}</div><div class='post'><h2>Head</h2><p>{PARA}</p><aside>{PARA}</aside><p>end</p></div><section class='comments'>{reply}{reply}</section><form>{PARA}</form><div class='footer'>{PARA}</div>"
    assert html_text.main_text(page) == f"Head\n\n{PARA.strip()}\n\nend"
    assert html_text.main_text(f"<nav><a href='x'>x</a></nav><footer>{PARA}</footer>") == ""
