import math
import re
import statistics

import duckdb
import pytest

from wadi.llm import tag_paths as T

P = "This is a sentence of the text, with commas, and a full stop. And here comes another one, somewhat longer."


def plain_selected(found):
    """Ratios, smoothing and threshold with lists and loops."""
    own = {}
    for text, node, linked in found:
        own.setdefault(node.path, []).append((len(text), len([c for c, after in zip(text, text[1:] + " ", strict=True) if c in "。，、；：！？…" or c in ".,;:!?" and after.isspace()]), linked))
    ratio = {}
    for path, rows in own.items():
        n = sum(r[0] for r in rows)
        ratio[path] = (n / len(rows), sum(r[1] for r in rows) / len(rows), sum(r[2] for r in rows) / n)
    weights = [math.exp(-0.5 * k * k) for k in (-2, -1, 0, 1, 2)]
    fuse = lambda a, b, c: a * (1 + b) * (1 - c)
    values = {}
    for i in range(len(found)):
        smooth = [0.0, 0.0, 0.0]
        for k, w in zip((-2, -1, 0, 1, 2), weights, strict=True):
            j = min(max(i + k, 0), len(found) - 1)
            for x in range(3):
                smooth[x] += w / sum(weights) * ratio[found[j][1].path][x]
        values.setdefault(found[i][1].path, []).append(fuse(*smooth))
    cut = statistics.pstdev([fuse(*r) for r in ratio.values()]) if len(ratio) > 1 else 0
    return [sum(values[n.path]) / len(values[n.path]) > 0.5 * cut and fuse(*ratio[n.path]) > cut for _, n, _ in found]


@pytest.fixture(scope="module")
def pages():
    rows = duckdb.connect().execute("SELECT html FROM read_parquet('/root/testdata/sf0.01/pages.parquet') WHERE html IS NOT NULL ORDER BY page_id").fetchall()
    return [r[0] for r in rows]


def bare(page):
    """The page without article and main tags and without classes."""
    return re.sub(r'\sclass="[^"]*"', "", re.sub(r"</?(article|main)\b[^>]*>", "", page))


def nameless(page):
    """The same, with menus and footers as plain div elements."""
    page = bare(page)
    return re.sub(r"(</?)(nav|header|footer|aside)\b", r"\1div", page)


def test_ratios_against_plain_loops(pages):
    for page in pages + [bare(p) for p in pages]:
        found = [b for b in T.blocks(page) if not b[1].dropped]
        assert T.selected(found) == plain_selected(found)


def test_paths_find_the_text_without_names(pages):
    """Without article and main tags and classes the text is the same for at least 95 % of the pages, with no name at all for 80 %."""
    assert sum(T.main_text(p) == T.main_text(bare(p)) for p in pages) >= 0.95 * len(pages)
    assert sum(T.main_text(p) == T.main_text(nameless(p)) for p in pages) >= 0.8 * len(pages)


def test_paths_decide_the_result(pages, monkeypatch):
    monkeypatch.setattr(T, "selected", lambda found: [True] * len(found))
    names = [T.main_text(nameless(p)) for p in pages]
    monkeypatch.undo()
    assert sum(a != T.main_text(nameless(p)) for a, p in zip(names, pages, strict=True)) > len(pages) / 2


def test_menus_and_credits_without_a_name():
    text = f"<div><h1>Title</h1><p>{P}</p><p>{P} {P}</p><ul><li>one</li><li>two</li></ul><p>{P}</p></div>"
    want = f"Title\n\n{P}\n\n{P} {P}\n\none\n\ntwo\n\n{P}"
    for menu in ("<div><a>Home</a> <a>About</a> <a>Contact</a></div>", "<ul><li><a>Home</a></li><li><a>About</a></li></ul>", "<div><div><a>Home</a></div><div><a>About</a></div></div>"):
        assert T.main_text(f"<body>{menu}{text}<div>(c) 2020 Corp</div></body>") == want
        assert T.main_text(f"<body><div>{menu}</div>{text}<div><div>(c) 2020 Corp</div></div></body>") == want


def test_within_an_article():
    around = f"<main><article><h1>T</h1><p>{P}</p>%s<p>{P} end</p>%s</article>%s</main>"
    plain = ["T", P, f"{P} end"]

    def text(*parts):
        return T.main_text(around % parts).split("\n\n")

    assert text("", "<ul><li><a>One more story</a></li><li><a>Other news here</a></li></ul>", "") == plain
    assert text('<div class="adBox">Buy our shoes, now.</div>', "", "") == plain
    assert text("", "", f"<div><div><p>{P} I think so.</p></div><div><p>{P} Me too, thanks.</p></div></div>") == plain
    assert text(f'<section class="sales-promotion-chapter"><h2>Two</h2><p>{P} part</p></section>', "", "") == [*plain[:2], "Two", f"{P} part", plain[2]]
    assert text(f'<p class="notice">{P} told</p>', "", "") == [*plain[:2], f"{P} told", plain[2]]
    assert text('<div class="notice">We use cookies, ok.</div>', "", "") == plain
    assert text('<p>See <a href="x">this</a>, please.</p>', "<p>By a writer</p>", "") == [*plain[:2], "See this, please.", plain[2], "By a writer"]


def test_odd_pages():
    assert T.main_text(f"<p>{P}</p>") == P and T.main_text("only words") == "only words"
    assert T.main_text("<a>Home</a><a>About</a>") != "" and T.main_text("<p></p>") == ""
    assert T.main_text("<div>" * 3000 + P + "</div>" * 3000) == P
    long = f"<div><p>{P}</p></div>" * 5000
    assert len(T.main_text(long)) == 5000 * (len(P) + 2) - 2
