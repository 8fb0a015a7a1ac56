from collections import Counter

import pytest

from sediment.llm import html_extract as H
from sediment.llm.tables import table


def named(page):
    paths, found = H.nodes(page)
    return [(paths.name(p), t) for p, t in found]


def test_paths_of_broken_markup():
    page = "<!DOCTYPE html><html><body><!-- <p>no</p> --><script>var t='</p>';</script><p a='x>y'>one <b>two<br><p>three &amp; four</i></p><ul><li>a<li>b<ul><li>c</ul></ul>1 < 2<img src=x/>end"
    assert named(page) == [
        ("html/body/p", "one"),
        ("html/body/p/b", "two"),
        ("html/body/p", "three & four"),
        ("html/body/ul/li", "a"),
        ("html/body/ul/li", "b"),
        ("html/body/ul/li/ul/li", "c"),
        ("html/body", "1"),
        ("html/body", "<"),
        ("html/body", "2"),
        ("html/body", "end"),
    ]


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!--", "<p a='", "</", "</p", "<script>", "<a href=\"x\">y</a>", "<div>" * 30_000 + "x", "<p>" * 1000 + "</b>" * 1000, "\x00<b>&#0;&bogus;"])
def test_odd_pages(page):
    text, kept, n = H.extract(page)
    assert kept <= n and (kept > 0 or text == "")


def block(path):
    tags = path.split("/")
    while tags and tags[-1] in H._INLINE:
        tags.pop()
    return "/".join(tags)


def brute_content(page):
    """Ratios, smoothing, fusion and threshold, written out over path names."""
    found = named(page)
    out = lambda p: bool(set(p.split("/")) & {"nav", "aside", "footer", "button"})
    order = [p for p in dict.fromkeys(p for p, _ in found) if not out(p) and "a" not in p.split("/")]
    if not order:
        return []
    of = {p: [t for q, t in found if q == p] for p in order}
    length = [sum(map(len, of[p])) / len(of[p]) for p in order]
    marks = [(sum(c in ".,;:!?…。，；！？" for t in of[p] for c in t) + 0.5) / len(of[p]) for p in order]
    fused = []
    for k in range(len(order)):
        near = [max(k - 1, 0), k, k, min(k + 1, len(order) - 1)]
        fused.append((sum(length[j] for j in near) / 4 * sum(marks[j] for j in near) / 4) ** 0.5)
    size = [sum(map(len, of[p])) for p in order]
    mean = sum(f * s for f, s in zip(fused, size)) / sum(size)
    good = {p for p, f in zip(order, fused) if f >= H.SHARE * mean - 1e-12}
    return [t for p, t in found if p in good or block(p) in good and not out(p)]


LONG = "A long sentence of running text, with commas, and a full stop at its end. " * 5


def text_of(page):
    return H.extract(page)[0].split("\n")


def test_words_in_links_and_emphasis_go_with_their_sentence():
    page = f"<body><ul><li><a href=x>Home</a><li><a href=y>News and more news, every day.</a></ul><p>{LONG}<p>See <a href=z>the <b>linked</b> words</a> and <em>stress</em> here.{LONG}</body>"
    assert text_of(page) == [LONG.strip(), "See", "the", "linked", "words", "and", "stress", "here." + LONG.strip()]


def test_a_page_in_one_form_and_a_title_in_a_header():
    inner = f"<article><header><h1>The title of it, in a few words</h1></header><p>{LONG}</p><p>{LONG}</p></article><input type=text><button>Go</button>"
    for page in (f"<body><form action=x><div>{inner}</div></form></body>", f"<body>{inner}</body>"):
        assert text_of(page) == ["The title of it, in a few words", LONG.strip(), LONG.strip()]
    assert text_of(f"<body><nav><p>{LONG}</p></nav><p>{LONG}</p><footer><p>{LONG}</p></footer></body>") == [LONG.strip()]


def test_pages_equal_brute_force_and_find_articles(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r for r in H.extract_pages(pages).collect()}
    scores = []
    for r in pages.collect():
        assert got[r.page_id].text == "\n".join(brute_content(r.html))
        gold = Counter(" ".join(t for p, t in named(r.html) if "article" in p).split())
        mine = Counter(got[r.page_id].text.split())
        scores.append(2 * sum((gold & mine).values()) / (sum(gold.values()) + sum(mine.values())))
    assert len(got) == pages.count() and sum(scores) / len(scores) > 0.96


def test_rows(spark):
    d = spark.createDataFrame([(1, "<p>Some text, here.</p>", "t"), (1, "<p>Some text, here.</p>", "t"), (None, None, None), (2, "", "t")], "page_id long, html string, text string")
    got = sorted(map(tuple, H.extract_pages(d).collect()), key=str)
    assert got == sorted([(1, "Some text, here.", 1, 1)] * 2 + [(None, "", 0, 0), (2, "", 0, 0)], key=str)
    assert H.extract_pages(d.limit(0)).count() == 0
