"""HTML extraction by tag-path ratios.

A page is read once, left to right, into its text nodes, each with the path of open elements from the root. Per path,
text length and punctuation are summed and divided by the path's number of nodes. Both ratios are smoothed over the
paths in their order on the page, fused as their geometric mean, and paths at or above a share of the page's
text-weighted mean are content; their nodes, in order, are the text. Words in links weigh nothing, and words in links or
other inline elements go where the block does that they stand in. One scan in Arrow batches, without a shuffle.

Defined results:

* comments, declarations, scripts, styles and other raw or hidden elements hold no text; entities are decoded;
* void elements open nothing; an opening block closes an open paragraph with all that is open in it, list items, cells
  and options close their like; an end tag without its start is ignored; an unclosed element ends with its parent;
* a link is content where the text around it is, so that lists of links never are; what HTML itself sets apart from a
  page's content, ``nav``, ``aside``, ``footer`` and ``button``, weighs nothing and never is it; forms and headers are as their
  ratios say;
* of two paths with equal ratios both are content or neither is;
* a page of which no path has any weight gives an empty text; null and empty pages give an empty text and 0 nodes;
* very long pages are read whole; repeated rows each give a row; an empty table gives an empty result;
* extra columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

SHARE = 0.3  #: a path is content from this share of the text-weighted mean on

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | </([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z) | <([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | [^<]++ | <""",
    re.S | re.X,
)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；！？]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe object svg math textarea select title".split())
_SIDE = frozenset("nav footer aside button".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select".split())


class Paths:
    """A trie of tag paths; a path is the number of its node, so that deep pages cost no more than flat ones."""

    def __init__(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.parent, self.tag, self.side = [0], [""], [False]
        self.linked, self.block = [False], [0]  #: whether it is in a link; the block that an inline element stands in

    def down(self, path: int, tag: str) -> int:
        k = self.child.get((path, tag))
        if k is None:
            k = self.child[path, tag] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
            self.side.append(self.side[path] or tag in _SIDE)
            self.linked.append(self.linked[path] or tag == "a")
            self.block.append(self.block[path] if tag in _INLINE else k)
        return k

    def name(self, path: int) -> str:
        out = []
        while path:
            out.append(self.tag[path])
            path = self.parent[path]
        return "/".join(reversed(out))


def nodes(page: str) -> tuple[Paths, list[tuple[int, str]]]:
    """Path and decoded text of each text node that isn't blank, in document order."""
    paths, out = Paths(), []
    open_: list[int] = []  # the path at each depth; its tag is the innermost element
    counts: Counter[str] = Counter()
    tags = paths.tag

    def close_to(depth: int) -> None:
        while len(open_) > depth:
            counts[tags[open_.pop()]] -= 1

    at, end = 0, len(page)
    match = _TOKEN.match
    while at < end:
        m = match(page, at)
        at = m.end()
        tag = m[2]
        if tag:
            tag = tag.lower()
            if tag in _VOID or m[3].endswith("/"):
                continue
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?![^\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            if tag in _CLOSES_P and counts["p"]:
                k = len(open_) - 1
                while tags[open_[k]] != "p":
                    k -= 1
                close_to(k)
            elif tag in _CLOSES_LIKE and any(counts[x] for x in _CLOSES_LIKE[tag]):
                for k in range(len(open_) - 1, -1, -1):
                    if tags[open_[k]] in _CLOSES_LIKE[tag]:
                        close_to(k)
                        break
                    if tags[open_[k]] in _SCOPE:
                        break
            open_.append(paths.down(open_[-1] if open_ else 0, tag))
            counts[tag] += 1
        elif m[1]:
            tag = m[1].lower()
            if counts[tag]:
                k = len(open_) - 1
                while tags[open_[k]] != tag:
                    k -= 1
                close_to(k)
        elif page[m.start()] != "<" or at - m.start() == 1:
            text = _SPACE.sub(" ", html.unescape(m[0])).strip()
            if text:
                out.append((open_[-1] if open_ else 0, text))
    return paths, out


def _smooth(values: list[float]) -> list[float]:
    """Each value with half the weight, its neighbours with a quarter; the ends count for their missing neighbours."""
    padded = [values[0], *values, values[-1]]
    return [0.25 * a + 0.5 * b + 0.25 * c for a, b, c in zip(padded, padded[1:], padded[2:])]


def content_paths(paths_of: Paths, found: list[tuple[int, str]], share: float = SHARE) -> set[int]:
    """The paths whose nodes are content."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
    for path, text in found:
        if not paths_of.side[path] and not paths_of.linked[path]:
            s = sums[path]
            s[0] += len(text)
            s[1] += len(_PUNCTUATION.findall(text))
            s[2] += 1
    paths = list(sums)
    if not paths:
        return set()
    lengths = _smooth([sums[p][0] / sums[p][2] for p in paths])
    marks = _smooth([(sums[p][1] + 0.5) / sums[p][2] for p in paths])
    fused = [(a * b) ** 0.5 for a, b in zip(lengths, marks, strict=True)]
    total = sum(sums[p][0] for p in paths)
    mean = sum(f * sums[p][0] for f, p in zip(fused, paths, strict=True)) / total
    good = {p for f, p in zip(fused, paths, strict=True) if f >= share * mean}
    return good | {p for p, _ in found if paths_of.block[p] in good and not paths_of.side[p]}


def extract(page: str | None, share: float = SHARE) -> tuple[str, int, int]:
    """The content, its number of nodes, and the number of nodes of the page."""
    paths, found = nodes(page or "")
    chosen = content_paths(paths, found, share)
    kept = [t for p, t in found if p in chosen]
    return "\n".join(kept), len(kept), len(found)


def extract_pages(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``page_id``, ``text``, ``n_kept`` and ``n_nodes``: one row for each input row."""

    def run(batches):
        for b in batches:
            got = [extract(x, share) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["page_id", "text", "n_kept", "n_nodes"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_kept int, n_nodes int")
