"""HTML extraction by tag-path ratios.

Every text node lies on a path of tags from the root. Text length and
punctuation are summed up for each path; a path of the main text holds much of
both in few nodes, one of a menu little in many. The roots of the two ratios,
laid along the page, are smoothed, fused by multiplication, and cut at a share of their spread.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import make_room
from lodeworks.llm.textbytes import frugal

SMOOTH = (0.2, 0.6, 0.2)
SPREAD = 0.5
_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)(\s*/?>)?", re.I)
#: What may end a tag: a quote that opens an attribute's value, or the bracket.
_EDGE = re.compile(r"""=\s*(["'])|>""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea svg iframe title".split()}
_HEAD = frozenset("html head base link meta style script noscript template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tr select".split())
_SPACES = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？]")


def _tag_end(html: str, at: int) -> int:
    """Where the tag that is open at `at` ends, values in quotes passed over; -1: nowhere."""
    while m := _EDGE.search(html, at):
        if m.end() - m.start() == 1 and html[m.start()] == ">":
            return m.end()
        at = html.find(m.group(1), m.end()) + 1
        if not at:
            return -1
    return -1


def _marks(html: str):
    """(start, end, slash, name) of the page's tags and of what is skipped with them;
    name is empty for comments, declarations and elements that hold no text.

    The page is read once from left to right: whatever is looked at is passed.
    Where a tag never ends because a quote doesn't, tags from there on end at
    their first bracket; behind the last bracket there are no tags.
    """
    last, plain, at = html.rfind(">"), False, 0
    while 0 <= (at := html.find("<", at)):
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4) + 3
            if end < 3:
                end = len(html)
            yield at, end, "", ""
            at = end
            continue
        if at > last:
            return
        m = _TAG.match(html, at)
        if not m:
            if html[at + 1] in "!?/":
                end = html.find(">", at) + 1
                yield at, end, "", ""
                at = end
            else:
                at += 1
            continue
        name = m.group(2).lower()
        end = m.end() if m.group(3) else -1 if plain else _tag_end(html, m.end())
        if end < 0:
            plain, end = True, html.find(">", at) + 1
        if not m.group(1) and name in _RAW and not (name == "svg" and html[end - 2] == "/"):
            close = _RAW[name].search(html, end)
            end = close.end() if close else len(html)
            yield at, end, "", "" if name in _HEAD else "-"
        else:
            yield at, end, m.group(1), name
        at = end


def text_nodes(html: str) -> tuple[list[str], list[int], list[int]]:
    """The page's visible text nodes in order: text, number of the tag path, number of the block."""
    texts: list[str] = []
    paths: list[int] = []
    blocks: list[int] = []
    known: dict[tuple[int, str], int] = {}
    tags, ids = [""], [0]
    open_: dict[str, list[int]] = {}  # places of a tag's open elements in tags
    block, head, at = 0, False, 0

    def add(raw: str) -> None:
        if raw and not head and not raw.isspace():
            text = _SPACES.sub(" ", unescape(raw))
            if not text.isspace():
                texts.append(text)
                paths.append(ids[-1])
                blocks.append(block)

    def pop(tag: str) -> None:
        """Close the innermost element of this name, and all within it."""
        to = open_[tag][-1]
        while len(tags) > to:
            open_[tags.pop()].pop()
        del ids[to:]

    def inner(tag: str) -> int:
        at = open_.get(tag)
        return at[-1] if at else 0

    for start, end, slash, tag in _marks(html):
        if start > at:
            add(html[at:start])
        at = end
        if not tag or tag == "-":
            if tag:
                head = False
            continue
        if slash:
            if tag not in _INLINE:
                block += 1
            if tag == "head":
                head = False
            if open_.get(tag):
                pop(tag)
            continue
        if tag not in _HEAD:
            head = False
        if tag not in _INLINE:
            block += 1
            if open_.get("p"):
                pop("p")
            for other in _CLOSES.get(tag, ()):
                if open_.get(other) and inner(other) > max(inner(s) for s in _SCOPE if s != other):
                    pop(other)
        elif tag == "br":
            block += 1
        if tag in _VOID or html[end - 2] == "/":
            continue
        if tag == "head":
            head = True
        open_.setdefault(tag, []).append(len(tags))
        tags.append(tag)
        ids.append(known.setdefault((ids[-1], tag), len(known) + 1))
    add(html[at:])
    return texts, paths, blocks


def path_scores(texts: list[str], paths: list[int], smooth: tuple[float, ...] = SMOOTH) -> np.ndarray:
    """The fused score of each text node: that of its path, over all the places it has on the page."""
    _, path = np.unique(np.array(paths), return_inverse=True)
    count = np.bincount(path)
    size = np.sqrt(np.bincount(path, weights=[len(t) for t in texts]) / count)
    mark = np.sqrt(np.bincount(path, weights=[len(_MARKS.findall(t)) for t in texts]) / count)
    kernel = np.array(smooth)
    side = len(kernel) // 2
    weight = np.convolve(np.ones(len(texts) + 2 * side)[side : side + len(texts)], kernel, "full")[side : side + len(texts)]
    along = lambda x: np.convolve(x[path], kernel, "full")[side : side + len(texts)] / weight
    return (np.bincount(path, weights=along(size) * along(mark)) / count)[path]


def main_text(html: str, smooth: tuple[float, ...] = SMOOTH, spread: float = SPREAD) -> tuple[str, int, int]:
    """The content of a page, how many text nodes it took, and how many there are."""
    texts, paths, blocks = text_nodes(html)
    if not texts:
        return "", 0, 0
    score = path_scores(texts, paths, smooth)
    keep = np.flatnonzero(score >= spread * score.std())
    parts: list[list[str]] = []
    last = None
    for i in keep.tolist():
        if blocks[i] != last:
            parts.append([])
        parts[-1].append(texts[i])
        last = blocks[i]
    whole = ("".join(p).strip() for p in parts)
    return "\n".join(p for p in whole if p), len(keep), len(texts)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", smooth: tuple[float, ...] = SMOOTH, spread: float = SPREAD) -> DataFrame:
    """key, text, kept_nodes, all_nodes for every row of pages.

    smooth: the kernel along the page; spread: the least score, in standard
    deviations of the page's scores. Nulls: a null page has a null text and 0
    nodes; an empty page, and one without visible text, an empty text; a null
    key stays null. If all nodes score alike (ties, a single node) all are kept.
    Repeated rows are answered each; whole pages count, however long or badly
    nested, in one pass from left to right; an empty table gives no rows. Other
    columns are ignored; a key column named like an output gets `_in` behind it.
    """
    rows = pages.select(F.col(f"`{key}`"), F.col(f"`{html}`").cast("string").alias("_html"))
    rows = make_room(rows, ["text", "kept_nodes", "all_nodes"])
    field = rows.schema.fields[0]

    def work(batches):
        for batch in batches:
            out = [(None, 0, 0) if (h := v.as_py()) is None else main_text(h, smooth, spread) for v in batch.column("_html")]
            text, kept, total = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(kept, pa.int32()), pa.array(total, pa.int32())], [field.name, "text", "kept_nodes", "all_nodes"])

    return rows.mapInArrow(frugal(work), f"`{field.name}` {field.dataType.simpleString()}, text string, kept_nodes int, all_nodes int")
