"""HTML pages to rows: reviews of a listing, histograms, search hits and plain text.

Python's own parser runs in Arrow batches, a slice at a time, so that no worker holds more parsed pages than those of a slice; everything after it is columns again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tierloom import config

# fixed values: the class and attribute names below are those of the pages that are read
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator:
        todo = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, _Node):
                yield node
                todo.extend(reversed(node.children))

    def texts(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in ("script", "style"):
                todo.extend(reversed(node.children))

    def text(self) -> str:
        return " ".join(x for x in (t.strip() for t in self.texts()) if x)

    def has(self, *names: str) -> bool:
        return bool(set(names) & set((self.attrs.get("class") or "").split()))

    def find(self, test) -> _Node | None:
        return next((n for n in self.walk() if test(n)), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str | None) -> _Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def stars(text: str, half_prefix: bool = False) -> float | None:
    """Stars and a half; with ``half_prefix`` the level name "half-★" is a half."""
    if half_prefix and text.strip().startswith("half-"):
        return 0.5
    n, half = text.count("★"), "½" in text
    return n + 0.5 * half if n or half and not half_prefix else None


def review_rows(html: str | None) -> list[dict]:
    root, out = tree(html), []
    items = [n for n in root.walk() if n.tag == "article" and n.has("production-viewing")] or [n for n in root.walk() if n.tag == "li" and n.has("film-detail")]
    for pos, item in enumerate(items):
        mark = item.find(lambda n: n.tag == "span" and n.has("inline-rating")) or item.find(lambda n: n.tag == "span" and n.has("rating"))
        rating = stars(mark.text()) if mark else None
        if mark and rating is None:
            named = re.search(r"(?:^|\s)rated-(\d+)(?:\s|$)", mark.attrs.get("class") or "")
            rating = int(named[1]) / 2 if named else None
        body = item.find(lambda n: n.has("body-text")) or item.find(lambda n: n.has("js-review-body"))
        text = body.text() if body else ""
        linked = item.find(lambda n: "data-full-text-url" in n.attrs)
        url = linked.attrs["data-full-text-url"] if linked else None
        holder = item.find(lambda n: "data-likeable-identifier" in n.attrs)
        try:
            uid = json.loads(holder.attrs["data-likeable-identifier"])["uid"] if holder else None
        except (ValueError, KeyError, TypeError):
            uid = None
        named = re.search(r"viewing:(\d+)", url or "")
        collapsed = item.find(lambda n: n.has("collapsed-text")) is not None
        out.append(
            {
                "pos": pos, "review_id": uid or (named and named[0]) or None, "rating": rating, "text": text, "spoiler": config.SPOILER_PLACEHOLDER in text,
                "truncated": collapsed or text.rstrip().endswith(("…", "...")), "full_text_url": url, "lang": body.attrs.get("lang") if body else None,
            }
        )
    return out


def histogram_rows(html: str | None) -> list[dict]:
    """The ten levels with their counts, or none where the page has not just those."""
    found: dict[float, int] = {}
    for chart in (n for n in tree(html).walk() if n.tag == "table" and n.has("chart")):
        for row in (n for n in chart.walk() if n.tag == "tr"):
            head, bar = row.find(lambda n: n.tag == "th"), row.find(lambda n: n.has("barcolumn"))
            level = stars(head.text(), half_prefix=True) if head and bar else None
            if level is not None:
                count = re.match(r"\s*([\d,]+)", bar.attrs.get("title") or "")
                found.setdefault(level, int(count[1].replace(",", "")) if count else 0)
    return [{"level": k, "n": v} for k, v in sorted(found.items())] if set(found) == set(config.LEVELS) else []


def search_hits(html: str | None) -> list[dict]:
    """Films of a search page in order: slug, name, and the year of its metadata or, in brackets, of its name."""
    out = []
    for node in tree(html).walk():
        slug = node.attrs.get("data-film-slug") or node.attrs.get("data-item-slug")
        if not slug:
            continue
        name = node.attrs.get("data-film-name") or node.attrs.get("data-item-name") or node.text()
        told = node.attrs.get("data-film-release-year") or ""
        named = re.search(r"\((\d{4})\)", name)
        out.append({"rank": len(out), "slug": slug, "name": name, "year": int(told) if told.isdigit() else int(named[1]) if named else None})
    return out


#: Pages of a batch that are parsed at a time; batches have up to 10,000.
SLICE_ROWS = 64


def _slices(batch: pa.RecordBatch | pa.Array) -> Iterator:
    return (batch.slice(k, SLICE_ROWS) for k in range(0, len(batch), SLICE_ROWS))


def _rows(pages: DataFrame, parse, schema: str) -> DataFrame:
    keys = [f for f in pages.schema.fields if f.name != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in _slices(batch)):
            told = pa.array([json.dumps(parse(x)) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([told, *(part.column(f.name) for f in keys)], names=["json", *(f.name for f in keys)])

    held = ", ".join(["json string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)])
    parsed = pages.mapInArrow(run, held)
    return parsed.select(*(f.name for f in keys), F.explode(F.from_json("json", f"array<struct<{schema}>>")).alias("r")).select(*(f.name for f in keys), "r.*")


def read_reviews(pages: DataFrame) -> DataFrame:
    """Pages with ``html`` and key columns to a row per review."""
    return _rows(pages, review_rows, "pos int, review_id string, rating double, text string, spoiler boolean, truncated boolean, full_text_url string, lang string")


def read_histograms(pages: DataFrame) -> DataFrame:
    return _rows(pages, histogram_rows, "level double, n bigint")


def read_search(pages: DataFrame) -> DataFrame:
    return _rows(pages, search_hits, "rank int, slug string, name string, year int")


#: An ampersand and, if there is one, the character reference that it begins; or the sign that hides bare ampersands from the parser (no reference gives it).
_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?|\ufdd0")
_HIDDEN = re.compile("\ufdd0([\ufdd1\ufdd2])")


def _hidden(found: re.Match) -> str:
    if found[0] == "\ufdd0":
        return "\ufdd0\ufdd1"
    name = found[1] or ""
    return found[0] if name[:1] == "#" or name in html5 else "\ufdd0\ufdd2" + name


def closed_text(html: str | None) -> str:
    """Text in which a character reference counts only with its semicolon: one that was cut off stays as it is written."""
    return _HIDDEN.sub(lambda m: "\ufdd0" if m[1] == "\ufdd1" else "&", tree(_REFERENCE.sub(_hidden, html or "")).text())


def _texts(html: pa.Array, of) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array(map(of, s.to_pylist()), pa.string()) for s in _slices(html))])


@F.arrow_udf(StringType())
def page_text(html: pa.Array) -> pa.Array:
    """All text of a page, pieces joined by single spaces; scripts and styles left out."""
    return _texts(html, lambda x: tree(x).text())


@F.arrow_udf(StringType())
def page_closed_text(html: pa.Array) -> pa.Array:
    """As :func:`page_text`, with the references of :func:`closed_text`; where browsers read "&amp<" as a sign, this keeps it."""
    return _texts(html, closed_text)
