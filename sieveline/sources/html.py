"""Raw pages as rows of nodes: wrappers pruned, what carries meaning kept.

There is no layout offline: boxes are absent, and styles count where they stand in
the element.  ``display:none`` and ``hidden`` take a subtree away, ``visibility:hidden``
an element but not its children.  Open paragraphs and list items end where HTML
ends them; other unclosed elements end with their parent.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head meta link".split())
#: Elements that are kept on their own account; fixed values.
KEPT = frozenset("a button input select textarea summary label form img canvas svg video picture object embed iframe frame address".split())
KEPT_ROLES = frozenset("main navigation banner contentinfo form search dialog table list heading".split())
ROLES = {
    "button": "button", "summary": "button", "select": "select", "textarea": "textbox", "img": "image", "form": "form", "iframe": "frame", "frame": "frame",
    "address": "address", "table": "table", "main": "main", "nav": "navigation", "header": "banner", "footer": "contentinfo",
} | {f"h{i}": "heading" for i in range(1, 7)}
#: Attributes that are kept as they are; fixed values.
KEPT_ATTRIBUTES = (
    "id name type placeholder autocomplete title alt role aria-label aria-modal aria-checked aria-selected aria-pressed aria-expanded aria-disabled aria-readonly aria-required aria-invalid "
    "itemprop itemtype rel email data-email data-hovercard-id data-name data-user-name data-sender data-testid content"
).split()
_CONTROLS = ("input", "textarea", "select")
_ENDS_P = frozenset("p div ul ol li nav article section header footer main table form address h1 h2 h3 h4 h5 h6 pre blockquote".split())
SCHEMA = "node_id int, parent_id int, depth int, tag string, role string, label string, text string, value string, attrs map<string,string>"


def _collapse(text: str, limit: int | None = None) -> str:
    text = " ".join(text.split())
    return text if limit is None or len(text) <= limit else text[:limit] + "…"


class _Tree(HTMLParser):
    """The elements of a page as [tag, attributes, own texts, children]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ["#root", {}, [], []]
        self.open = [self.root]

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close("p", frozenset(("div", "td", "th", "button", "table")))
        if tag == "li":
            self._close("li", frozenset(("ul", "ol")))
        if tag in ("td", "th", "tr"):
            for cell in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                self._close(cell, frozenset(("table",)) if tag == "tr" else frozenset(("tr", "table")))
        node = [tag, {k: v or "" for k, v in attrs}, [], []]
        self.open[-1][3].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.open[-1][2].append(data)


def _role(tag: str, attrs: dict) -> str:
    if attrs.get("role"):
        return attrs["role"]
    if tag == "a":
        return "link" if "href" in attrs else "generic"
    if tag == "input":
        kind = attrs.get("type", "").lower()
        return kind if kind in ("password", "checkbox", "radio", "submit", "file") else "textbox"
    return ROLES.get(tag) or ("textbox" if "contenteditable" in attrs else tag)


def _value(tag: str, attrs: dict, texts: list[str]) -> str | None:
    """Never of a password, a checkbox or a radio button."""
    if tag == "input" and attrs.get("type", "").lower() not in ("password", "checkbox", "radio"):
        return _collapse(attrs.get("value", ""), 300) or None
    return (_collapse("".join(texts), 600) or None) if tag == "textarea" else None


def _host(url: str) -> str:
    if url.startswith("data:"):
        return "data:"
    try:
        return urlsplit(url).netloc
    except ValueError:
        return ""


def _kept_attributes(tag: str, attrs: dict) -> dict[str, str]:
    """What names, describes and tells the state of an element; of addresses the host."""
    out = {k: _collapse(attrs[k], 120) for k in KEPT_ATTRIBUTES if attrs.get(k)}
    for name, host, tags in (("href", "hrefHost", ("a",)), ("src", "srcHost", ("img",)), ("src", "frameHost", ("iframe", "frame"))):
        if tag in tags and attrs.get(name) and _host(attrs[name]):
            out[host] = _host(attrs[name])
    kind = attrs.get("type", "").lower()
    if tag == "input" and kind == "password":
        out["filled"] = str(bool(attrs.get("value"))).lower()
    if tag == "input" and kind in ("checkbox", "radio"):
        out["checked"] = str("checked" in attrs).lower()
    out |= {k: "true" for k in ("disabled", "readonly", "required") if k in attrs and (tag in _CONTROLS or (k == "disabled" and tag == "button"))}
    return out


def _all_texts(node: list, but: list | None = None) -> str:
    """Texts of an element in document order, without those of a control in it."""
    out, stack = [], [node]
    while stack:
        tag, _, texts, children = x = stack.pop()
        if x is but or tag in ("select", "textarea", "option", "datalist", *SKIPPED):
            continue
        out += texts or []
        stack.extend(reversed(children))
    return " ".join(out)


def page_nodes(html: str | None) -> list[tuple]:
    """Rows of ``SCHEMA`` of one page, ids in document order from 0; none for null.

    Two explicit passes over a stack, so that depth has no limit."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    labels: dict[str, str] = {}
    ids: dict[str, list] = {}
    wraps: dict[int, list] = {}  # the label around a control
    order, stack = [], [(tree.root, None)]
    while stack:
        node, around = stack.pop()
        style = node[1].get("style", "").replace(" ", "").lower()
        if node[0] in SKIPPED or "display:none" in style or "hidden" in node[1]:
            node[3], node[2] = [], None
            continue
        if node[0] == "label":
            around = node
            if node[1].get("for"):
                labels[node[1]["for"]] = _collapse(_all_texts(node), 120)
        if node[1].get("id"):
            ids.setdefault(node[1]["id"], node)
        if node[0] in _CONTROLS and around:
            wraps[id(node)] = around
        order.append(node)
        stack.extend((x, around) for x in reversed(node[3]))
    kept: dict[int, list] = {}  # of each node: itself, or the children it leaves to its parent
    for node in reversed(order):
        tag, attrs, texts, _ = node
        children = [x for child in node[3] if child[2] is not None for x in kept.pop(id(child))]
        role = _role(tag, attrs)
        text, value = _collapse("".join(texts)), _value(tag, attrs, texts)
        matters = tag in KEPT or role in KEPT_ROLES or text or value or "contenteditable" in attrs
        unseen = "visibility:hidden" in attrs.get("style", "").replace(" ", "").lower()
        if tag == "#root" or unseen or not (matters or len(children) > 1):
            kept[id(node)] = children
            continue
        by = " ".join(_all_texts(ids[x]) for x in attrs.get("aria-labelledby", "").split() if x in ids)
        own = [labels.get(attrs.get("id", "")), _all_texts(wraps[id(node)], node) if id(node) in wraps else None, attrs.get("placeholder")] if tag in _CONTROLS else []
        said = (_collapse(x) for x in (by, attrs.get("aria-label"), *own, attrs.get("alt") if tag == "img" else None, attrs.get("title")) if x)
        label = next((x for x in said if x), "")
        kept[id(node)] = [(tag, role, _collapse(label, 120), text or None, value, _kept_attributes(tag, attrs), children)]
    rows, walk = [], [(x, None, 0) for x in reversed(kept[id(tree.root)])]
    while walk:
        (tag, role, label, text, value, attrs, children), parent, depth = walk.pop()
        rows.append((len(rows), parent, depth, tag, role, label, text, value, attrs))
        walk.extend((x, len(rows) - 1, depth + 1) for x in reversed(children))
    return rows


def html_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Nodes of each page with its key; pages without nodes have no rows.  Pages are
    parsed one by one, an Arrow batch of nodes for a batch of pages."""
    kind = pages.schema[key].dataType.simpleString()
    out = pages.sparkSession.createDataFrame([], f"`{key}` {kind}, {SCHEMA}").schema
    schema = to_arrow_schema(out)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [page_nodes(x.as_py()) for x in batch.column(1)]
            flat = [row for page in rows for row in page]
            keys = batch.column(0).take(pa.array([i for i, page in enumerate(rows) for _ in page], pa.int64()))
            columns = [[*(list(x.items()) if isinstance(x, dict) else x for x in c)] for c in zip(*flat, strict=True)] if flat else [[] for _ in schema.names[1:]]
            yield pa.RecordBatch.from_arrays([keys.cast(schema.field(0).type), *[pa.array(c, schema.field(i + 1).type) for i, c in enumerate(columns)]], schema=schema)

    return pages.select(F.col(key), F.col(html)).mapInArrow(parse, out)
