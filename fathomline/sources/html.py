"""Pages from raw HTML: one parse per document, in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style nav header footer aside noscript iframe svg template".split())
BLOCKS = frozenset("article main div section td".split())
TEXTUAL = re.compile(r"[ \t\n\r]+")
# Words of class and id that speak for or against main content.
GOOD = re.compile(r"article|content|post|entry|main|body|text|story", re.I)
BAD = re.compile(r"comment|sidebar|footer|nav|menu|advert|promo|related|share|widget|banner|cookie", re.I)
MAX_IMAGES, MAX_ITEMS, MAX_PROPERTIES, MAX_STRUCTURED = 100, 20, 30, 2000
# Schema types by weight, the first of equals wins.
SCHEMA_WEIGHT = {"Article": 10, "NewsArticle": 10, "BlogPosting": 9, "Product": 8, "Recipe": 8, "Event": 7, "LocalBusiness": 7, "Organization": 6, "FAQPage": 6, "HowTo": 6, "Person": 5, "Review": 5, "WebPage": 1, "WebSite": 1}
_MEDIA, _FLEX = re.compile(r"@media\b", re.I), re.compile(r"display\s*:\s*(?:inline-)?(?:flex|grid)", re.I)
_FONT, _SIDE = re.compile(r"font-size\s*:\s*([\d.]+)\s*(px|pt)"), re.compile(r"(?:^|[;\s])(?:width|height)\s*:\s*([\d.]+)\s*px")

SCHEMA = (
    "title string, description string, content string, canonical string, keywords array<string>, robots string, noindex boolean, nofollow boolean, lang string, headings array<struct<level: int, text: string>>, "
    "links array<struct<url: string, text: string, is_external: boolean, nofollow: boolean>>, images array<struct<url: string, alt: string, title: string, width: int, height: int, context: string>>, "
    "items array<struct<type: string, properties: map<string, string>>>, schema_type string, heading_text string, image_text string, structured_text string, scripts int, stylesheets int, resources int, lazy boolean, deferred boolean, "
    "style_bytes int, viewport string, media_queries boolean, flexible boolean, touch_icons boolean, small_fonts int, small_targets int"
)


class _Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Builder(HTMLParser):
    """A forgiving tree: unclosed tags end with their parent, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        n = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _walk(n: _Node):
    stack = [n]
    while stack:
        x = stack.pop()
        yield x
        stack += [k for k in reversed(x.kids) if isinstance(k, _Node)]


def _text(n: _Node, drop: frozenset = frozenset()) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in drop:
            stack += reversed(x.kids)
            if x.tag in BLOCKS or x.tag in ("p", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
                out.append(" ")
    return TEXTUAL.sub(" ", "".join(out)).strip(" ")


def _score(n: _Node) -> float:
    inner = [x for x in _walk(n)]
    text = _text(n, DROPPED)
    marks = n.attrs.get("class", "") + " " + n.attrs.get("id", "")
    s = sum(x.tag == "p" for x in inner) + text.count(",") + len(text.encode()) / 100
    return s + 25 * bool(GOOD.search(marks)) - 25 * bool(BAD.search(marks)) + 30 * (n.tag in ("article", "main"))


def main_text(root: _Node) -> str:
    """Text of the block that scores highest, the first of equals; of everything when that is under 50 bytes."""
    best, top = None, float("-inf")
    stack = [(root, False)]
    while stack:
        n, hidden = stack.pop()
        hidden = hidden or n.tag in DROPPED
        if not hidden and n.tag in BLOCKS and (s := _score(n)) > top:
            best, top = n, s
        stack += [(k, hidden) for k in reversed(n.kids) if isinstance(k, _Node)]
    text = _text(best, DROPPED) if best else ""
    return text if len(text.encode()) >= 50 else _text(root, DROPPED | {"title", "head"})


def _items(root: _Node) -> list[dict]:
    """JSON-LD objects: type and scalar properties."""
    out = []
    for n in _walk(root):
        if n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                data = json.loads("".join(k for k in n.kids if isinstance(k, str)))
            except ValueError:
                continue
            for o in data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []:
                if isinstance(o, dict):
                    kind = o.get("@type")
                    kind = kind[0] if isinstance(kind, list) and kind else kind
                    props = {k: str(v) for k, v in o.items() if not k.startswith("@") and isinstance(v, str | int | float | bool) and len(str(v).encode()) <= 500}
                    out.append({"type": str(kind or ""), "properties": dict(list(props.items())[:MAX_PROPERTIES])})
    return (out + _microdata(root))[:MAX_ITEMS]


def _microdata(root: _Node) -> list[dict]:
    """Items of itemscope: the short name of the type; a property's content, href or src, else its text."""
    out = []
    for n in _walk(root):
        kind = re.sub(r"^https?://schema\.org/", "", n.attrs.get("itemtype", ""))
        if "itemscope" not in n.attrs or "itemtype" not in n.attrs or "/" in kind:
            continue
        props: dict[str, str] = {}
        for x in _walk(n):
            if x is not n and (name := x.attrs.get("itemprop")):
                value = next((x.attrs[a] for a in ("content", "href", "src") if a in x.attrs), None)
                value = _text(x) if value is None else value
                if len(value.encode()) <= 500:
                    props[name] = value
        out.append({"type": kind, "properties": dict(list(props.items())[:MAX_PROPERTIES])})
    return out


def schema_type(items: list[dict]) -> str:
    """The weightiest type of the items; an unknown one only when nothing stands before it and nothing known follows."""
    known = [i["type"] for i in items if i["type"] in SCHEMA_WEIGHT]
    return max(known, key=lambda t: SCHEMA_WEIGHT[t]) if known else next((i["type"] for i in items if i["type"]), "")


def robots_flags(*values: str | None) -> tuple[str, bool, bool]:
    """(directives as written, noindex, nofollow) of meta tags and headers together."""
    said = [v.strip().lower() for v in values if v and v.strip()]
    words = {w.strip() for v in said for w in v.split(",")}
    both = "none" in said
    return ", ".join(said), both or "noindex" in words, both or "nofollow" in words


def _number(x: str | None) -> int:
    return int(x) if x and re.fullmatch(r"[+-]?\d{1,9}", x) else 0


def _images(nodes: list[_Node], captions: dict[int, str], url: str, content: str) -> list[dict]:
    out = []
    low = content.lower()
    rich = len(content.split()) >= 10
    for n in nodes:
        if n.tag != "img" or not n.attrs.get("src") or len(out) >= MAX_IMAGES:
            continue
        alt, context = n.attrs.get("alt", ""), captions.get(id(n), "")
        if not context and alt and rich:
            at = low.find(alt.lower())
            if at < 0 and len(words := alt.lower().split()) >= 2:
                at = low.find(" ".join(words[:2]))
            if at >= 0:
                context = content[max(0, at - 50) : at + len(alt) + 50].strip()
        out.append({"url": urljoin(url, n.attrs["src"]), "alt": alt, "title": n.attrs.get("title", ""), "width": _number(n.attrs.get("width")), "height": _number(n.attrs.get("height")), "context": context})
    return out


def _metrics(nodes: list[_Node]) -> dict:
    """What a page loads, and how it fits small screens."""
    scripts = [n for n in nodes if n.tag == "script" and "src" in n.attrs]
    sheets = [n for n in nodes if n.tag == "link" and n.attrs.get("rel") == "stylesheet"]
    images = [n for n in nodes if n.tag == "img"]
    css = " ".join(k for n in nodes if n.tag == "style" for k in n.kids if isinstance(k, str))
    fonts = targets = 0
    for n in nodes:
        low = n.attrs.get("style", "").lower()
        if (m := _FONT.search(low)) and float(m[1].rstrip(".") or 0) < (12 if m[2] == "px" else 9):
            fonts += 1
        if n.tag in ("a", "button", "input", "select") and (m := _SIDE.search(low)) and float(m[1].rstrip(".") or 0) < 44:
            targets += 1
    return {
        "scripts": len(scripts), "stylesheets": len(sheets), "resources": len(scripts) + len(sheets) + len(images), "lazy": any(n.attrs.get("loading", "").lower() == "lazy" for n in images),
        "deferred": any("async" in n.attrs or "defer" in n.attrs for n in scripts), "style_bytes": sum(len(n.attrs.get("style", "").encode()) for n in nodes),
        "viewport": next((n.attrs.get("content", "") for n in reversed(nodes) if n.tag == "meta" and n.attrs.get("name", "").lower() == "viewport"), None),
        "media_queries": bool(_MEDIA.search(css)) or any(n.attrs.get("media", "all") not in ("all", "") for n in sheets), "flexible": bool(_FLEX.search(css)),
        "touch_icons": any(n.tag == "link" and n.attrs.get("rel") in ("apple-touch-icon", "apple-touch-icon-precomposed") for n in nodes), "small_fonts": fonts, "small_targets": targets,
    }


def parse_page(html: str | None, url: str | None = "", header: str | None = "") -> dict:
    """Everything of one page; header is its X-Robots-Tag. Null and broken markup give empty values."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    root, url = b.root, url or ""
    nodes = list(_walk(root))
    meta = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "") for n in reversed(nodes) if n.tag == "meta"}
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    title = first("title")
    robots, noindex, nofollow = robots_flags(meta.get("robots"), header)
    captions = {}
    for n in nodes:
        if n.tag == "figure" and (text := " ".join(_text(k) for k in _walk(n) if k.tag == "figcaption").strip()):
            captions |= {id(k): text for k in n.kids if isinstance(k, _Node) and k.tag == "img"}
    links, seen = [], set()
    for n in nodes:
        if n.tag == "a" and n.attrs.get("href"):
            try:
                to = urljoin(url, n.attrs["href"].strip())
                parts = urlsplit(to)
            except ValueError:
                continue
            key = to.split("#")[0].rstrip("/")
            if parts.scheme in ("http", "https") and key not in seen:
                seen.add(key)
                links.append({"url": to, "text": _text(n), "is_external": parts.netloc.lower() != urlsplit(url).netloc.lower(), "nofollow": "nofollow" in n.attrs.get("rel", "") or nofollow})
    canonical = next((n.attrs.get("href", "") for n in nodes if n.tag == "link" and n.attrs.get("rel") == "canonical"), "")
    content, items = main_text(root), _items(root)
    images = _images(nodes, captions, url, content)
    headings = [{"level": int(n.tag[1]), "text": t} for n in nodes if re.fullmatch("h[1-6]", n.tag) and (t := _text(n))]
    said = [p for i in items for p in (i["type"], *(f"{k}: {v}" for k, v in sorted(i["properties"].items()) if 0 < len(v.encode()) <= 200))]
    return {
        "title": (_text(title) if title else "") or meta.get("og:title", ""),
        "description": meta.get("description", "") or meta.get("og:description", ""),
        "content": content,
        "canonical": urljoin(url, canonical) if canonical else "",
        "keywords": [k.strip() for k in meta.get("keywords", "").split(",") if k.strip()],
        "robots": robots,
        "noindex": noindex,
        "nofollow": nofollow,
        "lang": (first("html").attrs.get("lang", "") if first("html") else ""),
        "headings": headings,
        "links": links,
        "images": images,
        "items": items,
        "schema_type": schema_type(items),
        "heading_text": " ".join(h["text"] for h in headings if h["level"] <= 3),
        "image_text": " ".join(t for i in images for t in (i["alt"], i["title"], i["context"]) if t),
        "structured_text": " ".join(said)[:MAX_STRUCTURED],
        **_metrics(nodes),
    }


def pages_from_html(raw: DataFrame, url: str = "url", html: str = "html", header: str | None = None) -> DataFrame:
    """(url, fields of SCHEMA): one row per row of raw; header names the column of the X-Robots-Tag."""
    target = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [parse_page(h, u, r) for u, h, r in zip(*(b.column(k).to_pylist() for k in range(3)))]
            for o in out:
                for item in o["items"]:
                    item["properties"] = list(item["properties"].items())
            cols = [pa.array([o[f.name] for o in out], f.type) for f in target]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["u", *target.names])

    robots = F.col(header) if header else F.lit(None).cast("string")
    return raw.select(F.col(url).alias("u"), F.col(html).alias("h"), robots.alias("r")).mapInArrow(run, "u string, " + SCHEMA).withColumnRenamed("u", url)
