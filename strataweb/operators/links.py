"""Links in bodies, headers and JSON, and edges between pages."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import json_scannable, latin1
from ..functions.url import in_scope, resolve
from ..rules import ATTRIBUTES, TAGS
from .surfaces import json_surfaces

#: Fixed values: (name, tier, how, pattern), in the order that decides a reference's attribution.
PATTERNS = [
    ("sourcemap", 2, "sourcemap", r"(?m)^[ \t]*//[#@]\s*sourceMappingURL=(\S+)"),
    ("css_url", 2, "css_url", r"""url\(\s*['"]?([^'")]+?)['"]?\s*\)"""),
    ("css_import", 2, "css_url", r"""@import\s+(?:url\(\s*)?['"]([^'"]+)['"]"""),
    ("absolute", 1, "", r"""["'`](https?://[^"'`\s<>)]+)["'`]"""),
    ("root_ext", 2, "", r"""["'`](/[^"'`\s<>)]+\.[A-Za-z0-9]{1,8})["'`]"""),
    ("root_route", 2, "", r"""["'`](/(?:[A-Za-z0-9_-]+/)+)["'`]"""),
    ("relative_ext", 3, "", r"""(?U)["'`]((?:\.\./|\./)?[\w.-]+(?:/[\w.-]+)*\.[A-Za-z0-9]{1,8})["'`]"""),
    ("robots", 2, "", r"(?im)^\s*(?:Disallow|Allow)\s*:\s*(/\S*)"),
    ("sitemap", 2, "", r"(?i)<loc>\s*(https?://[^<]+|/[^<]+?)\s*</loc>"),
    ("review", -1, "", r"""(?U)["'`]((?:\.\./|\./)?[\w-]+(?:/[\w-]+)+)["'`]"""),
]
#: URLs in inline styles, paths in data attributes, a refresh's target.
STYLE_URL, DATA_PATH, REFRESH = r"""url\(\s*['"]?([^'")]+)['"]?\s*\)""", r"[./A-Za-z0-9_-]+/[A-Za-z0-9_./-]+", r"(?i)url\s*=\s*([^;]+)"
#: Characters of an element's text that go with its reference; elements without an end tag.
HINT = 80
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def references(text: Column) -> Column:
    """(place, tier, how, ref) of all patterns, each reference by its first pattern."""
    def hits(place: int, tier: int, how: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit("(?d)" + pattern), 1)
        return F.transform(found, lambda r: F.struct(F.lit(place).alias("place"), F.lit(tier).alias("tier"), F.lit(how or f"tier{tier}").alias("how"), r.alias("ref")))

    parts = [hits(k, tier, how, p) for k, (_, tier, how, p) in enumerate(PATTERNS)]
    return F.concat(*parts)


def byte_scan(bodies: DataFrame) -> DataFrame:
    """bodies (id, base, text, scope) to (id, verbatim, tier, ref, how, hint); tier -1 is for review.

    Only links in scope are kept; a reference that doesn't resolve blocks its later patterns too.
    """
    rows = bodies.select("id", "base", "scope", F.explode(references(F.col("text"))).alias("h")).select("id", "base", "scope", "h.*")
    first = Window.partitionBy("id", "ref").orderBy("place")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").filter("tier > 0 or not (ref like 'http%' or ref like '/%' or element_at(split(ref, '/'), -1) like '%.%')")
    rows = rows.withColumn("verbatim", resolve(F.col("base"), F.col("ref")))
    rows = rows.filter((F.col("tier") < 0) | in_scope(F.col("verbatim"), F.col("scope")))
    named = F.col("how").startswith("tier")
    return rows.select("id", "verbatim", "tier", "ref", F.when(named, "regex_fallback").otherwise(F.col("how")).alias("how"), F.when(named, F.col("how")).otherwise("").alias("hint"))


def link_headers(value: Column) -> Column:
    """(ref, rel) of a Link header's entries."""
    entries = F.filter(F.split(value, r",\s*(?=<)"), lambda e: e.rlike(r"^\s*<[^>]*>"))
    return F.transform(entries, lambda e: F.struct(F.regexp_extract(e, "<([^>]*)>", 1).alias("ref"), F.trim(F.regexp_extract(e, r"""(?i);\s*rel\s*=\s*"?([^";]+)"?""", 1)).alias("rel")))


def header_links(manifest: DataFrame) -> DataFrame:
    """(seq, verbatim, how, hint) of Link headers, then of quoted URLs in other headers but location; each URL of a row once."""
    rows = manifest.select("seq", "url", F.explode(F.map_entries("headers")).alias("h")).select("seq", "url", F.lower("h.key").alias("key"), "h.value")
    link = rows.filter("key = 'link'").select("seq", "url", F.explode(link_headers(F.col("value"))).alias("x"))
    link = link.select("seq", "url", F.lit(0).alias("place"), F.lit("http_link_header").alias("how"), F.col("x.rel").alias("hint"), F.col("x.ref").alias("ref"))
    quoted = {name: pattern for name, _, _, pattern in PATTERNS}
    found = F.concat(*(F.regexp_extract_all("value", F.lit("(?d)" + quoted[x]), 1) for x in ("absolute", "root_ext")))
    rest = rows.filter("key not in ('link', 'location')").select("seq", "url", F.lit(1).alias("place"), F.concat(F.lit("http_header:"), "key").alias("how"), F.lit("").alias("hint"), F.explode(found).alias("ref"))
    every = link.unionByName(rest).withColumn("verbatim", resolve(F.col("url"), F.col("ref"))).filter("verbatim is not null")
    first = Window.partitionBy("seq", "verbatim").orderBy("place", "how", "ref")
    return every.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("seq", "verbatim", "how", "hint")


def json_links(values: DataFrame) -> DataFrame:
    """values (id, base, value) of JSON strings: http(s) as they are, rooted and dotted ones resolved, others no links; each once for an id."""
    rows = values.withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).filter("value rlike '^(?:https?://|/|\\\\./|\\\\.\\\\./)'").dropDuplicates(["id", "value"])
    return rows.select("id", F.when(F.col("value").rlike("^https?://"), F.col("value")).otherwise(resolve(F.col("base"), F.col("value"))).alias("verbatim")).filter("verbatim is not null")


def json_body_links(bodies: DataFrame) -> DataFrame:
    """json_links of bodies (id, base, content_type, ext, text) that hold JSON; one that can't be parsed has none."""
    rows = bodies.filter(json_scannable(F.col("content_type"), F.col("ext")))
    found = rows.select("id", "base", F.explode(json_surfaces(F.col("text"))).alias("s")).filter(F.col("s.sub").startswith("json_value:"))
    return json_links(found.select("id", "base", F.col("s.data").alias("value")))


def body_text(content: Column) -> Column:
    """A body as UTF-8, or if it isn't, a character for each byte."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin1(content))


def scan_links(heads: DataFrame, bodies: DataFrame) -> DataFrame:
    """(src, dst_url, how, hint, place) in scope that headers, then patterns in bodies, then JSON strings tell of.

    heads (seq, url, canon_key, headers, scope) are each key's first rows, bodies (seq, url, canon_key, content_type,
    url_ext, text, scope) each body's first rows.
    """
    inside = in_scope(F.col("verbatim"), F.col("scope"))
    own = lambda rows: rows.select(F.col("seq").alias("id"), F.col("canon_key").alias("src"), "scope")
    head = header_links(heads).withColumnRenamed("seq", "id").join(own(heads), "id").filter(inside).withColumn("kind", F.lit(0))
    scanned = byte_scan(bodies.select(F.col("seq").alias("id"), F.col("url").alias("base"), "scope", "text")).filter("tier > 0")
    scanned = scanned.join(own(bodies), "id").withColumn("kind", F.lit(1))
    values = json_body_links(bodies.select(F.col("seq").alias("id"), F.col("url").alias("base"), "content_type", F.col("url_ext").alias("ext"), "text"))
    values = values.join(own(bodies), "id").filter(inside).withColumns({"kind": F.lit(2), "how": F.lit("json_value"), "hint": F.lit("")})
    cols = ["src", F.col("verbatim").alias("dst_url"), "how", "hint", F.struct("kind", F.col("verbatim").alias("url")).alias("place")]
    return head.select(cols).unionByName(scanned.select(cols)).unionByName(values.select(cols))


def review(bodies: DataFrame) -> DataFrame:
    """(ref), distinct, of bodies for byte_scan that are for review: relative, and without an extension."""
    return byte_scan(bodies).filter("tier < 0").select("ref").distinct()


class _Harvest(HTMLParser):
    """References of a page in the order of its elements, with the text that each element holds, as far as end tags tell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.last: list[dict] = []
        self.base: str | None = None
        #: Open elements: the tag, references that wait for its text, and the text so far.
        self.open: list[tuple[str, list[dict], list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag == "base":
            self.base = self.base or own.get("href") or None
            return
        waiting = []
        for name, how in ATTRIBUTES.items():
            if not (value := own.get(name)):
                continue
            if name == "srcset":
                self.found += [{"ref": x.split()[0], "how": how, "hint": own.get("alt", "")[:HINT]} for x in value.split(",") if x.split()]
                continue
            link = {"ref": value, "how": TAGS.get(tag, how) if name in ("href", "src", "data") else how, "hint": own.get("rel", "") if tag == "link" else ""}
            self.found.append(link)
            waiting += [link] * (tag != "link")
        self.found += [{"ref": x, "how": "css_url", "hint": "inline style"} for x in re.findall(STYLE_URL, own.get("style", ""))]
        self.found += [{"ref": v, "how": "data_attr", "hint": k} for k, v in own.items() if k.startswith("data-") and re.fullmatch(DATA_PATH, v)]
        if tag == "meta" and own.get("http-equiv", "").lower() == "refresh" and (m := re.search(REFRESH, own.get("content", ""))):
            self.last.append({"ref": m[1].strip(), "how": "meta_refresh", "hint": own["content"][:HINT]})
        if tag not in VOID:
            self.open.append((tag, waiting, []))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """A slash doesn't end an element of HTML."""
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        for _, waiting, text in self.open:
            if waiting and sum(map(len, text)) < HINT and (text or data.strip()):
                text.append(data if text else data.lstrip())

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                name = self._shut()
                if name == tag:
                    return

    def _shut(self) -> str:
        tag, waiting, text = self.open.pop()
        for link in waiting:
            link["hint"] = "".join(text).strip()[:HINT]
        return tag

    def links(self, page: str) -> list[dict]:
        self.feed(page)
        self.close()
        while self.open:
            self._shut()
        return self.found + self.last


_LINK = T.StructType([T.StructField(x, T.StringType()) for x in ("ref", "how", "hint")])


@F.pandas_udf(T.StructType([T.StructField("base", T.StringType()), T.StructField("links", T.ArrayType(_LINK))]))
def harvested(page: pd.Series) -> pd.DataFrame:
    """Static references of a page and its first base."""
    out = []
    for text in page:
        h = _Harvest()
        out.append((links := h.links(text or ""), h.base))
    return pd.DataFrame([(base, links) for links, base in out], columns=["base", "links"])


def dom_links(pages: DataFrame) -> DataFrame:
    """(src, dst_url, how, hint, place) of pages (canon_key, url, html): references of the markup, resolved against the page's base."""
    rows = pages.select("canon_key", "url", harvested(F.col("html")).alias("h"))
    base = F.coalesce(resolve(F.col("url"), F.col("h.base")), F.col("url"))
    rows = rows.select(F.col("canon_key").alias("src"), base.alias("base"), F.posexplode("h.links").alias("place", "x"))
    return rows.select("src", resolve(F.col("base"), F.col("x.ref")).alias("dst_url"), "x.how", "x.hint", "place").filter("dst_url is not null")


def blocked_requests(log: DataFrame, scope: Column) -> DataFrame:
    """Requests (url, method) of a log that a capture may not make, with why: out of scope, or other than GET."""
    why = F.when(~in_scope(F.col("url"), scope), "out_of_scope").when(F.col("method") != "GET", "mutation")
    return log.withColumn("blocked", why).filter("blocked is not null")


def anchors(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('(?i)<a\\b[^>]*?href="([^"]*)"'), 1)
