"""Bodies expanded into text surfaces (sub, text): markup, code, JSON, XML, CSV, source maps, PDF, and decoded payloads."""

from __future__ import annotations

import base64
import csv
import html
import io
import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import latin1, utf8

#: Patterns of scripts, styles and attributes in markup.
SCRIPT, STYLE = r"(?is)<script.*?</script>", r"(?is)<style.*?</style>"
ATTRIBUTE = r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')"""
#: A match of ATTRIBUTE begins where a run of name characters does, so that other places needn't be tried.
NAMED = r"(?<![\w:-])" + ATTRIBUTE
SURFACE, PAYLOAD = (T.ArrayType(T.StructType([T.StructField("sub", T.StringType()), T.StructField("data", x)])) for x in (T.StringType(), T.BinaryType()))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references to characters."""
    return text.map(html.unescape, na_action="ignore")


def named(name: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(name).alias("sub"), x.alias("data")))


def comments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)<!--(.*?)-->"), 1)


def stripped(text: Column) -> Column:
    """Without scripts and styles."""
    return F.regexp_replace(F.regexp_replace(text, SCRIPT, " "), STYLE, " ")


def tag_free(text: Column) -> Column:
    """Text as it reads: tags gone without a space, references not yet decoded."""
    return F.regexp_replace(stripped(text), "(?d)<[^>]+>", "")


def hidden(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?is)<[^>]+(?:display\s*:\s*none|hidden)[^>]*>(.*?)</[^>]+>"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, "<[^>]+>", ""))


def attributes(text: Column) -> Column:
    """(sub html_attr:<name>, data) of non-empty attributes outside scripts and styles."""
    whole = F.regexp_extract_all(stripped(text), F.lit(NAMED), 0)
    name = lambda a: F.lower(F.regexp_extract(a, r"^([\w:-]+)", 1))
    value = lambda a: F.regexp_extract(a, r"(?s)^[\w:-]+\s*=\s*[\"'](.*)[\"']$", 1)
    return F.filter(F.transform(whole, lambda a: F.struct(F.concat(F.lit("html_attr:"), name(a)).alias("sub"), value(a).alias("data"))), lambda s: s["data"] != "")


def inline(text: Column, tag: str) -> Column:
    """Bodies of a tag that aren't blank."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))


def block_comments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)/\*(.*?)\*/"), 1)


def line_comments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(//[^\n]*)"), 1)


def string_literals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""(?s)(["'`])((?:\\.|(?!\1).)*)\1"""), 2)


def code(text: Column) -> Column:
    return F.concat(named("comment_block", block_comments(text)), named("comment_line", line_comments(text)), named("string_literal", string_literals(text)), named("raw", F.array(text)))


def _under(name: str):
    return lambda s: F.struct(F.concat(F.lit(name), s["sub"]).alias("sub"), s["data"].alias("data"))


def html_surfaces(text: Column) -> Column:
    parts = [named("html_comment", comments(text)), named("html_text", F.array(unescape(tag_free(text)))), named("html_hidden", hidden(text)), attributes(text)]
    for tag in ("script", "style"):
        inner = F.flatten(F.transform(inline(text, tag), code))
        parts.append(F.transform(inner, _under(f"inline_{tag}:")))
    return F.concat(*parts, named("raw", F.array(text)))


def pdf_text(text: Column) -> Column:
    """Literal strings in text objects."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)BT(.*?)ET"), 1)
    strings = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"\(((?:\\.|[^\\)])*)\)"), 1)))
    return F.transform(strings, lambda s: F.regexp_replace(s, r"\\([\\()])", "$1"))


def _json(body: str) -> list[tuple[str, str]]:
    def walk(v: object, path: str):
        if isinstance(v, str):
            yield f"json_value:{path}", v
        elif isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{path}.{k}")
        elif isinstance(v, list):
            for k, x in enumerate(v):
                yield from walk(x, f"{path}[{k}]")

    try:
        return list(walk(json.loads(body), "$"))
    except (ValueError, RecursionError):
        return [("raw", body)]


def _xml(body: str) -> list[tuple[str, str]]:
    """An encoding that the body declares isn't heeded, as it is text already."""
    found = [("xml_comment", x) for x in re.findall("<!--(.*?)-->", body, re.DOTALL)]
    try:
        return found + [(f"xml_text:{e.tag.rpartition('}')[2]}", e.text) for e in ElementTree.fromstring(body).iter() if isinstance(e.tag, str) and e.text and e.text.strip()]
    except (ElementTree.ParseError, ValueError):
        return [*found, ("raw", body)]


def _csv(body: str) -> list[tuple[str, str]]:
    """Cells that aren't empty; of a malformed body those before the fault, and the whole."""
    out = []
    try:
        for r, row in enumerate(csv.reader(io.StringIO(body))):
            out += [(f"csv_cell:r{r}c{k}", x) for k, x in enumerate(row) if x]
    except csv.Error:
        out.append(("raw", body))
    return out


def _sourcemap(body: str) -> list[tuple[str, str]]:
    try:
        found = json.loads(body)
        names = found.get("sources") or []
        texts = found.get("sourcesContent") or []
        name = lambda k: names[k] if k < len(names) and isinstance(names[k], str) else f"sourcesContent[{k}]"
        return [*((f"sourcemap:{name(k)}", x) for k, x in enumerate(texts) if isinstance(x, str)), ("raw", body)]
    except (ValueError, AttributeError):
        return [("raw", body)]


def _expander(parse):
    @F.pandas_udf(SURFACE)
    def expand(body: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else [{"sub": s, "data": d} for s, d in parse(b)] for b in body], dtype=object)

    return expand


json_surfaces, xml_surfaces, csv_surfaces, sourcemap_surfaces = map(_expander, (_json, _xml, _csv, _sourcemap))

#: Gates of decoders, patterns on one character for each byte.
BASE64 = r"[A-Za-z0-9+/]{32,}={0,2}"
DATA_URI = r"data:[^;,]*;base64,([A-Za-z0-9+/=]+)"
PERCENT = r"(?:%[0-9A-Fa-f]{2}){4,}"
ENTITIES = r"(?:&(?:#\d+|#x[0-9a-fA-F]+|[a-z]+);){4,}"
CSS_ESCAPES = r"(?:\\[0-9A-Fa-f]{1,6}\s?){4,}"
JS_ESCAPES = r"(?:\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}){4,}"
CHARCODES = r"String\.fromCharCode\(\s*\d+\s*(?:,\s*\d+\s*){3,}\)"
APPLIED = r"String\.fromCharCode\.apply\([^)]*?\[\s*\d+\s*(?:,\s*\d+\s*){3,}\]"
DECLARED = r"(?:var|let|const)?\s*NAME\s*=\s*\[(\s*\d+\s*(?:,\s*\d+\s*){3,})\]"
BY_NAME = r"String\.fromCharCode\.apply\([^,]+,\s*([A-Za-z_$][\w$]*)\s*\)"


def base64_runs(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(f"({BASE64})"), 1), lambda x: F.length(x) % 4 == 0)


def base64_decoded(text: Column) -> Column:
    """Binary payloads of runs that decode."""
    return F.filter(F.transform(base64_runs(text), lambda x: F.try_to_binary(x, F.lit("base64"))), lambda x: x.isNotNull())


def percent_decoded(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({PERCENT})"), 1), lambda x: F.unhex(F.replace(x, F.lit("%"), F.lit(""))))


def _chars(codes: list[int]) -> bytes | None:
    if any(x > 0x10FFFF for x in codes):
        return None
    return "".join(map(chr, codes)).encode("utf-8", "replace")


def decoded_variants(text: str) -> list[tuple[str, bytes]]:
    """What decoders make of a body, one level deep; text has a character for each byte."""
    out: list[tuple[str, bytes | None]] = []
    for name, runs, strict in (("data_uri", re.findall(DATA_URI, text), False), ("base64", [x for x in re.findall(BASE64, text) if len(x) % 4 == 0], True)):
        for x in runs:
            try:
                out.append((name, base64.b64decode(x, validate=strict)))
            except ValueError:
                pass
    out += [("percent", bytes.fromhex(x.replace("%", ""))) for x in re.findall(PERCENT, text)]
    out += [("html_entities", html.unescape(x).encode("utf-8", "replace")) for x in (m[0] for m in re.finditer(ENTITIES, text))]
    out += [("css_escape", _chars([int(y, 16) for y in re.findall(r"\\([0-9A-Fa-f]{1,6})", m[0])])) for m in re.finditer(CSS_ESCAPES, text, re.ASCII)]
    out += [("js_escape", _chars([int(a or b, 16) for a, b in re.findall(r"\\x(..)|\\u(....)", m[0])])) for m in re.finditer(JS_ESCAPES, text)]
    for pattern in (CHARCODES, APPLIED):
        out += [("js_escape", _chars(list(map(int, re.findall(r"\d+", m[0]))))) for m in re.finditer(pattern, text, re.ASCII)]
    for name in re.findall(BY_NAME, text, re.ASCII):
        if m := re.search(DECLARED.replace("NAME", re.escape(name)), text, re.ASCII):
            out.append(("js_escape", _chars(list(map(int, re.findall(r"\d+", m[1]))))))
    return [(f"decoded:{k}", v) for k, v in out if v is not None]


@F.pandas_udf(PAYLOAD)
def _decoded(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"sub": s, "data": d} for s, d in decoded_variants(t)] for t in text], dtype=object)


def decoded(body: Column) -> Column:
    """Decoded variants (sub, data) of a binary body; bodies without a gate's characters don't leave the JVM."""
    text = latin1(body)
    # A long run is found where it begins; what begins with a mark is looked for where there is one.
    may = text.rlike(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}") | text.contains(";base64,") | text.contains("fromCharCode")
    for mark, pattern in (("%", PERCENT), ("&", ENTITIES), ("\\", CSS_ESCAPES), ("\\", JS_ESCAPES)):
        may = may | (text.contains(mark) & text.rlike(pattern))
    return F.coalesce(_decoded(F.when(may, text)), F.array().cast("array<struct<sub:string,data:binary>>"))


def expanded(blobs: DataFrame) -> DataFrame:
    """(sha256, sub, data binary) of distinct bodies (sha256, handler, content): their surfaces and decoded variants.

    A body's raw surface is its very bytes. Bodies without a handler have decoded variants only, rasters none of
    their own. Spark calls a Python function for every row, whatever branch it stands in, so each is given null
    for bodies that aren't its own.
    """
    content, how = F.col("content"), F.col("handler")
    own = lambda name: F.when(how == name, utf8(content))
    whole = lambda x: named("raw", F.array(x))
    surfaces = (
        F.when(how == "html", html_surfaces(own("html"))).when(how == "code", code(own("code"))).when(how == "json", json_surfaces(own("json"))).when(how == "xml", xml_surfaces(own("xml")))
        .when(how == "csv", csv_surfaces(own("csv"))).when(how == "sourcemap", sourcemap_surfaces(own("sourcemap"))).when(how == "text", whole(F.lit("")))
        .when(how == "pdf", F.concat(named("pdf_text", pdf_text(latin1(content))), whole(F.lit(""))))
    )
    found = F.transform(surfaces, lambda s: F.struct(s["sub"].alias("sub"), F.when(s["sub"] == "raw", content).otherwise(s["data"].cast("binary")).alias("data")))
    every = F.concat(F.coalesce(found, F.array().cast("array<struct<sub:string,data:binary>>")), decoded(content))
    return blobs.select("sha256", F.explode(every).alias("s")).select("sha256", "s.sub", "s.data")
