"""Content types: sniffing, header types, handlers, and whether the three signals agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import EXTENSIONS, HANDLERS, JSON_EXTENSIONS, JSON_TYPES, SIGNATURES, Rules


def latin1(body: Column) -> Column:
    """One character for each byte."""
    return F.decode(body, "ISO-8859-1")


def utf8(body: Column) -> Column:
    """As UTF-8, what isn't valid replaced."""
    return F.make_valid_utf8(body.cast("string"))


def sniff_type(body: Column) -> Column:
    """By magic bytes, then by what the first 512 bytes have behind blanks; other than UTF-8 in the first 4096 bytes is octet-stream."""
    found = F
    for magic, kind in SIGNATURES:
        found = found.when(body.startswith(F.lit(magic)), kind)
    head = F.lower(F.regexp_replace(latin1(F.substring(body, 1, 512)), r"^\s+", ""))
    found = found.when(head.startswith("<!doctype html") | head.startswith("<html"), "text/html")
    found = found.when(head.startswith("<?xml"), F.when(head.contains("<svg"), "image/svg+xml").otherwise("application/xml")).when(head.startswith("<svg"), "image/svg+xml")
    found = found.when(~F.is_valid_utf8(F.substring(body, 1, 4096).cast("string")), "application/octet-stream")
    return found.when(head.startswith("{") | head.startswith("["), "application/json").otherwise("text/plain")


def header_type(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.substring_index(value, ";", 1), F.lit(""))))


def handler(content_type: Column, ext: Column) -> Column:
    """The name of the surfaces that a body is expanded by, or null."""
    found = F.when(ext == "map", "sourcemap")
    for prefix, name in HANDLERS:
        found = found.when(content_type.startswith(prefix), name)
    return found.when(content_type.startswith("image/"), "raster").when(content_type == "application/pdf", "pdf")


def expandable(status: Column, content_type: Column) -> Column:
    return F.coalesce(status.between(200, 299) & content_type.startswith("text/html"), F.lit(False))


def json_scannable(content_type: Column, ext: Column) -> Column:
    """Whether a body's JSON strings may be links."""
    found = ext.isin(JSON_EXTENSIONS)
    for x in JSON_TYPES:
        found = F.coalesce(content_type.startswith(x), F.lit(False)) | F.coalesce(found, F.lit(False))
    return found


def blocked_notice(text: Column, rules: Rules = Rules()) -> Column:
    return F.coalesce(text.rlike("(?iu)" + rules.blocked), F.lit(False))


def transient(status: Column, error: Column) -> Column:
    return F.coalesce(status.isin(500, 502, 503, 504), F.lit(False)) | error.isNotNull()


def disagrees(ext: Column, header: Column, sniffed: Column) -> Column:
    """Whether header and sniffed type differ, or either isn't what the extension stands for."""
    known = F.create_map(*(x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[ext]
    both = (header != "") & (sniffed != "") & (header != sniffed)
    named = known.isNotNull() & (header != "") & ~F.array_contains(known, header)
    inside = known.isNotNull() & (sniffed != "") & (sniffed != "text/plain") & ~F.array_contains(known, sniffed)
    return F.coalesce(both, F.lit(False)) | F.coalesce(named, F.lit(False)) | F.coalesce(inside, F.lit(False))
