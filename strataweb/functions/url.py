"""URLs as column functions: canonical keys, scopes, templates, extensions, and references resolved."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: RFC 3986, appendix B.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
PORTS = {"http": 80, "https": 443}
SKIPPED = ("data:", "javascript:", "mailto:", "tel:", "blob:", "about:")


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return F.regexp_extract(url, r"(?s)" + PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """The lower-cased authority without its port, user information included."""
    return F.lower(F.regexp_replace(part(url, 2), r":\d+$", ""))


def port(url: Column) -> Column:
    """The port given, or the scheme's own, or null."""
    own = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    usual = F.when(scheme(url) == "http", 80).when(scheme(url) == "https", 443)
    return F.when(own != "", own.cast("int")).otherwise(usual)


def normal_path(path: Column) -> Column:
    """Without . and .. segments; trailing slashes stay, an empty path stays empty."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & path.startswith("/"), acc).otherwise(F.concat(acc, F.array(s))),
    )
    lead = F.when(path.rlike("^//(?!/)"), "//").when(path.startswith("/"), "/").otherwise("")
    joined = F.concat(lead, F.array_join(kept, "/"))
    tail = F.when(path.endswith("/") & ~joined.endswith("/") & (joined != ""), "/").otherwise("")
    return F.when(path == "", "").otherwise(F.concat(F.when(joined == "", F.lit(".")).otherwise(joined), tail))


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _decoded(x: Column) -> Column:
    """Escapes decoded, + to a space; a % that begins no escape stays as it is."""
    return F.url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_query(query: Column) -> Column:
    """The query's pairs sorted and encoded anew; bytes that aren't UTF-8 become replacement characters."""
    some = F.filter(F.split(query, "&"), lambda p: p != "")
    both = F.transform(some, lambda p: F.struct(_decoded(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("n"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    return F.array_join(F.transform(F.array_sort(both), lambda p: F.concat(_encoded(p["n"]), F.lit("="), _encoded(p["v"]))), "&")


def canon_key(url: Column) -> Column:
    """Scheme and host in lower case, no default port, a normal path, sorted query pairs, no fragment."""
    own = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    usual = F.when(scheme(url) == "http", "80").when(scheme(url) == "https", "443").otherwise("")
    netloc = F.concat(host(url), F.when((own != "") & (own != usual), F.concat(F.lit(":"), own)).otherwise(""))
    query = canonical_query(part(url, 4))
    return F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(part(url, 2) != "", F.concat(F.lit("//"), netloc)).otherwise(""), normal_path(part(url, 3)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def scope(url: Column) -> Column:
    """struct<scheme, host, port>, or null without a host or a known port."""
    return F.when((host(url) != "") & port(url).isNotNull(), F.struct(scheme(url).alias("scheme"), host(url).alias("host"), port(url).alias("port")))


def in_scope(url: Column, of: Column) -> Column:
    return F.coalesce(scope(url) == of, F.lit(False))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url).isin(80, 443), "").otherwise(F.concat(F.lit(":"), port(url).cast("string"))))


def query_template(url: Column) -> Column:
    """The path and the query's distinct names, sorted."""
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(part(url, 4), "&"), lambda p: p != ""), lambda p: _decoded(F.substring_index(p, "=", 1)))))
    return F.concat(part(url, 3), F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))


def url_ext(url: Column) -> Column:
    """The extension of the last path segment, in lower case; none for dotfiles."""
    last = F.regexp_extract(part(url, 3), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(last, r"^.+\.([^.]*)$", 1))


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b: str | None, r: str | None) -> str | None:
        try:
            found = urljoin(b or "", r)
            return found if urlsplit(found).scheme in PORTS and urlsplit(found).netloc else None
        except ValueError:
            return None

    return pd.Series([None if r is None else one(b, r) for b, r in zip(base, ref)], dtype=object)


def resolve(base: Column, ref: Column) -> Column:
    """The absolute http(s) URL of a reference, or null.

    Absolute and root-relative references without dots are joined by expressions. A Python function is called
    for every row, in whatever branch it stands, so it is given null for those.
    """
    ref = F.regexp_replace(ref, r"^\s+|\s+$", "")
    none = (ref == "") | ref.startswith("#") | F.lower(ref).rlike("^(?:" + "|".join(SKIPPED) + ")")
    plain = ref.rlike(r"^/(?:[^/.?#\s][^?#\s]*)?(?:\?[^#\s]*)?$") & ~ref.contains("./") & ~ref.rlike(r"/\.{1,2}$") & base.rlike("^https?://[^/?#]+")
    whole = ref.rlike(r"^https?://[^/?#\s]+(?:/[^\s.]*)?$")
    left = F.when(~F.coalesce(none | plain | whole, F.lit(False)), ref)
    joined = _joined(F.when(left.isNotNull(), base), left)
    return F.when(none, None).when(plain, F.concat(F.regexp_extract(base, "^(https?://[^/?#]+)", 1), ref)).when(whole, ref).otherwise(joined)
