"""The catalogue of queries over the driver's tables, with DuckDB SQL for each that SQL can express.

Pages stand in for fetched rows (url, html), documents for bodies, and links in pages for edges.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import content as ct
from .functions import url as u
from .operators import detect, images, links, surfaces
from .plans import crawl, extraction, frontier, graph, reports
from .rules import DECLARED, Rules
from .sources import artifacts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Secrets in the documents stand in for markers.
TOKEN = r'token = "([0-9a-f]{40})"'


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
#: The canonical key of the pages' URLs, which have no ports, dots or escapes.
KEY = """concat(lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)), regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1),
  CASE WHEN url LIKE '%?%' THEN concat('?', array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&')) ELSE '' END)""".replace("\\\\", "\\")
TEMPLATE = """concat(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1),
  CASE WHEN url LIKE '%?%' THEN concat('?', array_to_string(list_sort(list_distinct(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: regexp_replace(x, '=.*', '')))), '&')) ELSE '' END)"""
STRIPPED = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')"
HREFS = "regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, {KEY} AS canon_key FROM pages")
def canon_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.canon_key(F.col("url")).alias("canon_key"))


@query(f"SELECT page_id, regexp_extract(url, '^([a-z]+)', 1) AS scheme, {HOST} AS host, CASE WHEN url LIKE 'https%' THEN 443 ELSE 80 END::INTEGER AS port, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)', 1) AS fragment FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", u.scheme(url).alias("scheme"), u.host(url).alias("host"), u.port(url).alias("port"), u.part(url, 3).alias("path"), u.part(url, 4).alias("query"), u.part(url, 5).alias("fragment"))


@query(f"SELECT min(page_id) AS page_id, canon_key FROM (SELECT page_id, {KEY} AS canon_key FROM pages) GROUP BY canon_key")
def canon_dedup(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), u.canon_key(F.col("url")).alias("canon_key"))
    return frontier.distinct_keys(found).select(F.col("seq").alias("page_id"), "canon_key")


@query(f"SELECT template, count(*)::BIGINT AS n FROM (SELECT {TEMPLATE} AS template FROM pages) GROUP BY template")
def query_template_counts(spark, sf_dir):
    return reports.counts(table(spark, sf_dir, "pages").select(u.query_template(F.col("url")).alias("template")), "template")


@query(f"SELECT in_scope, count(*)::BIGINT AS n FROM (SELECT url LIKE 'https%' AND {HOST} = (SELECT min({HOST}) FROM pages WHERE url LIKE 'https%') AS in_scope FROM pages) GROUP BY in_scope")
def scope_partition(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(u.scope(F.col("url")).alias("s"))
    own = pages.filter("s.scheme = 'https'").agg(F.min("s.host")).first()[0]
    scope = F.struct(F.lit("https").alias("scheme"), F.lit(own).alias("host"), F.lit(443).alias("port"))
    return pages.groupBy((F.coalesce(F.col("s") == scope, F.lit(False))).alias("in_scope")).agg(F.count("*").alias("n"))


@query("""SELECT ext, count(*)::BIGINT AS n FROM (SELECT lower(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/][.]([^./]*)$', 1)) AS ext FROM pages
  UNION ALL SELECT unnest(['png', 'gz' || page_id, '', '']) FROM pages) GROUP BY ext""")
def url_ext_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    made = ("http://h/a/b{}.PNG?x=1", "http://h/a.tar.gz{}#x", "http://h/.env{}", "http://h/a.b/c{}")
    urls = F.array("url", *(F.concat(F.lit(a), F.col("page_id").cast("string"), F.lit(b)) for a, b in (x.split("{}") for x in made)))
    return reports.counts(pages.select(F.explode(urls).alias("url")).select(u.url_ext(F.col("url")).alias("ext")), "ext")


@query("SELECT page_id, 'http://h' || page_id || '/p?a=1%2B1&b=%25zz+x+' || page_id || '&c=%E4%BD%A0&d=~%2A' AS canon_key FROM pages")
def canon_escapes(spark, sf_dir):
    """Queries with escapes, some of which aren't any."""
    k = F.col("page_id").cast("string")
    url = F.concat(F.lit("HTTP://H"), k, F.lit(":80/p?b=%zz+x%20"), k, F.lit("&d=%7e*&a=1%2B1&c=%e4%bd%a0#f"))
    return table(spark, sf_dir, "pages").select("page_id", u.canon_key(url).alias("canon_key"))


@query(f"SELECT {HOST} AS host, sum(len(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)))::BIGINT AS n FROM pages GROUP BY ALL")
def html_comments(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(u.host(F.col("url")).alias("host"), F.size(surfaces.comments(F.col("html"))).alias("k"))
    return found.groupBy("host").agg(F.sum("k").cast("bigint").alias("n"))


@query(f"SELECT page_id, md5(x) AS md5, length(x)::BIGINT AS n FROM (SELECT page_id, regexp_replace({STRIPPED}, '<[^>]+>', '', 'g') AS x FROM pages)")
def html_text(spark, sf_dir):
    text = surfaces.tag_free(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.cast("binary")).alias("md5"), F.length(text).cast("bigint").alias("n"))


@query(f"SELECT page_id, length(regexp_replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g'))::BIGINT AS n FROM (SELECT page_id, regexp_replace({STRIPPED}, '<[^>]+>', '', 'g') AS x FROM pages)")
def html_text_unescaped(spark, sf_dir):
    text = surfaces.unescape(surfaces.tag_free(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(text).cast("bigint").alias("n"))


@query(f"SELECT name, count(*)::BIGINT AS n FROM (SELECT 'html_attr:' || lower(unnest(regexp_extract_all({STRIPPED}, '([\\w:-]+)\\s*=\\s*\"[^\"]+\"', 1))) AS name FROM pages) GROUP BY name")
def html_attrs(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(F.explode(surfaces.attributes(F.col("html"))).alias("a"))
    return reports.counts(found.select(F.col("a.sub").alias("name")), "name")


for _tag in ("script", "style"):

    def _inline(spark, sf_dir, tag=_tag):
        return table(spark, sf_dir, "pages").select("page_id", F.explode(surfaces.inline(F.col("html"), tag)).alias("body"))

    _inline.__name__ = f"inline_{_tag}"
    query(f"SELECT page_id, body FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<{_tag}\\b[^>]*>(.*?)</{_tag}>', 1)) AS body FROM pages) WHERE trim(body) <> ''")(_inline)


@query("SELECT page_id, unnest(regexp_extract_all(url || chr(10) || html, '(//[^\\n]*)', 1)) AS line FROM pages")
def comment_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(surfaces.line_comments(F.concat_ws("\n", "url", "html"))).alias("line"))


@query(r"""SELECT page_id, unnest(list_concat(regexp_extract_all(s, '"((?:\\.|[^"\\])*)"', 1), [page_id || '"', 'x' || page_id])) AS literal
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1)) AS s FROM pages)""")
def string_literals(spark, sf_dir):
    """Scripts have double quotes alone; literals in other quotes are put behind each."""
    scripts = table(spark, sf_dir, "pages").select("page_id", F.explode(surfaces.inline(F.col("html"), "script")).alias("s"))
    text = F.concat("s", F.lit(";a='"), "page_id", F.lit("\"';b=`x"), "page_id", F.lit("`"))
    return scripts.select("page_id", F.explode(surfaces.string_literals(text)).alias("literal"))


@query(f"SELECT page_id, href, count(*)::BIGINT AS n FROM (SELECT page_id, unnest({HREFS}) AS href FROM pages) GROUP BY ALL")
def a_href_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links.anchors(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target FROM (SELECT page_id, url, unnest({HREFS}) AS href FROM pages) WHERE href LIKE '/%'")
def resolved_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(links.anchors(F.col("html"))).alias("href")).filter("href like '/%'")
    return found.select("page_id", u.resolve(F.col("url"), F.col("href")).alias("target"))


@query("SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT page_id, ref FROM (SELECT page_id, unnest(regexp_extract_all(html, '[\"''`](/[^\"''`\\s<>)]+\\.[A-Za-z0-9]{1,8})[\"''`]', 1)) AS ref FROM pages))")
def byte_scan_root_ext(spark, sf_dir):
    place = [k for k, p in enumerate(links.PATTERNS) if p[0] == "root_ext"][0]
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(links.references(F.col("html"))).alias("h")).filter(F.col("h.place") == place)
    return found.select("page_id", "h.ref").distinct().agg(F.count("*").alias("n"))


SITE = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
#: The page's folder, which relative references begin in.
FOLDER = f"({SITE} || coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/'))"


@query(f"""WITH p AS (SELECT page_id AS id, {SITE} AS site, {FOLDER} AS folder FROM pages)
SELECT id, folder || 'm' || id || '.js.map' AS verbatim, 2 AS tier, 'm' || id || '.js.map' AS ref, 'sourcemap' AS how, '' AS hint FROM p
UNION ALL SELECT id, folder || 'i' || id || '.gif', 2, 'i' || id || '.gif', 'css_url', '' FROM p UNION ALL SELECT id, folder || 'c' || id || '.css', 2, 'c' || id || '.css', 'css_url', '' FROM p
UNION ALL SELECT id, site || '/abs' || id, 1, site || '/abs' || id, 'regex_fallback', 'tier1' FROM p UNION ALL SELECT id, site || '/x/b' || id || '.js', 2, '/x/b' || id || '.js', 'regex_fallback', 'tier2' FROM p
UNION ALL SELECT id, site || '/r' || id || '/s/', 2, '/r' || id || '/s/', 'regex_fallback', 'tier2' FROM p UNION ALL SELECT id, folder || 'd/p' || id || '.png', 3, 'd/p' || id || '.png', 'regex_fallback', 'tier3' FROM p
UNION ALL SELECT id, site || '/no' || id, 2, '/no' || id, 'regex_fallback', 'tier2' FROM p UNION ALL SELECT id, site || '/loc' || id, 2, site || '/loc' || id, 'regex_fallback', 'tier2' FROM p
UNION ALL SELECT id, folder || 'reports/m' || id, -1, 'reports/m' || id, 'regex_fallback', 'tier-1' FROM p""")
def byte_scan(spark, sf_dir):
    """Pages with a reference of each pattern before them, and one that is out of scope."""
    url, site = F.col("url"), F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    forms = "//# sourceMappingURL=m{k}.js.map\nurl(i{k}.gif) @import \"c{k}.css\" \"{site}/abs{k}\" '/x/b{k}.js' \"/r{k}/s/\" `d/p{k}.png`\nDisallow: /no{k}\n<loc>{site}/loc{k}</loc> load(\"reports/m{k}\") \"http://elsewhere.example/{k}\"\n"
    text = F.replace(F.replace(F.lit(forms), F.lit("{k}"), F.col("page_id").cast("string")), F.lit("{site}"), site)
    bodies = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), url.alias("base"), F.concat(text, "html").alias("text"), u.scope(url).alias("scope"))
    return links.byte_scan(bodies)


HARVEST = '<img src="/i{k}.png" alt="x"><div style="background:url(/b{k}.png)" data-src="img/{k}.jpg"><link rel="icon" href="/f{k}.ico"><meta http-equiv="refresh" content="3; url=/n{k}"></div>'
PLAIN = "regexp_replace(replace({}, '&quot;', '\"'), '&amp;?', '&', 'g')"


@query(f"""SELECT page_id, {PLAIN.format('ref')} AS ref, 'a_href' AS how, {PLAIN.format('hint')} AS hint FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS ref, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS hint FROM pages)
UNION ALL SELECT page_id, '/i' || page_id || '.png', 'img_src', '' FROM pages UNION ALL SELECT page_id, '/b' || page_id || '.png', 'css_url', 'inline style' FROM pages
UNION ALL SELECT page_id, 'img/' || page_id || '.jpg', 'data_attr', 'data-src' FROM pages UNION ALL SELECT page_id, '/f' || page_id || '.ico', 'link_rel', 'icon' FROM pages
UNION ALL SELECT page_id, '/n' || page_id, 'meta_refresh', '3; url=/n' || page_id FROM pages""")
def dom_harvest(spark, sf_dir):
    """Pages with references of other kinds behind them."""
    more = F.replace(F.lit(HARVEST), F.lit("{k}"), F.col("page_id").cast("string"))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(links.harvested(F.concat("html", more))["links"]).alias("x"))
    return found.select("page_id", "x.ref", "x.how", "x.hint")


@query("""SELECT page_id, unnest(['http://h/j/' || page_id, 'https://o/' || page_id, 'http://h/r' || page_id]) AS verbatim FROM pages WHERE page_id % 2 = 0""")
def json_links(spark, sf_dir):
    """Bodies of JSON made of the pages' ids; those of other types aren't looked through."""
    k = F.col("page_id").cast("string")
    text = F.to_json(F.struct(F.concat(F.lit("/j/"), k).alias("a"), F.array(F.concat(F.lit("https://o/"), k), F.concat(F.lit("/j/"), k)).alias("b"), F.struct(F.concat(F.lit("../r"), k).alias("d"), k.alias("e")).alias("c")))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("http://h/x/y.json").alias("base"), F.when(F.col("page_id") % 2 == 0, "application/json").otherwise("text/css").alias("content_type"), F.lit("").alias("ext"), text.alias("text"))
    return links.json_body_links(rows).select(F.col("id").alias("page_id"), "verbatim")


@query("SELECT 'json_value:$.k' AS sub, props->>'$.k' AS data, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def json_walk(spark, sf_dir):
    as_text = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k")))
    found = table(spark, sf_dir, "events").select(F.explode(surfaces.json_surfaces(as_text)).alias("s")).select("s.sub", "s.data")
    return found.groupBy("sub", "data").agg(F.count("*").alias("n"))


@query("SELECT doc_id, x AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9a-f]+)', 1)) AS x FROM documents) WHERE length(x) = 16")
def bare_hex16(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.bare_hex(F.col("text"))).alias("run"))


@query("SELECT doc_id, x AS run, md5(from_base64(x)) AS md5 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9+/]{32,}={0,2})', 1)) AS x FROM documents) WHERE length(x) % 4 = 0")
def base64_decoded(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(surfaces.base64_runs(F.col("text"))).alias("run"))
    return found.select("doc_id", "run", F.md5(F.try_to_binary("run", F.lit("base64"))).alias("md5"))


@query("""SELECT page_id, form, CASE WHEN form IN ('hex', 'codes', 'applied', 'named') THEN 'js_escape' ELSE form END AS sub, 'MARK' || lpad(page_id::VARCHAR, 8, '0') AS data
  FROM pages, unnest(['percent', 'css_escape', 'hex', 'codes', 'applied', 'named', 'html_entities', 'data_uri']) AS t(form)""")
def escapes(spark, sf_dir):
    """A value for each page, escaped in each way, and decoded."""
    value = F.concat(F.lit("MARK"), F.lpad(F.col("page_id").cast("string"), 8, "0"))
    each = lambda before, after: F.regexp_replace(F.hex(value.cast("binary")), "(..)", f"{before}$1{after}")
    codes = F.array_join(F.transform(F.filter(F.split(value, ""), lambda x: x != ""), F.ascii), ", ")
    forms = {
        "percent": each("%", ""), "css_escape": each(r"\\", " "), "hex": each(r"\\x", ""), "codes": F.concat(F.lit("String.fromCharCode("), codes, F.lit(")")),
        "applied": F.concat(F.lit("String.fromCharCode.apply(null, ["), codes, F.lit("])")), "named": F.concat(F.lit("var q = ["), codes, F.lit("]; String.fromCharCode.apply(null, q)")),
        "html_entities": each("&#x", ";"), "data_uri": F.concat(F.lit("data:text/plain;base64,"), F.base64(value.cast("binary"))),
    }
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("body")) for k, v in forms.items()))).alias("f"))
    found = rows.select("page_id", "f.form", F.explode(surfaces.decoded(F.col("f.body").cast("binary"))).alias("s"))
    return found.select("page_id", "form", F.regexp_replace("s.sub", "decoded:", "").alias("sub"), F.col("s.data").cast("string").alias("data"))


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}', 1)) AS value FROM documents")
def marker_strict(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 1)).alias("value"))


@query("""SELECT bucket, count(*)::BIGINT AS n FROM (SELECT unnest(['strict', 'strict', 'strict', 'needs_review', 'ruled_out', 'ruled_out']) AS bucket FROM pages
  UNION ALL SELECT 'strict' FROM (SELECT unnest(regexp_extract_all(text, '(token = \"[0-9a-f]{40}\")', 1)) FROM documents)) GROUP BY bucket""")
def marker_buckets(spark, sf_dir):
    """For each page hits of every kind, made of its id; and the documents' tokens as hits."""
    digits = F.lpad(F.hex("page_id"), 16, "0")
    forms = [F.concat(F.lit(a), x, F.lit(b)) for a, x, b in (("MARK{", F.lower(digits), "}"), ("MARK{", digits, "}"), ("MARK { ", digits, " }"), ("MARK{junk", digits, "}"), ("MARK{aaaaaaaaaaaaaaaa}", digits, ""), ("MARK{16 hexadecimal digits}", digits, ""))]
    own = table(spark, sf_dir, "pages").select(F.explode(F.array(*forms)).alias("t"))
    tokens = marker_strict(spark, sf_dir).select(F.concat(F.lit("MARK{"), F.substring("value", 1, 16), F.lit("}")).alias("t"))
    rows = own.union(tokens).select(F.lit("text").alias("sub"), F.col("t").cast("binary").alias("data"))
    return reports.counts(detect.sightings(rows, Rules(excluded={"MARK{aaaaaaaaaaaaaaaa}": "worked example"})), "bucket")


@query("SELECT doc_id, 'raw[utf-16-le]' AS how_found, 'MARK{' || substr(md5(doc_id::VARCHAR), 1, 16) || '}' AS canonical FROM documents")
def utf16_markers(spark, sf_dir):
    """Documents in UTF-16 with a value behind a character whose bytes aren't UTF-8, found in their raw surfaces."""
    text = F.concat(F.lit("苢MARK{"), F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16), F.lit("} "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sha256"), F.lit("text").alias("handler"), F.encode(text, "UTF-16LE").alias("content"))
    return detect.sightings(surfaces.expanded(rows)).filter("strict").select(F.col("sha256").alias("doc_id"), "how_found", "canonical")


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_by_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched rows, the first of a source referring to the others."""
    url = F.concat(F.lit("http://site/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), url.alias("url"), url.alias("canon_key"), F.lit("text/plain").alias("content_type"), F.lit("txt").alias("url_ext"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("length"), "source", "lang")


@query("""WITH b AS (SELECT doc_id, sha256(text) AS sha256, source FROM documents),
s AS (SELECT sha256, count(DISTINCT doc_id) AS urls, count(DISTINCT source) AS referrers FROM b GROUP BY sha256)
SELECT sha256, urls::BIGINT AS urls, referrers::BIGINT AS referrers, CASE WHEN urls > 1 THEN 'same_bytes_different_urls' ELSE 'same_url_multiple_referrers' END AS case FROM s WHERE urls > 1 OR referrers > 1""")
def duplication_case(spark, sf_dir):
    rows = _bodies(spark, sf_dir)
    edges = rows.select(F.col("source").alias("src"), F.col("canon_key").alias("dst"))
    return reports.duplication(rows, edges).select("sha256", F.col("n_urls").alias("urls"), F.col("n_referrers").alias("referrers"), "case")


@query("""WITH r AS (SELECT source, doc_id, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source AS content_type, count(*)::BIGINT AS n, sum(n)::BIGINT AS bytes, string_agg(CASE WHEN k <= 3 THEN 'http://site/' || doc_id END, ' ' ORDER BY k) AS examples, false AS handled FROM r GROUP BY source""")
def inventory(spark, sf_dir):
    return reports.inventory(_bodies(spark, sf_dir).withColumn("content_type", F.col("source"))).withColumn("examples", F.array_join("examples", " "))


@query("SELECT DISTINCT lang AS content_type FROM documents WHERE lang NOT IN ('en', 'de')")
def unhandled(spark, sf_dir):
    handled = spark.createDataFrame([("en",), ("de",)], "content_type string")
    return reports.unhandled(table(spark, sf_dir, "documents").select(F.col("lang").alias("content_type")), handled)


@query("SELECT sniffed, disagrees, count(*)::BIGINT AS n FROM (SELECT 'text/html' AS sniffed, false AS disagrees FROM pages UNION ALL SELECT CASE WHEN substr(hex(encode(text)), 8193, 1) IN ('8', '9', 'A', 'B') THEN 'application/octet-stream' ELSE 'text/plain' END, true FROM documents) GROUP BY ALL")
def signal_disagreement(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("html").cast("binary").alias("b"), F.lit("html").alias("ext"), F.lit("text/html").alias("header"))
    docs = table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("b"), F.lit("csv").alias("ext"), F.lit("text/csv").alias("header"))
    rows = pages.union(docs).withColumn("sniffed", ct.sniff_type(F.col("b")))
    return rows.groupBy("sniffed", ct.disagrees(F.col("ext"), F.col("header"), F.col("sniffed")).alias("disagrees")).agg(F.count("*").alias("n"))


@query("SELECT regexp_matches(text, '(?i)licensed under') AS blocked, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def blocked_notice(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(ct.blocked_notice(F.col("text"), Rules(blocked="licensed under")).alias("blocked")).agg(F.count("*").alias("n"))


EDGES = f"""(SELECT page_id AS seq, {HOST} AS src, unnest({HREFS}) AS dst, 'a_href' AS how FROM pages
  UNION ALL SELECT page_id, {HOST}, 'script', 'script_src' FROM pages WHERE html LIKE '%<script%' UNION ALL SELECT page_id, {HOST}, 'style', 'link_rel' FROM pages WHERE html LIKE '%<style%')"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), u.host(F.col("url")).alias("src"), "html")
    found = pages.select("seq", "src", F.explode(links.anchors(F.col("html"))).alias("dst"), F.lit("a_href").alias("how"))
    for tag, how in (("script", "script_src"), ("style", "link_rel")):
        found = found.union(pages.filter(F.col("html").contains(f"<{tag}")).select("seq", "src", F.lit(tag), F.lit(how)))
    return found


@query(f"SELECT how, count(*)::BIGINT AS n FROM {EDGES} GROUP BY how")
def how_counts(spark, sf_dir):
    return reports.counts(_edges(spark, sf_dir), "how")


@query(f"SELECT how, count(*)::BIGINT AS n, min(seq) AS first FROM {EDGES} WHERE how <> 'a_href' GROUP BY how ORDER BY n DESC, first, how LIMIT 5")
def top_non_anchor(spark, sf_dir):
    return reports.top(_edges(spark, sf_dir).filter("how <> 'a_href'"), "how", 5)


BFS = f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM (SELECT {HOST} AS src, unnest({HREFS}) AS dst FROM pages)), both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, depth) AS (SELECT min(src), 0 FROM e UNION SELECT b.dst, r.depth + 1 FROM r JOIN both_ways b ON b.src = r.node WHERE r.depth < 12),
d AS (SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node)"""


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "pages").select(u.host(F.col("url")).alias("src"), F.explode(links.anchors(F.col("html"))).alias("dst"))
    return graph.bfs(edges.union(edges.select("dst", "src")), edges.agg(F.min("src").alias("node")))


@query(f"{BFS} SELECT node, depth FROM d")
def bfs_depth(spark, sf_dir):
    return _depths(spark, sf_dir)


@query(f"{BFS} SELECT depth, count(*)::BIGINT AS n FROM d GROUP BY depth")
def depth_histogram(spark, sf_dir):
    return reports.counts(_depths(spark, sf_dir), "depth")


CAPS = f"""WITH p AS (SELECT page_id, {HOST} AS template, {HOST} NOT LIKE '%.net' AS in_scope, row_number() OVER (ORDER BY page_id) AS g FROM pages),
t AS (SELECT *, sum((in_scope AND g <= 200)::INT) OVER (PARTITION BY template ORDER BY page_id) AS k FROM p),
s AS (SELECT page_id, CASE WHEN NOT in_scope THEN 'out_of_scope' WHEN g > 200 THEN 'global' WHEN k > 3 THEN 'template' ELSE 'enqueued' END AS state FROM t)"""


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = u.host(F.col("url"))
    keys = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), host.alias("template"), (~host.endswith(".net")).alias("in_scope"))
    return frontier.capped(keys, 200, 3)


@query(f"{CAPS} SELECT page_id, state FROM s")
def frontier_caps(spark, sf_dir):
    return _capped(spark, sf_dir).select(F.col("seq").alias("page_id"), "state")


@query(f"{CAPS}, c AS (SELECT CASE state WHEN 'enqueued' THEN 'fetched' WHEN 'out_of_scope' THEN 'out_of_scope' ELSE 'errored' END AS state FROM s) SELECT d.state, count(c.state)::BIGINT AS n FROM (SELECT unnest(['fetched', 'errored', 'out_of_scope', 'duplicate_key']) AS state) d LEFT JOIN c USING (state) GROUP BY d.state")
def terminal_accounting(spark, sf_dir):
    state = F.when(F.col("state") == "enqueued", "fetched").when(F.col("state") == "out_of_scope", "out_of_scope").otherwise("errored")
    return frontier.accounting(_capped(spark, sf_dir).select(state.alias("state")))


@query(f"SELECT d.doc_id, x.value FROM documents d JOIN (SELECT DISTINCT sha256(text) AS h, unnest(regexp_extract_all(text, '{TOKEN}', 1)) AS value FROM documents) x ON sha256(d.text) = x.h")
def fan_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "text")
    once = docs.filter(F.col("text").contains("token = ")).dropDuplicates(["sha256"]).select("sha256", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), 1))).alias("value"))
    return docs.select("doc_id", "sha256").join(once, "sha256").select("doc_id", "value")


WORDS = "unnest(list_distinct(regexp_extract_all({}, '([A-Za-z]{{12,}})', 1)))"


@query(f"""WITH c AS (SELECT page_id, 'raw' AS corpus, {WORDS.format('html')} AS w FROM pages UNION ALL SELECT page_id, 'rendered', {WORDS.format(f"regexp_replace({STRIPPED}, '<[^>]+>', '', 'g')")} FROM pages)
SELECT page_id::VARCHAR AS url, w AS canonical, min(corpus) || '_only' AS corpus FROM c GROUP BY page_id, w HAVING count(DISTINCT corpus) = 1""")
def corpus_divergence(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    words = lambda x: F.explode(F.array_distinct(F.regexp_extract_all(x, F.lit("([A-Za-z]{12,})"), 1)))
    raw = pages.select("url", F.lit("raw").alias("corpus"), words(F.col("html")).alias("canonical"))
    return detect.divergence(raw.union(pages.select("url", F.lit("rendered"), words(surfaces.tag_free(F.col("html"))))))


@query("SELECT 'header:x-note' AS how_found, min(page_id) AS seq, min(value) AS canonical, key AS canon_key FROM (SELECT page_id, (page_id % 7)::VARCHAR AS key, 'MARK{' || lpad(((page_id % 7) * 3)::VARCHAR, 16, '0') || '}' AS value FROM pages) GROUP BY key")
def header_dedup(spark, sf_dir):
    key = F.col("page_id") % 7
    value = F.concat(F.lit("x MARK{"), F.lpad((key * 3).cast("string"), 16, "0"), F.lit("}"))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", key.cast("string").alias("canon_key"), F.lit("").alias("sha256"), F.create_map(F.lit("x-note"), value, F.lit("etag"), F.lit("none")).alias("headers"))
    return detect.header_sightings(rows).select("how_found", "seq", "canonical", "canon_key")


@query(f"""WITH p AS (SELECT page_id, {SITE} AS site, {FOLDER} AS folder FROM pages)
SELECT page_id, 'http_link_header' AS how, 'next' AS hint, site || '/p' || page_id AS verbatim FROM p UNION ALL SELECT page_id, 'http_link_header', '', folder || 'x' || page_id FROM p
UNION ALL SELECT page_id, 'http_header:x-next', '', 'https://o' || page_id || '/z' FROM p UNION ALL SELECT page_id, 'http_header:x-next', '', site || '/f' || page_id || '.zip' FROM p""")
def header_links(spark, sf_dir):
    """Headers made of the pages' ids."""
    k = F.col("page_id").cast("string")
    made = lambda x: F.replace(F.lit(x), F.lit("{k}"), k)
    headers = F.create_map(F.lit("Link"), made('</p{k}>; rel="next", <x{k}>'), F.lit("x-next"), made('at "https://o{k}/z" or "/f{k}.zip", not /g{k}.zip'), F.lit("location"), made('"/gone{k}.zip"'))
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", headers.alias("headers"))
    return links.header_links(rows).select(F.col("seq").alias("page_id"), "how", "hint", "verbatim")


@query("SELECT page_id::VARCHAR AS sha256, CASE WHEN page_id % 3 < 2 THEN 'MARK{' || substr(md5(page_id::VARCHAR), 1, 16) || '}' END AS canonical FROM pages")
def ocr_vote(spark, sf_dir):
    """Three reads of a value for each page: with digits taken for letters, with a place wrong in each, or all different."""
    own, third = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 16), F.col("page_id") % 3
    wrong = lambda k: F.concat(F.substring(own, 1, k - 1), F.lit("x"), F.substring(own, k + 1, 16))
    reads = [
        ("gray", F.when(third == 0, F.replace(own, F.lit("0"), F.lit("O"))).when(third == 1, wrong(3)).otherwise(F.repeat(F.lit("a"), 16))),
        ("up", F.when(third == 0, F.replace(own, F.lit("1"), F.lit("l"))).when(third == 1, wrong(7)).otherwise(F.repeat(F.lit("b"), 16))),
        ("bin", F.when(third == 0, F.lit("noise")).when(third == 1, wrong(9)).otherwise(F.repeat(F.lit("c"), 16))),
    ]
    passes = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.concat(F.lit("MARK{"), x, F.lit("}")).alias("text")) for n, x in reads))).alias("r")
    return images.ocr_consensus(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("sha256"), passes).select("sha256", "r.*"))


@F.pandas_udf(T.BinaryType())
def _painted(key: pd.Series, value: pd.Series) -> pd.Series:
    """32 x 32 pixels (BGR) for a key: a ramp, a ramp with the value in the fourth row of its red, or noise."""
    y, x = np.mgrid[:32, :32]
    out = []
    for k, v in zip(key, value):
        a = np.stack([(1 + k % 4) * (x + y), 4 * y, 4 * x], 2).astype(np.uint8)
        if k % 3 == 1:
            a[:, :, 2].reshape(-1)[100 : 100 + len(v)] = list(v.encode())
        out.append(a.tobytes() if k % 3 < 2 else np.random.default_rng(k).integers(0, 256, a.shape).astype(np.uint8).tobytes())
    return pd.Series(out)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each nation, as Spark's image struct."""
    key = F.col("n_nationkey").cast("long")
    value = F.concat(F.lit("MARK{"), F.substring(F.md5(key.cast("string").cast("binary")), 1, 16), F.lit("}"))
    parts = [key.cast("string").alias("origin"), *(F.lit(v).alias(n) for n, v in (("height", 32), ("width", 32), ("nChannels", 3), ("mode", 16))), _painted(key, value).alias("data")]
    return table(spark, sf_dir, "nation").select(key.cast("string").alias("sha256"), F.struct(*parts).alias("image"))


@query("""SELECT n_nationkey::VARCHAR AS sha256, 376::BIGINT AS candidates_tried, CASE WHEN n_nationkey % 3 = 1 THEN 2 ELSE 0 END::BIGINT AS candidates_with_hits,
  CASE WHEN n_nationkey % 3 = 1 THEN 'payload-found' ELSE 'swept-and-clean' END AS ruling, CASE WHEN n_nationkey % 3 = 1 THEN 'MARK{' || substr(md5(n_nationkey::VARCHAR), 1, 16) || '}' END AS canonical FROM nation""")
def pixel_grid(spark, sf_dir):
    """Values in a part of a row of red pixels, which two scan orders run along: rows and the border's rings."""
    swept = images.sweep(_images(spark, sf_dir))
    found = images.pixel_sightings(swept).filter("strict").select("sha256", "canonical").distinct()
    return images.reports(swept).join(found, "sha256", "left")


@query("SELECT n_nationkey::VARCHAR AS sha256, n_nationkey % 3 = 0 AS is_ramp, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE -1 END::INTEGER AS deviating_px, CASE WHEN n_nationkey % 3 = 0 THEN 'ramp' ELSE 'no ramp' END AS explanation FROM nation")
def plane_fit(spark, sf_dir):
    return images.fits(_images(spark, sf_dir)).select("sha256", "is_ramp", "deviating_px", "explanation")


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS b, p_type AS t FROM part)
SELECT id, 'xml_text:b' AS sub, b AS data FROM p UNION ALL SELECT id, 'xml_comment', ' ' || t || ' ' FROM p UNION ALL SELECT id, 'raw', '<a><b>' || b FROM p
UNION ALL SELECT id, 'csv_cell:r0c0', id::VARCHAR FROM p UNION ALL SELECT id, 'csv_cell:r0c1', b || ',' || t FROM p UNION ALL SELECT id, 'csv_cell:r1c0', t FROM p
UNION ALL SELECT id, 'sourcemap:s' || id || '.js', t FROM p UNION ALL SELECT id, 'sourcemap:sourcesContent[1]', b FROM p
UNION ALL SELECT id, 'raw', '{"sources":["s' || id || '.js"],"sourcesContent":["' || t || '","' || b || '"]}' FROM p""")
def structured_surfaces(spark, sf_dir):
    """Bodies made of the parts' columns: XML, XML that breaks off, CSV and source maps."""
    made = lambda x: F.replace(F.replace(F.replace(F.lit(x), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{b}"), F.col("p_brand")), F.lit("{t}"), F.col("p_type"))
    forms = [("xml", "<a><b>{b}</b><!-- {t} --></a>"), ("xml", "<a><b>{b}"), ("csv", '{k},"{b},{t}"\n{t},\n'), ("sourcemap", '{"sources":["s{k}.js"],"sourcesContent":["{t}","{b}"]}')]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sha256"), F.explode(F.array(*(F.struct(F.lit(h).alias("handler"), made(x).cast("binary").alias("content")) for h, x in forms))).alias("f"))
    found = surfaces.expanded(rows.select("sha256", "f.*"))
    return found.select(F.col("sha256").alias("id"), "sub", F.col("data").cast("string").alias("data"))


#: Pages have no single quotes, escapes, or comments in scripts and styles; payloads in base64 are taken to hold no hit.
SURFACES = f"""WITH d AS (SELECT DISTINCT html FROM pages),
script AS (SELECT unnest(regexp_extract_all(html, '(?is)<script\\b[^>]*>(.*?)</script>', 1)) AS x FROM d), style AS (SELECT unnest(regexp_extract_all(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1)) AS x FROM d),
attr AS (SELECT unnest(regexp_extract_all({STRIPPED}, '([\\w:-]+)\\s*=\\s*"([^"]*)"', 1)) AS name, unnest(regexp_extract_all({STRIPPED}, '([\\w:-]+)\\s*=\\s*"([^"]*)"', 2)) AS x FROM d),
s AS (SELECT 'raw' AS sub, html AS x FROM d UNION ALL SELECT 'html_comment', unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) FROM d
  UNION ALL SELECT 'html_text', regexp_replace(replace(replace(replace(regexp_replace({STRIPPED}, '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') FROM d
  UNION ALL SELECT 'html_attr:' || lower(name), x FROM attr WHERE x <> '' UNION ALL SELECT 'inline_script:raw', x FROM script UNION ALL SELECT 'inline_style:raw', x FROM style
  UNION ALL SELECT 'inline_script:string_literal', unnest(regexp_extract_all(x, '"([^"]*)"', 1)) FROM script UNION ALL SELECT 'inline_script:comment_line', unnest(regexp_extract_all(x, '(//[^\\n]*)', 1)) FROM script
),
run AS (SELECT unnest(regexp_extract_all(html, '([A-Za-z0-9+/]{{32,}}={{0,2}})', 1)) AS x FROM d),
t AS (SELECT sub, x, octet_length(encode(x)) AS size FROM s UNION ALL SELECT 'decoded:base64', '', octet_length(from_base64(x)) FROM run WHERE length(x) % 4 = 0)"""


@query(f"""{SURFACES}
SELECT sub, count(*)::BIGINT AS n, sum(size)::BIGINT AS bytes, sum(len(regexp_extract_all(x, 'p\\{{[0-9a-f]{{16}}\\}}')))::BIGINT AS strict,
  sum(len(regexp_extract_all(x, 'p\\s*\\{{[^}}]{{0,80}}\\}}')) - len(regexp_extract_all(x, 'p\\{{[0-9a-f]{{16}}\\}}')))::BIGINT AS needs_review, 0::BIGINT AS ruled_out FROM t GROUP BY sub""")
def page_sightings(spark, sf_dir):
    """By surface, of all pages: their number and bytes, and the sightings of a pattern that page texts hold, by bucket."""
    bodies = table(spark, sf_dir, "pages").select(F.sha2("html", 256).alias("sha256"), F.lit("html").alias("handler"), F.col("html").cast("binary").alias("content")).dropDuplicates(["sha256"])
    return detect.totals(surfaces.expanded(bodies), Rules(prefix="p"))


@query(f"""{BFS}, n AS (SELECT src AS node FROM {EDGES} UNION SELECT dst FROM {EDGES})
SELECT 0::INTEGER AS place, 'digraph site {{' AS line UNION ALL SELECT 1, '  rankdir=LR;' UNION ALL SELECT 2, '  node [fontname="Helvetica"];' UNION ALL SELECT 5, '}}'
UNION ALL SELECT 3, '  "' || node || '" [label="' || node || coalesce('\\n(d=' || depth || ')', '') || '", shape=ellipse, style=filled, fillcolor="' || CASE WHEN node LIKE '/%' THEN 'lightblue' ELSE 'white' END || '"];' FROM n LEFT JOIN d USING (node)
UNION ALL SELECT 4, '  "' || src || '" -> "' || dst || '" [label="' || how || '", color=' || CASE how WHEN 'a_href' THEN 'black, style=solid' WHEN 'script_src' THEN 'darkorange, style=solid' ELSE 'darkgreen, style=dashed' END || '];' FROM {EDGES}""")
def dot_export(spark, sf_dir):
    edges = _edges(spark, sf_dir).select("src", "dst", "how")
    depths = _depths(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(depths, "node", "left")
    return graph.dot_lines(nodes.select("node", F.lit("fetched").alias("state"), F.when(F.col("node").startswith("/"), "text/html").otherwise("").alias("content_type"), "depth"), edges)


SEEDED = [f"http://h{x}" for x in DECLARED]
#: Page k refers to 2k + 1 and 2k + 2, as in a heap; a scan of every tenth one finds a key of its own.
TREE = """WITH c AS (SELECT count(*) AS n FROM pages), k AS (SELECT k, floor(log2(k + 1))::INTEGER AS depth, k < n AS captured FROM c, unnest(generate_series(0, 2 * n)) AS t(k))"""


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A crawl of a site with a page for each page, numbered from 0 as they are."""
    key = lambda x: F.concat(F.lit("http://h/"), x.cast("string"))
    rows = frontier.ranked(table(spark, sf_dir, "pages").select("page_id"), "page_id").select((F.col("rank") - 1).alias("k"))
    captured = rows.select(key(F.col("k")).alias("canon_key"), key(F.col("k")).alias("url"), key(F.col("k")).alias("final_url"), F.lit(200).alias("status"))
    dom = rows.select(key(F.col("k")).alias("src"), F.posexplode(F.array(key(2 * F.col("k") + 1), key(2 * F.col("k") + 2))).alias("place", "dst_url"), F.lit("a_href").alias("how"), F.lit("").alias("hint"))
    scanned = rows.filter("k % 10 = 0").select(key(F.col("k")).alias("src"), F.concat(F.lit("http://h/s"), F.col("k").cast("string")).alias("dst_url"), F.lit("json_value").alias("how"), F.lit("").alias("hint"), F.lit(0).alias("place"))
    return crawl.crawl("http://h/0", captured, dom, scanned, Rules(max_keys=1 << 60, max_per_template=1 << 60))


@query(f"""{TREE} SELECT 'http://h/' || k AS canon_key, depth, CASE WHEN captured THEN 'fetched' ELSE 'errored' END AS state FROM k
UNION ALL SELECT 'http://h/s' || k, depth + 1, 'errored' FROM k WHERE captured AND k % 10 = 0 UNION ALL SELECT unnest({SEEDED}), 1, 'errored'""")
def crawl_fixpoint(spark, sf_dir):
    return _crawled(spark, sf_dir)[0].select("canon_key", "depth", "state")


@query(f"""{TREE} SELECT 'http://h/' || k AS src, 'http://h/' || (2 * k + 1 + j) AS dst, 'a_href' AS how, '' AS hint, depth FROM k, unnest([0, 1]) AS t(j) WHERE captured
UNION ALL SELECT 'http://h/' || k, 'http://h/s' || k, 'json_value', '', depth FROM k WHERE captured AND k % 10 = 0 UNION ALL SELECT 'http://h/0', unnest({SEEDED}), 'seed', 'declared-path', 0""")
def crawl_edges(spark, sf_dir):
    return _crawled(spark, sf_dir)[1]


DIGITS = "substr(md5(({})::VARCHAR), 1, 16)"


def _value(key) -> F.Column:
    return F.concat(F.lit("MARK{"), F.substring(F.md5(key.cast("string").cast("binary")), 1, 16), F.lit("}"))


@query(f"""SELECT url, {KEY} AS canon_key, CASE WHEN page_id % 4 <> 2 THEN CASE WHEN page_id % 5 = 0 THEN 'http://other/' || page_id ELSE url END END AS final_url, CASE page_id % 4 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END::INTEGER AS status,
  CASE WHEN page_id % 4 <> 2 THEN 'text/html' END AS content_type, CASE WHEN page_id % 4 <> 2 THEN 'text/html' END AS sniffed_type, CASE WHEN page_id % 4 <> 2 THEN sha256(html) END AS sha256,
  CASE WHEN page_id % 4 <> 2 THEN octet_length(encode(html)) END::BIGINT AS length, CASE WHEN page_id % 4 <> 2 THEN regexp_matches(html, '(?i)only visible to') END AS blocked_notice, (page_id % 3)::INTEGER AS first_seen_depth FROM pages""")
def fetch_records(spark, sf_dir):
    """Manifest rows of captures made of the pages, some of which failed or were redirected."""
    k, ok = F.col("page_id"), F.col("page_id") % 4 != 2
    status = F.when(k % 4 == 1, 404).when(~ok, 503).otherwise(200)
    final = F.when(k % 5 == 0, F.concat(F.lit("http://other/"), k.cast("string"))).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("url", final.alias("final_url"), status.alias("status"), F.create_map(F.lit("Content-Type"), F.lit("Text/HTML; charset=utf-8")).alias("headers"), F.when(ok, F.col("html").cast("binary")).alias("content"), F.when(~ok, "failed").alias("error"), (k % 3).cast("int").alias("depth"), F.lit(0).alias("retries"))
    return artifacts.records(rows).select("url", "canon_key", "final_url", "status", "content_type", "sniffed_type", "sha256", "length", "blocked_notice", "first_seen_depth")


@query(f"""SELECT url, 'http://other/' || page_id AS final_url, true AS out_of_scope FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, {SITE} || '/moved', false FROM pages WHERE page_id % 3 = 1""")
def redirects(spark, sf_dir):
    k, site = F.col("page_id"), F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    final = F.when(k % 3 == 0, F.concat(F.lit("http://other/"), k.cast("string"))).when(k % 3 == 1, F.concat(site, F.lit("/moved"))).otherwise(F.col("url"))
    return reports.redirects(table(spark, sf_dir, "pages").select("url", final.alias("final_url")))


@query("""WITH a AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 500 WHEN 2 THEN 404 ELSE 200 END IN (500, 503) AS again, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
t AS (SELECT user_id, bool_or(again AND k = 1) AS first, bool_or(again AND k = 2) AS second, count(*) AS n FROM a WHERE k <= 2 GROUP BY user_id)
SELECT user_id::VARCHAR AS canon_key, CASE WHEN first AND (second OR n = 1) THEN 'errored' ELSE 'fetched' END AS state, CASE WHEN first AND second THEN 2 WHEN first AND n = 1 THEN 1 ELSE 0 END::INTEGER AS retries FROM t""")
def fetch_outcomes(spark, sf_dir):
    """Events stand in for attempts, users for keys."""
    status = F.when(F.col("event_id") % 5 == 0, 503).when(F.col("event_id") % 5 == 1, 500).when(F.col("event_id") % 5 == 2, 404).otherwise(200)
    return frontier.outcomes(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("canon_key"), status.alias("status"), F.lit(None).cast("string").alias("error")))


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS carriers, 'http://site/' || min(doc_id) AS first, max(octet_length(encode(text)))::BIGINT AS length FROM documents WHERE text IS NOT NULL GROUP BY 1")
def manifest_round_trip(spark, sf_dir):
    """Documents as a manifest of JSON lines in order, appended to the checkpoint folder and read again: each body's carriers and first row."""
    graph.ensure_checkpoints(docs := table(spark, sf_dir, "documents"))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/manifest-{uuid.uuid4().hex}"
    rows = docs.filter("text is not null").orderBy("doc_id").select(F.concat(F.lit("http://site/"), F.col("doc_id").cast("string")).alias("url"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("length"))
    artifacts.append_jsonl(rows, path)
    manifest = artifacts.read_jsonl(spark, path, artifacts.MANIFEST)
    first = artifacts.first_rows(manifest).select("sha256", F.col("url").alias("first"), "length")
    return first.join(artifacts.fetched(manifest).groupBy("sha256").agg(F.count("*").alias("carriers")), "sha256")


@query("SELECT DISTINCT sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS length FROM documents WHERE text IS NOT NULL")
def content_store(spark, sf_dir):
    bodies = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("text").cast("binary").alias("content"))
    return artifacts.content_addressed(bodies).select("sha256", F.octet_length("content").cast("bigint").alias("length"))


def _capture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, blobs): documents carry a hundred bodies with a value each; every tenth has a rendering, every fiftieth a header with one."""
    k, text = F.col("doc_id"), F.concat(F.lit("body "), _value(F.col("doc_id") % 100))
    shot = F.when(k % 10 == 0, F.concat(F.lit("<p>"), _value(k % 100 + F.when(k % 20 == 0, 1000).otherwise(0)), F.lit("</p>")))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("body"), shot.alias("shot"))
    headers = F.when(k % 50 == 0, F.create_map(F.lit("x-note"), _value(k + 2000))).otherwise(F.create_map().cast("map<string,string>"))
    url = F.concat(F.lit("http://site/"), k.cast("string"))
    manifest = rows.select(k.alias("seq"), url.alias("url"), url.alias("canon_key"), F.lit("text/plain").alias("content_type"), F.lit("").alias("url_ext"), F.sha2("body", 256).alias("sha256"), F.sha2("shot", 256).alias("rendered_sha256"), F.lit(None).cast("string").alias("interacted_sha256"), headers.alias("headers"))
    return manifest, artifacts.content_addressed(rows.select(F.explode(F.array("body", "shot")).alias("x")).filter("x is not null").select(F.col("x").cast("binary").alias("content")))


@query(f"""WITH d AS (SELECT 'http://site/' || doc_id AS url, doc_id AS k FROM documents)
SELECT 'MARK{{' || {DIGITS.format('k % 100')} || '}}' AS canonical, url, 'text/plain:raw' AS how_found FROM d
UNION ALL SELECT 'MARK{{' || {DIGITS.format('k % 100 + CASE WHEN k % 20 = 0 THEN 1000 ELSE 0 END')} || '}}', url, 'rendered:' || unnest(['html_text', 'raw']) FROM d WHERE k % 10 = 0
UNION ALL SELECT 'MARK{{' || {DIGITS.format('k + 2000')} || '}}', url, 'header:x-note' FROM d WHERE k % 50 = 0""")
def secrets(spark, sf_dir):
    """Bodies are looked through once each, what is found holds for every carrier; snapshots and headers are looked through as well."""
    return extraction.results(*_capture(spark, sf_dir))["secrets"].select("canonical", "url", "how_found")


@query(f"""WITH d AS (SELECT 'http://site/' || doc_id AS url, doc_id AS k FROM documents WHERE doc_id % 20 = 0)
SELECT 'MARK{{' || {DIGITS.format('k % 100')} || '}}' AS canonical, url, 'raw_only' AS corpus FROM d UNION ALL SELECT 'MARK{{' || {DIGITS.format('k % 100 + 1000')} || '}}', url, 'rendered_only' FROM d""")
def divergences(spark, sf_dir):
    return extraction.results(*_capture(spark, sf_dir))["divergences"].select("canonical", "url", "corpus")


@query(f"""SELECT min(n)::BIGINT AS n_rows, count(DISTINCT v)::BIGINT AS distinct_strict, count(DISTINCT v) >= 8 AS count_met FROM (SELECT {DIGITS.format('doc_id % 100')} AS v, 0 AS n FROM documents
  UNION ALL SELECT {DIGITS.format('doc_id % 100 + CASE WHEN doc_id % 20 = 0 THEN 1000 ELSE 0 END')}, 0 FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT {DIGITS.format('doc_id + 2000')}, 0 FROM documents WHERE doc_id % 50 = 0)""")
def distinct_strict(spark, sf_dir):
    """What the extraction's document says of its values, and how many rows are unhandled."""
    tables = extraction.results(*_capture(spark, sf_dir))
    head = json.loads(next(iter(extraction.document(tables))).rstrip(",") + "}")
    return tables["unhandled_types"].agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(head["distinct_strict"]).cast("bigint").alias("distinct_strict"), F.lit(head["count_met"]).alias("count_met"))


@query("SELECT DISTINCT 'reports/m' || page_id % 40 AS ref FROM pages")
def review_refs(spark, sf_dir):
    url = F.col("url")
    text = F.concat(F.lit('load("reports/m'), (F.col("page_id") % 40).cast("string"), F.lit('") "a/b.js" "/c/d/"'))
    return links.review(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), url.alias("base"), text.alias("text"), u.scope(url).alias("scope")))


@query("SELECT url AS canon_key FROM (SELECT DISTINCT url FROM pages WHERE page_id % 7 = 3) ORDER BY 1 LIMIT 10")
def unaccounted_keys(spark, sf_dir):
    """The first keys without a terminal state, in order."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("canon_key"), "page_id")
    states = pages.select("canon_key", F.when(F.col("page_id") % 7 != 3, "fetched").alias("state"))
    return frontier.unaccounted(pages.select("canon_key").distinct(), states)


@query("""SELECT page_id, t AS content_type, h AS handler FROM pages JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS k,
  unnest(['text/html', 'text/css', 'application/json', 'image/svg+xml', 'image/png', 'application/pdf', 'text/csv', 'video/mp4', '', 'text/vtt']) AS t, unnest(['html', 'code', 'json', 'xml', 'raster', 'pdf', 'csv', NULL, NULL, 'text']) AS h) ON page_id % 10 = k""")
def handlers(spark, sf_dir):
    """Header values of ten types, and what their bodies are expanded by."""
    values = ["Text/HTML; charset=utf-8", " text/css ", "application/json;x", "image/svg+xml", "image/png", "application/pdf", "text/csv; header=present", "video/mp4", "", "text/vtt"]
    kind = ct.header_type(F.array(*map(F.lit, values))[(F.col("page_id") % 10).cast("int")])
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("content_type"), ct.handler(kind, F.lit("")).alias("handler"))


@query("SELECT p_partkey AS id, 'pdf_text' AS sub, '(' || p_brand || ')' AS data FROM part UNION ALL SELECT p_partkey, 'pdf_text', p_type FROM part")
def pdf_strings(spark, sf_dir):
    """Strings of text objects, parentheses escaped in some."""
    body = F.concat(F.lit("%PDF-1.4 (not) BT (\\("), "p_brand", F.lit("\\)) Tj ET (nor) BT\n("), "p_type", F.lit(") Tj ET"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sha256"), F.lit("pdf").alias("handler"), body.cast("binary").alias("content"))
    return surfaces.expanded(rows).filter("sub = 'pdf_text'").select(F.col("sha256").alias("id"), "sub", F.col("data").cast("string").alias("data"))


@F.pandas_udf(T.BinaryType())
def _png(text: pd.Series) -> pd.Series:
    """A PNG's signature, a text chunk, and its end."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return text.map(lambda t: b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"note\0" + t.encode()) + chunk(b"IEND", b""))


@query(f"""SELECT c_custkey::VARCHAR AS sha256, 'MARK{{' || {DIGITS.format('c_custkey')} || '}}' AS raw, 'strict' AS bucket FROM customer
UNION ALL SELECT c_custkey::VARCHAR, 'FRAGMENT:' || {DIGITS.format('c_custkey')}, 'ruled_out' FROM customer""")
def image_texts(spark, sf_dir):
    """Values in images' text chunks, each once for an image, and bare runs of digits beside them."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha256"), _png(_value(F.col("c_custkey"))).alias("content"))
    return images.metadata_sightings(rows).select("sha256", "raw", "bucket").distinct()
