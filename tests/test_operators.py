"""Cases for operators, each a literal input and what is expected of it."""

import hashlib
import json
import random
import re
import struct
import zlib
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweb import rules
from strataweb.functions import content, url
from strataweb.operators import detect, images, links, metadata, surfaces
from strataweb.plans import frontier, graph, reports
from strataweb.rules import Rules

M = "MARK{0123456789abcdef}"


def one(spark, column, **values):
    return spark.range(1).select(column(*(F.lit(v) for v in values.values()))).first()[0]


@pytest.mark.parametrize("raw,key", [("HTTP://EXAMPLE.COM/Path", "http://example.com/Path"), ("http://h:80/a", "http://h/a"), ("https://h:443/a", "https://h/a"), ("http://h:8080/a", "http://h:8080/a"), ("http://h/a#f", "http://h/a"), ("http://h/a?b=2&a=1", "http://h/a?a=1&b=2"), ("http://h/a?x=", "http://h/a?x="), ("http://h/a?x", "http://h/a?x="), ("http://h/a/b/../c", "http://h/a/c"), ("http://h/page/", "http://h/page/"), ("http://h", "http://h"), ("http://h/a?q=a%20b*~", "http://h/a?q=a+b%2A~")])
def test_canon_key(spark, raw, key):
    assert one(spark, url.canon_key, u=raw) == key


def test_canonical_query_against_the_library(spark):
    rng = random.Random(1)
    rows = ["&".join("".join(rng.choice("ab=%+ ~*&é") for _ in range(rng.randint(0, 6))) for _ in range(3)) for _ in range(300)]
    rows += ["a=%zz+b%20c", "%", "%4", "%zz=%E4%B8", "x=%ff%41%", "a=1%2B1&a=1+1", "é=%C3%A9"]
    got = spark.createDataFrame([(q,) for q in rows], "q string").select("q", url.canonical_query(F.col("q")).alias("k")).collect()
    for r in got:
        assert r.k == urlencode(sorted(parse_qsl(r.q, keep_blank_values=True)), encoding="utf-8"), r.q


@pytest.mark.parametrize("ref,out", [("a.png", "http://h/x/a.png"), ("/x/y", "http://h/x/y"), ("http://o/z", "http://o/z"), ("../u", "http://h/u"), ("javascript:x", None), ("mailto:a@b", None), ("data:,x", None), ("#f", None), ("", None)])
def test_resolve(spark, ref, out):
    assert one(spark, url.resolve, b="http://h/x/1", r=ref) == out
    if out:
        assert urlsplit(urljoin("http://h/x/1", ref)).netloc


def test_scope_and_template(spark):
    assert one(spark, url.in_scope, a="http://h:80/x", b=None) is False
    assert tuple(one(spark, url.scope, a="https://H/x")) == ("https", "h", 443)
    assert one(spark, url.query_template, a="http://h/report/?page=3") == "/report/?page"
    assert one(spark, url.query_template, a="http://h/x?b=1&a=2&b=3") == "/x?a&b"
    assert one(spark, url.url_ext, a="http://h/a.PNG?x") == "png" and one(spark, url.url_ext, a="http://h/.env") == ""


@pytest.mark.parametrize("body,kind", [(b"\x89PNG\r\n\x1a\nx", "image/png"), (b"GIF89a", "image/gif"), (b"", "text/plain"), (b" <!DOCTYPE html>", "text/html"), (b"<?xml ?><svg/>", "image/svg+xml"), (b"\xff\xfe\x00", "application/octet-stream"), (b'{"a":1}', "application/json"), (b"%PDF-1", "application/pdf"), (b"<?xml ?>" + b" " * 612 + b"<svg/>", "application/xml"), (b" " * 600 + b"<html>", "text/plain"), (b"\x00\x01\x00\x00\x00", "font/ttf")])
def test_sniff(spark, body, kind):
    assert spark.range(1).select(content.sniff_type(F.lit(bytearray(body)))).first()[0] == kind


def test_signals(spark):
    ask = lambda *v: one(spark, content.disagrees, **dict(zip("abc", v)))
    assert ask("png", "text/html", "text/html") and ask("", "application/octet-stream", "application/pdf")
    assert not ask("png", "image/png", "image/png") and not ask("", "text/html", "text/html")


def test_html_surfaces(spark):
    page = f'<p class="c">MARK{{0123<span>4567</span>89abcdef}}</p><!-- n --><i style="display:none">h</i><script>/* c */ var a = "s"; // l\n</script>'
    got = {(s.sub, s.data) for s in spark.createDataFrame([(page,)], "t string").select(surfaces.html_surfaces(F.col("t")).alias("s")).first().s}
    assert ("html_comment", " n ") in got and ("html_hidden", "h") in got and ("html_attr:class", "c") in got
    assert any(s == "html_text" and M in d for s, d in got)
    assert {("inline_script:comment_block", " c "), ("inline_script:string_literal", "s"), ("inline_script:comment_line", "// l")} <= got


def test_json_and_decoders(spark):
    assert surfaces._json('{"a":["x",1,{"b":"y"}]}') == [("json_value:$.a[0]", "x"), ("json_value:$.a[2].b", "y")]
    assert surfaces._json("{") == [("raw", "{")]
    assert surfaces._csv("a,\nb\rc,d\n") == [("csv_cell:r0c0", "a"), ("raw", "a,\nb\rc,d\n")]
    assert dict(surfaces.decoded_variants("String.fromCharCode(77,65,82,75)")) == {"decoded:js_escape": b"MARK"}
    assert surfaces.decoded_variants(r"\110000 \110000 \110000 \110000") == []


def test_sightings(spark):
    rows = [("text", M.encode()), ("text", b"MARK{0123456789ABCDEF}"), ("text", b"MARK{junk}"), ("raw", M.encode("utf-16-le"))]
    got = detect.sightings(spark.createDataFrame([(s, bytearray(d)) for s, d in rows], "sub string, data binary"), Rules()).collect()
    assert sorted((r.how_found, r.bucket) for r in got) == [("raw[utf-16-le]", "strict"), ("text", "needs_review"), ("text", "strict"), ("text", "strict")]
    assert {r.canonical for r in got if r.strict} == {M}


def test_extract_end_to_end(spark):
    from strataweb.sources.artifacts import MANIFEST

    rows = [(0, "http://h/1", "http://h/1", "a", "r", {"x": f"v {M}"}), (1, "http://h/2", "http://h/2", "a", None, {})]
    cols = "seq long, url string, canon_key string, sha256 string, rendered_sha256 string, headers map<string,string>"
    manifest = spark.createDataFrame(rows, cols).selectExpr("*", "'text/html' content_type", "'' url_ext", "string(null) interacted_sha256")
    blobs = spark.createDataFrame([("a", bytearray(b"<!-- MARK{aaaaaaaaaaaaaaaa} -->")), ("r", bytearray(b"<p>MARK{bbbbbbbbbbbbbbbb}</p>"))], "sha256 string, content binary")
    found = detect.extract(manifest, blobs)
    strict = found.filter("bucket = 'strict'")
    assert {r.url for r in strict.filter("canonical like '%aaaa%'").collect()} == {"http://h/1", "http://h/2"}
    assert [tuple(r) for r in detect.divergence(strict.filter("corpus <> 'header'")).filter("corpus = 'rendered_only'").collect()] == [("MARK{bbbbbbbbbbbbbbbb}", "http://h/1", "rendered_only")]
    assert strict.select("canonical").distinct().count() == 3
    assert "sha256" in MANIFEST


def test_byte_scan(spark):
    text = '"https://h/a" \'/x/b.js\' "/r/s/" "c/d.png" load("reports/monthly") url(img.gif) \n//# sourceMappingURL=x.js.map\n https://h/unquoted'
    rows = spark.createDataFrame([("1", "http://h/p/", text)], "id string, base string, text string").withColumn("scope", F.struct(F.lit("http").alias("scheme"), F.lit("h").alias("host"), F.lit(80).alias("port")))
    got = {(r.ref, r.tier, r.how) for r in links.byte_scan(rows).collect()}
    assert {("/x/b.js", 2, "regex_fallback"), ("/r/s/", 2, "regex_fallback"), ("c/d.png", 3, "regex_fallback"), ("reports/monthly", -1, "regex_fallback"), ("img.gif", 2, "css_url"), ("x.js.map", 2, "sourcemap")} == got


def test_caps_against_a_model(spark):
    rng = random.Random(3)
    keys = [(k, rng.choice("abc"), rng.random() < 0.8) for k in range(200)]
    want, taken = {}, {}
    for g, (seq, t, inside) in enumerate(keys, 1):
        if not inside:
            want[seq] = "out_of_scope"
        elif g > 120:
            want[seq] = "global"
        elif taken.get(t, 0) >= 20:
            want[seq] = "template"
        else:
            want[seq], taken[t] = "enqueued", taken.get(t, 0) + 1
    got = frontier.capped(spark.createDataFrame(keys, "seq long, template string, in_scope boolean"), 120, 20)
    assert {r.seq: r.state for r in got.collect()} == want


def test_bfs(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("r", "b"), ("b", "r"), ("x", "y")], "src string, dst string")
    got = graph.bfs(edges, spark.createDataFrame([("r",)], "node string"))
    assert {(r.node, r.depth) for r in got.collect()} == {("r", 0), ("a", 1), ("b", 1)}


def test_scan_orders_and_grid():
    plane = np.arange(12).reshape(3, 4)
    assert images.scan(plane, "border").tolist() == [0, 1, 2, 3, 7, 11, 10, 9, 8, 4, 5, 6]
    assert images.scan(plane, "diagonal").tolist() == [0, 1, 4, 8, 5, 2, 3, 6, 9, 10, 7, 11]
    assert images.scan(plane, "column").tolist() == [0, 4, 8, 1, 5, 9, 2, 6, 10, 3, 7, 11]
    assert len(list(images.grid())) == 376
    assert images.packed(np.array([1] * 8), 1, "msb") == b"\xff" and images.packed(np.array([1, 0] * 4), 1, "lsb") == b"\x55"


def test_png_text():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"note\0" + M.encode()) + chunk(b"zTXt", b"z\0\0" + zlib.compress(M.encode())) + chunk(b"IEND", b"")
    got = metadata.texts(png)
    assert {("img_meta:png_text:note", M.encode()), ("img_meta:info:z", M.encode()), ("img_chunk:zTXt", M.encode())} <= set(got) and len(got) == 6
    assert metadata.texts(b"") == [] and metadata.texts(png[:30]) and metadata.texts(b"\xff\xd8\xff") == []


def test_stream(spark, tmp_path):
    from strataweb.streaming.ingest import ingest, manifest_stream, new_keys

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"url":"http://h/a#1","fetched_at":"2024-01-01T00:00:00Z"}\n{"url":"http://h/a","fetched_at":"2024-01-01T00:00:01Z"}\n')
    ingest(new_keys(manifest_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


@pytest.fixture
def capture(tmp_path):
    """A capture of a page, its rendering, and a PNG with a value in its metadata, by hand."""
    import hashlib
    import json

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    pixels = b"".join(b"\0" + bytes(range(48)) for _ in range(16))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 16, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"note\0MARK{cccccccccccccccc} 0123456789abcdef") + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    bodies = {"page": b"<!-- MARK{aaaaaaaaaaaaaaaa} --><p>MARK{ x }</p>", "shot": b"<p>MARK{bbbbbbbbbbbbbbbb}</p>", "png": png, "bad": b"\x89PNG\r\n\x1a\nbroken"}
    (tmp_path / "blobs").mkdir()
    sha = {}
    for name, b in bodies.items():
        sha[name] = hashlib.sha256(b).hexdigest()
        (tmp_path / "blobs" / sha[name]).write_bytes(b)
    rows = [
        {"url": "http://h/", "canon_key": "http://h/", "content_type": "text/html", "url_ext": "", "sniffed_type": "text/html", "sha256": sha["page"], "rendered_sha256": sha["shot"], "length": 40, "headers": {"Set-Cookie": "a=MARK{dddddddddddddddd}"}},
        {"url": "http://h/a.png", "canon_key": "http://h/a.png", "content_type": "image/png", "url_ext": "png", "sniffed_type": "image/png", "sha256": sha["png"], "length": 9, "headers": {}},
        {"url": "http://h/b.png", "canon_key": "http://h/b.png", "content_type": "image/png", "url_ext": "png", "sniffed_type": "image/png", "sha256": sha["png"], "length": 9, "headers": {}},
        {"url": "http://h/c.png", "canon_key": "http://h/c.png", "content_type": "image/png", "url_ext": "png", "sniffed_type": "image/png", "sha256": sha["bad"], "length": 9, "headers": {}},
        {"url": "http://h/x", "canon_key": "http://h/x", "error": "timeout"},
    ]
    (tmp_path / "manifest.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    edges = [("http://h/", "http://h/a.png", "img_src"), ("http://h/", "http://h/x", "a_href"), ("http://h/", "http://o/", "xhr")]
    (tmp_path / "edges.jsonl").write_text("".join(json.dumps({"src": s, "dst": d, "how": h, "hint": "", "depth": 1}) + "\n" for s, d, h in edges))
    return str(tmp_path)


def test_jobs(spark, capture):
    import json
    from pathlib import Path

    from strataweb import jobs

    out = Path(capture) / "out"
    jobs.extract(spark, capture, str(out))
    found = json.loads((out / "secrets.json").read_text())
    assert found["distinct_strict"] == 4 and not found["count_met"] and list(found["secrets"]) == [f"MARK{{{x * 16}}}" for x in "abcd"]
    assert {s["url"] for s in found["secrets"]["MARK{cccccccccccccccc}"]} == {"http://h/a.png", "http://h/b.png"}
    assert [s["how_found"] for s in found["secrets"]["MARK{dddddddddddddddd}"]] == ["header:Set-Cookie"]
    assert {(d["canonical"][5], d["corpus"]) for d in found["divergences"]} == {("a", "raw_only"), ("b", "rendered_only")}
    assert {(r["raw"], r["reason"]) for r in found["ruled_out"]} == {(f"FRAGMENT:{x}", "bare_hex_fragment") for x in ("0123456789abcdef", "c" * 16)}
    assert {r["raw"] for r in found["needs_review"]} == {"MARK{ x }"} and found["unhandled_types"] == []
    assert {(i["url"], i["ruling"], i["candidates_tried"]) for i in found["images"]} == {("http://h/a.png", "payload-found", 376), ("http://h/c.png", "unreadable", 0)}
    assert [i["url"] for i in found["images_without_secret"]] == ["http://h/c.png"]
    assert spark.read.json(str(out / "pixel_sweep")).count() == 376
    jobs.report(spark, capture, str(out))
    coverage = (out / "coverage.md").read_text()
    assert "| fetched | 4 |" in coverage and "| errored | 1 |" in coverage and "| out_of_scope | 1 |" in coverage and "same_bytes_different_urls" in coverage
    assert "| image/png | 3 |" in (out / "filetypes.md").read_text() and "MARK{aaaaaaaaaaaaaaaa}" in (out / "submission.md").read_text()
    jobs.dot(spark, capture, str(out))
    lines = next((out / "graph.dot").glob("*.txt")).read_text().splitlines()
    assert lines[0] == "digraph site {" and lines[-1] == "}"
    assert '  "http://o/" [label="http://o/\\n(d=1)", shape=box, style=filled, fillcolor="gray85"];' in lines
    assert '  "http://h/" -> "http://h/a.png" [label="img_src", color=gray40, style=solid];' in lines


def test_crawl_job(spark, tmp_path):
    """From a capture's folder: harvest, redirect, headers, patterns and JSON strings, in the order of a queue."""
    from strataweb import jobs

    def blob(body):
        name = hashlib.sha256(body).hexdigest()
        (tmp_path / "blobs").mkdir(exist_ok=True)
        (tmp_path / "blobs" / name).write_bytes(body)
        return name

    page = lambda path, body, kind="text/html", final=None, **more: {"url": f"http://h{path}", "canon_key": f"http://h{path}", "final_url": f"http://h{final or path}", "status": 200, "content_type": kind, "url_ext": path.rpartition(".")[2] if "." in path else "", "sha256": blob(body), "headers": {}, **more}
    rows = [
        page("/", b'<a href="/a">A</a><a href="http://o/x">out</a><script src="/s.js"></script>', headers={"Link": "</l>; rel=next", "x-y": 'see "/h.zip"'}),
        page("/a", b"<p>plain</p>", rendered_sha256=blob(b'<base href="/sub/"><a href="deep">D</a>')), page("/s.js", b'load("/js/x.json", "reports/may");', "application/javascript"),
        page("/js/x.json", b'{"u": "/from/json"}', "application/json"), page("/sub/deep", b"<p>", final="/end"), {"url": "http://h/l", "canon_key": "http://h/l", "status": 503, "error": "x"},
    ]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, rows)))
    jobs.crawl(spark, str(tmp_path), f"{tmp_path}/out")
    keys = {r.canon_key: (r.depth, r.state) for r in spark.read.json(f"{tmp_path}/out/keys").collect()}
    assert {k: v for k, v in keys.items() if v[1] != "errored"} == {"http://h/": (0, "fetched"), "http://h/a": (1, "fetched"), "http://o/x": (1, "out_of_scope"), "http://h/s.js": (1, "fetched"), "http://h/sub/deep": (2, "fetched"), "http://h/js/x.json": (2, "fetched")}
    assert {k.removeprefix("http://h"): d for k, (d, s) in keys.items() if s == "errored" and k.removeprefix("http://h") not in rules.DECLARED} == {"/l": 1, "/h.zip": 1, "/end": 2, "/from/json": 3}
    edges = {(r.src.removeprefix("http://h"), r.dst.removeprefix("http://h"), r.how, r.hint) for r in spark.read.json(f"{tmp_path}/out/edges").filter("how <> 'seed'").collect()}
    assert edges == {("/", "/a", "a_href", "A"), ("/", "http://o/x", "a_href", "out"), ("/", "/s.js", "script_src", ""), ("/a", "/sub/deep", "a_href", "D"), ("/sub/deep", "/end", "redirect", "HTTP 200"),
                     ("/", "/l", "http_link_header", "next"), ("/", "/h.zip", "http_header:x-y", ""), ("/s.js", "/js/x.json", "regex_fallback", "tier2"), ("/js/x.json", "/from/json", "json_value", "")}
    (tmp_path / "edges.jsonl").write_text("")
    manifest = jobs.artifacts.read_manifest(spark, str(tmp_path))
    bodies = jobs._bodies(manifest, jobs.artifacts.read_blobs(spark, str(tmp_path)), jobs._root(manifest)[1])
    assert [r.ref for r in links.review(bodies.select(F.col("seq").alias("id"), F.col("url").alias("base"), "scope", "text")).collect()] == ["reports/may"]


def test_rulings(spark):
    """Loose hits, decoys and disagreeing pixels, as they rule an image."""
    rows = [("a", "pixel:x", "MARK{0}", "needs_review"), ("b", "img_meta:x", "FRAGMENT:0", "ruled_out"), ("c", "pixel:x", "p", "strict"), ("c", "pixel:y", "q", "strict"), ("d", "pixel:x", "p", "strict"), ("d", "img_meta:x", "q", "strict")]
    found = spark.createDataFrame([(s, h, c if b == "strict" else None, b) for s, h, c, b in rows], "sha256 string, how_found string, canonical string, bucket string")
    swept = spark.createDataFrame([(s, "k", []) for s in "abcde"], "sha256 string, candidate string, hits array<string>")
    got = {r.sha256: r.ruling for r in images.image_reports(swept, found).collect()}
    assert got == {"a": "needs-review:loose-only", "b": "ruled-out:decoy-only", "c": "needs-review:disagreeing-payloads", "d": "payload-found", "e": "swept-and-clean"}


def test_exif_and_comments():
    ifd = struct.pack("<H", 2) + struct.pack("<HHI4s", 0x10E, 2, 4, b"abc\0") + struct.pack("<HHII", 0x8769, 4, 1, 38) + b"\0\0\0\0"
    inner = struct.pack("<H", 1) + struct.pack("<HHII", 37510, 7, 6, 60) + b"\0\0\0\0"
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd
    tiff = (tiff + inner.rjust(len(inner) + 38 - len(tiff), b"\0")).ljust(60, b"\0") + b"M\0A\0R\0"
    app = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    got = metadata.texts(b"\xff\xd8" + app + b"\xff\xfe" + struct.pack(">H", 5) + b"com" + b"\xff\xda")
    assert {("img_meta:exif:270", b"abc"), ("img_meta:exif_ifd0x8769:37510", b"M\0A\0R\0"), ("img_meta:jpeg_comment", b"com")} <= set(got)
    assert metadata.texts(b"GIF89a....\x21\xfe\x03abc\0;") == [("img_meta:info:comment", b"abc")]


def test_consensus():
    digits = "0123456789abcdef"
    assert images.consensus([f"mark{{{digits}}}", f"MARK{{{digits.replace('0', 'O')}}}"], "MARK") == f"MARK{{{digits}}}"
    read = lambda *places: "MARK{" + "".join("x" if k in places else d for k, d in enumerate(digits)) + "}"
    assert images.consensus([read(3), read(7), read(9)], "MARK") == f"MARK{{{digits}}}"
    assert images.consensus([read(3), read(3), read(9)], "MARK") is None
    assert images.consensus(["MARK", "MARK"], "MARK") is None and images.consensus([f"MARK{{{digits}}}"], "MARK") is None


def test_utf16_in_raw_surfaces(spark):
    """A value behind a character whose bytes aren't UTF-8 is found in the body's very bytes."""
    body = ("\u82e2" + M).encode("utf-16-le")
    rows = spark.createDataFrame([(h, h, bytearray(body)) for h in ("html", "code", "text", "json", "xml")], "sha256 string, handler string, content binary")
    found = surfaces.expanded(rows)
    assert {bytes(r.data) for r in found.filter("sub = 'raw'").collect()} == {body}
    got = {r.sha256 for r in detect.sightings(found).filter("strict and how_found = 'raw[utf-16-le]'").collect()}
    assert got == {"html", "code", "text", "json", "xml"}


def test_declared_encodings_and_data_uris():
    assert surfaces._xml('<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>') == [("xml_text:a", "é")]
    assert surfaces.decoded_variants("data:x;base64,QUJD= data:y;base64,QUJDR data:z;base64,QUJDRA==") == [("decoded:data_uri", b"ABC"), ("decoded:data_uri", b"ABCD")]


def test_python_is_given_other_bodies_as_null(spark):
    """In the plan every Python function's argument stands in a CASE."""
    rows = spark.createDataFrame([("a", "html", bytearray(b"x"))], "sha256 string, handler string, content binary")
    plan = surfaces.expanded(rows)._jdf.queryExecution().optimizedPlan().toString()
    links_ = spark.createDataFrame([("http://h/", "a")], "b string, r string").select(url.resolve(F.col("b"), F.col("r")).alias("x"))
    plan += links_._jdf.queryExecution().optimizedPlan().toString()
    calls = re.findall(r"(unescape|expand|_decoded|_joined)\(([^\n]{0,60})", plan)
    assert {n for n, _ in calls} == {"unescape", "expand", "_decoded", "_joined"} and all("CASE WHEN" in x or "_extract" in x or "pythonUDF" in x for _, x in calls)


def test_dom_harvest():
    page = """<base href="/b/"><base href="/c/"><a href="x.html"> one <b>two</b></a><link rel="icon" href="i.ico"><img src="p.png" srcset="a.png 1x, b.png 2x" alt="pic">
      <div style="background:url('bg.png');mask:url(m.svg)" data-src="img/lazy.jpg" data-n="7" data-u="http://x/y">t</div><script src="s.js">code</script><form action="/go"><input></form>
      <meta http-equiv="Refresh" content="3; URL=next.html"><video poster="v.png" src="v.mp4"></video><area href="ar"><object data="o.swf">none</object>"""
    h = links._Harvest()
    got = [(x["ref"], x["how"], x["hint"]) for x in h.links(page)]
    assert h.base == "/b/" and got == [
        ("x.html", "a_href", "one two"), ("i.ico", "link_rel", "icon"), ("p.png", "img_src", ""), ("a.png", "srcset", "pic"), ("b.png", "srcset", "pic"), ("bg.png", "css_url", "inline style"),
        ("m.svg", "css_url", "inline style"), ("img/lazy.jpg", "data_attr", "data-src"), ("s.js", "script_src", "code"), ("/go", "form_action", ""), ("v.mp4", "video_src", ""),
        ("v.png", "poster", ""), ("ar", "area_href", ""), ("o.swf", "object_data", "none"), ("next.html", "meta_refresh", "3; URL=next.html"),
    ]
    long = links._Harvest().links(f"<a href=x>{'w' * 100}</a><p><a href=y>open")
    assert [len(x["hint"]) for x in long] == [80, 4]


def test_json_links(spark):
    bodies = [("m", "application/json; charset=utf-8", "", '{"start_url": "/app/", "icons": [{"src": " /i/icon.png "}, {"src": "/i/icon.png"}], "x": "https://other.example/x", "name": "not a url", "rel": "a/b.js"}'),
              ("s", "", "map", '{"sources": ["../src/admin.js", "webpack://./x.js"]}'), ("bad", "application/json", "", "not json{"), ("no", "text/html", "html", '"/x/"'), ("null", None, None, '"/x/"')]
    rows = spark.createDataFrame(bodies, "id string, content_type string, ext string, text string").withColumn("base", F.lit("http://h/static/js/a.js.map"))
    got = {(r.id, r.verbatim) for r in links.json_body_links(rows).collect()}
    assert got == {("m", "http://h/app/"), ("m", "http://h/i/icon.png"), ("m", "https://other.example/x"), ("s", "http://h/static/src/admin.js")}


def test_header_links(spark):
    headers = {"Link": '</style.css>; rel="stylesheet", <https://x.example/a>; rel=preload', "x-source": 'see "/internal/backup.zip" and /bare/x.zip', "location": "/gone"}
    rows = spark.createDataFrame([(1, "http://h/p", headers)], "seq long, url string, headers map<string,string>")
    got = {(r.verbatim, r.how, r.hint) for r in links.header_links(rows).collect()}
    assert got == {("http://h/style.css", "http_link_header", "stylesheet"), ("https://x.example/a", "http_link_header", "preload"), ("http://h/internal/backup.zip", "http_header:x-source", "")}


def test_request_log(spark):
    log = spark.createDataFrame([("http://h/a", "GET"), ("http://h/a", "POST"), ("http://o/a", "GET"), ("data:x", "GET")], "url string, method string")
    scope = F.struct(F.lit("http").alias("scheme"), F.lit("h").alias("host"), F.lit(80).alias("port"))
    assert sorted((r.url, r.blocked) for r in links.blocked_requests(log, scope).collect()) == [("data:x", "out_of_scope"), ("http://h/a", "mutation"), ("http://o/a", "out_of_scope")]


def test_accounting(spark):
    seen = spark.createDataFrame([("a",), ("b",), ("c",)], "canon_key string")
    states = spark.createDataFrame([("a", "fetched"), ("b", "errored"), ("c", None)], "canon_key string, state string")
    with pytest.raises(AssertionError, match="'c'"):
        frontier.assert_accounted(seen, states)
    frontier.assert_accounted(seen, states.fillna("out_of_scope"))
    found = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None)], "seq long, canon_key string, url string")
    assert sorted(map(tuple, frontier.distinct_keys(found).collect())) == [(1, "a", "y"), (2, "b", None)]
    assert "partial_min_by" in frontier.distinct_keys(found)._jdf.queryExecution().toString()


def test_outcomes(spark):
    log = [(1, "ok", 200, None), (2, "gone", 404, None), (3, "late", 503, None), (4, "dead", 503, None), (5, "boom", None, "x"), (6, "late", 200, None), (7, "dead", 500, None), (8, "boom", 200, None), (9, "dead", 200, None)]
    got = {r.canon_key: (r.state, r.retries) for r in frontier.outcomes(spark.createDataFrame(log, "seq long, canon_key string, status int, error string")).collect()}
    assert got == {"ok": ("fetched", 0), "gone": ("fetched", 0), "late": ("fetched", 0), "dead": ("errored", 2), "boom": ("fetched", 0)}


def test_ranks_of_many_parts(spark):
    """No expression grows with the number of parts, and templates are counted by parts first."""
    keys = spark.range(500).select((F.col("id") * 7 % 500).alias("seq"), F.lit("t").alias("template"), F.lit(True).alias("in_scope"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        plan = frontier.ranked(keys)._jdf.queryExecution().toString()
        got = frontier.capped(keys, 400, 333)
        assert plan.count("CASE WHEN") == 0 and all(r.rank == r.seq + 1 for r in got.collect())
        assert got.groupBy("state").count().orderBy("state").collect() == [("enqueued", 333), ("global", 100), ("template", 67)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def simulated(root, pages, dom, scans, max_keys, per_template):
    """A queue, and scans when it is empty."""
    from collections import deque

    seen, states, depths, taken, queue, scanned, edges, order = {}, {}, {}, {}, deque(), set(), [], []
    inside = lambda x: x.startswith("http://h/")

    def add(key, depth):
        if key in seen:
            return
        seen[key], depths[key] = len(seen) + 1, depth
        template = key.removeprefix("http://h").partition("?")[0]
        if len(seen) > max_keys or taken.get(template, 0) >= per_template:
            states[key] = "errored"
        else:
            taken[template] = taken.get(template, 0) + 1
            queue.append(key)

    def found(key, depth):
        if inside(key):
            add(key, depth)
        elif key not in seen:
            seen[key], depths[key], states[key] = len(seen) + 1, depth, "out_of_scope"

    add(root, 0)
    for x in ["/robots.txt", "/sitemap.xml", "/manifest.json", "/humans.txt", "/.well-known/security.txt", "/favicon.ico"]:
        edges.append((root, f"http://h{x}", "seed"))
        add(f"http://h{x}", 1)
    while True:
        while queue:
            key = queue.popleft()
            if key not in pages:
                states[key] = "errored"
                continue
            states[key] = "fetched"
            order.append(key)
            if final := pages[key]:
                edges.append((key, final, "redirect"))
                if inside(final):
                    add(final, depths[key])
            for dst in dom.get(key, []):
                edges.append((key, dst, "a_href"))
                found(dst, depths[key] + 1)
        n = len(seen)
        for key in order:
            if key not in scanned:
                scanned.add(key)
                for dst in scans.get(key, []):
                    if dst not in seen:
                        edges.append((key, dst, "tier2"))
                        add(dst, depths[key] + 1)
        if len(seen) == n and not queue:
            return {k: (depths[k], seen[k], states[k]) for k in seen}, sorted(edges)


@pytest.mark.parametrize("max_keys,per_template", [(2000, 60), (25, 3), (12, 60)])
def test_crawl_against_a_queue(spark, max_keys, per_template):
    from strataweb.plans.crawl import crawl

    rng = random.Random(max_keys)
    names = [f"http://h/{x}" for x in ["", *map(str, range(30))]] + [f"http://h/list?page={k}" for k in range(8)] + [f"http://o/{k}" for k in range(4)]
    inner = [x for x in names if x.startswith("http://h/")]
    pages = {x: (rng.choice(names) if rng.random() < 0.15 else None) for x in inner if rng.random() < 0.85 or x == "http://h/"}
    pages = {x: None if f == x else f for x, f in pages.items()}
    dom = {x: [rng.choice(names) for _ in range(rng.randint(0, 3))] for x in pages}
    scans = {x: [rng.choice(inner) for _ in range(rng.randint(0, 2))] for x in pages}
    frame = lambda links, how: spark.createDataFrame([(s, d, how, "", k) for s, x in links.items() for k, d in enumerate(x)], "src string, dst_url string, how string, hint string, place int")
    rows = spark.createDataFrame([(x, x, f or x, 302) for x, f in pages.items()], "canon_key string, url string, final_url string, status int")
    keys, edges = crawl("http://h/", rows, frame(dom, "a_href"), frame(scans, "tier2"), Rules(max_keys=max_keys, max_per_template=per_template))
    want, want_edges = simulated("http://h/", pages, dom, scans, max_keys, per_template)
    assert {r.canon_key: (r.depth, r["rank"], r.state) for r in keys.collect()} == want
    assert sorted((r.src, r.dst, r.how) for r in edges.collect()) == want_edges


@pytest.mark.parametrize("small", [0, 20_000])
def test_crawl_without_caps_in_reach(spark, monkeypatch, small):
    """No template is counted, and tables of turns are cut together, whether turns are small or not."""
    from strataweb.plans import crawl as crawling

    monkeypatch.setattr(crawling, "SMALL", small)
    monkeypatch.setattr(crawling, "PIECES", 2)
    monkeypatch.setattr(crawling, "capped", None)
    names = [f"http://h/{k}" for k in range(5)]
    pages = dict.fromkeys(names[:4])
    dom = {a: [b, names[0]] for a, b in zip(names[:3], names[1:])}
    scans = {names[0]: [names[1], names[4]]}
    frame = lambda links, how: spark.createDataFrame([(s, d, how, "", k) for s, x in links.items() for k, d in enumerate(x)], "src string, dst_url string, how string, hint string, place int")
    rows = spark.createDataFrame([(x, x, x, 200) for x in pages], "canon_key string, url string, final_url string, status int")
    keys, edges = crawling.crawl(names[0], rows, frame(dom, "a_href"), frame(scans, "tier2"))
    want, want_edges = simulated(names[0], pages, dom, scans, 2000, 60)
    assert {r.canon_key: (r.depth, r["rank"], r.state) for r in keys.collect()} == want
    assert sorted((r.src, r.dst, r.how) for r in edges.collect()) == want_edges


def test_crawl_turns_take_few_tasks(spark, tmp_path):
    """A small turn takes few tasks, however many partitions a shuffle has: 209 in all here, 717 when each turn was dealt to all of them."""
    from strataweb import queries

    spark.range(15).withColumnRenamed("id", "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    context, usual = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    context.setJobGroup("turns", "turns")
    try:
        rows = queries.crawl_edges(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        context.setLocalProperty("spark.jobGroup.id", None)
    got, h = sorted((r.src, r.dst, r.depth) for r in rows if r.how != "seed"), "http://h/"
    want = [(f"{h}{k}", f"{h}{2 * k + j}", (k + 1).bit_length() - 1) for k in range(15) for j in (1, 2)] + [(f"{h}0", f"{h}s0", 0), (f"{h}10", f"{h}s10", 3)]
    assert got == sorted(want) and len(rows) == len(want) + len(rules.DECLARED)
    seen = context.statusTracker()
    stages = [x for j in seen.getJobIdsForGroup("turns") for k in seen.getJobInfo(j).stageIds if (x := seen.getStageInfo(k))]
    assert stages and sum(x.numCompletedTasks for x in stages) < 400


def test_utf16_goes_back_in_slices(spark, monkeypatch):
    """Parts of a batch hold about SLICE bytes; large and null values are each found once."""
    import pyarrow as pa

    from strataweb.operators import detect

    monkeypatch.setattr(detect, "SLICE", 100)
    data = pa.array([b"x" * n if n is not None else None for n in (30, 30, None, 50, 250, 0, 90, None)], pa.binary())
    parts = list(detect.slices(data))
    assert pa.concat_arrays(parts).equals(data) and max(map(len, parts)) < 5 and not list(detect.slices(data[:0]))
    monkeypatch.undo()
    big = ["\u82e2MARK{%016x} " % k + "x" * 700_000 for k in range(4)]
    rows = spark.createDataFrame([("raw", x.encode("utf-16-le")) for x in big] + [("raw", None), ("other", big[0].encode("utf-16-le"))], "sub string, data binary").coalesce(1)
    found = detect.sightings(rows).filter("strict").collect()
    assert sorted((r.how_found, r.canonical) for r in found) == [("raw[utf-16-le]", "MARK{%016x}" % k) for k in range(4)]


def test_sources(spark, tmp_path):
    """Order over files and splits, what a record has, content addressed bodies, documents."""
    from strataweb.sources import artifacts

    for k in range(4):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"url": f"http://h/{k}/{i:05}", "sha256": "s"}) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = artifacts.read_jsonl(spark, str(tmp_path), artifacts.MANIFEST)
        got = [r.url for r in rows.orderBy("seq").select("url").collect()]
        assert rows.rdd.getNumPartitions() > 8 and got == sorted(got) and len(got) == 12000
        assert artifacts.first_rows(rows).collect()[0].url == "http://h/0/00000"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert artifacts.read_jsonl(spark, f"{tmp_path}/none.jsonl", artifacts.EDGES).count() == 0
    captures = spark.createDataFrame([("http://h/a.PNG?x", "http://h/b", 200, {"Content-Type": "Image/PNG; q=1"}, bytearray(b"\x89PNG\r\n\x1a\n"), None, 2, 0, bytearray(b"<p>")), ("http://h/x", None, 503, None, None, "timeout", 1, 2, None)],
                                     "url string, final_url string, status int, headers map<string,string>, content binary, error string, depth int, retries int, rendered binary")
    one_, two = artifacts.records(captures).orderBy("url").collect()
    assert (one_.canon_key, one_.final_url, one_.content_type, one_.url_ext, one_.sniffed_type, one_.length, one_.first_seen_depth, one_.idle_timeout, one_.blocked_notice) == ("http://h/a.PNG?x=", "http://h/b", "image/png", "png", "image/png", 8, 2, False, False)
    assert one_.rendered_sha256 == hashlib.sha256(b"<p>").hexdigest() and one_.interacted_sha256 is None and one_.fetched_at and one_.clicks is None
    assert (two.sha256, two.content_type, two.error, two.retries, two.status, two.final_url) == (None, None, "timeout", 2, 503, None)
    artifacts.append_jsonl(artifacts.records(captures), f"{tmp_path}/m")
    artifacts.append_jsonl(artifacts.records(captures), f"{tmp_path}/m")
    again = artifacts.read_jsonl(spark, f"{tmp_path}/m", artifacts.MANIFEST)
    assert again.count() == 4 and artifacts.fetched(again).count() == 2
    bodies = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    assert {(r.sha256, bytes(r.content)) for r in artifacts.content_addressed(bodies).collect()} == {(hashlib.sha256(x).hexdigest(), x) for x in (b"a", b"b")}
    (tmp_path / "doc.json").write_text('{\n "expected": 8,\n "secrets": {"a": [1]}\n}')
    assert artifacts.read_document(spark, f"{tmp_path}/doc.json", "expected int, secrets map<string,array<int>>").first() == (8, {"a": [1]})


def test_predicates(spark):
    ask = lambda f, *v: spark.range(1).select(f(*map(F.lit, v))).first()[0]
    assert [ask(content.expandable, s, t) for s, t in ((200, "text/html; x"), (299, "text/html"), (404, "text/html"), (200, "text/css"), (None, "text/html"))] == [True, True, False, False, False]
    assert [ask(content.transient, s, e) for s, e in ((503, None), (404, None), (200, "x"), (None, None))] == [True, False, True, False]
    assert [ask(url.origin, x) for x in ("http://H:80/a", "https://h/", "http://h:8080/")] == ["http://h", "https://h", "http://h:8080"]


def test_duplication_lists_are_bounded(spark):
    rows = spark.range(50).select(F.col("id").alias("seq"), F.format_string("u%02d", "id").alias("url"), F.format_string("u%02d", "id").alias("canon_key"), F.lit("s").alias("sha256"), F.lit("t").alias("content_type"), F.lit(1).alias("length"))
    edges = spark.range(30).select(F.format_string("p%02d", "id").alias("src"), F.lit("u00").alias("dst"))
    r = reports.duplication(rows, edges, 5).first()
    assert (r.n_urls, r.n_referrers, r.urls, r.referrers) == (50, 30, [f"u0{k}" for k in range(5)], [f"p0{k}" for k in range(5)])
    assert reports.duplication(rows.filter("seq = 0"), edges.limit(0)).count() == 0


def test_ocr_variants(spark):
    """Only images that are wide or unexplained are read, in three variants."""
    image = lambda n, h, w: (n, (n, h, w, 3, 16, bytearray(bytes([200] * (h * w * 3 // 2) + [10] * (h * w * 3 - h * w * 3 // 2)))))
    rows = spark.createDataFrame([image("wide", 10, 30), image("known", 20, 20), image("open", 20, 20)], "sha256 string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    found = spark.createDataFrame([("wide", True), ("known", True), ("open", False)], "sha256 string, strict boolean")
    some = images.ocr_eligible(rows, found)
    assert {r.sha256 for r in some.collect()} == {"wide", "open"}
    got = {(r.sha256, r.variant): r.text for r in images.read_text(some, lambda a: f"{a.shape[0]}x{a.shape[1]} {len(set(a.ravel().tolist()))}").collect()}
    assert {k: v.split()[0] for k, v in got.items()} == {("wide", "gray"): "10x30", ("wide", "upscaled"): "60x180", ("wide", "binary"): "10x30", ("open", "gray"): "20x20", ("open", "upscaled"): "120x120", ("open", "binary"): "20x20"}
    assert got["open", "binary"].endswith(" 2") and images.read_text(some).count() == 0
