"""Offline extraction of a capture: all sightings, image reports, and the documents made of them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import handler, utf8
from ..operators import detect, images
from ..rules import Rules
from ..sources.artifacts import first_rows
from .reports import section

SIGHTING = ["canonical", "raw", "how_found", "url", "sha256", "ruled_out", "strict", "bucket", "corpus", "seq"]
#: What a divergence tells, by corpus.
NOTES = {"raw_only": "in raw bytes, not in the rendered page", "rendered_only": "put in by script, not in raw bytes", "interacted_only": "there after interaction alone"}
OCR = "sha256 string, variant string, text string"


def image_track(manifest: DataFrame, blobs: DataFrame, decoded: DataFrame, passes: DataFrame | None = None, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sightings, reports, sweep log) of rasters: blobs (sha256, content), decoded (sha256, image), OCR passes (sha256, variant, text).

    Each body is examined once. Strict sightings hold for every row that carries it, what is open or ruled out for the
    first; reads that a consensus of passes settles are dropped. A body that can't be decoded is reported as unreadable.
    """
    spark = manifest.sparkSession
    first = first_rows(manifest).filter("content_type like 'image/%' and content_type <> 'image/svg+xml'").select("sha256", "url", "seq", "content_type")
    passes = spark.createDataFrame([], OCR) if passes is None else passes
    decoded = decoded.join(first.select("sha256"), "sha256", "left_semi")
    swept = images.sweep(decoded, rules)
    cols = ["sha256", "how_found", "raw", "canonical", "ruled_out", "strict", "bucket"]
    read = passes.join(first.select("sha256"), "sha256", "left_semi")
    ocr = detect.sightings(read.select("sha256", F.concat(F.lit("img_ocr:"), "variant").alias("sub"), F.col("text").cast("binary").alias("data")), rules).select(cols)
    found = images.metadata_sightings(blobs.join(first.select("sha256"), "sha256", "left_semi").select("sha256", "content"), rules).select(cols).unionByName(images.pixel_sightings(swept, rules).select(cols)).unionByName(ocr)
    merged = images.ocr_consensus(read, rules).filter("canonical is not null")
    agreed = merged.select("sha256", F.lit("img_ocr:consensus+hex_repair").alias("how_found"), F.col("canonical").alias("raw"))
    open_ = found.filter("not strict").join(merged.select("sha256", F.lit(True).alias("_settled")), "sha256", "left").filter("_settled is null or how_found not like 'img_ocr:%'").drop("_settled")
    strict = detect.fan_out(found.filter("strict").unionByName(detect.judged(agreed, rules).select(cols)), manifest)
    every = strict.select(*cols, "url", "seq").unionByName(open_.join(first.select("sha256", "url", "seq"), "sha256").select(*cols, "url", "seq")).withColumn("corpus", F.lit("raw")).select(SIGHTING)
    size = decoded.select("sha256", F.when(F.col("image.height") > 0, F.array("image.width", "image.height")).alias("size"))
    texts = read.groupBy("sha256").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "text")))).alias("ocr_text"))
    ramp = images.fits(decoded).select("sha256", F.struct("is_ramp", "max_residual", "deviating_px", "explanation").alias("ramp_fit"))
    reports = first.join(size, "sha256", "left").join(ramp, "sha256", "left").join(images.image_reports(swept, found, merged), "sha256", "left").join(texts, "sha256", "left").select(
        "url", "sha256", F.upper(F.regexp_replace("content_type", "^image/", "")).alias("format"), "size", "ramp_fit", F.coalesce("candidates_tried", F.lit(0)).alias("candidates_tried"),
        F.coalesce("candidates_with_hits", F.lit(0)).alias("candidates_with_hits"), "ocr_text", F.coalesce("ruling", F.lit("unreadable")).alias("ruling"), "seq",
    )
    log = images.sweep_log(swept, rules).join(first.select("sha256", "url"), "sha256").select("url", "sha256", "candidate", "outcome")
    return every, reports, log


def text_of(raw: F.Column) -> F.Column:
    """A hit as text: its bytes as UTF-8, if it has a character for each byte."""
    return F.when(raw.rlike(r"[^\x00-\xff]"), raw).otherwise(utf8(F.encode(raw, "ISO-8859-1")))


def results(manifest: DataFrame, blobs: DataFrame, decoded: DataFrame | None = None, passes: DataFrame | None = None, rules: Rules = Rules()) -> dict[str, DataFrame]:
    """Tables of an extraction: secrets, needs_review, ruled_out, divergences, unhandled_types, images, and sweep where images are given."""
    found, out = detect.extract(manifest, blobs, rules), {}
    if decoded is not None:
        seen, reports, out["sweep"] = image_track(manifest, blobs, decoded, passes, rules)
        found = found.unionByName(seen)
    else:
        reports = manifest.sparkSession.createDataFrame([], "url string, sha256 string, format string, size array<int>, ramp_fit struct<is_ramp:boolean>, candidates_tried bigint, candidates_with_hits bigint, ocr_text map<string,string>, ruling string, seq bigint")
    strict = found.filter("bucket = 'strict'")
    paged = manifest.filter("sha256 is not null and (rendered_sha256 is not null or interacted_sha256 is not null)").select("url").distinct()
    notes = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))
    types = first_rows(manifest)
    out["secrets"] = strict.select("canonical", "url", "sha256", "how_found", "seq").orderBy("canonical", "seq", "how_found")
    out["needs_review"] = found.filter("bucket = 'needs_review'").select(text_of(F.col("raw")).alias("raw"), "url", "how_found").orderBy("url", "how_found", "raw")
    out["ruled_out"] = detect.first_ruled_out(found).select(text_of(F.col("raw")).alias("raw"), "url", "sha256", "how_found", F.col("ruled_out").alias("reason")).orderBy("url", "how_found", "raw")
    out["divergences"] = detect.divergence(strict.filter("corpus <> 'header'").join(paged, "url", "left_semi")).withColumn("note", notes[F.col("corpus")]).orderBy("url", "canonical")
    out["unhandled_types"] = types.filter(handler(F.col("content_type"), F.col("url_ext")).isNull()).select("content_type").distinct().orderBy("content_type")
    out["images"] = reports.orderBy("seq").drop("seq")
    return out


def document(tables: dict[str, DataFrame], rules: Rules = Rules()) -> Iterator[str]:
    """The lines of one JSON document of all tables; rows pass the driver a partition at a time and aren't kept."""
    distinct = tables["secrets"].agg(F.count_distinct("canonical")).first()[0]
    yield f'{{"expected": {rules.expected}, "distinct_strict": {distinct}, "count_met": {json.dumps(distinct >= rules.expected)},'
    yield '"secrets": {'
    lead = ""
    for value, rows in groupby(tables["secrets"].toLocalIterator(), lambda r: r.canonical):
        yield f"{lead}{json.dumps(value)}: ["
        for k, r in enumerate(rows):
            yield ("," if k else "") + json.dumps({"url": r.url, "sha256": r.sha256, "how_found": r.how_found})
        yield "]"
        lead = ","
    yield "}"
    without = tables["images"].filter("ruling <> 'payload-found'").select("url", "ruling")
    for name in ("needs_review", "ruled_out", "divergences", "images"):
        yield from _listed(name, (json.dumps(r.asDict(True)) for r in tables[name].toLocalIterator()))
    yield from _listed("images_without_secret", (json.dumps(r.asDict()) for r in without.toLocalIterator()))
    yield from _listed("unhandled_types", (json.dumps(r[0]) for r in tables["unhandled_types"].toLocalIterator()))
    yield "}"


def _listed(name: str, items: Iterator[str]) -> Iterator[str]:
    yield f", {json.dumps(name)}: ["
    for k, x in enumerate(items):
        yield ("," if k else "") + x
    yield "]"


def report(tables: dict[str, DataFrame], rules: Rules = Rules()) -> Iterator[str]:
    """The lines of the extraction's Markdown report."""
    distinct = tables["secrets"].agg(F.count_distinct("canonical")).first()[0]
    yield "# Extraction report"
    yield from ("", f"**Distinct strict values: {distinct} / {rules.expected}: {'met' if distinct >= rules.expected else 'SHORT'}**")
    yield from section("Sightings", tables["secrets"].select("canonical", "url", "how_found"))
    for title, name in (("Divergences", "divergences"), ("Needs-review bucket", "needs_review"), ("Ruled out", "ruled_out"), ("Unhandled content types", "unhandled_types")):
        yield from section(title, tables[name])
    fit = F.when(F.col("ramp_fit.is_ramp"), "ramp").otherwise("not a ramp").alias("ramp fit")
    yield from section("Images", tables["images"].select("url", "format", fit, "candidates_tried", "candidates_with_hits", "ruling"))
    yield from section("Images without a value", tables["images"].filter("ruling <> 'payload-found'").select("url", "ruling"))
