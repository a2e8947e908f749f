"""Marker patterns in surfaces: strict and loose hits, canonical values, exclusions, buckets, divergence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import latin1
from ..rules import BARE, FRAGMENT, PROSE, Rules


def strict_hits(text: Column, rules: Rules = Rules()) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({rules.prefix}\{{[0-9a-f]{{16}}\}})"), 1)


def loose_hits(text: Column, rules: Rules = Rules()) -> Column:
    """Those that aren't strict ones; a loose hit inside a strict one is that very hit."""
    found = F.regexp_extract_all(text, F.lit(rf"({rules.prefix}\s*\{{[^}}]{{0,80}}\}})"), 1)
    return F.filter(found, lambda x: ~x.rlike(rf"^{rules.prefix}\{{[0-9a-f]{{16}}\}}$"))


def canonical(raw: Column, rules: Rules = Rules()) -> Column:
    """prefix{16 hexadecimal digits} of a hit, tolerant of case and spaces, or null; a hit with other than ASCII has none."""
    value = F.regexp_extract(raw, rf"(?i)^{rules.prefix}\s*\{{\s*([0-9a-f]{{16}})\s*\}}", 1)
    return F.when((value != "") & ~raw.rlike(r"[^\x00-\x7F]"), F.concat(F.lit(rules.prefix + "{"), F.lower(value), F.lit("}")))


def ruled_out(raw: Column, canon: Column, rules: Rules = Rules()) -> Column:
    """Why a hit doesn't count, or nothing."""
    found = F
    for value, why in rules.excluded.items():
        found = found.when(canon == value, why)
    return found.when(canon.isNull() & F.lower(raw).contains(rules.prose), PROSE).when(canon.isNull() & raw.startswith(FRAGMENT), BARE).otherwise("")


def judged(hits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """hits (…, raw) with canonical, ruled_out, strict and bucket."""
    rows = hits.withColumn("canonical", canonical(F.col("raw"), rules)).withColumn("ruled_out", ruled_out(F.col("raw"), F.col("canonical"), rules))
    return rows.withColumn("strict", F.col("canonical").isNotNull() & (F.col("ruled_out") == "")).withColumn("bucket", bucket())


#: Bytes of UTF-16 that are decoded together.
SLICE = 1 << 20
WIDE = pa.list_(pa.struct([("text", pa.string()), ("note", pa.string())]))


def slices(data: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of binary values, of about SLICE bytes."""
    of = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(data)]
    return (data.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("note", T.StringType())])))
def _wide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A batch's texts go back in slices, as each takes several times its bytes."""
    for batch in batches:
        for part in slices(batch):
            yield pa.array([None if d is None else [{"text": d.decode(e, "ignore"), "note": f"[{e}]"} for e in ("utf-16-le", "utf-16-be")] for d in part.to_pylist()], WIDE)


def _texts(wide: Column | None) -> Column:
    """What surfaces (sub, data) are read as: a character for each byte, and UTF-16 if they are wide."""
    none = F.array().cast("array<struct<text:string,note:string>>")
    wide = F.col("sub") == "raw" if wide is None else wide
    once = F.array(F.struct(latin1(F.col("data")).alias("text"), F.lit("").alias("note")))
    return F.concat(once, F.when(wide, F.coalesce(_wide(F.when(wide, F.col("data"))), none)).otherwise(none))


def sightings(surfaces: DataFrame, rules: Rules = Rules(), wide: Column | None = None) -> DataFrame:
    """surfaces (…, sub, data) to (…, sub, how_found, raw, canonical, ruled_out, strict, bucket).

    Surfaces that are wide, by default those called raw, are tried as UTF-16 as well.
    """
    rows = surfaces.withColumn("_t", F.explode(_texts(wide)))
    rows = rows.withColumn("raw", F.explode(F.concat(strict_hits(F.col("_t.text"), rules), loose_hits(F.col("_t.text"), rules))))
    return judged(rows.withColumn("how_found", F.concat("sub", "_t.note")), rules).drop("_t", "data")


def totals(surfaces: DataFrame, rules: Rules = Rules(), wide: Column | None = None) -> DataFrame:
    """(sub, n, bytes, strict, needs_review, ruled_out): surfaces, their bytes, and sightings() by bucket, in one pass."""

    def hit(raw: Column) -> Column:
        value = canonical(raw, rules)
        return F.when(ruled_out(raw, value, rules) != "", "ruled_out").when(value.isNotNull(), "strict").otherwise("needs_review")

    hits = F.flatten(F.transform(_texts(wide), lambda t: F.concat(strict_hits(t["text"], rules), loose_hits(t["text"], rules))))
    rows = surfaces.select("sub", F.octet_length("data").alias("size"), F.transform(hits, hit).alias("hits"))
    own = lambda x: F.sum(F.size(F.filter("hits", lambda h: h == x))).alias(x)
    return rows.groupBy("sub").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *map(own, ("strict", "needs_review", "ruled_out")))


def bucket() -> Column:
    return F.when(F.col("ruled_out") != "", "ruled_out").when(F.col("strict"), "strict").otherwise("needs_review")


def header_sightings(manifest: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Hits in header values; exclusions don't hold here. Equal ones of a key are found once, the first row's."""
    wanted = F.map_filter("headers", lambda k, v: (F.lower(k) == "set-cookie") | F.lower(v).contains(rules.prefix.lower()))
    rows = manifest.select("seq", "url", "canon_key", "sha256", F.explode(F.map_entries(wanted)).alias("h"))
    hits = F.concat(strict_hits(F.col("h.value"), rules), loose_hits(F.col("h.value"), rules))
    rows = rows.select("seq", "url", "canon_key", "sha256", F.concat(F.lit("header:"), F.col("h.key")).alias("how_found"), F.explode(hits).alias("raw"))
    rows = rows.withColumn("canonical", canonical(F.col("raw"), rules)).withColumn("ruled_out", F.lit("")).withColumn("strict", F.col("canonical").isNotNull())
    own = Window.partitionBy(F.coalesce("canonical", "raw"), "canon_key").orderBy("seq", "how_found")
    return rows.withColumn("_n", F.row_number().over(own)).filter("_n = 1").drop("_n")


def bare_hex(text: Column) -> Column:
    """Runs of exactly 16 hexadecimal digits."""
    return F.filter(F.regexp_extract_all(text, F.lit("([0-9a-f]+)"), 1), lambda x: F.length(x) == 16)


def divergence(found: DataFrame) -> DataFrame:
    """(canonical, url, corpus) seen in one corpus of a page and in no other."""
    return found.groupBy("url", "canonical").agg(F.collect_set("corpus").alias("c")).filter(F.size("c") == 1).select("canonical", "url", F.concat(F.col("c")[0], F.lit("_only")).alias("corpus"))


def fan_out(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """What was found once in a body, for every row that carries it."""
    return found.join(manifest.select("seq", "url", "canon_key", "sha256"), "sha256")


def extract(manifest: DataFrame, blobs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """All sightings of a capture: bodies once each, then by carrier; snapshots by role; headers."""
    from ..functions.content import handler
    from ..sources.artifacts import first_rows
    from .surfaces import expanded

    own = first_rows(manifest).select("sha256", handler(F.col("content_type"), F.col("url_ext")).alias("handler"), F.col("content_type").alias("_type"))
    bodies = sightings(expanded(blobs.join(own, "sha256").select("sha256", "handler", "content")), rules)
    bodies = fan_out(bodies.join(own.select("sha256", "_type"), "sha256"), manifest).withColumn("how_found", F.concat("_type", F.lit(":"), "how_found")).withColumn("corpus", F.lit("raw"))
    shots = manifest.select("seq", "url", "canon_key", F.expr("stack(2, 'rendered', rendered_sha256, 'interacted', interacted_sha256) as (corpus, sha256)")).filter("sha256 is not null")
    pages = blobs.join(shots.select("sha256").distinct(), "sha256").select("sha256", F.lit("html").alias("handler"), "content")
    shot = sightings(expanded(pages), rules).join(shots, "sha256").withColumn("how_found", F.concat("corpus", F.lit(":"), "how_found"))
    head = header_sightings(manifest, rules).withColumn("corpus", F.lit("header")).withColumn("bucket", bucket())
    cols = ["canonical", "raw", "how_found", "url", "sha256", "ruled_out", "strict", "bucket", "corpus", "seq"]
    return bodies.select(cols).unionByName(shot.select(cols)).unionByName(head.select(cols))


def first_ruled_out(found: DataFrame) -> DataFrame:
    return found.filter("bucket = 'ruled_out'").withColumn("_n", F.row_number().over(Window.partitionBy("raw", "sha256").orderBy("seq", "how_found"))).filter("_n = 1").drop("_n")
