"""Coverage: inventory, signal disagreements, duplication, histograms, and their Markdown."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import disagrees
from ..rules import INVENTORIED, SEVERAL_REFERRERS, SEVERAL_URLS


def inventory(rows: DataFrame) -> DataFrame:
    """(content_type, n, bytes, examples, handled) of fetched rows (seq, url, content_type, url_ext, length); no type is (none).

    Examples are the first three rows' URLs; each task keeps three of a type, never all.
    """
    kind = F.when(F.coalesce("content_type", F.lit("")) == "", "(none)").otherwise(F.col("content_type"))
    rows = rows.withColumn("content_type", kind)
    handled = F.bool_or((F.col("url_ext") == "map") | F.col("content_type").isin(INVENTORIED))
    totals = rows.groupBy("content_type").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), handled.alias("handled"))
    return totals.join(first_k(rows, "content_type", 3), "content_type").select("content_type", "n", "bytes", "examples", "handled")


def first_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, examples): the URLs of each key's first k rows, by row groups first so that no key's rows meet."""
    salted = Window.partitionBy(key, "_salt").orderBy("seq")
    part = rows.select(key, "seq", "url", F.pmod(F.xxhash64("seq"), F.lit(64)).alias("_salt")).withColumn("_n", F.row_number().over(salted)).filter(F.col("_n") <= k)
    return part.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "url"))), 1, k), lambda x: x["url"]).alias("examples"))


def unhandled(rows: DataFrame, handled: DataFrame) -> DataFrame:
    """Types (content_type) without an extractor, distinct."""
    return rows.select("content_type").filter("content_type <> ''").distinct().join(handled, "content_type", "left_anti")


def disagreements(rows: DataFrame) -> DataFrame:
    return rows.filter(disagrees(F.col("url_ext"), F.col("content_type"), F.col("sniffed_type")))


#: URLs or referrers of a body that are listed, the first ones in order; all are counted.
LISTED = 1000


def _listed(pairs: DataFrame, key: str, what: str, k: int) -> DataFrame:
    """(key, n, list) of distinct pairs: how many, and the first k in order; no task holds all of a key's."""
    part = pairs.select(key, F.col(what).alias("x"), F.pmod(F.xxhash64(what), F.lit(64)).alias("_salt"))
    some = part.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_salt").orderBy("x"))).filter(F.col("_n") <= k)
    lists = some.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("x")), 1, k).alias(what))
    return pairs.groupBy(key).agg(F.count(what).alias(f"n_{what}")).join(lists, key)


def duplication(rows: DataFrame, edges: DataFrame, k: int = LISTED) -> DataFrame:
    """(sha256, urls, referrers, n_urls, n_referrers, case, content_type, length) of bodies that several URLs have, or several pages refer to.

    The lists hold the first k in order; the counts are of all.
    """
    same = rows.filter("sha256 is not null")
    first = same.groupBy("sha256").agg(F.min_by("content_type", "seq").alias("content_type"), F.min_by("length", "seq").alias("length"))
    urls = _listed(same.select("sha256", F.col("url").alias("urls")).distinct(), "sha256", "urls", k)
    refs = same.select("sha256", "canon_key").distinct().join(edges.select(F.col("dst").alias("canon_key"), F.col("src").alias("referrers")).distinct(), "canon_key")
    refs = _listed(refs.select("sha256", "referrers").distinct(), "sha256", "referrers", k)
    found = first.join(urls, "sha256").join(refs, "sha256", "left").withColumn("n_referrers", F.coalesce("n_referrers", F.lit(0)))
    case = F.when(F.col("n_urls") > 1, SEVERAL_URLS).when(F.col("n_referrers") > 1, SEVERAL_REFERRERS)
    found = found.withColumn("referrers", F.coalesce("referrers", F.array().cast("array<string>"))).withColumn("case", case)
    return found.filter("case is not null").select("sha256", "urls", "referrers", "n_urls", "n_referrers", "case", "content_type", "length")


def counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def top(rows: DataFrame, key: str, k: int, seq: str = "seq") -> DataFrame:
    """The k keys with most rows; of equal ones those that came first."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(seq).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def fetched_errored(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.when(F.col("sha256").isNotNull(), "fetched").otherwise("errored").alias("state")).agg(F.count("*").alias("n"))


def cell(x: object) -> str:
    return str("" if x is None else ", ".join(map(str, x)) if isinstance(x, list) else x).replace("|", "\\|").replace("\n", " ")


def section(title: str, rows: DataFrame, none: str = "_None._", level: int = 2) -> Iterator[str]:
    """A heading and a Markdown table of all rows, which pass the driver a partition at a time."""
    yield from ("", f"{'#' * level} {title}", "")
    some = False
    for r in rows.toLocalIterator():
        if not some:
            yield from ("| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns))
        some = True
        yield "| " + " | ".join(map(cell, r)) + " |"
    if not some:
        yield none


def write_lines(lines: Iterable[str], path: str) -> None:
    """One file at a path or URI of any file system Arrow knows."""
    system, name = fs.FileSystem.from_uri(path if "://" in path else Path(path).absolute().as_uri())
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as f:
        for x in lines:
            f.write((x + "\n").encode("utf-8", "replace"))


def filetypes_report(manifest: DataFrame) -> Iterator[str]:
    rows = manifest.filter("content_type is not null")
    kinds = inventory(rows).orderBy("content_type")
    yield "# Filetype inventory"
    yield from section("Types", kinds.select("content_type", F.col("n").alias("count"), "bytes", F.when(F.col("handled"), "yes").otherwise("**NO**").alias("extractor?"), "examples"))
    yield from section("Signal disagreements", disagreements(rows).select("url", F.col("content_type").alias("header"), F.col("url_ext").alias("ext"), F.col("sniffed_type").alias("sniffed")).orderBy("url"))
    yield from section("Unhandled types", kinds.filter("not handled").select("content_type"))


def coverage_report(manifest: DataFrame, edges: DataFrame, states: DataFrame, depths: DataFrame, review: DataFrame | None = None) -> Iterator[str]:
    """Accounts of a capture: states (canon_key, state, capped), depths (node, depth), review (ref) of references that weren't followed."""
    from .frontier import accounting

    rows = manifest.filter("sha256 is not null")
    yield "# Coverage report"
    yield from section("Terminal-state accounting", accounting(states).orderBy("state").union(states.select(F.lit("seen (total)"), F.count_distinct("canon_key"))))
    yield from section("Depth histogram", counts(depths, "depth").orderBy("depth"))
    yield from section("References", counts(edges, "how").orderBy(F.desc("n"), "how"))
    yield from ("", "## Named exceptions")
    if "capped" in states.columns:
        yield from section("Template truncations", states.filter("capped is not null").select(F.col("capped").alias("cap"), "canon_key").orderBy("cap", "canon_key"), level=3)
    yield from section("Blocked notices", manifest.filter("blocked_notice").select("url").orderBy("url"), level=3)
    yield from section("Terminal errors", manifest.filter("error is not null").select("url", "error").orderBy("url"), level=3)
    yield from section("Redirects", redirects(manifest).orderBy("url"), level=3)
    yield from section("Duplication", duplication(rows, edges).orderBy("sha256").select(F.substring("sha256", 1, 16).alias("sha256"), "case", "content_type", "length", "urls", "referrers"))
    yield from ("", "## Residual queues")
    yield from section("Unhandled types", inventory(rows).filter("not handled").select("content_type").orderBy("content_type"), level=3)
    if review is not None:
        yield from section("References without an extension", review, level=3)
    for title, what in RESIDUALS:
        yield from section(title, manifest.filter(what).select("url").orderBy("url"), level=3)


def redirects(manifest: DataFrame) -> DataFrame:
    """(url, final_url) of rows that ended elsewhere, and whether out of the first scope."""
    from ..functions import url as u

    return manifest.filter("final_url is not null and final_url <> url").select("url", "final_url", (~F.coalesce(u.scope(F.col("final_url")) == u.scope(F.col("url")), F.lit(False))).alias("out_of_scope"))


def submission_report(manifest: DataFrame, edges: DataFrame, results: dict[str, DataFrame], expected: int) -> Iterator[str]:
    """What was captured, the values found with their first sightings, what is open, and the images."""
    kinds = counts(manifest.filter("sha256 is not null"), "content_type")
    found = results["secrets"]
    yield "# Report on the capture"
    yield from section("Rows", fetched_errored(manifest).orderBy("state"))
    yield from section("Content types", kinds.orderBy(F.desc("n"), "content_type"))
    yield from section("References by mechanism", counts(edges, "how").orderBy(F.desc("n"), "how"))
    yield from section("Other than anchors, the most frequent", top(edges.filter("how <> 'a_href'"), "how", 5).select("how", "n"))
    yield from section(f"Values, of {expected} expected", found.groupBy("canonical").agg(F.min_by("url", "seq").alias("url"), F.min_by("how_found", "seq").alias("how_found")).orderBy("canonical"))
    yield from section("Header sightings", found.filter("how_found like 'header:%'").agg(F.count("*").alias("n")))
    yield from section("Candidates over all images", results["images"].agg(F.sum("candidates_tried").alias("candidates_tried")))
    for title, name in (("Divergences", "divergences"), ("Ruled out", "ruled_out"), ("Needs review", "needs_review"), ("Images", "images")):
        rows = results[name]
        yield from section(title, rows.withColumn("raw", F.substring("raw", 1, 32)) if name == "ruled_out" else rows)


#: Pages that a capture left a doubt about.
RESIDUALS = [
    ("Pages that never fell quiet", "idle_timeout"), ("Changed after their snapshot", "late_mutations > 0"), ("Changed after clicks", "late_mutations_post_click > 0"),
    ("With closed shadow roots", "closed_shadow_roots > 0"), ("With unexplained interactive parts", "unexplained_interactives > 0"),
]
