"""Jobs over a capture's folder: python -m strataweb.jobs extract|report|graph|crawl ROOT [--out FOLDER]."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import content, url
from .operators import links
from .plans import extraction, frontier, graph, reports
from .plans import crawl as crawling
from .rules import Rules
from .sources import artifacts


def extract(spark: SparkSession, root: str, out: str, rules: Rules = Rules(), passes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Writes secrets.json, extraction.md and pixel_sweep (JSON lines); each table is computed once, to tables/, and read from there."""
    manifest, blobs = artifacts.read_manifest(spark, root), artifacts.read_blobs(spark, root)
    tables = extraction.results(manifest, blobs, artifacts.read_images(spark, root), passes, rules)
    tables.pop("sweep").write.mode("overwrite").json(f"{out}/pixel_sweep")
    order = {"secrets": ["canonical", "seq", "how_found"], "images": ["url"]}
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{out}/tables/{name}")
        kept = spark.read.parquet(f"{out}/tables/{name}")
        tables[name] = kept.orderBy(*order.get(name, [x for x in ("url", "how_found", "raw", "content_type") if x in kept.columns]))
    reports.write_lines(extraction.document(tables, rules), f"{out}/secrets.json")
    reports.write_lines(extraction.report(tables, rules), f"{out}/extraction.md")
    return tables


def _states(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """(canon_key, state) of rows, and of references to keys without one, which were never in scope."""
    own = manifest.groupBy("canon_key").agg(F.when(F.max_by(F.col("sha256").isNotNull(), "seq"), "fetched").otherwise("errored").alias("state"))
    rest = frontier.unfetched(edges, manifest).withColumn("state", F.lit("out_of_scope"))
    return own.unionByName(rest)


def _bodies(manifest: DataFrame, blobs: DataFrame, scope: Column) -> DataFrame:
    """First rows of bodies that are text, with the text and the scope that links are held against."""
    rows = artifacts.first_rows(manifest).join(blobs, "sha256").withColumn("text", links.body_text(F.col("content")))
    return rows.select("seq", "url", "canon_key", "content_type", "url_ext", "text", scope.alias("scope"))


def _root(manifest: DataFrame) -> tuple[str, Column]:
    """The first row's URL, and its scope."""
    root = manifest.orderBy("seq").first()["url"]
    return root, url.scope(F.lit(root))


def crawl(spark: SparkSession, root: str, out: str, rules: Rules = Rules()) -> None:
    """Writes keys and edges (folders of JSON lines): what a crawl from the capture's first URL finds again in its pages.

    Pages that can be expanded are harvested as they were rendered, or as they came; the first row of a key is its page.
    """
    manifest, blobs = artifacts.read_manifest(spark, root), artifacts.read_blobs(spark, root)
    if manifest.isEmpty():
        return
    start, scope = _root(manifest)
    first = frontier.distinct_keys(manifest)
    shown = first.filter(content.expandable(F.col("status"), F.col("content_type"))).withColumn("sha256", F.coalesce("rendered_sha256", "sha256"))
    pages = shown.join(blobs, "sha256").select("canon_key", F.coalesce("final_url", "url").alias("url"), content.utf8(F.col("content")).alias("html"))
    scanned = links.scan_links(first.filter("sha256 is not null").withColumn("scope", scope), _bodies(manifest, blobs, scope))
    got = first.filter("sha256 is not null").select("canon_key", "url", "final_url", "status")
    keys, edges = crawling.crawl(start, got, links.dom_links(pages), scanned, rules)
    keys.write.mode("overwrite").json(f"{out}/keys")
    edges.write.mode("overwrite").json(f"{out}/edges")


def report(spark: SparkSession, root: str, out: str, rules: Rules = Rules()) -> None:
    """Writes filetypes.md, coverage.md and, where an extraction has been written to out, submission.md."""
    manifest, edges = artifacts.read_manifest(spark, root), artifacts.read_edges(spark, root)
    reports.write_lines(reports.filetypes_report(manifest), f"{out}/filetypes.md")
    states = _states(manifest, edges)
    frontier.assert_accounted(edges.select(F.col("dst").alias("canon_key")).union(manifest.select("canon_key")), states)
    review = None
    if not manifest.isEmpty():
        bodies = _bodies(manifest, artifacts.read_blobs(spark, root), _root(manifest)[1])
        review = links.review(bodies.select(F.col("seq").alias("id"), F.col("url").alias("base"), "scope", "text")).orderBy("ref")
    reports.write_lines(reports.coverage_report(manifest, edges, states, _depths(manifest, edges), review), f"{out}/coverage.md")
    tables = {n: spark.read.parquet(f"{out}/tables/{n}") for n in ("secrets", "divergences", "ruled_out", "needs_review", "images")}
    tables["images"] = tables["images"].select("url", "format", "candidates_tried", "candidates_with_hits", "ruling").orderBy("url")
    reports.write_lines(reports.submission_report(manifest, edges, tables, rules.expected), f"{out}/submission.md")


def _depths(manifest: DataFrame, edges: DataFrame) -> DataFrame:
    """Depths from the first row's key."""
    return graph.bfs(edges, manifest.orderBy("seq").limit(1).select(F.col("canon_key").alias("node")))


def dot(spark: SparkSession, root: str, out: str, rules: Rules = Rules()) -> None:
    """Writes graph.dot, a folder of text files whose lines in the files' order are the graph: ranges are sorted each on their own."""
    manifest, edges = artifacts.read_manifest(spark, root), artifacts.read_edges(spark, root)
    nodes = graph.graph_nodes(edges, manifest, _states(manifest, edges), _depths(manifest, edges))
    graph.dot_lines(nodes, edges).orderBy("place", "line").select("line").write.mode("overwrite").text(f"{out}/graph.dot")


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["extract", "report", "graph", "crawl"])
    p.add_argument("root")
    p.add_argument("--out")
    p.add_argument("--prefix", default=Rules.prefix)
    p.add_argument("--expected", type=int, default=Rules.expected)
    a = p.parse_args()
    {"extract": extract, "report": report, "graph": dot, "crawl": crawl}[a.job](SparkSession.builder.getOrCreate(), a.root, a.out or a.root, Rules(prefix=a.prefix, expected=a.expected))


if __name__ == "__main__":
    main()
