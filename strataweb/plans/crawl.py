"""A crawl over pages that have been captured: discovery in turns with scans, to a fixpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as u
from ..rules import DECLARED, Rules
from .frontier import capped, distinct_keys, ranked
from .graph import ensure_checkpoints

EDGE = "src string, dst string, how string, hint string, depth int"
#: Rows of a turn up to which one task puts them in order, and what they are joined with isn't shuffled.
SMALL = 20_000
#: Turns' tables that are kept apart.
PIECES = 8


def seeds(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(found, edges) that a crawl of a root URL begins with: the root at depth 0, and declared paths at depth 1."""
    rows = spark.createDataFrame([(root, "", 0, 0), *((root, path, k, 1) for k, path in enumerate(DECLARED, 1))], "root string, path string, place int, depth int")
    site = u.scope(F.col("root"))
    urls = rows.select(u.canon_key(F.col("root")).alias("src"), F.when(F.col("path") == "", F.col("root")).otherwise(F.concat(u.origin(F.col("root")), "path")).alias("url"), "place", "depth", site.alias("scope"))
    found = urls.select(F.struct(F.lit(0).cast("long").alias("parent"), F.lit(0).alias("kind"), "place").alias("seq"), u.canon_key(F.col("url")).alias("canon_key"), "url", "depth", u.in_scope(F.col("url"), F.col("scope")).alias("in_scope"))
    edges = urls.filter("depth = 1").select("src", u.canon_key(F.col("url")).alias("dst"), F.lit("seed").alias("how"), F.lit("declared-path").alias("hint"), F.lit(0).alias("depth"))
    return found.filter("in_scope or depth = 0"), edges


def crawl(root: str, pages: DataFrame, dom: DataFrame, scanned: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """(keys, edges): what a crawl of root reaches over pages (canon_key, final_url or null), to a fixpoint.

    dom (src, dst_url, how, hint, place) are references of expanded pages, scanned (the same) those that scans
    find in headers and bodies; place orders a page's. Keys are discovered in the order of a queue: a page's redirect first, at the
    page's own depth, then its references in their order, a level deeper; when the queue is empty, pages that
    are new are scanned, in the order they were fetched. Each key is capped as it is discovered. keys: canon_key,
    depth, rank, and state: fetched, errored (capped, or not captured) or out_of_scope. edges: all of dom's and redirects,
    but scanned ones of new keys only. A turn's keys and edges are cut to the checkpoint folder; what is known is
    joined, not collected. Small turns are broadcast to what is known and to the references, and templates are counted
    only where a cap can be reached.
    """
    spark = pages.sparkSession
    ensure_checkpoints(pages)
    site = spark.range(1).select(u.scope(F.lit(root))).first()[0]
    scope = F.struct(*(F.lit(x).alias(n) for n, x in zip(("scheme", "host", "port"), site)))
    target = lambda links: links.withColumn("canon_key", u.canon_key(F.col("dst_url"))).withColumn("in_scope", u.in_scope(F.col("dst_url"), scope))
    redirects = target(pages.filter("final_url is not null and final_url <> url").select(F.col("canon_key").alias("src"), F.col("final_url").alias("dst_url"), F.concat(F.lit("HTTP "), F.col("status").cast("string")).alias("hint")))
    redirects = redirects.withColumn("how", F.lit("redirect")).withColumn("place", F.lit(0)).withColumn("kind", F.lit(0))
    found_in, scans = target(dom).withColumn("kind", F.lit(1)), target(scanned).withColumn("kind", F.lit(2))
    cols = ["src", "canon_key", "dst_url", "in_scope", "how", "hint", "place", "kind"]
    got = pages.select(F.col("canon_key").alias("src"))
    by_page = redirects.select(cols).unionByName(found_in.select(cols).join(got, "src", "left_semi")).checkpoint()
    by_scan = scans.select(cols).join(got, "src", "left_semi").checkpoint()
    found, first = seeds(spark, root)
    # Tables with their numbers of rows; size: how many rows a turn has at most, n: how many keys are known, of which scans have seen those up to seen.
    known, edges, n, seen = [], [(first.checkpoint(), len(DECLARED))], 0, 0
    turn, size = found.select("seq", "canon_key", F.col("url").alias("dst_url"), "depth", "in_scope"), len(DECLARED) + 1
    while True:
        fresh = distinct_keys(turn.select("seq", "canon_key", "depth", "in_scope"))
        if known:
            fresh = _without(fresh, turn.select("canon_key"), _whole(known).select("canon_key"), size)
        if n + size > min(rules.max_keys, rules.max_per_template):
            taken = _whole(known).filter("state = 'enqueued'").groupBy(u.query_template(F.col("canon_key")).alias("template")).agg(F.count("*").alias("n")) if known else None
            keys = capped(fresh.withColumn("template", u.query_template(F.col("canon_key"))), rules.max_keys, rules.max_per_template, n, taken)
        else:
            keys = ranked(fresh) if size > SMALL else fresh.withColumn("rank", F.row_number().over(Window.orderBy("seq")))
            keys = keys.withColumn("state", F.when(F.col("in_scope"), "enqueued").otherwise("out_of_scope"))
        keys = keys.select("canon_key", "depth", (F.col("rank") + n).cast("long").alias("rank"), "state").checkpoint()
        count = keys.count()
        if count:
            known, n = _fewer([*known, (keys, count)]), n + count
            links = by_page.join(_sent(keys.filter("state = 'enqueued'").select(F.col("canon_key").alias("src"), "depth", "rank"), count), "src").hint("rebalance").checkpoint()
            size = links.count()
            edges = _fewer([*edges, (links.select("src", F.col("canon_key").alias("dst"), "how", "hint", "depth"), size)])
            # A redirect out of scope isn't seen.
            turn = links.filter("kind > 0 or in_scope").withColumn("depth", F.when(F.col("kind") > 0, F.col("depth") + 1).otherwise(F.col("depth")))
        elif seen < n:
            new = _whole(known).filter(f"state = 'enqueued' and rank > {seen}").select(F.col("canon_key").alias("src"), "depth", "rank")
            links = by_scan.join(_sent(new, n - seen), "src").join(_whole(known).select("canon_key"), "canon_key", "left_anti")
            links = links.withColumn("seq", F.struct(F.col("rank").alias("parent"), "kind", "place")).hint("rebalance").checkpoint()
            size, seen = links.count(), n
            edges = _fewer([*edges, (distinct_keys(links).select("src", F.col("canon_key").alias("dst"), "how", "hint", "depth"), size)])
            turn = links.withColumn("depth", F.col("depth") + 1)
        else:
            break
        turn = turn.withColumn("seq", F.struct(F.col("rank").alias("parent"), "kind", "place"))
    keys = _whole(known).join(pages.select("canon_key", F.lit(True).alias("_got")), "canon_key", "left")
    state = F.when(F.col("state") == "out_of_scope", "out_of_scope").when((F.col("state") == "enqueued") & F.col("_got"), "fetched").otherwise("errored")
    capped_by = F.when(F.col("state").isin("global", "template"), F.col("state"))
    return keys.select("canon_key", "depth", "rank", state.alias("state"), capped_by.alias("capped")), _whole(edges)


def _whole(pieces: list[tuple[DataFrame, int]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (x for x, _ in pieces))


def _fewer(pieces: list[tuple[DataFrame, int]]) -> list[tuple[DataFrame, int]]:
    """The pieces; of over PIECES the last ones are cut together, with those before that have at most twice as many rows."""
    k, n = len(pieces) - 1, pieces[-1][1]
    while len(pieces) > PIECES and k and pieces[k - 1][1] <= 2 * n:
        k, n = k - 1, n + pieces[k - 1][1]
    return pieces if k == len(pieces) - 1 else [*pieces[:k], (_whole(pieces[k:]).hint("rebalance").checkpoint(), n)]


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SMALL else rows


def _without(found: DataFrame, keys: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """found without known keys; keys are found's, n at most."""
    if n <= SMALL:
        known = F.broadcast(known.join(F.broadcast(keys), "canon_key", "left_semi"))
    return found.join(known, "canon_key", "left_anti")
