"""The reference graph: nodes, breadth-first depths, DOT."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import HOW_STYLES, PREFIX_FILL, STATE_FILL, TYPE_FILL

#: Levels that are joined by a union before they are cut together.
KNOWN_LEVELS = 20


def nodes(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(manifest.select("canon_key")).distinct()


def bfs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth) of all that can be reached from roots (node) over edges (src, dst), however far.

    A round joins the newest level with the edges and leaves out what is known; every level is cut
    to the checkpoint folder, and what is known every KNOWN_LEVELS rounds, so that plans don't grow
    and lost executors cost no level twice.
    """
    ensure_checkpoints(edges)
    links = edges.select("src", "dst").distinct()
    known = roots.select("node", F.lit(0).alias("depth")).distinct().checkpoint()
    level, depth = known, 0
    while True:
        depth += 1
        new = level.join(links, level["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        level = new.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        known = known.union(level)
        if depth % KNOWN_LEVELS == 0:
            known = known.checkpoint()
    return known


def ensure_checkpoints(df: DataFrame) -> None:
    import tempfile

    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line) of a DOT graph of nodes (node, state, content_type, depth) and edges (src, dst, how), in order of place and line.

    A quotation mark in a key is escaped, as it would end the node's name.
    """
    fill, kind = F, F.coalesce("content_type", F.lit(""))
    for when, table in ((lambda x: F.col("state") == x, STATE_FILL), (kind.startswith, PREFIX_FILL), (lambda x: kind == x, TYPE_FILL)):
        for x, colour in table.items():
            fill = fill.when(when(x), colour)
    shape = F.when(F.col("state").isin(*STATE_FILL), "box").otherwise("ellipse")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    label = F.concat(F.replace(F.col("node"), F.lit('"'), F.lit("'")), F.coalesce(F.concat(F.lit("\\n(d="), F.col("depth").cast("string"), F.lit(")")), F.lit("")))
    node = F.concat(F.lit("  "), quoted(F.col("node")), F.lit(' [label="'), label, F.lit('", shape='), shape, F.lit(', style=filled, fillcolor="'), fill.otherwise("white"), F.lit('"];'))
    colour, style = F, F
    for how, (c, s) in HOW_STYLES.items():
        colour, style = colour.when(F.col("how") == how, c), style.when(F.col("how") == how, s)
    edge = F.concat(F.lit("  "), quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(' [label="'), F.col("how"), F.lit('", color='), colour.otherwise("black"), F.lit(", style="), style.otherwise("solid"), F.lit("];"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph site {"), (1, "  rankdir=LR;"), (2, '  node [fontname="Helvetica"];'), (5, "}")], "place int, line string")
    return ends.union(nodes.select(F.lit(3), node)).union(edges.select(F.lit(4), edge))


def graph_nodes(edges: DataFrame, manifest: DataFrame, states: DataFrame, depths: DataFrame) -> DataFrame:
    """(node, state, content_type, depth) for dot_lines: every end of a reference and every row, a key's last row deciding its type."""
    last = manifest.groupBy(F.col("canon_key").alias("node")).agg(F.max_by("content_type", "seq").alias("content_type"))
    own = states.select(F.col("canon_key").alias("node"), "state")
    return nodes(edges, manifest).filter("node is not null").join(last, "node", "left").join(own, "node", "left").join(depths, "node", "left").select("node", "state", "content_type", "depth")
