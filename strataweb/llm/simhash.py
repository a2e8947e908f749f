"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are 64 bits over word shingles. Two of them link if they differ in at most `radius`
bits. A pair that close agrees on at least `BLOCKS - radius` of BLOCKS blocks of bits, so the
fingerprints that share such a set of blocks form a shard, and each pair meets in a shard. In a
shard, fingerprints are sorted by Gray rank and grouped by fours into a tree; a node holds the bits
that all below it share, without those its parent holds already. A search walks down the tree,
adds up the differences on those bits and leaves a group once there are more than `radius`; a group
that can't exceed `radius` any more is taken as a whole. A shard yields a spanning forest of its
links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bits are in so many blocks; a shard shares all but RADIUS of them.
BLOCKS = 6
#: Children of a node of the index.
FANOUT = 4
#: A shard with more fingerprints is dealt as pairs of parts of about this size, up to so many parts.
SHARD, PARTS = 4096, 8
#: A shard of more parts is split by further bits, so many times; then it is dealt as parts whatever their number.
SPLITS = 2
#: Pairs of a query and a node that are looked at together.
FRONTIER = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text: ASCII lower-cased words, split at ASCII white space.

    Fewer words than a shingle: the whole sequence is the shingle. None, empty or blank: 0.
    """
    words = c.encoded(text).lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    first, last, bits = starts[:n].tolist(), ends[len(words) - n :].tolist(), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        h = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k : k + (1 << 15)], last[k : k + (1 << 15)])]
        bits += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) for each row, over the whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(each, "id long, fp long")


def gray_rank(x: Column) -> Column:
    """The place of a 64-bit word in the Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """The bits that each family of shards shares, as signed numbers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    found = [reduce(int.__or__, x) for x in combinations(part, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, with the smallest row of each component, after the links a-b."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while len(a) and (label[label] != label).any():
            label = label[label]
    return label


def forest(first: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest row that it is linked with, directly or not, in its shard.

    first: each row's first row in its shard; rows are sorted by shard, then Gray rank.
    """
    n, pos = len(fp), np.arange(len(fp)) - first
    levels = [(np.arange(n), fp, np.full(n, ~np.uint64(0)))]
    step = 1
    while step <= pos.max(initial=0):
        step *= FANOUT
        starts = np.flatnonzero(pos % step == 0)
        shared = ~(np.bitwise_and.reduceat(fp, starts) ^ np.bitwise_or.reduceat(fp, starts))
        levels.append((starts, fp[starts] & shared, shared))
    label = np.arange(n)
    if len(levels) == 1:
        return label
    size = np.bincount(first, minlength=n)[first]
    ask = np.flatnonzero(pos < size - 1)  # a query looks at later rows only
    part = np.cumsum(size[ask]) // FRONTIER
    for some in np.split(ask, np.flatnonzero(np.diff(part)) + 1):
        q, node, more = some, np.searchsorted(levels[-1][0], first[some]), np.zeros(len(some), np.int64)
        more = np.bitwise_count((fp[q] ^ levels[-1][1][node]) & levels[-1][2][node]).astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(levels) - 2, -1, -1):
            upper, (starts, value, shared) = levels[k + 1], levels[k]
            low = np.searchsorted(starts, upper[0])
            count = np.diff(np.append(low, len(starts)))[node]
            above = np.repeat(upper[2][node], count)
            q, more, node = np.repeat(q, count), np.repeat(more, count), np.repeat(low[node], count) + c.runs(count)
            more = more + np.bitwise_count((fp[q] ^ value[node]) & shared[node] & ~above)
            end = np.append(starts[1:], n)[node]
            keep = (more <= radius) & (end - 1 > q)
            q, more, node, end = q[keep], more[keep], node[keep], end[keep]
            whole = more + 64 - np.bitwise_count(shared[node]) <= radius
            found.append((q[whole], np.maximum(q[whole] + 1, starts[node[whole]])))
            q, more, node = q[~whole], more[~whole], node[~whole]
        label = _united(label, *(np.concatenate(x) for x in zip(*found)))
    return label


def _shard_links(radius: int, keys: int):
    """Over rows sorted by shard: links (a, b) between ids, at most one fewer than a shard has rows."""

    def links(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(k).to_numpy() for k in range(keys)]
        fp, rep = table.column(keys).to_numpy().view(np.uint64), table.column(keys + 1).to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in cols], axis=0)
        label = forest(np.flatnonzero(new)[np.cumsum(new) - 1], fp, radius)
        other = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(rep[other]), pa.array(rep[label[other]])], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 1 << 16:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            same = np.all([(x := t.column(k).to_numpy()) == x[-1] for k in range(keys)], axis=0)
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield links(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return each


def finer(mask: int, radius: int) -> list[int]:
    """Masks (signed) of which fingerprints within radius bits that agree on mask agree on one: mask and a part of the other bits."""
    free = [k for k in range(64) if not mask >> k & 1]
    if len(free) <= radius:
        return [mask]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    found = [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
    return [((m & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for m in found]


def _families(fps: DataFrame, radius: int, blocks: int, shard: int, parts: int) -> DataFrame:
    """fps by shard: (mask, bits, parts, fp, rep), each pair within radius in at least one shard.

    A shard of more than shard * parts rows is split by further bits, of which pairs agree on one part of
    radius + 1, so that each row is in radius + 1 finer shards, not in a pair of parts with every other. That
    helps where a shard's fingerprints are spread; those all near to each other stay together and are dealt as parts.
    """
    keys, out, families = ["mask", "bits"], [], masks(radius, blocks)
    spread = F.explode(F.array(*map(F.lit, families)))
    rows = fps.select("fp", "rep", spread.alias("mask"))
    for level in range(SPLITS + 1):
        rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        hot = c.cut(rows.groupBy(keys).count().filter(F.col("count") > shard).select(*keys, F.ceil(F.col("count") / shard).cast("int").alias("parts")))
        rows = c.by_small(rows, hot, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        many = [r[0] for r in hot.filter(F.col("parts") > parts).select("mask").distinct().collect()] if level < SPLITS else []
        split = (F.col("parts") > parts) & F.col("mask").isin(many)
        out.append(rows.filter(~split).select(*keys, "parts", "fp", "rep") if many else rows.select(*keys, "parts", "fp", "rep"))
        if not many:
            break
        table = rows.sparkSession.createDataFrame([(m, finer(m, radius)) for m in many], "mask long, finer array<long>")
        rows = rows.filter(split).join(F.broadcast(table), "mask").select("fp", "rep", F.explode("finer").alias("mask"))
    return reduce(DataFrame.union, out)


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard: int = SHARD, parts: int = PARTS) -> DataFrame:
    """Links (a, b) that join all of fps (fp, rep; each fp once) within radius bits, up to transitivity.

    Bits are in BLOCKS blocks, or in two more than radius if that are more. A shard of up to `parts` times
    `shard` rows is dealt as pairs of parts, a larger one is split by further bits.
    """
    if not 0 <= radius <= 62:
        raise ValueError("the radius is to be 0 to 62 bits")
    rows = _families(fps, radius, blocks or max(BLOCKS, radius + 2), shard, parts)
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    rows = rows.select("mask", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    keys = ["mask", "bits", "i", "j"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, gray_rank(F.col("fp")))
    return dealt.mapInArrow(_shard_links(radius, len(keys)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row (id_col, fingerprint, component_id) for each row of docs.

    component_id is the smallest id reachable over links, the row's own included. Null, empty and
    blank texts have the fingerprint zero, which is linked like any other. Rows that repeat an id
    are each returned. A null id stays null and gets its component's smallest id, or null if no row
    of the component has one. Other columns of docs aren't read; no rows give no rows.
    """
    prints = c.cut(fingerprints(docs, id_col, text_col, shingle))
    fps = prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    joined = components(near_links(fps.filter("rep is not null").select("fp", "rep"), radius))
    fps = fps.join(joined, fps["rep"] == joined["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    return c.join_unique(prints, fps, "fp", "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that have their component's smallest id; rows without an id stay, repeated rows too, and all columns do."""
    copies = near_duplicates(docs, id_col, text_col).filter(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(copies, id_col, "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"))
