"""Benchmark decontamination by suffix arrays over the training documents.

A task takes documents until they have about SHARD_WORDS words and sorts the suffixes of their words
into an array, leaving out stretches that no benchmark item can match: those with a word that the
benchmark lacks, and those shorter than the shortest window. Every suffix of every item is then
searched for in that array by bisection, a word deeper each time, all suffixes at once; that gives
the places of each window and how far a match goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

WINDOW, SHARD_WORDS = 10, 500_000
#: Characters of benchmark text that are broadcast at once; a larger benchmark is taken in blocks.
BENCHMARK_CHARS = 32_000_000
#: ASCII letters in lower case, digits and all non-ASCII bytes stay, other bytes part words.
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
MATCH = "struct<item_id:long,item_start:int,doc_start:int,n_words:int>"
FOUND = f"n_words long, hits array<struct<start:int,end:int>>, items array<long>, matches array<{MATCH}>"


def words(text: str | None) -> list[bytes]:
    return c.encoded(text).translate(LETTERS).split() if text else []


class Vocabulary(dict):
    """Words of the benchmark, from 1; 0 for others."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Suffixes:
    """All suffixes of the benchmark's items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        own = [(i, x) for i, t in items if (x := words(t))]
        self.vocabulary = Vocabulary({w: k for k, w in enumerate(sorted({w for _, x in own for w in x}), 1)})
        n = np.array([len(x) for _, x in own], np.int64)
        self.h = np.array([self.vocabulary[w] for _, x in own for w in x], np.int64)
        #: The item_ids in order, and where among them each suffix has its own; -1 without one.
        self.ids = sorted({i for i, _ in own if i is not None})
        place = {i: k for k, i in enumerate(self.ids)}
        self.item = np.repeat(np.array([place.get(i, -1) for i, _ in own], np.int64), n)
        self.pos = c.runs(n)
        self.left = np.repeat(n, n) - self.pos
        #: Words in a window of the suffix's item.
        self.window = np.repeat(np.minimum(n, window), n)
        self.shortest, self.longest = (int(n.min(initial=window)), int(n.max(initial=0))) if len(own) else (window, 0)


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes of seq (0 or above), sorted by their first `depth` numbers at least."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth and len(seq):
        key = rank * (len(seq) + 1)
        key[:-k or None] += rank[k:] + 1 if k < len(seq) else 0
        order = np.argsort(key, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        k *= 2
        if rank.max() == len(seq) - 1:
            break
    return order


def bisected(seq: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, target: np.ndarray, right: bool) -> np.ndarray:
    """For each range of sa, sorted at that depth, the first place with the target, or after it."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = sa[np.minimum(mid, len(sa) - 1)] + depth
        v = np.where(at < len(seq), seq[np.minimum(at, len(seq) - 1)], 0)
        down = open_ & ((v <= target) if right else (v < target))
        lo, hi = np.where(down, mid + 1, lo), np.where(open_ & ~down, mid, hi)
    return lo


def _matches(seq: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix that starts a window of its item, and each place of seq where that window is."""
    sa = suffix_array(seq, int(tests.window.max(initial=1)))
    t = np.flatnonzero(tests.left >= tests.window)
    lo, hi, found = np.zeros(len(t), np.int64), np.full(len(t), len(sa)), []
    for depth in range(int(tests.window.max(initial=0))):
        target = tests.h[t + depth]
        low = bisected(seq, sa, lo, hi, depth, target, False)
        hi, lo = bisected(seq, sa, low, hi, depth, target, True), low
        full = (lo < hi) & (tests.window[t] == depth + 1)
        count = (hi - lo)[full]
        found.append((np.repeat(t[full], count), sa[np.repeat(lo[full], count) + c.runs(count)]))
        on = (lo < hi) & ~full
        t, lo, hi = t[on], lo[on], hi[on]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _scanned(texts: list[str | None], tests: Suffixes) -> list[tuple]:
    split = [words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    ids = np.zeros(len(n) + int(n.sum()), np.int64)  # a 0 after each document
    first = np.cumsum(n + 1) - n - 1
    look = tests.vocabulary.__getitem__
    for a, w in zip(first.tolist(), split):
        ids[a : a + len(w)] = np.fromiter(map(look, w), np.int64, len(w))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= tests.shortest
    start, size = start[long], (end - start)[long] + 1  # with the 0 behind it
    place = np.repeat(start, size) + c.runs(size)
    t, at = _matches(ids[place], tests)
    at = place[at]
    doc = np.repeat(np.arange(len(n)), n + 1)
    out: list[tuple] = [(int(x), [], [], []) for x in n]
    if not len(t):
        return out
    covered = np.zeros(len(ids) + 1, np.int32)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + tests.window[t], -1)
    hit = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(covered) > 0])))
    for a, b in zip(hit[::2].tolist(), hit[1::2].tolist()):
        d = int(doc[a])
        out[d][1].append((a - int(first[d]), b - int(first[d])))
    pairs = np.unique(np.stack([doc[at], tests.item[t]]), axis=1)
    for d, i in pairs.T.tolist():
        if i >= 0:
            out[d][2].append(tests.ids[i])
    longer = (tests.pos[t] > 0) & (at > first[doc[at]]) & (ids[np.maximum(at - 1, 0)] == tests.h[np.maximum(t - 1, 0)])
    t, at = t[~longer], at[~longer]
    length, on = tests.window[t].copy(), np.arange(len(t))
    while len(on):
        k = length[on]
        on = on[(k < tests.left[t[on]])]
        k = length[on]
        on = on[ids[at[on] + k] == tests.h[t[on] + k]]
        length[on] += 1
    for d, i, p, q, k in zip(doc[at].tolist(), tests.item[t].tolist(), tests.pos[t].tolist(), (at - first[doc[at]]).tolist(), length.tolist()):
        out[d][3].append((tests.ids[i] if i >= 0 else None, p, q, k))
    return out


def _each(tests, schema: pa.Schema):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tests.value
        for b in batches:
            texts, k, size = b.column(0).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "") // 5
                if size >= SHARD_WORDS or i == len(texts) - 1:
                    found = _scanned(texts[k : i + 1], own)
                    cols = [pa.array(x, f.type) for x, f in zip(zip(*found), schema)]
                    yield pa.RecordBatch.from_arrays([*(x.slice(k, i + 1 - k) for x in b.columns[1:]), *cols], names=[*b.schema.names[1:], *schema.names])
                    k, size = i + 1, 0

    return each


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_MATCH = pa.struct([("item_id", pa.int64()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())])
_FOUND = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(_SPAN)), ("items", pa.list_(pa.int64())), ("matches", pa.list_(_MATCH))])


def _block(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    rows = [(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").filter("text is not null").toLocalIterator()]
    tests = docs.sparkSession.sparkContext.broadcast(Suffixes(rows, window))
    extra = [x for x in docs.columns if x != "text"]
    return docs.select("text", *extra).mapInArrow(_each(tests, _FOUND), c.extended(docs, extra, FOUND))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chars: int = BENCHMARK_CHARS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, hits, items, matches.

    hits: the stretches of words (start, end) inside occurrences of windows; items: the item_ids that
    have such windows, sorted; matches: the longest verbatim matches, each with its places in words.
    A window is `window` words in a row of an item, or all of a shorter one. Null texts have no words;
    items without words match nothing, and an empty benchmark nothing at all. Items without an item_id
    make hits and matches, and are left out of items. Rows that repeat a doc_id are each returned; other columns
    aren't read. A benchmark of more than `chars` characters is searched for in blocks.
    """
    docs = docs.select("doc_id", "text")
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    if n <= 1:
        return _block(docs, benchmark, window)
    parts = c.cut(docs.withColumn("row", F.struct(F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("k"))))
    found = [c.cut(_block(parts, benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k), window)) for k in range(n)]
    every = found[0]
    for x in found[1:]:
        every = every.union(x)
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(x)).alias(x) for x in ("hits", "items", "matches")))
    return merged.select("doc_id", "n_words", _joined("hits"), F.array_sort(F.array_distinct("items")).alias("items"), "matches")


def _joined(hits: str):
    """Sorted stretches, those that overlap or touch made one."""
    last = lambda acc: F.element_at(acc, -1)
    whole = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(F.array_sort(hits), none, lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))), whole(acc, x)).otherwise(F.concat(acc, F.array(x)))).alias(hits)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark; rows without a doc_id are judged alike, null and empty texts hold none."""
    found = scan(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"), benchmark, window)
    return found.filter(F.size("hits") == 0).select("doc_id.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s FROM item, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM low, size, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
found AS (SELECT doc_id, item_id, i, n FROM place JOIN win USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
had AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN had USING (doc_id)
"""
