"""What the operators of this subpackage share: reading tables, cutting lineage, word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(names: Iterable[str], *taken: str) -> list[str]:
    """The names, each once, without those that are taken in any case, as Spark would take them for the same."""
    seen, out = {x.lower() for x in taken}, []
    for x in names:
        if x.lower() not in seen:
            seen.add(x.lower())
            out.append(x)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a local one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Hadoop knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def sample(rows: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """At most n distinct rows, those with the least hash; with `by`, of each value of that column, nulls aside.

    Distinct rows are counted about, and those with a hash below what should let twice n through are gathered;
    were they fewer, the bound would be raised until there are n or none is left out. So about 2 n rows
    meet in one task at any number of rows, and repeated rows count once.
    """
    h = F.xxhash64(*rows.columns)
    known = F.approx_count_distinct(h).alias("_size")
    if by:
        rows = rows.filter(F.col(by).isNotNull())
        size = cut(rows.groupBy(by).agg(known))
    else:
        total = rows.agg(known).first()[0]
    times = 2.0
    while True:
        part = F.least(F.lit(1.0), times * (n + 50) / F.greatest(F.col("_size") if by else F.lit(total), F.lit(1)))
        upto = size.select(by, part.alias("_part")) if by else None
        some = by_small(rows, upto, by, "inner") if by else rows.withColumn("_part", part)
        some = some.filter(F.pmod(h, F.lit(1 << 52)) <= F.col("_part") * float(1 << 52)).select(*rows.columns).distinct()
        if by:
            found = cut(some.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(h, *rows.columns))).filter(F.col("_n") <= n).drop("_n"))
            got = found.groupBy(by).agg(F.count("*").alias("_got"))
            few = not upto.filter("_part < 1").join(got, by, "left").filter(f"coalesce(_got, 0) < {n}").isEmpty()
        else:
            found = cut(some.orderBy(h, *rows.columns).limit(n))
            few = times * (n + 50) < total and found.count() < n
        if not few:
            return found
        times *= 4


def by_small(df: DataFrame, small: DataFrame, on, how: str, rows: int = 100_000) -> DataFrame:
    """Join with a side that is usually small: broadcast where it has at most so many rows, else shuffled.

    small is to be cut, as it is counted first.
    """
    fits = small.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(small) if fits else small, on, how)


#: Rows of one key that may meet in a task of a join.
HOT = 100_000


def join_unique(df: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a side that has each key once, and in column n how many rows of df have it.

    Rows of keys that more than HOT rows have aren't shuffled by the key: these keys are at most a HOT-th of all rows,
    and are broadcast if they have been counted to be few.
    """
    rest, hot = side.drop(n), cut(side.filter(F.col(n) > HOT).drop(n))
    if hot.isEmpty():
        return df.join(rest, key)
    cold = by_small(df, hot.select(key), key, "left_anti").join(side.filter(F.col(n) <= HOT).drop(n), key)
    return by_small(df, hot, key, "inner").unionByName(cold)


def extended(docs: DataFrame, keep: Iterable[str], more: str) -> T.StructType:
    """The schema of the columns to keep of docs and those of a DDL string."""
    return T.StructType([*(docs.schema[x] for x in keep), *T.StructType.fromDDL(more).fields])


def trim() -> None:
    """Gives freed memory back to the system: what Arrow's pool holds and, where malloc is glibc's, what that holds."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes: one for each start, none if it is shorter."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    return mix(out)


def spans(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions the intervals [start, start + length) cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive runs of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


#: ASCII white space: the bytes between words.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: A factor, odd and 3 or 5 modulo 8 as are its odd powers, and its inverse modulo 2**64.
FACTOR = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, x in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Words:
    """The words of some texts, one text after another: h their 64-bit hashes, doc and pos where each
    stands; n and first, for each text, its number of words and its first one. gap: the bytes between words.

    A word's hash is a polynomial of its bytes' values modulo 2**64, mixed.
    """

    def __init__(self, texts: list[str | None], gap: np.ndarray = SPACE):
        raw = [encoded(t) if t else b"" for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.byte = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        self.begin = np.cumsum(size) - size
        edge = np.flatnonzero(np.diff(gap[self.byte], prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        power, inverse = _powers(len(self.byte) + 1)
        sums = np.cumsum(_VALUE[self.byte] * power[: len(self.byte)])
        before = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
        self.h = mix((sums[self.end - 1] - before) * inverse[self.start]) if len(self.start) else np.zeros(0, np.uint64)
        upto = np.searchsorted(self.start, self.begin + size)
        self.n = np.diff(upto, prepend=0)
        self.first = upto - self.n
        self.doc = np.repeat(np.arange(len(raw)), self.n)
        self.pos = np.arange(len(self.h)) - self.first[self.doc]


def blocks(texts: list[str | None], chars: int = 1_000_000):
    """Consecutive parts of the texts, of about so many characters: the first's place, and the part."""
    k = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= chars or i == len(texts) - 1:
            yield k, texts[k : i + 1]
            k, size = i + 1, 0
