"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

Each coordinate has a learning rate of its own, and an L1 penalty leaves most weights at zero, so
that what is broadcast is small; it has at most 2 ** BITS weights at any size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

BITS, ALPHA, BETA, L1, L2, EPOCHS = 20, 1.5, 1.0, 12.0, 1.0, 4
#: Labelled rows that the model is fitted on, at most, chosen by a hash of their ids.
SAMPLE = 16384
CUT = 0.3
#: Bytes between words: all ASCII but letters and digits.
GAP = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and coordinate of every word, of every pair of neighbours and of every pair with a word between."""
    x = c.Words([t.lower() if t else t for t in texts], GAP)
    found = [(x.doc, x.h)]
    for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        at = np.flatnonzero(x.pos + gap < x.n[x.doc])
        found.append((x.doc[at], c.mix(x.h[at] * np.uint64(factor) + x.h[at + gap])))
    doc, h = (np.concatenate(y) for y in zip(*found))
    return doc, (h >> np.uint64(64 - BITS)).astype(np.int64)


def fitted(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes over (distinct coordinates, label)."""
    z, n, bias, bias_n = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, y in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    return weights(z, n), float(bias)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in zip(*(x.to_pylist() for x in b.columns))), key=lambda r: (r[0], r[1] or "", r[2]))
    examples = []
    for k, texts in c.blocks([r[1] for r in rows]):
        doc, at = features(texts)
        pair = np.unique(doc << BITS | at)
        cuts = np.searchsorted(pair >> BITS, np.arange(len(texts) + 1))
        examples += [((pair[a:b] & (1 << BITS) - 1).astype(np.int32), rows[k + i][2]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    w, bias = fitted(examples)
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(w[some], bias))], names=["at", "w"])


def model(labelled: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Weights by coordinate, the bias at -1, of labelled (doc_id, text, label); no rows give a bias of -3.

    Repeated rows count once, rows without a label not at all; a null text is one without features.
    """
    rows = labelled.filter("label is not null").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    rows = c.sample(rows, sample)
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", "label")
    found = {r[0]: r[1] for r in rows.coalesce(1).mapInArrow(_fit, "at int, w double").collect()}
    return found if len(found) > 1 or found.get(-1) else {-1: -3.0}


def scores(texts: list[str | None], w: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for k, some in c.blocks(texts):
        doc, at = features(some)
        on = w[at] != 0
        pair = np.unique(doc[on] << BITS | at[on])
        out[k : k + len(some)] += np.bincount(pair >> BITS, w[pair & (1 << BITS) - 1], minlength=len(some))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def scored(docs: DataFrame, weights: dict[int, float], *keep: str) -> DataFrame:
    """The columns to keep and score (double, 0 to 1), a row for each row of docs, over its whole text, however long.

    Null and empty texts have no features; their score is the model's bias. Repeated rows are each scored, alike;
    no rows give no rows. Other columns aren't read, and one to keep that is called score gives way.
    """
    keep = c.apart(keep, "score")
    bias, own = weights[-1], {k: v for k, v in weights.items() if k >= 0}
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(own), np.int64), np.array(list(own.values()))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[shared.value[0]] = shared.value[1]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores(b.column(0).to_pylist(), w, bias))], names=[*b.schema.names[1:], "score"])

    schema = c.extended(docs, keep, "score double")
    return docs.select("text", *keep).mapInArrow(each, schema)


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels and documents may repeat rows; a document without an id is scored, and counts as not held out."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = c.table(spark, sf_dir, "labels").filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), 4) != 2))
    chosen = c.sample(marked.select("doc_id", F.col("toxic").alias("label")), SAMPLE)
    found = scored(docs, model(docs.join(F.broadcast(chosen), "doc_id")), "doc_id")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
