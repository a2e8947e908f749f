"""Language ID by error-correcting output codes over character n-grams.

Each language has a codeword; a binary classifier for each bit sums log odds of hashed n-grams, scaled to
a logit. A text's language is the one whose codeword has the least loss, each bit's logistic loss
weighing as much as the bit can be trusted; a small lead over the next one marks it as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

BITS, ORDERS = 13, 3
#: Labelled rows that the model is fitted on, at most, as many of each language as there are.
SAMPLE = 2000
#: A lead in loss below this, as a probability of the best, is ambiguous.
AMBIGUOUS = 0.8
NONE = "und"
PREDICTED = ("lang_pred", "score", "ambiguous")
BLOCK = 400_000


@cache
def letters() -> np.ndarray:
    return np.array([0xD800 <= x < 0xE000 or not chr(x).isalpha() for x in range(0x110000)]) == 0


def codewords(k: int) -> np.ndarray:
    """k distinct rows of -1 and 1: all columns that tell some from others if k is 5 or less, else 12 bits for each doubling of k, spread by a hash."""
    if k <= 5:
        return np.array([[1 if col >> row & 1 else -1 for col in range(1, 1 << k, 2) if col != (1 << k) - 1] or [1] for row in range(k)])
    n = 12 * int(np.ceil(np.log2(k)))

    def rows(seed: int) -> np.ndarray:
        return np.where(c.mix(np.arange(k * n, dtype=np.uint64) + np.uint64(seed * k * n + 1)) >> np.uint64(63), 1, -1).reshape(k, n)

    return max((rows(s) for s in range(20)), key=lambda m: (n - m @ m.T + 4 * n * np.eye(k)).min())


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and coordinate of every n-gram of letters and gaps, and each text's number of letters."""
    texts = [f" {t.lower()} " if t else " " for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = letters()[x.astype(np.int64)]
    doc = np.repeat(np.arange(len(texts)), size)
    n = np.bincount(doc, own, minlength=len(texts)).astype(np.int64)
    solid = own | np.append(True, own[:-1]) | (np.diff(doc, prepend=-1) != 0)  # one gap for each run of others
    x, doc = np.where(own, x, np.uint64(32))[solid], doc[solid]
    out_doc, out_at = [], []
    for k in range(ORDERS):
        m = max(0, len(x) - k)
        key = np.full(m, k + 1, np.uint64) << np.uint64(62)
        for j in range(k + 1):
            key ^= x[j : j + m] << np.uint64(20 * j)
        same = doc[:m] == doc[k:]
        out_doc.append(doc[:m][same])
        out_at.append((c.mix(key)[same] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out_doc), np.concatenate(out_at), n


def logits(texts: list[str | None], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log odds of each bit (0 for texts without n-grams), and numbers of letters."""
    out, n = np.zeros((len(texts), w.shape[1])), np.zeros(len(texts), np.int64)
    for k, some in c.blocks(texts, BLOCK):
        doc, at, n[k : k + len(some)] = grams(some)
        size = np.maximum(1, np.bincount(doc, minlength=len(some)))
        for b in range(w.shape[1]):
            out[k : k + len(some), b] = np.bincount(doc, w[:, b][at], minlength=len(some)) / size
    return out, n


def odds(rows: list[tuple[str, int]], code: np.ndarray) -> np.ndarray:
    """Log odds of each n-gram's coordinate for each bit, from (text, number of its language)."""
    y, total = np.array([k for _, k in rows]), np.zeros((len(code), 1 << BITS))
    for k, some in c.blocks([t for t, _ in rows], BLOCK):
        doc, at, _ = grams(some)
        share = 1.0 / np.maximum(1, np.bincount(doc, minlength=len(some)))
        np.add.at(total, (y[k + doc], at), share[doc])
    p = total / np.maximum(1e-9, total.sum(1, keepdims=True)) + 1e-5
    one, other = (np.stack([p[code[:, j] == v].mean(0) if (code[:, j] == v).any() else p.mean(0) for j in range(code.shape[1])], 1) for v in (1, -1))
    return np.log(one) - np.log(other)


def fitted(rows: list[tuple[str, str]]) -> dict:
    """languages, codewords (code), log odds (w), each bit's scale and shift (a, b) and trust, from (text, language).

    Scales, shifts and trust are measured on the rows of every fifth hash, which log odds aren't taken from; a
    language without other rows keeps them, and without any row to measure on all are measured on.
    """
    names = sorted({x for _, x in rows})
    code, place = codewords(len(names)), {x: k for k, x in enumerate(names)}
    own = [(t, place[x], xxhash.xxh64_intdigest(c.encoded(t), 1) % 5 == 0) for t, x in rows]
    bare = set(place.values()) - {k for _, k, held in own if not held}
    w = odds([(t, k) for t, k, held in own if not held or k in bare], code)
    held = [(t, k) for t, k, out in own if out and k not in bare] or [(t, k) for t, k, _ in own]
    f, bits = logits([t for t, _ in held], w)[0], (code[np.array([k for _, k in held])] + 1) / 2
    a, b = np.ones(code.shape[1]), np.zeros(code.shape[1])
    for _ in range(25):  # Newton's method, with a penalty that keeps separable bits finite
        q = 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
        g, v = q - bits, q * (1 - q) + 1e-6
        h = np.stack([(v * f * f).sum(0) + 0.05, (v * f).sum(0), v.sum(0) + 0.05])
        ga, gb = (g * f).sum(0) + 0.05 * (a - 1), g.sum(0) + 0.05 * b
        det = h[0] * h[2] - h[1] * h[1]
        a, b = a - np.clip((h[2] * ga - h[1] * gb) / det, -5, 5), b - np.clip((h[0] * gb - h[1] * ga) / det, -5, 5)
    # Bits without a mistake on so few rows aren't sure: one mistake more, and one row, is counted.
    right = (((a * f + b > 0) == (bits > 0.5)).sum(0) + 0.5) / (len(held) + 1)
    return {"languages": names, "code": code, "w": w.astype(np.float32), "a": a, "b": b, "trust": np.clip(2 * right - 1, 0.05, 1)}


def decoded(f: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row of logits, and its probability."""
    z = np.clip(m["a"] * f + m["b"], -35, 35)
    loss = np.stack([(m["trust"] * np.logaddexp(0, -word * z)).sum(1) for word in m["code"]], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return loss.argmin(1), 1 / p.sum(1)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    rows = sorted(r for b in batches for r in zip(*(x.to_pylist() for x in b.columns)))
    if rows:
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fitted(rows))]})


def model(labelled: DataFrame, sample: int = SAMPLE) -> dict | None:
    """fitted() on a sample of labelled (text, lang), of as many distinct texts of each language as there are; None without rows.

    Repeated rows count once; a text with several languages is one of each. The driver gets the model.
    """
    import pickle

    labelled = labelled.filter("text is not null").select("lang", "text")
    n = labelled.agg(F.count_distinct("lang")).first()[0]
    if not n:
        return None
    some = c.sample(labelled, max(1, sample // n), "lang")
    return pickle.loads(some.select("text", "lang").coalesce(1).mapInArrow(_fit, "model binary").first()[0])


def predicted(docs: DataFrame, found: dict | None, *keep: str) -> DataFrame:
    """The columns to keep, lang_pred, score (0 to 1) and ambiguous, a row for each row of docs, over its whole text.

    Texts that are null or have no letter, and all texts if there is no model, are NONE with a score of 0.
    Of codewords that are equally near, that of the language first in order is taken. Repeated rows are each
    predicted, alike; long texts are read whole; no rows give no rows. Columns that aren't named aren't read,
    and one to keep that is called as a new one gives way to it.
    """
    keep = c.apart(keep, *PREDICTED)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            best, p, n = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), int)
            if m and texts:
                f, n = logits(texts, m["w"])
                best, p = decoded(f, m)
            names = [m["languages"][k] if x else NONE for k, x in zip(best.tolist(), n.tolist())]
            p = np.where(n > 0, p, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(p), pa.array(p < AMBIGUOUS)], names=[*b.schema.names[1:], *PREDICTED])

    schema = c.extended(docs, keep, "lang_pred string, score double, ambiguous boolean")
    return docs.select("text", *keep).mapInArrow(each, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    found = predicted(docs, model(docs.filter(~held)), "doc_id")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
