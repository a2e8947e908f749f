"""Host-level quality rules.

Rules are judged on each document first. Their failures are counted by host; a host's rate is shrunk
towards the mean of all hosts' by a beta prior that fits the spread between hosts, each host counting
once, and weighs at most as much as HEAVIEST documents. So a host with a few documents is judged
mostly as the others are, and one with many by its own, however large the corpus. A host with a shrunk rate over the limit is rejected
as a whole, and its verdict is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
#: A document fails these rules with more symbols, or repeated lines, than so many for 100 words.
SYMBOL_PERCENT, LINE_PERCENT = 60, 30
#: A host is rejected if the shrunk share of its documents that fail a rule is above this.
HOST_RATE = 0.5
#: Limits of the prior's weight, in documents.
LIGHTEST, HEAVIEST = 2.0, 20.0
RULES = ("short", "repetitive", "symbols", "lines")
SYMBOL = np.isin(np.arange(256), [*b"#*$%&|<>"])
#: For passing(), a document fails with more repeated lines than so many for 100 lines.
REPEATED_LINE_PERCENT = 30
VERDICTS = ("n_lines", "base_failed", "rule_failed", "host_failed", "kept")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(texts: list[str | None]) -> list[np.ndarray]:
    """COUNTS of the texts, and their lines that aren't blank."""
    x = c.Words(texts)
    points = np.array([len(t or "") for t in texts], np.int64)
    summed = lambda flag: np.diff(np.append(0, np.cumsum(flag, dtype=np.int64))[np.append(x.begin, len(x.byte))])
    blank = summed(c.SPACE[x.byte]) - 1  # but for the one behind the text
    gram = c.ngrams(x.h, REPEAT_WINDOW)
    starts = np.flatnonzero(x.pos + REPEAT_WINDOW <= x.n[x.doc])
    order = starts[np.lexsort((gram[starts], x.doc[starts]))]
    same = (np.diff(gram[order]) == 0) & (np.diff(x.doc[order]) == 0)
    twice = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    covered = np.append(0, np.cumsum(c.spans(twice, REPEAT_WINDOW, len(x.h)), dtype=np.int64))
    lines = [[y for y in c.encoded(t).split(b"\n") if y.strip()] if t and "\n" in t else () for t in texts]
    dup = np.array([len(y) - len(set(y)) for y in lines], np.int64)
    n_lines = np.maximum(np.array([len(y) for y in lines], np.int64), x.n > 0)
    return [x.n, points - blank, summed(SYMBOL[x.byte]), dup, covered[x.first + x.n] - covered[x.first], n_lines]


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in (*COUNTS, "n_lines")]))
def counted(text: pa.Array) -> pa.Array:
    """COUNTS and n_lines of texts."""
    parts = [counts(some) for _, some in c.blocks(text.to_pylist())]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in zip(*parts)] if parts else [pa.array([], pa.int64())] * (len(COUNTS) + 1), names=[*COUNTS, "n_lines"])


def ruled(rows: DataFrame) -> DataFrame:
    """rows with COUNTS and n_lines, and whether each of RULES failed, base_failed and rule_failed.

    rule_failed: whether any rule failed, `lines` by the number of lines too, where RULES hold it against words.
    """
    rules = {"short": F.col("n_words") < MIN_WORDS, "repetitive": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"), "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("n_words"), "lines": 100 * F.col("n_dup_lines") > LINE_PERCENT * F.col("n_words")}
    rows = rows.withColumns(rules).withColumn("base_failed", F.col("short") | F.col("repetitive"))
    return rows.withColumn("rule_failed", F.col("base_failed") | F.col("symbols") | F.col("lines") | (100 * F.col("n_dup_lines") > REPEATED_LINE_PERCENT * F.col("n_lines")))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, COUNTS of the text, n_lines, and what ruled() makes of them; only texts go to Python."""
    rows = docs.select(*keep, counted(F.col("text")).alias("_counts"))
    return ruled(rows.select(*keep, *(F.col("_counts")[x].alias(x) for x in (*COUNTS, "n_lines"))))


def host_rates(rows: DataFrame, host: str) -> DataFrame:
    """(host, n, and for each rule its shrunk rate) of rows from measured(); rows without a host aside."""
    per = c.cut(rows.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *(F.count_if(r).alias(r) for r in RULES)))
    rate = lambda r: F.col(r) / F.col("n")
    total = per.agg(F.count("*").alias("hosts"), F.avg(1 / F.col("n")).alias("single"), *(F.avg(rate(r)).alias(r) for r in RULES), *(F.var_samp(rate(r)).alias(f"{r}_var") for r in RULES)).first()
    shrunk: dict[str, Column] = {}
    for r in RULES:
        mean, single = total[r] or 0.0, total["single"] or 1.0
        # A beta-binomial rate of n documents varies by mean * (1 - mean) * (1 / n + (1 - 1 / n) * inner).
        own = (total[f"{r}_var"] or 0.0) / (mean * (1 - mean)) if 0 < mean < 1 else 0.0
        inner = (own - single) / (1 - single) if single < 1 else 0.0
        weight = min(HEAVIEST, max(LIGHTEST, 1 / inner - 1)) if inner > 1e-12 else HEAVIEST
        shrunk[r] = (F.col(r) + mean * weight) / (F.col("n") + weight)
    return per.withColumns(shrunk)


def rejected(rows: DataFrame, host: str, host_rate: float = HOST_RATE) -> DataFrame:
    """(host, host_failed) of the hosts of measured() rows that are rejected."""
    return c.cut(host_rates(rows, host).filter(" or ".join(f"{r} > {host_rate!r}" for r in RULES)).select(host, F.lit(True).alias("host_failed")))


def judged(docs: DataFrame, host: str = "source", *keep: str, host_rate: float = HOST_RATE) -> DataFrame:
    """The columns to keep, COUNTS, base_failed, rule_failed, host_failed and kept, one row for each row of docs.

    kept is of base_failed and the host alone, as the query has it; passing() takes rule_failed.
    Null and empty texts have no words, so they fail. Rows without a host are judged on their own, and
    repeated rows each count. Very long texts are read whole. Columns that aren't named aren't read, and one to keep
    that is called as one of COUNTS, RULES or the other new ones gives way to it; no rows give no rows.
    """
    keep = c.apart(keep, *COUNTS, *RULES, *VERDICTS, "_host")
    rows = c.cut(measured(docs.select("text", *keep, F.col(host).alias("_host")), *keep, "_host"))
    rows = c.by_small(rows, rejected(rows, "_host", host_rate), "_host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return rows.select(*keep, *COUNTS, "base_failed", "rule_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def passing(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs, all columns, that fail no rule, of hosts that aren't rejected; null and empty texts fail.

    Texts are measured twice, for the hosts and to filter by; only the rejected hosts are kept in between.
    """
    bad = rejected(measured(docs.select("text", F.col(host).alias("_host")), "_host"), "_host")
    rows = measured(docs.select("text", F.col(host).alias("_host"), F.struct(*docs.columns).alias("_row")), "_host", "_row")
    rows = c.by_small(rows.filter("not rule_failed").select("_host", "_row"), bad, "_host", "left_anti")
    return rows.select("_row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(c.table(spark, sf_dir, "documents"), "source", "doc_id").select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE = r"""
WITH doc AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM doc) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM doc, unnest(generate_series(1, len(w) - 7)) AS t(i) WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 7) AS t(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(line.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM doc LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive, 100 * n_symbols > 60 * n_words AS symbols, 100 * n_dup_lines > 30 * n_words AS lines FROM m),
host AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(f::INT)::DOUBLE AS k FROM (SELECT source, unnest(['short', 'repetitive', 'symbols', 'lines']) AS rule, unnest([short, repetitive, symbols, lines]) AS f FROM r) WHERE source IS NOT NULL GROUP BY ALL),
mean AS (SELECT rule, avg(k / n) AS p, avg(1 / n) AS single, coalesce(var_samp(k / n), 0) AS v FROM host GROUP BY rule),
spread AS (SELECT rule, p, CASE WHEN p > 0 AND p < 1 AND single < 1 THEN (v / (p * (1 - p)) - single) / (1 - single) ELSE 0 END AS own FROM mean),
prior AS (SELECT rule, p, CASE WHEN own > 1e-12 THEN least(20, greatest(2, 1 / own - 1)) ELSE 20 END AS q FROM spread),
bad AS (SELECT DISTINCT source FROM host JOIN prior USING (rule) WHERE (k + p * q) / (n + q) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive) AND bad.source IS NULL AS kept
FROM r LEFT JOIN bad USING (source)
"""
