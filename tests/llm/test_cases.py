"""Operators that SQL can't express against plain versions, and odd tables: repeated rows, nothing, clashing names."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataweb.llm import _common as c
from strataweb.llm import decontaminate, language, licenses, pieces, quality, simhash, substrings, toxicity, warc

from ..conftest import SF
from .test_operators import DOCS, ODD, WRAPPED, corpus, prose, slow_fingerprint, slow_substrings  # noqa: F401

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Samplers.


def test_sample_of_repeated_rows(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("a"), F.lit("x").alias("b"))
    assert sorted(r.a for r in c.sample(rows, 500).collect()) == [0, 1, 2]
    many = spark.range(50_000).select((F.col("id") % 5_000).alias("a"), (F.col("id") % 2).alias("g"))
    assert c.sample(many, 100).count() == c.sample(many, 100).distinct().count() == 100
    assert {r.g: r["count"] for r in c.sample(many, 100, "g").groupBy("g").count().collect()} == {0: 100, 1: 100}
    assert c.sample(rows.limit(0), 5).count() == c.sample(many.limit(0), 5, "g").count() == 0


def test_models_of_repeated_rows(spark):
    """Two texts in 200,000 rows, and a language that is in one of them alone."""
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "the cat and the dog").otherwise("der hund und die katze").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    found = language.model(rows)
    got = language.predicted(spark.createDataFrame([("the dog",), ("die katze",)], "text string"), found, "text").collect()
    assert [r.lang_pred for r in got] == ["en", "de"]
    mixed = rows.filter("lang = 'de'").unionByName(spark.createDataFrame([(prose(random.Random(k), 30), "en") for k in range(300)], "text string, lang string"))
    assert language.model(mixed)["languages"] == ["de", "en"]
    labelled = rows.select(F.lit(1).alias("doc_id"), "text", (F.col("lang") == "de").cast("int").alias("label"))
    weights = toxicity.model(labelled.unionByName(labelled.select("doc_id", "text", F.lit(None).cast("int").alias("label"))))
    assert -1 in weights
    assert licenses.model(rows.withColumn("doc_id", F.lit(1)))["weights"]


# Plain versions.


def slow_language(text, m):
    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    t = f" {text.lower()} " if text else " "
    if not any(x.isalpha() for x in t):
        return "und", 0.0
    chars = [x if x.isalpha() else " " for x in t]
    chars = [x for k, x in enumerate(chars) if k == 0 or x != " " or chars[k - 1] != " "]
    at = []
    for n in range(1, language.ORDERS + 1):
        for k in range(len(chars) - n + 1):
            key = n << 62
            for j in range(n):
                key ^= ord(chars[k + j]) << 20 * j
            at.append(mix(key % 2**64) >> 64 - language.BITS)
    z = m["a"] * np.mean([m["w"][k].astype(float) for k in at], axis=0) + m["b"]
    loss = [sum(t * math.log1p(math.exp(-b * x)) for t, b, x in zip(m["trust"], word, z)) for word in m["code"]]
    best = min(range(len(loss)), key=loss.__getitem__)
    return m["languages"][best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def test_language_against_a_plain_version(spark, documents):
    m = language.model(documents.filter("doc_id % 2 = 0"))
    rows = [(r.doc_id, r.text) for r in documents.filter("doc_id % 20 = 1").select("doc_id", "text").collect()] + [(-1 - k, t) for k, (_, t) in enumerate(ODD)]
    got = {r.doc_id: r for r in language.predicted(spark.createDataFrame(rows, DOCS), m, "doc_id").collect()}
    for i, t in rows:
        want = slow_language(t, m)
        assert got[i].lang_pred == want[0] and abs(got[i].score - want[1]) < 1e-6 and got[i].ambiguous == (got[i].score < language.AMBIGUOUS)


def test_language_trust_is_measured_on_other_rows():
    """A bit that only tells apart what the fit has seen isn't trusted."""
    rng = random.Random(4)
    noise = [("".join(rng.choice("abcdefgh") for _ in range(12)), rng.choice(["x", "y"])) for _ in range(300)]
    assert language.fitted(noise)["trust"].max() < 0.5
    words = {"x": "abc", "y": "xyz"}
    assert language.fitted([(" ".join(rng.choice(words[k]) * 3 for _ in range(9)), k) for k in rng.choices("xy", k=300)])["trust"].min() > 0.9


def test_toxicity_against_a_plain_version(spark, documents):
    rng = random.Random(7)
    weights = {rng.randrange(1 << toxicity.BITS): rng.gauss(0, 1) for _ in range(200_000)} | {-1: -0.5}
    hashed = lambda w: int(c.Words([w], toxicity.GAP).h[0])
    mix = lambda x: int(c.mix(np.array([x % 2**64], np.uint64))[0])
    rows = [(r.doc_id, r.text) for r in documents.filter("doc_id % 50 = 3").select("doc_id", "text").collect()] + [(-1 - k, t) for k, (_, t) in enumerate(ODD[:6])]
    got = {r.doc_id: r.score for r in toxicity.scored(spark.createDataFrame(rows, DOCS), weights, "doc_id").collect()}
    for i, t in rows:
        h = [hashed(w) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())]
        at = {x >> 64 - toxicity.BITS for x in h}
        for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
            at |= {mix(a * factor + b) >> 64 - toxicity.BITS for a, b in zip(h, h[gap:])}
        assert abs(got[i] - 1 / (1 + math.exp(-max(-35, min(35, weights[-1] + sum(weights.get(k, 0.0) for k in at)))))) < 1e-9


def test_ftrl_against_a_plain_version():
    """Per-coordinate rates, the proximal step, and L1's zeros."""
    rng = random.Random(3)
    examples = [(sorted(rng.sample(range(50), 8)), rng.randint(0, 1)) for _ in range(120)]
    z, n, bias, seen = {}, {}, 0.0, 0.0

    def weight(k):
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= toxicity.L1 else -(x - math.copysign(toxicity.L1, x)) / ((toxicity.BETA + math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, y in examples:
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for k in at:
                now = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(now + g * g) - math.sqrt(now)) / toxicity.ALPHA * w[k]
                n[k] = now + g * g
            seen += g * g
            bias -= toxicity.ALPHA * g / (toxicity.BETA + math.sqrt(seen))
    got, b = toxicity.fitted([(np.array(at, np.int32), y) for at, y in examples])
    assert abs(b - bias) < 1e-9 and all(abs(got[k] - weight(k)) < 1e-9 for k in range(50)) and (got[50:] == 0).all() and (got[:50] == 0).any()


def slow_licenses(text, m):
    split = [licenses.words(x) for x in text.split("\n")] if text else []
    found = []
    for i, first in enumerate(split):
        if not first:
            continue
        last, n = i, 0
        while last + 1 < len(split) and n < m["longest"] and split[last + 1]:
            last += 1
            n += len(split[last])
        for j in range(i, last + 1):
            f = set(licenses.features([w for x in split[i : j + 1] for w in x]))
            if not f & set(m["gate"]):
                continue
            z = np.array(m["bias"]) + sum((np.array(m["weights"][x]) for x in f if x in m["weights"]), np.zeros(len(m["bias"])))
            family, p = m["families"][int(z.argmax())], 1 / np.exp(z - z.max()).sum()
            if family != licenses.UNKNOWN and p >= licenses.LEAST:
                near = max(len(f & set(t)) / len(t) for t in m["notices"][family])
                found.append((-near, j - i + 1, i, j, p, family))
    out = []
    for x in sorted(found):
        if not any(x[5] == y[5] and x[2] <= y[3] and y[2] <= x[3] for y in out):
            out.append(x)
    return [(x[2], x[5], round(x[4], 4), round(-x[0], 6), -x[0] >= licenses.CONFIRMED) for x in out]


def test_licenses_against_a_plain_version(spark, documents):
    m = licenses.model(documents)
    rows = [(r.doc_id, r.text) for r in documents.filter("lower(text) rlike 'licens|copyright|reserved|permission' or doc_id % 20 = 7").select("doc_id", "text").collect()]
    rows += [(10**6 + k, f"a line\n// {t[:60]}\n// {t[60:]}\n\nend") for k, t in enumerate(WRAPPED.values())] + [(-1 - k, t) for k, (_, t) in enumerate(ODD)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, DOCS), m, "doc_id").collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, round(r.probability, 4), round(r.similarity, 6), r.confirmed))
    want = {i: x for i, t in rows if (x := slow_licenses(t, m))}
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()} and want


def test_licenses_recall(spark, documents):
    """Of the documents with a line that names a licence, which SQL can find, few are missed, and few others are found."""
    line = r"(?im)^.{0,20}(licensed under|released under the|all rights reserved|spdx-license-identifier|permission is hereby granted)"
    named = {r.doc_id for r in documents.filter(F.col("text").rlike(line)).select("doc_id").collect()}
    found = {r.doc_id for r in licenses.scan(documents, licenses.model(documents), "doc_id").filter("confirmed").select("doc_id").collect()}
    assert len(named) > 20 and len(named & found) / len(named) > 0.95 and len(found - named) <= 0.05 * len(found)


# Stages of the pipeline, against plain versions, with columns that clash with the operators' own.


EXTRA = "others shard n_words kept n_removed host_failed n_lines short lines fp id component_id fingerprint _row _host _key _text _n row hits items matches n_hit parts count label".split()


@pytest.fixture(scope="module")
def stage_input(spark, corpus, tmp_path_factory):  # noqa: F811
    rng, top = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(rng, n)) for k, n in enumerate((40, 12, 25))] + [(7, None), (8, "")]
    rows = [(i, f"{t} {items[k % 3][1]}" if k % 9 == 0 else t) for k, (i, t) in enumerate(corpus)]
    rows += [(1000 + i, t) for i, t in ODD if i] + [(2000, " ".join(f"w{k}***" for k in range(40))), (2001, None), (2002, "ein " * 30)]
    rows = [(i, t, "en", f"h{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, TABLE)
    for k, x in enumerate(EXTRA):
        docs = docs.withColumn(x, F.lit(k))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return docs, rows, items, top


def split_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def slow_quality(t):
    w = split_words(t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    repeated = len({k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)})
    lines = [x for x in (t or "").split("\n") if x.strip()]
    dup, symbols = len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t or ""))
    return len(w) < 20 or 100 * repeated > 30 * len(w) or 100 * symbols > 60 * len(w) or 100 * dup > 30 * len(w) or 100 * dup > 30 * len(lines)


def test_quality_stage(spark, stage_input):
    docs, rows, _, top = stage_input
    small = docs.filter("length(text) < 5000 or text is null")
    got = corpus_pipeline.quality_rules(spark, small, top)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows if len(r[1] or "") < 5000 and not slow_quality(r[1]))


def test_near_dedup_stage(spark, stage_input):
    docs, rows, _, top = stage_input
    fp, label = np.array([slow_fingerprint(r[1]) for r in rows], np.uint64), np.array([r[0] for r in rows])
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4
    for _ in range(len(rows)):
        new = np.where(near, label[None], 1 << 40).min(1)
        if (new == label).all():
            break
        label = new
    got = corpus_pipeline.near_dedup(spark, docs, top)
    assert got.columns[:1] == ["doc_id"] and set(got.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(label.tolist()))


def test_substring_stage(spark, stage_input):
    docs, rows, _, top = stage_input
    got = corpus_pipeline.substring_dedup(spark, docs, top)
    assert got.schema.simpleString() == docs.schema.simpleString()
    want = slow_substrings([(r[0], r[1]) for r in rows])
    texts = {r[0]: r[1] for r in rows}
    want = {i: kept.decode() if gone else texts[i] for i, (n, gone, kept) in want.items() if gone == 0 or gone < n}
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in found.items()} == want and all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())
    assert all(r.kept == EXTRA.index("kept") and r.n_removed == EXTRA.index("n_removed") for r in found.values())


def test_decontamination_stage(spark, stage_input):
    docs, rows, items, top = stage_input
    low = lambda t: f" {' '.join(re.findall('[a-z0-9]+|[^\x00-\x7f]+', (t or '').lower()))} "
    windows = [f" {' '.join(w[k : k + 10])} " for _, t in items for w in [low(t).split()] for k in range(len(w) - 9)]
    got = corpus_pipeline.decontamination(spark, docs, top)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows if not any(x in low(r[1]) for x in windows))


def test_encoding_stage(spark, stage_input):
    """Each sample is a segmentation of the whole text, its probability that of its pieces; samples of a text differ."""
    docs, rows, _, top = stage_input
    v, got = pieces.Vocabulary(pieces.MODEL, pieces.ALPHA), {}
    for r in corpus_pipeline.encoding(spark, docs, top).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {r[0] for r in rows}
    for i, t, *_ in rows:
        own = got[i]
        if t is None:
            assert [(r.ids, r.log_prob) for r in own] == [(None, None)]
            continue
        assert all(pieces.decode(v, r.ids) == t and r.round_trip and 0 < r.inclusion <= 1 and r.log_prob <= 0 for r in own)
        assert len({tuple(r.ids) for r in own}) == len(own) == (2 if len(t) > 3 else len(own)) and [r.sample for r in sorted(own, key=lambda r: r.sample)] == list(range(len(own)))


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, stage_input, k):
    docs, _, _, top = stage_input
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), top).count() == 0


# Other operators: nothing, nulls, names that clash.


def test_nothing(spark):
    none = spark.createDataFrame([], TABLE)
    assert licenses.scan(none, licenses.model(none), "doc_id").count() == 0
    assert language.model(none) is None and language.predicted(none, None, "doc_id").count() == 0
    assert toxicity.scored(none, toxicity.model(none.withColumn("label", F.lit(1))), "doc_id").count() == 0
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.scan(none, some).count() == decontaminate.clean(none, some).count() == 0
    assert [tuple(r) for r in language.predicted(spark.createDataFrame([(1, "word")], DOCS), None, "doc_id").collect()] == [(1, "und", 0.0, True)]


def test_names_that_clash(spark):
    own = "doc_id text TEXT_ lang_pred score AMBIGUOUS paragraph family _t _s sample ids log_prob Inclusion round_trip n_words kept short host_failed component_id fingerprint fp id".split()
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    for x in own[2:]:
        docs = docs.withColumn(x, F.lit("old"))
    keep = [x for x in own if x != "text"]
    for got, new in (
        (language.predicted(docs, None, *keep), language.PREDICTED),
        (toxicity.scored(docs, {-1: 0.0}, *keep), ["score"]),
        (licenses.scan(docs.withColumn("text", F.lit("Licensed under the MIT License.")), licenses.model(docs), *keep), ["paragraph", "family", "probability", "similarity", "confirmed"]),
        (pieces.sampled(docs, *keep, k=1), ["sample", "ids", "log_prob", "inclusion", "round_trip"]),
        (quality.judged(docs.withColumn("source", F.lit("h")), "source", *keep), [*quality.COUNTS, "base_failed", "rule_failed", "host_failed", "kept"]),
        (substrings.drop_repeats(docs), substrings.FOUND),
    ):
        row = got.first().asDict()
        assert len({x.lower() for x in got.columns}) == len(got.columns) and row["doc_id"] == 1 and all(row[x] != "old" for x in new)
        assert row["TEXT_"] == "old"
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert decontaminate.scan(docs.withColumn("hits", F.lit(1)), spark.createDataFrame([(1, "some words")], "item_id long, text string")).first().n_words == 5


def test_wide_radius(spark):
    rows = spark.createDataFrame([(0, 10), (0b111111, 20), (0b1111111 << 20, 30)], "fp long, rep long")
    assert {(r.a, r.b) for r in simhash.near_links(rows, radius=6).collect()} in ({(20, 10)}, {(10, 20)})
    with pytest.raises(ValueError):
        simhash.near_links(rows, radius=63)


def test_hot_keys_of_joins(spark, monkeypatch):
    monkeypatch.setattr(c, "HOT", 5)
    df = spark.createDataFrame([(k % 3 if k < 30 else k, k) for k in range(40)] + [(None, 99)], "k long, v long")
    side = df.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m")).filter("k <> 35")
    got = {(r.k, r.v, r.m) for r in c.join_unique(df, side, "k", "n").collect()}
    assert got == {(k % 3 if k < 30 else k, k, k % 3 if k < 30 else k) for k in range(40) if k != 35}


def test_archive_cut_short(spark, tmp_path):
    """A record whose member doesn't end is none; those before it are read."""
    pages = spark.createDataFrame([(k, f"http://h/{k}", "".join(random.Random(k).choices("abcdef", k=500))) for k in range(6)], "page_id long, url string, html string").coalesce(1)
    path, size, _ = warc.write(pages, f"file://{tmp_path}/w").first()
    local = path.removeprefix("file://")
    with open(local, "r+b") as f:
        f.truncate(size - 20)
    files = spark.createDataFrame([(path, size - 20)], "path string, bytes long")
    assert warc.read(files, 100).count() == warc.read(files).count() == 5


def test_quality_sql_on_bad_hosts(spark, tmp_path):
    """The query's SQL has the operator's prior: they agree where hosts are rejected, small ones among them."""
    import duckdb

    rng, rows = random.Random(6), []
    for h, n, bad in (("all bad", 40, 1.0), ("most", 60, 0.7), ("half", 60, 0.5), ("few", 300, 0.05), ("one", 1, 1.0), ("none", 200, 0.0), (None, 30, 0.9), *((f"s{k}", 3, rng.random()) for k in range(30))):
        for _ in range(n):
            text = "* " * 40 if rng.random() < bad else " ".join(f"{rng.choice('abc')}{k}" for k in range(30))
            rows.append((len(rows), rng.choice([text, "short"]) if rng.random() < bad / 2 else text, "en", h, len(text)))
    spark.createDataFrame(rows, TABLE).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(quality.ORACLE)
    names = [x[0] for x in found.description]
    got = quality.op6_quality(spark, str(tmp_path)).select(*names).collect()
    want = found.fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    rejected = {r[3] for r in rows} - {h for (i, _, _, h, _), k in zip(rows, [r.kept for r in sorted(got, key=lambda r: r.doc_id)]) if k}
    assert "all bad" in rejected and not rejected & {"few", "none"}


def test_pieces_blocks_without_ids(monkeypatch):
    """Blocks of null and empty texts alone, and texts with line feeds, runs of spaces and characters spelled by bytes."""
    import pyarrow as pa

    monkeypatch.setattr(pieces.SparkFiles, "get", staticmethod(lambda name: pieces.MODEL))
    each = pieces._each(pieces.MODEL, 2, 1.0, 42)
    words = pieces.Vocabulary(pieces.MODEL, 1.0)
    for texts in ([None], [""], [None, ""], [], ["\U0001f9ec a\n\n  b ", "", None, "x"], [" ", "\n", "a\x00b"]):
        rows = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))], pa.string()), pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], names=["_key", "_text", "doc_id"])
        got = [r for b in each(iter([rows])) for r in b.to_pylist()]
        assert {r["doc_id"] for r in got} == set(range(len(texts)))
        for r in got:
            text = texts[r["doc_id"]]
            assert (r["ids"], r["round_trip"]) == (None, None) if text is None else r["round_trip"] and pieces.decode(words, r["ids"]) == text
    ids = [[5, 9], [], [7]]
    assert pieces.decoded(words, np.array([5, 9, 7], np.int32), np.array([2, 0, 1])) == [b"".join(words.bytes_of[k] for k in x)[1:] for x in ids]


def test_pieces_hold_a_block(monkeypatch):
    """While a block's samples go out, the batch's other texts aren't held as strings; freed memory is given back."""
    import pyarrow as pa

    monkeypatch.setattr(pieces.SparkFiles, "get", staticmethod(lambda name: pieces.MODEL))
    trims, trim = [], pieces.c.trim
    monkeypatch.setattr(pieces.c, "trim", lambda: trims.append(trim()))
    each = pieces._each(pieces.MODEL, 2, 1.0, 42)
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(map(str, range(n))), pa.array([f"{k} " + "ab " * 50_000 for k in range(n)]), pa.array(range(n))], names=["_key", "_text", "doc_id"])
    assert sum(x.num_rows for x in each(iter([batch(1)]))) == 2
    many, before = batch(200), len(trims)
    tracemalloc.start()
    try:
        rest = each(iter([many]))
        next(rest)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 16e6 < many.nbytes
    for _ in range(4):
        next(rest)
    assert len(trims) >= before + 2


def test_pieces_met_by_flags(monkeypatch):
    """Samples don't depend on what chunks share a flag, and those met once take no more room than the flags."""
    rng = random.Random(3)
    rows = [(k, " ".join("".join(rng.choice("abcdé丁") for _ in range(rng.randint(1, 7))) for _ in range(300))) for k in range(20)]
    want = [pieces.Sampler(pieces.MODEL, 1.0, 42).sample([r], 2)[0] for r in rows]
    monkeypatch.setattr(pieces, "FLAGS", 16)
    monkeypatch.setattr(pieces, "MET", 700)
    own = pieces.Sampler(pieces.MODEL, 1.0, 42)
    for _ in range(2):
        for r, x in zip(rows, want):
            (got,) = own.sample([r], 2)
            assert all((a[0] == b[0]).all() and a[1:] == b[1:] for a, b in zip(got, x, strict=True))
    assert own.met.nbytes == 16
