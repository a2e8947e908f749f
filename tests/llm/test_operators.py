"""The operators against brute force, round trips and held-out rows, and on odd input."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strataweb.llm import _common as c
from strataweb.llm import chat, components, decontaminate, language, licenses, pieces, quality, simhash, substrings, toxicity, warc
from strataweb.llm.queries import ORACLES, QUERIES

from ..conftest import SF

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Ünï ▁ 丁 \U0001f600 é"), (7, "a b c d " * 3000), (None, "no id"), (8, "x" * 3000)]
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies and shared passages among others."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    passage = prose(rng, 55)
    texts += [texts[3]] * 90 + [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(20)]
    for k in range(20):
        w = prose(random.Random(9), 200).split()
        w[rng.randrange(200)] = f"new{k}"
        texts.append("  ".join(w) + "\n")
    rng.shuffle(texts)
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, matches, name):
    assert matches(QUERIES[name](spark, SF), ORACLES[name])


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 4] for i in range(len(w) - 3)] or [w] * bool(w))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, corpus):
    rows = corpus + [r for r in ODD if r[0] is None] + [(1000 + r[0], r[1]) for r in ODD if r[0]]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(0))).collect()}
    rows = [r for r in rows if r[0]]
    fp = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, np.array([i for i, _ in rows])
    while True:
        new = np.where(near, label[None], 1 << 40).min(1)
        if (new == label).all():
            break
        label = new
    assert {i: (f"{int(f):016x}", int(x)) for (i, _), f, x in zip(rows, fp, label)} == {k: v for k, v in got.items() if k}


def test_forest_and_split_shards(spark):
    rng = np.random.default_rng(2)
    fp = set()
    for base in rng.integers(0, 2**63, 4, np.uint64):
        for _ in range(150):
            x = int(base)
            for k in rng.choice(64, rng.integers(0, 8), False):
                x ^= 1 << int(k)
            fp.add(x)
    fp = sorted(fp)
    near, label = np.bitwise_count(np.array(fp, np.uint64)[:, None] ^ np.array(fp, np.uint64)[None]) <= 4, np.arange(len(fp))
    for _ in range(100):
        label = np.where(near, label[None], 1 << 40).min(1)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fp)], "fp long, rep long")
    for shard, parts in ((4096, 8), (20, 100), (20, 4)):
        got = {r.node: r.component for r in components.components(simhash.near_links(rows, shard=shard, parts=parts)).collect()}
        assert {k: got.get(k, k) for k in range(len(fp))} == dict(enumerate(label.tolist()))


def slow_substrings(rows, n=20):
    seen, gone = {}, {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone[i] = set()
        for k in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[k : k + n]), (i, k)) != (i, k):
                gone[i].update(range(k, k + n))
    return {i: (len(w := (t or "").encode().split()), len(gone[i]), b" ".join(x for k, x in enumerate(w) if k not in gone[i])) for i, t in rows}


@pytest.mark.parametrize("chars,key_shards", [(4_000_000, 1 << 16), (3_000, 1 << 16), (3_000, 4), (500, 1)])
def test_substrings_against_brute_force(spark, corpus, chars, key_shards):
    rows = corpus + [(1000 + i, t) for i, t in ODD if i]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"kept_": F.lit(1), "N_WORDS": F.lit(2), "kept": F.lit("x"), "others": F.lit(3), "shard": F.lit(4)})
    got = substrings.drop_repeats(docs, shard_chars=chars, key_shards=key_shards)
    assert got.columns == ["doc_id", "kept_", "others", "shard", "n_words", "n_removed", "kept"]
    assert {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()} == slow_substrings(rows)


def test_substrings_salts_keep_hot_keys_apart(spark):
    """With salts no window of the plan's is over a phrase alone."""
    rows = spark.createDataFrame([(7, k, False) for k in range(100)] + [(8, 1, True), (9, 1, False)], "phrase long, shard int, again boolean")
    got = substrings._recurring(rows, 10, "phrase")
    assert sorted((r.phrase, r.shard) for r in got.collect()) == [*((7, k) for k in range(100)), (8, 1)]
    assert "CASE WHEN (k" in got._jdf.queryExecution().toString()


def test_substrings_are_located_by_the_automaton(corpus, monkeypatch):
    """Places come from the automaton of confirmed phrases: without it, or without a phrase, no window is found."""
    texts = [t for _, t in corpus]
    docs = pa.table({"doc_id": pa.array([i for i, _ in corpus], pa.int64()), "text": texts, "shard": pa.array([0] * len(texts), pa.int32())})
    grams = substrings._phrases(20, 6)(docs)
    spelled = substrings._spelled(20, 6)(docs, grams.filter(grams.column("again")))
    words = sorted(set(spelled.column("words").to_pylist()))
    found = substrings._windows(20, 6)(docs, spelled.select(["words", "shard"]))
    doc, pos = substrings.Phrases(words).located([t.encode().split() for t in texts])
    want = [(d, k) for d, t in enumerate(texts) for w in [t.encode().split()] for k in range(len(w) - 5) if b" ".join(w[k : k + 6]) in set(words)]
    assert list(zip(doc.tolist(), pos.tolist())) == want and found.num_rows > 0
    fewer = substrings._windows(20, 6)(docs, spelled.slice(0, 5).select(["words", "shard"]))
    assert 0 < fewer.num_rows < found.num_rows
    monkeypatch.setattr(substrings.Phrases, "located", lambda self, texts: (np.zeros(0, np.int64),) * 2)
    assert substrings._windows(20, 6)(docs, spelled.select(["words", "shard"])).num_rows == 0


def test_quality(spark):
    rows = [(i, t, "h") for i, t in ODD] + [(20, "w " * 5 + " ".join(map(str, range(30))), None)] + [(30 + k, " ".join(map(str, range(k, k + 30))), "good") for k in range(9)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, DOCS + ", source string"), "source", "doc_id").collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[7].base_failed and got[7].n_repeat_words == 12000
    assert got[20].kept and all(got[30 + k].kept for k in range(9)) and got[6].word_chars == 7


def test_quality_rejects_hosts(spark):
    rows = [(k, " ".join(map(str, range(k, k + 40))) if k % 10 == 0 else "short", "bad") for k in range(200)] + [(k, " ".join(map(str, range(k, k + 40))), f"h{k % 5}") for k in range(200, 400)]
    got = quality.judged(spark.createDataFrame(rows, DOCS + ", source string"), "source", "source").groupBy("source").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    assert {r.source: r.n for r in got} == {"bad": 0} | {f"h{k}": 40 for k in range(5)}


@pytest.mark.parametrize("size", [100, 500])
def test_quality_host_verdict_at_any_corpus_size(spark, size):
    """A host whose documents all fail is rejected, and clean ones aren't, as those grow a thousandfold."""
    flags = {r: F.lit(False) for r in quality.RULES}
    for times in (1, 1000):
        hosts = [("third", 3_300 * times, 20), *((f"h{k}", 330 * times, 20) for k in range(20)), ("bad", size, 1)]
        rows = spark.createDataFrame(hosts, "source string, n long, every long").select("source", "every", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
        got = quality.host_rates(rows.withColumns(flags | {"short": F.col("k") % F.col("every") == 0}), "source").filter("short > 0.5").collect()
        assert [r.source for r in got] == ["bad"]


def test_quality_stage_drops_what_fails_any_rule(spark):
    """Junk of symbols and repeated lines goes, of hosts that stay."""
    line = lambda k: " ".join(map(str, range(k, k + 20)))
    rows = [(k, line(k) + "\n" + line(k + 50), "h") for k in range(20)]
    rows += [(100, " ".join(f"w{k}***" for k in range(40)), "h"), (101, "\n".join([*map(line, range(0, 120, 20)), *["7 seven"] * 5]), "h"), (102, line(0) + "\n" + "\n".join("abcdefgh") + "\n" + "a", "h"), (103, "too short", "h")]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    assert sorted(r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()) == [*range(20), 102]
    assert sorted(r.doc_id for r in quality.judged(docs, "source", "doc_id").filter("kept").collect()) == [*range(20), 100, 101, 102]


def test_decontaminate_against_brute_force(spark, corpus):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate((40, 12, 3, 1))] + [(9, None), (10, ""), (11, corpus[5][1])]
    docs = [(i, f"{t} {items[k % 4][1].upper()}, tail" if k % 3 == 0 else t) for k, (i, t) in enumerate(corpus)] + [(1000 + i, t) for i, t in ODD if i]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = {}
    for i, t in docs:
        w, hit, had = split(t), set(), set()
        for j, x in items:
            y = split(x)
            n = min(10, len(y))
            for a in range(len(y) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == y[a : a + n]:
                        hit.update(range(p, p + n))
                        had.add(j)
        want[i] = len(w), len(hit), sorted(had)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**8, 200):
        got = decontaminate.scan(d, b, chars=chars).collect()
        assert {r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in got} == want
    assert decontaminate.clean(d, b).count() == sum(not n for _, n, _ in want.values())
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k l y")], DOCS)
    b = spark.createDataFrame([(5, "a b c d e f g h i j k l")], "item_id long, text string")
    assert [tuple(m) for m in decontaminate.scan(d, b).first().matches] == [(5, 0, 1, 12)]


@pytest.mark.parametrize("chars", [10**8, 20])
def test_decontaminate_items_without_id(spark, chars):
    d = spark.createDataFrame([(1, "x a b c y"), (2, "d e f"), (3, "a b c d e f"), (4, "none")], DOCS)
    b = spark.createDataFrame([(None, "a b c"), (7, "d e f"), (None, "q r s t u v w x y z"), (7, "D E F"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(d, b, chars=chars).collect()}
    assert {k: (sum(h.end - h.start for h in r.hits), r["items"]) for k, r in got.items()} == {1: (3, []), 2: (3, [7]), 3: (6, [7]), 4: (0, [])}
    assert {(m.item_id, m.doc_start) for m in got[3].matches} == {(None, 0), (7, 3)}
    assert [r.doc_id for r in decontaminate.clean(d, b).collect()] == [4]


def all_paths(v, s):
    if not s:
        return [((), 0.0)]
    out = [((x[0], *r), math.log(x[1]) + w) for j in range(1, len(s) + 1) if (x := v.begins.get(s[:j])) for r, w in all_paths(v, s[j:])]
    if not v.begins.get(s[0]):
        k = v.spell(s[0])
        out += [((*v.ids_of[k], *r), math.log(v.byte_weight) * len(v.ids_of[k]) + w) for r, w in all_paths(v, s[1:])]
    return out


def test_samples_against_all_segmentations():
    own, n = pieces.Sampler(pieces.MODEL, 1.0, 42), 4000
    paths = all_paths(own.words, " the ca")
    z = np.logaddexp.reduce([w for _, w in paths])
    p = {a: w - z for a, w in paths}
    found = own.sample([(k, "the ca") for k in range(n)], 3)
    assert all(len({tuple(x[0]) for x in r}) == 3 for r in found)
    assert all(abs(p[tuple(x[0].tolist())] - x[1]) < 1e-9 for r in found for x in r)
    assert abs(np.mean([sum(math.exp(x[1]) / x[2] for x in r) for r in found]) - 1) < 0.02
    best = max(p, key=p.get)
    assert abs(np.mean([tuple(r[0][0].tolist()) == best for r in found]) - math.exp(p[best])) < 0.03


def test_samples_are_all_segmentations():
    """Of as many samples as there are segmentations none is missing, be the others' shares lost next to 1 or weights too small or large for a number."""
    for alpha in (0.0, 1.0, 2.0, 4.0):
        own = pieces.Sampler(pieces.MODEL, alpha, 42)
        for text in ("t", "  a", "Bitcoin", "heter"):
            paths = all_paths(own.words, " " + text)
            z = np.logaddexp.reduce([w for _, w in paths])
            found = own.sample([(1, text)], len(paths) + 1)[0]
            assert sorted(tuple(x[0].tolist()) for x in found) == sorted(a for a, _ in paths)
            assert all(abs(dict(paths)[tuple(x[0].tolist())] - z - x[1]) < 1e-9 and x[2] == 1 for x in found)
    for alpha, text in ((60.0, "t"), (0.0, "=" * 2500)):
        found = pieces.Sampler(pieces.MODEL, alpha, 42).sample([(1, text)], 2)[0]
        assert len({tuple(x[0].tolist()) for x in found}) == 2 and all(x[1] <= 0 <= x[2] <= 1 for x in found)


def test_pieces_round_trip(spark):
    rows = ODD + [(90, "丁龘" * 200 + "  two  spaces ")]
    got = pieces.sampled(spark.createDataFrame(rows, DOCS), "doc_id", k=3).collect()
    assert all(r.round_trip for r in got if r.ids is not None) and sum(r.ids is None for r in got) == 1
    assert [list(r.ids) for r in got if r.doc_id == 2] == [[]]
    v = pieces.Vocabulary(pieces.MODEL, 1.0)
    assert all(pieces.decode(v, r.ids) == dict(rows)[r.doc_id] for r in got if r.ids)
    again = pieces.sampled(spark.createDataFrame(rows[::-1], DOCS).repartition(3), "doc_id", k=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "p" * 200), (2, "http://b", "p" * 200), (3, None, None), (4, "u\r\nx", "short"), (5, "c", "short"), (None, "n", "p" * 200), (6, "é", "\x1f\x8b\x08WARC/1." * 40)]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3), f"file://{tmp_path}/w")
    for split in (50, 1 << 20):
        got = {r.page_id: r for r in warc.read(files, split).collect()}
        assert len(got) == 7 and got[2].record_type == "revisit" and got[2].refers_to == 1 and got[5].record_type == "response"
        assert all(bytes(got[i].payload) == (h or "").encode() for i, _, h in rows if i and i != 2)
        assert all(got[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest() and got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 1, "assistant", "yo"), (3, 0, "user", "hi"), (4, 0, None, "hi"), (5, 0, "hi", None), (None, 0, "user", "x"), (6, None, "user", "hi")]
    got = {r.conv_id: (r.n_turns, r.chat) for r in chat.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))).collect()}
    assert set(got) == {2, 4, 5} and got[2] == (2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n")


def test_licenses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.model(docs)
    own = [(f, t) for f, x in licenses.NOTICES.items() for t in x]
    rows = [(k, f"Some words before.\n{t}\nAnd after.") for k, (_, t) in enumerate(own)] + [(1000 + (i or 0), t) for i, t in ODD] + [(2000, "The general public has rights to this version of the work.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, DOCS), model, "doc_id").filter("confirmed").collect()}
    assert {k: got[k].family for k in range(len(own))} == {k: f for k, (f, _) in enumerate(own)} and set(got) == set(range(len(own)))


@pytest.mark.parametrize("notice", ["Licensed under the Apache License, Version 2.0.", "Released under the\nMIT License."])
def test_licenses_in_many_documents(spark, notice):
    """A notice that a third of the documents have is found as often as it occurs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    often = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(f"\n{notice}"))).otherwise(F.col("text")))
    model, alone = licenses.model(often), notice.replace("\n", " ")
    family = "apache" if "Apache" in notice else "mit"
    got = licenses.scan(spark.createDataFrame([(1, alone)], DOCS), model, "doc_id").collect()
    assert [(r.family, r.confirmed) for r in got] == [(family, True)]
    if "\n" not in notice:
        want = often.filter(F.col("doc_id") % 3 == 0).count()
        assert licenses.scan(often.filter(F.col("doc_id") % 3 == 0), model, "doc_id").filter(f"family = '{family}' and confirmed").select("doc_id").distinct().count() == want


WRAPPED = {
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def test_licenses_in_wrapped_notices(spark):
    """Notices over several lines, plain and in comments, between other lines; a line of words parts nothing."""
    model = licenses.model(spark.read.parquet(f"{SF}/documents.parquet"))
    own = [(f, t) for f, x in licenses.NOTICES.items() for t in x if len(t) > 72] + list(WRAPPED.items())
    rows, want = [], {}
    for f, t in own:
        for mark in ("", "// ", " * ", "# "):
            for width in (72, 40):
                lines = [mark + x for x in textwrap.wrap(t, width, break_on_hyphens=False)]
                want[len(rows)] = f
                rows.append((len(rows), "\n".join(["some code here", *lines, "other code here"])))
    got = licenses.scan(spark.createDataFrame(rows, DOCS), model, "doc_id").filter("confirmed").groupBy("doc_id").agg(F.collect_set("family").alias("f")).collect()
    assert {k: f for k, f in want.items() if f not in {r.doc_id: r.f for r in got}.get(k, [])} == {}
    two = "Released under the\nMIT License. Licensed under the\nApache License, Version 2.0.\n\nAll rights reserved.\nAll rights reserved."
    got = licenses.scan(spark.createDataFrame([(1, two)], DOCS), model, "doc_id").filter("confirmed").collect()
    assert sorted((r.paragraph, r.family) for r in got) == [(0, "mit"), (1, "apache"), (4, "proprietary"), (5, "proprietary")]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = language.op5_language(spark, "/root/testdata/sf0.1").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.99
    rows = toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(labels, "doc_id").collect()
    bad, good = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.95 and np.mean([s >= 0.3 for s in good]) < 0.02


def test_codewords():
    for k in (1, 2, 4, 5, 9, 30):
        m = language.codewords(k)
        assert len({tuple(r) for r in m}) == k
        if k > 3:
            assert min((m[a] != m[b]).sum() for a in range(k) for b in range(a)) >= 3


def test_models_on_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    assert toxicity.scored(odd, {-1: -1.0}, "doc_id").filter("score between 0 and 1").count() == len(ODD)
    got = {r.doc_id: r.lang_pred for r in language.predicted(odd, language.model(spark.createDataFrame([("ab cd", "en"), ("é è", "fr")], "text string, lang string")), "doc_id").collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("en", "fr")
    assert language.model(spark.createDataFrame([], "text string, lang string")) is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS + ", source string")
    assert simhash.near_duplicates(none).count() == substrings.drop_repeats(none).count() == quality.judged(none).count() == pieces.sampled(none, "doc_id").count() == 0
    assert chat.rendered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_word_hashes():
    rng = random.Random(1)
    texts = [None, "", " ", *(" ".join("".join(rng.choice("abé\t") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(30))]
    x = c.Words(texts)
    words = [w for t in texts for w in (t or "").encode().split()]
    assert x.n.tolist() == [len((t or "").encode().split()) for t in texts] and len(x.h) == len(words)
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(words, x.h.tolist())) and len(set(of.values())) == len(of)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        texts[name] = before
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = slow_substrings(sorted(texts["substring dedup"].items()))
    after = texts["decontamination"]
    for i, (n, gone, kept) in want.items():
        assert (after[i] == kept.decode() if gone else after[i] == texts["substring dedup"][i]) if gone < n or not n else i not in after
    assert docs.filter("not round_trip").count() == 0 and docs.count() > 0


def test_folds(spark):
    got = spark.range(200).select("id", toxicity.fold(F.col("id"), 4).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 4 for r in got)
