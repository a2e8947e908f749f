"""Substring dedup by repeated-phrase automata.

Every window of `window` words holds a phrase of `phrase` words whose hash is the least in it, the same
phrase wherever that window occurs. Phrases that are least somewhere and whose hash comes twice in the
corpus are candidates; each shard of documents that holds one spells it out, and those whose words come
twice are confirmed. Confirmed phrases go, as words, to the shards that hold them. A shard compiles them
into an Aho-Corasick automaton and streams its documents through it, which locates every occurrence; only
windows whose least phrase begins at a located place are looked at further. They are held against each
other: first within the shard, then, for each shard's first ones, by hash across shards. Equal texts share
a shard, except that a text with very many copies is dealt out.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as c

WINDOW, PHRASE = 20, 6
#: Characters of text in a shard, about; copies of one text that share a shard, about.
SHARD_CHARS, COPIES = 4_000_000, 64
#: Shards whose rows of one phrase or window may meet in a task.
KEY_SHARDS = 1 << 16
#: Characters that stand for one place of a word in an automaton.
BASE = 48
FOUND = ("n_words", "n_removed", "kept")


class Block(c.Words):
    """Some documents' words; starts of windows, and the start of each one's least phrase."""

    def __init__(self, texts: list[str | None], window: int, phrase: int):
        super().__init__(texts)
        self.starts = np.flatnonzero(self.pos + window <= self.n[self.doc])
        self.grams = c.ngrams(self.h, phrase)
        least, at = self.grams[self.starts], self.starts.copy()
        for k in range(1, window - phrase + 1):
            other = self.grams[self.starts + k]
            less = other < least
            least, at = np.minimum(least, other), np.where(less, self.starts + k, at)
        self.at = at
        #: Least phrases, each place once; they are in order, as windows are.
        self.least = at[np.diff(at, prepend=-1) != 0]


def _texts(docs: pa.Table) -> tuple[np.ndarray, list[str | None]]:
    """A shard's documents by id, ids as far as there are any."""
    docs = docs.filter(docs.column("doc_id").is_valid()).sort_by("doc_id")
    return docs.column("doc_id").to_numpy(), docs.column("text").to_pylist()


def _phrases(window: int, phrase: int):
    """A shard to (phrase, shard, again): its least phrases, and whether it has one more than once."""

    def each(docs: pa.Table) -> pa.Table:
        found = [x.grams[x.least] for _, t in c.blocks(_texts(docs)[1]) for x in [Block(t, window, phrase)]]
        value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        shard = pa.repeat(docs.column("shard")[0], len(value)) if docs.num_rows else pa.array([], pa.int32())
        return pa.table({"phrase": value.view(np.int64), "shard": shard, "again": n > 1})

    return each


def _spelled(window: int, phrase: int):
    """A shard's documents and the hashes of phrases that recur, to (phrase, words, shard, again): the phrases it has of them, by their words."""

    def each(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        wanted = np.unique(recurring.column("phrase").to_numpy()).view(np.uint64)
        found: dict[tuple[int, bytes], bool] = {}
        for _, texts in c.blocks(_texts(docs)[1]) if len(wanted) else ():
            x = Block(texts, window, phrase)
            at = x.least[np.isin(x.grams[x.least], wanted)]
            split = [c.encoded(t).split() if t else [] for t in texts]
            for h, d, k in zip(x.grams[at].view(np.int64).tolist(), x.doc[at].tolist(), x.pos[at].tolist()):
                key = h, b" ".join(split[d][k : k + phrase])
                found[key] = key in found
        shard = pa.repeat(docs.column("shard")[0], len(found)) if docs.num_rows else pa.array([], pa.int32())
        return pa.table({"phrase": pa.array([h for h, _ in found], pa.int64()), "words": pa.array([w for _, w in found], pa.binary()), "shard": shard, "again": pa.array(found.values(), pa.bool_())})

    return each


class Phrases:
    """An automaton of phrases, each given by its words with a space between.

    A word is spelled as a few characters, each of a range of its own by its place, so that matches
    begin with words; a state looks through all it leads on to, of which there are at most BASE. Words that no
    phrase has are one word that is in none.
    """

    def __init__(self, spelled: list[bytes]):
        split = [x.split() for x in spelled]
        self.symbols = {w: k for k, w in enumerate(sorted({w for x in split for w in x}), 1)}
        self.digits = 1
        while BASE**self.digits <= len(self.symbols):
            self.digits += 1
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        every, at = self._text(split), 0
        for x in split:
            self.machine.add_word(every[at : (at := at + len(x) * self.digits)])
        self.machine.make_automaton()

    def _text(self, texts: list[list[bytes]], end: list[int] = []) -> str:
        """The words of the texts as characters; after each text those of the symbols of end."""
        look, ids = self.symbols.get, []
        for words in texts:
            ids += [look(w, 0) for w in words]
            ids += end
        place = np.arange(self.digits - 1, -1, -1)
        chars = np.array(ids, np.int64)[:, None] // BASE**place % BASE + place * BASE
        return chars.astype("<u4").tobytes().decode("utf-32-le")

    def located(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Text and first word of each place where one of the phrases is, by text."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(n + 1) - n - 1
        found = [end - size for end, size in self.machine.iter(self._text(texts, [0]))] if self.symbols else []
        at = np.unique((np.array(found, np.int64) + 1) // self.digits)
        doc = np.searchsorted(first, at, "right") - 1
        return doc, at - first[doc]


def _windows(window: int, phrase: int):
    """A shard's documents and the phrases confirmed that it has, by their words, to windows that may be repeats.

    Those that are the shard's first ones have 96 bits of hash (h, more) and a count of 0; runs of
    those that aren't have a count, and a place for a hash.
    """

    def each(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        phrases = Phrases(confirmed.column("words").unique().to_pylist())
        ids_of, texts = _texts(docs)
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for k, part in c.blocks(texts) if phrases.symbols else ():
            split = [words if len(words := c.encoded(t).split()) >= window else [] for t in (x or "" for x in part)]
            doc, pos = phrases.located(split)
            if not len(doc):
                continue
            some, place = np.unique(doc, return_inverse=True)
            x = Block([part[d] for d in some.tolist()], window, phrase)
            hit = np.zeros(len(x.h), bool)
            hit[x.first[place] + pos] = True
            starts = x.starts[hit[x.at]]
            more = c.mix(c.ngrams(x.h[::-1], window)[::-1][starts]) >> np.uint64(32)
            out.append((k + some[x.doc[starts]], c.ngrams(x.h, window)[starts], more.astype(np.uint32).view(np.int32), x.pos[starts].astype(np.int32)))
        doc, h, more, pos = (np.concatenate(v) for v in zip(*out))
        order = np.lexsort((more, h))  # stable: documents by id, then places
        first = np.zeros(len(h), bool)
        first[order[(np.diff(h[order], prepend=np.uint64(0)) != 0) | (np.diff(more[order], prepend=0) != 0)]] = True
        if len(order):
            first[order[0]] = True
        late = np.flatnonzero(~first)
        head = late[(np.diff(late, prepend=-2) != 1) | (np.diff(pos[late], prepend=-2) != 1) | (np.diff(doc[late], prepend=-1) != 0)]
        length = np.diff(np.append(np.searchsorted(late, head), len(late)))
        rows = np.concatenate([np.flatnonzero(first), head])
        count = np.concatenate([np.zeros(int(first.sum()), np.int32), length.astype(np.int32)])
        spread = np.where(count > 0, c.mix(ids_of[doc[rows]].view(np.uint64) + pos[rows].astype(np.uint64)), h[rows])
        shard = pa.repeat(docs.column("shard")[0], len(rows)) if docs.num_rows else pa.array([], pa.int32())
        return pa.table({"h": spread.view(np.int64), "more": more[rows], "doc_id": ids_of[doc[rows]], "start": pos[rows], "n": count, "shard": shard})

    return each


def _kept(window: int, names: list[str]):
    """A shard's documents and its repeated windows (doc_id, start, n) to what stays of each document."""

    def each(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        repeats = repeats.sort_by("doc_id")
        of, start, n = (repeats.column(x).to_numpy() for x in ("doc_id", "start", "n"))
        docs = docs.combine_chunks()
        key = docs.column("doc_id")
        lo, hi = (np.searchsorted(of, key.fill_null(0).to_numpy(), side) for side in ("left", "right"))
        valid, rows = key.is_valid().to_pylist(), []
        for a, b, known, text in zip(lo.tolist(), hi.tolist(), valid, docs.column("text")):
            words = c.encoded(t).split() if (t := text.as_py()) else []
            kept = words
            if known and b > a and len(words) >= window:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start[a:b], 1)
                np.add.at(edge, np.minimum(start[a:b] + n[a:b] - 1 + window, len(words)), -1)
                kept = [w for w, gone in zip(words, (np.cumsum(edge) > 0).tolist()) if not gone]
            rows.append((len(words), len(words) - len(kept), b" ".join(kept)))
        cols = [pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 3, (pa.int64(), pa.int64(), pa.binary()))]
        return pa.table([*(docs.column(x) for x in names), *cols], names=[*names, *FOUND])

    return each


def _recurring(rows: DataFrame, salts: int, *keys: str) -> DataFrame:
    """The rows (..., shard, again; each shard has a key once) whose key another row has too, or that have it again.

    A key's rows are counted by salts of their shards first; only one row of each salt is then held
    against those of the other salts.
    """
    if salts == 1:
        return rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).filter("n > 1 or again").drop("n")
    own = Window.partitionBy(*keys, F.pmod("shard", F.lit(salts)))
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy("shard")))
    across = F.count("*").over(Window.partitionBy(*keys, F.when(F.col("k") > 1, F.col("shard"))))
    return rows.withColumn("m", across).filter("n > 1 or m > 1 or again").drop("n", "k", "m")


def _late(rows: DataFrame, salts: int) -> DataFrame:
    """The rows (h, more, doc_id, n, shard) that are runs, or whose window a smaller doc_id has; by salts as _recurring() does."""
    keys = ["h", "more"]
    if salts == 1:
        return rows.withColumn("e", F.min("doc_id").over(Window.partitionBy(*keys))).filter("n > 0 or doc_id > e").drop("e")
    rows = rows.withColumn("e", F.min("doc_id").over(Window.partitionBy(*keys, F.pmod("shard", F.lit(salts)))))
    across = F.min("doc_id").over(Window.partitionBy(*keys, F.when(F.col("doc_id") > F.col("e"), F.col("doc_id"))))
    return rows.withColumn("f", across).filter("n > 0 or doc_id > e or doc_id > f").drop("e", "f")


def drop_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_chars: int = SHARD_CHARS, keep_text: bool = False, key_shards: int = KEY_SHARDS) -> DataFrame:
    """docs and n_words, n_removed (long), kept (binary: the words that stay, joined by a space).

    Words are split at ASCII white space. Those covered by a window of `window` words that also starts
    earlier (in a smaller doc_id, or earlier in the document) go; windows are judged on the input. A
    null text has no words, and shorter texts keep theirs. Rows without a doc_id keep their words and
    don't count as earlier ones; a doc_id is to be unique, repeated rows of one are held against each
    other in no set order. Other columns are kept as they are, text only if keep_text says so; those
    that are called as one of the three new ones, in any case, give way to them. No rows give no rows.

    The documents are dealt to shards once; the four steps read the same exchange. A shard has at most one
    row for a phrase or window, so a task meets at most key_shards of one: with more shards they are
    counted by salts.
    """
    others = c.apart(docs.columns, "doc_id", "text", *FOUND)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*others).alias("others") if others else F.lit(0).alias("others"), F.xxhash64("text").alias("same"))
    hot = c.cut(rows.groupBy("same").count().filter(F.col("count") > COPIES).select("same", F.ceil(F.col("count") / COPIES).alias("parts")))
    shards = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars))
    salts = -(-shards // key_shards)
    dealt = F.pmod(F.xxhash64("same", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1)))), F.lit(shards)).cast("int")
    rows = c.by_small(rows, hot, "same", "left").select("doc_id", "text", "others", dealt.alias("shard"))
    by_shard = lambda found: rows.groupBy("shard").cogroup(found.groupBy("shard"))
    phrases = rows.groupBy("shard").applyInArrow(_phrases(window, phrase), "phrase long, shard int, again boolean")
    candidates = _recurring(phrases, salts, "phrase").select("phrase", "shard")
    spelled = by_shard(candidates).applyInArrow(_spelled(window, phrase), "phrase long, words binary, shard int, again boolean")
    confirmed = _recurring(spelled, salts, "phrase", "words").select("words", "shard")
    found = by_shard(confirmed).applyInArrow(_windows(window, phrase), "h long, more int, doc_id long, start int, n int, shard int")
    # A shard's documents are in it alone, so that a document has at most one row for a hash.
    repeats = _late(found, salts).select("doc_id", "start", F.greatest("n", F.lit(1)).alias("n"), "shard")
    names = ["others", "doc_id", *["text"] * keep_text]
    schema = rows.select(*names, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(b"").alias("kept")).schema
    kept = by_shard(repeats).applyInArrow(_kept(window, names), schema)
    return kept.select(*names[1:], *(F.col("others")[x].alias(x) for x in others), *FOUND)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the words of repeated passages in text; where any went n_chars, if there is one, is the new length.

    A document that has no words left goes, one that loses none stays as it is; a null or empty text stays.
    """
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    found = drop_repeats(packed).filter("n_removed = 0 or n_removed < n_words")
    kept = F.col("kept").cast("string")
    anew = {"text": kept, "n_chars": F.length(kept)}
    return found.select(*(F.when(F.col("n_removed") > 0, anew[x].cast(docs.schema[x].dataType)).otherwise(F.col("_row")[x]).alias(x) if x in anew else F.col("_row")[x].alias(x) for x in docs.columns))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM doc, unnest(generate_series(1, len(w) - 19)) AS t(i) WHERE len(w) >= 20),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM late, generate_series(0, 19) AS t(k)),
word AS (SELECT doc_id, j, w[j] AS x FROM doc, unnest(generate_series(1, len(w))) AS t(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""
