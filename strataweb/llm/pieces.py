"""SentencePiece sampling without replacement, encoding and decoding.

A text's segmentations are the paths of its piece lattice. Each weighs the product of its pieces'
weights; a piece of rank r in the vocabulary weighs (r + 2) ** -alpha. Stretches of text that no
piece crosses are lattices of their own, so that a word's lattice is built once and used
wherever the word occurs.

The k segmentations with the largest Gumbel-perturbed log weights are a sample of k without
replacement. An A* search finds them from above: a node stands for all paths with a common
beginning, its bound is the largest perturbed value among them, drawn from a Gumbel truncated at its
parent's. Following the path of a bound leaves, at each step, a node of the other paths; the next
sample is in the node with the largest bound. The bound that remains after k samples gives each
sample's inclusion score. All draws are hashes of the row's key and the place in the text.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 1.0, 42
#: Characters of lattices, and stretches met once, that a worker remembers; characters that are sampled together.
CACHE, MET, BLOCK_CHARS = 1_500_000, 500_000, 300_000
#: Flags, a power of two, by which stretches met once are remembered; characters after which freed memory is given back.
FLAGS, TRIM_CHARS = 1 << 22, 1_000_000
#: Characters that have a column of their own in the trie's table.
COMMON = 160
SAMPLED = "sample int, ids array<int>, log_prob double, inclusion double, round_trip boolean"


class Vocabulary:
    """Pieces of a model file, with spaces for its space marks, and their weights."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [-1] * 256
        #: Beginnings of pieces, to (id, weight) where a piece ends, else to None.
        self.begins: dict[str, tuple[int, float] | None] = {}
        pieces = []
        for k in range(size):
            p = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(p[3:5], 16)] = k
                self.bytes_of[k] = bytes([int(p[3:5], 16)])
            elif not model.is_control(k) and not model.is_unknown(k) and not model.is_unused(k):
                p = p.replace("▁", " ")
                self.bytes_of[k] = c.encoded(p)
                pieces.append((p, k, (2 - model.get_score(k)) ** -alpha))
        self.spelling = pa.array(self.bytes_of, pa.large_binary())
        self.byte_weight = float(size) ** -alpha
        #: Logarithms of the weights: of the pieces by id, and of a byte.
        self.log_weight, self.log_byte = [-alpha * math.log(2 - model.get_score(k)) for k in range(size)], -alpha * math.log(size)
        for p, _, _ in pieces:
            for n in range(1, len(p)):
                self.begins.setdefault(p[:n])
        self.begins |= {p: (k, w) for p, k, w in pieces}
        #: The trie: its edges, as state and character, and where they lead; each state's piece and weight.
        self.longest = max(len(p) for p, _, _ in pieces)
        self.chars = np.array(sorted({ord(x) for p, _, _ in pieces for x in p}), np.uint32)
        state = {"": 0} | {p: k for k, p in enumerate(self.begins, 1)}
        char = {chr(x): k for k, x in enumerate(self.chars.tolist())}
        edges = np.array([state[p[:-1]] * (len(char) + 1) + char[p[-1]] for p in self.begins], np.int64)
        order = np.argsort(edges)
        self.edges, self.into = edges[order], order + 1
        #: The characters with most edges lead on by a table; others are searched for among the edges.
        often = np.argsort(-np.bincount(edges % (len(char) + 1), minlength=len(char) + 1), kind="stable")[:COMMON]
        self.column = np.full(len(char) + 1, -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.table = np.zeros((len(state), len(often)), np.min_scalar_type(len(state)))
        own = self.column[self.edges % (len(char) + 1)]
        self.table[self.edges[own >= 0] // (len(char) + 1), own[own >= 0]] = self.into[own >= 0]
        self.piece = np.array([-1, *(-1 if x is None else x[0] for x in self.begins.values())], np.int64)
        self.weight = np.array([0.0, *(0.0 if x is None else x[1] for x in self.begins.values())])
        self.split = re.compile(self._split([p for p, _, _ in pieces if len(p) > 1]), re.DOTALL)
        #: A character without a piece is its UTF-8 bytes, one arc; arcs of several ids come after the pieces.
        self.spelled: dict[str, int] = {}
        self.ids_of: list[tuple[int, ...]] = [(k,) for k in range(size)]

    @staticmethod
    def _split(pieces: list[str]) -> str:
        """A pattern whose matches tile any text, and that no piece crosses."""
        if any(" " in p.lstrip(" ") for p in pieces):
            return ".+"
        return "\n| *[^ \n]+| +" if not any("\n" in p for p in pieces) else " *[^ ]+| +"

    def spell(self, char: str) -> int:
        if char not in self.spelled:
            raw = tuple(self.byte_id[x] for x in c.encoded(char))
            if len(raw) == 1:
                self.spelled[char] = raw[0]
            else:
                self.spelled[char] = len(self.ids_of)
                self.ids_of.append(raw)
                self.bytes_of.append(c.encoded(char))
        return self.spelled[char]

    def arcs(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """For the places of each stretch, from its last to its first: their numbers of arcs, then each arc's length, id, logarithms of its share and of what the place's other arcs have, and share cumulated.

        The trie of pieces is walked from all places at once; weights of what lies behind a place
        are summed for all places that are equally far from their stretches' ends. Next to a share that is
        1 but for rounding the others' are summed by themselves, so that none is lost.
        """
        n = np.fromiter(map(len, stretches), np.int64, len(stretches))
        char = np.searchsorted(self.chars, code := np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32))
        char[self.chars[np.minimum(char, len(self.chars) - 1)] != code] = len(self.chars)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(char))
        node = np.repeat(np.cumsum(n) - n, n) + left - 1
        at, state, found, one = np.arange(len(char)), np.zeros(len(char), np.int64), [], np.zeros(len(char), bool)
        for d in range(1, self.longest + 1):
            on = left[at] >= d
            at, state = at[on], state[on]
            column = self.column[char[at + d - 1]]
            into = self.table[state, column]
            rare = np.flatnonzero(column < 0)
            key = state[rare] * (len(self.chars) + 1) + char[at[rare] + d - 1]
            place = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            into[rare] = np.where(self.edges[place] == key, self.into[place], 0)
            on = into > 0
            at, state = at[on], into[on].astype(np.int64)
            on = self.piece[state] >= 0
            found.append((at[on], np.full(int(on.sum()), d), self.piece[state[on]], self.weight[state[on]]))
            if d == 1:
                one[at[on]] = True
        bare = np.flatnonzero(~one)
        spelled = np.fromiter((self.spell(chr(x)) for x in code[bare].tolist()), np.int64, len(bare))
        found.append((bare, np.ones(len(bare), np.int64), spelled, np.array([self.byte_weight ** len(self.ids_of[k]) for k in spelled.tolist()])))
        # A node's arcs stand together, the longest first.
        source = [node[at] for at, _, _, _ in found]
        count = np.bincount(np.concatenate(source), minlength=len(char))
        first = np.cumsum(count) - count
        d, ids, weight, free = np.zeros(count.sum(), np.int64), np.zeros(count.sum(), np.int64), np.zeros(count.sum()), first.copy()
        for of, (_, *values) in zip(source[::-1], found[::-1]):
            for x, y in zip((d, ids, weight), values):
                x[free[of]] = y
            free[of] += 1
        rest, share = np.zeros(len(char)), np.zeros(len(d))
        far = np.empty_like(left)
        far[node] = left
        order = np.argsort(far, kind="stable")
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for r, some in enumerate(np.split(order, np.searchsorted(far[order], np.arange(2, n.max() + 1))), 1):
                total = np.zeros(len(some))
                for k in range(int(count[some].max())):
                    on = count[some] > k
                    arc, own = first[some[on]] + k, some[on]
                    weight[arc] *= np.where(d[arc] == r, 1.0, rest[own - d[arc]])
                    total[on] += weight[arc]
                    share[arc] = total[on]
                rest[some] = total
            starts = np.cumsum(n) - n
            fine = (np.minimum.reduceat(rest, starts) >= 1e-200) & (np.maximum.reduceat(rest, starts) <= 1e200) & (np.minimum.reduceat(weight, first[starts]) >= 1e-290)
            of_all = np.repeat(rest, count)
            share, weight = share / of_all, weight / of_all
            most = weight > 0.5
            others = np.add.reduceat(np.where(most, 0.0, weight), first)
            besides = np.log1p(-weight)
            besides[most] = np.log(np.repeat(others, count)[most])
            log = np.log(weight)
        if not fine.all():
            return self._mended(stretches, n, np.repeat(~fine, n), count, d, ids, log, besides, share)
        return count, d, ids, log, besides, share

    def _mended(self, stretches, n, thin, count, *arcs) -> tuple[np.ndarray, ...]:
        """arcs(), with those stretches anew whose weights are too small or too large for a number."""
        ends, upto, out = np.cumsum(n), np.append(0, np.cumsum(count)), []
        for s, a, b in zip(stretches, (ends - n).tolist(), ends.tolist()):
            out.append(self._long(s) if thin[a] else (count[a:b], *(x[upto[a] : upto[b]] for x in arcs)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _long(self, s: str) -> tuple[list, ...]:
        """The same of one stretch, by logarithms."""
        n, rest = len(s), [0.0] * (len(s) + 1)
        out: tuple[list, ...] = [], [], [], [], [], []
        for i in range(n - 1, -1, -1):
            found = []
            for j in range(i + 1, n + 1):
                p = self.begins.get(s[i:j], 0)
                if p == 0:
                    break
                if p:
                    found.append((j - i, p[0], self.log_weight[p[0]] + rest[j]))
            if not found or found[0][0] > 1:
                k = self.spell(s[i])
                found.append((1, k, self.log_byte * len(self.ids_of[k]) + rest[i + 1]))
            logs = [x for _, _, x in found]
            rest[i] = log_sum(logs)
            upto = 0.0
            for e, (d, k, x) in enumerate(found):
                share = math.exp(x - rest[i])
                upto += share
                others = math.log1p(-share) if share <= 0.5 else log_sum(logs[:e] + logs[e + 1 :]) - rest[i]
                for to, v in zip(out[1:], (d, k, x - rest[i], others, upto)):
                    to.append(v)
            out[0].append(len(found))
        return out


def log_sum(logs: list[float]) -> float:
    """The logarithm of the sum of the numbers that have these logarithms."""
    top = max(logs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in logs))


def draw(key: np.ndarray, stream: int, at: np.ndarray) -> np.ndarray:
    """Uniform numbers, above 0 and below 1, for rows' keys and places."""
    x = c.mix(key + (at.astype(np.uint64) * np.uint64(64) + np.uint64(stream) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Sampler:
    def __init__(self, path: str, alpha: float, seed: int):
        self.words, self.seed = Vocabulary(path, alpha), seed
        self._forget()

    def key(self, row: object) -> int:
        return xxhash.xxh64_intdigest(str(row).encode(), self.seed)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met, self.n_met = np.zeros(FLAGS, bool), 0
        self.passing: list[str] = []
        self.nodes = self.size = 0
        self.stay = 0, 0
        self.count, self.arcs = np.zeros(1 << 16, np.int16), np.zeros((1 << 16) + 1, np.int64)
        self.step, self.id, self.log, self.left, self.upto = (np.zeros(1 << 18, t) for t in (np.int8, np.int32, np.float64, np.float64, np.float64))

    def _room(self, nodes: int, arcs: int) -> None:
        """Makes room for so many more, doubling what there is; pages of the new half take no memory before they are used."""

        def longer(x: np.ndarray, n: int) -> np.ndarray:
            y = np.zeros(n, x.dtype)
            y[: len(x)] = x
            return y

        n, m = len(self.count), len(self.step)
        while n < self.nodes + nodes:
            n *= 2
        while m < self.size + arcs:
            m *= 2
        if n > len(self.count):
            self.count, self.arcs = longer(self.count, n), longer(self.arcs, n + 1)
        if m > len(self.step):
            for name in ("step", "id", "log", "left", "upto"):
                setattr(self, name, longer(getattr(self, name), m))

    def _lattices(self, chunks: list[str]) -> None:
        """Sees to it that the lattices of the chunks, each given once, are known. A place's node comes after that of the place behind it.

        Lattices stay if their chunks come in a second block; others give way to the next block's. Chunks that share
        a flag count as met once one of them is.
        """
        for x in self.passing:
            del self.known[x]
        self.nodes, self.size = self.stay
        if self.nodes > CACHE:
            self._forget()
        if self.n_met > MET:
            self.met[:] = False
            self.n_met = 0
        new = [x for x in chunks if x not in self.known]
        flag = np.fromiter(map(hash, new), np.int64, len(new)) & (FLAGS - 1)
        met = self.met[flag]
        self._add(list(itertools.compress(new, met.tolist())))
        self.stay = self.nodes, self.size
        self.passing = list(itertools.compress(new, (~met).tolist()))
        self.met[flag] = True
        self.n_met += len(self.passing)
        self._add(self.passing)

    def _add(self, new: list[str]) -> None:
        if not new:
            return
        self.known |= zip(new, (self.nodes - 1 + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))).tolist())
        count, *arcs = self.words.arcs(new)
        self._room(len(count), len(arcs[0]))
        upto = slice(self.nodes, self.nodes + len(count))
        self.count[upto] = count
        self.arcs[upto.start + 1 : upto.stop + 1] = self.size + np.cumsum(count)
        for x, y in zip((self.step, self.id, self.log, self.left, self.upto), arcs):
            x[self.size : self.size + len(y)] = y
        self.nodes, self.size = upto.stop, self.size + len(arcs[0])

    def _pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        arc, last = self.arcs[node], self.arcs[node + 1] - 1
        on = np.flatnonzero((u >= self.upto[arc]) & (arc < last))
        while len(on):
            arc[on] += 1
            on = on[(u[on] >= self.upto[arc[on]]) & (arc[on] < last[on])]
        return arc

    def sample(self, rows: list[tuple[object, str]], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """For each (key, text) up to k of (ids, log probability, inclusion score), the largest perturbed first."""
        texts = [" " + t if t else "" for _, t in rows]
        chars = np.array([len(t) for t in texts], np.int64)
        if not chars.any():
            return [[(np.zeros(0, np.int32), 0.0, 1.0)] for _ in rows]
        tokens = [self.words.split.findall(t) for t in texts]
        n = np.array([len(t) for t in tokens], np.int64)
        place: dict[str, int] = defaultdict(itertools.count().__next__)
        of_chunk = np.fromiter(map(place.__getitem__, itertools.chain.from_iterable(tokens)), np.int64, n.sum())
        chunks = list(place)
        self._lattices(chunks)
        keys = np.array([self.key(r) for r, _ in rows], np.uint64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))[of_chunk]
        start, last, begin = np.cumsum(size) - size, np.cumsum(n), np.cumsum(chars) - chars
        doc = np.repeat(np.arange(len(rows)), n)
        node = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[of_chunk]
        block = keys, node, start, node - size, last, begin
        at, arc, of = self._walk(0, keys[doc], node, start, node - size, begin[doc])
        lp, left = self.log[arc], self.left[arc]
        ends = np.searchsorted(at, begin + chars)
        cuts = ends - np.diff(np.append(0, ends))
        top = -np.log(-np.log(draw(keys, 61, np.zeros(len(rows)))))
        bounds = self._bounds(1, keys, at, lp, left, np.repeat(np.arange(len(rows)), ends - cuts), begin, np.zeros(len(rows)), top)
        spans = list(zip(cuts.tolist(), ends.tolist()))
        #: A path: places, arcs, nodes, log shares. An open node: bounds by step, its path, arcs gone by step.
        paths = [[(at[a:b], arc[a:b], of[a:b], lp[a:b])] for a, b in spans]
        open_: list[list[tuple[np.ndarray, int, dict]]] = [[(bounds[a:b].copy(), 0, {})] for a, b in spans]
        for s in range(1, k):
            go = []
            for d in range(len(rows)):
                bound, e = max(((float(x[0].max(initial=-np.inf)), e) for e, x in enumerate(open_[d])), default=(-np.inf, 0))
                if bound == -np.inf:
                    continue
                values, parent, gone = open_[d][e]
                i = int(values.argmax())
                p_at, p_arc, p_of, p_lp = paths[d][parent]
                here, place = int(p_of[i]), int(p_at[i] - begin[d])
                shut = gone.setdefault(i, [int(p_arc[i])])
                logs = self.log[self.arcs[here] : self.arcs[here + 1]].copy()
                logs[np.array(shut) - self.arcs[here]] = -np.inf
                share = np.exp(logs - logs.max())
                u = draw(np.full(2, keys[d]), 2 * s + 1, np.array([2 * place, 2 * place + 1]))
                new = min(int(np.searchsorted(np.cumsum(share), u[1] * share.sum(), "right")), int(np.flatnonzero(share)[-1]))
                before, own, logs[new] = float(p_lp[:i].sum()), float(logs[new]), -np.inf
                shut.append(new + int(self.arcs[here]))
                values[i] = -np.logaddexp(-bound, math.log(-math.log(u[0])) - before - log_sum(logs.tolist()))
                go.append((d, parent, i, shut[-1], here, bound, before, own))
            if not go:
                break
            for (d, parent, i, new, here, _, _, own), (x_at, x_arc, x_of, x_lp, x_bound) in zip(go, self._suffixes(s, go, paths, block)):
                p_at, p_arc, p_of, p_lp = paths[d][parent]
                paths[d].append((np.concatenate([p_at[: i + 1], x_at]), np.concatenate([p_arc[:i], [new], x_arc]), np.concatenate([p_of[: i + 1], x_of]), np.concatenate([p_lp[:i], [own], x_lp])))
                open_[d].append((np.concatenate([np.full(i + 1, -np.inf), x_bound]), len(paths[d]) - 1, {}))
        out = []
        for d in range(len(rows)):
            if not chars[d]:
                out.append([(np.zeros(0, np.int32), 0.0, 1.0)])
                continue
            kappa = max(float(x[0].max(initial=-np.inf)) for x in open_[d])
            logs = [float(x[3].sum()) for x in paths[d]]
            out.append([(self._ids(x[1]), v, 1.0 if kappa == -np.inf else -math.expm1(-math.exp(min(700.0, v - kappa)))) for x, v in zip(paths[d], logs)])
        return out

    def _walk(self, stream: int, key, node, at, stop, begin) -> tuple[np.ndarray, ...]:
        """Paths from nodes to the ends of their chunks: places in the block, arcs and nodes, in order; draws go by place in the text."""
        steps = []
        while len(node):
            arc = self._pick(node, draw(key, stream, at - begin))
            steps.append((at, arc, node))
            node, at = node - self.step[arc], at + self.step[arc]
            on = node > stop
            key, node, at, stop, begin = key[on], node[on], at[on], stop[on], begin[on]
        found = [np.concatenate(x) for x in zip(*steps)] if steps else [np.zeros(0, np.int64)] * 3
        order = np.argsort(found[0], kind="stable")
        return tuple(x[order] for x in found)

    def _bounds(self, stream: int, keys, at, lp, left, doc, begin, before, top) -> np.ndarray:
        """At each step the bound of the paths that leave there; before: the log probability up to a document's first step."""
        total = np.empty_like(lp)
        cuts = np.searchsorted(doc, np.arange(len(begin) + 1)).tolist()
        for a, b in zip(cuts, cuts[1:]):  # each on its own, so that a block's other texts don't round it
            np.cumsum(lp[a:b], out=total[a:b])
        mass = total - lp + before[doc] + left
        g = mass - np.log(-np.log(draw(keys[doc], stream, at - begin[doc])))
        return -np.logaddexp(-top[doc], -g)

    def _suffixes(self, s: int, go, paths, block):
        """For each branch the steps after it, with their bounds."""
        keys, node, start, stop, last, begin = block
        d = np.array([x[0] for x in go])
        at = np.array([int(paths[x[0]][x[1]][0][x[2]]) for x in go])
        token = np.searchsorted(start, at, "right") - 1
        step = self.step[np.array([x[3] for x in go])]
        here = np.array([x[4] for x in go]) - step
        on = here > stop[token]
        more = last[d] - token - 1
        after = np.repeat(token + 1, more) + c.runs(more)
        own = np.concatenate([d[on], np.repeat(d, more)])
        x_at, x_arc, x_of = self._walk(2 * s, keys[own], np.concatenate([here[on], node[after]]), np.concatenate([(at + step)[on], start[after]]), np.concatenate([stop[token][on], stop[after]]), begin[own])
        lp, left = self.log[x_arc], self.left[x_arc]
        before, top = np.zeros(len(begin)), np.zeros(len(begin))
        before[d], top[d] = [x[6] + x[7] for x in go], [x[5] for x in go]
        of = np.searchsorted(begin, x_at, "right") - 1
        bound = self._bounds(2 * s + 32, keys, x_at, lp, left, of, begin, before, top) if len(x_at) else np.zeros(0)
        cuts = zip(np.searchsorted(of, d, "left").tolist(), np.searchsorted(of, d, "right").tolist())
        return [(x_at[a:b], x_arc[a:b], x_of[a:b], lp[a:b], bound[a:b].copy()) for a, b in cuts]

    def _ids(self, arcs: np.ndarray) -> np.ndarray:
        ids = self.id[arcs]
        if (ids < self.words.size).all():
            return ids
        return np.array([k for x in ids.tolist() for k in self.words.ids_of[x]], np.int32)


def decoded(words: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The texts, in UTF-8, of which these are the ids; so many ids each, one text after another."""
    taken = words.spelling.take(pa.array(ids, pa.int32()))
    upto, raw = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1], memoryview(taken.buffers()[2] or b"")
    cuts = upto[np.append(0, np.cumsum(sizes))].tolist() if len(ids) else [0] * (len(sizes) + 1)
    return [bytes(raw[a + 1 : b]) for a, b in zip(cuts, cuts[1:])]  # but for the space in front


def decode(words: Vocabulary, ids: list[int]) -> str:
    """The text of which these are the ids."""
    return decoded(words, np.array(ids, np.int32), np.array([len(ids)]))[0].decode("utf-8", "surrogatepass")


_SAMPLERS: dict[tuple, Sampler] = {}


def _each(model: str, k: int, alpha: float, seed: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _SAMPLERS.setdefault((model, alpha, seed), None) or Sampler(SparkFiles.get(model.rpartition("/")[2]), alpha, seed)
        _SAMPLERS[model, alpha, seed] = own
        freed = 0
        c.trim()  # what earlier stages left in this worker
        for b in batches:
            chars, first, size = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist(), 0, 0
            for i, n in enumerate(chars):
                size += n + 1
                if size < BLOCK_CHARS and i < len(chars) - 1:
                    continue
                block = b.slice(first, i + 1 - first)  # a batch's texts aren't all held twice
                some = block.column(1).to_pylist()
                found = own.sample([(r, t or "") for r, t in zip(block.column(0).to_pylist(), some)], k)
                rows, ids = [], []
                for j, (t, x) in enumerate(zip(some, found)):
                    for s, (v, lp, q) in enumerate(x if t is not None else [(None, None, None)]):
                        rows.append((j, s, lp, q))
                        ids.append(v)
                of, s, lp, q = zip(*rows)
                sizes = np.array([0 if v is None else len(v) for v in ids])
                values = np.concatenate([v for v in ids if v is not None] or [np.zeros(0, np.int32)])
                raw = [None if t is None else c.encoded(t) for t in some]
                ok = [None if raw[j] is None else x == raw[j] for j, x in zip(of, decoded(own.words, values, sizes))]
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append([v is None for v in ids], False))
                lists = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
                own_cols = [x.take(pa.array(of, pa.int64())) for x in block.columns[2:]]
                yield pa.RecordBatch.from_arrays([*own_cols, pa.array(s, pa.int32()), lists, pa.array(lp, pa.float64()), pa.array(q, pa.float64()), pa.array(ok, pa.bool_())], names=[*b.schema.names[2:], "sample", "ids", "log_prob", "inclusion", "round_trip"])
                freed += size
                first, size = i + 1, 0
                if freed >= TRIM_CHARS:
                    found = ids = values = raw = some = lists = own_cols = None
                    c.trim()
                    freed = 0

    return each


def sampled(docs: DataFrame, *keep: str, key: str = "doc_id", text: str = "text", k: int = SAMPLES, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The columns to keep and SAMPLED's: up to k distinct segmentations of each row's whole text.

    Samples are numbered from 0, the largest perturbed one first; a text with fewer segmentations has
    fewer. log_prob is the logarithm of a segmentation's probability, inclusion 1 - exp(-exp(log_prob
    - t)), t being the bound that remains, or 1 if all segmentations are out. An empty text has the one
    empty segmentation; a null text has one row of nulls. Rows with equal keys and texts, null keys
    too, get the same samples. round_trip tells whether the ids decode to the text; a row for each
    sample, and no rows for no rows. A column to keep that is called as one of SAMPLED gives way to it.
    Executors get the model file from the driver.
    """
    keep = c.apart(keep, *(x.split()[0] for x in SAMPLED.split(", ")))
    schema = c.extended(docs, keep, SAMPLED)
    docs.sparkSession.sparkContext.addFile(model)
    return docs.select(F.col(key).cast("string").alias("_key"), F.col(text).cast("string").alias("_text"), *keep).mapInArrow(_each(model, k, alpha, seed), schema)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampled(c.table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "sample", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", "round_trip")
