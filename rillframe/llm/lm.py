"""Language-model scores: word counts of the whole corpus, and a causal self-attention model over subword ids, trained in numpy.

A text is its words with A-Z lowered. Each word, a space before it, is cut into pieces of a public vocabulary. The network reads the pieces'
ids and predicts the next one, or the end, over the whole vocabulary in steps: by how often the training texts hold them, frequent pieces are
classes of their own, in groups; the classes of the last group are bins of rarer pieces, and a third step tells the pieces of a bin apart.
So a piece sequence has a probability, and a text that of its one sequence.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import blocks, _LOWER, mix, partitions, quoted, release, remainder, rolling, stored, substring_hash, text_bytes, tidied, word_bounds

_U = np.uint64
#: Groups, and classes of a group. Class 0 is the border of a text; the classes of the last group are bins of rarer pieces.
GROUPS = 40
CLASSES = GROUPS * GROUPS
#: Inputs of a window, how many of them only give context (borders, where the text begins), and the places that it scores.
WINDOW, CONTEXT = 32, 8
SCORED = WINDOW - CONTEXT
#: The counts of so many of the most frequent words go to all workers; a rarer word's count is joined by a shuffle.
HEAD = 1 << 19
#: Windows that a copy of the network trains on in a round, at least, and its least number of steps (few windows are gone over again).
LEARNER, STEPS = 1 << 17, 400
#: Windows that are put in random order at once.
POOL = 1 << 15
#: Windows at once in the output and before it: few, so that their arrays stay in a core's cache.
CHUNK, FEW = 256, 128
#: The end of a text among word hashes.
END = np.int64(0x0E0D)
#: Different words that a task holds before it passes their counts on.
HELD = 1 << 20


@lru_cache(maxsize=1)
def _processor(model: str):
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=model)
    if made.get_piece_size() >= 1 << 16:
        raise ValueError("ids and the border must fit into 16 bits")
    return made


def cut_words(model: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces of each word (with a space before it), one after another, and their numbers."""
    raw = data.tobytes()
    found = _processor(model).encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], num_threads=1)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for ids in found for i in ids), np.uint16, int(sizes.sum())), sizes


@dataclass
class Classes:
    """of: the class of each id (a piece's number and 1; id 0 is the border); bins: the ids of each bin of rarer pieces, 0 where it has
    fewer than others; share: their log shares in their bin; prior: the classes' log shares."""

    of: np.ndarray
    place: np.ndarray
    bins: np.ndarray
    share: np.ndarray
    prior: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray, texts: float, first: np.ndarray) -> Classes:
        """counts: how often each piece occurs; first: whether it begins a word; such pieces are in groups of their own."""
        smooth = np.append(0.0, counts + 0.05)
        order = 1 + np.argsort(-smooth[1:], kind="stable")
        own = CLASSES - GROUPS - 1
        of, place = np.zeros(len(smooth), np.int16), np.zeros(len(smooth), np.int32)
        often, rest = order[:own], order[own:]
        of[often[np.argsort(~first[often - 1], kind="stable")]] = np.arange(1, len(often) + 1)
        width = max(1, -(-len(rest) // GROUPS))
        place[rest] = np.arange(len(rest)) % width
        of[rest] = CLASSES - GROUPS + np.arange(len(rest)) // width
        bins = np.zeros((GROUPS, width), np.int32)
        bins[of[rest] - (CLASSES - GROUPS), place[rest]] = rest
        total = np.bincount(of, smooth, CLASSES)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(bins > 0, np.log(smooth[bins] / total[CLASSES - GROUPS :, None]), -np.inf).astype(np.float32)
        total[0] = texts
        total += 0.05
        return Classes(of, place, bins, share, np.log(total / total.sum()).astype(np.float32))


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return (top + np.log(np.exp(x - top[:, None]).sum(1))).astype(np.float32)


def _log_total(z: np.ndarray, bias: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of each row's sum of exponentials of z + bias; z is lost. safe: no exponential is too large or all too small for a float."""
    if safe:
        np.exp(z, out=z)
        return np.log(z @ np.exp(bias))
    z += bias
    return _log_sum(z)


class Network:
    """One layer of causal self-attention and one of ReLU units over subword ids, all arrays float32.

    The products of the query's and the key's matrix, and of the value's and the output's, are one matrix each (`look`, `take`).
    """

    def __init__(self, p: dict[str, np.ndarray], classes: Classes):
        self.p, self.classes = p, classes
        self.past = np.tril(np.ones((WINDOW, WINDOW), np.float32))[CONTEXT:]
        self.steep = max(float(np.sqrt((p[k] ** 2).sum(-2).max())) for k in ("group", "class"))
        self.rows = np.empty((CHUNK * SCORED, GROUPS), np.float32)

    @staticmethod
    def fresh(classes: Classes, width: int = 16, units: int = 32, seed: int = 9) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        d, prior = width, classes.prior.reshape(GROUPS, GROUPS)
        level = _log_sum(prior)
        return Network({
            "e": normal(len(classes.of), d, scale=0.5), "pos": normal(WINDOW, d, scale=0.1), "look": normal(d, d, scale=0.5 / d), "take": normal(d, d, scale=0.5 * d**-0.5),
            "w1": normal(d, units, scale=d**-0.5), "w2": normal(units, d, scale=0.5 * units**-0.5), "group": normal(d, GROUPS, scale=0.05), "group_bias": level,
            "class": normal(GROUPS, d, GROUPS, scale=0.05), "class_bias": prior - level[:, None], "rare": np.zeros((GROUPS, d, classes.bins.shape[1]), np.float32),
        }, classes)

    def hidden(self, x: np.ndarray):
        """States of the scored places of the windows, those after the context."""
        p, (b, t), d = self.p, x.shape, self.p["pos"].shape[1]
        h0 = np.take(p["e"], x, axis=0)
        h0 += p["pos"][:t]
        own = np.ascontiguousarray(h0[:, CONTEXT:]).reshape(-1, d)
        q = (own @ p["look"]).reshape(b, t - CONTEXT, d)
        a = np.matmul(q, h0.transpose(0, 2, 1))
        past = self.past[: t - CONTEXT, :t]
        ones = np.ones(t, a.dtype)
        with np.errstate(over="ignore"):
            np.exp(a, out=a)
        a *= past
        total = a.reshape(-1, t) @ ones
        if not (np.isfinite(total).all() and total.min(initial=1) > 0):
            a = np.exp(np.clip(np.matmul(q, h0.transpose(0, 2, 1)), -60, 60)) * past
            total = a.reshape(-1, t) @ ones
        np.reciprocal(total, out=total)
        m = np.matmul(a, h0).reshape(-1, d)
        m *= total[:, None]
        h1 = m @ p["take"]
        h1 += own
        u = h1 @ p["w1"]
        np.maximum(u, 0, out=u)
        h2 = u @ p["w2"]
        h2 += h1
        return h2, (h0, own, q, a, total, m, h1, u)

    def log_chance(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target id."""
        p, n, k = self.p, len(h), self.classes
        of = k.of[target]
        group = of // np.int16(GROUPS)
        order = np.argsort(group.astype(np.int8), kind="stable")
        h, of = np.take(h, order, axis=0), of[order].astype(np.int64)
        group, own = np.divmod(of, GROUPS)
        if n > len(self.rows):
            self.rows = np.empty((n, GROUPS), np.float32)
        z, at = self.rows[:n], np.arange(0, n * GROUPS, GROUPS)
        safe = np.sqrt(float(np.einsum("ij,ij->i", h, h).max(initial=0))) * self.steep < 80
        np.matmul(h, p["group"], out=z)
        found = z.ravel()[at + group]
        found += p["group_bias"][group]
        found -= _log_total(z, p["group_bias"], safe)
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        for g in range(GROUPS):
            i, j = ends[g], ends[g + 1]
            if i < j:
                np.matmul(h[i:j], p["class"][g], out=z[i:j])
        found += z.ravel()[at + own]
        found += p["class_bias"].ravel()[of]
        for g in range(GROUPS):
            i, j = ends[g], ends[g + 1]
            if i < j:
                found[i:j] -= _log_total(z[i:j], p["class_bias"][g], safe)
        out = np.empty_like(found)
        i = ends[GROUPS - 1]
        if i < n:
            found[i:] += self._within(h[i:], own[i:], k.place[target[order[i:]]])
        out[order] = found
        return out

    def _within(self, h: np.ndarray, bin: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log chances of the rarer pieces, given their bins."""
        found = np.empty(len(h), np.float32)
        for b in np.unique(bin):
            at = np.flatnonzero(bin == b)
            for a in range(0, len(at), 1024):
                some = at[a : a + 1024]
                z = h[some] @ self.p["rare"][b] + self.classes.share[b]
                found[some] = z[np.arange(len(some)), place[some]] - _log_sum(z)
        return found

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean loss and gradients over places of weight 1; x: windows by places, target, weight: windows by scored places.

        Those of `e` are (ids, rows), those of `rare` are by bin: what no window meets isn't there.
        """
        p, (b, t), k = self.p, x.shape, self.classes
        d = p["pos"].shape[1]
        h, (h0, own, q, a, total, m, h1, u) = self.hidden(x)
        a *= total.reshape(b, t - CONTEXT, 1)
        scored = np.flatnonzero(weight.ravel())
        ids = target.ravel()[scored]
        of = k.of[ids].astype(np.int64)
        order = np.argsort((of // GROUPS).astype(np.int8), kind="stable")
        scored, ids = scored[order], ids[order]
        group, place = np.divmod(of[order], GROUPS)
        n, hs = max(len(scored), 1), h[scored]
        at = np.arange(len(scored))

        def softmax(z, y):
            z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            z *= (1 / z.sum(1))[:, None]
            lost = -np.log(z[at[: len(y)], y] + 1e-20).sum()
            z[at[: len(y)], y] -= 1
            z *= np.float32(1 / n)
            return z, lost

        z, loss = softmax(hs @ p["group"] + p["group_bias"], group)
        g = {"group": hs.T @ z, "group_bias": z.sum(0), "class": np.zeros_like(p["class"]), "class_bias": np.zeros_like(p["class_bias"]), "rare": {}}
        ds = z @ p["group"].T
        ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        for c in range(GROUPS):
            i, j = ends[c], ends[c + 1]
            if i < j:
                z, lost = softmax(hs[i:j] @ p["class"][c] + p["class_bias"][c], place[i:j])
                loss += lost
                g["class"][c], g["class_bias"][c] = hs[i:j].T @ z, z.sum(0)
                ds[i:j] += z @ p["class"][c].T
        last = ends[GROUPS - 1]
        for c in np.unique(place[last:]).tolist():
            some = last + np.flatnonzero(place[last:] == c)
            z, lost = softmax(hs[some] @ p["rare"][c] + k.share[c], k.place[ids[some]])
            loss += lost
            g["rare"][c] = hs[some].T @ z
            ds[some] += z @ p["rare"][c].T
        loss = float(loss) / n
        dh = np.zeros_like(h)
        dh[scored] = ds
        du = dh @ p["w2"].T
        du[u <= 0] = 0
        g["w2"], g["w1"] = u.T @ dh, h1.T @ du
        dh1 = dh + du @ p["w1"].T
        g["take"] = m.T @ dh1
        dm = (dh1 @ p["take"].T).reshape(b, t - CONTEXT, d)
        da = np.matmul(dm, h0.transpose(0, 2, 1))
        da -= (da * a).sum(2, keepdims=True)
        da *= a
        dq = np.matmul(da, h0).reshape(-1, d)
        g["look"] = own.T @ dq
        dh0 = np.matmul(np.concatenate([a, da], 1).transpose(0, 2, 1), np.concatenate([dm, q], 1))
        dh0[:, CONTEXT:] += (dh1 + dq @ p["look"].T).reshape(b, t - CONTEXT, d)
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:t] = dh0.sum(0)
        seen, rows = x.ravel(), dh0.reshape(-1, d)
        by = np.argsort(seen, kind="stable")
        heads = np.flatnonzero(np.diff(seen[by].astype(np.int64), prepend=-1))
        g["e"] = (seen[by[heads]], np.add.reduceat(rows[by], heads, axis=0))
        return loss, g


class Trainer:
    """Adam for what every step meets; rows of `e` and bins of `rare` move by their own mean squares, when a step meets them."""

    def __init__(self, net: Network):
        self.net, self.n = net, 0
        self.first, self.second = ({k: np.zeros_like(v) for k, v in net.p.items() if k not in ("e", "rare")} for _ in range(2))
        self.row, self.bin = np.zeros(len(net.p["e"]), np.float32), np.zeros((GROUPS, net.p["rare"].shape[2]), np.float32)

    def step(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> float:
        loss, g = self.net.gradients(x, target, weight)
        self.n += 1
        (rows, de), rare, p = g.pop("e"), g.pop("rare"), self.net.p
        scale = np.float32(min(1.0, 1.0 / (np.sqrt(sum(float((v * v).sum()) for v in (*g.values(), de, *rare.values()))) + 1e-9)))
        small = np.float32(1e-7)
        for key, v in g.items():
            v *= scale
            self.first[key] *= np.float32(0.9)
            self.first[key] += np.float32(0.1) * v
            self.second[key] *= np.float32(0.98)
            self.second[key] += np.float32(0.02) * v * v
            p[key] -= np.float32(rate / (1 - 0.9**self.n)) * self.first[key] / (np.sqrt(self.second[key] / np.float32(1 - 0.98**self.n)) + small)
        de *= scale
        self.row[rows] = np.float32(0.98) * self.row[rows] + np.float32(0.02) * (de * de).mean(1)
        p["e"][rows] -= np.float32(rate) * de / (np.sqrt(self.row[rows]) + small)[:, None]
        for c, v in rare.items():
            v *= scale
            self.bin[c] = np.float32(0.98) * self.bin[c] + np.float32(0.02) * (v * v).mean(0)
            p["rare"][c] -= np.float32(0.1 * rate) * v / (np.sqrt(self.bin[c]) + np.float32(1e-5))
        return loss


def windows(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, valid, many): WINDOW + 1 ids of each window of the texts, how many of its scored places are the text's, and windows a text.

    ids: the pieces' numbers of the texts, one after another; counts: of each text. A window's first WINDOW ids are inputs, and what follows
    each input is its target. Each next id and each end (0) is scored once, in the order of the texts, with CONTEXT inputs before it at least:
    the last ones of the window before, or borders (0) where the text begins.
    """
    lengths = counts + 1
    many = -(-lengths // SCORED)
    begin = (np.cumsum(many) - many) * SCORED + CONTEXT
    line = np.zeros(CONTEXT + int(many.sum()) * SCORED + 1, np.uint16)
    line[np.arange(1, len(ids) + 1) + np.repeat(begin - (np.cumsum(counts) - counts), counts)] = ids.astype(np.uint16) + np.uint16(1)
    made = np.lib.stride_tricks.as_strided(line, (int(many.sum()), WINDOW + 1), (2 * SCORED, 2)).copy()
    heads = np.cumsum(many) - many
    made[heads, :CONTEXT] = 0
    valid = np.full(len(made), SCORED, np.uint16)
    valid[heads + many - 1] = lengths - (many - 1) * SCORED
    return made, valid, many


class PieceCache:
    """Pieces of words met before, in a table with a place for each hash: frequent words are looked up, not cut anew, and memory is bounded."""

    BITS, FLAT = 21, 1 << 23

    def __init__(self, model: str):
        self.model = model
        self.word = np.zeros(1 << self.BITS, np.int64)
        self.begin, self.size = np.zeros(1 << self.BITS, np.int32), np.zeros(1 << self.BITS, np.int32)
        self.flat, self.used = np.zeros(self.FLAT, np.uint16), 0

    def pieces(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, where the pieces of each word begin in them, their numbers); words may repeat."""
        slot = (words.view(np.uint64) >> _U(64 - self.BITS)).astype(np.int64)
        miss = np.flatnonzero((self.word[slot] != words) | (self.size[slot] == 0))
        begin, size = self.begin[slot], self.size[slot]
        if not len(miss):
            return self.flat, begin, size
        _, first, which = np.unique(words[miss], return_index=True, return_inverse=True)
        first = miss[first]
        ids, sizes = cut_words(self.model, low, starts[first], ends[first])
        if self.used + len(ids) > len(self.flat):  # all are forgotten, so what begins in the old array is cut again
            self.word[:], self.size[:], self.used = 0, 0, 0
            if len(miss) < len(words):
                return self.pieces(low, starts, ends, words)
            if len(ids) > len(self.flat):
                self.flat = np.zeros(len(ids), np.uint16)
        at = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        begin[miss], size[miss] = at[which], sizes[which]
        self.word[slot[first]], self.begin[slot[first]], self.size[slot[first]] = words[first], at, sizes
        return self.flat, begin, size


@lru_cache(maxsize=1)
def piece_cache(model: str) -> PieceCache:
    """One for each Python worker: what a task has met serves the next one."""
    return PieceCache(model)


def _spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of each, one after another."""
    size = size.astype(np.int64)
    stop = np.cumsum(size)
    return flat[np.repeat(begin - (stop - size), size) + np.arange(int(size.sum()))]


@dataclass
class Cut:
    """A block of texts: piece ids of all words and how many each text has; the words' hashes, bounds and numbers in each text."""

    ids: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    number: np.ndarray


def _cut(cache: PieceCache, data, offsets) -> Cut:
    low = _LOWER[data]
    starts, ends, number = word_bounds(data, offsets)
    words = substring_hash(rolling(low), starts, ends).view(np.int64)
    flat, begin, size = cache.pieces(low, starts, ends, words)
    doc = np.repeat(np.arange(len(number)), number)
    return Cut(_spread(flat, begin, size), np.bincount(doc, size, len(number)).astype(np.int64), words, number)


def _drawn(cut: Cut, many: np.ndarray, every: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that train, one of each `every` that follow each other in a text (one of the rest, too), and the round of each; by hash of the text."""
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(cut.words.view(np.uint64), dtype=np.uint64))
    ends = np.concatenate([[0], np.cumsum(cut.number)])
    parts = -(-many // every)
    text = np.repeat(np.arange(len(many)), parts)
    part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    chance = mix((sums[ends[1:]] - sums[ends[:-1]])[text] + part.astype(np.uint64))
    first = part * every
    at = first + (chance % np.minimum(many[text] - first, every).astype(np.uint64)).astype(np.int64)
    return (np.cumsum(many) - many)[text] + at, ((chance >> _U(32)) % _U(rounds)).astype(np.int64)


def _gather(docs: DataFrame, model: str, every: int, rounds: int) -> DataFrame:
    """One pass over all training texts, stored. Rows of words (word, c): how often a task met them, the ends among them; rows of pieces (sums): how
    often a task met each, packed; rows of windows (turn, x): those that train in that round, packed with their valid places."""
    schema = "word bigint, c bigint, sums binary, turn int, x binary"

    def rows(n, **columns):
        types = {"word": pa.int64(), "c": pa.int64(), "sums": pa.binary(), "turn": pa.int32(), "x": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

    def merged(held):
        words, which = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(which, np.concatenate([c for _, c in held])).astype(np.int64)

    def counted(words, counts):
        for a in range(0, len(words), 100_000):
            yield rows(len(words[a : a + 100_000]), word=words[a : a + 100_000], c=counts[a : a + 100_000])

    def run(batches):
        held, size, texts = [], 0, 0
        cache, total = piece_cache(model), np.zeros(_processor(model).get_piece_size())
        for batch in batches:
            for _, data, offsets in blocks(batch):
                texts += len(offsets) - 1
                cut = _cut(cache, data, offsets)
                total += np.bincount(cut.ids, minlength=len(total))
                words, often = np.unique(cut.words, return_counts=True)
                held.append((words, often))
                size += len(words)
                if size > 2 * HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD:
                        yield from counted(*held[0])
                        held, size = [], 0
                made, valid, many = windows(cut.ids, cut.sizes)
                use, turn = _drawn(cut, many, every, rounds)
                x = np.concatenate([made[use], valid[use, None]], 1)
                for r in range(rounds):
                    own = np.ascontiguousarray(x[turn == r])
                    packed = [own[a : a + 1024].tobytes() for a in range(0, len(own), 1024)]
                    if packed:
                        yield rows(len(packed), turn=np.full(len(packed), r), x=packed)
        if held:
            yield from counted(*merged(held))
        if texts:
            yield from counted(np.array([END]), np.array([texts]))
            yield rows(1, sums=[total.tobytes()])

    return stored(docs.select(text_bytes().alias("text")).mapInArrow(tidied(run), schema), "gathered")


def _summed(vectors: DataFrame, n: int, kind=np.float64) -> np.ndarray:
    """The sum of a column of n packed vectors: tasks add up to sixteen each, in as many steps as it takes, and the driver the last eight."""
    name = vectors.columns[0]

    def run(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                one = np.frombuffer(x.as_buffer(), kind)
                total = one.astype(kind) if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=[name])

    while n > 8:
        n = -(-n // 16)
        vectors = vectors.repartition(n).mapInArrow(tidied(run), f"{name} binary")
    rows = vectors.collect()
    return np.sum([np.frombuffer(r[0], kind) for r in rows], axis=0) if rows else np.zeros(0, kind)


def _learn(net: Network, pools, n: int, rate: float, batch: int, seed: int, turn: int, turns: int) -> int:
    """Trains on n windows, which come in pools, each in random order; over all turns the rate falls. The number of windows."""
    trainer, rng, seen, done = Trainer(net), np.random.default_rng(seed), 0, 0
    passes = -(-STEPS * batch // max(n, 1))
    steps = max(1, passes * n // batch)
    if passes > 1:
        pools = [np.concatenate(list(pools))] * passes
    for pool in pools:
        seen += len(pool)
        order = rng.permutation(len(pool))
        for a in range(0, len(pool), batch):
            x = pool[order[a : a + batch]]
            now = rate * max(0.02, 1.02 - (turn + done / steps) / turns) * min(1.0, (turn * steps + done + 1) / 50)
            trainer.step(x[:, :WINDOW], x[:, CONTEXT + 1 : WINDOW + 1], np.arange(SCORED) < x[:, -1:], now)
            done += 1
    return seen // max(passes, 1)


def _train(gathered: DataFrame, classes: Classes, rounds: int, rate: float, batch: int, seed: int) -> Network:
    """Parameter averaging: in each round copies of the network train on their parts of the round's windows, and are averaged by their numbers of windows."""
    net = Network.fresh(classes)
    names = sorted(net.p)
    made = gathered.where("x is not null").select("turn", "x")
    sizes = {r["turn"]: r["n"] // (2 * (WINDOW + 2)) for r in made.groupBy("turn").agg(F.sum(F.length("x")).alias("n")).collect()}
    shared = gathered.sparkSession.sparkContext.broadcast(classes)
    for turn in range(rounds):
        if not sizes.get(turn):
            continue
        copies = min(max(1, sizes[turn] // LEARNER), partitions(gathered.sparkSession))
        sent = gathered.sparkSession.sparkContext.broadcast(net.p)

        def learn(batches, turn=turn, sent=sent, expected=-(-sizes[turn] // copies)):
            def pools():
                held, size = [], 0
                for b in batches:
                    for x in b.column(0):
                        held.append(np.frombuffer(x.as_buffer(), np.uint16).reshape(-1, WINDOW + 2))
                        size += len(held[-1])
                        if size >= POOL:
                            yield np.concatenate(held)
                            held, size = [], 0
                if held:
                    yield np.concatenate(held)

            own = Network({k: v.copy() for k, v in sent.value.items()}, shared.value)
            pools = pools()
            if (some := next(pools, None)) is not None:
                n = _learn(own, (x for part in ([some], pools) for x in part), expected, rate, batch, seed + turn, turn, rounds)
                body = np.concatenate([[n], *[n * own.p[k].ravel() for k in names]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([body.tobytes()], pa.binary())], names=["sums"])

        sums = _summed(made.where(F.col("turn") == turn).select("x").repartition(copies).mapInArrow(tidied(learn), "sums binary"), copies, np.float32)
        at, new = 1, {}
        for k in names:
            new[k] = (sums[at : at + net.p[k].size] / sums[0]).reshape(net.p[k].shape).astype(np.float32)
            at += net.p[k].size
        net = Network(new, classes)
        sent.unpersist()
    return net


class Head:
    """Values of frequent words by hash: a table with a place for each hash, and a sorted rest whose places were taken."""

    BITS = 21

    def __init__(self, words: np.ndarray, values: np.ndarray):
        slot = self._slot(words)
        _, first = np.unique(slot, return_index=True)
        self.word, self.value = np.zeros(1 << self.BITS, np.int64), np.full(1 << self.BITS, -np.inf)
        self.word[slot[first]], self.value[slot[first]] = words[first], values[first]
        rest = np.setdiff1d(np.arange(len(words)), first)
        rest = rest[np.argsort(words[rest])]
        self.more, self.more_values = words[rest], values[rest]

    def _slot(self, words):
        return (words.view(np.uint64) >> _U(64 - self.BITS)).astype(np.int64)

    def values(self, words: np.ndarray) -> np.ndarray:
        """The value of each word; minus infinity where there is none."""
        slot = self._slot(words)
        out = np.where(self.word[slot] == words, self.value[slot], -np.inf)
        if len(self.more):
            miss = np.flatnonzero((out == -np.inf) & (self.value[slot] > -np.inf))
            at = np.minimum(np.searchsorted(self.more, words[miss]), len(self.more) - 1)
            out[miss] = np.where(self.more[at] == words[miss], self.more_values[at], -np.inf)
        return out


def _head(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of all counts that at most HEAD words have or exceed, and their counts: by a histogram of counts and a filter."""
    top = 1 << 16
    bins = counts.groupBy(F.least("c", F.lit(top)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # `top` rows at most
    least, total = top + 1, 0
    for c, n in sorted(((r["c"], r["n"]) for r in bins), reverse=True):
        if total + n > HEAD:
            break
        least, total = c, total + n
    few = counts.where(F.col("c") >= least).toArrow()  # HEAD rows of 16 bytes at most
    return few.column("word").to_numpy(), few.column("c").to_numpy()


def score_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", folds: int = 5, hold: int = 1, every: int = 8, rounds: int = 2, rate: float = 0.04, batch: int = 256, seed: int = 2) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; learnt from rows whose crc32(key) modulo `folds` isn't `hold`.

    Tokens are the words ([^\\x20\\x09-\\x0D]+, A-Z lowered) and one end. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))); score is the
    model's log10 probability of the piece sequence with its end. The network trains on every training text: on one of each `every` windows that
    follow each other in it, one at least, the same share at any size. Null and empty texts are an end alone. Without training rows, N and V are 0
    and the model has only its smoothed priors. Repeated rows are rows like others, learnt from each; null keys count as empty ones; an empty
    table gives no rows. Other columns don't matter.
    """
    slim = docs.select(quoted(key).alias("key"), quoted(text).alias("text")).withColumn("held_out", remainder("key", folds) == hold)
    gathered = _gather(slim.where(~F.col("held_out")), model, every, rounds)
    counts = stored(gathered.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v_words, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c"), F.coalesce(F.sum(F.when(F.col("word") == int(END), F.col("c"))), F.lit(0))).first()
    sums = gathered.where("sums is not null").select("sums")
    pieces = _summed(sums, sums.count())
    processor = _processor(model)
    first = np.array([processor.id_to_piece(i)[:1] == "\u2581" for i in range(processor.get_piece_size())])
    classes = Classes.fit(pieces if len(pieces) else np.zeros(len(first)), float(ends), first)
    net = _train(gathered, classes, rounds, rate, batch, seed)
    release(gathered)
    words, often = _head(counts)
    below = np.log10(n + 0.5 * (v_words + 1)) if n else np.log10(0.5)
    shared = docs.sparkSession.sparkContext.broadcast((words, often, net.p, classes))
    schema = f"key {slim.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<bigint>"

    def run(batches):
        words, often, p, classes = shared.value
        cache, net, head = piece_cache(model), Network(p, classes), Head(words, np.log10(often + 0.5))
        end_known = int(ends > 0)
        end_base = np.log10(ends + 0.5) - below
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                cut = _cut(cache, data, offsets)
                number, m = cut.number, len(cut.number)
                doc = np.repeat(np.arange(m), number)
                value = head.values(cut.words)
                found = value > -np.inf
                known = np.bincount(doc, found, m).astype(np.int64) + end_known
                base = np.bincount(doc, np.where(found, value, 0.0), m) - number * below + end_base
                rare = ~found
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=m))]), pa.int32()), pa.array(cut.words[rare]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("held_out"), pa.array(number + 1), pa.array(known), pa.array(base), pa.array(score_pieces(net, cut.ids, cut.sizes)), lists],
                    names=["key", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )

    scored = stored(slim.select("key", "held_out", text_bytes().alias("text")).mapInArrow(tidied(run), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    # occurrences of rarer words meet their counts; words that no training text holds add log10(0.5)
    rare = scored.select("row", F.explode("rare").alias("word"))
    more = rare.join(counts, "word", "left").groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"))
    out = scored.drop("rare").join(more, "row", "left")
    return out.select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )


def score_pieces(net: Network, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probabilities of texts given as piece ids and their numbers."""
    made, valid, many = windows(ids, sizes)
    total = np.zeros(len(made))
    for a in range(0, len(made), CHUNK):
        part = made[a : a + CHUNK]
        h = np.concatenate([net.hidden(part[b : b + FEW, :WINDOW])[0] for b in range(0, len(part), FEW)])
        chance = net.log_chance(h, part[:, CONTEXT + 1 :].ravel()).reshape(-1, SCORED)
        chance *= np.arange(SCORED) < valid[a : a + CHUNK, None]
        total[a : a + CHUNK] = chance.sum(1, dtype=np.float64)
    return np.bincount(np.repeat(np.arange(len(sizes)), many), total, len(sizes)) / np.log(10)
