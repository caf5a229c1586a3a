"""SentencePiece segmentations sampled by forward filtering and backward sampling, and lossless decoding.

The lattice stands on UTF-8 bytes. Its edges are the pieces of a public vocabulary (a piece's lower one-eighth block stands for a space) and
one-byte fall-back pieces, so every text, also one that holds that block character or broken UTF-8, has a path and decodes to itself.
Where two bytes meet that stand side by side in no piece, every path has a node, and the forward sum may start anew. Each run between such
nodes is a small lattice; alike runs share one forward pass, and each occurrence draws its own path.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import _BYTE_KEYS, _power, map_arrow, mix, plain, rolling, substring_hash

#: Runs up to each of these lengths go through numpy together; longer ones one at a time, so many bytes at once.
WIDTHS = (4, 8, 12, 16, 24, 40, 64)
STRETCH = 1 << 16
#: Bytes of text at once, and bytes of different runs at once.
TEXTS, RUNS = 1_000_000, 40_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_UP = np.array([pow(_BASE, i, 2**64) for i in range(256)], np.uint64)
_DOWN = np.array([pow(pow(_BASE, -1, 2**64), i, 2**64) for i in range(256)], np.uint64)


def _hash(raw: bytes) -> int:
    x = np.frombuffer(raw, np.uint8)
    return int((_BYTE_KEYS[x] * _UP[: len(x)]).sum(dtype=np.uint64))


def run_keys(sums: np.ndarray, j: int, i: np.ndarray) -> np.ndarray:
    """The hashes of bytes i to j of many runs, from their prefix sums (places by runs)."""
    return (sums[j] - sums[i]) * _DOWN[i, None]


class Vocabulary:
    """Pieces as bytes, their log weights, and a hash table from a byte string's hash to its id."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces: list[bytes | None] = [None] * n
        self.weight = np.full(n, -np.inf)
        self.fallback = np.full(256, -1, np.int32)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte = int(re.fullmatch(r"<0x(..)>", piece)[1], 16)
                self.fallback[byte], self.pieces[i] = i, bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[i] = piece.replace("▁", " ").encode()
        if (self.fallback < 0).any():
            raise ValueError("the vocabulary lacks byte pieces")
        # a merge vocabulary ranks its pieces; the weight of a piece falls as a power of its rank, fall-back bytes are last
        usable = [i for i, p in enumerate(self.pieces) if p is not None and i not in set(self.fallback.tolist())]
        by_rank = sorted(usable, key=lambda i: (-model.get_score(i), i))
        for rank, i in enumerate(by_rank):
            self.weight[i] = -alpha * np.log(rank + 10)
        self.weight[self.fallback] = -alpha * 2 * np.log(n + 10)
        self.length = np.array([len(p) if p else 0 for p in self.pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(p or b"" for p in self.pieces), np.uint8)
        self.find = {self.pieces[i]: i for i in usable}
        self.longest = max(1, *map(len, self.find))
        if self.longest > len(_UP) - WIDTHS[-1]:
            raise ValueError("the vocabulary has pieces of very many bytes")
        # whether some piece holds the two bytes side by side
        self.joined = np.zeros((256, 256), bool)
        inner = np.ones(max(len(self.flat), 1), bool)
        inner[self.start[:-1][self.length > 0]] = False
        at = np.flatnonzero(inner[: len(self.flat)])
        self.joined[self.flat[at - 1], self.flat[at]] = True
        self.bits, keys = 20, np.array([_hash(p) for p in self.find], np.uint64)
        ids = np.array(list(self.find.values()), np.int32)
        self.key1, self.id1 = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        _, first = np.unique(self._slot(keys), return_index=True)
        self.key1[self._slot(keys[first])], self.id1[self._slot(keys[first])] = keys[first], ids[first]
        self.there = self.id1 >= 0
        rest = np.setdiff1d(np.arange(len(keys)), first)
        order = rest[np.argsort(keys[rest])]
        self.key2, self.id2 = keys[order], ids[order]  # those whose slot was taken

    def _slot(self, keys):
        return (keys * _U(0xD6E8FEB86659FD93) >> _U(64 - self.bits)).astype(np.int64)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where no piece has it."""
        slot = self._slot(keys)
        found = np.full(len(keys), -1, np.int32)
        hit = np.flatnonzero(self.there[slot])  # a byte for each place stays in the cache; few substrings are pieces
        slot, keys = slot[hit], keys[hit]
        ids = np.where(self.key1[slot] == keys, self.id1[slot], np.int32(-1))
        if len(self.key2):
            miss = np.flatnonzero(ids < 0)
            at = np.minimum(np.searchsorted(self.key2, keys[miss]), len(self.key2) - 1)
            ids[miss] = np.where(self.key2[at] == keys[miss], self.id2[at], np.int32(-1))
        found[hit] = ids
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    return Vocabulary(path, alpha)


def _forward(v: Vocabulary, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs (rows of bytes, padded): at each end position, the cumulative probability and the id of the last piece by its length."""
    m, n = rows.shape
    k = min(n, v.longest)
    sums = np.zeros((n + 1, m), np.uint64)
    np.cumsum(_BYTE_KEYS[rows.T] * _UP[:n, None], axis=0, out=sums[1:])
    total = np.zeros((n + 1, m))
    cumulative = np.zeros((n + 1, k, m), np.float32)
    ids = np.full((n + 1, k, m), -1, np.int32)
    weight = np.append(v.weight, -np.inf)
    for j in range(1, n + 1):
        most = min(j, k)
        i = j - 1 - np.arange(most)
        keys = run_keys(sums, j, i)
        found = v.ids(keys.ravel()).reshape(most, m)
        one = found[0] < 0
        found[0, one] = v.fallback[rows[one, j - 1]]
        score = total[i] + weight[found]
        top = score.max(0)
        chance = np.exp(score - top)
        run = np.cumsum(chance, axis=0)
        total[j] = top + np.log(run[-1])
        cumulative[j, :most] = run / run[-1]
        cumulative[j, most - 1 :] = 2.0
        ids[j, :most] = found
    return cumulative, ids


def _uniform(seed: np.ndarray, position: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each (row seed, byte position)."""
    return (mix(seed ^ mix(position.astype(np.uint64) + _U(0x632BE59BD9B4E019))) >> _U(40)).astype(np.float64) / 2**24


def _ending(v: Vocabulary, run: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, length, id) of all pieces that end in (a, b] of a run, by end and length; fall-back pieces where no other piece of a byte is."""
    low = max(0, a - v.longest)
    sums, down = rolling(run[low:b]), _power("down", b - low)
    found = []
    for n in range(1, v.longest + 1):
        end = np.arange(max(a + 1, n), b + 1)
        ids = v.ids((sums[end - low] - sums[end - low - n]) * down[end - low - n])
        if n == 1:
            ids = np.where(ids < 0, v.fallback[run[end - 1]], ids)
        some = ids >= 0
        found.append((end[some], np.full(int(some.sum()), n), ids[some]))
    end, length, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end, kind="stable")
    return end[order], length[order], ids[order]


def _long_run(v: Vocabulary, run: np.ndarray, seed: int, offset: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(starts, ids) of one sampled path over a run of any length, by stretches from its end; kept are the forward sums alone."""
    n = len(run)
    total = array("d", [0.0]) * (n + 1)
    exp, log = math.exp, math.log
    for a in range(0, n, STRETCH):
        end, length, ids = _ending(v, run, a, min(a + STRETCH, n))
        heads = np.flatnonzero(np.diff(end, prepend=-1)).tolist() + [len(end)]
        length, weight = length.tolist(), v.weight[ids].tolist()
        for j, (x, y) in enumerate(zip(heads[:-1], heads[1:], strict=True), a + 1):
            if y == x + 1:
                total[j] = total[j - length[x]] + weight[x]
            else:
                scores = [total[j - length[k]] + weight[k] for k in range(x, y)]
                top = max(scores)
                total[j] = top + log(sum([exp(s - top) for s in scores]))
    path, j = [], n
    for a in range((n - 1) // STRETCH * STRETCH, -1, -STRETCH):
        b = min(a + STRETCH, n)
        end, length, ids = _ending(v, run, a, b)
        heads = np.flatnonzero(np.diff(end, prepend=-1)).tolist() + [len(end)]
        length, weight, ids = length.tolist(), v.weight[ids].tolist(), ids.tolist()
        draws = _uniform(np.full(b - a, seed, np.uint64), offset + np.arange(a + 1, b + 1)).tolist()
        starts, chosen = [], []
        while j > a:
            x, y = heads[j - a - 1], heads[j - a]
            left = draws[j - a - 1]
            k = x
            while k < y - 1:
                left -= exp(total[j - length[k]] + weight[k] - total[j])
                if left < 0:
                    break
                k += 1
            j -= length[k]
            starts.append(j)
            chosen.append(ids[k])
        path.append((np.array(starts), np.array(chosen, np.int32)))
    return path


def sample_pieces(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a block of texts, in order, and how many each text has; each text's draws depend on its seed and bytes alone."""
    size = len(data)
    out = np.full(size, -1, np.int32)
    if size:
        head = np.ones(size, bool)
        head[1:] = ~v.joined[data[:-1], data[1:]]
        head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.append(starts, size))
        doc = np.searchsorted(offsets, starts, "right") - 1
        hashes = substring_hash(rolling(data), starts, starts + lengths)
        low = 0
        for width in WIDTHS:
            these = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if not len(these):
                continue
            these = these[np.argsort(hashes[these], kind="stable")]
            h = hashes[these]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            firsts = np.append(np.flatnonzero(new), len(h))
            for a in range(0, len(firsts) - 1, RUNS // width):
                b = min(a + RUNS // width, len(firsts) - 1)
                unique, own = these[firsts[a:b]], these[firsts[a] : firsts[b]]
                at = np.minimum(starts[unique][:, None] + np.arange(width), size - 1)
                cumulative, ids = _forward(v, data[at])
                k, m = cumulative.shape[1:]
                which = np.cumsum(new[firsts[a] : firsts[b]]) - 1
                end = lengths[own].copy()
                start, seed = starts[own], seeds[doc[own]]
                base = start - offsets[doc[own]]
                flat_c, flat_i = cumulative.transpose(0, 2, 1).reshape(-1, k), ids.transpose(0, 2, 1).reshape(-1, k)
                while len(end):
                    row = end * m + which
                    t = (flat_c[row] <= _uniform(seed, base + end)[:, None]).sum(1)
                    piece = flat_i[row, t]
                    end = end - 1 - t
                    out[start + end] = piece
                    more = end > 0
                    end, which, start, seed, base = end[more], which[more], start[more], seed[more], base[more]
        for r in np.flatnonzero(lengths > WIDTHS[-1]):
            a = int(starts[r])
            for begin, ids in _long_run(v, data[a : a + lengths[r]], int(seeds[doc[r]]), a - int(offsets[doc[r]])):
                out[a + begin] = ids
    places = np.flatnonzero(out >= 0)
    return out[places], np.diff(np.searchsorted(places, offsets))


def decode_pieces(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes that the pieces stand for."""
    lengths = v.length[ids]
    ends = np.cumsum(lengths)
    at = np.repeat(v.start[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return v.flat[at]


def encode_sampled(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", alpha: float = 1.0, seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all) with ids array<int>, n_pieces and lossless (whether the pieces decode to the text's very bytes).

    alpha sharpens the weights (0: all paths alike; large: the best path). Draws depend on the seed, the row's key as text and the
    position: reruns, other partitions and other batches give the same pieces, repeated rows too. Null texts count as empty; empty texts
    have no pieces and are lossless. A null key counts as an empty one.
    `model` is the vocabulary file's path, which each worker opens. An empty table gives no rows. Other columns stay as they are, whatever
    their names and types; those named like the new ones are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_pieces", "lossless")]
    rows, (key, text, *places) = plain(docs, key, text, *kept)
    fed = rows.select(*places, F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("__seed"), F.col(text).alias("__text"))
    return _encode(fed, model, alpha).toDF(*kept, "ids", "n_pieces", "lossless")


def _encode(fed: DataFrame, model: str, alpha: float) -> DataFrame:
    from pyspark.sql.types import StructType

    from rillframe.llm.common import blocks, text_bytes

    keep = [c for c in fed.columns if c not in ("__seed", "__text")]
    schema = StructType([fed.schema[c] for c in keep] + list(StructType.fromDDL("ids array<int>, n_pieces int, lossless boolean")))
    fed = fed.withColumn("__text", text_bytes("__text"))

    def run(batches):
        v = vocabulary(model, alpha)
        for batch in batches:
            for rows, data, offsets in blocks(batch, "__text", TEXTS):
                part = batch.slice(rows.start, rows.stop - rows.start)
                seeds = part.column("__seed").to_numpy(zero_copy_only=False).astype(np.uint64)
                ids, counts = sample_pieces(v, data, offsets, seeds)
                back = decode_pieces(v, ids)
                ends = np.concatenate([[0], np.cumsum(counts)])
                if len(back) == len(data):
                    wrong = np.concatenate([[0], np.cumsum(back != data)])
                    size_ok = np.diff(np.concatenate([[0], np.cumsum(v.length[ids])])[ends]) == np.diff(offsets)
                    fine = (np.diff(wrong[offsets]) == 0) & size_ok
                else:
                    fine = np.array([decode_pieces(v, ids[a:b]).tobytes() == data[c:d].tobytes() for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [lists, pa.array(counts, pa.int32()), pa.array(fine, pa.bool_())], names=[*keep, "ids", "n_pieces", "lossless"])

    return map_arrow(fed, run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that each list of pieces stands for: null for a null list, empty for an empty one.

    Rows are independent; repeated rows decode alike, and an empty table gives no rows. Other columns stay as they are, whatever their names
    and types; one named `out` is replaced.
    """
    from pyspark.sql.types import StructType

    names = [c for c in df.columns if c != out]
    df, (ids, *keep) = plain(df, ids, *names)
    fed = [*keep, ids] if ids not in keep else keep
    schema = StructType([df.schema[c] for c in keep]).add("__decoded", "binary")

    def run(batches):
        v = vocabulary(model, 1.0)
        for b in batches:
            found = [None if x is None else decode_pieces(v, np.array(x, np.int64)).tobytes() for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(found, pa.binary())], names=[*keep, "__decoded"])

    return map_arrow(df.select(*fed), run, schema).withColumn("__decoded", F.col("__decoded").cast("string")).toDF(*names, out)
