"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import blocks, quoted, remainder, text_bytes, tidied

#: Text is cut into stretches of so many bytes; the network reads each, and so many bytes beside it, from both ends and labels its positions.
STRETCH, MARGIN = 128, 16
#: At most so many texts are learnt from, each at so many places at most, and at most so many languages, the most frequent.
LEARNT, PLACES, LANGUAGES = 6000, 8, 500
UNKNOWN = "und"


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class ByteNetwork:
    """Arrays are feature by batch, so that all work on a step is on contiguous rows. p: the parameters."""

    languages: list[str]
    hidden: int
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int, seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        p = {}
        for side in ("f", "b"):
            p[f"x{side}"] = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
            p[f"u{side}"] = (rng.standard_normal((2 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
            p[f"c{side}"] = (rng.standard_normal((hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        p["o"] = (rng.standard_normal((len(languages), 2 * hidden)) * 0.3).astype(np.float32)
        p["ob"] = np.zeros((len(languages), 1), np.float32)
        return ByteNetwork(languages, hidden, p)

    def states(self, x: np.ndarray, side: str, trace: list | None = None, there: np.ndarray | None = None) -> np.ndarray:
        """The state after each of the bytes x (steps by batch), read in the order of the side: steps by hidden by batch.

        there: 1 where a byte is one of the text, 0 beyond its end, where states are zero. So a text's states don't depend on the others'.
        """
        h, steps, batch = self.hidden, *x.shape
        table = np.ascontiguousarray(self.p[f"x{side}"].T)
        out = np.zeros((steps, h, batch), np.float32)
        state = np.zeros((h, batch), np.float32)
        u, c = self.p[f"u{side}"], self.p[f"c{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            fed = np.take(table, x[t], axis=1)
            gates = fed[: 2 * h]
            gates += u @ state
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:h], gates[h:]
            reset = r * state
            new = fed[2 * h :]
            new += c @ reset
            np.tanh(new, out=new)
            if trace is not None:
                trace.append((t, state, z, r, new))
            new_state = out[t]
            np.subtract(state, new, out=new_state)
            new_state *= z
            new_state += new
            if there is not None:
                new_state *= there[t]
            state = new_state
        return out

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        h = self.hidden
        return self.p["o"][:, :h] @ forward + self.p["o"][:, h:] @ backward + self.p["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, each labelled with its text's language, and its gradients."""
        h, steps = self.hidden, len(x)
        traces = {"f": [], "b": []}
        s = {side: self.states(x, side, traces[side], mask) for side in "fb"}
        logit = np.stack([self.logits(s["f"][t], s["b"][t]) for t in range(steps)])
        logit -= logit.max(1, keepdims=True)
        chance = np.exp(logit)
        chance /= chance.sum(1, keepdims=True)
        total = mask.sum()
        loss = -(np.log(np.take_along_axis(chance, np.broadcast_to(y, (steps, len(y)))[:, None], 1)[:, 0] + 1e-9) * mask).sum() / total
        d = chance
        np.put_along_axis(d, np.broadcast_to(y, (steps, len(y)))[:, None], np.take_along_axis(d, np.broadcast_to(y, (steps, len(y)))[:, None], 1) - 1, 1)
        d *= (mask / total)[:, None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["ob"] = d.sum((0, 2))[:, None]
        for i, side in enumerate("fb"):
            g["o"][:, i * h : (i + 1) * h] = np.einsum("tcb,thb->ch", d, s[side])
            from_out = np.einsum("ch,tcb->thb", self.p["o"][:, i * h : (i + 1) * h], d)
            u, c = self.p[f"u{side}"], self.p[f"c{side}"]
            back = np.zeros_like(s[side][0])
            for t, state, z, r, new in reversed(traces[side]):
                ds = (back + from_out[t]) * mask[t]
                dn = ds * (1 - z) * (1 - new * new)
                dz = ds * (state - new) * z * (1 - z)
                dreset = c.T @ dn
                dr = dreset * state * r * (1 - r)
                dg = np.concatenate([dz, dr])
                g[f"c{side}"] += dn @ (r * state).T
                g[f"u{side}"] += dg @ state.T
                np.add.at(g[f"x{side}"], x[t], np.concatenate([dg, dn]).T)
                back = ds * z + dreset * r + u.T @ dg
        return float(loss), g

    def pooled(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lead: np.ndarray, trail: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Sums over positions of the probabilities of each language: texts by languages.

        What is read is given by start, length and text; its first `lead` and last `trail` positions don't count.
        """
        out = np.zeros((n, len(self.languages)))
        order = np.argsort(-lengths, kind="stable")
        k = len(self.languages)
        for a in range(0, len(order), 4096):
            these = order[a : a + 4096]
            steps = int(lengths[these[0]])
            at = starts[these] + np.arange(steps)[:, None]
            step = np.arange(steps)[:, None]
            x = data[np.minimum(at, len(data) - 1)]
            x[step >= lengths[these]] = 0
            inside = (step >= lead[these]) & (step < (lengths - trail)[these])
            there = None if lengths[these[-1]] == steps else (step < lengths[these]).astype(np.float32)
            forward, backward = self.states(x, "f", None, there), self.states(x, "b", None, there)
            total = np.zeros((k, len(these)), np.float32)
            for t in range(steps):
                e = self.logits(forward[t], backward[t])
                e -= e.max(0)
                np.exp(e, out=e)
                e *= inside[t] / e.sum(0)
                total += e
            for j in range(k):
                out[:, j] += np.bincount(of[these], total[j], n)
        return out


def stretches(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of up to STRETCH bytes, with up to MARGIN bytes of the text before and after: their starts and lengths with these, how many
    bytes come before and after, and the texts. All bytes are in one stretch."""
    sizes = np.diff(offsets)
    many = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(sizes)), many)
    k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    starts = offsets[:-1][of] + k * STRETCH
    ends = np.minimum(starts + STRETCH, offsets[1:][of])
    lead, trail = np.minimum(MARGIN, starts - offsets[:-1][of]), np.minimum(MARGIN, offsets[1:][of] - ends)
    return starts - lead, ends - starts + lead + trail, lead, trail, of


def fit_language(docs: DataFrame, hidden: int = 8, rounds: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 5, most: int = LEARNT) -> ByteNetwork | None:
    """Learn from (key, text, lang): from at most `most` texts, chosen by hash with equal parts of languages; from all of a text of up to PLACES
    stretches, from PLACES stretches spread over a longer one, each at a hash-chosen place of its part.

    Null languages and texts without bytes are left out, and languages beyond the LANGUAGES most frequent. None if nothing is left.
    """
    from pyspark.sql import Window

    some = docs.where("lang is not null and length(text) > 0")
    counts = {r[0]: r[1] for r in some.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(most, LANGUAGES)).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    size, bytes_ = F.octet_length("text"), text_bytes()
    many = F.least(F.lit(PLACES), F.ceil(size / STRETCH)).cast("int")
    jitter = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1000)) / 1000.0
    start = lambda i: (F.when(size <= PLACES * STRETCH, i * STRETCH).otherwise(F.floor((i + jitter) * (size - STRETCH) / PLACES)) + 1).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.substring(bytes_, start(i), F.lit(STRETCH)))
    # candidates by a threshold on a hash, known from counts, so that no sort of all rows is needed
    each = max(1, most // len(languages))
    chance = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.3 * each / n + 20 / n)))])
    share = (F.xxhash64(F.lit(seed + 1), "key") % 1_000_003 + 1_000_003) / 2_000_006.0
    picked = some.where(share < chance[F.col("lang")]).select("lang", cut.alias("pieces"), F.xxhash64(F.lit(seed + 2), "key").alias("by"))
    chosen = picked.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("by", "pieces"))).where(F.col("_n") <= each)
    rows = chosen.select("lang", "by", F.posexplode("pieces").alias("place", "piece")).orderBy("by", "place", "piece").collect()
    net = ByteNetwork.fresh(languages, hidden, seed)
    x = np.zeros((STRETCH, len(rows)), np.uint8)
    mask = np.zeros((STRETCH, len(rows)), np.float32)
    for i, r in enumerate(rows):
        piece = np.frombuffer(bytes(r["piece"]), np.uint8)
        x[: len(piece), i], mask[: len(piece), i] = piece, 1
    y = np.array([languages.index(r["lang"]) for r in rows])
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        i = rng.integers(0, len(rows), min(batch, 4 * len(rows)))
        a = int(rng.integers(0, STRETCH // 2)) if step % 2 else 0  # half the steps see short texts too
        part = slice(0, STRETCH // 2) if a else slice(0, STRETCH)
        _, g = net.gradients(x[part][:, i], mask[part][:, i], y[i])
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        now = rate * min(1.0, 3 * (1 - step / (rounds + 1)))
        for k, v in g.items():
            v *= min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def identify_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, hold: int = 1, **fit) -> DataFrame:
    """(key, held_out, lang_pred, score) of each row, learnt from non-null languages of rows whose crc32(key) modulo `folds` isn't `hold`.

    The text alone is the input of a prediction. The network labels every byte of the whole text; a text's score is the mean over its bytes of
    the probability of its best language. Null and empty texts, and those without a letter, are `und` with score 0, and so are all if there is
    nothing to learn from. Ties go to the language first by code point. Null keys count as empty ones; repeated rows are rows like others.
    """
    slim = docs.select(quoted(key).alias("key"), quoted(text).alias("text"), quoted(lang).alias("lang")).withColumn("held_out", remainder("key", folds) == hold)
    net = fit_language(slim.where(~F.col("held_out")), **fit)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    fed = slim.select(F.col("key").alias("key"), "held_out", letter.alias("letter"), text_bytes().alias("text"))
    schema = f"key {slim.schema['key'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def run(batches):
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                n = len(offsets) - 1
                ok = part.column("letter").to_numpy(zero_copy_only=False).astype(bool) & (net is not None)
                names, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if net is not None and len(data):
                    total = net.pooled(data, *stretches(offsets), n) / np.maximum(np.diff(offsets), 1)[:, None]
                    best = total.argmax(1)
                    names = np.where(ok, np.array(net.languages, object)[best], UNKNOWN)
                    score = np.where(ok, np.clip(total[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["key", "held_out", "lang_pred", "score"])

    return fed.mapInArrow(tidied(run), schema).withColumnRenamed("key", key)
