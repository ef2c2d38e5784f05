"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word is a run of letters and digits, lower-cased; a longer one than PIECE bytes is several. Its inputs are the sum of
learnt vectors, of the word and of its BEGINNINGS in bytes, each if at least KNOWN training texts hold it, and what its
characters tell a bidirectional recurrent network. A second bidirectional network reads windows of WINDOW words, one every half window, so that every word but those at the ends lies
in two; attention pools each window, and a text is as toxic as its worst window. Table, character and word networks and
attention are learnt together, by gradients of the loss.

The network is fitted on at most TOXIC and OTHER labelled texts, in the order of a hash of doc_id, of those whose
crc32(doc_id) modulo 4 is not 2, none longer than LONGEST characters; that bounds the one task that fits it and what is
shipped to the others. A label is of a whole text, so a round learns from the window of each text that the round before
scored highest (the first one from that with the word most typical of toxic texts), and from further ones of texts that
aren't toxic. One text in CALIBRATION is kept out of the network's training and sets the level of the scores. Scoring is
one pass over all texts without a shuffle.

Defined cases: null and empty texts, and those without words, get the score of no evidence; a null doc_id stays null
and is not held out; repeated rows are scored alike; of conflicting labels of a doc_id the toxic one counts; without
labels of both kinds every score is 0; of texts that share a labelled doc_id the least is learnt from; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlight.llm.common import joined, pieces, table, tidy, utf8, word_hashes, word_spans

TOXIC, OTHER, LONGEST = 1200, 2800, 100_000
WINDOW, STRIDE, PIECE = 32, 16, 24
CALIBRATION, PRIOR = 5, 4.0
BEGINNINGS = (6, 8)
KNOWN, VECTOR, CHAR, HIDDEN, POOL = 3, 8, 8, 8, 8
EPOCHS, STEPS, BATCH, RATE, TABLE_RATE, DECAY, FORGOTTEN = 8, 80, 192, 0.012, 0.03, 0.01, 0.25
THRESHOLD = 0.3
CHUNK, RUN = 1 << 21, 4096
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


@dataclass
class Words:
    """Words of some texts: the distinct ones by hash, with the bytes of each; number of each word; where texts begin."""

    hashes: np.ndarray  # (distinct, 3): of the distinct words and of their beginnings, 0 where a word isn't longer
    chars: np.ndarray  # (distinct, PIECE), 0 where there is none
    lengths: np.ndarray
    number: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        buf, starts = joined([t.decode("utf-8", "replace").lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts])
        b, e = word_spans(buf)
        parts = -(-(e - b) // PIECE)
        if len(b) and parts.max() > 1:
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            b, e = np.repeat(b, parts) + within * PIECE, np.repeat(e, parts)
            e = np.minimum(e, b + PIECE)
        h = word_hashes(buf, b, e)
        distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
        fb, fe = b[first], e[first]
        chars = np.zeros((len(fb), PIECE), np.uint8)
        for i in range(PIECE):
            own = np.flatnonzero(fb + i < fe)
            chars[own, i] = buf[fb[own] + i]
        heads = [np.where(fe - fb > n, word_hashes(buf, fb, np.minimum(fb + n, fe)) ^ np.uint64(n), 0).astype(np.uint64) for n in BEGINNINGS]
        return cls(np.stack([distinct, *heads], 1), chars, (fe - fb).astype(np.int64), number, np.searchsorted(b, starts))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of every window, -1 where there are none, and the text of each window; one at least for each text."""
        n = np.diff(self.at)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        place = start[:, None] + np.arange(WINDOW)
        inside = place < n[text][:, None]
        number = self.number if len(self.number) else np.zeros(1, np.int64)
        return np.where(inside, number[np.minimum(self.at[text][:, None] + place, len(number) - 1)], -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (time, row, hidden) for input projections x (time, row, 3 * hidden); masked steps carry the state on."""
    t, n, width = x.shape
    k = width // 3
    h = np.zeros((n, k), np.float32)
    states, past = np.empty((t, n, k), np.float32), []
    for i in range(t):
        a = h @ u
        zr = _sigmoid(x[i, :, : 2 * k] + a[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(x[i, :, 2 * k :] + r * a[:, 2 * k :])
        m = mask[i][:, None]
        new = np.where(m, c + z * (h - c), h)
        if keep:
            past.append((h, a, z, r, c, m))
        states[i] = h = new
    return states, past


def gru_back(grad: np.ndarray, past: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input projections and of u, from those of the states."""
    t, n, k = grad.shape
    dx, du, dh = np.zeros((t, n, 3 * k), np.float32), np.zeros_like(u), np.zeros((n, k), np.float32)
    for i in range(t - 1, -1, -1):
        h, a, z, r, c, m = past[i]
        dh = dh + grad[i]
        own = dh * m
        dz, dc = own * (h - c) * z * (1 - z), own * (1 - z) * (1 - c * c)
        dr = dc * a[:, 2 * k :] * r * (1 - r)
        dx[i] = np.concatenate([dz, dr, dc], 1)
        da = np.concatenate([dz, dr, dc * r], 1)
        du += h.T @ da
        dh = dh * ~m + own * z + da @ u.T
    return dx, du


class Network:
    """Parameters, the score of windows and its gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=None: (rng.normal(size=s) * (scale or 1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {"out": draw(2 * HIDDEN, 1), "bias": np.array([-2.0], np.float32), "att": draw(2 * HIDDEN, POOL), "query": draw(POOL, 1), "table": np.zeros((1, VECTOR), np.float32)}
        self.known = np.zeros(0, np.uint64)
        for way in ("f", "b"):
            self.p |= {f"c{way}w": draw(256, 3 * CHAR, scale=0.3), f"c{way}u": draw(CHAR, 3 * CHAR), f"w{way}w": draw(VECTOR + 2 * CHAR, 3 * HIDDEN), f"w{way}v": np.zeros(3 * HIDDEN, np.float32), f"w{way}u": draw(HIDDEN, 3 * HIDDEN)}

    def words(self, chars: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """What the characters of each word tell: the last states of both directions."""
        most = int(lengths.max()) if len(lengths) else 1
        step = np.arange(most)
        turned = np.take_along_axis(chars[:, :most], np.maximum(lengths[:, None] - 1 - step, 0), 1) if len(chars) else chars[:, :most]
        mask = (step < lengths[:, None]).T
        out, past = [], []
        for way, own in (("f", chars[:, :most]), ("b", turned)):
            states, kept = gru(self.p[f"c{way}w"][own.T], mask, self.p[f"c{way}u"], keep)
            out.append(states[-1])
            past.append((own, kept))
        return np.concatenate(out, 1), past

    def learn_words(self, hashes: np.ndarray) -> None:
        """Words and beginnings that get vectors of their own; row 0 of the table, which stays zero, stands for all others."""
        self.known = np.unique(hashes)
        self.p["table"] = np.zeros((1 + len(self.known), VECTOR), np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Their rows in the table."""
        if not len(self.known):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def vectors(self, w: Words) -> np.ndarray:
        """Inputs of each distinct word; words of like length are worked through together."""
        chars = np.zeros((len(w.lengths), 2 * CHAR), np.float32)
        order = np.argsort(w.lengths, kind="stable")
        for k in range(0, len(order), 2 * RUN):
            own = order[k : k + 2 * RUN]
            chars[own] = self.words(w.chars[own], w.lengths[own])[0]
        return np.concatenate([self.p["table"][self.rows(w.hashes)].sum(1), chars], 1)

    def pooled(self, hf: np.ndarray, hb: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        h = np.concatenate([hf, hb], 2)
        a = np.tanh(h @ self.p["att"])
        s = np.where(mask, (a @ self.p["query"])[:, :, 0], -1e9)
        w = np.exp(s - s.max(0)) * mask
        w /= np.maximum(w.sum(0), 1e-9)
        pool = (h * w[:, :, None]).sum(0)
        return h, a, w, pool, (pool @ self.p["out"])[:, 0] + self.p["bias"][0]

    def score(self, vectors: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Log odds of each window."""
        project = [vectors @ self.p[f"w{way}w"] + self.p[f"w{way}v"] for way in "fb"]
        project = [np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]) for x in project]
        out = np.empty(len(windows), np.float32)
        for k in range(0, len(windows), RUN):
            own = windows[k : k + RUN].T
            mask = own >= 0
            hf, _ = gru(project[0][own], mask, self.p["wfu"])
            hb, _ = gru(project[1][own[::-1]], mask[::-1], self.p["wbu"])
            out[k : k + RUN] = self.pooled(hf, hb[::-1], mask)[-1]
        return out

    def gradients(self, rows: np.ndarray, chars: np.ndarray, lengths: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss of windows over these words; rows: of the table, for each word; known: 0 for those left out, else 1. That of the table is one row for each of rows."""
        p, g = self.p, {}
        own = windows.T
        mask = own >= 0
        char, past = self.words(chars, lengths, True)
        word = np.concatenate([(p["table"][rows] * known[:, :, None]).sum(1), char], 1)
        x = word[own]
        hf, kept_f = gru(x @ p["wfw"] + p["wfv"], mask, p["wfu"], True)
        hb, kept_b = gru((x @ p["wbw"] + p["wbv"])[::-1], mask[::-1], p["wbu"], True)
        h, a, w, pool, logit = self.pooled(hf, hb[::-1], mask)
        d = (weight * (_sigmoid(logit) - y)).astype(np.float32)
        g["out"], g["bias"] = pool.T @ d[:, None], np.array([d.sum()], np.float32)
        dpool = d[:, None] * p["out"][:, 0]
        dw = (h * dpool).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        da = ds[:, :, None] * p["query"][:, 0] * (1 - a * a)
        g["query"] = np.einsum("tnp,tn->p", a, ds)[:, None].astype(np.float32)
        g["att"] = np.einsum("tnh,tnp->hp", h, da).astype(np.float32)
        dh = w[:, :, None] * dpool + da @ p["att"].T
        dx = np.zeros_like(x)
        for way, part, kept in (("f", dh[:, :, :HIDDEN], kept_f), ("b", dh[::-1, :, HIDDEN:], kept_b)):
            dp, g[f"w{way}u"] = gru_back(part, kept, p[f"w{way}u"])
            dp = dp if way == "f" else dp[::-1]
            dp = dp * mask[:, :, None]
            g[f"w{way}w"], g[f"w{way}v"] = np.einsum("tni,tnj->ij", x, dp).astype(np.float32), dp.sum((0, 1))
            dx += dp @ p[f"w{way}w"].T
        order = np.argsort(own[mask], kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(own[mask][order]) > 0])
        dword = np.zeros_like(word)
        dword[own[mask][order][heads]] = np.add.reduceat(dx[mask][order], heads, axis=0)
        g["table"], dchar = dword[:, None, :VECTOR] * known[:, :, None], dword[:, VECTOR:]
        for way, (ids, kept), part in (("f", past[0], dchar[:, :CHAR]), ("b", past[1], dchar[:, CHAR:])):
            grad = np.zeros((len(kept), *part.shape), np.float32)
            grad[-1] = part
            dp, g[f"c{way}u"] = gru_back(grad, kept, p[f"c{way}u"])
            table_ = np.zeros_like(p[f"c{way}w"])
            np.add.at(table_, ids.T.ravel(), dp.reshape(-1, dp.shape[2]))
            g[f"c{way}w"] = table_
        return g


@dataclass
class Model:
    network: Network
    scale: tuple[float, float]

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: its worst window's."""
        out = np.zeros(len(texts))
        for b, e in pieces(texts, CHUNK):
            w = Words.of(texts[b:e])
            windows, text = w.windows()
            score = self.network.score(self.network.vectors(w), windows)
            out[b:e] = np.maximum.reduceat(score, np.flatnonzero(np.r_[True, text[1:] != text[:-1]]))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.log_odds(texts) + self.scale[1]) if texts else np.zeros(0)


def suspicion(number: np.ndarray, doc: np.ndarray, n: int, y: np.ndarray) -> np.ndarray:
    """Of each of n words, how much likelier a text that holds it is to be toxic: only to choose the windows of the first round."""
    if not n:
        return np.zeros(0)
    pair = np.unique(doc * n + number)
    toxic, total = np.bincount(pair % n, y[pair // n], n), np.bincount(pair % n, minlength=n)
    q = (toxic + PRIOR * y.mean()) / (total + PRIOR)
    return np.log(q / (1 - q))


def fit(texts: list[bytes], y: np.ndarray, rate: float | None = None) -> Model | None:
    """Fits on texts with labels y (0 or 1), in EPOCHS rounds or as many as give STEPS steps. rate: the share of toxic ones among all, if the sample's is another. None without both labels."""
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(5)
    w = Words.of(texts)
    share = float(y.mean())
    spared = np.zeros(len(y), bool)  # of each label one in CALIBRATION, unless that leaves none
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        spared[own[: len(own) // CALIBRATION]] = True
    doc = np.repeat(np.arange(len(y)), np.diff(w.at))
    net = Network()
    kept, often = ~spared[doc], []
    for column in w.hashes.T:
        ids, inverse = np.unique(column, return_inverse=True)
        pair = np.unique(doc[kept] * max(1, len(ids)) + inverse[w.number[kept]]) if len(ids) else np.zeros(0, np.int64)
        held = np.bincount(pair % max(1, len(ids)), minlength=len(ids))
        often.append(ids[(held >= KNOWN) & (ids != 0)])
    net.learn_words(np.concatenate(often))
    table_rows = net.rows(w.hashes)
    windows, text = w.windows()
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    last = np.r_[first[1:], len(text)]
    typical = np.full(len(w.lengths) + 1, -9.0)
    for column in w.hashes.T:
        ids, inverse = np.unique(column, return_inverse=True)
        own = suspicion(inverse[w.number[kept]], doc[kept], len(ids), y)[inverse]
        typical[:-1] = np.maximum(typical[:-1], np.where(column != 0, own, -9.0))
    hint = np.concatenate([typical[windows[k : k + 8192]].max(1) for k in range(0, len(text), 8192)]) + rng.random(len(text)) * 1e-3
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, epochs = 0, max(EPOCHS, -(-STEPS * BATCH // (2 * len(y))))
    for epoch in range(epochs):
        top = np.array([b + int(hint[b:e].argmax()) for b, e, s in zip(first, last, spared) if not s])
        more = np.array([int(rng.integers(b, e)) for b, e, t, s in zip(first, last, y, spared) if not t and not s], np.int64)
        rows = rng.permutation(np.r_[top, more])
        slower = 0.3 if epoch == epochs - 1 else 1
        for k in range(0, len(rows), BATCH):
            own = rows[k : k + BATCH]
            ids, inverse = np.unique(windows[own], return_inverse=True)
            inverse = inverse.reshape(windows[own].shape)
            if ids[0] < 0:
                ids, inverse = ids[1:], inverse - 1
            if not len(ids):
                continue
            r = table_rows[ids]
            known = ((rng.random(r.shape) >= FORGOTTEN) & (r > 0)).astype(np.float32)  # some are left out, so that characters are learnt too
            g = net.gradients(r, w.chars[ids], w.lengths[ids], inverse, y[text[own]], np.full(len(own), 1 / len(own)), known)
            grad = DECAY * net.p["table"] / len(own)
            np.add.at(grad, r, g["table"])
            g["table"] = grad
            step += 1
            for name, v in net.p.items():
                m1, m2 = moments[name]
                m1 += 0.1 * (g[name] - m1)
                m2 += 0.01 * (g[name] ** 2 - m2)
                v -= (TABLE_RATE if name == "table" else RATE) * slower * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + (1e-4 if name == "table" else 1e-6))
        if (epoch + 1) % (epochs // EPOCHS) and epoch + 1 < epochs:
            continue
        hint = net.score(net.vectors(w), windows)
    judges = spared if len(set(y[spared])) == 2 else np.ones(len(y), bool)
    top, y = np.maximum.reduceat(hint, first)[judges], y[judges]
    aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))  # not quite 1 and 0, as few texts judge
    rate, share = share if rate is None else rate, float(y.mean())
    weight = np.where(y == 1, rate / share, (1 - rate) / (1 - share))
    x, ridge = np.stack([top, np.ones(len(top))], 1), np.array([1e-3, 1e-3])
    at, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - aim * z)).sum() + (ridge * (v - start) ** 2).sum() / 2)

    for _ in range(50):  # Newton steps of a logistic fit, which sets the level of the scores; halved while they don't help
        p = _sigmoid(x @ at)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - aim)) + ridge * (at - start))
        while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
            step /= 2
        at = at - step
    a, b = at
    return Model(net, (float(a), float(b)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model fitted on a bounded sample of the labelled texts that aren't held out."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    sample = None
    for kind, most in ((1, TOXIC), (0, OTHER)):
        part = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.unionByName(part)
    # at most TOXIC + OTHER rows of two numbers, so this side may be broadcast
    rows = docs.select("doc_id", "text").where(F.length("text") <= LONGEST).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rate = counts[1] / (counts[0] + counts[1])

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        model = fit([utf8(r[1]) for r in own], np.array([r[2] for r in own], np.float64), rate)
        parts = model and (model.network.p, model.network.known, model.scale)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(parts)], pa.binary())], names=["model"])

    # one task fits, on the bounded sample, so that the driver holds no more than the model
    row = rows.select("doc_id", "text", F.col("toxic").cast("int")).coalesce(1).mapInArrow(tidy(fitting), "model binary").first()
    parts = pickle.loads(row[0]) if row else None
    if not parts:
        return None
    network = Network()
    network.p, network.known = parts[:2]
    return Model(network, parts[2])


def _scoring(model: Model | None) -> Callable[[list[str | None]], np.ndarray]:
    return lambda texts: model.scores([utf8(t) for t in texts]) if model else np.zeros(len(texts))


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = _scoring(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score(batch.column(2).to_pylist()).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def not_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below THRESHOLD."""
    score, at = _scoring(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))
