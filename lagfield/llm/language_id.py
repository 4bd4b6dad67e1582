"""Language of documents by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by back-propagation through time on a bounded sample of labelled windows; every byte of
a text is then labelled, and the probabilities of its letters are pooled to those of the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import hash60
from lagfield.llm.shingles import as_bytes

UNKNOWN = "und"
HIDDEN = 8
TRAIN_WINDOW = 64
WINDOW = 128
LANGUAGE_DOCS = 200
LEAST_DOCS = 20
DOC_WINDOWS = 4
#: Labels up to which each has its full sample and windows go in whole blocks; more share the same room.
SHARED_LABELS = 64
BLOCK = 4096

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def held_out(doc_id):
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Gru:
    """A gated recurrent layer over bytes: a byte selects a row of ``w`` (input to gates z, r and candidate n).

    Gates and candidate are piecewise linear (0.5 + 0.25 x within 0 to 1, x within -1 to 1), which costs a fraction of
    the smooth ones and learns as well here.
    """

    def __init__(self, rng, hidden):
        self.h = hidden
        self.w = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, 0.4, (hidden, 3 * hidden)).astype(np.float32)

    def _scaled(self):
        """Weights with the slope and the middle of the gates worked in."""
        k = 2 * self.h
        w, u = self.w.copy(), self.u.copy()
        w[:, :k] = 0.25 * w[:, :k] + 0.5
        u[:, :k] *= 0.25
        return w, u

    def run(self, x, keep=False):
        """States after each step; ``x``: bytes (steps, windows)."""
        steps, n = x.shape
        k, (w, u) = self.h, self._scaled()
        h = np.zeros((n, k), np.float32)
        out, memory = np.empty((steps, n, k), np.float32), []
        a, m = np.empty((n, 3 * k), np.float32), np.empty((n, 3 * k), np.float32)
        gate, c = np.empty((n, 2 * k), np.float32), np.empty((n, k), np.float32)
        for t in range(steps):
            np.take(w, x[t], 0, a, mode="clip")
            np.matmul(h, u, out=m)
            np.add(a[:, : 2 * k], m[:, : 2 * k], out=gate)
            np.clip(gate, 0, 1, out=gate)
            np.multiply(gate[:, k:], m[:, 2 * k :], out=c)
            c += a[:, 2 * k :]
            np.clip(c, -1, 1, out=c)
            if keep:
                memory.append((h, m[:, 2 * k :].copy(), gate[:, :k].copy(), gate[:, k:].copy(), c.copy()))
            new = out[t]
            np.subtract(h, c, out=new)
            new *= gate[:, :k]
            new += c
            h = new
        return (out, memory) if keep else out

    def back(self, x, memory, d_out):
        """Gradients of ``w`` and ``u`` from those of the states."""
        dw, du, k = np.zeros_like(self.w), np.zeros_like(self.u), self.h
        dh = np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            before, mn, z, r, c = memory[t]
            dh = dh + d_out[t]
            dc = dh * (1 - z) * (np.abs(c) < 1)
            dz = dh * (before - c) * ((z > 0) & (z < 1)) * np.float32(0.25)
            dr = dc * mn * ((r > 0) & (r < 1)) * np.float32(0.25)
            da = np.concatenate([dz, dr, dc], 1)
            dm = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(dw, x[t], da)
            du += before.T @ dm
            dh = dh * z + dm @ self.u.T
        return dw, du


class ByteTagger:
    """Forward and backward layer, and a softmax over languages at every byte."""

    def __init__(self, languages, hidden=HIDDEN, seed=11):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.ahead, self.behind = Gru(rng, hidden), Gru(rng, hidden)
        self.v = rng.normal(0, 0.3, (2 * hidden, len(self.languages))).astype(np.float32)
        self.c = np.zeros(len(self.languages), np.float32)

    def fit(self, x, y, epochs=10, batch=256, rate=0.02, seed=5):
        """``x``: windows of bytes (windows, steps), ``y``: their languages.  Adam on the cross entropy at every letter."""
        rng = np.random.default_rng(seed)
        params = [self.ahead.w, self.ahead.u, self.behind.w, self.behind.u, self.v, self.c]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                step += 1
                grads = self._gradients(np.ascontiguousarray(x[rows].T), y[rows])
                for p, g, m, s in zip(params, grads, first, second, strict=True):
                    np.clip(g, -1, 1, out=g)
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x, y):
        f, fm = self.ahead.run(x, keep=True)
        b, bm = self.behind.run(x[::-1], keep=True)
        h = np.concatenate([f, b[::-1]], 2)
        p = self._softmax(h @ self.v + self.c)
        counted = _LETTER[x].astype(np.float32)[:, :, None]
        p[:, np.arange(len(y)), y] -= 1
        d = p * counted / max(1.0, float(counted.sum()))
        dv = np.tensordot(h, d, ((0, 1), (0, 1)))
        dh = d @ self.v.T
        k = self.ahead.h
        return [
            *self.ahead.back(x, fm, dh[:, :, :k]),
            *self.behind.back(x[::-1], bm, dh[::-1, :, k:]),
            dv,
            d.sum((0, 1)),
        ]

    @staticmethod
    def _softmax(a):
        a = np.exp(a - a.max(-1, keepdims=True))
        return a / a.sum(-1, keepdims=True)

    def pooled(self, data, offsets):
        """Mean probabilities of the letters of each text, and their number; texts as bytes with offsets."""
        lengths = np.diff(offsets)
        windows = -(-lengths // WINDOW)
        text = np.repeat(np.arange(len(lengths)), windows)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW + offsets[:-1][text]
        stop = np.minimum(start + WINDOW, offsets[1:][text])
        sums, letters = np.zeros((len(lengths), len(self.languages))), np.zeros(len(lengths))
        padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
        k = self.ahead.h
        block = max(1, BLOCK * SHARED_LABELS // max(SHARED_LABELS, len(self.languages)))
        for i in range(0, len(text), block):
            rows = slice(i, i + block)
            at = start[rows][None, :] + np.arange(WINDOW)[:, None]
            x = np.where(at < stop[rows][None, :], padded[at], 0).astype(np.uint8)
            a = self.ahead.run(x) @ self.v[:k]
            a += self.behind.run(x[::-1])[::-1] @ self.v[k:]
            a += self.c
            np.exp(np.clip(a, -30, 30, out=a), out=a)
            counted = _LETTER[x]
            a *= (counted / a.sum(2))[:, :, None]
            got = a.sum(0)
            for j in range(got.shape[1]):
                sums[:, j] += np.bincount(text[rows], got[:, j], len(lengths))
            letters += np.bincount(text[rows], counted.sum(0), len(lengths))
        return sums / np.maximum(letters, 1)[:, None], letters


def _windows(batches):
    """A few windows of each text, at places spread over it."""
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        out = {"lang": [], "hash": [], "window": []}
        langs, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for i, (lang, h) in enumerate(zip(langs, hashes, strict=True)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            n = max(1, min(DOC_WINDOWS, (b - a) // TRAIN_WINDOW))
            for k in range(n):
                at = a + (b - a) * k // n
                out["lang"].append(lang)
                out["hash"].append(h)
                out["window"].append(data[at : min(b, at + TRAIN_WINDOW)].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["lang"], pa.string()), pa.array(out["hash"], pa.int64()), pa.array(out["window"], pa.binary())],
            names=list(out),
        )


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    language_docs: int = LANGUAGE_DOCS,
) -> ByteTagger | None:
    """Fit on at most ``2 * language_docs`` documents of every label, taken by hash.

    Where there are more than ``SHARED_LABELS`` labels they share the sample of so many, but none has less than
    ``LEAST_DOCS`` in place of ``language_docs``.
    Documents that are held out and labels that are null take no part.  Without any label there is no model.
    """
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(doc_id).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).count().collect()
    if not counts:
        return None
    language_docs = min(language_docs, max(LEAST_DOCS, language_docs * SHARED_LABELS // len(counts)))
    # one row for each label that the network has; they are on the driver anyhow
    limits = docs.sparkSession.createDataFrame(
        [(row["lang"], int(min(1.0, 1.5 * language_docs / row["count"]) * (1 << 60))) for row in counts],
        "__label__ string, __limit__ long",
    )
    h = hash60(F.lit("lang"), F.col(doc_id).cast("string"))
    sample = (
        rows.join(F.broadcast(limits), F.col(lang) == F.col("__label__"))
        .where(h < F.col("__limit__"))
        .select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("hash"))
        .mapInArrow(_windows, "lang string, hash bigint, window binary")
        .collect()
    )
    languages = sorted(row["lang"] for row in counts)
    seen: dict = {}
    x, y = [], []
    for row in sorted(sample, key=lambda r: (r["hash"], bytes(r["window"]))):
        mine = seen.setdefault(row["lang"], set())
        if row["hash"] in mine or len(mine) < 2 * language_docs:
            mine.add(row["hash"])
            x.append(np.frombuffer(bytes(row["window"]).ljust(TRAIN_WINDOW, b"\0"), np.uint8))
            y.append(languages.index(row["lang"]))
    if not x:
        return None
    return ByteTagger(languages).fit(np.array(x), np.array(y))


def _predict(model):
    def run(batches):
        tagger = model.value
        for batch in batches:
            data, offsets = as_bytes(batch.column(2))
            if tagger is None:
                lang, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                p, letters = tagger.pooled(data, offsets)
                best = p.argmax(1)
                score = np.where(letters > 0, p[np.arange(len(p)), best], 0.0)
                lang = [tagger.languages[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)]
            ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
            bare = np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]])
            for i in bare.tolist():  # no plain letter: others count only if they are letters
                if not any(c.isalpha() for c in batch.column(2)[i].as_py() or ""):
                    lang[i], score[i] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(np.clip(score, 0.0, 1.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: ByteTagger | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``, from the text alone.

    A null text, one without letters, and any text without a model are ``und`` with score 0.  Repeated rows have a row
    each; an empty table gives no rows; further columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(shared), "doc_id bigint, held_out boolean, lang_pred string, score double")
