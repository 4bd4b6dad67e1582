"""Toxicity of documents by averaged subword embeddings and a softmax, trained together.

A word is the bag of its character n-grams, each with a vector of its own; a word's vector is the mean of theirs, a
text's vector the mean of its words', and a linear softmax tells the labels apart.  Vectors and softmax are trained
jointly in numpy on a bounded sample of labelled documents.  A misspelt word shares most n-grams with the word it comes
from, and so its vector, whether or not it was ever seen.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import hash60

#: Rows of the embedding table, length of a vector, and the n-grams of a word (with a mark at both ends).
BUCKETS = 1 << 17
SIZE = 4
SHORTEST, LONGEST = 3, 5
#: Documents of each label that are learned from, at most.
LABEL_DOCS = 2000
#: Subwords in fewer of them have no vector; those in a share ``COMMON`` of the documents of label 0 count half as much as
#: subwords that these never hold.
LEAST_DOCS = 10
COMMON = 0.02
#: Words without a vector that every mean counts besides the text's own, so that a text of few words is not judged by one.
PLAIN_WORDS = 20
#: Updates of the fit, as many for any sample, and the documents of one.
STEPS = 300
BATCH = 64
RATE = 0.5
#: Words a task remembers before it starts anew.
MEMORY = 500_000

_ENDS = string.punctuation


def held_out(doc_id):
    """True for the documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def split_words(text: str) -> list[str]:
    """Words between blanks in lower case."""
    return text.lower().split()


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word itself, without punctuation at its ends unless it has nothing else."""
    marked = f"<{word.strip(_ENDS) or word}>"
    data, size = marked.encode("utf-8", "replace"), len(marked)
    if len(data) == size:  # characters are bytes
        grams = [data[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(size - n + 1)]
    else:
        grams = [
            marked[i : i + n].encode("utf-8", "replace") for n in range(SHORTEST, LONGEST + 1) for i in range(size - n + 1)
        ]
    grams.append(data)
    return [crc32(g) % BUCKETS for g in grams]


def bag(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """A text as buckets and their weights: the mean over words of the mean over a word's subwords."""
    counts = Counter(split_words(text))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    if len(known) > MEMORY:
        known.clear()
    for w in counts:
        if w not in known:
            known[w] = np.array(subwords(w), np.int32)
    parts = [known[w] for w in counts]
    sizes = np.array([len(x) for x in parts])
    share = np.repeat(np.array(list(counts.values())) / sizes / (counts.total() + PLAIN_WORDS), sizes)
    ids, place = np.unique(np.concatenate(parts), return_inverse=True)
    return ids, np.bincount(place, share).astype(np.float32)


class SubwordClassifier:
    """Embedding table ``e``, softmax ``w`` and ``c`` over labels 0 and 1; ``prior`` is the share of label 1."""

    def __init__(self, prior: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.prior = prior
        self.scale = np.ones(BUCKETS, np.float32)
        self.e = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (SIZE, 2)).astype(np.float32)
        self.c = np.zeros(2, np.float32)

    def fit(self, bags, labels, steps=STEPS, batch=BATCH, rate=RATE, seed=4):
        """Adam on the cross entropy; every label has the same weight in sum."""
        labels = np.asarray(labels)
        weight = len(labels) / (2.0 * np.maximum(1, np.bincount(labels, minlength=2)))[labels]
        seen = np.bincount(np.concatenate([b[0] for b in bags]), minlength=BUCKETS)
        usual = np.bincount(np.concatenate([b[0] for b, y in zip(bags, labels, strict=True) if y == 0]), minlength=BUCKETS)
        usual = usual / max(1, int((labels == 0).sum()))
        self.scale = (COMMON / (COMMON + usual) * (seen >= LEAST_DOCS)).astype(np.float32)
        cut = []
        for ids, share in bags:
            share = share * self.scale[ids]
            cut.append((ids[share > 0], share[share > 0]))
        rng = np.random.default_rng(seed)
        params = [self.e, self.w, self.c]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        epochs = max(1, round(steps * batch / len(cut)))
        for epoch in range(epochs):
            order = rng.permutation(len(cut))
            fade = 1 - epoch / epochs
            for i in range(0, len(order), batch):
                step += 1
                rows = order[i : i + batch]
                used, grads = self._gradients([cut[k] for k in rows], labels[rows], weight[rows])
                for p, g, m, s, at, r in zip(params, grads, first, second, (used, ..., ...), (rate, 0.05, 0.05), strict=True):
                    m[at] += np.float32(0.1) * (g - m[at])
                    s[at] += np.float32(0.01) * (g * g - s[at])
                    p[at] -= np.float32(r * fade / (1 - 0.9**step)) * m[at] / (np.sqrt(s[at] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
        return self

    def _gradients(self, bags, labels, weight):
        """Buckets that the batch holds; gradients of their vectors, of ``w`` and of ``c``."""
        share = np.concatenate([b[1] for b in bags])
        doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        used, place = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
        rows = self.e[used][place] * share[:, None]
        mean = np.stack([np.bincount(doc, rows[:, j], len(bags)) for j in range(SIZE)], 1).astype(np.float32)
        a = mean @ self.w + self.c
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p = (p * (weight / len(labels))[:, None]).astype(np.float32)
        back = (p @ self.w.T)[doc] * share[:, None]
        de = np.stack([np.bincount(place, back[:, j], len(used)) for j in range(SIZE)], 1).astype(np.float32)
        return used, [de, mean.T @ p, p.sum(0)]

    def margins(self) -> np.ndarray:
        """Each bucket's part in the log odds of label 1: the softmax is linear, so texts need this vector only."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0]) * self.scale).astype(np.float64)

    def base(self) -> float:
        """Log odds before any word."""
        return float(self.c[1] - self.c[0])


class _Words(dict):
    """Log odds of words, worked out when first met."""

    def __init__(self, margins):
        super().__init__()
        self.margins = margins.tolist()

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        bare = word.strip(_ENDS) or word
        if bare != word:
            value = self[word] = self[bare]
        else:
            parts = subwords(word)
            value = self[word] = sum([self.margins[b] for b in parts]) / len(parts)
        return value


def score_texts(model: SubwordClassifier, words: _Words, texts) -> np.ndarray:
    """Probability of label 1 for each text; one without words has the share of label 1."""
    out, base = np.empty(len(texts)), model.base()
    for i, text in enumerate(texts):
        parts = split_words(text or "")
        odds = base + sum(map(words.__getitem__, parts)) / (len(parts) + PLAIN_WORDS) if parts else None
        out[i] = model.prior if odds is None else 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, odds))))
    return out


def _bags(batches):
    known: dict = {}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids, weights = zip(*(bag(t or "", known) for t in texts), strict=True) if texts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                batch.column("label"),
                pa.array(ids, pa.list_(pa.int32())),
                pa.array(weights, pa.list_(pa.float32())),
            ],
            names=["doc", "label", "ids", "weights"],
        )


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    label_docs: int = LABEL_DOCS,
) -> SubwordClassifier | None:
    """Fit on at most ``label_docs`` documents of each label, those of the least hash of their id.

    Held-out documents, null ids and labels other than 0 and 1 take no part; an id with both labels counts as 1.  Of
    rows that repeat an id one is learned, the one whose text comes first.  What reaches the driver is bounded by
    ``2 * label_docs`` bags of at most ``BUCKETS`` entries.  Without documents of both labels there is no model.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    order = [hash60(F.lit("toxic"), F.col("doc").cast("string")), F.col("doc")]
    chosen = known.where("label = 0").orderBy(*order).limit(label_docs)
    chosen = chosen.unionAll(known.where("label = 1").orderBy(*order).limit(label_docs))
    # 2 * label_docs rows at most, so every task gets them
    met = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc")
    one = met.groupBy("doc", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("of"))
    rows = (
        one.select("doc", "label", F.col("of.text").alias("text"))
        .mapInArrow(_bags, "doc bigint, label int, ids array<int>, weights array<float>")
        .toArrow()
        .sort_by("doc")
    )
    got = rows["label"].to_numpy()
    if len(set(got.tolist())) < 2:
        return None
    bags = [
        (np.asarray(i.values, np.int32), np.asarray(w.values, np.float32))
        for i, w in zip(rows["ids"], rows["weights"], strict=True)
    ]
    return SubwordClassifier(counts[1] / (counts[0] + counts[1])).fit(bags, got)


def _predict(model):
    def run(batches):
        classifier = model.value
        words = _Words(classifier.margins()) if classifier is not None else None
        for batch in batches:
            if classifier is None:
                score = np.zeros(len(batch))
            else:
                score = score_texts(classifier, words, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.7).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def predict(docs: DataFrame, model: SubwordClassifier | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, from its whole text alone.

    A null text counts as empty, and a text without words has the share of label 1 as its score.  Without a model every
    score is 0.  Repeated rows have a row each, null ids stay, an empty table gives no rows, and further columns are not
    looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
