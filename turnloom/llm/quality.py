"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are the three-character shapes of its bytes (letters folded to
their kind, each punctuation mark kept) and how its words repeat: the share of
words equal to the word before, and of words not met before in the text. Weighted
by rarity and projected on the leading singular directions of the labelled
sample, they give a short vector. Every document is compared by exact cosine
with all labelled vectors, block by block, and its ``NEIGHBOURS`` nearest vote
for their label with weights that grow with similarity.

The labelled vectors are broadcast: at most ``SAMPLE`` rows of each label, of
``DIMENSIONS`` floats each, whatever the input. They come from labelled rows
with texts of at most ``LONGEST`` bytes, in the order of a hash of their key.

Defined cases: a null or empty text, whose vector is zero, gets the share of label
1 in the sample; without labelled rows every score is 0.5; repeated rows score
alike; ties among neighbours go to the earlier labelled row; other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import labelled_sample
from turnloom.llm.word_bpe import as_bytes

SAMPLE, LONGEST = 2000, 20_000
TERMS, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 48, 15, 8
#: Steps into which the two shares of repeated and new words are cut.
STEPS = 8


def _kinds() -> np.ndarray:
    """A small number for each byte: its kind."""
    kinds = np.full(256, 1, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kinds[marks] = np.arange(6, 6 + len(marks))
    kinds[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    kinds[[ord(c) for c in "0123456789"]] = 3
    kinds[:33] = 4
    kinds[10] = 5
    return kinds


KINDS = _kinds()
RADIX = int(KINDS.max()) + 1
WIDTH = TERMS + 2 * (STEPS + 1)


def counts(texts: list[bytes | None]) -> np.ndarray:
    """A row of term rates for each text."""
    texts = [t or b"" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kind = KINDS[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros((len(texts), WIDTH), np.float32)
    if len(kind) > 2:
        code = (kind[:-2] * RADIX + kind[1:-1]) * RADIX + kind[2:]
        code = (code * 2654435761 >> 7) % TERMS
        inside = owner[:-2] == owner[2:]
        out[:, :TERMS] = np.bincount((owner[:-2] * TERMS + code)[inside], minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
    out[:, :TERMS] = np.log1p(out[:, :TERMS] * (1000 / np.maximum(sizes, 1))[:, None])
    for i, text in enumerate(texts):
        words = text.split()
        if words:
            again = sum(map(bytes.__eq__, words, words[1:])) / len(words)
            # Later stretches of a text repeat its common words anyway: newness counts by 200 words.
            stretches = [words[k : k + 200] for k in range(0, len(words), 200)]
            new = sum(len(set(s)) for s in stretches) / len(words)
            out[i, TERMS + round(STEPS * again)] = 40 * min(1.0, 4 * again)
            out[i, TERMS + STEPS + 1 + round(STEPS * new)] = 4
    return out


@dataclass
class Model:
    rarity: np.ndarray | None
    directions: np.ndarray | None
    vectors: np.ndarray | None
    marks: np.ndarray | None
    prior: float = 0.5

    def project(self, rates: np.ndarray) -> np.ndarray:
        own = (rates * self.rarity) @ self.directions
        norms = np.linalg.norm(own, axis=1, keepdims=True)
        return np.divide(own, norms, out=np.zeros_like(own), where=norms > 0)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), 0.5)
        own = self.project(counts(texts))
        near = own @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        votes = (weight * self.marks[top]).sum(1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior)


def fit(texts: list[bytes], marks: np.ndarray, seed: int = 0) -> Model:
    if not len(texts):
        return Model(None, None, None, None)
    rates = np.vstack([counts(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    rarity = np.log((1 + len(rates)) / (1 + (rates > 0).sum(0))).astype(np.float32) + 0.1
    x = rates * rarity
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    # Leading singular directions by a few rounds of orthogonal iteration.
    q = np.random.default_rng(seed).normal(size=(x.shape[1], min(DIMENSIONS, len(x)))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    model = Model(rarity, np.ascontiguousarray(q, np.float32), None, np.asarray(marks, np.float64), float(np.mean(marks)))
    model.vectors = model.project(rates)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id and ``label``) with the texts of ``docs``."""
    rows = labelled_sample(docs, labels, label, sample, sample, LONGEST)
    return fit([t.encode() for t in rows["text"]], rows["mark"].to_numpy())


def scorer(spark: SparkSession, model: Model):
    """A column function: the chance, 0 to 1, that a text has label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def quality(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            held = as_bytes(texts)
            yield pa.array(np.concatenate([shared.value.scores(held.slice(i, 128).to_pylist()) for i in range(0, len(held), 128)]) if len(held) else [], pa.float64())

    def column(text: Column) -> Column:
        return quality(F.coalesce(text, F.lit("")))

    return column


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a column of scores."""
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text)))
