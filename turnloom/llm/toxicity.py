"""Toxicity by support vector machines on a subsequence string kernel.

A text is toxic if one of its sentences holds an insult, or if many of its words are likely to be one. Instances are
stretches of at most ``STRETCH`` letters of a word, of a run of single letters written apart, of two neighbouring words
of at most ``JOINED`` bytes, or of three of at most ``SHORT`` bytes each; a word's score is that of its worst stretch.

Kernel: two stretches share a subsequence of four letters wherever both hold it in order inside six letters, each
skipped letter costing ``DECAY``. Counts aren't divided by the length, so a letter that is inserted, doubled or (in
words of six and more) replaced lowers a match by little. Figures are read as the letters that they look like. Nyström: landmarks are instances seen in training; a machine is linear on their whitened similarities. As
the kernel's features are explicit, the trained machine folds into one weight per (hashed) subsequence.

Training uses labelled rows only, at most ``SAMPLE`` toxic and three times as many others, each of at most ``LONGEST``
bytes, taken in the order of a hash of their key; executors cut them into stretches, the driver gets the distinct ones
of each text. A text's sentences carry its label; as most are harmless, the positive instances are those that toxic
texts hold far too often for chance, and later those that the machine of the round before names (multiple-instance
learning). Each also trains with inserted, doubled and replaced letters, against random and the hardest other instances.

Two machines are trained: a sure one, whose positives have hardly any relatives in other texts, and a wide one for all
positives. A text is clean only if both its worst sure score and its share of words that the wide machine accepts are
low, by logistic curves whose middles tell labelled texts and disguised insults apart best.

Defined cases: a null or empty text, and one without four-letter instances, gets the score of no insult; without
labelled rows of both kinds every score is 0; repeated rows score alike; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import cut, labelled_rows
from turnloom.llm.word_bpe import as_bytes, slices

#: Bounds of the training sample: toxic rows (others: OTHERS times as many), bytes of a text.
SAMPLE, OTHERS, LONGEST = 1500, 3, 20_000
ORDER, SPAN, DECAY, STRETCH = 4, 6, 0.8, 8
TABLE = 1 << 20
#: Bytes of text that a worker scores at a time; it takes some 70 bytes of memory for each.
PIECE = 1 << 18
LANDMARKS, ROUNDS, RANDOM, HARD = 192, 4, 4000, 2000
#: Positives at most, the commonest first; each has some thirty variants.
POSITIVES = 200
#: Letters of two neighbouring words that are joined, and of each of three.
JOINED, SHORT = 12, 4

SHAPES = [(0, *rest) for rest in combinations(range(1, SPAN), ORDER - 1)]
COSTS = [np.float32(DECAY ** (s[-1] + 1 - ORDER)) for s in SHAPES]


class _Letters(dict):
    """For str.translate: each character's letter. Figures and signs are what they look like, other scripts' letters fall in five
    classes behind z, white space is a space, and all else goes."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code).lower()
        if "a" <= c <= "z" and len(c) == 1:
            got = c
        elif c.isspace():
            got = " "
        else:
            got = chr(ord("z") + 1 + code % 5) if c.isalpha() else None
        self[code] = got
        return got


LETTERS = _Letters(str.maketrans("013457@$", "oieastas"))


def letters(text: bytes) -> list[str]:
    """The words of a text as letters, each of which is its own last five bits; single letters written apart are one word."""
    return APART.sub(lambda m: m[0].replace(" ", ""), " ".join(text.decode().translate(LETTERS).split())).split()


#: Four single letters or more in a row.
APART = re.compile(r"(?<![^ ])[^ ](?: [^ ](?![^ ])){3,}")


def stretches(word: str) -> list[str]:
    return [word] if len(word) <= STRETCH else [word[i : i + STRETCH] for i in range(len(word) - STRETCH + 1)]


def _subsequences(x: np.ndarray) -> Iterator[tuple[int, np.float32, np.ndarray]]:
    """(last place, cost, code at each place) for each shape, over letters as numbers below 32 (0: none) whose last axis ends in SPAN - 1 zeros."""
    n = x.shape[-1] - SPAN + 1
    parts = [x << (5 * k) for k in range(ORDER)]
    for (_, *rest), cost in zip(SHAPES, COSTS, strict=True):
        code = parts[3][..., :n]
        for k, d in zip((2, 1, 0), rest, strict=True):
            code = code | parts[k][..., d : d + n]
        yield rest[-1], cost, code


def _codes(instances: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of each stretch, and their costs (0 where there is none)."""
    n = STRETCH - ORDER + 1
    x = np.array(instances, dtype=f"S{STRETCH}").view(np.uint8).reshape(len(instances), STRETCH).astype(np.int32) & 31
    x = np.pad(x, ((0, 0), (0, SPAN - 1)))
    codes = np.empty((len(instances), len(SHAPES), n), np.int32)
    costs = np.empty((len(instances), len(SHAPES), n), np.float32)
    for k, (last, cost, code) in enumerate(_subsequences(x)):
        codes[:, k] = code[:, :n]
        costs[:, k] = np.where(x[:, last : last + n] > 0, cost, 0)
    return codes.reshape(len(instances), -1), costs.reshape(len(instances), -1)


def _kernel(instances: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of stretches with landmarks, some rows at a time."""
    codes, costs = _codes(landmarks)
    used = np.unique(codes[costs > 0])
    place = np.full(TABLE, len(used), np.int32)
    place[used] = np.arange(len(used))
    base = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for j in range(len(landmarks)):
        np.add.at(base[:, j], place[codes[j]], costs[j])
    base[-1] = 0
    out = np.empty((len(instances), len(landmarks)), np.float32)
    for i in range(0, len(instances), 128):
        codes, costs = _codes(instances[i : i + 128])
        out[i : i + 128] = np.matmul(costs[:, None, :], base[place[codes]])[:, 0]
    return out


@dataclass
class Machine:
    """A weight for each subsequence."""

    table: np.ndarray
    bias: float

    def of(self, instances: list[str]) -> np.ndarray:
        out = np.empty(len(instances), np.float32)
        for i in range(0, len(instances), 4096):
            codes, costs = _codes(instances[i : i + 4096])
            out[i : i + 4096] = np.einsum("ij,ij->i", self.table[codes], costs)
        return out + np.float32(self.bias)

    def worst(self, letters: np.ndarray, codes: list[tuple[int, np.float32, np.ndarray]], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The worst stretch of each part [start, stop) of at least ORDER letters."""
        sums = {last: np.zeros(len(letters) + 1) for last in range(ORDER - 1, SPAN)}
        for last, cost, code in codes:
            sums[last][1:] += self.table[code] * cost
        sums = {last: np.cumsum(x) for last, x in sums.items()}

        def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return sum(x[np.maximum(b - last, a)] - x[a] for last, x in sums.items())

        out = np.empty(len(start))
        long = stop - start > STRETCH
        out[~long] = within(start[~long], stop[~long])
        if long.any():
            at = np.arange(len(letters) - STRETCH + 1)
            whole = np.append(within(at, at + STRETCH), 0)
            ends = np.stack([start[long], stop[long] - STRETCH + 1], 1).ravel()
            out[long] = np.maximum.reduceat(whole, ends)[::2]
        return out + self.bias


@dataclass
class Model:
    """Both machines; slope and middle of the curves over a text's worst sure score and over the root of its share of likely words."""

    sure: Machine | None
    wide: Machine | None = None
    worst: tuple[float, float] = (8.0, 0.0)
    share: tuple[float, float] = (40.0, 0.5)
    #: Insults with a letter inserted or doubled, which a sure score should accept.
    disguised: tuple[str, ...] = ()

    def evidence(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The worst sure score of each text (the bias, a match with nothing, where there is none), and the share of its words that the wide machine accepts."""
        words = [letters(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(texts))
        flat = [w for own in words for w in own]
        worst, share = np.full(len(texts), self.sure.bias, np.float64), np.zeros(len(texts))
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), counts)
        x = np.frombuffer("".join(flat).encode(), np.uint8).astype(np.int32) & 31
        codes = list(_subsequences(np.pad(x, (0, SPAN - 1))))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        own = np.flatnonzero(sizes >= ORDER)
        if len(own):
            share = np.bincount(owner[own], self.wide.worst(x, codes, starts[own], ends[own]) > 0, len(texts)) / np.maximum(counts, 1)
        # Neighbouring words of one text may be one word with spaces in it.
        two = np.flatnonzero((owner[1:] == owner[:-1]) & (sizes[1:] + sizes[:-1] <= JOINED) & (sizes[1:] + sizes[:-1] >= ORDER))
        small = sizes <= SHORT
        three = np.flatnonzero((owner[2:] == owner[:-2]) & small[2:] & small[1:-1] & small[:-2] & (sizes[2:] + sizes[1:-1] + sizes[:-2] >= ORDER))
        first = np.concatenate([own, two, three])
        if len(first):
            found = self.sure.worst(x, codes, starts[first], ends[np.concatenate([own, two + 1, three + 2])])
            np.maximum.at(worst, owner[first], found)
        return worst, share

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.sure is None:
            return np.zeros(len(texts))
        worst, share = self.evidence(texts)
        (a, b), (c, d) = self.worst, self.share
        return 1 - _sigmoid(-a * (worst - b)) * _sigmoid(-c * (np.sqrt(share) - d))

    def settle(self, worst: np.ndarray, share: np.ndarray, toxic: np.ndarray) -> None:
        """Put the middles where labelled texts and disguised insults are told apart best."""
        toxic = toxic.astype(bool)
        insults = self.sure.of(list(self.disguised)) if self.disguised else np.ones(1)
        self.worst = (8.0, _best_cut(insults, worst[~toxic], np.linspace(0, 0.9, 19)))
        told = worst >= self.worst[1]
        if (toxic & ~told).any() and (~toxic & ~told).any():
            self.share = (40.0, _best_cut(np.sqrt(share[toxic & ~told]), np.sqrt(share[~toxic & ~told]), np.linspace(0.02, 0.5, 49)))


def _best_cut(high: np.ndarray, low: np.ndarray, cuts: np.ndarray) -> float:
    """The cut that loses the least share of ``high`` and ``low`` together; of equal ones the middle."""
    lost = np.array([(high < c).mean() + (low >= c).mean() for c in cuts])
    return float(np.median(cuts[lost <= lost.min() + 1e-9]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(x1.shape[1])
    for _ in range(25):
        miss = np.flatnonzero(y * (x1 @ w) < 1)
        a = x1[miss] * weight[miss, None]
        new = np.linalg.solve(ridge + 2 * cost * x1[miss].T @ a, 2 * cost * a.T @ y[miss])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def inserted(word: str, rng: np.random.Generator, alphabet: list[str]) -> list[str]:
    """A positive with one letter inserted or doubled at each place."""
    return [word[:i] + a + word[i:] for i in range(1, len(word)) for a in (word[i - 1], *rng.choice(alphabet, 3))]


def variants(word: str, rng: np.random.Generator, alphabet: list[str]) -> list[str]:
    """Stretches of a positive with one letter inserted or doubled at each place, or replaced in words of six and more."""
    replaced = [word[:i] + a + word[i + 1 :] for i in range(1, len(word) - 1) for a in rng.choice(alphabet, 2)] if len(word) >= 6 else []
    return [s for v in inserted(word, rng, alphabet) + replaced for s in stretches(v)]


def _machine(positive: list[str], varied: list[str], negative: list[str], landmarks: list[str]) -> Machine:
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(np.float64))
    whiten = (vectors * (1 / np.sqrt(np.maximum(values, 1e-2)))) @ vectors.T
    near = _kernel(positive + varied + negative, landmarks) @ whiten.astype(np.float32)
    scale = max(float(np.sqrt((near**2).sum(1).mean())), 1e-9)
    near /= np.float32(scale)
    parts = [len(positive), len(varied), len(negative)]
    y = np.repeat([1.0, 1.0, -1.0], parts)
    weight = np.repeat([share * len(y) / max(1, n) for share, n in zip((0.25, 0.25, 0.5), parts, strict=True)], parts)
    w, bias = _svm(near.astype(np.float64), y, weight)
    table = np.zeros(TABLE, np.float32)
    codes, costs = _codes(landmarks)
    for j, v in enumerate((whiten @ w / scale).tolist()):
        np.add.at(table, codes[j], np.float32(v) * costs[j])
    return Machine(table, bias)


#: Of the shares of toxic and other texts that hold relatives of a sure positive: how much less the second is. How alike relatives are.
SURE, RELATED = 0.05, 0.6


def learn(instances: list[str], bags: list[np.ndarray], toxic: np.ndarray, seed: int = 0) -> Model:
    """Both machines from the texts' distinct stretches (numbers into ``instances``); the curve isn't fitted yet."""
    n, all_toxic = len(instances), max(1, int(toxic.sum()))
    in_toxic, in_other = (np.bincount(np.concatenate([b for b, t in zip(bags, toxic, strict=True) if t == kind] or [np.zeros(0, int)]), minlength=n) for kind in (True, False))
    share = toxic.mean()

    def chance(i: int) -> float:
        k, m = int(in_toxic[i]), int(in_toxic[i] + in_other[i])
        return sum(comb(m, j) * share**j * (1 - share) ** (m - j) for j in range(k, m + 1)) if m < 400 else (0.0 if k / m > 3 * share else 1.0)

    alone = np.flatnonzero((in_toxic >= 2) & (in_other <= SURE * in_toxic)).tolist()
    positive = [i for i in alone if chance(i) * len(alone) < 1e-3]
    if not positive:
        # Too few texts to tell: all instances that lead by as much, as none of them is likelier.
        lead = in_toxic - in_other
        positive = np.flatnonzero((lead == lead.max(initial=0)) & (lead > 0)).tolist()
    if not positive:
        return Model(None)
    rng = np.random.default_rng(seed)
    harmless = np.flatnonzero(in_other)
    random = harmless[rng.permutation(len(harmless))[:RANDOM]].tolist()
    alphabet = sorted({c for i in harmless.tolist() for c in instances[i] if c.isascii()}) or ["x"]
    other_words = {instances[i] for i in harmless.tolist()}
    hard: list[list[int]] = [[], []]
    machines: list[Machine] = []
    relatives: dict[int, bool] = {}
    for _ in range(ROUNDS):
        positive = sorted(positive, key=lambda i: (-in_toxic[i], instances[i]))[:POSITIVES]
        names = [instances[i] for i in positive]
        if fresh := [i for i in positive if i not in relatives]:
            # Relatives of a positive among all instances tell whether other texts hold such words too.
            near, asked = np.zeros((2, len(fresh))), [instances[i] for i in fresh]
            least = RELATED * _kernel(asked, asked).diagonal()
            for at in range(0, n, 4096):
                related = _kernel(instances[at : at + 4096], asked) >= least
                near += np.stack([in_toxic[at : at + 4096], in_other[at : at + 4096]]) @ related
            relatives.update(zip(fresh, (near[1] / max(1, len(toxic) - all_toxic) <= SURE * near[0] / all_toxic).tolist(), strict=True))
        sure = np.array([relatives[i] for i in positive])
        if not sure.any():
            sure[:] = True
        machines = []
        for k, chosen in enumerate((sure, np.ones(len(names), bool))):
            own_names = [w for w, s in zip(names, chosen, strict=True) if s]
            taken = set(own_names)
            varied = list(dict.fromkeys(v for w in own_names for v in variants(w, rng, alphabet) if v not in taken and v not in other_words))
            unsure = [w for w, s in zip(names, chosen, strict=True) if not s]
            negative = [w for w in dict.fromkeys(unsure + [instances[i] for i in random + hard[k]]) if w not in taken]
            marks = own_names[: LANDMARKS // 2] + unsure[: LANDMARKS // 4] + [instances[i] for i in hard[k][:: max(1, len(hard[k]) // (LANDMARKS // 2))]] + [instances[i] for i in random[:32]]
            machine = _machine(own_names, varied, negative, list(dict.fromkeys(marks)))
            # Its own worst mistakes are the next round's negatives.
            scores = machine.of([instances[i] for i in harmless.tolist()])
            hard[k] = harmless[np.argsort(-scores, kind="stable")[:HARD]].tolist()
            machines.append(machine)
        # The wide machine names the instance of each toxic text that had none.
        held = np.zeros(n, bool)
        held[positive] = True
        new = np.flatnonzero((in_toxic > 0) & (in_other == 0))
        scores = np.full(n, -np.inf)
        scores[new] = machines[1].of([instances[i] for i in new.tolist()])
        named = {int(b[np.argmax(scores[b])]) for b, t in zip(bags, toxic, strict=True) if t and len(b) and not held[b].any()}
        positive += sorted(i for i in named if scores[i] > 0.5)
    disguised = [v for w, s in zip(names, sure, strict=True) if s and len(w) < STRETCH for v in inserted(w, rng, alphabet)]
    return Model(*machines, disguised=tuple(disguised))


def bag(text: bytes) -> tuple[list[int], list[str]]:
    """A text's sketch (its least pairs of words, hashed) and its distinct stretches."""
    words = text.lower().split()
    pairs = sorted({zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)})[:8]
    return pairs, sorted({s for w in letters(text) if len(w) >= ORDER for s in stretches(w)})


def _first_of_copies(sketches: list[list[int]]) -> list[int]:
    """Of copies one text is enough."""
    out, met = [], set()
    for i, sketch in enumerate(sketches):
        if 2 * sum(h in met for h in sketch) <= len(sketch):
            out.append(i)
        met.update(sketch)
    return out


def _learn(sketches: list[list[int]], held: pa.Array, toxic: np.ndarray) -> tuple[Model, list[int]]:
    """The machines from each text's stretches, a list column."""
    first = _first_of_copies(sketches)
    toxic = np.asarray(toxic).astype(bool)[first]
    if not toxic.any() or toxic.all():
        return Model(None), first
    held = held.take(pa.array(first))
    coded = held.flatten().dictionary_encode()
    ends = np.cumsum(np.fromiter((len(x) for x in held), np.int64, len(held)))
    bags = np.split(coded.indices.to_numpy(), ends[:-1])
    return learn(coded.dictionary.to_pylist(), bags, toxic), first


def fit(texts: list[bytes], toxic: np.ndarray) -> Model:
    """Train on labelled texts at hand; see the module's text."""
    bags = [bag(t) for t in texts]
    model, first = _learn([b[0] for b in bags], pa.array([b[1] for b in bags], pa.list_(pa.string())), toxic)
    if model.sure is not None:
        worst, share = (np.concatenate(x) for x in zip(*(model.evidence(texts[i : i + 64]) for i in range(0, len(texts), 64)), strict=True))
        model.settle(worst[first], share[first], np.asarray(toxic)[first])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id and ``label``) with the texts of ``docs``, which stay on the executors."""
    rows = cut(labelled_rows(docs, labels, label, sample, OTHERS * sample, LONGEST), "labelled")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [bag(t) for t in as_bytes(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark").cast(pa.int32()), pa.array([h[0] for h in held], pa.list_(pa.int64())), pa.array([h[1] for h in held], pa.list_(pa.string()))], ["id", "mark", "sketch", "held"])

    got = rows.mapInArrow(bags, "id long, mark int, sketch array<long>, held array<string>").toArrow().sort_by("id").combine_chunks()
    if not got.num_rows:
        return Model(None)
    toxic = got["mark"].to_numpy() == 1
    model, first = _learn(got["sketch"].to_pylist(), got["held"].combine_chunks(), toxic)
    if model.sure is None:
        return model
    kept = got["id"].take(pa.array(first)).to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst, share = shared.value.evidence(as_bytes(batch.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark").cast(pa.int32()), pa.array(worst), pa.array(share)], ["id", "mark", "worst", "share"])

    found = rows.mapInArrow(seen, "id long, mark int, worst double, share double").toPandas().set_index("id").loc[kept]
    model.settle(found["worst"].to_numpy(), found["share"].to_numpy(), found["mark"].to_numpy())
    return model


def scored(model: Model, texts: pa.Array) -> pa.Array:
    """The scores of texts, PIECE bytes of them at a time."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    out = [model.scores(as_bytes(x.column("text")).to_pylist()) for x in slices(batch, "text", PIECE)]
    return pa.array(np.concatenate(out) if out else [], pa.float64())


def scorer(spark: SparkSession, model: Model):
    """A column function: the toxicity, 0 to 1, of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield scored(shared.value, texts)

    def column(text: Column) -> Column:
        return toxicity(F.coalesce(text, F.lit("")))

    return column


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a column of scores."""
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text)))
