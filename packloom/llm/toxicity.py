"""Toxicity by multiple-instance learning.

Only documents are labelled.  A sentence's probability is logistic in its words
and word beginnings; a document is toxic unless none of its sentences is
(noisy-or), and the likelihood of document labels trains the sentence weights.
The same weights then point out the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_parts
from .langid import held_out
from .staging import stage

#: Labelled documents of each class that the classifier is fitted on at most, those whose ids hash lowest,
#: and the characters of a document of that sample at most: longer ones are scored like all others, but not fitted on.
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 1 << 16
#: Features that the fit weighs: those most associated with the label among features of at least MIN_DOCS documents.
FEATURES = 4_000
MIN_DOCS = 4
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.7
#: The fit ends when no weight has moved further than this for ten rounds.
STILL = 5e-4

_TOKENS = re.compile(r"\w+|[.!?\n]+")


def _features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def _sentences(text: str | None) -> Iterator[list[str]]:
    words: list[str] = []
    for token in _TOKENS.findall((text or "").lower()):
        if token[0] in ".!?\n":
            if words:
                yield words
            words = []
        else:
            words.append(token)
    if words:
        yield words


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every feature of each document once, with the document's label."""
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            found = sorted({f for s in _sentences(text.as_py()) for w in s for f in _features(w)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label.as_py()] * len(found), pa.int32())], ["feature", "label"])


def _bags(index: dict[str, int]):
    """Per document: the chosen features of each sentence that has any, and how many sentences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, sizes, features = [], [], []
            for text in batch.column("text"):
                bags = [sorted({index[f] for w in s for f in _features(w) if f in index}) for s in _sentences(text.as_py())]
                full = [bag for bag in bags if bag]
                plain.append(len(bags) - len(full))
                sizes.append(np.array([len(bag) for bag in full], np.int32).tobytes())
                features.append(np.array([k for bag in full for k in bag], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(plain, pa.int32()), pa.array(sizes, pa.binary()), pa.array(features, pa.binary())], ["place", "label", "plain", "sizes", "features"])

    return run


class Bags:
    """Documents as bags of sentences, for the noisy-or likelihood of their labels."""

    def __init__(self, y: np.ndarray, plain: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]]):
        """``bags`` holds per document the sizes of its sentences' feature lists and the lists in a row; ``plain`` counts sentences without features."""
        sizes = [s for s, _ in bags]
        self.y, self.plain = y, plain
        self.owner = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
        self.rows, self.cols = np.repeat(np.arange(len(self.owner)), np.concatenate(sizes)), np.concatenate([f for _, f in bags])

    def _none(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """Sentence logits, and per document -log of the probability that no sentence is toxic."""
        z = np.bincount(self.rows, w[self.cols], len(self.owner)) + b
        return z, np.bincount(self.owner, np.logaddexp(0, z), len(self.y)) + self.plain * np.logaddexp(0, b)

    def loss(self, w: np.ndarray, b: float) -> float:
        """-log likelihood of the labels."""
        none = self._none(w, b)[1]
        return float(np.where(self.y, -np.log(-np.expm1(-none)), none).sum())

    def gradient(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z, none = self._none(w, b)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        pull = np.where(self.y, -1 / np.expm1(np.clip(none, 1e-9, 50)), 1.0)
        g = pull[self.owner] * p
        return np.bincount(self.cols, g[self.rows], len(w)), float(g.sum() + (pull * self.plain * p0).sum())


def fit(y: np.ndarray, plain: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], index: dict[str, int], rounds: int = 1_000, l1: float = 0.1, l2: float = 0.02) -> Model:
    """Noisy-or likelihood with an elastic net, by scaled proximal gradients; arguments as for :class:`Bags`.

    Without documents of both classes nothing can be learned: every sentence
    scores near 0.
    """
    if not y.any() or y.all() or not index:
        return Model({}, -12.0)
    documents = Bags(y, plain, bags)
    w, b = np.zeros(len(index)), -4.0
    speed_w, speed_b, scale_w, scale_b = np.zeros(len(w)), 0.0, np.full(len(w), 1e-8), 1e-8
    still = 0
    for _ in range(rounds):
        gw, gb = documents.gradient(w, b)
        gw = gw + l2 * w
        scale_w, scale_b = np.maximum(0.99 * scale_w, gw * gw), max(0.99 * scale_b, gb * gb)
        speed_w, speed_b = 0.8 * speed_w + 0.2 * gw, 0.8 * speed_b + 0.2 * gb
        rate_w = 0.15 / np.sqrt(scale_w)
        before, bias = w, b
        w = w - rate_w * speed_w
        w = np.sign(w) * np.maximum(np.abs(w) - rate_w * l1, 0)
        b -= 0.15 * speed_b / np.sqrt(scale_b)
        still = 0 if max(abs(b - bias), np.abs(w - before).max()) > STILL else still + 1
        if still >= 10:
            break
    return Model({f: float(w[k]) for f, k in index.items() if w[k]}, float(b))


class Scorer(dict):
    """Weight of each word, its beginnings included."""

    def __init__(self, model: Model, limit: int = 100_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        if word[0] in ".!?\n":
            value = np.nan
        else:
            value = sum(self.model.weights.get(f, 0.0) for f in _features(word))
        self[word] = value
        return value

    def sentence_probabilities(self, text: str | None) -> np.ndarray:
        tokens = _TOKENS.findall((text or "").lower())
        w = np.fromiter(map(self.__getitem__, tokens), float, len(tokens))
        stop = np.isnan(w)
        words = ~stop
        if not words.any():
            return np.empty(0)
        begins = np.flatnonzero(words & np.concatenate(([True], stop[:-1])))
        z = np.add.reduceat(np.where(stop, 0.0, w), begins)
        for k in np.flatnonzero(np.add.reduceat((w != 0) & words, begins) > 1):  # a repeated word counts once
            end = begins[k + 1] if k + 1 < len(begins) else len(tokens)
            z[k] = sum(self[t] for t in {*tokens[begins[k] : end]} if t[0] not in ".!?\n")
        z += self.model.bias
        return 1 / (1 + np.exp(-z))

    def score(self, text: str | None) -> float:
        p = self.sentence_probabilities(text)
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))

    def offending(self, text: str, least: float = 0.5) -> list[dict]:
        """Character spans and probabilities of the sentences at or above ``least``."""
        lowered = text.lower()
        if len(lowered) != len(text):  # keep positions where lowering changes lengths
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, span, total, seen = [], None, 0.0, set()
        for m in [*_TOKENS.finditer(lowered), None]:
            if m is None or m[0][0] in ".!?\n":
                p = 1 / (1 + np.exp(-total - self.model.bias))
                if span and p >= least:
                    out.append({"start": span[0], "end": span[1], "score": float(p)})
                span, total, seen = None, 0.0, set()
            else:
                span = (span[0] if span else m.start(), m.end())
                total += self[m[0]] if m[0] not in seen else 0.0
                seen.add(m[0])
        return out


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE_ROWS`` labelled, not held-out documents of each class.

    Several labels of one document count as toxic if any is, and of several
    texts of one id the first in order counts.  Null labels, ids and texts, and
    texts longer than ``SAMPLE_CHARS``, are left out; empty tables teach nothing.
    Ties: documents are ordered by id hash and id, features of equal association
    by name.  The driver receives ``FEATURES`` words and the sample's sentences
    as lists of their numbers.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for k in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # 2 * SAMPLE_ROWS ids at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(sample, "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = stage(rows.select(F.xxhash64("id").alias("place"), "text", "label").repartition(2 * cores), "toxic-sample")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = toxic / max(1, total)
    counts = rows.mapInArrow(_present, "feature string, label int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("k")).where(F.col("n") >= MIN_DOCS)
    apart = F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1)  # signed root of a likelihood ratio
    index = {r["feature"]: i for i, r in enumerate(counts.orderBy(apart.desc(), "feature").select("feature").limit(FEATURES).collect())}
    found = sorted(rows.mapInArrow(_bags(index), "place long, label int, plain int, sizes binary, features binary").collect())
    numbers = [(np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["features"], np.int32)) for r in found]
    return fit(np.array([r["label"] for r in found], bool), np.array([r["plain"] for r in found], float), numbers, index)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``, ``offending``.

    ``offending`` lists start, end and probability of the sentences that make a
    document toxic; it is empty where ``predicted`` is 0.  Null texts and texts
    without words score 0; texts may be of any length, and since a noisy-or adds
    up what little each sentence has, texts of far more sentences than those of
    the sample lean towards toxic.  Null and repeated ids
    are kept, each row scored by its own text; an empty table gives no rows;
    other columns are ignored.
    """
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        scorer = Scorer(model)

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            values, found = [], []
            for x in part.column("text"):
                text = x.as_py()
                values.append(scorer.score(text))
                found.append(scorer.offending(text) if values[-1] >= threshold else [])
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32()), pa.array(found, spans)], [id_col, "held_out", "score", "predicted", "offending"])

        return one

    source = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(by_parts(make, "text"), f"`{id_col}` {source.dtypes[0][1]}, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")
