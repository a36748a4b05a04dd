"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's logit is a fixed prior plus the weights of its
distinct words (each word: itself and its prefixes); its score is the logistic of that.  Sentence scores
combine by noisy-or: a document is toxic unless every sentence is clean.  The weights are learned
from document labels alone, by gradient descent through the noisy-or, and then say which sentences
offend.

Training takes a bounded number of labelled rows, whole texts of any length.  The texts stay on the executors, which count
features and then send the driver, for each document, its sentences with chosen features: equal ones once, with
their number.  Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded, kept
from linkwell.llm.labelled import sample_rows
from linkwell.storage import discard

#: A sentence ends after its stops and closing marks, or at a line feed.
SENTENCE = re.compile(r"[^\n.!?]*[.!?]+[^\w\s]*|[^\n.!?]+|\n")
_OUTSIDE = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows used.
    ``prior``: logit of a sentence without known words.  ``features``: most features kept, each
    in at least ``seen`` toxic texts.
    ``l1``, ``l2``: penalties on a weight.  ``remembered``: most words kept in a scorer's table."""

    sample: int = 6000
    prior: float = -10.0
    features: int = 2000
    seen: int = 6
    rounds: int = 400
    rate: float = 0.1
    l1: float = 0.1
    l2: float = 0.05
    remembered: int = 200_000


def word_features(token: str) -> list[str]:
    """A token's lower-case word without marks around it, and its prefixes of 3 to 8 letters."""
    word = _OUTSIDE.sub("", token.lower())
    return [word, *(word[:n] + "*" for n in range(3, min(9, len(word))))] if word else []


class Model:
    def __init__(self, weights: dict[str, float], settings: Settings):
        self.weights, self.settings = weights, settings
        self.words: dict[str, float] = {}

    def mark(self) -> int:
        return hash((tuple(sorted(self.weights.items())), self.settings))

    def word(self, token: str) -> float:
        w = sum(self.weights.get(f, 0.0) for f in word_features(token))
        if len(token) <= 64:
            if len(self.words) >= self.settings.remembered:
                self.words.clear()
            self.words[token] = w
        return w

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence that has a word."""
        out, known, word, prior = [], self.words.get, self.word, self.settings.prior
        for m in SENTENCE.finditer(text):
            if tokens := m[0].split():
                total = prior
                for t in set(tokens):
                    w = known(t)
                    total += word(t) if w is None else w
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-total))) if total != prior else self.base))
        return out

    @property
    def base(self) -> float:
        return float(1 / (1 + np.exp(-self.settings.prior)))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of all sentences, and the sentences that offend: those above one half."""
        known, word, prior, base = self.words.get, self.word, self.settings.prior, self.base
        clean, plain, offend = 0.0, 0, []
        for m in SENTENCE.finditer(text):
            tokens = m[0].split()
            if not tokens:
                continue
            weights = [w for t in set(tokens) if (w := word(t) if (x := known(t)) is None else x)]
            if not weights:
                plain += 1
                continue
            z = prior + sum(weights)
            clean -= float(np.logaddexp(0, z))
            if z > 0:
                offend.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        clean += plain * float(np.log1p(-base))
        return float(-np.expm1(clean)), offend


def worth(held, fair, toxic_rows, fair_rows, log, sqrt) -> tuple:
    """Log odds of a feature that ``held`` toxic and ``fair`` other texts hold, and its rank among features."""
    odds = log((held + 0.5) / (toxic_rows + 1)) - log((fair + 0.5) / (fair_rows + 1))
    return odds, odds * sqrt(held)


def text_features(text: str) -> set[str]:
    return {f for t in set(text.split()) for f in word_features(t)}


class Bag:
    """Turns texts into (plain, sentences): the number of sentences without a chosen feature, and a count for
    each list of features that sentences hold, one entry for each distinct word and feature of it."""

    def __init__(self, chosen: dict[str, int], remembered: int):
        self.chosen, self.remembered = chosen, remembered
        self.known: dict[str, tuple[int, ...]] = {}

    def token(self, t: str) -> tuple[int, ...]:
        if (f := self.known.get(t)) is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            f = tuple(self.chosen[x] for x in word_features(t) if x in self.chosen)
            if len(t) <= 64:
                self.known[t] = f
        return f

    def read(self, text: str) -> tuple[int, Counter]:
        plain, found = 0, Counter()
        for m in SENTENCE.finditer(text):
            if tokens := m[0].split():
                ids = sorted(f for t in set(tokens) for f in self.token(t))
                if ids:
                    found[tuple(ids)] += 1
                else:
                    plain += 1
        return plain, found


@dataclass
class Bags:
    """Training documents: labels, plain sentences, and a sparse matrix of the other sentences."""

    y: np.ndarray
    plain: np.ndarray
    doc: np.ndarray
    times: np.ndarray
    sentence: np.ndarray
    column: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: list[tuple[int, int, Counter]], width: int) -> Bags:
        """From (label, plain, sentences) of each document."""
        doc, times, sentence, column = [], [], [], []
        for d, (_, _, found) in enumerate(rows):
            for ids in sorted(found):
                sentence += [len(doc)] * len(ids)
                column += ids
                doc.append(d)
                times.append(found[ids])
        ints = lambda x: np.array(x, np.int64)
        return cls(np.array([r[0] for r in rows], np.float64), np.array([r[1] for r in rows], np.float64), ints(doc), np.array(times, np.float64), ints(sentence), ints(column), width)


def objective(w: np.ndarray, bags: Bags, s: Settings) -> tuple[float, np.ndarray]:
    """Loss of the noisy-or against the document labels, with penalties, and its gradient."""
    n, rows = len(bags.y), len(bags.doc)
    z = s.prior + np.bincount(bags.sentence, w[bags.column], rows)
    sentence = 1 / (1 + np.exp(-z))
    # minus log of "no sentence is toxic"
    clean = np.bincount(bags.doc, bags.times * np.logaddexp(0, z), n) + np.log1p(np.exp(s.prior)) * bags.plain
    p = np.clip(-np.expm1(-clean), 1e-12, 1 - 1e-12)
    loss = np.where(bags.y == 1, -np.log(p), clean).sum() + s.l2 / 2 * (w**2).sum() + s.l1 * np.abs(w).sum()
    by_doc = np.where(bags.y == 1, -(1 - p) / p, 1.0)
    return float(loss), np.bincount(bags.column, (by_doc[bags.doc] * bags.times * sentence)[bags.sentence], bags.width) + s.l2 * w + s.l1 * np.sign(w)


def solve(bags: Bags, names: list[str], s: Settings) -> Model:
    """Weights by gradient descent with momentum."""
    w, mean, square = np.zeros(bags.width), np.zeros(bags.width), np.zeros(bags.width)
    for t in range(1, s.rounds + 1):
        gradient = objective(w, bags, s)[1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= s.rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, s)


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """Learn weights from whole texts and their labels, on one machine.  Without both labels all weights are 0."""
    if len(set(labels)) < 2:
        return Model({}, settings)
    held, fair = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        (held if label else fair).update(text_features(text))
    n1 = sum(labels)
    ranked = [(*worth(n, fair[f], n1, len(labels) - n1, np.log, np.sqrt), f) for f, n in held.items() if n >= settings.seen]
    names = [f for _, rank, f in sorted((x for x in ranked if x[0] > 1), key=lambda x: (-x[1], x[2]))[: settings.features]]
    bag = Bag({f: i for i, f in enumerate(names)}, settings.remembered)
    return solve(Bags.of([(y, *bag.read(t)) for t, y in zip(texts, labels, strict=True)], len(names)), names, settings)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``settings.sample`` labelled rows for which ``allowed`` (of doc_id) holds; see ``sample_rows``.

    Of several labels of one id the largest counts.  Null texts count as empty.  Without both labels, or without
    any row, all weights are 0.
    """
    s = settings
    rows = sample_rows(docs, labels, allowed, s.sample, F.max, id_col, text_col, label_col)
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, s)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[y].update(text_features(text))
        names = sorted(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([held[y][f] for f in names], pa.int64()) for y in (1, 0))], ["f", "held", "fair"])

    counts = bounded(rows.select("y", "text")).mapInArrow(count, "f string, held long, fair long").groupBy("f").agg(F.sum("held").alias("held"), F.sum("fair").alias("fair"))
    odds, rank = worth(F.col("held"), F.col("fair"), sizes[1], sizes[0], F.log, F.sqrt)
    names = [r["f"] for r in counts.where(F.col("held") >= s.seen).where(odds > 1).orderBy(rank.desc(), "f").limit(s.features).select("f").collect()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Bag({f: i for i, f in enumerate(names)}, s.remembered)
        for batch in batches:
            found = [bag.read(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([p for p, _ in found], pa.int64()), pa.array([list(c) for _, c in found], pa.list_(pa.list_(pa.int32()))), pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64()))],
                ["doc_id", "sha", "y", "plain", "sets", "times"])

    bags = bounded(rows).mapInArrow(read, f"doc_id {dict(rows.dtypes)['doc_id']}, sha string, y int, plain long, sets array<array<int>>, times array<long>").toArrow().sort_by([("doc_id", "ascending"), ("sha", "ascending")])
    table = zip(*(bags[c].to_pylist() for c in ("y", "plain", "sets", "times")), strict=True)
    model = solve(Bags.of([(y, plain, Counter(dict(zip(map(tuple, sets), times, strict=True)))) for y, plain, sets, times in table], len(names)), names, s)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for every input row: id, score, predicted, offending (start, end and score of sentences).

    Null and empty texts have no sentence, so their score is 0.  Texts of any length are read whole.
    Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    Spans count code points; ``end`` is exclusive.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weights, settings, mark = model.weights, model.settings, model.mark()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("toxicity", mark), lambda: Model(weights, settings))
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b, "score": s} for a, b, s in offend] for _, offend in found]
            columns = [batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "offending"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    return bounded(rows).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The input's rows whose text scores below ``threshold``, with all their columns, in one pass."""
    weights, settings, mark, at = model.weights, model.settings, model.mark(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("toxicity", mark), lambda: Model(weights, settings))
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "")[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)
