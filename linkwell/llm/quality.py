"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled texts gives a vocabulary, its inverse document frequencies and a
truncated singular value decomposition; the labelled vectors are broadcast.  Every document is
projected, and blocks of documents are multiplied with all labelled vectors, so cosines are exact.
The nearest ones vote for their label with a weight that grows with their similarity; those as near as the last
of them vote too.  How many vote is chosen on the labelled rows: each is scored by the others, and the
number with the least squared error, both labels weighing alike, is taken.

Training takes a bounded number of labelled rows, whole texts of any length.  The texts stay on the executors, which
count terms and then send the driver each document's counts of the chosen terms.

Terms are words, and signs of a text's shape: marks that stick to words or stand alone, letter case,
immediate repetitions.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwell.llm.batches import bounded, kept
from linkwell.llm.labelled import sample_rows
from linkwell.storage import discard, materialize

_RUN = re.compile(r"(.)\1+", re.S)
_EDGE = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows used; ``words``, ``signs``: most terms kept of each kind, each in at least ``seen`` texts.
    ``size``: axes of the latent space.  ``digits``: decimals at which cosines count as equal.  ``block``: documents multiplied at once.  ``remembered``: most tokens kept in a projector's table.
    ``neighbours``: the numbers of neighbours to choose from."""

    sample: int = 4000
    words: int = 2000
    signs: int = 400
    seen: int = 3
    size: int = 32
    neighbours: tuple[int, ...] = (3, 5, 9, 15)
    digits: int = 9
    sharpness: float = 4.0
    sign_weight: float = 3.0
    block: int = 256
    remembered: int = 200_000


def token_terms(token: str) -> tuple[str, ...]:
    """The terms of a token: its word, its marks (a run of one mark as two), its case.  Terms that aren't words begin with \\0."""
    before, word, after = _EDGE.match(token).groups()
    terms = [word.lower()] if word else []
    if marks := before + after:
        terms.append("\0" + _RUN.sub(r"\1\1", marks))
    if len(word) > 1 and word.isupper():
        terms.append("\0upper")
    if any(c.isdigit() for c in word):
        terms.append("\0digit")
    return tuple(terms)


def counts(text: str) -> tuple[Counter, int]:
    """Tokens with their numbers, and how often one repeats the token before it."""
    tokens = text.split()
    return Counter(tokens), sum(map(eq, tokens, tokens[1:]))


def bag_of(text: str) -> Counter:
    """A text's terms with their numbers."""
    tokens, repeats = counts(text)
    bag: Counter = Counter()
    for t, c in tokens.items():
        for x in token_terms(t):
            bag[x] += c
    if repeats:
        bag["\0repeat"] = repeats
    return bag


@dataclass
class Model:
    """What is sent to the executors; its size is bounded by the settings."""

    terms: dict[str, int]
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    settings: Settings
    voters: int = 15

    def project(self, ids: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The latent vector of counts of terms, in double precision; zero without terms."""
        out = (np.log1p(number) * self.idf[ids]) @ self.axes[ids]
        size = np.linalg.norm(out)
        return out / size if size > 0 else out

    def vectorise(self, texts: list[str]) -> np.ndarray:
        """Unit rows of the latent space; a text without known terms has a zero row."""
        out = np.zeros((len(texts), self.axes.shape[1]))
        known = self.__dict__.setdefault("known", {})
        for i, text in enumerate(texts):
            tokens, repeats = counts(text)
            ids, n = [], []
            for t, c in tokens.items():
                found = known.get(t)
                if found is None:
                    found = tuple(self.terms[x] for x in token_terms(t) if x in self.terms)
                    if len(t) <= 64:
                        if len(known) >= self.settings.remembered:
                            known.clear()
                        known[t] = found
                for x in found:
                    ids.append(x)
                    n.append(c)
            if repeats and (x := self.terms.get("\0repeat")) is not None:
                ids.append(x)
                n.append(repeats)
            if ids:
                place, back = np.unique(ids, return_inverse=True)
                out[i] = self.project(place, np.bincount(back, n))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """The weighted share of label 1 among the nearest labelled vectors, 0 to 1."""
        out = np.zeros(len(texts))
        s = self.settings
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        for k in range(0, len(texts), s.block):
            block = texts[k : k + s.block]
            if not len(self.labels):
                out[k : k + len(block)] = prior
                continue
            cosine = np.round(self.vectorise(block) @ self.vectors.T, s.digits)
            out[k : k + len(block)] = self.vote(cosine, self.voters, prior)
        return np.clip(out, 0, 1)

    def vote(self, cosine: np.ndarray, voters: int, prior: float) -> np.ndarray:
        """The weighted share of label 1 among the ``voters`` nearest of each row, and all that are as near as the last of them."""
        m = min(voters, cosine.shape[1])
        near = cosine >= np.partition(cosine, -m, axis=1)[:, [-m]]
        weight = np.where(near, np.maximum(cosine, 0), 0) ** self.settings.sharpness
        total = weight.sum(1)
        return np.where(total > 1e-9, weight @ self.labels / np.where(total > 1e-9, total, 1), prior)

    def choose_voters(self) -> int:
        """The number of neighbours that scores the labelled rows best when each is left out of its own vote."""
        s, n = self.settings, len(self.labels)
        if n < 2 or self.labels.min() == self.labels.max():
            return s.neighbours[-1]
        share = np.where(self.labels == 1, self.labels.sum(), n - self.labels.sum())
        error = dict.fromkeys(s.neighbours, 0.0)
        for k in range(0, n, s.block):
            cosine = np.round(self.vectors[k : k + s.block] @ self.vectors.T, s.digits)
            cosine[np.arange(len(cosine)), np.arange(k, k + len(cosine))] = -1
            for m in s.neighbours:
                gap = self.vote(cosine, m, float(self.labels.mean())) - self.labels[k : k + s.block]
                error[m] += float((gap**2 / share[k : k + s.block]).sum())
        return min(s.neighbours, key=lambda m: (round(error[m], s.digits), -m))


def solve(names: list[str], df: list[int], rows: list[tuple[int, list[int], list[int]]], s: Settings) -> Model:
    """The model of chosen terms, the numbers of texts that hold them, and (label, term places, counts) of each text."""
    idf = np.array([np.log(1 + len(rows) / n) * (s.sign_weight if x[0] == "\0" else 1) for x, n in zip(names, df, strict=True)])
    a = np.zeros((len(rows), len(names)), np.float32)
    for i, (_, ids, number) in enumerate(rows):
        a[i, ids] = np.log1p(number) * idf[ids] if len(ids) else 0
    size = np.linalg.norm(a, axis=1, keepdims=True)
    a /= np.where(size > 0, size, 1)
    k = min(s.size, *a.shape) if a.size else 0
    # a randomised range finder with four power steps
    q = np.random.default_rng(7).standard_normal((a.shape[1], k + min(16, a.shape[1] - k))).astype(np.float32) if k else np.zeros((a.shape[1], 0), np.float32)
    for _ in range(5 if k else 0):
        q = np.linalg.qr(a.T @ (a @ np.linalg.qr(q)[0]))[0]
    axes = (q @ np.linalg.svd(a @ q, full_matrices=False)[2].T)[:, :k] if k else q
    model = Model({x: i for i, x in enumerate(names)}, idf, np.ascontiguousarray(axes, np.float64), np.zeros((0, k)), np.array([y for y, _, _ in rows], np.float64), s)
    model.vectors = np.stack([model.project(np.array(ids, np.int64), np.array(number)) for _, ids, number in rows]) if rows else model.vectors
    model.voters = model.choose_voters()
    return model


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """A model of whole texts and their labels, on one machine."""
    s, bags = settings, [bag_of(t) for t in texts]
    df = Counter(x for bag in bags for x in bag)
    common = lambda signs, most: [x for x, n in sorted(df.items(), key=lambda p: (-p[1], p[0])) if n >= s.seen and (x[0] == "\0") == signs][:most]
    names = common(False, s.words) + common(True, s.signs)
    place = {x: i for i, x in enumerate(names)}
    rows = []
    for y, bag in zip(labels, bags, strict=True):
        held = sorted((place[x], c) for x, c in bag.items() if x in place)
        rows.append((y, [i for i, _ in held], [c for _, c in held]))
    return solve(names, [df[x] for x in names], rows, s)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``settings.sample`` labelled rows for which ``allowed`` (of doc_id) holds; see ``sample_rows``.

    Of several labels of one id the smallest counts.  Null texts count as empty.
    """
    s = settings
    rows = sample_rows(docs, labels, allowed, s.sample, F.min, id_col, text_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df.update(bag_of(text).keys())
        names = sorted(df)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([df[x] for x in names], pa.int64())], ["term", "df"])

    terms = bounded(rows.select("text")).mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= s.seen)
    terms = materialize(terms, "quality-terms")
    sign = F.ascii("term") == 0
    chosen = [r for signs, most in ((False, s.words), (True, s.signs)) for r in terms.where(sign == signs).orderBy(F.desc("df"), "term").limit(most).collect()]
    names, df = [r["term"] for r in chosen], [r["df"] for r in chosen]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(names)}
        for batch in batches:
            found = [sorted((place[x], c) for x, c in bag_of(t).items() if x in place) for t in batch.column(3).to_pylist()]
            columns = (pa.array([[x[j] for x in row] for row in found], pa.list_(pa.int64())) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "sha", "y", "ids", "number"])

    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, sha string, y int, ids array<long>, number array<long>"
    found = bounded(rows).mapInArrow(read, schema).toArrow().sort_by([("doc_id", "ascending"), ("sha", "ascending")])
    model = solve(names, df, list(zip(*(found[c].to_pylist() for c in ("y", "ids", "number")), strict=True)), s)
    discard(rows, terms)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for every input row: id, score, predicted.

    A text without known terms (null and empty ones among them) is near nothing and gets the share
    of label 1 in the sample.  Without any label every score is 0.5.  Texts of any length are read
    whole.  Repeated rows give repeated results; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent, mark = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("quality", mark), lambda: sent.value)
        for batch in batches:
            s = scorer.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return bounded(rows).mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int").withColumnRenamed("doc_id", id_col)
