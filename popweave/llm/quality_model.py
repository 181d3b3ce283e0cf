"""Quality classifier trained from weak labels.

Overlapping heuristic labellers vote on every document (good, bad or abstain).
Expectation-maximisation over the counts of their vote patterns - at most
3**7, over all documents - estimates each labeller's accuracy and the share of
good documents. The posterior of a document's pattern is its weak label, and
weak labels train a linear scorer on hashed features, which generalises beyond
the labellers. No hand label is used; hand labels only measure the result.
Texts are read three times and never shuffled: for the votes, for the sample's
vectors, and for votes and scores together.

The scorer is fitted on a bounded sample: the ``SAMPLE`` documents with the
smallest hash of their id and text (a documented bound; the vectors have
``DIMENSIONS`` entries each, whatever the texts' lengths). Vote counts, weak
labels and scores cover all documents.

Defined results
* null text counts as empty: all labellers but the length one abstain; where
  all abstain, the weak label is the share of good documents.
* repeated rows get equal scores; an empty table gives no rows; of documents with
  equal hashes one is in the sample.
* a score of exactly the threshold is good; texts of any length are read whole;
  further columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popweave.llm._store import scoped, stored
from popweave.llm._words import Words, mix, slices, utf8, words
from popweave.llm.quality_rules import measure_texts

SAMPLE = 6000
DIMENSIONS = 4096
LABELLERS = ("symbols", "dup_lines", "repeats", "word_length", "stopwords", "length", "shouting")

# Frequent function words of the corpus's languages.
STOPWORDS = (
    "the of and to in is that for it was on are as with his they at be this from have or by "
    "le la les de des du un une et en est que qui dans pour sur par pas au aux avec ce il "
    "der die das und ist nicht von zu mit den dem ein eine sich des auf für im als auch es an "
    "el los las del y que no por con para una su al lo como más pero sus se"
).split()


def stop_hashes() -> np.ndarray:
    return np.unique(words([" ".join(STOPWORDS).encode()]).hashes)


def three(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Votes as characters: 0 where bad, 1 where good, - elsewhere."""
    return np.where(bad, "0", np.where(good, "1", "-")).astype("U1") if len(value) else np.zeros(0, "U1")


def vote_texts(texts: list[bytes], w: Words, stops: np.ndarray) -> list[str]:
    c = measure_texts(texts)
    n = np.maximum(c["n_words"], 1)
    some = c["n_words"] >= 10
    symbol, repeat, length = c["n_symbols"] / n, c["n_repeat_words"] / n, c["word_chars"] / n
    dup = c["n_dup_lines"] / np.maximum(c["n_lines"], 1)
    is_stop = np.isin(w.hashes, stops)
    total = np.concatenate([[0], np.cumsum(is_stop)])
    stop = (total[w.first[1:]] - total[w.first[:-1]]) / n
    loud = np.array([t.count(b"!!") for t in texts]) / n
    columns = (
        three(n, some & (symbol > 0.1), some & (symbol < 0.01)),
        three(n, some & (dup > 0.3), some & (dup < 0.05)),
        three(n, some & (repeat > 0.2), some & (repeat < 0.02)),
        three(n, some & ((length > 6.4) | (length < 3)), some & (length > 3.8) & (length < 5.8)),
        three(n, some & (stop < 0.08), some & (stop > 0.2)),
        three(n, c["n_words"] == 0, c["n_words"] >= 50),
        three(n, some & (loud > 0.2), some & (loud < 0.01)),
    )
    return ["".join(v) for v in zip(*(x.tolist() for x in columns), strict=True)]


def vectors(texts: list[bytes], w: Words) -> np.ndarray:
    """Hashed word and word-ending frequencies, of length 1 (0 for no words)."""
    data = np.frombuffer(b"\n".join([*texts, b"\n"]), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    letter = data.copy()
    letter[(data >= 97) & (data <= 122) | (data >= 128)] = 97
    letter[(data >= 65) & (data <= 90)] = 65
    letter[(data >= 48) & (data <= 57)] = 48
    end = w.end + base[owner]
    tail = np.zeros(len(end), np.uint64)
    for k in (3, 2, 1):
        at = np.maximum(end - k, w.start + base[owner])
        tail = tail * np.uint64(256) + letter[at]
    tail = tail * np.uint64(16) + np.minimum(w.end - w.start, 15).astype(np.uint64)
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    for h in (w.hashes, mix(tail)):
        out += np.bincount(owner * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64), minlength=len(out)).astype(np.float32)
    out = out.reshape(len(texts), DIMENSIONS)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


@dataclass
class LabelModel:
    prior: float
    accuracy: dict[str, tuple[float, float]]  # of each labeller on bad and on good documents
    posterior: dict[str, float]


def fit_labels(counts: dict[str, int], rounds: int = 60) -> LabelModel:
    """EM over vote patterns, with conditionally independent labellers."""
    pattern = sorted(counts)
    n = np.array([counts[p] for p in pattern], float)
    cell = np.array([["01-".index(c) for c in p] for p in pattern]).reshape(len(pattern), len(LABELLERS)).astype(np.int64)
    q = np.array([0.9 if p.count("0") < 2 else 0.1 for p in pattern])
    accuracy: dict[str, tuple[float, float]] = {}
    prior = 0.5
    for _ in range(rounds):
        prior = float((n @ q + 1) / (n.sum() + 2)) if len(n) else 0.5
        log = np.stack([np.full(len(q), math.log(1 - prior)), np.full(len(q), math.log(prior))])
        for j in range(cell.shape[1]):
            right = []
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                # Pseudo-counts say that a labeller is right more often than not.
                # An abstention says nothing.
                p = np.bincount(cell[:, j], w, 3)[:2] + ((8, 2), (2, 8))[c]
                p = p / p.sum()
                log[c] += np.append(np.log(p), 0.0)[cell[:, j]]
                right.append(float(p[c]))
            accuracy[LABELLERS[j]] = (right[0], right[1])
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
    return LabelModel(prior, accuracy, dict(zip(pattern, q.tolist(), strict=True)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights and bias of a logistic scorer for soft labels (gradient descent with momentum)."""
    w = np.zeros(x.shape[1] + 1, np.float32)
    step = np.zeros_like(w)
    y = y.astype(np.float32)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        g = (p - y) / len(y)
        grad = np.concatenate([x.T @ g + 2e-5 * w[:-1], [g.sum()]])
        step = 0.9 * step - 4.0 * grad
        w += step
    return w


def label_documents(docs: DataFrame) -> DataFrame:
    """key (a hash of id and text) and votes of every document."""
    stops = stop_hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(vote_texts(texts, words(texts), stops), pa.string())], ["key", "votes"])

    return _keyed(docs).select("key", "text").mapInArrow(run, "key long, votes string")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def _vectors_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                x = vectors(texts, words(texts)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "x"])

    return docs.select("key", "text").mapInArrow(run, "key long, x binary")


def train(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """The label model of all documents, and the scorer of the bounded sample."""
    model = fit_labels({r.votes: r.n for r in labelled.groupBy("votes").agg(F.count("*").alias("n")).collect()})
    chosen = {r.key: r.votes for r in labelled.select("key", "votes").orderBy("key").limit(sample).collect()}
    near = _keyed(docs)
    near = near.where(F.col("key") <= F.lit(max(chosen))) if chosen else near.limit(0)
    rows = sorted(_vectors_of(near.dropDuplicates(["key"])).collect(), key=lambda r: r.key)
    x = np.stack([np.frombuffer(r.x, np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, DIMENSIONS), np.float32)
    y = np.array([model.posterior[chosen[r.key]] for r in rows])
    return model, fit_scorer(x, y)


def score_documents(docs: DataFrame, model: LabelModel, weights: np.ndarray) -> DataFrame:
    """doc_id, votes, weak_label and score (0 to 1) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stops = stop_hashes()
    sent = docs.sparkSession.sparkContext.broadcast((model.posterior, weights.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                own = words(texts)
                votes = vote_texts(texts, own, stops)
                z = np.concatenate([vectors(texts[i : i + 256], _rows(own, i, i + 256)) @ w[:-1] for i in range(0, len(texts), 256)]) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(votes, pa.string()), pa.array([posterior[v] for v in votes], pa.float64()), pa.array(score, pa.float64())], ["doc_id", "votes", "weak_label", "score"])

    return _keyed(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes string, weak_label double, score double")


def _rows(w: Words, a: int, b: int) -> Words:
    first = w.first[a : b + 1]
    s = slice(first[0], first[-1])
    return Words(w.hashes[s], w.start[s], w.end[s], first - first[0])


@scoped
def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, votes, weak_label (posterior), score and good for every document."""
    model, weights = train(docs, stored(label_documents(docs), "votes"), sample)
    return score_documents(docs, model, weights).withColumn("good", F.col("score") >= threshold)
