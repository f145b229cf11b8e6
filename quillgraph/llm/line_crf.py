"""Document quality from a linear-chain conditional random field over lines.

Method: each line with a word is labelled good or bad.  A line's evidence is a
linear function of its own features and those of the lines before and after it;
transition weights tie neighbouring labels.  Features are shares of characters,
repetition within the line, and the mean log odds of its words (hashed) between
good and bad documents.  Forward-backward gives each line's marginal of being
good, and their mean, weighted by line length, is the quality of the document.

The field is trained on a sample of labelled documents (about ``SAMPLE_PER_LABEL``
of each label, by a hash of the id), on all lines of each.  Labels are given for
documents, so training runs twice: first every line by itself has the label of its
document; then lines whose own evidence speaks against it change sides, unless most
of the text would, and the whole field learns, now with neighbours that differ.
Word odds of a training document come from the other half of the sample.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import column, map_batches, record
from quillgraph.llm.language_id import with_columns

SAMPLE_PER_LABEL = 700
THRESHOLD = 0.3
# Buckets of word odds, and how much a line's own evidence must speak against its document.
BUCKETS, AGAINST = 1 << 14, 0.65
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = b"0123456789"
_MARKS = b"#*$%&|<>{}[]\\^~=_@"
_STOPS = b"!?.,;:"
_SPACES = b" \t\n\x0b\x0c\r"


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class _Odds(dict):
    """Log odds of words, remembered up to a bounded count."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        value = float(self.table[bucket(word)])
        if len(word) <= 64:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


def word_odds(documents: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Log odds of each bucket between good and bad documents; a document counts a bucket once."""
    counts = np.full((2, BUCKETS), 0.5)
    for buckets, y in documents:
        counts[y, np.unique(buckets)] += 1
    share = counts / (np.array([sum(y == k for _, y in documents) for k in (0, 1)]) + 1.0)[:, None]
    return (np.log(share[1]) - np.log(share[0])).astype(np.float32)


def line_features(line: bytes) -> list[float]:
    """Features of one line that has a word."""
    words = line.split()
    n, size = len(words), len(line)
    upper, lower, digits, marks, stops = (size - len(line.translate(None, s)) for s in (_UPPER, _LOWER, _DIGITS, _MARKS, _STOPS))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n),
        upper / size,
        lower / size,
        digits / size,
        marks / size,
        stops / size,
        len(set(words)) / n,
        (pairs / (n - 1)) if n > 1 else 1.0,
        (size - n) / n / 10.0,
        float(line.rstrip()[-1:] in (b".", b"!", b"?")),
        float(marks >= n / 4),
        min(1.0, 3.0 * max(0.0, 0.6 - len(set(words)) / n)) if n >= 8 else 0.0,
    ]


def worded_lines(text: str | None) -> list[bytes]:
    return [line for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if line.strip()]


def shape(lines: list[bytes]) -> np.ndarray:
    """Features of each line by itself, without its words' odds."""
    own = np.array([line_features(line) for line in lines])
    again = np.array([float(a == b) for a, b in zip(lines, [None, *lines[:-1]], strict=True)])
    return np.column_stack((own, again))


def with_neighbours(own: np.ndarray) -> np.ndarray:
    blank = np.zeros((1, own.shape[1]))
    return np.hstack((own, np.vstack((blank, own[:-1])), np.vstack((own[1:], blank))))


class LineField:
    """Weights of the field; state 1 is good."""

    def __init__(self, prior: float):
        self.prior = prior
        self.mean = self.scale = self.weights = None
        self.bias, self.move, self.odds = 0.0, np.zeros((2, 2)), np.zeros(BUCKETS, np.float32)
        self._known: _Odds | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": None}

    @property
    def trained(self) -> bool:
        return self.weights is not None

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)

    def marginals(self, evidence: np.ndarray) -> np.ndarray:
        """P(good) of each line, by forward-backward with normalised messages."""
        n = len(evidence)
        gain = np.exp(evidence).tolist()
        (a00, a01), (a10, a11) = np.exp(self.move - self.move.max()).tolist()
        forward, p = [], gain[0] / (1 + gain[0])
        forward.append(p)
        for k in range(1, n):
            one = gain[k] * (p * a11 + (1 - p) * a01)
            p = one / (one + p * a10 + (1 - p) * a00)
            forward.append(p)
        out, b = [0.0] * n, 0.5
        for k in range(n - 1, -1, -1):
            f = forward[k]
            good = f * b
            out[k] = good / (good + (1 - f) * (1 - b))
            one, none = a11 * gain[k] * b + a10 * (1 - b), a01 * gain[k] * b + a00 * (1 - b)
            b = one / (one + none)
        return np.array(out)

    def score(self, text: str | None) -> float:
        """Quality from 0 to 1; the prior for texts without a word or an untrained field."""
        if not self.trained:
            return self.prior
        lines = worded_lines(text)
        if not lines:
            return self.prior
        if self._known is None:
            self._known = _Odds(self.odds)
        known, words = self._known.__getitem__, [line.split() for line in lines]
        odds = np.array([sum(map(known, w)) / len(w) for w in words])
        sizes = np.array([len(line) for line in lines], float)
        good = self.marginals(self.evidence(with_neighbours(np.column_stack((shape(lines), odds)))))
        return float(np.clip((good * sizes).sum() / sizes.sum(), 0.0, 1.0))


class Sequences:
    """Labelled sequences side by side, longest first, so that each step over lines takes a leading part of them.

    Line k of all sequences that have one stands in rows at[k] to at[k + 1], so
    nothing is padded.
    """

    def __init__(self, data: list[tuple[np.ndarray, np.ndarray, float]]):
        self.order = sorted(range(len(data)), key=lambda i: -len(data[i][0]))
        data = [data[i] for i in self.order]
        sizes = np.array([len(x) for x, *_ in data])
        self.live = [int((sizes > k).sum()) for k in range(sizes[0])]
        self.at = np.concatenate(([0], np.cumsum(self.live))).tolist()
        self.n, self.rows, self.d = len(data), self.at[-1], data[0][0].shape[1]
        self.x, self.y, weight = np.empty((self.rows, self.d), np.float32), np.empty(self.rows), np.empty(self.rows)
        self.places = [np.array(self.at[:m]) + i for i, m in enumerate(sizes)]
        for own, (x, y, w) in zip(self.places, data, strict=True):
            self.x[own], self.y[own], weight[own] = x, y, w
        self.weight, self.total = weight, weight.sum()
        self.before = np.arange(self.n, self.rows) - np.repeat(self.live[:-1], self.live[1:])

    def gradient(self, theta: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """Penalised conditional log-likelihood per unit of weight, and its gradient.

        All lines of a sequence weigh alike.
        """
        at, live, n, d, weight, y = self.at, self.live, self.n, self.d, self.weight, self.y
        w, bias, move = theta[:d], theta[d], theta[d + 1 :].reshape(2, 2)
        evidence = np.clip(self.x @ w.astype(np.float32) + bias, -30, 30).astype(float)
        gain, a = np.exp(evidence), np.exp(move)
        fwd, back, norm = np.empty((self.rows, 2)), np.empty((self.rows, 2)), np.empty(self.rows)
        fwd[:n] = np.stack((np.ones(n), gain[:n]), 1)
        norm[:n] = fwd[:n].sum(1)
        fwd[:n] /= norm[:n, None]
        for k in range(1, len(live)):
            nxt = fwd[at[k - 1] : at[k - 1] + live[k]] @ a
            nxt[:, 1] *= gain[at[k] : at[k + 1]]
            norm[at[k] : at[k + 1]] = nxt.sum(1)
            fwd[at[k] : at[k + 1]] = nxt / norm[at[k] : at[k + 1], None]
        last = np.full((n, 2), 0.5)
        for k in range(len(live) - 1, -1, -1):
            msg = back[at[k] : at[k + 1]] = last[: live[k]]
            new = (msg * np.stack((np.ones(live[k]), gain[at[k] : at[k + 1]]), 1)) @ a.T
            last[: live[k]] = new / new.sum(1, keepdims=True)
        good = fwd * back
        good = good[:, 1] / good.sum(1)
        back[:, 1] *= gain
        pair = fwd[self.before][:, :, None] * a[None] * back[n:, None, :]
        later = weight[n:]
        expected = (pair * (later / pair.sum((1, 2)))[:, None, None]).sum(0)
        now, then = y[n:], y[self.before]
        observed = np.array([[(later * (1 - then) * (1 - now)).sum(), (later * (1 - then) * now).sum()], [(later * then * (1 - now)).sum(), (later * then * now).sum()]])
        miss = (y - good) * weight
        value = ((weight * (y * evidence - np.log(norm))).sum() + (observed * move).sum()) / self.total - penalty / 2 * (theta**2).sum()
        return value, np.concatenate((miss.astype(np.float32) @ self.x, [miss.sum()], (observed - expected).ravel())) / self.total - penalty * theta


def _climb(sequences: Sequences, theta: np.ndarray, steps: int, rate: float, penalty: float, chain: bool = True) -> np.ndarray:
    """Gradient steps; without ``chain`` the transitions stay as they are."""
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = sequences.gradient(theta, penalty)[1]
        if not chain:
            grad[-4:] = 0.0
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta


def line_labels(alone: np.ndarray, sizes: np.ndarray, y: int) -> np.ndarray:
    """Labels of a document's lines: its own label, but for lines whose chance of being good clearly says otherwise."""
    out = np.full(len(sizes), float(y))
    turned = alone < 1 - AGAINST if y else alone > AGAINST
    if turned.any() and 2 * sizes[turned].sum() < sizes.sum():
        out[turned] = 1.0 - y
    return out


def train(samples: list[tuple[np.ndarray, np.ndarray, list[np.ndarray], int]], prior: float, steps: int = 120, rate: float = 0.08, penalty: float = 1e-3) -> LineField:
    """Fits the field to (line shapes, line sizes, word buckets of each line, label of the document)."""
    field = LineField(prior)
    samples = [d for d in samples if len(d[1])]
    if len({d[3] for d in samples}) < 2:
        return field
    held = [(np.concatenate(words), y) for _, _, words, y in samples]
    field.odds = word_odds(held)
    y = np.array([d[3] for d in samples], float)
    # Both halves have as many of each label.
    half = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 2
    odds = [word_odds([d for d, h in zip(held, half, strict=True) if h != k]) for k in (0, 1)]
    x = [with_neighbours(np.column_stack((own, [odds[h][w].mean() for w in words]))) for (own, _, words, _), h in zip(samples, half, strict=True)]
    rows = np.concatenate(x)
    field.mean, field.scale = rows.mean(0), rows.std(0) + 1e-6
    x = [((own - field.mean) / field.scale).astype(np.float32) for own in x]
    # Each document counts once, however many lines it has, and both labels weigh alike.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / [len(own) for own in x]
    labels = [np.full(len(own), v) for own, v in zip(x, y, strict=True)]
    theta = np.zeros(x[0].shape[1] + 5)
    d = x[0].shape[1]
    theta = _climb(Sequences(list(zip(x, labels, weight, strict=True))), theta, steps, rate, penalty, chain=False)
    alone = [1 / (1 + np.exp(-np.clip(own @ theta[:d] + theta[d], -30, 30))) for own in x]
    labels = [line_labels(p, sizes, v) for p, (_, sizes, _, v) in zip(alone, samples, strict=True)]
    theta = _climb(Sequences(list(zip(x, labels, weight, strict=True))), theta, steps, rate, penalty)
    field.weights, field.bias, field.move = theta[:d], float(theta[d]), theta[d + 1 :].reshape(2, 2)
    return field


def prepared(text: str | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Line shapes, line sizes and word buckets of a whole text."""
    lines = worded_lines(text)
    return (shape(lines) if lines else np.empty((0, 0))), np.array([len(x) for x in lines], float), [np.array([bucket(w) for w in line.split()], np.int32) for line in lines]


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> LineField:
    """Trains on about ``per_label`` of the labelled ids of each label that satisfy ``where`` (written on column ``id``).

    Labels other than 0 and 1, and ids with both, are left out; of several texts
    of one id one is taken.  Lines are read on the executors; what they are made
    of, numbers for each line and word of the sample, comes to the driver.
    """
    named = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (F.lit(True) if where is None else where))
    named = named.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    shares = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    # A cut through a hash of the ids: nothing is sorted, and the sample can go to every task.
    cut = F.when(F.col("y") == 1, F.lit(_cut(per_label, shares.get(1, 0)))).otherwise(F.lit(_cut(per_label, shares.get(0, 0))))
    sample = F.broadcast(named.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < cut))
    texts = docs.select(F.col(f"`{id_col}`").alias("own"), F.col(f"`{text_col}`").alias("text")).join(sample, F.col("own") == F.col("id"))
    texts = texts.groupBy("id", "y").agg(F.min("text").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [prepared(t) for t in column(batch, "text")]
            words = [np.concatenate(w) if w else np.empty(0, np.int32) for *_, w in rows]
            return record(
                id=batch.column(0), y=batch.column(1), shapes=pa.array([r[0].ravel() for r in rows], pa.list_(pa.float64())), sizes=pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                counts=pa.array([[len(w) for w in r[2]] for r in rows], pa.list_(pa.int32())), words=pa.array(words, pa.list_(pa.int32())),
            )

        return work

    kind = texts.schema["id"].dataType.simpleString()
    got = map_batches(texts, make, f"id {kind}, y int, shapes array<double>, sizes array<double>, counts array<int>, words array<int>").toArrow()
    samples = []
    for i in sorted(range(len(got)), key=lambda i: str(got["id"][i].as_py())):
        sizes, counts = (np.asarray(got[c][i].values) for c in ("sizes", "counts"))
        shapes, words = (np.asarray(got[c][i].values) for c in ("shapes", "words"))
        samples.append((shapes.reshape(len(sizes), -1), sizes, np.split(words, np.cumsum(counts)[:-1]) if len(counts) else [], got["y"][i].as_py()))
    return train(samples, prior)


def _cut(wanted: int, there: int) -> int:
    return min(1 << 30, -(-wanted * (1 << 30) // max(there, 1)))


def score(docs: DataFrame, field: LineField, threshold: float = THRESHOLD, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns of ``keep`` with score and predicted for every row.

    A null or empty text, or one without words, gets the share of good labels.
    Columns named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = with_columns(docs, docs.columns if keep is None else keep, ["score", "predicted"])
    slim = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__qg_text"))
    schema = slim.drop("__qg_text").schema.add("score", "double").add("predicted", "integer")

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.score(t) for t in column(batch, "__qg_text")]
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], names=[*names, "score", "predicted"])

        return work

    return map_batches(slim, make, schema)
