"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Each line has features of its own and those of the lines before and after it. Two states, transition weights and start
weights are fitted by maximum likelihood on labelled documents, whose lines all take the document's label. A document's
score is the mean of its lines' forward-backward marginals, weighted by the lines' lengths, mapped to a probability by a
logistic curve fitted on the same documents.

The fit uses a bounded sample: the `train_docs` labelled rows of smallest hash, of those that the caller allows (here:
crc32 of the id mod 5 is not 0). Scoring reads every whole text; the model is a few dozen numbers.

Defined cases: a null or empty text is one empty line and gets a score too; labels that are null are not learned from,
several labels of one id count as their maximum; with fewer than two classes every score is 0.5; rows that share an id
are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows

N_OWN = 14
BYTE_CLASS = np.zeros(256, dtype=np.uint8)
for chars, number in ((b"#*$%&<>", 1), (b"|", 2), (b"!?", 3), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), (b"abcdefghijklmnopqrstuvwxyz", 5), (b"0123456789", 6), (b".,;:", 7), (b" \t\n\x0b\x0c\r", 8)):
    BYTE_CLASS[list(chars)] = number


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    n_lines = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    joined = ("\n".join(texts) + "\n").encode("utf-8", "surrogatepass")
    buf = np.frombuffer(joined, dtype=np.uint8)
    kind = BYTE_CLASS[buf]
    ends = np.flatnonzero(buf == 10)
    starts = np.r_[0, ends[:-1] + 1]
    sums = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(9)]
    length = (ends - starts + 1 - sums[8]).astype(float)  # without white space
    space = kind == 8
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    line = np.searchsorted(starts, begins, side="right") - 1
    number = count()
    table: dict[bytes, int] = defaultdict(number.__next__)
    ids = np.fromiter(map(table.__getitem__, joined.split()), dtype=np.int64, count=len(begins))
    m = len(starts)
    words = np.bincount(line, minlength=m).astype(float)
    again = np.bincount(line[1:][(ids[1:] == ids[:-1]) & (line[1:] == line[:-1])], minlength=m) if len(ids) > 1 else np.zeros(m)
    pair = np.unique(line * (next(number) + 1) + ids)
    distinct = np.bincount(pair // (len(table) + 1), minlength=m)[:m] if len(ids) else np.zeros(m)
    repeated = np.zeros(m)
    at = 0
    for t in texts:
        seen: set[str] = set()
        for x in t.split("\n"):
            if x in seen:
                repeated[at] = 1
            elif len(x) > 8:
                seen.add(x)
            at += 1
    w, c = np.maximum(words, 1), np.maximum(length, 1)
    letters = np.maximum(sums[4] + sums[5], 1)
    own = np.column_stack(
        [
            np.log1p(words) / 4,
            length / w / 10,
            np.minimum(sums[1] / w, 3),
            np.minimum(sums[2] / w, 2),
            np.minimum(sums[3] / w, 2),
            sums[4] / letters,
            (sums[4] > 0.6 * letters) & (words > 2),
            sums[6] / c,
            np.minimum(sums[7] / w, 2),
            again / w,
            1 - distinct / w * (words > 0),
            repeated,
            words == 0,
            words < 4,
        ]
    ).astype(float)
    first = np.r_[0, np.cumsum(n_lines)[:-1]]
    before, after = np.vstack([np.zeros((1, N_OWN)), own[:-1]]), np.vstack([own[1:], np.zeros((1, N_OWN))])
    before[first] = 0
    after[first + n_lines - 1] = 0
    return np.hstack([np.ones((m, 1)), own, before, after]), length + 1, n_lines


def marginals(emission: np.ndarray, n_lines: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward-backward for all texts at once. Returns P(good) of each line, expected transitions, log-likelihood parts."""
    order = np.argsort(-n_lines, kind="stable")
    first = np.r_[0, np.cumsum(n_lines)[:-1]][order]
    sizes = n_lines[order]
    steps = int(sizes[0]) if len(sizes) else 0
    e = np.column_stack([np.zeros(len(emission)), np.clip(emission, -30, 30)])
    e = np.exp(e - e.max(1, keepdims=True))
    T, s = np.exp(trans), np.exp(start)
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty(len(e))
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # texts with more than t lines
    for t in range(steps):
        at = first[: live[t]] + t
        a = (alpha[at - 1] @ T if t else s[None, :]) * e[at]
        scale[at] = z = a.sum(1)
        alpha[at] = a / z[:, None]
    moves = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        at = first[: live[t]] + t
        beta[at] = 1.0
        if t + 1 < steps:
            more = first[: live[t + 1]] + t
            ahead = e[more + 1] * beta[more + 1] / scale[more + 1][:, None]
            beta[more] = ahead @ T.T
            moves += T * (alpha[more].T @ ahead)
    return alpha * beta, moves, np.log(scale)


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[str]) -> np.ndarray:
        x, length, n = line_features(texts)
        good = marginals(((x - self.mean) / self.spread) @ self.weights, n, self.trans, self.start)[0][:, 1]
        doc = np.repeat(np.arange(len(n)), n)
        return np.bincount(doc, good * length, len(n)) / np.bincount(doc, length, len(n))

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        p = np.clip(self.raw(texts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def fit(texts: list[str], labels: list[int], rounds: int = 25, l2: float = 1e-3) -> Model:
    """Maximum likelihood: a logistic start for the line weights, then gradient steps on the whole chain."""
    y = np.array(labels, dtype=float)
    k = 1 + 3 * N_OWN
    flat = Model(np.zeros(k), np.zeros((2, 2)), np.zeros(2), np.zeros(k), np.ones(k), 0.0, 0.0)
    if len(set(labels)) < 2:
        return flat
    x, length, n = line_features(texts)
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[spread < 1e-9] = 0, 1
    x = (x - mean) / spread
    first = np.r_[0, np.cumsum(n)[:-1]]
    target = np.repeat(y, n)
    share = 1 / np.repeat(np.minimum(n, 20), n) ** 0.5  # very long texts don't outvote the others
    w = np.zeros(k)
    for _ in range(8):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = share * p * (1 - p) + 1e-6
        w += np.linalg.solve((x * h[:, None]).T @ x + l2 * len(y) * np.eye(k), x.T @ (share * (target - p)) - l2 * len(y) * w)
    theta = np.concatenate([w * 0.5, [1.0, -1.0, -1.0, 1.0], [0.0, 0.0]])
    seen_moves = np.zeros((2, 2))
    for s in (0, 1):
        seen_moves[s, s] = (n[y == s] - 1).sum()
    m1 = m2 = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, moves, _ = marginals(x @ theta[:k], n, theta[k : k + 4].reshape(2, 2), theta[k + 4 :])
        grad = np.concatenate(
            [
                x.T @ (target - good[:, 1]),
                (seen_moves - moves).ravel(),
                [(1 - y).sum() - good[first, 0].sum(), y.sum() - good[first, 1].sum()],
            ]
        ) / len(y) - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:k], theta[k : k + 4].reshape(2, 2), theta[k + 4 :], mean, spread)
    p = np.clip(model.raw(texts), 1e-4, 1 - 1e-4)
    z = np.column_stack([np.log(p / (1 - p)), np.ones(len(p))])
    ab = np.array([0.5, 0.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(z @ ab, -30, 30)))
        h = q * (1 - q) + 1e-6
        ab = ab + np.linalg.solve((z * h[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - q) - 0.1 * ab)
    model.slope, model.shift = float(max(ab[0], 0.0)), float(ab[1])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int = 1200) -> tuple[list[str], list[int]]:
    """At most `train_docs` labelled texts that are not held out, by smallest hash of the id."""
    own = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label_value")).dropna()
    own = own.filter(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0)
    own = own.groupBy("label_id").agg(F.max("label_value").alias("label_value"))
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(train_docs)
    got = docs.select(F.col("doc_id").alias("label_id"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(own), "label_id")
    got = got.orderBy("label_id", "t").limit(train_docs).select("t", "label_value").collect()
    return [r[0] for r in got], [r[1] for r in got]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def rows(batch):
        texts = [t or "" for _, t in batch]
        return [(i, float(s)) for (i, _), s in zip(batch, model.score(texts))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), rows, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of docs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    import pyarrow as pa

    from .common import releasing, small_batches

    small_batches(docs.sparkSession)
    at, kind = docs.columns.index("text"), to_arrow_schema(docs.schema)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kind)], schema=kind).filter(pa.array(model.score(texts) >= threshold, type=pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = scores(docs, fit(*training_rows(docs, labels)))
    return got.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
