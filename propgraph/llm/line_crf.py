"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad.  What speaks for either are features of the line and of its two
neighbours, and the labels of adjacent lines depend on each other.  Forward-backward gives the
probability that a line is good; the length-weighted mean over a document's lines, put on the scale of
the labels, is the document's quality.

Labels are known for documents only: all lines of a good document are taken as good; those of a bad
one begin as bad, and after each fit those that the field finds good are relabelled, all but its worst.

The field is fitted on the driver from a bounded sample: PER_LABEL documents of each label, of each
RUNS stretches of RUN lines, drawn by hash.  Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propgraph.llm.common import prepare, unused, whole_text
from propgraph.llm.language_id import blocks

PER_LABEL, RUNS, RUN = 1500, 4, 64
#: Rounds of fitting and relabelling, steps of each fit, and how much weights are held down.
ROUNDS, STEPS, RIDGE = 3, 120, 1e-3
#: A document is predicted good from this score on.
LEAST_SCORE = 0.3

LOWER, UPPER, LETTER, DIGIT, SPACE, BREAK, SIGN = range(7)
_classes: np.ndarray | None = None


def _class_of() -> np.ndarray:
    global _classes
    if _classes is None:
        found = np.full(0x110000, SIGN, "u1")
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                found[c] = UPPER if x.isupper() else LOWER if x.islower() else LETTER
            elif x.isdigit():
                found[c] = DIGIT
            elif x.isspace():
                found[c] = SPACE
        found[10] = BREAK
        _classes = found
    return _classes


NAMES = (
    "one", "length", "words", "upper", "digits", "signs", "spaces", "repeated", "adjacent", "word_length", "longest",
    "closed_by_sign", "lone_signs", "as_before", "begins_upper", "ends_sentence", "upper2", "signs2", "repeated2", "adjacent2",
)
WIDTH = 3 * len(NAMES)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of features, characters with the line break, lines per text): one row a line, of the line, the one before and the one after."""
    split = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in split], "i8")
    lines = [line for x in split for line in x]
    n = len(lines)
    codes = np.frombuffer("".join(line + "\n" for line in lines).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _class_of()[codes]
    ends = np.flatnonzero(kind == BREAK)
    begins = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - begins + 1
    owner = np.repeat(np.arange(n), sizes)
    of = np.bincount(owner * 7 + kind, minlength=7 * n).reshape(n, 7).astype("f8")
    blank = (kind == SPACE) | (kind == BREAK)
    sign = kind == SIGN
    before_blank = sign & np.concatenate([blank[1:], [True]])
    after_blank = np.concatenate([[True], blank[:-1]])
    closed = np.bincount(owner[before_blank], minlength=n)
    lone = np.bincount(owner[before_blank & after_blank], minlength=n)
    said = np.zeros((n, 5))
    last = ""
    firsts = set(np.concatenate([[0], np.cumsum(counts)[:-1]]).tolist())
    for k, line in enumerate(lines):
        words = line.split()
        if words:
            said[k] = len(words), len(set(words)), sum(map(eq, words, words[1:])), max(map(len, words)), k not in firsts and line == last
        last = line
    words = np.maximum(said[:, 0], 1)
    letters = np.maximum(of[:, :3].sum(1), 1)
    chars = np.maximum(sizes - 1, 1)
    upper, signs, repeated, adjacent = of[:, UPPER] / letters, of[:, SIGN] / chars, np.where(said[:, 0] > 0, 1 - said[:, 1] / words, 0), said[:, 2] / words
    own = np.stack(
        [
            np.ones(n), np.log1p(sizes) / 8, np.log1p(said[:, 0]) / 6, upper, of[:, DIGIT] / chars, signs, of[:, SPACE] / chars, repeated, adjacent,
            np.minimum((of[:, :4].sum(1) + of[:, SIGN]) / words / 10, 5), np.log1p(said[:, 3]) / 4, np.minimum(closed / words, 2), lone / words, said[:, 4],
            kind[begins] == UPPER, np.isin(codes[np.maximum(ends - 1, 0)], [33, 46, 63]) & (sizes > 1), upper**2, signs**2, repeated**2, adjacent**2,
        ],
        1,
    )
    first = np.isin(np.arange(n), list(firsts))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[first] = 0
    after[:-1] = own[1:]
    after[:-1][first[1:]] = 0
    return np.concatenate([own, before, after], 1), sizes, counts


def _running(m: np.ndarray) -> np.ndarray:
    """Products m[0], m[0] m[1], ... of 2 x 2 matrices, each up to a factor: within stretches of about sqrt(n) side by side, then from stretch to stretch."""
    n = len(m)
    size = max(1, int(np.ceil(np.sqrt(n))))
    rows = -(-n // size)
    padded = np.concatenate([m, np.broadcast_to(np.eye(2), (rows * size - n, 2, 2))]).reshape(rows, size, 2, 2)
    out = np.empty_like(padded)
    out[:, 0] = padded[:, 0]
    for s in range(1, size):
        step = out[:, s - 1] @ padded[:, s]
        out[:, s] = step / step.sum((1, 2), keepdims=True)
    for r in range(1, rows):
        step = out[r - 1, -1] @ out[r]
        out[r] = step / step.sum((1, 2), keepdims=True)
    return out.reshape(-1, 2, 2)[:n]


def marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each label at each line, of each pair of labels at a line and the one before) of chains laid end to end.

    emit: score of each label; trans: of a label after a label; first: where a chain begins, with no pair to the line before.
    """
    step = np.where(first[:, None, None], 0.0, trans) + emit[:, None, :]
    m = np.exp(step - step.max((1, 2), keepdims=True))
    forward = _running(m).sum(1)  # any label before the first line: its pair has no score
    forward /= forward.sum(1, keepdims=True)
    backward = np.ones_like(forward)
    backward[:-1] = _running(m[:0:-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1).sum(2) if len(m) > 1 else 1
    own = forward * backward
    own /= own.sum(1, keepdims=True)
    pair = np.zeros_like(m)
    pair[1:] = forward[:-1, :, None] * m[1:] * backward[1:, None, :]
    pair[1:] /= pair[1:].sum((1, 2), keepdims=True)
    return own, pair


@dataclass
class Field:
    """A fitted field: weights of the label good, pair scores, and the scale from mean marginal to score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def emissions(self, x: np.ndarray) -> np.ndarray:
        good = ((x - self.mean) / self.scale) @ self.weights
        return np.stack([np.zeros_like(good), good], 1)

    def good(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(self.emissions(x), self.trans, first)[0][:, 1]

    def score(self, mean_good: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean_good + self.offset, -40, 40)))


def starts(counts: np.ndarray) -> np.ndarray:
    first = np.zeros(int(counts.sum()), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("i8")] = True
    return first


def _fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, begun: Field) -> Field:
    """The field of greatest likelihood of line labels (Adam on the convex loss, from where `begun` ended)."""
    field = Field(begun.mean, begun.scale, begun.weights.copy(), begun.trans.copy())
    z, n = (x - field.mean) / field.scale, len(x)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][~first[1:]], labels[1:][~first[1:]]), 1)
    theta = np.concatenate([field.weights, field.trans.reshape(-1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        good = z @ theta[:-4]
        own, pair = marginals(np.stack([np.zeros_like(good), good], 1), theta[-4:].reshape(2, 2), first)
        slope = np.concatenate([z.T @ (own[:, 1] - labels) / n, (pair[~first].sum(0) - seen).reshape(-1) / n]) + RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    field.weights, field.trans = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def _scaled(field: Field, means: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Field:
    """Slope and offset by logistic regression of documents' labels on their mean marginals (Newton steps)."""
    a = np.stack([means, np.ones_like(means)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        slope = a.T @ (weights * (p - labels)) + 1e-3 * weights.sum() * np.array([1e-3, 1e-3]) * w
        curve = (a * (weights * p * (1 - p))[:, None]).T @ a + 1e-6 * weights.sum() * np.eye(2)
        w = w - np.linalg.solve(curve, slope).clip(-5, 5)
    field.slope, field.offset = float(w[0]), float(w[1])
    return field


def _sampled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int) -> DataFrame:
    """(label, doc, counts of runs, features, sizes) of the sample: at most 2 * per_label documents of RUNS * RUN lines each."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(label).cast("int").alias("label")).distinct()
    lot = F.xxhash64(F.lit("line-crf"), F.col("doc").cast("string"))
    drawn = [known.where(F.col("label") == y).orderBy(lot, "doc").limit(per_label) for y in (0, 1)]
    ids = drawn[0].unionByName(drawn[1])
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc"), whole_text(docs[f"`{text}`"]).alias("text"))
    rows = rows.join(F.broadcast(ids), "doc")  # 2 * per_label rows at most
    once = rows.groupBy("doc", "label", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))  # copies teach once
    few = once.orderBy(F.xxhash64("h", "doc"), "label").limit(2 * per_label)  # should one id have many texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, y, t in zip(*(batch.column(c).to_pylist() for c in ("h", "label", "text")), strict=True):
                x, sizes, _ = features([t])
                runs = -(-len(x) // RUN)
                for r in np.sort(np.random.default_rng(doc & 0xFFFFFFFF).permutation(runs)[:RUNS]):
                    part = slice(r * RUN, (r + 1) * RUN)
                    out.append((y, doc, len(sizes[part]), x[part].astype("<f4").tobytes(), sizes[part].astype("<i8").tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["label", "doc", "n", "x", "sizes"])

    return few.mapInArrow(run, "label int, doc long, n long, x binary, sizes binary")


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = PER_LABEL) -> Field:
    """A field from labels (doc_id, quality 0 or 1; others teach nothing) of docs.

    A document with both labels teaches both; repeated rows teach once.  Without rows of both labels every
    document gets the share of label 1 among the labels, without any 0.5.
    """
    prepare(docs.sparkSession)
    shares = {r[0]: r[1] for r in labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect()}  # two rows
    flat = Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), np.zeros((2, 2)), 0.0)
    rows = _sampled(docs, labels, doc_id, text, label, per_label).toArrow().sort_by([("label", "ascending"), ("doc", "ascending")])
    taught = rows.column("label").to_numpy().astype("i8")
    if not ((taught == 0).any() and (taught == 1).any()):
        good, bad = shares.get(1, 0), shares.get(0, 0)
        flat.offset = 0.0 if good + bad == 0 else float(np.clip(np.log(good) - np.log(bad), -40, 40)) if good and bad else 40.0 if good else -40.0
        return flat
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), "<f4").reshape(-1, WIDTH).astype("f8")
    sizes = np.frombuffer(b"".join(rows.column("sizes").to_pylist()), "<i8")
    counts = rows.column("n").to_numpy()
    first = starts(counts)
    _, doc = np.unique(np.stack([rows.column("doc").to_numpy(), taught], 1), axis=0, return_inverse=True)
    doc = doc.reshape(-1)
    owner, bad = np.repeat(doc, counts), np.repeat(taught, counts) == 0
    field = Field(x.mean(0), x.std(0) + 1e-3, np.zeros(WIDTH), np.zeros((2, 2)))
    field.mean[0], field.scale[0] = 0, 1
    lines = np.where(bad, 0, 1)
    for _ in range(ROUNDS):
        field = _fit(x, first, lines, field)
        good = field.good(x, first)
        worst = np.full(doc.max() + 1, 2.0)
        np.minimum.at(worst, owner, good)
        lines = np.where(bad & ((good < 0.5) | (good <= worst[owner])), 0, 1)
    means = np.bincount(owner, good * sizes) / np.bincount(owner, sizes)
    of_doc = np.zeros(len(means))
    of_doc[doc] = taught
    drawn = np.array([(of_doc == y).sum() for y in (0, 1)])
    weights = np.array([shares[0], shares[1]]) / drawn  # the sample has as many of both
    return _scaled(field, means, of_doc, weights[of_doc.astype(int)] / weights.max())


def scores(texts: list[str], field: Field) -> np.ndarray:
    """Each text's quality: the mean probability of its lines to be good, weighted by their length with the line break."""
    out = []
    for part in blocks(texts):
        x, sizes, counts = features(part)
        good = field.good(x, starts(counts))
        owner = np.repeat(np.arange(len(part)), counts)
        out.append(field.score(np.bincount(owner, good * sizes, len(part)) / np.bincount(owner, sizes, len(part))))
    return np.concatenate(out) if out else np.zeros(0)


def predict(df: DataFrame, field: Field, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """df plus score (0 to 1, higher: better) and predicted (1 from `least` on).

    Null counts as the empty text, which is one empty line.  Rows are independent; other columns pass through,
    those named like results are replaced.
    """
    prepare(df.sparkSession)
    rest = [c for c in df.columns if c not in ("score", "predicted")]
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            score = scores(batch.column(len(rest)).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= least).astype("i4"))], names=[*rest, "score", "predicted"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), "score double", "predicted int"])
    return df.select(*(df[f"`{c}`"] for c in rest), whole_text(df[f"`{text}`"]).alias(unused(df, "body"))).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text is 0 modulo 5 (null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
