"""Quality scores by naive Bayes support vectors.

A text is its set of n-grams: one or two tokens as they stand (runs of letters,
of digits, of other marks), and one to three token shapes, where a token that
repeats the one before has a shape of its own. Each n-gram's indicator is scaled
by the log of its smoothed shares in the two classes, and a linear model with
hinge loss is fitted on that by dual coordinate descent. A logistic curve over
margins of rows held out in turn makes probabilities of the margins.

The fit reads about `LABELLED` labelled documents, chosen by a hash of doc_id
(twice that at most), and the `FEATURES` n-grams found in most of them, in
`MIN_DOCS` at least; both bounds are parameters. N-grams are counted by Spark;
the descent runs in one task on the sample's indexes. Every document is scored
over its whole text.

Only rows whose crc32(doc_id as text) mod 5 is not 0 lend their labels.

Nulls and edges: a null text is an empty one, which has no n-gram and scores by
the constant alone; a null doc_id is scored and counts as held out; repeated ids
keep a row each; labels other than 0 and 1 are ignored, and of several for one
doc_id the larger counts. Without both classes in the sample every score is the
share of ones in it, 0.5 without any. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches

LABELLED = 4_000
FEATURES = 100_000
MIN_DOCS = 3
THRESHOLD = 0.3
# Weight of the loss, smoothing of the counts, passes over the rows.
COST, SMOOTH, PASSES = 0.05, 1.0, 30
FOLDS = 3
SEED = 11

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
# Stands before every shape, so that none equals a token.
MARK = "\x00"
SPLIT = "\x1f"

Gram = str | tuple[str, ...]


class _Shapes(dict):
    """Shape per token, kept once it is known."""

    def __missing__(self, token: str) -> str:
        if token.isalpha():
            kind = "x" if token.islower() else "X" if token.isupper() and len(token) > 1 else "Xx" if token[0].isupper() and not token[1:].isupper() else "xX"
            if token == token.lower() == token.upper():
                kind = "o"
        else:
            kind = "0" if token.isdecimal() else token[:3]
        if len(self) > 200_000:
            self.clear()
        self[token] = shape = MARK + kind
        return shape


def grams(text: str | None, shapes: dict[str, str]) -> set[Gram]:
    """The n-grams of a text, each once."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return set()
    kinds = [shapes[t] for t in tokens]
    again = MARK + "="
    kinds[1:] = [again if a == b else k for a, b, k in zip(tokens, tokens[1:], kinds[1:], strict=False)]
    out: set[Gram] = set(tokens)
    out.update(kinds)
    out.update(zip(tokens, tokens[1:], strict=False))
    out.update(zip(kinds, kinds[1:], strict=False))
    out.update(zip(kinds, kinds[1:], kinds[2:], strict=False))
    return out


def _line(gram: Gram) -> str:
    return gram if isinstance(gram, str) else SPLIT.join(gram)


def _gram(line: str) -> Gram:
    return tuple(line.split(SPLIT)) if SPLIT in line else line


# --- the fit, over rows of feature indexes ---


def log_ratios(rows: list[np.ndarray], good: np.ndarray, n: int) -> np.ndarray:
    """Log of each feature's smoothed share in the good class over the bad."""
    out = []
    for one in (True, False):
        held = [r for r, g in zip(rows, good, strict=True) if g == one]
        counts = np.bincount(np.concatenate(held), minlength=n) if held else np.zeros(n)
        out.append(np.log((counts + SMOOTH) / (counts.sum() + SMOOTH * n)))
    return out[0] - out[1]


def descend(rows: list[np.ndarray], good: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and constant of the hinge-loss model, by dual coordinates."""
    w, constant = np.zeros(len(scale)), 0.0
    y = np.where(good, 1.0, -1.0)
    values = [scale[r] for r in rows]
    norms = np.array([v @ v for v in values]) + 1.0
    # Both classes weigh the same in all.
    share = np.where(good, good.mean(), 1 - good.mean())
    top = cost * 0.5 / share
    alpha, random = np.zeros(len(rows)), np.random.default_rng(SEED)
    for _ in range(passes):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, x = rows[i], values[i]
            gradient = y[i] * (w[at] @ x + constant) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * x
                constant += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4 * cost:
            break
    return w * scale, constant


def margins(rows: list[np.ndarray], weights: np.ndarray, constant: float) -> np.ndarray:
    return np.array([weights[r].sum() + constant for r in rows])


def curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with softened targets."""
    high, low = (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2)
    target = np.where(good, high, low)
    scale = max(float(np.abs(margin).mean()), 1e-9)
    x = np.column_stack([margin / scale, np.ones(len(margin))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (p - target)
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        b = b - step * min(1.0, 2.0 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    # A margin must not lower the score.
    return max(b[0], 0.0) / scale, float(b[1])


def train(rows: list[np.ndarray], good: np.ndarray, n: int) -> tuple[np.ndarray, float, float]:
    """Weights and constant on all rows, scaled so that the logistic of their
    sum is the score."""

    def fitted(which: np.ndarray):
        some = [rows[i] for i in np.flatnonzero(which)]
        return descend(some, good[which], log_ratios(some, good[which], n))

    fold = np.random.default_rng(SEED).permutation(len(rows)) % FOLDS
    held = np.zeros(len(rows))
    for k in range(FOLDS):
        out = fold == k
        if not out.any():
            continue
        if len(set(good[~out].tolist())) == 2:
            held[out] = margins([rows[i] for i in np.flatnonzero(out)], *fitted(~out))
    slope, offset = curve(held, good)
    weights, constant = fitted(np.ones(len(rows), bool))
    return weights * slope, constant * slope + offset, slope


# --- the job ---


def sample(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """doc_id, good, text of the labelled documents to learn from."""
    usable = "quality in (0, 1) and pmod(crc32(cast(cast(doc_id as string) as binary)), 5) != 0"
    known = labels.filter(usable).groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    n = known.count()
    share = min(1.0, labelled / max(n, 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * labelled)
    # at most twice `labelled` rows of two values
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "good", "text").limit(2 * labelled)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, n_features: int = FEATURES) -> tuple[dict[Gram, float], float]:
    """Weight per n-gram and the constant; the score is their sum's logistic."""
    small_batches(docs.sparkSession)

    def split(batches):
        shapes = _Shapes()
        for pdf in batches:
            lists = [sorted(map(_line, grams(t, shapes))) for t in pdf.pop("text")]
            yield pdf.assign(grams=lists)

    kind = dict(docs.dtypes)["doc_id"]
    said = cut_lineage(sample(docs, labels, labelled).mapInPandas(split, f"doc_id {kind}, good boolean, grams array<string>"))
    seen = said.agg(F.count("*").alias("n"), F.count_if("good").alias("ones")).first()
    if seen["ones"] in (0, seen["n"]):
        p = seen["ones"] / seen["n"] if seen["n"] else 0.5
        return {}, float(np.clip(np.log(max(p, 1e-12) / max(1 - p, 1e-12)), -30, 30))
    counts = said.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= MIN_DOCS)
    # at most `n_features` rows
    chosen = [r["gram"] for r in counts.orderBy(F.desc("df"), "gram").limit(n_features).collect()]
    index = {g: i for i, g in enumerate(sorted(chosen))}

    def indexed(batches):
        for pdf in batches:
            lists = [sorted(index[g] for g in gs if g in index) for gs in pdf.pop("grams")]
            yield pdf.assign(at=lists)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[tuple(a) for a in pdf["at"]]).sort_values(["doc_id", "order"], ignore_index=True)
        rows = [np.array(a, np.int64) for a in pdf["at"]]
        weights, constant, _ = train(rows, pdf["good"].to_numpy(bool), len(index))
        at = [*np.flatnonzero(weights).tolist(), -1]
        return pd.DataFrame({"at": at, "weight": [*weights[at[:-1]], constant]})

    rows = said.mapInPandas(indexed, f"doc_id {kind}, good boolean, at array<int>")
    # the bounded sample, as indexes, in one task
    found = rows.groupBy(F.lit("all")).applyInPandas(learn, "at int, weight double").collect()
    names = sorted(chosen)
    weights = {_gram(names[r["at"]]): r["weight"] for r in found if r["at"] >= 0}
    return weights, next(r["weight"] for r in found if r["at"] < 0)


def score(docs: DataFrame, weights: dict[Gram, float], constant: float) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches):
        shapes = _Shapes()
        for pdf in batches:
            total = [constant + sum(weights[g] for g in grams(t, shapes) if g in weights) for t in pdf.pop("text")]
            yield pdf.assign(score=1 / (1 + np.exp(-np.clip(np.array(total, float), -30, 30))))

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    # Missing ids keep their type in the worker as text.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id string, score double").select(F.col("doc_id").cast(kind).alias("doc_id"), "score")


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    weights, constant = fit(docs, labels, labelled)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))
    out = score(docs, weights, constant)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

