"""Language by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed
into the longest phrases that the automaton knows; the language that needs the
fewest phrases, each counted as the bits that name a place in its training
text, wins. The automaton is a plain table of transitions, so many blocks of
text are parsed in step, a letter of each at a time.

Whole texts are parsed, in blocks of BLOCK letters: a phrase ends at a block's
end. Training text is a bounded sample (ROWS different texts per language, an
equal share of CHARS letters from each); languages with less weigh the same, by
the bits of a phrase.

Nulls and edges: a null text, or one without letters, is `und` with score 0;
with nothing to learn from all texts are. Ties go to the first language by
name. Null doc_ids are held in the training part (crc32 of nothing is taken as
0) and keep their rows, repeated rows too. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import small_batches

UNKNOWN = "und"
# Training sample per language.
ROWS = 200
CHARS = 40_000
BLOCK = 1024
# Letters with a symbol of their own; rarer ones are runs of digits.
LETTERS = 62
DIGITS = 64
LANES = 4096


class Alphabet:
    """Symbols of letters: 0 for anything that is no letter (runs are one), 1
    for a letter that no training text has, one for each of the commonest
    letters. Every other letter of the training texts is a run of digits, as
    long for all: no two are merged, and the transitions stay a small table."""

    def __init__(self, texts: list[str]):
        counts: dict[str, int] = {}
        for text in texts:
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        known = sorted(counts, key=lambda c: (-counts[c], c))
        # The first symbol of a digit, how many digits there are, and how many a letter takes.
        self.first, rare = min(len(known), LETTERS) + 2, max(len(known) - LETTERS, 0)
        self.digits = min(DIGITS, math.isqrt(rare - 1) + 1) if rare else 0
        self.run = 2
        while self.digits**self.run < rare:
            self.run += 1
        self.size = self.first + self.digits
        self.number = {c: i + 2 for i, c in enumerate(known)}
        self.table = np.array([self._of(chr(i)) for i in range(0x3000)], np.int32)

    def _of(self, c: str) -> int:
        return self.number.get(c, 1) if c.isalpha() else 0

    def _spelled(self, numbers: np.ndarray) -> np.ndarray:
        """Symbols of numbered letters."""
        rare = numbers >= self.first
        if not rare.any():
            return numbers.astype(np.uint8)
        sizes = np.where(rare, self.run, 1)
        symbols = np.repeat(numbers, sizes)
        at, left = (np.cumsum(sizes) - sizes)[rare], numbers[rare] - self.first
        for k in range(self.run - 1, -1, -1):
            symbols[at + k] = self.first + left % self.digits
            left //= self.digits
        return symbols.astype(np.uint8)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        low = points < len(self.table)
        if low.all():
            numbers = self.table[points]
        else:
            numbers = np.zeros(len(points), np.int32)
            numbers[low] = self.table[points[low]]
            high, back = np.unique(points[~low], return_inverse=True)
            numbers[~low] = np.array([self._of(chr(p)) for p in high], np.int32)[back]
        space = numbers == 0
        return self._spelled(numbers[~(space & np.roll(space, 1))])


def suffix_automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions [state, symbol] of the automaton that knows every substring,
    0 where there is none; state 1 is the empty phrase."""
    length, link, step = [0, 0], [0, 0], [{}, {}]
    last = 1
    for c in text.tolist():
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.zeros((len(step), size), np.int32)
    for s, moves in enumerate(step):
        for c, to in moves.items():
            table[s, c] = to
    return table


def phrases(table: np.ndarray, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each lane (a column of `lanes`; longest first). Where a state
    cannot go on, the next phrase starts with this symbol. State 0 goes nowhere:
    a lane begins there, and a symbol that no phrase starts with leads there."""
    flat, size = table.ravel(), table.shape[1]
    count = np.zeros(lanes.shape[1], np.int64)
    state = np.zeros(lanes.shape[1], np.int64)
    live = np.searchsorted(-lengths, -np.arange(len(lanes)), side="left")
    for i in range(len(lanes)):
        n = live[i]
        symbols, s = lanes[i, :n], state[:n]
        to = flat[s * size + symbols]
        ended = np.flatnonzero(to == 0)
        if len(ended):
            count[ended] += 1
            to[ended] = flat[size + symbols[ended]]
        state[:n] = to
    return count


class Model:
    """Built in a worker from the training texts."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.alphabet = Alphabet([t for lang in self.languages for t in texts[lang]])
        self.tables, self.bits = [], []
        for lang in self.languages:
            symbols = self.alphabet.encode("\n".join(texts[lang]))
            self.tables.append(suffix_automaton(symbols, self.alphabet.size))
            self.bits.append(math.log2(len(symbols) + 2))

    def costs(self, texts: list[str]) -> np.ndarray:
        """[text, language]: bits per symbol."""
        coded = [self.alphabet.encode(t) for t in texts]
        blocks = [(i, c[a : a + BLOCK]) for i, c in enumerate(coded) for a in range(0, len(c), BLOCK)]
        blocks.sort(key=lambda b: -len(b[1]))
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(0, len(blocks), LANES):
            part = blocks[a : a + LANES]
            lengths = np.array([len(b) for _, b in part])
            lanes = np.zeros((lengths[0], len(part)), np.uint8)
            for k, (_, b) in enumerate(part):
                lanes[: len(b), k] = b
            owner = np.array([i for i, _ in part])
            for j, table in enumerate(self.tables):
                np.add.at(total[:, j], owner, phrases(table, lanes, lengths) * self.bits[j])
        sizes = np.array([len(c) for c in coded])
        return total / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: how far the best lies before the second, from
        0.5 (level) to 1."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        if at:
            costs = self.costs([texts[i] for i in at])
            best = costs.argmin(axis=1)
            low = costs.min(axis=1)
            costs[np.arange(len(at)), best] = np.inf
            second = costs.min(axis=1)
            for k, i in enumerate(at):
                names[i] = self.languages[best[k]]
                scores[i] = 1.0 if np.isinf(second[k]) else second[k] / (low[k] + second[k])
        return names, scores


_models: dict[str, Model] = {}


def held_out(doc_id: Column) -> Column:
    crc = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(3)) == 1


def equal_shares(texts: list[str], chars: int) -> list[str]:
    """The texts cut to `chars` letters in all: the same share of each, and what
    short ones leave is shared by the others."""
    shares, left = [0] * len(texts), chars
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        shares[i] = min(len(texts[i]), left // (len(texts) - k))
        left -= shares[i]
    return [t[:n] for t, n in zip(texts, shares, strict=True)]


def training_texts(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> dict[str, list[str]]:
    """A bounded sample per language of labelled texts that are not held out:
    different texts by hash, and as much of one as of another."""
    pool = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    pool = pool.withColumn("h", F.xxhash64("text", F.lit(5)))
    sizes = pool.groupBy("lang").agg(F.count_distinct("h").alias("n"))
    # Some twice as many by a second hash, then the first by the first: one pass
    # for all languages, in groups of bounded size.
    share = F.least(F.lit(1.0), F.lit(2.0 * rows) / F.col("n")) * F.lit(1 << 30)
    some = pool.join(cut_lineage(sizes), "lang").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share.cast("long"))
    # Training text is cut to the bound; texts to be told are not.
    some = some.groupBy("lang", "h").agg(F.first(F.substring("text", 1, chars)).alias("t"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    out: dict[str, list[str]] = {}
    # at most `rows` texts a language
    for r in some.withColumn("i", first).filter(F.col("i") <= rows).orderBy("lang", "i").collect():
        out.setdefault(r["lang"], []).append(r["t"])
    return {lang: equal_shares(texts, chars) for lang, texts in out.items()}


def predict(docs: DataFrame, texts: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    key = str(hash(tuple((k, tuple(v)) for k, v in sorted(texts.items()))))
    training = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches):
        if key not in _models:
            _models.clear()
            _models[key] = Model(training.value)
        for pdf in batches:
            names, scores = _models[key].predict(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": names, "score": scores})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = predict(docs, training_texts(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
