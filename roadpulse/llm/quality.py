"""Quality rules: statistics of a text, and a decision list learned from labels.

The statistics are built-in functions within a row: nothing is exploded or
shuffled. The list is learned by sequential covering on a bounded sample of
labelled rows: half of them grow a conjunction of thresholds that covers bad
documents, the other half prunes it, and the covered rows go. What comes out
is one ordered conditional expression.

Nulls and edges: a null text has no words; a text without words, or too short,
fails the base rules. Statistics are never null. Labels without a quality or a
document are not learned from; of several labels of a document any may be
used; without labels of both kinds the list is empty and the base rules decide
alone. Null and repeated doc_ids keep their rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACES, fresh, let, without, words

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Labelled documents that the list is learned from, about; at most twice as many.
LABELLED = 10_000
# A rule goes into the list if this share of what it covers is bad on held-back
# rows, and it covers this many of them.
MIN_PRECISION = 0.95
MIN_COVER = 3
MAX_CONDITIONS = 3
MAX_RULES = 20
CUTS = 32


# --- statistics ---


def _hashes(w: Column) -> Column:
    """Of each 3-word window."""
    size = F.size(w) - F.lit(2)
    heads = F.slice(w, F.lit(1), F.greatest(size, F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def _covered(hashes: Column) -> Column:
    """Words in windows found twice or more. Sorted by hash, equal windows are
    neighbours; sorted by place again, each adds up to three new words."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def cover(at: Column) -> Column:
        adds = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(adds, F.lit(0), lambda a, x: a + x)

    return let(let(placed, repeated), cover)


def repeat_words(w: Column) -> Column:
    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))

    return let(_hashes(w), count)


def _line_stats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    return let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def with_stats(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a struct `name`: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))

    def of(t: Column) -> Column:
        bare = without(t, SPACES)
        counted = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("again")))
        lines = _line_stats(t)

        def build(c: Column) -> Column:
            return F.struct(
                c["w"]["n"].cast("long").alias("n_words"),
                F.length(c["bare"]).cast("long").alias("word_chars"),
                (F.length(c["bare"]) - F.length(without(c["bare"], SYMBOLS))).cast("long").alias("n_symbols"),
                c["l"]["n"].cast("long").alias("n_lines"),
                c["l"]["dup"].cast("long").alias("n_dup_lines"),
                c["w"]["again"].cast("long").alias("n_repeat_words"),
                ((c["w"]["n"] < MIN_WORDS) | (F.lit(100) * c["w"]["again"] > F.lit(MAX_REPEAT_PERCENT) * c["w"]["n"])).alias("base_failed"),
            )

        return let(F.struct(counted.alias("w"), lines.alias("l"), bare.alias("bare")), build)

    return docs.withColumn(name, let(text, of))


# --- the decision list ---

# What a threshold may be set on, as shares; denominators are at least one.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.cut if self.above else v <= self.cut

    def column(self, stats: str) -> Column:
        top, bottom = FEATURES[self.feature]
        v = F.col(stats)[top].cast("double")
        if bottom:
            v = v / F.greatest(F.col(stats)[bottom], F.lit(1)).cast("double")
        return v > F.lit(self.cut) if self.above else v <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (top, bottom) in FEATURES.items():
        v = stats[top].astype(float)
        out[name] = v / np.maximum(stats[bottom], 1).astype(float) if bottom else v
    return out


def _cover(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for c in rule:
        held &= c.holds(x)
    return held


def _gain(bad: int, all_: int, bad0: int, all0: int) -> float:
    """Information gained on the bad rows kept, as first-order rules count it."""
    if not bad:
        return -np.inf
    return bad * (np.log2(bad / all_) - np.log2(bad0 / all0))


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the most gain until only bad rows are covered."""
    rule: Rule = ()
    held = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (~bad & held).any():
        best: tuple[float, Condition | None] = (1e-9, None)
        for name, v in x.items():
            values = np.unique(v[held])
            if len(values) < 2:
                continue
            middle = (values[1:] + values[:-1]) / 2
            # Cuts at ranks, and where a step between values is widest.
            wide = middle[np.argsort(-np.diff(values), kind="stable")[:CUTS]]
            cuts = np.unique(np.concatenate([middle[np.linspace(0, len(middle) - 1, CUTS).astype(int)], wide]))
            for cut in cuts:
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    now = held & c.holds(x)
                    gain = _gain((now & bad).sum(), now.sum(), (held & bad).sum(), held.sum())
                    if gain > best[0]:
                        best = (gain, c)
        if best[1] is None:
            break
        rule, held = (*rule, best[1]), held & best[1].holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on held-back rows."""

    def worth(r: Rule) -> float:
        held = _cover(r, x, len(bad))
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray) -> list[Rule]:
    """Rules in order; `order` deals the rows to growing and pruning."""
    x, rules = features(stats), []
    left, grows = np.ones(len(bad), bool), order % 2 == 0

    def rows(which: np.ndarray):
        return {k: v[which] for k, v in x.items()}, bad[which]

    while len(rules) < MAX_RULES and (left & grows & bad).sum() >= MIN_COVER:
        rule = grow(*rows(left & grows))
        if not rule:
            break
        held_x, held_bad = rows(left & ~grows)
        rule = prune(rule, held_x, held_bad)
        covered = _cover(rule, held_x, len(held_bad))
        if covered.sum() < MIN_COVER or held_bad[covered].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~_cover(rule, x, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list[Rule]:
    """Learn from about `labelled` documents that pass the base rules."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    share = min(1.0, labelled / max(n, 1))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).limit(2 * labelled)
    # at most twice `labelled` rows of two numbers
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # A filter on the statistics would be moved below the join, to all documents.
    rows = with_stats(some, "stats").select("doc_id", "quality", "stats.*").limit(4 * labelled)
    rows = cut_lineage(rows).toPandas()
    rows = rows[~rows["base_failed"].astype(bool)]
    if not len(rows):
        return []
    rows = rows.sort_values(["doc_id", "n_words", "word_chars"], ignore_index=True)
    order = np.random.default_rng(7).permutation(len(rows))
    stats = {k: rows[k].to_numpy() for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    return learn(stats, rows["quality"].to_numpy() == 0, order)


def verdict(rules: list[Rule], stats: str) -> Column:
    """Kept or not: the base rules, then the rules in order."""
    out = F.when(F.col(stats)["base_failed"], F.lit(False))
    for rule in rules:
        held = rule[0].column(stats)
        for c in rule[1:]:
            held = held & c.column(stats)
        out = out.when(held, F.lit(False))
    return out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document its statistics, base_failed and kept."""
    rules = fit(docs, labels)
    marked = with_stats(docs.select("doc_id", "text"), "stats")
    return marked.select("doc_id", "stats.*", verdict(rules, "stats").alias("kept")).drop("n_lines")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep."""
    rules, stats = fit(docs, labels), fresh(docs, "stats")
    return with_stats(docs, stats).filter(verdict(rules, stats)).select(*docs.columns)
