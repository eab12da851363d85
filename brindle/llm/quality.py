"""Quality rules: statistics of whole texts and a learned decision list, all as Spark expressions.

Statistics are array expressions of one row, so nothing is shuffled.  Eight-word windows are
hashed word by word; only texts in which a window's hash repeats are sorted to find where.

A decision list is learned from a bounded sample of labelled statistics (``TRAIN_LABELS``) by
sequential covering: a conjunction of thresholds grows by the information it gains on two thirds
of the rows that no rule covers yet, is pruned on the last third, and is kept if it is precise
enough; a few other thirds are tried before the list ends.  The rules become one ordered conditional expression.

Defined results: null or empty text has no words and fails the base rule; repeated rows give
repeated results; of a label's repeated rows the lowest quality counts and null labels do not;
with no labels the base rule alone decides.  Only ``doc_id``, ``text`` and the labels are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, once, table, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
TRAIN_LABELS = 12_000
#: A learned rule is kept if so much of what it covers in the pruning third is of low quality.
PRECISION, LEAST_COVER, MOST_RULES, MOST_TERMS, CUTS = 0.95, 2, 12, 4, 48
#: Ways to part the rows that are tried before no further rule is looked for.
TRIES = 5
FEATURES = ("n_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct_words", "bangs", "mean_line")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed`` and the features of the rules."""
    text = F.col("__text")
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    without = lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    n_symbols = without(SYMBOLS[0])
    for c in SYMBOLS[1:]:
        n_symbols = n_symbols + without(c)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    split = base.select("doc_id", once(words_of(text)).alias("__words"), lines.alias("__lines"), n_symbols.cast("long").alias("n_symbols"), without("!").alias("__bangs"))
    hashed = split.withColumn("__h", once(F.when(F.size("__words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))))
    # Windows as (hash, place) in order, for the texts where a hash comes twice.
    ordered = hashed.withColumn("__s", once(F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))))
    at = lambda k: F.get("__s", k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda k: at(k).eqNullSafe(at(k - 1)) | at(k).eqNullSafe(at(k + 1)))
    places = ordered.withColumn("__p", once(F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get("__s", k)["p"])))))
    covered = F.aggregate("__p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    counted = places.select(
        "doc_id", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), once(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"), F.size(F.array_distinct("__words")).alias("__n_distinct"), "__bangs",
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.struct(
            F.col("n_words").cast("double").alias("n_words"), (F.col("word_chars") / n).alias("mean_word"), (F.col("n_symbols") / n).alias("symbols"), (F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))).alias("dup_lines"),
            (F.col("n_repeat_words") / n).alias("repeats"), (F.col("__n_distinct") / F.sqrt(n)).alias("distinct_words"), (F.col("__bangs") / n).alias("bangs"), (n / F.greatest(F.col("__n_lines"), F.lit(1))).alias("mean_line"),
        ).alias("features"),
    )


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.cut if self.above else v <= self.cut

    def column(self, features: str) -> Column:
        v = F.col(features)[self.feature]
        return v > F.lit(self.cut) if self.above else v <= F.lit(self.cut)


Rule = tuple[Term, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for term in rule:
        out &= term.holds(x)
    return out


def _candidates(x: np.ndarray) -> list[Term]:
    terms = []
    for i, name in enumerate(FEATURES):
        values = np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS), method="lower"))
        terms += [Term(name, above, float(v)) for v in values for above in (True, False)]
    return terms


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MOST_TERMS and (~bad[inside]).any():
        p0, n0 = (bad & inside).sum(), inside.sum()
        best, gain = None, 1e-9
        for term in _candidates(x[inside & bad]):
            now = inside & term.holds(x)
            p, n = (bad & now).sum(), now.sum()
            g = p * (np.log2(p / n) - np.log2(p0 / n0)) if p else 0
            if g > gain:
                best, gain = term, g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        c = covers(r, x)
        return float((bad & c).sum() - (~bad & c).sum()) / max(1, c.sum())

    while len(rule) > 1:
        shorter = max((rule[:i] + rule[i + 1 :] for i in range(len(rule))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def _centre(rule: Rule, x: np.ndarray) -> Rule:
    """Cuts half-way between the values that they part, so that near misses are not covered."""
    out = []
    for term in rule:
        v = x[:, FEATURES.index(term.feature)]
        low, high = v[v <= term.cut], v[v > term.cut]
        out.append(Term(term.feature, term.above, float(low.max() + high.min()) / 2) if len(low) and len(high) else term)
    return tuple(out)


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """Ordered conjunctions that find low quality."""
    rules: list[Rule] = []
    if not len(x) or not bad.any():
        return rules
    draw, failed = np.random.default_rng(seed), 0
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES and failed < TRIES:
        failed += 1
        parts = draw.integers(0, 3, len(x))
        grow, held = left & (parts > 0), left & (parts == 0)
        if (bad & grow).sum() < LEAST_COVER:
            continue
        rule = _centre(_prune(_grow(x[grow], bad[grow]), x[held], bad[held]), x[left])
        c = covers(rule, x) & left
        found = c & held
        if rule and (bad & found).sum() >= max(LEAST_COVER, PRECISION * found.sum()) and (bad & c).sum() >= PRECISION * c.sum():
            rules.append(rule)
            left &= ~c
            failed = 0
    return rules


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learns from at most ``2 * TRAIN_LABELS`` labelled documents, chosen by hash of their id."""
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    share = known.where(hash_share(F.col("doc_id"), TRAIN_LABELS, known.count())).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = docs.select("doc_id", "text").join(F.broadcast(share.limit(2 * TRAIN_LABELS)), "doc_id")
    # The label rides along in the id column, so statistics need no second join.
    rows = statistics(sample.select(F.struct("doc_id", "quality").alias("doc_id"), "text")).limit(4 * TRAIN_LABELS).collect()
    rows = [r for r in rows if not r.base_failed]
    rows.sort(key=lambda r: (r.doc_id.doc_id, tuple(r.features)))
    x = np.array([tuple(r.features) for r in rows], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r.doc_id.quality == 0 for r in rows], bool))


def verdict(rules: list[Rule], features: str = "features") -> Column:
    """The decision list as one ordered conditional expression: true if the text is kept."""
    kept = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        holds = rule[0].column(features)
        for term in rule[1:]:
            holds = holds & term.column(features)
        kept = kept.when(holds, F.lit(False))
    return kept.otherwise(F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return statistics(docs).withColumn("kept", verdict(rules)).drop("features")
