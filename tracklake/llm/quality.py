"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, struct, text_batches, unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
THRESHOLD = 0.5  # a text goes if it is more likely bad than good
RULES = ("length", "repeats", "symbols", "lines", "word_size", "capitals", "variety", "shouts", "plain")
GOOD, BAD, ABSTAIN = "1", "0", "-"
RESULT = struct("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes string")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` (a power of two) that occur at least twice in the text.

    Windows get exact integer names by doubling: the name of 2k words comes from the names of
    its two halves, so no window is built and memory stays proportional to the text.
    """
    if len(words) <= width:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    step = 1
    while step < width:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
        step *= 2
    count = np.bincount(ids)
    if count.max() < 2:
        return 0
    twice = np.flatnonzero(count[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _vote(good: bool, bad: bool) -> str:
    return BAD if bad else GOOD if good else ABSTAIN


def features(text: str | None) -> tuple[int, int, int, int, int, str]:
    """The base counts of a text and the rules' votes, one character for each of ``RULES``; null is the empty text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at space and U+0009 to U+000D only
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return 0, 0, 0, 0, 0, BAD + ABSTAIN * (len(RULES) - 1)
    caps = shouted(text)
    # a word has no white space, so joined words split where they were joined
    plain = sum(w.rstrip(".,;:?!\"')").isalpha() for w in b"\n".join(words).decode("utf-8", "surrogatepass").split("\n")) / n
    mean, variety, shouts = chars / n, len(set(words)) / n, text.count("!") / n
    votes = (
        _vote(n >= 40, n < 20)
        + _vote(20 * repeats <= n, 10 * repeats > 3 * n)
        + _vote(50 * symbols <= n, 5 * symbols > n)
        + (_vote(not dup_lines, 10 * dup_lines > 3 * len(lines)) if len(lines) > 1 else ABSTAIN)
        + _vote(3.5 <= mean <= 9, mean < 2.5 or mean > 14)
        + _vote(caps < 0.15, caps > 0.4)
        + (_vote(variety > 0.35, variety < 0.15) if n >= 40 else ABSTAIN)
        + _vote(shouts < 0.03, shouts > 0.2)
        + _vote(plain > 0.85, plain < 0.6)
    )
    return n, chars, symbols, dup_lines, repeats, votes


@functools.cache
def _cases() -> np.ndarray:
    """1 for each code point of an upper-case letter, 2 for a lower-case one, else 0."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x20000):  # no letter beyond has a case
        ch = chr(c)
        kinds[c] = 1 if ch.isupper() else 2 if ch.islower() else 0
    return kinds


def shouted(text: str) -> float:
    """Share of upper-case letters among the cased letters, of any script and in texts of any size."""
    kinds = np.bincount(_cases()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=3)
    return float(kinds[1] / max(1, kinds[1] + kinds[2]))


@F.pandas_udf(RESULT)
def _features(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(x) for x in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"])


#: What is believed of a class before any text: the chance that a rule calls its texts good, and for how many
#: texts that belief counts, in good and in bad classes; and the share of good texts, worth ``SHARE_COUNT`` of them.
GOOD_RATE, GOOD_COUNT, BAD_RATE, BAD_COUNT, GOOD_SHARE, SHARE_COUNT = 0.95, 10.0, 0.6, 2.0, 0.8, 10.0
MOST_CLASSES, STARTS, ROUNDS = 6, 6, 400


@dataclass
class Model:
    """Classes of texts: the share of each, the chance that each rule calls its texts good, and whether they are good."""

    share: np.ndarray
    rates: np.ndarray
    good: np.ndarray

    @property
    def prior(self) -> float:
        """Share of good text."""
        return float(self.share[self.good].sum())

    def odds(self) -> list[tuple[float, list[tuple[float, float]]]]:
        """For each class the logarithm of its share, and of the chances of a good and of a bad vote by each rule."""
        return [(float(np.log(w)), [(float(np.log(x)), float(np.log(1 - x))) for x in r]) for w, r in zip(self.share, self.rates, strict=True)]

    def p_good(self, votes: str) -> float:
        """Probability of good text given votes."""
        logs = np.array([w + sum(r[0] if v == GOOD else r[1] if v == BAD else 0.0 for v, r in zip(votes, rules, strict=True)) for w, rules in self.odds()])
        p = np.exp(logs - logs.max())
        return float(p[self.good].sum() / p.sum())

    def posterior(self, votes: Column) -> Column:
        """The same of a column of votes."""
        logs = []
        for w, rules in self.odds():
            e = F.lit(w)
            for i, (yes, no) in enumerate(rules):
                v = F.substring(votes, i + 1, 1)
                e = e + F.when(v == GOOD, yes).when(v == BAD, no).otherwise(0.0)
            logs.append(e)
        # the classes' terms are made once for a row, as the only element of an array
        return F.transform(F.array(F.array(*logs)), lambda x: self._share_of_good(x))[0]

    def _share_of_good(self, logs: Column) -> Column:
        parts = [F.exp(logs[k] - F.array_max(logs)) for k in range(len(self.good))]
        kept = [p for p, g in zip(parts, self.good, strict=True) if g]
        return sum(kept, F.lit(0.0)) / sum(parts, F.lit(0.0))


def fit(patterns: dict[str, int], most: int = MOST_CLASSES, starts: int = STARTS) -> Model:
    """Expectation-maximisation over counts of vote patterns: latent classes within which rules vote independently.

    Bad text comes in kinds, in each of which several rules fail together; two classes would not do,
    as rules of one kind depend on each other. So the number of classes, two to ``most``, is the one
    with the least Bayesian information criterion, each fitted from several starts of which the
    likeliest counts. No text is fixed to a class and no rule's rate is given: beliefs of a few texts
    (``GOOD_COUNT``, ``BAD_COUNT``) say how a class starts and decide in small tables alone.

    A class is bad if two rules or more fail its texts more often than not. What single rules do
    by themselves is noise to this model, however often: a text on which two rules fail that fail
    independently elsewhere stays good, and one failure of a rule that fails with others need not.
    Without votes the model is what is believed beforehand.
    """
    k = len(RULES)
    if not patterns:
        return Model(np.array([GOOD_SHARE, 1 - GOOD_SHARE]), np.array([np.full(k, GOOD_RATE), np.full(k, BAD_RATE)]), np.array([True, False]))
    keys = sorted(patterns)
    n = np.array([patterns[x] for x in keys], float)
    v = np.array([list(x) for x in keys])
    good, bad = (v == GOOD).astype(float), (v == BAD).astype(float)
    best = None
    for classes in range(2, most + 1):
        runs = [_maximise(n, good, bad, classes, seed) for seed in range(starts)]
        likelihood, share, rates = max(runs, key=lambda r: r[0])
        criterion = -2 * likelihood + (classes * k + classes - 1) * np.log(n.sum())
        if best is None or criterion < best[0]:
            best = criterion, share, rates
    _, share, rates = best
    return Model(share, rates, (rates < 0.5).sum(1) < 2)


def _maximise(n: np.ndarray, good: np.ndarray, bad: np.ndarray, classes: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(penalised log-likelihood, shares, rates) of one run from a start that the seed gives: the first class is believed good."""
    rng = np.random.default_rng(seed)
    k = good.shape[1]
    belief = np.array([np.full(k, GOOD_RATE), *(np.full(k, BAD_RATE) for _ in range(classes - 1))])
    count = np.array([GOOD_COUNT] + [BAD_COUNT] * (classes - 1))
    shares = np.array([GOOD_SHARE] + [(1 - GOOD_SHARE) / (classes - 1)] * (classes - 1))
    share, rates = shares, belief.copy()
    if classes > 2 or seed:
        rates[1:] = rng.uniform(0.1, 0.95, (classes - 1, k))
    before = -np.inf
    for _ in range(ROUNDS):
        logs = np.log(share) + good @ np.log(rates.T) + bad @ np.log(1 - rates.T)
        top = logs.max(1, keepdims=True)
        p = np.exp(logs - top)
        total = p.sum(1, keepdims=True)
        believed = (count[:, None] * (belief * np.log(rates) + (1 - belief) * np.log(1 - rates))).sum() + SHARE_COUNT * (shares * np.log(share)).sum()
        likelihood = float(n @ (top + np.log(total))[:, 0] + believed)
        if likelihood - before <= 1e-9 * abs(likelihood):
            break
        before = likelihood
        q = p / total * n[:, None]
        share = (q.sum(0) + SHARE_COUNT * shares) / (n.sum() + SHARE_COUNT)
        rates = (q.T @ good + count[:, None] * belief) / (q.T @ (good + bad) + count[:, None])
    return likelihood, share, rates


def add_features(df: DataFrame, text: str | Column = "text", out: str = "quality") -> DataFrame:
    """Add a struct column ``out`` with the base counts and votes of a text column.

    Row by row, without a shuffle, so no key can be hot; whole texts are read. Null and empty
    texts have counts of 0 and one vote. Equal rows get equal results. A column of the name
    ``out`` is replaced; all other columns stay.
    """
    text_batches(df.sparkSession)
    return df.withColumn(out, _features(F.col(text) if isinstance(text, str) else text))


def fit_on(df: DataFrame, votes: str | Column) -> Model:
    """Fit the model to the votes of all rows; the driver gets one record a pattern, 3 ** len(RULES) at most."""
    rows = df.groupBy((F.col(votes) if isinstance(votes, str) else votes).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit({r.v: r.n for r in rows})


def failed(q: Column) -> Column:
    """The base rule of the query's contract."""
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def filter_quality(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose posterior probability of good text reaches ``threshold``.

    The posterior stands in place of rules that all must pass: a short text that every other
    rule calls good stays. Null texts and texts without words go. Repeated rows share their fate.
    Columns stay as they are, whatever their names. Votes are made once and written beside the
    rows; the model is fitted to the votes of all rows, then decides over what was written.
    """
    name = unused(df, "quality")
    voted = materialize(add_features(df, text, name), "voted")
    q = F.col(name)
    model = fit_on(voted, q["votes"])
    return voted.filter((q["n_words"] > 0) & (model.posterior(q["votes"]) >= threshold)).drop(name)
