"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsift.llm.common import with_results

WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows that voters and classifier are fitted on, at most; chosen by hash of the id.
FIT_ROWS = 4_000
#: Word prefixes that stand for a word whatever its ending.
PREFIXES = (4, 5, 6)
#: An entry: in so many toxic rows, in such a share of them, and so much oftener than elsewhere (log
#: odds). The share keeps out words that only a few copies of one text have in common.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 4, 0.025, 2.0
FOLDS = 4
STEPS, PENALTY = 400, 1e-3
#: Tokens whose features a task remembers.
TOKENS_HELD = 300_000


def token_features(token: str) -> frozenset[str]:
    """The words of a lower-case token, and their beginnings."""
    found = set()
    for w in WORD.findall(token):
        found.add("=" + w)
        found.update(w[:n] for n in PREFIXES if len(w) >= n)
    return frozenset(found)


def features(text: str) -> set[str]:
    """Distinct words of the text in lower case, and their beginnings."""
    return set().union(*map(token_features, set(text.lower().split())))


def _lexicon(rows: list[set[str]], toxic: np.ndarray) -> dict[str, float]:
    """Entries that toxic rows hold far more often than others, with their log odds.

    `toxic` is the share of each row that counts as toxic: a label, or a posterior.
    """
    bad, every = Counter(), Counter()
    for row, y in zip(rows, toxic, strict=True):
        every.update(row)
        if y > 0.01:
            for f in row:
                bad[f] += y
    n_bad, n_good = toxic.sum(), (1 - toxic).sum()
    least = max(LEAST_ROWS, LEAST_SHARE * n_bad) - 0.5
    odds = {f: np.log((n + 0.5) / (n_bad + 1)) - np.log((every[f] - n + 0.5) / (n_good + 1)) for f, n in bad.items() if n >= least}
    return {f: float(v) for f, v in odds.items() if v >= LEAST_ODDS}


def votes(text: str, row: set[str], lexicon: dict[str, float]) -> list[int]:
    """Votes of all voters: 1 toxic, -1 clean, 0 abstain.

    Lexicon voters: each takes one kind of entry (word, or prefix of one length) and one fold of
    it. Pattern voters: several different entries, their density, strong entries, shouted words,
    repeated exclamation marks.
    """
    hits = [f for f in row if f in lexicon]
    kind = {f: 0 if f[0] == "=" else len(f) - PREFIXES[0] + 1 for f in hits}
    seen = {(kind[f], zlib.crc32(f.encode()) % FOLDS) for f in hits}
    out = [1 if (k, fold) in seen else -1 if not hits else 0 for k in range(len(PREFIXES) + 1) for fold in range(FOLDS)]
    weight = sum(lexicon[f] for f in hits)
    share = len(hits) / max(1, len(row))
    out.append(1 if len(hits) >= 4 else -1 if len(hits) <= 1 else 0)
    out.append(1 if share > 0.03 else -1 if share < 0.002 else 0)
    out.append(1 if weight > 12 else -1 if weight < 3 else 0)
    out.append(1 if any(lexicon[f] > 5 for f in hits) else -1)
    out.append(1 if hits and re.search(r"!!+|\b[A-Z]{5,}\b", text) else 0)
    return out


class LabelModel:
    """Votes given the hidden label: means by label (the accuracies) and one covariance (the correlations).

    Fitted by expectation-maximisation without labels, from the majority vote on. The shared
    covariance keeps voters that repeat each other from counting twice.
    """

    def __init__(self, table: np.ndarray, rounds: int = 10):
        x = table.astype(float)
        share = np.clip((x.sum(1) > 0).astype(float), 0.02, 0.98)
        for _ in range(rounds):
            prior = np.clip(share.mean(), 1e-3, 1 - 1e-3)
            mean1 = (share @ x) / max(share.sum(), 1e-9)
            mean0 = ((1 - share) @ x) / max((1 - share).sum(), 1e-9)
            d1, d0 = x - mean1, x - mean0
            cov = ((d1 * share[:, None]).T @ d1 + (d0 * (1 - share)[:, None]).T @ d0) / len(x)
            self.weights = np.linalg.solve(cov + 0.05 * np.eye(x.shape[1]), mean1 - mean0)
            self.bias = np.log(prior / (1 - prior)) - self.weights @ (mean1 + mean0) / 2
            share = self.posterior(table)
        self.accuracy = np.array([mean0, mean1])

    def posterior(self, table: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(table @ self.weights + self.bias, -30, 30)))


def _linear(rows: list[set[str]], target: np.ndarray) -> tuple[dict[str, float], float]:
    """Logistic regression on soft labels over present features, by adaptive gradient steps."""
    number = {f: i for i, f in enumerate(sorted(_lexicon(rows, target)))}
    at = [[number[f] for f in row if f in number] for row in rows]
    row_of = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    column = np.array([c for a in at for c in a], np.int64)
    size = np.sqrt(np.maximum(1, np.array([len(a) for a in at])))
    value = 1 / size[row_of]
    weight, bias, seen, seen_bias = np.zeros(len(number)), 0.0, np.full(len(number), 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(row_of, weight[column] * value, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.bincount(column, error[row_of] * value, len(number)) / len(rows) + PENALTY / len(rows) * weight
        seen += grad**2
        weight -= 0.5 * grad / np.sqrt(seen)
        slope = error.mean()
        seen_bias += slope**2
        bias -= 0.5 * slope / np.sqrt(seen_bias)
    return {f: float(weight[i]) for f, i in number.items()}, float(bias)


class ToxicityModel:
    """`score(text)` in 0..1 from the weights of the distinct words and prefixes of a whole text."""

    def __init__(self, texts: list[str], toxic: list[int]):
        y = np.array(toxic, bool)
        self.weights, self.bias, self._tokens = {}, -30.0, {}
        first = {t: i for i, t in reversed(list(enumerate(texts)))}  # of equal texts one
        texts, y = [texts[i] for i in first.values()], y[list(first.values())]
        if not y.any():
            return
        rows = [features(t) for t in texts]
        lexicon = _lexicon(rows, y.astype(float))
        table = np.array([votes(t, r, lexicon) for t, r in zip(texts, rows, strict=True)])
        self.label_model = LabelModel(table)
        self.weights, self.bias = _linear(rows, self.label_model.posterior(table))

    def _known_features(self, token: str) -> frozenset[str]:
        if len(self._tokens) > TOKENS_HELD:
            self._tokens.clear()
        found = self._tokens[token] = token_features(token) & self.weights.keys()
        return found

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        held, row = self._tokens, set()
        for token in set(text.lower().split()):
            found = held.get(token)
            if found is None:
                found = self._known_features(token)
            if found:
                row |= found
        z = self.bias + sum(self.weights[f] for f in sorted(row)) / max(1, len(row)) ** 0.5
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out_id(key: str = "doc_id"):
    """Whether crc32 of the id's text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on at most `fit_rows` labelled rows that are not held out, the first by hash of the id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col(key).isNotNull() & ~held_out_id(key))
    chosen = usable.select(key, "toxic").orderBy(F.xxhash64(key), "toxic").limit(fit_rows)
    sample = docs.select(key, text).join(F.broadcast(chosen), key).orderBy(F.xxhash64(key), text).limit(fit_rows).collect()
    return ToxicityModel([r[text] or "" for r in sample], [r["toxic"] for r in sample])


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with `held_out`, `score` and `predicted` for each whole text.

    Labels of held-out rows are never read. Labels propose the lexicon entries; what the classifier
    learns are the label model's posteriors. The fit takes a bounded sample (`fit_rows`) to the
    driver; every text is scored. Null and empty texts get the score of a text without features;
    without a toxic label all scores are 0; repeated rows get equal scores; an empty table gives an
    empty result; input columns named like results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_rows, key, text))

    def fn(texts: list[str]) -> list[list]:
        scores = [shared.value.score(t) for t in texts]
        return [scores, [int(s >= 0.5) for s in scores]]

    flagged = docs.drop("held_out").withColumn("held_out", held_out_id(key))
    return with_results(flagged, text, FIELDS, fn, drop_text=not keep_text)
