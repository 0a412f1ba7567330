"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon and the trees are learned on a bounded sample of labelled rows; all texts are scored, whole, in
Arrow batches. The features are densities of lexicon words, their nearness to words of the second person,
and rates of capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Insults known beforehand; the lexicon proper is learned. Fixed values.
SEEDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown vermin filth filthy imbecile "
    "crétin crétine abruti connard idiote imbécile ordure raclure débile minable nul pourriture salaud salope déchet "
    "idiotin trottel dummkopf abschaum müll arschloch blödmann versager widerlich dreck penner schwachkopf wertlos "
    "idiota imbécil estúpido estúpida basura asqueroso asquerosa escoria inútil patético patética payaso tonto tonta".split()
)
#: Words of the second person. Fixed values.
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch ihr usted ustedes tú ti tuyo vosotros".split())
FEATURES = ("hits", "distinct", "weight", "highest", "seeds", "near_you", "you", "capitals", "shouted", "exclaimed", "asked", "other_marks", "obfuscated", "log_words")
TOKEN = re.compile(r"\w+")
HIDDEN = re.compile(r"[^\W\d_][@$*!#0-9|][^\W\d_]")
NEAR = 4
#: Toxic texts in which a term of the lexicon has to be found.
LEAST = 3


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def terms(words: list[str]) -> set[str]:
    """The words of a text and, after a mark, their first five letters."""
    known = {w for w in words if len(w) > 2}
    return known | {"<" + w[:5] for w in known if len(w) > 5}


def candidates(texts: list[str | None], labels: np.ndarray) -> tuple[list[str], list[np.ndarray]]:
    """The terms found in LEAST toxic texts or more, and the numbers of those in each text. Words are made anew for each text
    where they are needed: those of all texts would take many times the room of the texts."""
    there = Counter(t for x, y in zip(texts, labels, strict=True) if y for t in terms(tokens(x)))
    number = {t: k for k, t in enumerate(sorted(t for t, n in there.items() if n >= LEAST))}
    return list(number), [np.array(sorted(number[t] for t in terms(tokens(x)) if t in number), np.int64) for x in texts]


def learn_lexicon(names: list[str], has: list[np.ndarray], labels: np.ndarray, rows: np.ndarray) -> dict[str, float]:
    """Log odds of terms found in LEAST toxic texts of some rows or more, where they are 2 or more and 3 standard errors above 0."""
    bad, good = (rows[labels[rows] == y] for y in (1, 0))
    n, m = (np.bincount(np.concatenate([np.empty(0, np.int64), *(has[i] for i in part)]), minlength=len(names)) for part in (bad, good))
    odds = np.log((n + 0.5) / (len(bad) + 1)) - np.log((m + 0.5) / (len(good) + 1))
    chosen = (n >= LEAST) & (odds >= 2) & (odds >= 3 * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5)))
    return {names[k]: min(float(odds[k]), 6.0) for k in np.flatnonzero(chosen)}


def features(text: str | None, words: list[str], lexicon: dict[str, float]) -> list[float]:
    """The values of FEATURES; a text without words has zeros for all densities."""
    text, n = text or "", max(1, len(words))
    weight = {}
    for w in set(words):
        x = max(lexicon.get(w, 0.0), lexicon.get("<" + w[:5], 0.0) if len(w) > 5 else 0.0, 4.0 * (w in SEEDS))
        if x:
            weight[w] = x
    hits, near, you = 0, 0, 0
    if weight:
        you_at, hit_at = -NEAR - 1, -NEAR - 1
        for i, w in enumerate(words):
            if w in SECOND:
                you, you_at = you + 1, i
                near += i - hit_at <= NEAR
            elif w in weight:
                hits, hit_at = hits + 1, i
                near += i - you_at <= NEAR
    else:
        you = sum(map(words.count, SECOND.intersection(words)))
    letters = max(1, sum(map(str.isalpha, text)) if len(text) < 200 else len("".join(words)))
    capitals = len(text) - len(text.translate(CAPITALS))
    marks = len(text) - len(text.translate(MARKS))
    return [
        hits / n, float(len(weight)), sum(weight.values()) / math.sqrt(n), max(weight.values(), default=0.0), sum(w in SEEDS for w in weight) * 1.0,
        near / n, you / n, capitals / letters, text.isupper() * 1.0, text.count("!") / n, text.count("?") / n, marks / n,
        len(HIDDEN.findall(text)) / n, math.log1p(len(words)),
    ]


CAPITALS = dict.fromkeys(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"))
MARKS = dict.fromkeys(map(ord, "#$%&*+/<=>@\\^_|~"))


def fit_tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, n_bins: int, depth: int, least: float, ridge: float = 1.0) -> list[tuple]:
    """A tree as nodes (feature, bin, left, right, value); a leaf has feature -1. Splits by histograms."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, level: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(nodes)
        nodes.append((-1, 0, 0, 0, -g / (h + ridge)))
        if level == depth or h < 2 * least:
            return at
        best, pick = 1e-6, None
        for f in range(bins.shape[1]):
            x = bins[rows, f]
            gl = np.cumsum(np.bincount(x, grad[rows], n_bins))[:-1]
            hl = np.cumsum(np.bincount(x, hess[rows], n_bins))[:-1]
            gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
            gain[(hl < least) | (h - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best:
                best, pick = gain[k], (f, k)
        if pick:
            f, k = pick
            low = bins[rows, f] <= k
            left, right = grow(rows[low], level + 1), grow(rows[~low], level + 1)
            nodes[at] = (f, k, left, right, 0.0)
        return at

    grow(np.arange(len(grad)), 0)
    return nodes


@dataclass
class Trees:
    cuts: list[np.ndarray]
    base: float
    trees: list[list[tuple]]
    rate: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.binned(x), np.full(len(x), self.base)
        for nodes in self.trees:
            f, k, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                down = bins[np.arange(len(x)), np.maximum(f[at], 0)] <= k[at]
                at = np.where(inner, np.where(down, left[at], right[at]), at)
            out += self.rate * value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, n_bins: int = 48) -> Trees:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins)[1:-1])) for f in range(x.shape[1])]
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(cuts, float(np.log(p / (1 - p))), [], rate)
    bins, margin = model.binned(x), np.full(len(x), model.base)
    least = float(np.clip(p * (1 - p) * len(y) / 40, 0.5, 5.0))  # of the Hessian in a leaf; less for small samples
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        one = Trees(cuts, 0.0, [fit_tree(bins, q - y, q * (1 - q), n_bins, depth, least)], rate)
        model.trees += one.trees
        margin += one.margin(x)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the blocks as points (mean margin, rate), rates between them by a line. Half an observation
    of the mean label is part of every block, which keeps the ends off 0 and 1; blocks are pooled until these rates rise. Equal
    margins are one block from the start."""
    each, of = np.unique(margin, return_inverse=True)
    n, prior = np.bincount(of), 0.5 * float(y.mean())
    blocks: list[list[float]] = []
    for block in zip((each * n).tolist(), np.bincount(of, y).tolist(), n.tolist(), strict=True):
        blocks.append(list(block))
        while len(blocks) > 1 and (blocks[-2][1] + prior) * (blocks[-1][2] + 0.5) >= (blocks[-1][1] + prior) * (blocks[-2][2] + 0.5):
            b = blocks.pop()
            blocks[-1] = [blocks[-1][i] + b[i] for i in range(3)]
    at, bad, n = (np.array([b[i] for b in blocks]) for i in range(3))
    return at / n, (bad + prior) / (n + 0.5)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    at: np.ndarray
    rate: np.ndarray

    def scores(self, texts) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), float(self.rate[0]))
        x = np.array([features(t, tokens(t), self.lexicon) for t in texts], float).reshape(-1, len(FEATURES))
        m = self.trees.margin(x)
        # A small slope beyond the calibrated rates keeps the order of margins that share a block.
        return np.clip(np.interp(m, self.at, self.rate) * 0.998 + 0.002 / (1 + np.exp(-m)), 0.0, 1.0)


def fit(texts: list[str | None], labels: np.ndarray, folds: int = 5) -> Model:
    """Lexicon and trees from all rows. The features that the trees learn from, and the margins that the
    calibration learns from, come from folds that did not see the row."""
    y = np.asarray(labels, float)
    if len(y) < 2 * folds or y.min() == y.max():
        return Model({}, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    names, has = candidates(texts, y)
    fold = np.arange(len(y)) % folds
    x = np.zeros((len(y), len(FEATURES)))
    for k in range(folds):
        lexicon = learn_lexicon(names, has, y, np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            x[i] = features(texts[i], tokens(texts[i]), lexicon)
    margin = np.zeros(len(y))
    for k in range(folds):
        margin[fold == k] = fit_trees(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(learn_lexicon(names, has, y, np.arange(len(y))), fit_trees(x, y), *isotonic(margin, y))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 8000, most_bytes: int = 32_000_000) -> Model:
    """A model from a sample of about `most` labelled rows and `most_bytes` bytes of text at most, taken by the hash of the id. labels: (id,
    label); null labels don't count. The sample's ids are broadcast; its texts are written out and weighed before
    the driver reads them: beyond the bounds (long texts, many documents of an id) a smaller share of it is read, and texts larger than
    the bound on their own are none of the sample. Scores are of all texts, whatever their size."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("y is not null and id is not null").distinct()
    share = min(1.0, most / max(1, known.count()))
    below = lambda key, part: F.pmod(key, F.lit(1_000_000)) < part * 1_000_000
    sample = known.filter(below(F.xxhash64("id", F.lit(9)), share))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").distinct()  # about `most` rows of three numbers
    found = Tables(docs.sparkSession).keep(found.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)))).filter(F.col("bytes") <= most_bytes)
    n, size = found.agg(F.count("*"), F.sum("bytes")).first()
    part = min(1.0, 1.2 * most / max(1, n), most_bytes / max(1, size or 0))
    rows = found.filter(below(F.xxhash64("id", "text", F.lit(10)), part)).toPandas()
    rows = rows.sort_values(["id", "text"], na_position="first", kind="stable")
    return fit(rows["text"].tolist(), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row: score in 0 to 1, predicted 1 if it is 0.5 or more.

    Null and empty texts are scored as texts without words. Repeated rows are scored each; an empty table
    gives no rows; other columns are not read.
    """
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return docs.select(F.col(id_col), scored(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5))
