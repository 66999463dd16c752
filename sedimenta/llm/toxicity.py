"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are lexicon densities (a fixed list, and words and stems that training texts show to be toxic), lexicon
hits near a second-person word, capitals, punctuation and obfuscation rates. Folds by a hash keep the three fits
apart: two folds for the lexicon, one for the trees, one for the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import ship, text_or_empty

#: At most about this many labelled rows are drawn for training, by a hash of doc_id.
TRAINING_ROWS = 20_000
#: Entries of the learned lexicon at most; and what a word needs to enter it.
LEXICON = 2_000
LEAST_TOXIC = 5
LEAST_ODDS = 2.5
STEM = 5

# Insults in common use, and second-person words of four languages.
INSULTS = frozenset("idiot idiots moron morons loser losers worthless pathetic scum clown clowns trash garbage disgusting stupid dumb hate hateful ugly vermin filth filthy fool jerk imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes tú ti tus".split())
_LEET = str.maketrans("0134578@$!|", "oieastbasii")

FEATURES = ("log_words", "insults", "insult_rate", "learned", "learned_rate", "stems", "stem_rate", "second_rate", "near_second", "capitals", "shouted", "exclaimed", "punctuation", "obfuscated", "hidden")
_words = re.compile(r"[^\W\d_]+").findall
_mixed = re.compile(r"\b[^\W\d_]+[\d@$!*|]+[^\W\d_]+\b").findall
_odd = re.compile(r"[\d@$!*|]").search
_shout = re.compile(r"\b[A-Z]{3,}\b").findall
_capital = re.compile("[A-Z\xc0-\xd6\xd8-\xde]").findall
_other = re.compile(r"[^\w\s]").findall


def features(text: str, lexicon: frozenset, stems: frozenset) -> list[float]:
    """One number for each of FEATURES; all are 0 for an empty text."""
    words = _words(text.lower())
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    listed = [i for i, w in enumerate(words) if w in INSULTS or w in lexicon or w in SECOND_PERSON]
    insults, learned, second = ([i for i in listed if words[i] in kind] for kind in (INSULTS, lexicon, SECOND_PERSON))
    stemmed = [i for i, w in enumerate(words) if w[:STEM] in stems] if stems else []
    hits = np.unique(np.array(insults + learned + stemmed, np.int64))
    near = 0
    if len(hits) and second:
        s = np.array(second)
        at = np.searchsorted(s, hits)
        gap = np.minimum(np.abs(s[np.minimum(at, len(s) - 1)] - hits), np.abs(hits - s[np.maximum(at - 1, 0)]))
        near = int((gap <= 5).sum())
    mixed = _mixed(text) if _odd(text) else []
    hidden = sum(w.translate(_LEET).lower() in INSULTS for w in mixed)
    marks = len(_other(text))
    capitals = len(_capital(text)) / len(text)
    return [math.log1p(n), float(len(insults)), 100 * len(insults) / n, float(len(learned)), 100 * len(learned) / n, float(len(stemmed)), 100 * len(stemmed) / n,
            len(second) / n, float(near), capitals, len(_shout(text)) / n, text.count("!") / n, marks / n, len(mixed) / n, float(hidden)]


def _doc_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, word, toxic, n): in how many texts of a task a word (kind 0) or stem (kind 1) occurs."""
    seen: Counter = Counter()
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = set(_words(text.lower()))
            seen.update((0, w, toxic) for w in words)
            seen.update((1, w, toxic) for w in {w[:STEM] for w in words if len(w) >= STEM})
    cols = list(zip(*(k + (n,) for k, n in seen.items()), strict=True)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["kind", "word", "toxic", "n"])


def _features(batches: Iterator[pa.RecordBatch], lexicon, stems) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py(), lexicon, stems) for t in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "toxic", "fold"])


class Trees:
    """Boosted trees of a fixed depth on logistic loss, split on quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 1.0, shrink: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.shrink = rounds, depth, rate, bins, least, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.empty(0) for j in range(d)]
        b = self._binned(x)
        p = (y.sum() + 0.5) / (n + 1)
        self.start = math.log(p / (1 - p))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = np.full(n, self.start)
        for _ in range(self.rounds if n else 0):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - q, q * (1 - q))
            self.trees.append(tree)
            f += self._apply(b, tree)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int32)

    def _grow(self, b, g, h):
        """Complete binary tree: feature and bin of each inner node, value of each leaf; rows with bin > split go right."""
        inner, d = 2**self.depth - 1, b.shape[1]
        feature, split, value = np.zeros(inner, np.int32), np.full(inner, self.bins, np.int32), np.zeros(2**self.depth)
        node = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            width = 2**level
            gain, pick = np.zeros(width), [(0, self.bins)] * width
            for j in range(d):
                key = node * self.bins + np.minimum(b[:, j], self.bins - 1)
                gs = np.bincount(key, g, width * self.bins).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * self.bins).reshape(width, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                new = gs**2 / (hs + self.shrink) + (gt - gs) ** 2 / (ht - hs + self.shrink) - gt**2 / (ht + self.shrink)
                new[(hs < self.least) | (ht - hs < self.least)] = 0
                for k in range(width):
                    s = int(new[k].argmax())
                    if new[k, s] > gain[k] + 1e-9:
                        gain[k], pick[k] = new[k, s], (j, s)
            for k, (j, s) in enumerate(pick):
                feature[width - 1 + k], split[width - 1 + k] = j, s
            at = width - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[at]] > split[at])
        gs, hs = np.bincount(node, g, 2**self.depth), np.bincount(node, h, 2**self.depth)
        value[:] = self.rate * gs / (hs + self.shrink)
        return feature, split, value

    def _apply(self, b, tree):
        feature, split, value = tree
        node = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (b[np.arange(len(b)), feature[at]] > split[at])
        return value[node]

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.start + sum((self._apply(b, t) for t in self.trees), np.zeros(len(x)))


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising knots (margin, share of label 1). Each block is smoothed by half a row of either label."""
    blocks: list[list[float]] = []  # sum of y, rows, sum of f
    order = np.argsort(f, kind="stable")
    for m, v in zip(f[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, m])
        while len(blocks) > 1 and (blocks[-2][2] / blocks[-2][1] == m or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            s, n, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + t]
    knots = np.array([t / n for _, n, t in blocks])
    shares = np.maximum.accumulate(np.array([(s + 0.5) / (n + 1) for s, n, _ in blocks])) if blocks else np.empty(0)
    return knots, shares


class Model:
    def __init__(self, lexicon: frozenset, stems: frozenset, trees: Trees, knots: np.ndarray, shares: np.ndarray):
        self.lexicon, self.stems, self.trees, self.knots, self.shares = lexicon, stems, trees, knots, shares

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        f = self.trees.margins(np.array([features(t, self.lexicon, self.stems) for t in texts]))
        plain = 1 / (1 + np.exp(-f))
        # a hundredth of the plain score keeps the order inside flat stretches
        return 0.99 * np.interp(f, self.knots, self.shares) + 0.01 * plain if len(self.knots) else plain


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, entries: int = LEXICON) -> Model:
    """Fit on documents with a toxic label; rows bounds the sample (a documented bound; all if fewer), entries the lexicon learned from it.

    Labels are drawn first and are few, so they are broadcast and texts do not move. Of repeated labels the largest
    counts. Without labelled rows every score is the same.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(n, 1)))
    known = known.where(draw).withColumn("fold", F.pmod(F.xxhash64(F.lit(66), "doc_id"), F.lit(4)).cast("int"))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic", "fold")

    size = {r.toxic: r.n for r in known.where("fold < 2").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = texts.where("fold < 2").mapInArrow(_doc_words, "kind int, word string, toxic int, n bigint")
    n0, n1 = size.get(0, 0), size.get(1, 0)
    counted = found.groupBy("kind", "word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    best = counted.where((F.col("t") >= LEAST_TOXIC) & (odds >= LEAST_ODDS)).orderBy((-odds * F.log1p("t")).asc(), "kind", "word").limit(entries).collect()
    lexicon, stems = (frozenset(r.word for r in best if r.kind == k) for k in (0, 1))

    fitted = texts.where("fold >= 2").mapInArrow(partial(_features, lexicon=lexicon, stems=stems), "x array<double>, toxic int, fold int").toArrow()
    x = np.array(fitted.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y, fold = fitted.column("toxic").to_numpy().astype(float), fitted.column("fold").to_numpy()
    order = np.lexsort((*x.T, y))  # rows come in any order
    x, y, fold = x[order], y[order], fold[order]
    trees = Trees().fit(x[fold == 2], y[fold == 2])
    return Model(lexicon, stems, trees, *isotonic(trees.margins(x[fold == 3]), y[fold == 3]))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.scores(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row, from its whole text; null and empty texts have the score of no features.

    Repeated rows get a row each, an empty table none. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(partial(_score, model=spark.sparkContext.broadcast(model)), f"doc_id {kind}, score double")


def held_out():
    """crc32 of doc_id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op6_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
