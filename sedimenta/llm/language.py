"""Language identification of mixed-language text.

Training counts hashed n-grams of the bytes of words by language and the scripts each language is written in.
A word's script, from ranges of code points, narrows the candidate languages; its score for a language is its
n-grams' summed log-probability over the mean of the languages, clipped. A Viterbi pass over the words of a
text, with a penalty for each switch, labels spans; many texts advance together, one word at a step.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import ship, text_or_empty

#: At most about this many training rows of each language are drawn, by a hash of doc_id.
TRAINING_ROWS = 1500
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
#: Cost of one switch of language between words, and the most that one word can speak for or against a language.
SWITCH = 8.0
CLIP = 6.0
#: Share of what was clipped off that still counts, so that languages at the clip don't tie.
TIES = 1e-3
#: A language whose words are in a script less often than this is no candidate there.
RARE_SCRIPT = 0.002
MEMO_WORDS = 300_000
#: Words labelled together, times the number of languages.
CHUNK_CELLS = 6_000_000

# The first code point of each range and its script.
_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [a for a, _ in _RANGES]
SCRIPTS = sorted({s for _, s in _RANGES})
_AT = [SCRIPTS.index(s) for _, s in _RANGES]

#: Numbers that are word characters to the matcher but not letters: signs for fractions, exponents, Roman numerals.
_SIGNS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters. Signs are rare, so only texts that hold one have their words split at signs."""
    found = _WORD.findall(text)
    if text.isascii() or _SIGNS.isdisjoint(text):
        return found
    return [w for x in found for w in (x if _SIGNS.isdisjoint(x) else "".join(" " if c in _SIGNS else c for c in x)).split()]


def script(word: str) -> int:
    return _AT[bisect_right(_STARTS, ord(word[0])) - 1]


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the bucket of the byte n-gram at each place of the words, which places lie in one word, and the words' first places.

    Words are set between marks that no word holds; n-grams over two words don't count.
    """
    raw = [b"\x01" + w.encode("utf-8", "replace") + b"\x02" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(ends[-1])  # places up to the word's end
    code = np.concatenate([np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.zeros(max(GRAMS), np.uint32)])
    h = np.zeros(ends[-1], np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = (h ^ code[n - 1 : n - 1 + len(h)]) * np.uint32(16777619) + np.uint32(n)
        if n in GRAMS:
            yield (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1), left >= n, ends - size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n) of a task: n-gram buckets as kind 0, scripts as kind 1."""
    langs: dict[str, tuple[np.ndarray, np.ndarray, dict]] = {}

    def add(g, s, seen) -> None:
        words, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
        for h, inside, firsts in grams(words):
            each = np.repeat(n, np.diff(np.append(firsts, len(h))))
            g += np.bincount(h[inside], each[inside], BUCKETS).astype(np.int64)
        s += np.bincount([script(w) for w in words], n, len(SCRIPTS)).astype(np.int64)
        seen.clear()

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            g, s, seen = langs.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64), {}))
            for w in words_of(text.lower()):
                seen[w] = seen.get(w, 0) + 1
            if len(seen) > MEMO_WORDS:
                add(g, s, seen)
    for lang, (g, s, seen) in langs.items():
        if seen:
            add(g, s, seen)
        for kind, x in enumerate((g, s)):
            at = np.nonzero(x)[0]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "kind": np.full(len(at), kind, np.int32), "key": at.astype(np.int32), "n": x[at]})


class Model:
    """languages, log-probabilities (buckets x languages) less their mean, and the languages of each script."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        p = np.zeros((BUCKETS, len(languages)), np.float32)
        for i in range(len(languages)):  # one language at a time, so that there is no second matrix
            p[:, i] = np.log((grams[i] + 0.5) / (grams[i].sum(dtype=float) + 0.5 * BUCKETS))
        if languages:
            p -= p.mean(1, keepdims=True, dtype=float).astype(np.float32)
        self.logp = p
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1) if languages else np.zeros((0, len(SCRIPTS)))
        ok = (share >= RARE_SCRIPT).T
        ok[~ok.any(1)] = True  # a script that no language has: all are candidates
        self.barred = np.where(ok, 0.0, -4 * CLIP).astype(np.float32)


def train(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fit on rows with a text and a language; rows bounds the sample of each language (a documented bound; all if fewer).

    The driver gets counts by language and n-gram bucket: at most BUCKETS for each language. Rows that share a doc_id are
    drawn together.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    drawn = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000))
    parts = spark.createDataFrame([(lang, int(1_000_000 * min(1.0, rows / n))) for lang, n in sizes.items()], "_lang string, _part int")  # a row for each language
    sample = known.select("text", "lang", drawn.alias("_drawn")).join(F.broadcast(parts), F.col("lang") == F.col("_lang")).where("_drawn < _part")
    found = sample.select("text", "lang").mapInArrow(_count, "lang string, kind int, key int, n bigint").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    languages = sorted(sizes)
    at = {x: i for i, x in enumerate(languages)}
    g, s = np.zeros((len(languages), BUCKETS), np.float32), np.zeros((len(languages), len(SCRIPTS)))
    for r in found.toArrow().to_batches():
        for kind, table in ((0, g), (1, s)):
            own = r.filter(pc.equal(r.column("kind"), kind)) if r.num_rows else r
            table[[at[x] for x in own.column("lang").to_pylist()], own.column("key").to_numpy()] += own.column("n").to_numpy()
    return Model(languages, g, s)


class Labeller(dict):
    """As a dict: a word's row among the scores of words met so far; new words are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.scored = np.zeros((0, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def scores(self) -> np.ndarray:
        if self.new:
            m, total = self.model, 0
            for h, inside, firsts in grams(self.new):
                total = total + np.add.reduceat(m.logp[h] * inside[:, None], firsts, axis=0)
            own = np.clip(total, -CLIP, CLIP) + TIES * total + m.barred[[script(w) for w in self.new]]
            self.scored = np.concatenate([self.scored, own.astype(np.float32)])
            self.new = []
        return self.scored

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the text's words and their lengths in letters."""
        found = words_of(text.lower())
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found)), np.fromiter(map(len, found), np.int32, len(found))

    def viterbi(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word of each text; texts in any order."""
        scores, k = self.scores(), len(self.model.languages)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order])
        steps = int(lengths[0]) if len(lengths) else 0
        if not steps:
            return [np.empty(0, np.int32) for _ in texts]
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
        firsts = np.concatenate([[0], np.cumsum(active)])
        flat = np.empty(firsts[-1], np.int32)
        for r, i in enumerate(order):
            flat[firsts[: lengths[r]] + r] = texts[i]
        back = np.empty((firsts[-1], k), np.int16)
        v = np.zeros((len(order), k), np.float32)
        own = np.arange(k, dtype=np.int32)
        for t in range(steps):
            n = active[t]
            x = v[:n]
            if t:
                best = x.argmax(1)
                jump = x[np.arange(n), best][:, None] - SWITCH
                move = jump > x
                back[firsts[t] : firsts[t + 1]] = np.where(move, best[:, None], own)
                np.maximum(x, jump, out=x)
            x += scores[flat[firsts[t] : firsts[t + 1]]]
        labels = np.empty(firsts[-1], np.int32)
        now = np.zeros(len(order), np.int32)
        started = 0
        for t in range(steps - 1, -1, -1):
            n = active[t]
            if n > started:
                now[started:n] = v[started:n].argmax(1)
                started = n
            labels[firsts[t] : firsts[t + 1]] = now[:n]
            if t:
                now[:n] = back[firsts[t] + np.arange(n), now[:n]]
        out: list = [None] * len(texts)
        for r, i in enumerate(order):
            out[i] = labels[firsts[: lengths[r]] + r]
        return out


def spans(labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of one language: first word, number of words, language."""
    if not len(labels):
        return []
    starts = np.concatenate([[0], np.nonzero(np.diff(labels))[0] + 1, [len(labels)]])
    return [{"first_word": int(a), "n_words": int(b - a), "lang": languages[labels[a]]} for a, b in zip(starts, starts[1:], strict=False)]


_LABELLERS: dict[str, Labeller] = {}


def _predict(batches: Iterator[pa.RecordBatch], model, key: str) -> Iterator[pa.RecordBatch]:
    def labeller() -> Labeller:
        if key not in _LABELLERS or len(_LABELLERS[key]) > MEMO_WORDS:
            _LABELLERS.clear()
            _LABELLERS[key] = Labeller(model.value)
        return _LABELLERS[key]

    names = model.value.languages
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
    for b in batches:
        at, n = 0, b.num_rows
        while at < n:
            own, texts, total, first = labeller(), [], 0, at
            while at < n and total * max(1, len(names)) < CHUNK_CELLS:
                texts.append(own.words(b.column(1)[at].as_py()) if names else (np.empty(0, np.int32),) * 2)
                total += len(texts[-1][0])
                at += 1
            langs, scores, runs = [], [], []
            for labels, (_, letters) in zip(own.viterbi([x for x, _ in texts]), texts, strict=True):
                if not len(labels):
                    langs.append("und"), scores.append(0.0), runs.append([])
                    continue
                mass = np.bincount(labels, letters, len(names))
                best = int(mass.argmax())
                langs.append(names[best]), scores.append(float(mass[best] / mass.sum())), runs.append(spans(labels, names))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, at - first), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(runs, kind)], ["row", "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """(keep, lang_pred, score, spans) of each row; keep names the column that comes along.

    lang_pred is the language of most letters, score its share of them; spans count words from 0. A text that is
    null or has no letter (Unicode category L), or a model without languages: "und", 0 and no spans. Ties go to the first
    language. Whole texts are labelled. Rows may repeat; an empty table gives no rows. Other columns are ignored. Up to
    32,767 languages.
    """
    import hashlib

    spark = docs.sparkSession
    ship(spark)
    key = hashlib.sha256(model.logp.tobytes() + model.barred.tobytes()).hexdigest()
    kind = docs.schema[keep].dataType.simpleString()
    work = partial(_predict, model=spark.sparkContext.broadcast(model), key=key)
    out = docs.select(keep, text_or_empty().alias("text")).mapInArrow(work, f"row {kind}, lang_pred string, score double, spans array<struct<first_word:int,n_words:int,lang:string>>")
    return out.withColumnRenamed("row", keep)


def held_out():
    """crc32 of doc_id as text leaves 1 by 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
