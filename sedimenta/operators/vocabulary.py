"""Large vocabularies: all terms found in a text in one pass over it.

For a few terms column expressions (functions.text) are better, as they stay in the JVM; from some dozens on one pass
beats a search for each term. A term of letters and digits lies inside a word of the text: its pieces are looked up, once
for each word. Other terms (with spaces or signs, or long ones) are found by an Aho-Corasick automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.batches import parts
from sedimenta.session import checkpointed, send_code

#: Terms of one pass: of letters and digits, and others (an automaton holds more for each); a larger vocabulary takes a pass for each so many, so what is broadcast is bounded.
BLOCK, OTHERS = 2_000_000, 100_000
#: Characters that a term looked up by pieces of words has at most: a word has pieces of as many lengths.
LONGEST = 64
#: Words whose terms a worker remembers.
REMEMBERED = 400_000
_WORD = re.compile(rf"[^\W_]{{1,{LONGEST}}}")
_FOUND = T.ArrayType(T.StructType([T.StructField("rank", T.LongType()), T.StructField("term", T.StringType())]))


class _Terms:
    """The terms of a block (a table of rank and term in this order), found in texts by number."""

    def __init__(self, block: pa.Table):
        both = block.combine_chunks()
        self.ranks, self.words = (both.column(c).combine_chunks() for c in ("rank", "term"))
        self.number, others = {}, []
        for i, term in enumerate(self.words.to_pylist()):
            if _WORD.fullmatch(term):
                self.number[term] = i
            else:
                others.append((term, i))
        self.lengths = sorted({len(t) for t in self.number})
        self.runs = re.compile(rf"[^\W_]{{{self.lengths[0]},}}").findall if self.lengths else lambda text: []
        self.known: dict[str, list[int]] = {}
        self.automaton = None
        if others:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for term, i in others:
                self.automaton.add_word(term, i)
            self.automaton.make_automaton()

    def _inside(self, word: str) -> list[int]:
        n, number = len(word), self.number.get
        return [x for k in self.lengths if k <= n for i in range(n - k + 1) if (x := number(word[i : i + k])) is not None]

    def found(self, text: str | None) -> set[int]:
        if not text:
            return set()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        words, known = set(self.runs(text)), self.known
        for word in words.difference(known):
            known[word] = self._inside(word)
        out = set().union(*map(known.__getitem__, words))
        if self.automaton is not None:
            out.update(i for _, i in self.automaton.iter(text))
        return out


_HELD: list = []


def _terms(shared: Broadcast) -> _Terms:
    """The terms of a block, made once in a worker; those of the block before go."""
    if not _HELD or _HELD[0] is not shared:
        _HELD.clear()
        _HELD.extend((shared, _Terms(shared.value)))
    return _HELD[1]


def _search(batches: Iterator[pa.RecordBatch], shared: Broadcast, most: int | None) -> Iterator[pa.RecordBatch]:
    """The last column is the lower-cased text; what is found, the first most of it, takes its place. Terms are in order, so the numbers of those found are."""
    terms = _terms(shared)
    for b in parts(batches, -1):
        found = [sorted(terms.found(t))[:most] if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        own = pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1])))
        both = pa.StructArray.from_arrays([terms.ranks.take(own), terms.words.take(own)], ["rank", "term"])
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, both)], names=[*b.schema.names[:-1], "_found"])


def _count(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """The last column is the lower-cased text; gives in how many rows of the task each term is that occurs."""
    terms = _terms(shared)
    n = np.zeros(len(terms.words), np.int64)
    for b in parts(batches, -1):
        for t in b.column(b.num_columns - 1).to_pylist():
            found = terms.found(t)
            n[np.fromiter(found, np.int64, len(found))] += 1
    seen = np.flatnonzero(n)
    for at in range(0, len(seen), OTHERS):
        own = seen[at : at + OTHERS]
        yield pa.RecordBatch.from_arrays([terms.words.take(pa.array(own)), pa.array(n[own])], names=["term", "n"])


def _blocks(vocabulary: DataFrame) -> list[Broadcast]:
    """The terms with their ranks, sorted, in blocks of about BLOCK (OTHERS); one block at a time is in the driver, as an Arrow table."""
    spark = vocabulary.sparkSession
    words = vocabulary.select(F.lower("term").alias("term"), F.col("rank").cast("long").alias("rank")).where("term <> ''").groupBy("term").agg(F.min("rank").alias("rank"))
    plain = F.length("term").between(1, LONGEST) & ~F.col("term").rlike(r"[^\p{L}\p{Nd}]")
    words = checkpointed(words.withColumn("plain", plain))
    out = []
    for kind, size in ((True, BLOCK), (False, OTHERS)):
        own = words.where(F.col("plain") == kind)
        n = -(-own.count() // size)
        for i in range(n):
            block = own.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).select("rank", "term").toArrow()
            if block.num_rows:
                out.append(spark.sparkContext.broadcast(block.sort_by([("rank", "ascending"), ("term", "ascending")])))
    return out


def _passes(rows: DataFrame, blocks: list[Broadcast], most: int | None = None) -> DataFrame:
    """Rows whose last column is the lower-cased text, once for each block, with what of the block is in it (_found) in its place.

    The passes are tasks of their own, so a worker holds one block, however many there are.
    """
    send_code(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_found", _FOUND)])
    each = [rows.mapInArrow(partial(_search, shared=b, most=most), schema) for b in blocks]
    return reduce(DataFrame.unionAll, each) if each else rows.select(*rows.columns[:-1], F.array().cast(_FOUND).alias("_found"))


def with_terms(docs: DataFrame, vocabulary: DataFrame, text: str = "text", name: str = "terms", most: int | None = None) -> DataFrame:
    """Adds the terms that are substrings of the lower-cased text, in the order of (rank, term), the first most of them.

    vocabulary has term and rank (a long); terms are lower-cased, null and empty ones ignored, equal ones count once with
    their least rank. No word boundaries. A null text has none. Only a block of terms at a time reaches the driver. With
    several blocks the rows are numbered and written first, and the terms of each are brought together by its number.
    """
    blocks = _blocks(vocabulary)
    own = docs.select(F.struct(*docs.columns).alias("row"), F.lower(text).alias("_low"))
    terms = lambda found: F.transform(found, lambda x: x["term"]).alias(name)
    columns = lambda found: [terms(found) if c == name else F.col("row").getField(c).alias(c) for c in dict.fromkeys([*docs.columns, name])]
    if len(blocks) < 2:
        return _passes(own, blocks, most).select(*columns(F.col("_found")))
    own = checkpointed(own.withColumn("_row", F.monotonically_increasing_id()))
    found = _passes(own.select("_row", "_low"), blocks, most).where(F.size("_found") > 0)
    found = found.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("_found"))).alias("_found"))
    found = found.select("_row", F.col("_found") if most is None else F.slice("_found", 1, most).alias("_found"))
    return own.join(found, "_row", "left").select(*columns(F.coalesce("_found", F.array().cast(_FOUND))))


def term_rows(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """A row for each row of docs and each term in its text: the join of documents and vocabulary on containment."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*kept).alias("row"), F.lower(text).alias("_low")) if kept else docs.select(F.lower(text).alias("_low"))
    found = _passes(rows, _blocks(vocabulary))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.explode("_found.term").alias("term"))


def with_any(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that have a term in their text."""
    return with_terms(docs, vocabulary, text, "_terms", 1).where(F.size("_terms") > 0).drop("_terms")


def term_counts(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """In how many rows each term of the vocabulary occurs; terms that occur nowhere count 0. Tasks give their counts, not the rows."""
    send_code(docs.sparkSession)
    low = docs.select(F.lower(text).alias("_low"))
    each = [low.mapInArrow(partial(_count, shared=b), "term string, n long") for b in _blocks(vocabulary)]
    words = vocabulary.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    if not each:
        return words.select("term", F.lit(0).cast("long").alias("n"))
    found = reduce(DataFrame.unionAll, each).groupBy("term").agg(F.sum("n").alias("n"))
    return words.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
