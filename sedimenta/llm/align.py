"""Cross-tokenizer alignment by a sweep over token end events.

Both tokenizers' tokens become end events (document, byte offset, side, id), packed in blocks of up to BLOCK events of one
side. The union of both sides is repartitioned by document, sorted within partitions by offset and streamed through a
machine that holds no more than the open group and a running hash: wherever both sides end at the same offset a group is
complete, and every A token of it is linked with every B token. A document's links leave the machine as distinct id pairs
with their multiplicity, in bounded rows.

How many documents hold a pair is counted over all rows. The most frequent pairs (a fixed number) are broadcast and
summed where the links lie; only rarer links are exchanged by pair to meet their counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, ship, tidy

#: Events of a block; events that the machine takes in before it works off what is complete.
BLOCK, FLUSH = 8192, 200_000
#: Groups of more links than this are linked by distinct ids; rows of links hold so many pairs at most.
SMALL, PAIRS = 4096, 200_000
#: Segments of texts whose tokens a worker remembers.
REMEMBERED = 300_000
#: The most frequent pairs that are broadcast: 32,768 rows of 17 bytes.
FREQUENT = 32_768
EVENTS = "uid long, doc_id long, at long, side int, ids binary, sizes binary"
SWEPT = "uid long, doc_id long, whole boolean, alone boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file (tokenizers JSON); added tokens stand for their text."""
    data, alphabet = json.load(open(path, encoding="utf-8")), _byte_alphabet()
    tokens = {i: bytes(alphabet[c] for c in t) for t, i in data["model"]["vocab"].items() if all(c in alphabet for c in t)}
    tokens |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
    return [tokens.get(i, b"") for i in range(max(tokens) + 1)]


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: U+2581 is a space, <0xHH> a byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


class Tokenizers:
    """Both tokenizers, and the tokens of segments seen before.

    Texts are cut before a space that follows anything but a space and precedes anything but white space. No token of the
    byte-level tokenizer crosses such a place, and none of the pieces if no piece holds a space after something else,
    which is looked up; otherwise texts are not cut.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.tokens = byte_level_tokens(a_path), piece_tokens(self.b)
        self.kinds = [np.dtype(np.min_scalar_type(len(t))) for t in self.tokens]
        self.sizes = [np.array([len(t) for t in own]) for own in self.tokens]
        self.size_kinds = [np.dtype(np.min_scalar_type(int(s.max(initial=1)))) for s in self.sizes]
        self.cut = None if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.tokens[1]))) else re.compile(r"(?<=[^ ])(?= \S)")
        self.seen: dict[str, tuple[bytes, bytes]] = {}
        self.bad: set[str] = set()

    def segments(self, text: str) -> list[str]:
        whole = " " + text
        return self.cut.split(whole) if self.cut else [whole]

    def learn(self, segments: set[str]) -> None:
        """Remember the tokens of new segments; those that begin with one space and end with none are encoded as one text."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.bad = {}, set()
        new = [s for s in segments if s not in self.seen]
        plain = [s for s in new if not s[1:2].isspace() and not s[-1].isspace()] if self.cut else []
        if plain and not self._together(plain):
            plain = []
        done = set(plain)
        for s in [s for s in new if s not in done]:
            own = [self.a.encode(s, add_special_tokens=False).ids, self.b.encode(s[1:])]
            self.seen[s] = tuple(np.array(ids, kind).tobytes() for ids, kind in zip(own, self.kinds, strict=True))
            if any(b"".join([t[i] for i in ids]) != s.encode() for t, ids in zip(self.tokens, own, strict=True)):
                self.bad.add(s)

    def _together(self, segments: list[str]) -> bool:
        """Encode segments as one text and cut its tokens at their ends; False if either side's bytes differ from the text."""
        text = "".join(segments)
        whole, ends = text.encode(), np.cumsum([len(s.encode()) for s in segments])
        sides = []
        for side, ids in enumerate((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:]))):
            if b"".join(map(self.tokens[side].__getitem__, ids)) != whole:
                return False
            own = np.array(ids, self.kinds[side])
            at = np.searchsorted(np.cumsum(self.sizes[side][own]), ends, side="right") * self.kinds[side].itemsize
            packed, cuts = own.tobytes(), at.tolist()
            sides.append([packed[i:j] for i, j in zip([0, *cuts], cuts, strict=False)])
        self.seen.update(zip(segments, zip(*sides, strict=True), strict=True))
        return True

    def encode(self, text: str, segments: Sequence[str]) -> list[np.ndarray]:
        """The ids of both sides; none if either side's bytes differ from a space and the text."""
        both = zip(*[self.seen[s] for s in segments], strict=True)
        ids = [np.frombuffer(b"".join(x), kind) for x, kind in zip(both, self.kinds, strict=True)]
        if self.bad and not self.bad.isdisjoint(segments):
            whole = (" " + text).encode()
            if any(b"".join([t[i] for i in own.tolist()]) != whole for t, own in zip(self.tokens, ids, strict=True)):
                return [own[:0] for own in ids]
        return ids


@cache
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _lots(docs: list[tuple], most: int = 200_000) -> Iterator[list[tuple]]:
    """The rows in lots of so many characters of text; a longer text is a lot of its own."""
    lot, held = [], 0
    for row in docs:
        n = len(row[2] or "")
        if lot and held + n > most:
            yield lot
            lot, held = [], 0
        lot.append(row)
        held += n
    if lot:
        yield lot


def _events(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    both = _tokenizers(a_path, b_path)
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary())])
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        docs = list(zip(*[batch.column(c).to_pylist() for c in ("uid", "doc_id", "text")], strict=True))
        for some in _lots(docs):
            cut_ = [both.segments(text) if text else [] for _, _, text in some]
            both.learn({s for own in cut_ for s in own})
            for (uid, doc_id, text), segments in zip(some, cut_, strict=True):
                ids = both.encode(text, segments) if text else []
                if not any(len(own) for own in ids):
                    rows.append((uid, doc_id, 0, 0, b"", b""))
                for side, own in enumerate(ids):
                    sizes = both.sizes[side][own]
                    ends = np.cumsum(sizes)
                    for i in range(0, len(own), BLOCK):
                        at = int(ends[i - 1]) if i else 0
                        rows.append((uid, doc_id, at, side, own[i : i + BLOCK].tobytes(), sizes[i : i + BLOCK].astype(both.size_kinds[side]).tobytes()))
                        held += len(own[i : i + BLOCK])
            if held > FLUSH:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


class Sweep:
    """The machine: takes blocks in order of document and offset, gives rows of links.

    It holds the events taken in since the last flush and, of the document that is open, what follows the last common end.
    """

    def __init__(self, vocabularies: Sequence[int], size_kinds: Sequence[np.dtype]):
        self.kinds, self.size_kinds = [np.min_scalar_type(n) for n in vocabularies], size_kinds
        self.n_b, self.width = vocabularies[1], vocabularies[0] * vocabularies[1]
        self.names = [np.array([f"{i}{mark}" for mark in marks for i in range(n)], object) for n, marks in zip(vocabularies, (",|", ",;"), strict=True)]
        self.docs: list[tuple[int, int | None]] = []  # documents taken in
        self.blocks: list[list[tuple[int, int, np.ndarray, np.ndarray]]] = [[], []]  # for each side (document's place, start, ids, ends)
        self.held, self.until = 0, 0
        self.clear()

    def clear(self) -> None:
        """Counts of the document that is open."""
        self.hash, self.counts, self.parts = hashlib.sha256(), [0, 0, 0, 0], 0

    def take(self, uid: int, doc_id: int | None, at: int, side: int, ids: bytes, sizes: bytes) -> Iterator[dict]:
        if self.docs and self.docs[-1][0] != uid and self.held > FLUSH:
            yield from self.flush(done=True)
        if not self.docs or self.docs[-1][0] != uid:
            self.docs.append((uid, doc_id))
            self.until = FLUSH
        own = np.frombuffer(ids, self.kinds[side])
        if len(own):
            ends = at + np.cumsum(np.frombuffer(sizes, self.size_kinds[side]).astype(np.int64))
            self.blocks[side].append((len(self.docs) - 1, at, own, ends))
            self.held += len(own)
        if self.held > 2 * FLUSH and self.held > self.until:
            yield from self.flush(done=False, upto=at)
            self.until = self.held + FLUSH

    def flush(self, done: bool, upto: int = 0) -> Iterator[dict]:
        """Work off the complete groups; unless done, of the last document only those that end by upto, and keep its rest."""
        docs, n = self.docs, len(self.docs)
        if not n:
            return
        doc, ids, ends = [], [], []
        for side in (0, 1):
            b = self.blocks[side]
            doc.append(np.concatenate([np.full(len(x[2]), x[0]) for x in b] or [np.empty(0, np.int64)]))
            ids.append(np.concatenate([x[2] for x in b] or [np.empty(0, self.kinds[side])]))
            ends.append(np.concatenate([x[3] for x in b] or [np.empty(0, np.int64)]))
        last = np.zeros(n, np.int64)
        for side in (0, 1):
            np.maximum.at(last, doc[side], ends[side])
        base = np.concatenate([[0], np.cumsum(last + 1)[:-1]])
        flat = [e + base[d] for d, e in zip(doc, ends, strict=True)]
        common = np.intersect1d(*flat, assume_unique=True)
        if not done:
            common = common[common <= base[-1] + upto]
        rest: list[list] = [[], []]
        if not done:
            edge = common[-1] if len(common) else -1
            for side in (0, 1):
                keep = flat[side] > edge
                if keep.any():
                    rest[side] = [(0, 0, ids[side][keep], ends[side][keep])]
                doc[side], ids[side], flat[side] = (x[~keep] for x in (doc[side], ids[side], flat[side]))
        yield from self._groups(docs, doc, ids, [np.searchsorted(common, f) for f in flat], np.searchsorted(base, common, side="right") - 1, len(common), done)
        self.docs, self.blocks = ([], [[], []]) if done else (docs[-1:], rest)
        self.held = sum(len(x[2]) for own in self.blocks for x in own)

    def _groups(self, docs, doc, ids, group, owner, n_groups, done) -> Iterator[dict]:
        n = [np.bincount(g, minlength=n_groups) for g in group]
        links = n[0] * n[1]
        first = [np.cumsum(x) - x for x in n]
        words = self._words(ids, group, n, first)
        starts = np.searchsorted(owner, np.arange(len(docs) + 1))
        token_starts = np.concatenate([[0], np.cumsum(n[0] + n[1])])[starts].tolist()
        pairs, times, wide = self._pairs(ids, group, n, links, first, owner)
        cuts = np.searchsorted(pairs // self.width, np.arange(len(docs) + 1))
        pairs = pairs % self.width
        totals = np.stack([np.concatenate([[0], np.cumsum(x)])[starts] for x in (*n, np.ones(n_groups, np.int64), links)], 1)
        totals = np.diff(totals, axis=0)
        for i, (uid, doc_id) in enumerate(docs):
            if i:
                self.clear()
            whole = done or i < len(docs) - 1
            text = "".join(words[token_starts[i] : token_starts[i + 1]])
            if text:
                self.hash.update((";" if self.counts[2] else "").encode() + text[:-1].encode())
            self.counts = [x + int(y) for x, y in zip(self.counts, totals[i], strict=True)]
            own = slice(cuts[i], cuts[i + 1])
            rows = [(pairs[own][j : j + PAIRS], times[own][j : j + PAIRS]) for j in range(0, cuts[i + 1] - cuts[i], PAIRS)] + wide.get(i, [])
            alone = whole and self.parts == 0 and len(rows) <= 1
            for own, count in rows[:-1] if whole else rows:
                yield {"uid": uid, "doc_id": doc_id, "whole": False, "alone": False, "pairs": own, "times": count}
            self.parts += len(rows)
            if whole:
                own, count = rows[-1] if rows else ([], [])
                sha = self.hash.hexdigest() if self.counts[2] else ""
                yield {"uid": uid, "doc_id": doc_id, "whole": True, "alone": alone, "pairs": own, "times": count, "groups_sha256": sha} | dict(zip(("n_a", "n_b", "n_groups", "n_links"), self.counts, strict=True))
        if done:
            self.clear()

    def _words(self, ids, group, n, first) -> list[str]:
        """Ids in the order of the digest's text, each with the sign that follows it."""
        before = [first[1], first[0] + n[0]]
        out = np.empty(sum(map(len, ids)), object)
        for side in (0, 1):
            own, g = ids[side].astype(np.int64), group[side]
            final = np.arange(len(own)) - first[side][g] == n[side][g] - 1
            out[np.arange(len(own)) + before[side][g]] = self.names[side][own + final * (len(self.names[side]) // 2)]
        return out.tolist()

    def _pairs(self, ids, group, n, links, first, owner):
        """Distinct pairs (document's place * width + pair) with how often they are linked; for groups of very many links the same by document."""
        a, b = (x.astype(np.int64) for x in ids)
        at = np.flatnonzero(links[group[0]] <= SMALL)
        g = group[0][at]
        repeat = n[1][g]
        turn = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        linked = a[np.repeat(at, repeat)] * self.n_b + b[turn + np.repeat(first[1][g], repeat)]
        codes, times = np.unique(linked + np.repeat(owner[g], repeat) * self.width, return_counts=True)
        wide: dict[int, list] = {}
        for g in np.flatnonzero(links > SMALL).tolist():
            (x, nx), (y, ny) = (np.unique(own[first[side][g] : first[side][g] + n[side][g]], return_counts=True) for side, own in enumerate((a, b)))
            step = max(1, PAIRS // len(y))
            for i in range(0, len(x), step):
                some = slice(i, i + step)
                wide.setdefault(int(owner[g]), []).append(((x[some, None] * self.n_b + y).ravel(), (nx[some, None] * ny).ravel()))
        return codes, times, wide


def _table(rows: list[dict]) -> pa.RecordBatch:
    def lists(name: str) -> pa.Array:
        own = [np.asarray(r[name], np.int64) for r in rows]
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32), np.concatenate(own))

    plain = {c: pa.array([r.get(c) for r in rows], kind) for c, kind in (("uid", pa.int64()), ("doc_id", pa.int64()), ("whole", pa.bool_()), ("alone", pa.bool_()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()))}
    return pa.record_batch(plain | {c: lists(c) for c in ("pairs", "times")})


def _swept(batches: Iterator[pa.RecordBatch], vocabularies: Sequence[int], size_kinds: Sequence[np.dtype]) -> Iterator[pa.RecordBatch]:
    machine = Sweep(vocabularies, size_kinds)
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("uid", "doc_id", "at", "side", "ids", "sizes")], strict=True):
            rows = list(machine.take(*row))
            if rows:
                yield _table(rows)
    rows = list(machine.flush(done=True))
    if rows:
        yield _table(rows)


def end_events(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of token end events of both sides; a document without tokens has one empty block. uid tells rows of docs apart."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _events(it, a_path, b_path), EVENTS)


def sweep(events: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The rows of links of the machine, from events in any order."""
    both = _tokenizers(a_path, b_path)
    vocabularies, size_kinds = [len(t) for t in both.tokens], both.size_kinds
    ordered = events.repartition("uid").sortWithinPartitions("uid", "at", "side")
    return ordered.mapInArrow(lambda it: _swept(it, vocabularies, size_kinds), SWEPT)


def pair_counts(swept: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, top): in how many documents a pair is linked, and whether no pair of its A id is in more. Written.

    Documents whose links are spread over several rows are made distinct first; all others' rows already are.
    """
    one = swept.where("alone").select(F.explode("pairs").alias("pair"))
    several = swept.where("not alone").select("uid", F.explode("pairs").alias("pair")).distinct().select("pair")
    counts = cut(one.unionByName(several).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.expr(f"pair div {n_b}")), "counts")
    best = counts.groupBy(F.col("a").alias("_a")).agg(F.max("n").alias("most"))
    return cut(counts.join(best, counts["a"] == best["_a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("top")), "pairs")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text (to which it adds the space). Null and empty texts, and texts that either
    side's bytes don't give back, have no tokens: zeros and an empty groups_sha256. Repeated rows and null doc_ids are
    documents like any other. Only doc_id and text are read, so other columns' names don't matter; an empty table gives no
    rows. A long text's events are streamed; of a hot pair no task holds more than the pairs of its own rows.
    """
    with tidy() as keep:
        swept = cut(sweep(end_events(docs, a_path, b_path), a_path, b_path), "swept")
        stats = pair_counts(swept, len(_tokenizers(a_path, b_path).tokens[1]))
        frequent = cut(stats.orderBy(F.desc("n"), "pair").limit(FREQUENT), "frequent")
        links = swept.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        rare = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(stats, "pair")
        common = links.join(F.broadcast(frequent), "pair")
        sums = [F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
        each = [part.groupBy("uid").agg(*sums) for part in (common, rare)]
        sums = each[0].unionByName(each[1]).groupBy(F.col("uid").alias("_uid")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        rows = swept.where("whole").drop("pairs", "times")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return keep(cut(rows.join(sums, rows["uid"] == sums["_uid"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), "aligned"))


def op11_token_alignment(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
