"""Byte-level BPE encoding and decoding.

A text is split into pre-tokens. Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is
a token itself with one probe and one comparison. Tier two: the bytes of any other pre-token form a doubly linked
list; a heap of (rank, place) yields the lowest-ranked adjacent pair, stale entries are skipped. Each pre-token is
encoded on its own, so a text of any length needs memory for its own tokens only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from sedimenta.llm.common import ship, text_or_empty

#: Pre-tokens remembered by a worker, and the longest that is.
MEMO_TOKENS = 400_000
MEMO_CHARS = 48
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a rank file: base64 of the token and its rank on each line, ranks without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _slot(h: int, d: int, n: int) -> int:
    """Where displacement d sends hash h."""
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots. Keys that share a first hash get one displacement
    that sends them all to free slots; a lone key names its slot directly, as -slot - 1."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        hashes = [xxh64_intdigest(k) for k in keys]
        self.places, self.values = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        rows: list[list[int]] = [[] for _ in range(n)]
        for i, h in enumerate(hashes):
            rows[h % n].append(i)
        free = bytearray(b"\1" * n)
        order = sorted((r for r in rows if r), key=len, reverse=True)
        singles = [r[0] for r in order if len(r) == 1]
        for row in (r for r in order if len(r) > 1):
            d = 1
            while True:
                slots = [_slot(hashes[i], d, n) for i in row]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.places[hashes[row[0]] % n] = d
            for i, s in zip(row, slots, strict=True):
                free[s], self.values[s] = 0, i
        spare = iter([s for s in range(n) if free[s]])
        for i in singles:
            s = next(spare)
            self.places[hashes[i] % n], self.values[s] = -s - 1, i

    def candidate(self, key: bytes) -> int:
        """The one key index that may equal key."""
        h = xxh64_intdigest(key)
        d = int(self.places[h % self.n])
        return int(self.values[-d - 1 if d < 0 else _slot(h, d, self.n)])


# Letters, numbers and white space below U+0250, as classes for the standard library's matcher.
_LOW = "[^\x00-ɏ]"
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
#: Unicode White_Space.
_SPACE = _S + "  -     　"


def splitter(pattern: str):
    """A function that lists a text's pre-tokens. Texts below U+0250 use the standard library with the classes spelled out, which is faster."""
    wide = regex.compile(_expand(pattern, r"\p{L}", r"\p{N}", _SPACE)).findall
    low = re.compile(_expand(pattern, _L, _N, _S)).findall
    above = re.compile(_LOW).search
    return lambda text: wide(text) if above(text) else low(text)


def _expand(pattern: str, letters: str, numbers: str, space: str) -> str:
    """The pattern with its classes replaced; inside brackets only the members are put in."""
    out, inside, i = [], False, 0
    names = {r"\p{L}": letters, r"\p{N}": numbers, r"\s": space, r"\S": "^" + space}
    while i < len(pattern):
        name = next((n for n in names if pattern.startswith(n, i)), None)
        if name:
            out.append(names[name] if inside else f"[{names[name]}]")
            i += len(name)
        elif pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Codec(dict):
    """Encoder and decoder; as a dict it remembers the ids of pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        super().__init__()
        self.tokens, self.hash, self.split = tokens, PerfectHash(tokens), splitter(pattern)
        ids = {t: i for i, t in enumerate(tokens)}
        self.bytes = [ids.get(bytes([b]), -1) for b in range(256)]
        self.pairs = {}
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = ids.get(t[:cut]), ids.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = i

    def __missing__(self, pre: str) -> tuple[int, ...]:
        raw = pre.encode("utf-8", "replace")
        whole = self.hash.candidate(raw)
        ids = (whole,) if whole >= 0 and self.tokens[whole] == raw else self.merged(raw)
        if len(pre) <= MEMO_CHARS:
            if len(self) >= MEMO_TOKENS:
                self.clear()
            self[pre] = ids
        return ids

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Merge adjacent pairs, lowest rank first, leftmost first among equals."""
        part = [self.bytes[b] for b in raw]
        if min(part, default=0) < 0:
            raise ValueError("the vocabulary lacks a byte")
        n, pair = len(part), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pair(part[i] << 32 | part[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i] if part[i] >= 0 else n
            if j >= n or pair(part[i] << 32 | part[j]) != rank:
                continue
            part[i], part[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pair(rank << 32 | part[k])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := pair(part[h] << 32 | rank)) is not None:
                heappush(heap, (r, h))
        return tuple(p for p in part if p >= 0)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.split(text))), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


_CODECS: dict[tuple, Codec] = {}


def codec(tokens: list[bytes], pattern: str, key) -> Codec:
    """One codec for each worker process and vocabulary."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


_KINDS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _encode(batches: Iterator[pa.RecordBatch], tokens, pattern: str, key, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    own = codec(tokens.value, pattern, key)
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part, out = b.slice(at, 512), {c: [] for c in columns}
            for t in part.column(1):
                ids = own.encode(t.as_py())
                for c, values in out.items():
                    if c == "n_tokens":
                        values.append(len(ids))
                    elif c == "ids":
                        values.append(ids.astype(np.int32))
                    else:
                        values.append(hashlib.sha256(ids.tobytes() if c == "ids_sha256" else own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[c], _KINDS[c]) for c in columns)], ["doc_id", *columns])


def _decode(batches: Iterator[pa.RecordBatch], tokens) -> Iterator[pa.RecordBatch]:
    table = tokens.value
    for b in batches:
        texts = [b"".join(map(table.__getitem__, ids or ())) for ids in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])


def _run(docs: DataFrame, path: str, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    tokens = read_ranks(path)
    key = (hashlib.sha256(b"\n".join(tokens)).hexdigest(), pattern)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} { {'n_tokens': 'bigint', 'ids': 'array<int>'}.get(c, 'string') }" for c in columns)
    work = partial(_encode, tokens=spark.sparkContext.broadcast(tokens), pattern=pattern, key=key, columns=columns)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(work, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row by the rank file at path; special tokens are ordinary text.

    Null and empty texts have no tokens. Repeated rows get a row each, an empty table none; other columns are ignored. The broadcast is the
    vocabulary, whose size is fixed.
    """
    return _run(docs, path, pattern, ("n_tokens", "ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows with doc_id and ids; null ids give no bytes."""
    spark = encoded.sparkSession
    ship(spark)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, tokens=spark.sparkContext.broadcast(read_ranks(path))), f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, perhaps ids, and the digests of ids and decoded bytes."""
    return _run(docs, path, pattern, ("n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"))


def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
