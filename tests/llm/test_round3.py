"""Alignment, exact dedup and centroid clustering against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import align, common, exact, hnsw, kmeans, language, sharding

P = pytest.importorskip("public_tokenizers")
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [(1, None), (2, ""), (3, "One two three"), (3, "One two three"), (4, "one TWO three"), (None, "x " * 5000), (None, None), (5, "!!! 日本語 $$$"), (6, "ÀÉ one"), (7, "àé one"), (8, "ﬁ ▁ <0x41>"), (9, "<|endoftext|> </s>")]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns whose names clash with the operators' own."""
    clash = "digest string, uid long, n int, best int, at int, side int, pairs int, row int, id int, frequent boolean"
    return spark.createDataFrame([(i, t, "d", 1, 2, 3, 4, 5, 6, 7, 8, True) for i, t in ODD], f"doc_id long, text string, {clash}")


def _plain_alignment(rows):
    """The contract, document by document, from whole texts and lists of all linked occurrences."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path(A)), sentencepiece.SentencePieceProcessor(model_file=P.path(B))
    a.encode_special_tokens = True
    tokens = align.byte_level_tokens(P.path(A)), align.piece_tokens(b)
    out = []
    for doc_id, text in rows:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        if text and any(b"".join(t[i] for i in own) != (" " + text).encode() for t, own in zip(tokens, ids, strict=True)):
            ids = [[], []]
        ends = [np.cumsum([len(t[i]) for i in own]).tolist() for t, own in zip(tokens, ids, strict=True)]
        links, groups, start = [], [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ([i for i, e in zip(own, at, strict=True) if start < e <= end] for own, at in zip(ids, ends, strict=True))
            links += [(i, j) for i in x for j in y]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            start = end
        out.append([doc_id, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for r in out for p in set(r[4]))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return sorted([str((d, na, nb, ng, len(ln), sum(count[p] == most[p[0]] for p in ln), sum(count[p] for p in ln), sha)) for d, na, nb, ng, ln, sha in out])


def _aligned(df):
    return sorted(str(tuple(r)) for r in align.align(df, P.path(A), P.path(B)).collect())


def test_alignment_of_odd_rows(odd):
    assert _aligned(odd) == _plain_alignment(ODD)
    assert align.align(odd.limit(0), P.path(A), P.path(B)).count() == 0


def test_alignment_equals_brute_force(spark, monkeypatch):
    """Random texts; blocks, flushes and rows so small that documents, groups and links are split, and most pairs are rare."""
    rnd = random.Random(5)
    pool = ["the", " ", "  ", "\n", "\t ", " the", " alignment", "'s", "1234567", "====", "=", "日本", "é", "😀", "▁", " ", "\x1c", "\x85", "Ünïcode", ".", " <s>", "á", " supercalifragilistic", "antidisestablishment", "x" * 40]
    rows = [(i, "".join(rnd.choice(pool) for _ in range(rnd.choice([1, 3, 30, 400])))) for i in range(60)] + [(60, "".join(chr(rnd.randint(0x3400, 0x9FFF)) for _ in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _plain_alignment(rows)
    assert _aligned(df) == want
    both = align.Tokenizers(P.path(A), P.path(B))
    for block, flush, small, pairs in ((7, 20, 3, 5), (3, 10**6, 1, 10**6), (10**6, 5, 10**6, 3)):
        for name, value in (("BLOCK", block), ("FLUSH", flush), ("SMALL", small), ("PAIRS", pairs)):
            monkeypatch.setattr(align, name, value)
        blocks = [r for batch in align._events(iter(df.selectExpr("doc_id as uid", "doc_id", "text").toArrow().to_batches()), P.path(A), P.path(B)) for r in batch.to_pylist()]
        machine, out = align.Sweep([len(t) for t in both.tokens], both.size_kinds), []
        for r in sorted(blocks, key=lambda r: (r["uid"], r["at"], r["side"])):
            out += machine.take(*r.values())
        out += machine.flush(done=True)
        got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out if r["whole"]}
        assert {str(k): v for k, v in got.items()} == {w[0]: (int(w[1]), int(w[2]), int(w[3]), int(w[4]), w[7]) for w in (x.strip("()").replace("'", "").split(", ") for x in want)}
        assert len(got) == len(rows) and sum(r["whole"] for r in out) == len(rows)
        if block == 7:
            total = Counter()
            for r in out:
                total[r["doc_id"]] += int(np.sum(r["times"]))
            assert all(total[k] == v[3] for k, v in got.items())
            assert any(not r["whole"] for r in out)


def test_alignment_with_few_frequent_pairs(spark, monkeypatch):
    monkeypatch.setattr(align, "FREQUENT", 3)
    rows = [(i, f"the same words {i} and number {i % 7}") for i in range(40)] + [(40, "the " * 300)]
    assert _aligned(spark.createDataFrame(rows, "doc_id long, text string")) == _plain_alignment(rows)


def _low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def _plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(_low(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept = [True] + [False] * (len(ids) - 1)
        ids = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        out += [str((i, best, len(ids), k, hashlib.sha256(t.encode()).hexdigest())) for i, k in zip(ids, kept, strict=True)]
    return sorted(out)


@pytest.mark.parametrize("share", [2, 4, 1024])
def test_exact_groups(spark, odd, share):
    assert sorted(str(tuple(r)) for r in exact.exact_groups(odd, share).collect()) == _plain_groups(ODD)
    rnd = random.Random(share)
    rows = [(i, rnd.choice(["hot", "HOT", "Warm", f"t{rnd.randint(0, 60)}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(str(tuple(r)) for r in exact.exact_groups(df, share).collect()) == _plain_groups(rows)
    assert exact.exact_groups(odd.limit(0), share).count() == 0


@pytest.mark.parametrize("share", [2, 1024])
def test_drop_duplicates(odd, share):
    left = exact.drop_duplicates(odd, share)
    assert left.columns == odd.columns
    got = left.collect()
    assert len(got) == len({_low(t) for _, t in ODD}) == len({_low(r.text) for r in got})
    assert {r.doc_id for r in got} == {None, 2, 4, 5, 6, 7, 8, 9}


def test_frequent_digests_are_all_found(spark):
    """Every digest above the share, none below it, with exact counts, when it is spread over partitions or in one."""
    rows = [("a",)] * 130 + [("b",)] * 101 + [("c",)] * 99 + [(f"x{i}",) for i in range(670)]
    df = spark.createDataFrame(rows, "t string").select(F.col("t").cast("binary").alias("digest"), F.lit(1).alias("doc_id"), F.monotonically_increasing_id().alias("uid"))
    for n in (1, 9):
        got = {bytes(r.digest): r.n for r in exact.frequent(df.repartition(n), 10).collect()}
        assert got == {b"a": 130, b"b": 101}


def test_misra_gries_bound():
    rnd = random.Random(3)
    stream = [int(rnd.paretovariate(0.7)) for _ in range(20_000)]
    summary = Counter()
    for i in range(0, len(stream), 500):
        summary = exact.misra_gries(summary, Counter(stream[i : i + 500]), 49)
    true = Counter(stream)
    assert len(summary) <= 49 and all(true[x] - len(stream) / 50 <= summary[x] <= true[x] for x in true)


def _plain_kmeans(rows, k, rounds):
    """Lloyd's rounds in whole numbers, one vector at a time."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0], r[1]))
    centres = [v for _, v in rows[:k]]
    nearest = lambda v: min((sum((p - q) ** 2 for p, q in zip(v, c, strict=True)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in rows]
        for i in range(len(centres)):
            mine = [v for (_, v), c in zip(rows, own, strict=True) if c == i]
            centres[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else centres[i]
    out = [(i, *reversed(nearest(v))) for i, v in rows]
    return sorted(str((i, c, d, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())) for i, c, d in out)


@pytest.mark.parametrize("spread", [1, 4, 300])
def test_kmeans_equals_brute_force(spark, spread):
    """Few values give many equal distances; far clumps let bounds certify; repeated ids and vectors, a null id."""
    rnd = random.Random(spread)
    clumps = [[rnd.randint(-spread, spread) * 5 for _ in range(8)] for _ in range(9)]
    rows = [(i % 390, [x + rnd.randint(-1, 1) * (spread < 300) for x in rnd.choice(clumps)]) for i in range(400)] + [(None, [0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    scans = []
    got = kmeans.cluster(df, 7, 4, scans=scans).collect()
    assert sorted(str(tuple(r)) for r in got) == _plain_kmeans(rows, 7, 4)
    if spread == 300:
        assert scans[0] == 401 and scans[-1] < 200, scans


def test_kmeans_edges(spark):
    schema = "vec_id long, v array<long>"
    assert kmeans.cluster(spark.createDataFrame([], schema)).count() == 0
    few = [(1, [1, 2]), (2, [5, 5]), (3, [2**25, -(2**25)])]
    assert sorted(str(tuple(r)) for r in kmeans.cluster(spark.createDataFrame(few, schema)).collect()) == _plain_kmeans(few, 16, 3)
    with pytest.raises(Exception, match="components of"):
        kmeans.cluster(spark.createDataFrame([(1, [2**26])], schema)).collect()


def test_kmeans_query_leaves_out_unusable_vectors(spark, tmp_path):
    rows = [(1, [0.5] * 64), (2, None), (3, [0.5] * 63), (4, [0.5] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] * 64), (7, [-0.3] * 64), (7, [-0.3] * 64)]
    spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = kmeans.op13_kmeans(spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == [1, 7, 7] and all(r.distance == 0 and r.inertia == 0 for r in got)


def test_shards_keep_columns_of_any_name_and_type(spark, tmp_path):
    names = ["size", "shard", "slot", "law", "bucket", "grown_shard", "row", "own", "carried", "text_crc32"]
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), *[F.lit(i).alias(n) for i, n in enumerate(names)], F.create_map(F.lit("k"), F.lit("v")).alias("m"))
    docs.drop("m").write.parquet(f"{tmp_path}/documents.parquet")
    written = sharding.write_shards(docs, f"file://{tmp_path}/shards", 5)
    rows = written.orderBy("_shard", "_slot").collect()
    assert len(rows) == 300 and all(r["m"] == {"k": "v"} and [r[n] for n in names] == list(range(len(names))) for r in rows)
    for shard in range(5):
        own = [r for r in rows if r["_shard"] == shard]
        assert [r["_slot"] for r in own] == list(range(len(own)))
        assert [r["doc_id"] for r in own] != sorted(r["doc_id"] for r in own)
    got = sharding.op2_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and got.count() == 300


def test_shards_against_plain_python(spark):
    """The law and the slots, recomputed row by row from Spark's hash of each key."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.array(*[F.xxhash64(F.lit(7), F.lit(s), F.col("doc_id")) for s in range(9)]).alias("h")).collect()}
    for r in sharding.shard_rows(docs, 8).collect():
        h = hashes[r.doc_id]
        assert r.shard == max(range(8), key=lambda s: h[s]) and r.grown_shard == max(range(9), key=lambda s: h[s])


def test_a_thousand_languages(spark):
    """One word for each language; every language is told by its own word."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1000)]
    docs = spark.createDataFrame([(i, f"{w} {w} {w}", f"l{i:04}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    model = language.train(docs)
    got = language.identify(docs.where("doc_id % 20 = 0"), model).collect()
    assert len(model.languages) == 1000 and all(r.lang_pred == f"l{r.doc_id:04}" for r in got)


def test_words_split_at_signs():
    assert language.words_of("ab½cd Ⅷx é_1 ²") == ["ab", "cd", "x", "é"] and language.words_of("½") == [] and language.words_of("a1b") == ["a", "b"]


def test_embedding_links_over_shards_and_blocks(spark, monkeypatch):
    """Dense groups larger than a beam, single pairs, ties and two labels, over several shards, blocks and parts: links and components by brute force."""
    for name, value in (("SHARD_ROWS", 300), ("QUERY_ROWS", 90), ("PART_ROWS", 40)):
        monkeypatch.setattr(hnsw, name, value)
    rnd = np.random.RandomState(4)
    dense = [c + 0.02 * rnd.randn(12) for c in rnd.randn(2, 12) for _ in range(320)]
    pairs = [v for c in rnd.randn(60, 12) for v in (c, c + 0.05 * rnd.randn(12))]
    x = np.array(dense + pairs + list(rnd.randn(100, 12)) + [pairs[0]])
    labels = rnd.randint(0, 2, len(x))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while (root != (new := np.minimum(root, np.where(near, root[None, :], len(x)).min(1)))).any():
        root = new
    assert got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(x))}
    assert near.sum(1).max() > 2 * hnsw.BEAM


def test_dense_links_need_little_memory():
    import tracemalloc

    rnd = np.random.RandomState(1)
    x = rnd.randn(1, 16) + 0.01 * rnd.randn(3000, 16)
    graph = hnsw.Hnsw(hnsw.unit(x))
    tracemalloc.start()
    links = sum(len(a) for a, _ in graph.linked_parts(hnsw.unit(x), 0.93))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == 9_000_000 and peak < 120e6, peak


def test_scratch_tables_go_after_an_error(spark, tmp_path):
    made = []
    with pytest.raises(ZeroDivisionError), common.tidy():
        made.append(common.cut(spark.range(3)))
        with common.tidy() as keep:
            kept = keep(common.cut(spark.range(4)))
            made.append(common.cut(spark.range(5)))
        assert kept.count() == 4
        raise ZeroDivisionError
    from pathlib import Path

    assert not any(Path(t._sedimenta_path.removeprefix("file://")).exists() for t in [*made, kept])
