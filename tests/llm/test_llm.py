"""Operators against brute force, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import bpe, common, hnsw, language, lines, mixing, sharding, simhash, topk, toxicity, warc

P = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"
ODD = [(1, None), (2, ""), (3, "One two three four five"), (3, "One two three four five"), (4, "one two three four five"), (None, "x " * 5000), (5, "!!! 日本語 $$$")]


@pytest.fixture
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7) for i, t in ODD], "doc_id long, text string, lang string, source string, n_kept int, fp int, root int")


def test_codec_equals_tiktoken():
    tiktoken = pytest.importorskip("tiktoken")
    own = bpe.Codec(bpe.read_ranks(P.path(RANKS)), P.PATTERN)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    pool = ["a", "é", " ", "  ", "\n", "'s", "ß", "1", "²", "!", "中", " ", "\x1c", "\x85", "the", "😀", "ª", "_", "\t", "٣", "Ⅷ", "ö"]
    rnd = random.Random(1)
    for _ in range(3000):
        x = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))
        ids = own.encode(x)
        assert ids.tolist() == other.encode_ordinary(x) and own.decode(ids) == x.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(1000)]
    h = bpe.PerfectHash(keys)
    assert [h.candidate(k) for k in keys] == list(range(1000))


def test_bpe_rows(odd):
    r = bpe.round_trip(odd, P.path(RANKS), P.PATTERN).collect()
    assert len(r) == len(ODD)
    want = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD}
    assert {x.decoded_sha256 for x in r} == want
    ids = bpe.encode(odd, P.path(RANKS), P.PATTERN)
    assert {bytes(x.bytes).decode() for x in bpe.decode(ids, P.path(RANKS)).collect()} == {t or "" for _, t in ODD}
    assert bpe.round_trip(odd.limit(0), P.path(RANKS), P.PATTERN).count() == 0


def test_sharding(spark, odd):
    r = sharding.shard_rows(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("é").alias("text")), 8).toPandas()
    assert (r["size"] == 18).all() and (r.text_crc32 == zlib.crc32("é".encode())).all()
    for _, own in r.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    moved = r[r.grown_shard != r.shard]
    assert len(moved) and (moved.grown_shard == 8).all()
    assert sharding.shard_rows(odd, 3).count() == len(ODD) and sharding.shard_rows(odd.limit(0), 3).count() == 0


def brute_components(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.id: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    pairs = {frozenset(e) for e in edges}
    want = brute_components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    groups = lambda roots: sorted(sorted(n for n, r in zip(nodes, roots, strict=True) if r == x) for x in set(roots))
    assert groups([got[n] for n in nodes]) == groups(want)


def test_simhash(spark, odd):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("abcdefghij") * 2 for _ in range(40)) for _ in range(6)]
    texts = [b if k == 0 else b[: 60 - k] + " zz " + b[60 - k :] for b in base for k in range(8)] + ["", " "]
    r = {x.doc_id: x for x in simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = [simhash.fingerprint(t) & (2**64 - 1) for t in texts]
    want = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert [r[i].component_id for i in range(len(texts))] == want
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == len(ODD) and simhash.fingerprint("") == 0
    assert {x.component_id for x in got if x.doc_id in (1, 2)} == {1} and {x.component_id for x in got if x.doc_id in (3, 4)} == {3}
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


@pytest.mark.parametrize("tau", [2, 3])
def test_dense_fingerprints_link(spark, tau):
    rnd = random.Random(7)
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for c in (rnd.getrandbits(62), -rnd.getrandbits(62)) for _ in range(150)}
    prints = sorted({(f + 2**63) % 2**64 - 2**63 for f in prints})
    df = spark.createDataFrame([(f,) for f in prints], "fp long")
    filed = simhash.filed(df, [list(range(8))])
    got = {r.id: r.root for r in simhash.near_links(filed, tau).collect()}
    far = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    want = brute_components(prints, lambda x, y: (x ^ y) & 0xFF == 0 and far(x, y) <= tau)
    whole = brute_components(prints, lambda x, y: far(x, y) <= tau)
    groups = lambda roots: {frozenset(f for f, r in zip(prints, roots, strict=True) if r == x) for x in set(roots)}
    mine = groups([got.get(f, f) for f in prints])
    assert all(any(g <= m for m in mine) for g in groups(want)) and all(any(m <= g for g in groups(whole)) for m in mine)
    balls = {r.id: r.root for r in common.components(simhash.ball_links(df, tau)).collect()}
    assert groups([balls.get(f, f) for f in prints]) == groups(whole)


def test_plan_finds_every_near_pair():
    rnd = np.random.RandomState(4)
    fps = rnd.randint(0, 2**63, 200).astype(np.uint64)
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for n, tau in ((200, 2), (10**9, 2), (10**9, 4)):
        masks = [sum(1 << b for b in m) for m in simhash.plan(bits.T @ bits * n / 200, n, tau)]
        for f in fps[:50].tolist():
            g = f
            for b in rnd.choice(64, tau, replace=False):
                g ^= 1 << int(b)
            assert any(f & m == g & m for m in masks)


def test_lines(spark, odd):
    long = "the quick brown fox jumps over the lazy dog near the river bank while seven grey geese watch from a hill"
    docs = [(1, f"{long}\nshared line here\n\nonly one"), (2, f"Shared  LINE, here\n{long}\nonly two"), (3, None), (4, "")]
    r = {x.doc_id: x for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert r[1].text == docs[0][1] and r[2].text == "only two" and r[3].text is None and r[4].text == ""
    assert (r[2].n_lines, r[2].n_kept) == (3, 1)
    named = spark.createDataFrame([(1, "same words here", 5), (1, "same words here", 5), (1, None, 5)], "doc_id long, text string, _at int").select("doc_id", "text", *[F.col("_at").alias(c) for c in ("_at", "_parts", "_doc", "_tag", "_stay", "stay", "parts", "at", "row", "tag")])
    assert sorted((r.text is None, r.text or "") for r in lines.dedup_lines(named).collect()) == [(False, ""), (False, "same words here"), (True, "")]
    assert lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(odd.limit(0)).count() == 0


def test_edit_bounds_equal_levenshtein(spark):
    rnd = random.Random(8)
    rows = []
    for k in range(600):
        a = [rnd.choice(["ab", "b", "cab", "aa", "é"]) for _ in range(rnd.randint(0, 12) * (1 + 20 * (k % 7 == 0)))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 1)] = [rnd.choice(["ab", "c", "aaa"])] * rnd.randint(0, 2)
        rows.append((" ".join(a), " ".join(b), rnd.randint(0, 12)))
    df = spark.createDataFrame(rows, "ta string, tb string, most int")
    want = [r.ok for r in df.coalesce(1).select((F.levenshtein("ta", "tb") <= F.col("most")).alias("ok")).collect()]
    assert [lines.edits_within(*r) for r in rows] == want and 100 < sum(want) < 500


def test_line_prints():
    """Fingerprints and sketches of lines, each by itself and in plain Python."""
    rnd = random.Random(3)
    texts = ["a", "a b", "c d e " * 70, "é", " ".join(f"w{i % 999}" for i in range(7_000)), "x " * 4_000 + "y", *[" ".join("ab"[: rnd.randint(1, 2)] * rnd.randint(1, 7) for _ in range(rnd.randint(1, 9))) for _ in range(60)]]
    raw = [t.strip().encode() for t in texts]
    prints, keys = lines.sketched(raw)
    mixed = lambda x: int(lines._mixed(np.array([x & (2**64 - 1)], np.uint64))[0])
    for line, fp, own in list(zip(raw, prints.tolist(), keys.tolist(), strict=True))[:4] + list(zip(raw, prints.tolist(), keys.tolist(), strict=True))[6:]:
        words = [mixed(int.from_bytes(w[:8], "little") + len(w) * 0xC2B2AE3D27D4EB4F) for w in line.split(b" ")]
        assert fp & (2**64 - 1) == sum(1 << i for i in range(64) if 2 * sum(w >> i & 1 for w in words) > len(words))
        marked = line + b"\x02" * 8
        grams = [mixed(int.from_bytes(marked[i : i + 8], "little") ^ (marked[i + 8] * 0xC2B2AE3D27D4EB4F % 2**64)) >> 32 for i in range(len(line))]
        least = [min(((g ^ int(f)) * int(t)) % 2**32 for g in grams) for f, t in zip(lines._FLIP, lines._TIMES, strict=True)]
        assert [k & (2**64 - 1) for k in own] == [mixed((least[2 * i] << 32 | least[2 * i + 1]) + i + 1) for i in range(lines.SKETCHES)]
    assert lines.normal_lines("A_b,,C\n\n  É½ \t1!\nß\r\n__") == ["a b c", "", "é½ 1", "ß", ""]
    alone = [lines.sketched([x]) for x in raw]
    assert [int(p[0]) for p, _ in alone] == prints.tolist() and [k[0].tolist() for _, k in alone] == keys.tolist()


def test_crowded_buckets_link(spark):
    rnd = random.Random(9)
    items = [(i, rnd.randrange(2), rnd.randrange(1200)) for i in range(700)]
    df = spark.createDataFrame([(k, i, v) for i, k, v in items], "key long, id long, fp long")
    place = {i: v for i, _, v in items}
    near = F.udf(lambda a, b: abs(place[a] - place[b]) <= 1, "boolean")
    got = {r.id: r.root for r in common.link(df, lambda pairs: pairs.where(near("a", "b")), 64).collect()}
    want = brute_components(items, lambda x, y: x[1] == y[1] and abs(x[2] - y[2]) <= 1)
    groups = lambda roots: {frozenset(n for n, r in zip(range(700), roots, strict=True) if r == x) for x in set(roots)}
    assert groups([got.get(i, i) for i in range(700)]) == groups(want)


def test_top_k():
    rnd = np.random.RandomState(5)
    x = rnd.randint(-20, 20, (900, 8)).astype(float)
    x[100:400] = x[100]
    ids = rnd.permutation(5000)[:900].astype(np.int64)
    s = topk.Search(x[:50], ids[:50], x, ids, 7)
    for i in range(50):
        score = x @ x[i]
        want = sorted((-score[j], ids[j]) for j in range(900) if j != i)[:7]
        assert list(zip(-s.scores[i], s.found[i], strict=True)) == want


def test_top_k_prunes_and_keeps_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 48)
    rnd = np.random.RandomState(15)
    x = np.floor(64 * (rnd.randn(40, 24)[rnd.randint(0, 40, 6000)] + 0.05 * rnd.randn(6000, 24)))
    ids = np.arange(6000, dtype=np.int64)
    s = topk.Search(x[:300], ids[:300], x, ids, 5)
    leaves = lambda t: sum(map(leaves, t.children)) if t.children else 1
    assert s.visits < 0.5 * leaves(topk.cover_tree(x)) * leaves(topk.cover_tree(x[:300]))
    score = x[:300] @ x.T
    score[np.arange(300), np.arange(300)] = -np.inf
    assert (s.scores == -np.sort(-score, 1)[:, :5]).all()
    big = 2**53
    rows = [(big, [1]), (big + 1, [1]), (big + 1, [1]), (1, [2]), (2, [3])]
    df = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    assert {r.vec_id for r in topk.top_k(df, df.where("vec_id = 1"), 9).collect()} == {2, big, big + 1}


def test_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    rnd = np.random.RandomState(16)
    x = rnd.randint(-9, 9, (200, 6))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, v array<bigint>, score int")
    got = topk.top_k(df, df.where("vec_id % 4 = 0"), 3).collect()
    for i in range(0, 200, 4):
        want = sorted((-int(x[j] @ x[i]), j) for j in range(200) if j != i)[:3]
        assert sorted((-r.score, r.vec_id) for r in got if r.query_id == i) == want


def test_top_k_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0]), (4, [3.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable()).select("vec_id", F.transform("embedding", lambda c: c.cast("long")).alias("v"))
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()]
    assert got == [(1, 1, 5), (2, 4, 3), (3, 5, 0)]
    assert topk.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_embedding_groups(spark):
    rnd = np.random.RandomState(6)
    centre = rnd.randn(30, 16)
    x = centre[rnd.randint(0, 30, 300)] + 0.12 * rnd.randn(300, 16)
    label = rnd.randint(0, 2, 300)
    rows = [(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, rows[0][1], None), (303, rows[0][1], rows[0][2])]
    got = {r.vec_id: r for r in hnsw.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    v = np.array([r[1] for r in rows[:300]] + [rows[0][1]], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    k = np.append(label, rows[0][2])
    near = (v @ v.T >= 0.93) & (k[:, None] == k)
    np.fill_diagonal(near, False)
    order = [*range(300), 303]
    assert sum(got[i].n_links for i in order) >= 0.9 * near.sum()
    assert all(got[i].n_links <= near[j].sum() for j, i in enumerate(order))
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302)) and got[303].component_id <= 0


def test_graphs_find_links_by_beams():
    rnd = np.random.RandomState(26)
    for n in (1, 30, 150, 3000):
        x = rnd.randn(max(1, n // 6), 16)[rnd.randint(0, max(1, n // 6), n)] + 0.1 * rnd.randn(n, 16)
        v = hnsw.unit(x)
        graph = hnsw.Hnsw(v)
        calls, beam = [], graph.beam
        graph.beam = lambda *a, calls=calls, beam=beam: calls.append(1) or beam(*a)
        a, b = graph.within(v.astype(np.float32), 0.93, hnsw.BEAM // 2)
        assert calls
        want = (v @ v.T >= 0.93).sum()
        assert len(set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.95 * want
        a, b = graph.links(v, 0.93 - hnsw.SLACK)
        exact = set(zip(*np.nonzero(v @ v.T >= 0.93), strict=True))
        assert len(exact & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.99 * want


def test_embedding_components_are_doubles(spark):
    rows = [(1, [1e300, 1.0], 2**40), (2, [1e300, 1.0], 2**40), (3, [-1e300, 1.0], 2**40), (2, [1e300, 1.0], 2**40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.embedding_groups(df).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]
    assert hnsw.embedding_groups(df.limit(0)).count() == 0


def test_toxicity(spark, odd):
    docs = [(i, f"word{i % 7} plain text number" + (" you idiot scum" if i % 5 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    s = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert min(s[i] for i in range(0, 400, 5)) > 0.5 > max(s[i] for i in range(400) if i % 5)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.train(df.limit(0), labels.limit(0))
    assert toxicity.score(odd, none).count() == len(ODD)


def test_language(spark, odd):
    en, de = "the cat and the dog of this house are there with that", "der hund und die katze sind nicht auf dem haus für das"
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    model = language.train(docs)
    mixed = spark.createDataFrame([(0, en + " " + de + " " + de), (1, None), (2, "123 !?"), (3, en)], "doc_id long, text string")
    r = {x.doc_id: x for x in language.identify(mixed, model).collect()}
    assert [r[i].lang_pred for i in range(4)] == ["de", "und", "und", "en"]
    assert [s.lang for s in r[0].spans] == ["en", "de"] and 0.5 < r[0].score < 1
    assert language.identify(odd, model).count() == len(ODD)
    assert {x.lang_pred for x in language.identify(odd, language.train(docs.limit(0))).collect()} == {"und"}


def test_signs_are_no_letters_and_many_languages(spark):
    rnd = random.Random(18)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03d}": ["".join(rnd.choice(rnd.sample(alphabet, 4)) for _ in range(7)) for _ in range(12)] for k in range(200)}
    rows = [(i, " ".join(rnd.choices(words[k], k=40)), k) for i, k in enumerate(list(words) * 2)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([*[(i, t) for i, t, _ in rows[:200]], (900, "½ ² 3 Ⅷ"), (901, words["l007"][0])], "doc_id long, text string")
    r = {x.doc_id: x for x in language.identify(asked, model).collect()}
    assert sum(r[i].lang_pred == k for i, _, k in rows[:200]) >= 195 and r[901].lang_pred == "l007"
    assert (r[900].lang_pred, r[900].score) == ("und", 0.0)


def test_viterbi_equals_every_path():
    from itertools import product

    rnd = np.random.RandomState(19)
    own = language.Labeller(language.Model(["a", "b", "c"], np.ones((3, language.BUCKETS)), np.ones((3, len(language.SCRIPTS)))))
    own.scored = (6 * rnd.randn(9, 3)).astype(np.float32)
    texts = [rnd.randint(0, 9, n) for n in (6, 1, 4, 0)]
    for text, got in zip(texts, own.viterbi(texts), strict=True):
        cost = lambda p, text=text: sum(own.scored[w, k] for w, k in zip(text, p, strict=True)) - language.SWITCH * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert abs(cost(got.tolist()) - max(map(cost, product(range(3), repeat=len(text))))) < 1e-3


def test_warc_forged_lengths(spark):
    forged = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n" for n in ("9" * 20, "9" * 4301, str(2**63 - 1), "９９", "-1", ""))
    rows = [(i, "u", f"{i}{forged}" + "long " * 300_000 * (i == 3)) for i in range(5)] + [(3, "u", "again"), (7, None, "é\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = common.scratch_path(spark, "forged")
    warc.write_archives(df, path, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        got = sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.resolve(warc.read_archives(spark, path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((i, len(h.encode()), "response") for i, _, h in rows)
    empty = common.scratch_path(spark, "empty")
    warc.write_archives(df.limit(0), empty)
    assert warc.resolve(warc.read_archives(spark, empty)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, compression):
    fake = "x WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "u", fake * (i % 3 + 1) + str(i % 5)) for i in range(12)] + [(100, None, None), (101, "u", ""), (102, "u\r\nx", "WARC/1.1\r\n")]
    path = common.scratch_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, compression=compression)
    got = {r.page_id: r for r in warc.resolve(warc.read_archives(spark, path)).collect()}
    assert sorted(got) == sorted(i for i, _, _ in rows)
    for i, _, h in rows:
        keeper = max(j for j, _, g in rows if (g or "") == (h or ""))
        assert got[i].payload_bytes == len((h or "").encode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == keeper else ("revisit", keeper))


def test_mixing(spark, odd):
    docs = [(i, "w " * (i % 9 + 1), f"s{i % 4}" if i % 11 else None) for i in range(200)]
    r = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).toPandas()
    assert abs(r.taken.sum() - 1.5 * r["size"].sum()) <= 5 and (r.taken <= 2 * r["size"]).all()
    for _, own in r.groupby("source", dropna=False):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 1 and own.target.iloc[0] <= 2 * own["size"].sum()
    assert r.position.dropna().between(0, 1.000001).all()
    assert mixing.in_training_order(mixing.mix(odd)).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def typo(rnd, line, n):
    """The line with n letters replaced."""
    out = list(line)
    for at in rnd.sample([i for i, c in enumerate(out) if c != " "], n):
        out[at] = rnd.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(out)


def test_line_recall(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    rows = []
    for words, typos in ((5, 1), (10, 1), (10, 3), (30, 1), (30, 6), (100, 5), (100, 20)):
        for _ in range(40):
            base = " ".join(word() for _ in range(words))
            rows += [(len(rows), base, words, typos), (len(rows) + 1, typo(rnd, base, typos), words, typos)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words int, typos int")
    occurring = common.cut(lines.occurrences(df))
    roots = {r.id: r.root for r in lines.similar_lines(occurring, common.cut(lines.line_prints(occurring))).collect()}
    labels = {r.doc_id: roots.get(r.id, r.id) for r in occurring.collect()}  # equal lines have one id
    d, e = df.alias("d"), df.alias("e")
    pairs = d.join(e, F.expr("d.words = e.words and d.typos = e.typos and d.doc_id < e.doc_id and abs(length(d.text) - length(e.text)) <= 0.2 * greatest(length(d.text), length(e.text))"))
    near = F.expr("levenshtein(d.text, e.text, cast(floor(0.2 * greatest(length(d.text), length(e.text)) + 1e-9) as int)) >= 0")
    recall = {}
    for r in pairs.where(near).select("d.words", "d.typos", F.col("d.doc_id").alias("a"), F.col("e.doc_id").alias("b")).collect():
        recall.setdefault((r.words, r.typos), []).append(r.a in labels and labels[r.a] == labels.get(r.b))
    share = {k: sum(v) / len(v) for k, v in sorted(recall.items())}
    print(share)
    assert all(len(v) >= 35 for v in recall.values())
    assert len(share) == 7 and min(share.values()) >= 0.9


def test_near_copies(spark):
    """Recall over planted copies against brute-force Jaccard."""
    import corpus_pipeline as p

    rnd = random.Random(11)
    texts = []
    for k in range(60):
        base = [f"w{rnd.randrange(9999)}" for _ in range(rnd.choice([60, 150, 400]))]
        other = list(base)
        for at in rnd.sample(range(len(base)), max(1, len(base) * (k % 3) // 150)):
            other[at] = f"x{at}"
        texts += [" ".join(base), " ".join(other)]
    sets = [set(simhash.shingle_hashes(t, p.SHINGLE).tolist()) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= p.SIMILARITY * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc_id: r.root for r in simhash.near_copies(df, p.SHINGLE, p.NEAR_BITS, p.SIMILARITY).collect()}
    found = sum(root[i] == root[j] for i, j in want)
    assert len(want) >= 30 and found >= 0.97 * len(want)


def test_near_fingerprints_share_a_bucket(spark):
    """Near-dedup of the pipeline: all fingerprints within three bits meet by the pigeonhole principle, whatever their sketches."""
    rnd = random.Random(31)
    prints = []
    for _ in range(300):
        fp = rnd.getrandbits(64)
        other = fp
        for bit in rnd.sample(range(64), rnd.randint(1, 3)):
            other ^= 1 << bit
        prints += [fp, other]
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    keys = {}
    for r in simhash.pigeonhole_members(df, simhash.PROBED).collect():
        keys.setdefault(r.id, set()).add(r.key)
    assert all(keys[i] & keys[i + 1] for i in range(0, 600, 2))


def test_edits_seen_never_says_too_much():
    rnd = random.Random(32)
    found = 0
    for _ in range(400):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 300)))
        b = typo(rnd, a, min(len(a.replace(" ", "")), rnd.randint(0, 30))) + "x" * rnd.randint(0, 9)
        most = len(b) // 5
        seen = lines.edits_seen(a, b, most)
        assert not seen or lines.edits_within(a, b, most)
        found += seen
    assert found > 100


def test_short_lines_link(spark):
    df = spark.createDataFrame([(1, "la ja"), (2, "la ra")], "doc_id long, text string")
    occurring = common.cut(lines.occurrences(df))
    roots = [r.root for r in lines.similar_lines(occurring, common.cut(lines.line_prints(occurring))).collect()]
    assert len(roots) == 2 and len(set(roots)) == 1


def test_equal_minima(spark):
    raw = np.random.RandomState(4).randint(0, 3, (60, 24)).astype(np.uint8)
    rows = [(*map(int, x.view(np.int64)), *map(int, y.view(np.int64))) for x, y in zip(raw[::2], raw[1::2], strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{s}{i} long" for s in "xy" for i in range(3)))
    df = df.select(*[F.struct(*[F.col(f"{s}{i}").alias(f"m{i}") for i in range(3)]).alias(s) for s in "xy"])
    got = [r.n for r in df.coalesce(1).select(lines.equal_minima("x", "y").alias("n")).collect()]
    assert got == (raw[::2] == raw[1::2]).sum(1).tolist()


def test_near_copies_do_not_hang_on_the_least_id(spark):
    import corpus_pipeline as p

    base = [f"v{i}" for i in range(100)]
    a, b = " ".join(base), " ".join(base[:-12] + [f"y{i}" for i in range(12)])
    rows = [(1, a), (2, b), (3, b), (4, b + " z"), (3, "clean words of another text under one id")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(r.doc_id, r.text) for r in p.dedup_documents(spark, df, "").collect()}
    assert kept == {(1, a), (2, b), (3, rows[4][1])}


def test_every_copy_has_its_position(spark):
    import corpus_pipeline as p

    rows = [(i, "w " * (i % 5 + 1), "en", "s0" if i < 40 else "s1", 9) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for slope in (0.0, 0.6):
        r = mixing.mix(df, slopes=(slope,)).where("taken > 0").toPandas()
        for _, own in r.groupby("source"):
            words = round(own.target.iloc[0])
            at = []
            for x in own.itertuples():
                left = x.taken
                assert x.positions[0] == x.position
                for t in x.positions:
                    at.append((t, min(left, x.size)))
                    left -= at[-1][1]
                assert left == 0
            done = 0
            for t, n in sorted(at):
                assert abs((1 - slope) * t + slope * t * t - (done + n / 2) / words) < 1e-9
                done += n
            assert done == words and max(at)[0] > 0.95
    ids = [r.doc_id for r in p.mix_sources(spark, df, "").collect()]
    both = [i for i in range(40) if ids.count(i) == 2]
    assert both and not any(x == y for x, y in zip(ids, ids[1:], strict=False))


def test_shards_hold_whole_records(spark, odd, tmp_path):
    rows = [(i, f"é text {i} " * (i % 7), "en") for i in range(300)] + [(300, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sharding.write_shards(docs, f"{tmp_path}/shards", 5, bucket_bytes=1000)
    r = spark.read.parquet(f"{tmp_path}/shards").toPandas()
    assert {(x.doc_id, x.text, x.lang) for x in r.itertuples()} == set(rows) and len(r) == len(rows)
    for _, own in r.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own))) and own.bucket.nunique() > 1
    assert sharding.write_shards(odd.limit(0), f"{tmp_path}/none", 5).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op2_sharding(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.size, x.text_crc32) for x in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows}
    at = common.scratch_root(spark).removeprefix("file://")
    assert any(f.read_bytes() for f in __import__("pathlib").Path(at).glob("sedimenta-shards-*/shard=*/*.parquet"))


def test_line_recall_of_words_replaced(spark):
    """Linked pairs against every pair of an edit similarity of 0.8 or more, lines with up to two words replaced or a letter changed."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9)))
    rows = []
    for base in range(60):
        words = [word() for _ in range(rnd.randint(6, 40))]
        for copy in range(4):
            own = list(words)
            for at in rnd.sample(range(len(own)), rnd.randint(0, 2)):
                own[at] = word()
            line = " ".join(own)
            rows.append((len(rows), base, typo(rnd, line, 1) if copy == 3 else line))
    df = spark.createDataFrame(rows, "doc_id long, base long, text string")
    occurring = common.cut(lines.occurrences(df))
    roots = {r.id: r.root for r in lines.similar_lines(occurring, common.cut(lines.line_prints(occurring))).collect()}
    labels = {r.doc_id: roots.get(r.id, r.id) for r in occurring.collect()}  # equal lines have one id
    d, e = df.alias("d"), df.alias("e")
    near = d.join(e, F.expr("d.base = e.base and d.doc_id < e.doc_id")).where("levenshtein(d.text, e.text) <= 0.2 * greatest(length(d.text), length(e.text))")
    pairs = [(r.a, r.b) for r in near.select(F.col("d.doc_id").alias("a"), F.col("e.doc_id").alias("b")).collect()]
    found = sum(a in labels and labels[a] == labels.get(b) for a, b in pairs)
    print(len(pairs), found / len(pairs))
    assert len(pairs) > 200 and found >= 0.9 * len(pairs)
    by_root = {}
    for r, _, text in rows:
        by_root.setdefault(labels.get(r, -r), set()).add(rows[r][1])
    assert all(len(v) == 1 for v in by_root.values())


def test_bpe_query_equals_tiktoken(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bpe.read_ranks(P.path(RANKS))
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rnd = random.Random(22)
    texts = [None, "", "a" * 30_000, "word, " * 40_000, "日本語" * 5_000, "<|endoftext|> x", *["".join(rnd.choice("aé 1!\n中ß") for _ in range(300)) for _ in range(20)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op1_byte_bpe(spark, str(tmp_path)).collect():
        text = texts[r.doc_id] or ""
        ids = other.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input against brute force, with nulls, empty texts and repeated rows."""
    import corpus_pipeline as p

    rnd = random.Random(23)
    en = "the of and to in is that it was for on are as with his they at be this from have or by one had".split()
    made = lambda n: " ".join(rnd.choice(en) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefghilmnoprst") for _ in range(rnd.randint(4, 9))) for _ in range(n))
    shared, texts = made(20), []
    for k in range(30):
        body = made(120)
        texts.append(f"{body}\n{shared}\n{made(9)}")
        if k % 3 == 0:
            words = body.split()
            words[40:42] = ["changed", "words"]
            texts.append(" ".join(words))
    texts += ["12 34 !?", "", None, texts[0]]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    told = p.identify_language(spark, docs, "")
    assert told.columns == list(p.COLUMNS) and told.count() == len(rows) - 3
    lined = sorted(p.dedup_lines(spark, told, "").collect(), key=lambda r: r.doc_id)
    kept = [line for r in lined for line in r.text.split("\n")]
    assert kept.count(shared) == 1 and len(kept) == len(set(kept)) and all(r.n_chars == len(r.text) for r in lined)
    assert {line for t in texts if t for line in t.split("\n") if any(c.isalpha() for c in line)} - set(kept) <= {t for t in texts if t and "changed words" in t}
    sets = [set(simhash.shingle_hashes(t or "", p.SHINGLE).tolist()) for _, t, *_ in rows]
    same = brute_components(range(len(rows)), lambda i, j: not (sets[i] or sets[j]) or len(sets[i] & sets[j]) >= p.SIMILARITY * len(sets[i] | sets[j]))
    near = p.dedup_documents(spark, docs, "").collect()
    assert len(near) == len(set(same))
    mixed = p.mix_sources(spark, docs.where("text is not null"), "")
    assert mixed.columns == list(p.COLUMNS)
    words = lambda t: len((t or "").split())
    total = sum(words(t) for _, t, *_ in rows)
    assert abs(sum(words(r.text) for r in mixed.collect()) - 1.5 * total) < 0.15 * total
    for r in p.tokenise(spark, docs, "").collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and len(r.ids) == r.n_tokens
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, "").count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    assert out and all(r.n_tokens > 0 for r in out)
