"""What the findings of round 4 named: references cut off in titles, passes of a vocabulary over all texts."""

import pytest
from pyspark.sql import functions as F
from test_round4 import equals_sql

from sedimenta.functions import dom
from sedimenta.operators import vocabulary


@pytest.mark.parametrize("name", ["page_nodes", "body_cascade", "containers", "page_blocks"])
def test_references_cut_off_are_text(spark, tmp_path, name):
    page = "<html><body><nav>m</nav><article><h1>{0}</h1><p class=\"ad\">{0} and more than twenty letters</p></article><footer>&copy;</footer></body></html>"
    cuts = ["a &quot", "a &quo", "a &am", "a &amp", "a &", "a &lt", "a &gt", "a &copy", "&middot", "a &quot;", "a &amp;quot;", "a &ampquot;", "a &copyx;", "x &amp;&amp"]
    assert equals_sql(spark, tmp_path, name, "pages", [(i, page.format(x)) for i, x in enumerate(cuts)], "page_id long, html string")


def test_closed_references():
    texts = lambda html, **k: [n[8] for n in dom.nodes_of(html, **k)]
    assert texts("&quot &eacute; &#233; &#xe9; &nosuch; &amp", closed=True) == ["&quot é é é &nosuch; &"]
    assert texts("&quot &amp") == ['" &']


def test_a_large_vocabulary_is_one_pass(spark):
    """150,000 words took two passes over all texts, each a search of its own; counts were made from a row for each word of each text."""
    vocab = spark.range(150_000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"), F.lit(0).alias("rank"))
    assert len(vocabulary._blocks(vocab)) == 1
    docs = spark.createDataFrame([(1, "xword149999y WORD7 word7"), (2, None), (3, "word 7")], "doc_id long, text string")
    assert sorted(r.term for r in vocabulary.term_rows(docs, vocab).collect()) == sorted([f"word{'149999'[:n]}" for n in range(1, 7)] + ["word7"])
    counts = vocabulary.term_counts(docs, vocab)
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString() and counts.where("n > 0").count() == 7


def test_terms_of_all_kinds(spark, monkeypatch):
    """Words, words of more than LONGEST letters, phrases, signs and marks, alone and inside longer words, in one block and in several."""
    terms = ["new york", "york", "c++", "_", "a_b", "é", "é", "ภาษา", "ษา", "日本", "本語", "x" * 64, "x" * 65, "x" * 66, "1", "२", "\U0001d400", "²", "Ⅰ"]
    texts = ["New York", "newyorker_a_b", "c++ é É", "ภาษาไทย", "日本語1", "x" * 65, "x" * 63 + " " + "x" * 64, "२3 \U0001d400b x² ⅠI", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, rank long")
    low = [r[0] for r in docs.orderBy("doc_id").select(F.lower("text")).collect()]
    names = [r[0] for r in vocab.orderBy("rank").select(F.lower("term")).collect()]
    want = [[w for w in names if w in (t or "")] for t in low]
    for block in (100, 4):
        monkeypatch.setattr(vocabulary, "BLOCK", block)
        monkeypatch.setattr(vocabulary, "OTHERS", block)
        for most in (None, 2):
            got = {r.doc_id: r.terms for r in vocabulary.with_terms(docs, vocab, most=most).collect()}
            assert [got[i] for i in range(len(texts))] == [x[:most] for x in want]
        assert {r.term: r.n for r in vocabulary.term_counts(docs, vocab).collect()} == {w: sum(w in x for x in want) for w in names}
