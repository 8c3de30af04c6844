from pyspark.sql import functions as F

from caseweave.catalog.text import STEM_PAIRS
from caseweave.functions import text as tx
from caseweave.operators import summaries, terms

def test_stem(spark):
    df = spark.createDataFrame(STEM_PAIRS, "word STRING, expected STRING")
    rows = df.withColumn("got", tx.stem(F.col("word"))).collect()
    assert [(r.word, r.got) for r in rows if r.got != r.expected] == []


def test_stem_terms_merges_counts(spark):
    tf = spark.createDataFrame([(1, "knees", 2, 5), (1, "knee", 1, 5), (2, "knees", 1, 1)], "doc_id INT, term STRING, tf LONG, doc_len LONG")
    assert sorted((r.doc_id, r.term, r.tf) for r in terms.stem_terms(tf).collect()) == [(1, "knee", 3), (2, "knee", 1)]


def test_words_of_sentences_are_counted_in_their_row(spark):
    """No word is shuffled to be counted; an id that comes twice scores as before."""
    docs = spark.createDataFrame([(1, "Aa bb. Cc dd cc! Ee"), (2, "bb bb. "), (2, "aa bb. cc"), (3, None), (4, "")], "doc_id INT, text STRING")
    weights = spark.createDataFrame([(1, "aa", 0.5), (1, "cc", 0.9), (2, "bb", 0.3), (2, "bb", 0.1)], "doc_id INT, term STRING, w DOUBLE")
    best = summaries.summarize_docs(docs, weights, ratio=1.0)
    assert "doc_id, position, term" not in " ".join(best._jdf.queryExecution().executedPlan().toString().replace("#", " ").split())
    got = sorted((r.doc_id, r.position, round(r.score, 6)) for r in best.collect())
    assert got == [(1, 0, 0.25), (1, 1, 0.6), (1, 2, 0.0), (2, 0, 0.171429), (2, 0, 0.171429), (2, 1, 0.0), (2, 1, 0.0)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cleaning_order(spark):
    text = F.lit("The 3 Views, of  running CAN'T")
    first = tx.clean_corpus(text, ["the", "of"])
    assert one(spark, first).split() == ["views", "running", "cant"]
    custom = tx.clean_corpus(text, ["the", "of"], ("lower", "stop_words", "punctuation", "numbers", "blanks", "stem", "late_words"), ["view", "run"])
    assert one(spark, custom).split() == ["cant"]


def test_tokens_and_ngrams(spark):
    assert one(spark, tx.tokenize(F.lit("It's a Été_1!"))) == ["it", "été_1"]
    assert one(spark, tx.tokenize(F.lit("It is!"), "marks")) == ["It", "is", "!"]
    tokens = F.array(*[F.lit(w) for w in "abc"])
    assert one(spark, tx.ngrams(tokens, 1, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, tx.ngrams(F.array(F.lit("a")), 2, 3)) == []
    assert one(spark, tx.keep_letter_terms(F.array(*[F.lit(w) for w in ("The", "the", "ab", "a1b", "Été")]), ["the"])) == ["the", "été"]


def test_markup(spark):
    assert one(spark, tx.scrub_markup_lines(F.lit("  <x>\nkeep a.c /path*&gt;!\n<y"))) == "keep a.c  path "
    assert one(spark, tx.html_to_text(F.lit("<p>a<!-- <b> --><script>x<1</script> &amp;lt; b</p>"))) == "a &lt; b"
    assert one(spark, tx.strip_vote_suffix(F.lit("too. 12 votes"))) == "too."
    assert one(spark, tx.normalize_text(F.lit("A\nbé C"), 5)) == "a b  "


def test_emails_need_the_marker(spark):
    docs = spark.createDataFrame([(1, "a@b.c wrote: hi d@e.f\nx@y.z")], "doc_id INT, text STRING")
    assert [r.user for r in summaries.extract_emails(docs).collect()] == ["a@b.c"]
    assert [r.user for r in summaries.extract_emails(docs, None).collect()] == ["a@b.c", "x@y.z"]


def test_vocabulary_bounds(spark):
    tf = spark.createDataFrame([(d, t, 1, 3) for d, ts in enumerate(["abc", "ab", "a", "a"]) for t in ts], "doc_id INT, term STRING, tf LONG, doc_len LONG")
    names = lambda df: sorted(r.term for r in df.select("term").distinct().collect())
    assert names(terms.bound_vocabulary(tf, 4, 2)) == ["a", "b"]
    assert names(terms.bound_vocabulary(tf, 4, 1, 0.5)) == ["b", "c"]
    assert names(terms.bound_vocabulary(tf, 4, 1, 2)) == ["b", "c"]
    assert names(terms.prune_sparse_terms(tf, 4, 0.6)) == ["a", "b"]
    assert [r.term for r in terms.trim_terms_by_freq(tf, 1, rarest=True).collect()] == ["c"]
