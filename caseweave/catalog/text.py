"""Queries of text preparation, term statistics and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseweave.catalog.registry import query
from caseweave.functions import text as tx
from caseweave.operators import summaries, terms
from caseweave.session import spread, stage

STOP = "the and of de la le les der die und el que".split()
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"

TOKENS_SQL = r"""
docs AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS tokens FROM documents),
tok AS (SELECT doc_id, len(tokens) AS doc_len, unnest(tokens) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM tok GROUP BY 1, 2),
n AS (SELECT count(*)::DOUBLE AS n FROM documents),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY 1)"""

BOUND_SQL = TOKENS_SQL + """,
vocab AS (SELECT * FROM df, n WHERE df >= 2 AND df <= 0.5 * n),
smooth AS (
  SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w0 FROM tf JOIN vocab USING (term)),
unit AS (SELECT doc_id, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM smooth)"""


def tokens_of(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", "text", tx.tokenize(F.col("text")).alias("tokens"))


def tf_of(t):
    return terms.term_freq(tokens_of(t))


def staged_tf(t):
    """The term table, written once for queries that read it more than once."""
    return stage(tf_of(t))


def ids_are_single(docs):
    """Whether no document comes twice: then its rows of a term table, as they are made, are all that there are of it."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def n_docs(t):
    return t.documents.agg(F.count(F.lit(1)).cast("double")).scalar()


def sent(vocabulary, most_bytes=32 << 20):
    """A staged vocabulary, hinted to be sent to all tasks if its measured size is small: then the term table isn't shuffled to meet it."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    return F.broadcast(vocabulary) if size <= most_bytes else vocabulary


def vocabulary_of(t, tf, max_features=None):
    return terms.bound_vocabulary(tf, n_docs(t), 2, 0.5, max_features)


def unit_weights(t):
    tf = staged_tf(t)
    return terms.tfidf(tf, n_docs(t), "smooth", by_length=False, l2=True, vocabulary=vocabulary_of(t, tf))


# --- preparation --------------------------------------------------------------------------------


@query(
    "normalize_text",
    r"""SELECT doc_id, lower(regexp_replace(replace(text, chr(10), ' '), '[^\x00-\x7F]+', ' ', 'g')) AS text FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


@query(
    "scrub_markup_lines",
    r"""SELECT page_id, array_to_string(list_transform(
      list_filter(list_transform(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), lambda x: ltrim(x)),
                  lambda x: NOT starts_with(x, '<')),
      lambda x: translate(translate(regexp_replace(x, '(&gt|&#xD|&quot)', '', 'g'), '/*', '  '),
                '!"#$%&''()+,-:;<=>?@[\]^`{|}~', '')), ' ') AS text FROM pages""",
)
def _(t):
    lines = F.regexp_replace("html", "><", ">\n<")
    return t.pages.select("page_id", tx.scrub_markup_lines(lines, " ").alias("text"))


@query(
    "extract_emails",
    r"""SELECT doc_id, "user" FROM (SELECT doc_id, regexp_extract(unnest(string_split(text, chr(10))), '[\w\.-]+@[\w\.-]+') AS "user"
    FROM documents) WHERE "user" <> ''""",
)
def _(t):
    return summaries.extract_emails(t.documents, None)


@query(
    "extract_tags",
    """SELECT page_id, len(tags) AS n_tags, array_to_string(tags, '') AS tags
    FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>') AS tags FROM pages)""",
)
def _(t):
    tags = tx.extract_tags(F.col("html"))
    return t.pages.select("page_id", F.size(tags).cast("long").alias("n_tags"), F.array_join(tags, "").alias("tags"))


@query(
    "html_to_text",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text
    FROM pages""",
)
def _(t):
    return t.pages.select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query(
    "strip_vote_suffix",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END AS text FROM documents",
)
def _(t):
    votes = F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit(" votes"))
    ending = F.when(F.col("doc_id") % 3 == 0, F.lit(".")).otherwise(votes)
    return t.documents.select("doc_id", tx.strip_vote_suffix(F.concat("text", ending)).alias("text"))


@query(
    "keep_letter_terms",
    rf"""SELECT doc_id, array_to_string(list_transform(list_filter(
      regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'),
      lambda x: regexp_full_match(x, '\p{{L}}{{3,}}') AND NOT list_contains({STOP_SQL}, x)), lambda x: lower(x)), ' ') AS terms
    FROM documents""",
)
def _(t):
    kept = tx.keep_letter_terms(tx.tokenize(F.col("text"), "marks"), STOP)
    return t.documents.select("doc_id", F.array_join(kept, " ").alias("terms"))


@query(
    "keep_alnum_tokens",
    r"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'),
      lambda x: regexp_matches(x, '[a-zA-Z0-9\-\\/]')), ' ') AS terms FROM documents""",
)
def _(t):
    kept = tx.keep_alnum_tokens(tx.tokenize(F.col("text"), "marks"))
    return t.documents.select("doc_id", F.array_join(kept, " ").alias("terms"))


@query("drop_short_docs", f"WITH {TOKENS_SQL} SELECT doc_id, len(tokens) AS n FROM docs WHERE len(tokens) > 1")
def _(t):
    n = F.size("tokens").cast("long")
    return tokens_of(t).select("doc_id", n.alias("n")).where("n > 1")


@query("tokenize", f"WITH {TOKENS_SQL} SELECT doc_id, array_to_string(tokens, ' ') AS tokens FROM docs")
def _(t):
    return tokens_of(t).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "clean_corpus",
    rf"""WITH c AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
      '[0-9]+', '', 'g'), '[!-/:-@\[-`{{-~]+', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '$', ''), ' ') AS w FROM documents)
    SELECT doc_id, array_to_string(list_filter(w, lambda x: NOT list_contains({STOP_SQL}, x)), ' ') AS text FROM c""",
)
def _(t):
    return t.documents.select("doc_id", tx.clean_corpus(F.col("text"), STOP).alias("text"))


@query(
    "remove_words",
    f"WITH {TOKENS_SQL} SELECT doc_id, array_to_string(list_filter(tokens, lambda x: NOT list_contains({STOP_SQL}, x)), ' ') AS tokens FROM docs",
)
def _(t):
    return tokens_of(t).select("doc_id", F.array_join(tx.remove_words(F.col("tokens"), STOP), " ").alias("tokens"))


# Words and their stems as published for the English (Porter2) algorithm.
STEMS = """consigned consign|consistency consist|consolatory consolatori|conspicuous conspicu|knackeries knackeri|knives knive
hopping hop|hoping hope|luxuriated luxuri|agreed agre|feed feed|plastered plaster|motoring motor|sing sing|sized size|falling fall
happy happi|relational relat|digitizer digit|feudalism feudal|hopefulness hope|sensibility sensibl|triplicate triplic|electrical electr
allowance allow|adjustment adjust|adoption adopt|communism communism|rate rate|cease ceas|controlling control|ties tie|cries cri
say say|generate generat|generic generic|skies sky|dying die|news news|gas gas|gaps gap|kiwis kiwi|apologize apolog|proceeds proceed
configuration configur|organization organ|national nation|quickly quick"""
STEM_PAIRS = [tuple(p.split()) for line in STEMS.splitlines() for p in line.split("|")]
STEM_SQL = ", ".join(f"({i}, '{s}')" for i, (_, s) in enumerate(STEM_PAIRS))


@query(
    "stem_terms",
    f"""WITH {TOKENS_SQL}, s(i, stem) AS (VALUES {STEM_SQL})
    SELECT doc_id, stem AS term, sum(tf)::BIGINT AS tf FROM tf JOIN s ON i = ('0x' || substr(md5(term), 1, 8))::BIGINT % {len(STEM_PAIRS)} GROUP BY 1, 2""",
)
def _(t):
    """Every term stands for one of the published words, which are stemmed and merged per document."""
    number = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % len(STEM_PAIRS)
    word = F.array(*[F.lit(w) for w, _ in STEM_PAIRS])[number.cast("int")]
    tf = tf_of(t).groupBy("doc_id", word.alias("term")).agg(F.sum("tf").alias("tf"), F.max("doc_len").alias("doc_len"))
    return terms.stem_terms(stage(tf)).select("doc_id", "term", "tf")


@query(
    "term_ids",
    f"""WITH {BOUND_SQL}, v AS (SELECT term, row_number() OVER (ORDER BY term) AS "index" FROM vocab)
    SELECT doc_id, "index", tf FROM tf JOIN v USING (term)""",
)
def _(t):
    """A bag of words by term ids."""
    from caseweave.operators.models import numbered_terms

    tf = staged_tf(t)
    return tf.join(numbered_terms(vocabulary_of(t, tf)), "term").select("doc_id", "index", "tf")


@query(
    "clean_corpus_late",
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[0-9]+', '', 'g') AS text FROM documents)
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'),
      lambda x: NOT list_contains(['the', 'and', 'license', 'under'], x)), ' ') AS text FROM a""",
)
def _(t):
    """The cleaning chain with punctuation before numbers and two word lists, the second one last."""
    order = ("lower", "punctuation", "numbers", "stop_words", "late_words")
    return t.documents.select("doc_id", tx.clean_corpus(F.col("text"), ["the", "and"], order, ["license", "under"]).alias("text"))


@query(
    "split_sentences",
    r"""SELECT doc_id, generate_subscripts(s, 1)::INTEGER - 1 AS position, unnest(s) AS sentence FROM (
      SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""",
)
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("position", "sentence"))


@query(
    "ngrams",
    f"""WITH {TOKENS_SQL}, g AS (
      SELECT unnest(tokens) AS gram FROM docs
      UNION ALL SELECT unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM docs
      UNION ALL SELECT unnest(list_transform(range(1, len(tokens) - 1),
        lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2])) FROM docs)
    SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 5""",
)
def _(t):
    grams = tokens_of(t).select(F.explode(tx.ngrams(F.col("tokens"), 1, 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(
    "drop_hapax",
    f"""WITH {TOKENS_SQL} SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens
    FROM tf JOIN df USING (term) WHERE total > 1 GROUP BY 1""",
)
def _(t):
    kept = terms.drop_hapax(staged_tf(t))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


# --- statistics and weights ---------------------------------------------------------------------


@query("term_freq", f"WITH {TOKENS_SQL} SELECT doc_id, term, tf FROM tf")
def _(t):
    return tf_of(t).select("doc_id", "term", "tf")


@query("doc_freq", f"WITH {TOKENS_SQL} SELECT term, df, total FROM df")
def _(t):
    return terms.doc_freq(tf_of(t))


@query("top_terms_by_df", f"WITH {TOKENS_SQL} SELECT term, df, total FROM df ORDER BY df DESC, term LIMIT 1000")
def _(t):
    return terms.top_terms_by_df(tf_of(t), 1000)


@query("trim_terms_by_freq", f"WITH {TOKENS_SQL} SELECT term, total FROM df ORDER BY total DESC, term LIMIT 500")
def _(t):
    return terms.trim_terms_by_freq(tf_of(t), 500)


@query("term_totals", f"WITH {TOKENS_SQL} SELECT term, total FROM df WHERE total >= 2 ORDER BY total DESC, term LIMIT 100")
def _(t):
    return terms.term_totals(tf_of(t), 2).orderBy(F.desc("total"), "term").limit(100)


@query(
    "doc_term_totals",
    f"WITH {TOKENS_SQL} SELECT term, sum(tf)::BIGINT AS total FROM tf WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1",
)
def _(t):
    return terms.doc_term_totals(tf_of(t), t.labels.where("toxic = 1"))


@query(
    "prune_sparse_terms",
    f"""WITH {TOKENS_SQL} SELECT doc_id, term, tf FROM tf WHERE term IN (
      SELECT term FROM df, n WHERE df > n * (1.0::DOUBLE - 0.95::DOUBLE))""",
)
def _(t):
    return terms.prune_sparse_terms(staged_tf(t), n_docs(t), 0.95).select("doc_id", "term", "tf")


@query("bound_vocabulary", f"WITH {BOUND_SQL} SELECT term, df, total FROM vocab ORDER BY total DESC, term LIMIT 2000")
def _(t):
    return vocabulary_of(t, tf_of(t), 2000)


@query(
    "idf",
    f"""WITH {TOKENS_SQL} SELECT term, round(ln(n / df), 9) AS idf_ln, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf_smooth,
    round(log2(n / df), 9) AS idf_log2, round(ln((n + 1) / (df + 1)), 9) AS idf_shifted FROM df, n""",
)
def _(t):
    n = n_docs(t)
    forms = [F.round(f(n, F.col("df")), 9).alias(f"idf_{name}") for name, f in terms.IDF_FORMS.items()]
    return terms.doc_freq(tf_of(t)).select("term", *forms)


@query(
    "tfidf",
    f"WITH {TOKENS_SQL} SELECT doc_id, term, round(tf / doc_len::DOUBLE * ln(n / df), 9) AS w FROM tf JOIN df USING (term), n",
)
def _(t):
    return terms.tfidf(staged_tf(t), n_docs(t)).withColumn("w", F.round("w", 9))


@query("tfidf_smooth", f"WITH {BOUND_SQL} SELECT doc_id, term, round(w, 9) AS w FROM unit")
def _(t):
    return unit_weights(t).withColumn("w", F.round("w", 9))


@query(
    "tfidf_log2",
    f"""WITH {TOKENS_SQL} SELECT doc_id, round(sum(tf / doc_len::DOUBLE * log2(n / df)), 6) AS w_normalised,
    round(sum(tf * log2(n / df)), 5) AS w_plain FROM tf JOIN df USING (term), n GROUP BY 1""",
)
def _(t):
    tf = staged_tf(t)
    both = terms.tfidf(tf, n_docs(t), "log2").withColumn("plain", F.lit(0.0)).unionByName(
        terms.tfidf(tf, n_docs(t), "log2", by_length=False).select("doc_id", "term", F.lit(0.0).alias("w"), F.col("w").alias("plain"))
    )
    return both.groupBy("doc_id").agg(F.round(F.sum("w"), 6).alias("w_normalised"), F.round(F.sum("plain"), 5).alias("w_plain"))


@query(
    "tfidf_own_form",
    f"""WITH {TOKENS_SQL} SELECT doc_id, term, round(tf / doc_len::DOUBLE * greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 9) AS w
    FROM tf JOIN df USING (term), n""",
)
def _(t):
    """Weights by a form of the caller's own: the probabilistic one, not below zero."""
    probabilistic = lambda n, df: F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5)))
    return terms.tfidf(staged_tf(t), n_docs(t), probabilistic).withColumn("w", F.round("w", 9))


@query(
    "l2_normalize",
    f"""WITH {TOKENS_SQL}, s AS (SELECT doc_id, tf, sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS norm, term FROM tf)
    SELECT doc_id, term, round(tf / norm, 9) AS w FROM s""",
)
def _(t):
    weights = tf_of(t).select("doc_id", "term", F.col("tf").cast("double").alias("w"))
    return terms.l2_normalize(weights).withColumn("w", F.round("w", 9))


@query(
    "scale_columns",
    f"""WITH {TOKENS_SQL}, w AS (
      SELECT doc_id, term, tf, count(*) OVER x AS c, sum(tf) OVER x AS s, sum(tf * tf) OVER x AS q FROM tf WINDOW x AS (PARTITION BY term))
    SELECT doc_id, term, round(tf / sqrt((q - s * s / n) / (n - 1)), 6) AS w FROM w, n""",
)
def _(t):
    weights = staged_tf(t).select("doc_id", "term", F.col("tf").cast("double").alias("w"))
    return terms.scale_columns(weights, n_docs(t)).withColumn("w", F.round("w", 6))


@query(
    "vocabulary_difference",
    rf"""WITH {TOKENS_SQL} SELECT term, total FROM df WHERE term NOT IN (
      SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) FROM benchmark)
    ORDER BY total DESC, term LIMIT 1000""",
)
def _(t):
    general = t.benchmark.select(F.explode(tx.tokenize(F.col("text"))).alias("term"))
    return terms.vocabulary_difference(tf_of(t), general)


@query(
    "docs_with_terms_freq",
    f"""WITH {TOKENS_SQL}, hit AS (SELECT DISTINCT doc_id FROM tf WHERE term IN ('password', 'license', 'under'))
    SELECT term, sum(tf)::BIGINT AS total FROM tf JOIN hit USING (doc_id) GROUP BY 1 HAVING sum(tf) >= 5
    ORDER BY total DESC, term LIMIT 50""",
)
def _(t):
    return terms.docs_with_terms_freq(staged_tf(t), ["password", "license", "under"], 5, 50)


# --- whole documents ----------------------------------------------------------------------------


@query(
    "summarize_docs",
    rf"""WITH {TOKENS_SQL}, w AS (
      SELECT doc_id, term, tf / doc_len::DOUBLE * ln(n / df) AS w FROM tf JOIN df USING (term), n),
    s0 AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
    s AS (SELECT doc_id, generate_subscripts(s, 1)::INTEGER - 1 AS position, unnest(s) AS sentence FROM s0),
    t AS (SELECT doc_id, position, unnest(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM s),
    sc AS (SELECT doc_id, position, coalesce(sum(w), 0) / count(*) AS score FROM t LEFT JOIN w USING (doc_id, term) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, position) AS rank,
            count(*) OVER (PARTITION BY doc_id) AS n FROM sc)
    SELECT doc_id, position, sentence, round(score, 6) AS score FROM r JOIN s USING (doc_id, position)
    WHERE rank <= ceil(n * 0.2::DOUBLE)""",
)
def _(t):
    tf = staged_tf(t)
    weights = terms.tfidf(tf, n_docs(t), vocabulary=sent(stage(terms.doc_freq(tf))))
    return summaries.summarize_docs(t.documents, weights).withColumn("score", F.round("score", 6))


def sentiment_of(t):
    """Sentiment of the documents by the words of even test items less those of odd ones."""
    words = t.benchmark.select("item_id", F.explode(tx.tokenize(F.col("text"))).alias("word"))
    positive = words.where("item_id % 2 = 0").select("word").distinct()
    negative = words.where("item_id % 2 = 1").select("word").distinct()
    return summaries.sentiment_score(tokens_of(t), positive, negative)


@query(
    "sentiment_score",
    rf"""WITH {TOKENS_SQL},
    g AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term, item_id FROM benchmark),
    lex AS (SELECT DISTINCT term, 1 AS sign FROM g WHERE item_id % 2 = 0
            UNION ALL SELECT DISTINCT term, -1 FROM g WHERE item_id % 2 = 1)
    SELECT d.doc_id, coalesce(sum(sign), 0)::BIGINT AS score FROM documents d LEFT JOIN
      (SELECT doc_id, sign FROM tf JOIN lex USING (term)) h ON h.doc_id = d.doc_id GROUP BY 1""",
)
def _(t):
    return sentiment_of(t)
