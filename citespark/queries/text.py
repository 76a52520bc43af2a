"""Text and topics."""

from pyspark.sql import functions as F

from citespark.adapter import VIEWS
from citespark.operators import gibbs as gb
from citespark.operators import text as tx
from citespark.operators import topics as tp
from citespark.queries import query
from citespark.queries.series import doc_nodes, r6
from citespark.session import cut_lineage


def en(c):
    return c.texts


def tokens(c):
    clean = en(c).select("EID", tx.clean_text("AB").alias("AB")).dropna()
    return tx.tokenize(clean, "EID", "AB")


@query("compose_text", "SELECT doc_id AS EID, md5(concat_ws(' ', source, lang, text)) AS h FROM documents")
def _(c):
    return c.abstracts.select("EID", F.md5(tx.compose_text("SO", "LA", "AB")).alias("h"))


@query("clean_text", "SELECT document, md5(AB) AS h, CAST(length(AB) AS BIGINT) AS n FROM text_clean")
def _(c):
    d = c.abstracts.select(F.col("EID").alias("document"), tx.clean_text("AB").alias("AB")).dropna()
    return d.select("document", F.md5("AB").alias("h"), F.length("AB").cast("long").alias("n"))


@query("tokenize", "SELECT document, term, count(*) AS n FROM tokens GROUP BY 1, 2")
def _(c):
    return tokens(c).groupBy("document", "term").agg(F.count(F.lit(1)).alias("n"))


@query("min_length_filter", "SELECT term, count(*) AS n FROM tokens WHERE length(term) > 2 GROUP BY 1")
def _(c):
    return tx.min_length_filter(tokens(c)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("stopword_removal", "SELECT document, count(*) AS n FROM tokens WHERE term NOT IN (SELECT word FROM stops) GROUP BY 1")
def _(c):
    return tx.remove_stopwords(tokens(c)).groupBy("document").agg(F.count(F.lit(1)).alias("n"))


# a dictionary made of the data: words in -ing lose the ending
DICT = """dict AS (SELECT DISTINCT term AS token, substr(term, 1, length(term) - 3) AS lemma FROM tokens WHERE length(term) > 5 AND term LIKE '%ing'),
    alll AS (SELECT token, lemma FROM lemmas UNION ALL SELECT token, lemma FROM dict WHERE token NOT IN (SELECT token FROM lemmas))"""


def _dictionary(c):
    t = tokens(c).select(F.col("term").alias("token")).distinct().where((F.length("token") > 5) & F.col("token").endswith("ing"))
    return t.withColumn("lemma", F.expr("substring(token, 1, length(token) - 3)"))


@query("lemmatize", f"WITH {DICT} SELECT coalesce(lemma, term) AS term, count(*) AS n FROM tokens LEFT JOIN alll ON term = token GROUP BY 1")
def _(c):
    return tx.lemmatize(tokens(c), _dictionary(c)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("term_counts", "SELECT * FROM text_tidy")
def _(c):
    return tx.text_tidy(c.texts, "EID", "AB")  # read once, so no stage table


VIEWS["placed"] = r"""SELECT document, term, pos FROM (SELECT document, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT t.document,
    list_filter(regexp_split_to_array(lower(t.AB), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
    FROM text_clean t))"""


ORACLES_OF_NGRAMS = """WITH g AS (SELECT document, term, lead(term, 1) OVER w AS t2, lead(term, 2) OVER w AS t3 FROM placed WINDOW w AS (PARTITION BY document ORDER BY pos)),
    a AS (SELECT 1 AS size, term FROM g UNION ALL SELECT 2, term || '_' || t2 FROM g WHERE t2 IS NOT NULL UNION ALL SELECT 3, term || '_' || t2 || '_' || t3 FROM g WHERE t3 IS NOT NULL)
    SELECT size, term, count(*) AS n FROM a GROUP BY 1, 2"""


@query("ngrams", ORACLES_OF_NGRAMS)
def _(c):
    clean = en(c).select("EID", tx.clean_text("AB").alias("AB")).dropna()
    return tx.text_ngrams(clean, "EID", "AB").groupBy("size", "term").agg(F.count(F.lit(1)).alias("n"))


@query("ngrams_of_tokens", ORACLES_OF_NGRAMS)
def _(c):
    clean = en(c).select("EID", tx.clean_text("AB").alias("AB")).dropna()
    return tx.ngram_counts(tx.ngrams(tx.tokenize(clean, "EID", "AB", position=True)))


@query("remove_sparse_terms", """WITH k AS (SELECT term FROM text_tidy GROUP BY 1 HAVING count(*) > (SELECT count(DISTINCT document) FROM text_tidy) * 0.01::DOUBLE)
    SELECT document, term, n FROM text_tidy WHERE term IN (SELECT term FROM k)""")
def _(c):
    return tx.remove_sparse_terms(c.text_tidy)


@query("trim_by_frequency_quantile", """WITH f AS (SELECT term, sum(n) AS tf FROM text_tidy GROUP BY 1)
    SELECT document, term, n FROM text_tidy WHERE term IN (SELECT term FROM f WHERE tf >= (SELECT quantile_cont(tf, 0.9) FROM f))""")
def _(c):
    return tx.trim_by_frequency_quantile(c.text_tidy)


@query("min_tokens_per_doc", """SELECT document, term, n FROM text_tidy WHERE document IN (SELECT document FROM text_tidy GROUP BY 1 HAVING sum(n) >= 50)""")
def _(c):
    return tx.min_tokens_per_doc(c.text_tidy, 50)


@query("top_features", "SELECT term, CAST(sum(n) AS BIGINT) AS freq FROM text_tidy GROUP BY 1 ORDER BY freq DESC, term LIMIT 500")
def _(c):
    return tx.top_features(c.text_tidy)


@query("topic_top_terms", "SELECT topic, term, round(beta, 9) AS beta FROM (SELECT *, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS r FROM beta) WHERE r <= 10")
def _(c):
    return tp.topic_top_terms(c.beta).select("topic", "term", F.round("beta", 9).alias("beta"))


@query("dominant_topic", """SELECT d.document AS EID, d.PY, d.com, coalesce(t.topic, -1) AS topic FROM doc_nodes d LEFT JOIN
    (SELECT document, topic FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY gamma DESC, topic) AS r FROM gamma) WHERE r = 1) t ON d.document = t.document""")
def _(c):
    d = tp.dominant_topic(c.gamma, doc_nodes(c))
    return d.withColumn("topic", F.coalesce("topic", F.lit(-1).cast("long")))


@query("topic_edges", """SELECT g.document AS EID, topic, gamma AS weight, d.PY, coalesce(l.com, -1) AS com FROM gamma g JOIN doc_nodes d ON g.document = d.document LEFT JOIN labels l ON g.document = l.id""")
def _(c):
    d = tp.topic_edges(c.gamma, doc_nodes(c), c.labels)
    return d.withColumn("com", F.coalesce("com", F.lit(-1).cast("long")))


PROP = """len AS (SELECT document, sum(n) AS len FROM text_tidy GROUP BY 1),
    tk AS (SELECT topic, sum(gamma * len) AS tokens FROM gamma JOIN len USING (document) GROUP BY 1),
    sh AS (SELECT topic, tokens, tokens / (SELECT sum(tokens) FROM tk) AS share FROM tk)"""


@query("topic_proportions", f"WITH {PROP} SELECT topic, round(tokens, 4) AS tokens, round(share, 6) AS share FROM sh")
def _(c):
    d = tp.topic_proportions(c.gamma, c.text_tidy)
    return d.withColumns({"tokens": F.round("tokens", 4), "share": F.round("share", 6)})


@query("topic_proportions_subset", f"""WITH {PROP} SELECT topic, round(tokens / (SELECT sum(tokens) FROM tk WHERE topic IN (1, 3)), 6) AS share FROM tk WHERE topic IN (1, 3)""")
def _(c):
    return r6(tp.topic_proportions(c.gamma, c.text_tidy, [1, 3]).select("topic", "share"), "share")


@query("term_saliency", f"""WITH {PROP}, j AS (SELECT b.term, b.topic, b.beta * s.share AS j, s.share FROM beta b JOIN sh s ON b.topic = s.topic),
    p AS (SELECT term, share, j / sum(j) OVER (PARTITION BY term) AS ptw FROM j), f AS (SELECT term, CAST(sum(n) AS BIGINT) AS freq FROM text_tidy GROUP BY 1)
    SELECT p.term, freq, round(freq * sum(ptw * ln(ptw / share)), 4) AS saliency FROM p JOIN f ON p.term = f.term GROUP BY 1, 2""")
def _(c):
    d = tp.term_saliency(c.beta, tp.topic_proportions(c.gamma, c.text_tidy), c.text_tidy)
    return d.withColumn("saliency", F.round("saliency", 4))


@query("term_relevance", """WITH f AS (SELECT term, sum(n) AS freq FROM text_tidy GROUP BY 1), t AS (SELECT sum(freq) AS total FROM f),
    s AS (SELECT topic, b.term, 0.6::DOUBLE * ln(beta) + (1 - 0.6::DOUBLE) * (ln(beta) - ln(CAST(freq AS DOUBLE) / total)) AS rel FROM beta b JOIN f ON b.term = f.term, t)
    SELECT topic, term, round(rel, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(rel, 9) DESC, term) AS r FROM s) WHERE r <= 30""")
def _(c):
    return tp.term_relevance(c.beta, c.text_tidy).select("topic", "term", F.round("relevance", 6).alias("relevance"))


@query("topic_distance", """WITH x AS (SELECT i.topic AS topic_i, j.topic AS topic_j FROM (SELECT DISTINCT topic FROM beta) i JOIN (SELECT DISTINCT topic FROM beta) j ON i.topic < j.topic),
    w AS (SELECT DISTINCT term FROM beta),
    m AS (SELECT topic_i, topic_j, coalesce(a.beta, 0) AS p, coalesce(b.beta, 0) AS q FROM x CROSS JOIN w LEFT JOIN beta a ON a.topic = topic_i AND a.term = w.term
    LEFT JOIN beta b ON b.topic = topic_j AND b.term = w.term)
    SELECT topic_i, topic_j, round(0.5::DOUBLE * sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END), 6) AS jsd FROM m GROUP BY 1, 2""")
def _(c):
    return r6(tp.topic_distance(c.beta), "jsd")


STEM = """st AS (SELECT DISTINCT term, substr(term, 1, 4) AS stem FROM tokens), cn AS (SELECT stem, t.term, count(*) AS n FROM tokens t JOIN st ON t.term = st.term GROUP BY 1, 2),
    be AS (SELECT stem, term AS fl FROM (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, term) AS r FROM cn) WHERE r = 1)"""


@query("corpus_clean_stem_complete", f"WITH {STEM} SELECT fl AS term, count(*) AS n FROM tokens t JOIN st ON t.term = st.term JOIN be ON st.stem = be.stem GROUP BY 1")
def _(c):
    t = tokens(c)
    stems = t.select("term").distinct().withColumn("stem", F.substring("term", 1, 4))
    return tx.stem_complete(t, stems).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_clean", r"""SELECT EID, md5(lower(regexp_replace(trim(regexp_replace(AB, '[\s\p{Z}]+', ' ', 'g')), '\p{P}+', '', 'g'))) AS h FROM abstracts""")
def _(c):
    return tx.corpus_clean(en(c).select("EID", "AB"), "AB").select("EID", F.md5("AB").alias("h"))


# topic model: iterative, checked by rows and by the invariants in tests/test_tables.py
def _model(c, k):
    counts = tx.remove_sparse_terms(c.text_tidy)
    vectors, index = tp.doc_term_vectors(counts)
    return tp.lda_fit(vectors, k), vectors, index


KEPT = """kept AS (SELECT document, term, n FROM text_tidy WHERE term IN (SELECT term FROM text_tidy GROUP BY 1
    HAVING count(*) > (SELECT count(DISTINCT document) FROM text_tidy) * 0.01::DOUBLE))"""


@query("doc_term_vectors", f"""WITH {KEPT} SELECT document, CAST((SELECT count(DISTINCT term) FROM kept) AS INTEGER) AS vocabulary,
    CAST(sum(n) AS DOUBLE) AS tokens FROM kept GROUP BY 1""")
def _(c):
    v, _ = tp.doc_term_vectors(tx.remove_sparse_terms(c.text_tidy))
    sizes = F.udf(lambda x: (int(x.size), float(x.values.sum())), "vocabulary int, tokens double", useArrow=False)
    return v.select("document", sizes("features").alias("_s")).select("document", "_s.*")


@query("topic_model_sums", f"""WITH {KEPT}, k AS (SELECT unnest(range(1, 7)) AS topic)
    SELECT 'topic' AS kind, topic AS id, (SELECT count(DISTINCT term) FROM kept) AS n, 1.0::DOUBLE AS total FROM k
    UNION ALL SELECT 'document', document, 6, 1.0::DOUBLE FROM kept GROUP BY document""")
def _(c):
    """Every topic has every term and every document every topic, with weights that sum to one."""
    model, vectors, index = _model(c, 6)
    beta, gamma = tp.topic_terms(model, index), tp.doc_topics(model, vectors)
    sums = [x.groupBy(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id")).agg(
        F.countDistinct(other).alias("n"), F.round(F.sum(value), 6).alias("total"))
        for x, kind, key, other, value in ((beta, "topic", "topic", "term", "beta"), (gamma, "document", "document", "topic", "gamma"))]
    return sums[0].unionByName(sums[1])


@query("lda_fit")
def _(c):
    model, vectors, index = _model(c, 6)
    return tp.topic_top_terms(tp.topic_terms(model, index), ties=False)


@query("topic_terms")
def _(c):
    model, _, index = _model(c, 6)
    return tp.topic_terms(model, index)


@query("doc_topics")
def _(c):
    model, vectors, _ = _model(c, 6)
    return tp.doc_topics(model, vectors)


@query("term_index", f"WITH {KEPT} SELECT row_number() OVER (ORDER BY term) - 1 AS index, term FROM (SELECT DISTINCT term FROM kept)")
def _(c):
    return gb.term_index(tx.remove_sparse_terms(c.text_tidy))


@query("term_matrix", f"""WITH {KEPT}, i AS (SELECT row_number() OVER (ORDER BY term) - 1 AS index, term FROM (SELECT DISTINCT term FROM kept))
    SELECT document, index, CAST(sum(n) AS BIGINT) AS n FROM kept k JOIN i ON k.term = i.term GROUP BY 1, 2""")
def _(c):
    counts = cut_lineage(tx.remove_sparse_terms(c.text_tidy))
    return gb.term_matrix(counts, gb.term_index(counts))


@query("gibbs_counts", f"""WITH {KEPT} SELECT 'document' AS kind, CAST(document AS VARCHAR) AS name, CAST(sum(n) AS BIGINT) AS n, 1.0::DOUBLE AS total
    FROM kept GROUP BY document UNION ALL SELECT 'term', term, CAST(sum(n) AS BIGINT), NULL FROM kept GROUP BY term""")
def _(c):
    """No sweep loses a token: topic counts add up to the tokens of each document and of each term, shares to one."""
    counts = cut_lineage(tx.remove_sparse_terms(c.text_tidy))
    index = cut_lineage(gb.term_index(counts))
    tokens = gb.gibbs_fit(gb.term_matrix(counts, index), sweeps=12)
    docs = gb.gibbs_doc_topics(tokens).groupBy(F.col("document").cast("string").alias("name")).agg(
        F.sum("n").alias("n"), F.round(F.sum("gamma"), 6).alias("total"))
    terms = gb.gibbs_topic_terms(tokens, index).groupBy(F.col("term").alias("name")).agg(F.sum("n").alias("n"))
    return docs.select(F.lit("document").alias("kind"), "name", "n", "total").unionByName(
        terms.select(F.lit("term").alias("kind"), "name", "n", F.lit(None).cast("double").alias("total")))
