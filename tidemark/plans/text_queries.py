"""Queries for text operators (T) and search (V) on documents, benchmark items, conversations and embeddings.

The bundled prose is invented, so lexicons of words that do occur are passed in.
"""

from pyspark.sql import functions as F

from tidemark.functions import texts as X
from tidemark.operators import cells
from tidemark.operators import joins as J
from tidemark.operators import search as V
from tidemark.operators import terms as TT
from tidemark.operators import text as T
from tidemark.lexicons import STOPWORDS
from tidemark.plans.basic_queries import NAMES, _mention_sql
from tidemark.plans.bindings import table
from tidemark.plans.registry import R, query, r, rounded

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
TOKENS = f"list_filter({WORDS}, lambda t: length(t) >= 3 AND NOT list_contains({STOPS}, t))"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def hits(col, term):
    return f"CAST((length({col}) - length(replace({col}, '{term}', ''))) / {len(term)} AS BIGINT)"


def total(col, terms):
    return "(" + " + ".join(hits(col, t) for t in terms) + ")"


def anyof(col, terms):
    return "(" + " OR ".join(f"contains({col}, '{t}')" for t in terms) + ")"


PAD = "' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', '  ', 'g') || ' '"


def key(term):
    return X.word_key(term)


@query("t_01_tokens", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(TT.tokens("text"), " ").alias("tokens"))


@query("t_02_ngrams", f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents) SELECT doc_id, CAST(greatest(len(w) - 1, 0) AS INTEGER) AS n, CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] END AS first_gram,
 CASE WHEN len(w) > 1 THEN w[len(w) - 1] || ' ' || w[len(w)] END AS last_gram FROM t""")
def _(spark, d):
    g = docs(spark, d).select("doc_id", TT.tokens("text").alias("t")).select("doc_id", TT.ngrams(F.col("t")).alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.try_element_at("g", F.lit(1)).alias("first_gram"), F.try_element_at("g", F.lit(-1)).alias("last_gram"))


TERMS = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents),
 a AS (SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM w),
 f AS (SELECT doc_id, term, count(*) AS n, count(*) / any_value(total) AS tf FROM (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM a) GROUP BY 1, 2),
 i AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM f GROUP BY 1)"""


@query("t_03_term_freq", f"WITH {TERMS} SELECT doc_id, term, n, {R('tf', 9)} AS tf FROM f")
def _(spark, d):
    return TT.term_freq(TT.spread(docs(spark, d), "doc_id", "text"), "doc_id", "text").select("doc_id", "term", "n", r("tf", 9))


@query("t_04_idf", f"WITH {TERMS} SELECT term, df, {R('idf', 9)} AS idf FROM i")
def _(spark, d):
    return TT.idf(docs(spark, d), "doc_id", "text").select("term", "df", r("idf", 9))


@query("t_05_tfidf", f"WITH {TERMS} SELECT doc_id, term, {R('tf * idf', 9)} AS weight FROM f JOIN i USING (term)")
def _(spark, d):
    return TT.tfidf(docs(spark, d), "doc_id", "text").select("doc_id", "term", r("weight", 9))


BOOST = ["rewh", "tion"]


@query("t_06_keywords", f"""WITH {TERMS}, k AS (SELECT doc_id, term, tf * idf * CASE WHEN contains(term, 'rewh') OR contains(term, 'tion') THEN 1.5 ELSE 1 END AS x FROM f JOIN i USING (term) WHERE doc_id IN (SELECT doc_id FROM documents WHERE length(text) >= 100))
 SELECT doc_id, term, {R('x', 9)} AS weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(x, 12) DESC, term) AS INTEGER) AS rank FROM k QUALIFY rank <= 5""")
def _(spark, d):
    return TT.keywords(docs(spark, d), "doc_id", "text", 5, boost=BOOST).select("doc_id", "term", r("weight", 9), "rank")


@query("t_07_keywords_count", f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE length(text) >= 50),
 b0 AS (SELECT doc_id, w[i] AS x, w[i + 1] AS y FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
 b AS (SELECT doc_id, x || ' ' || y AS term, count(*) * CASE WHEN contains(x || ' ' || y, 'rewh') OR contains(x || ' ' || y, 'tion') THEN 2 ELSE 1 END AS n FROM b0
       WHERE length(x) > 3 AND length(y) > 3 AND NOT list_contains({STOPS}, x) AND NOT list_contains({STOPS}, y) GROUP BY doc_id, x, y),
 bt AS (SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM b QUALIFY rank <= 3),
 c AS (SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS chosen, count(*) AS have FROM bt GROUP BY 1),
 s AS (SELECT doc_id, term, count(*) * CASE WHEN term = 'rewh' OR term = 'tion' THEN 2 ELSE 1 END AS n FROM (SELECT doc_id, unnest(w) AS term FROM w) WHERE length(term) > 3 AND NOT list_contains({STOPS}, term) GROUP BY doc_id, term),
 sr AS (SELECT s.doc_id, s.term, s.n, coalesce(c.have, 0) + row_number() OVER (PARTITION BY s.doc_id ORDER BY s.n DESC, s.term) AS rank FROM s LEFT JOIN c USING (doc_id) WHERE c.chosen IS NULL OR NOT contains(c.chosen, s.term) QUALIFY rank <= 6)
 SELECT doc_id, term, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM bt UNION ALL SELECT doc_id, term, CAST(n AS BIGINT), CAST(rank AS INTEGER) FROM sr""")
def _(spark, d):
    return TT.keywords_count(docs(spark, d), "doc_id", "text", 6, boost=BOOST)


UNI = f"""w AS (SELECT doc_id, {TOKENS} AS t FROM documents), f AS (SELECT doc_id, term, count(*) / any_value(total) AS tf FROM (SELECT doc_id, len(t) AS total, unnest(t) AS term FROM w) GROUP BY 1, 2),
 i AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM f GROUP BY 1), v AS (SELECT doc_id, term, tf * idf AS x FROM f JOIN i USING (term)),
 nm AS (SELECT doc_id, sqrt(sum(x * x)) AS nd FROM v GROUP BY 1)"""


@query("t_08_cosine_pairs", f"""WITH {UNI}, p AS (SELECT doc_id AS id_a, doc_id + 1 AS id_b FROM documents), dt AS (SELECT id_a, id_b, sum(a.x * b.x) AS s FROM p JOIN v a ON a.doc_id = id_a JOIN v b ON b.doc_id = id_b AND a.term = b.term GROUP BY 1, 2)
 SELECT p.id_a, p.id_b, {R('coalesce(CASE WHEN na.nd > 0 AND nb.nd > 0 THEN s / (na.nd * nb.nd) END, 0.0)')} AS similarity FROM p LEFT JOIN dt USING (id_a, id_b) LEFT JOIN nm na ON na.doc_id = p.id_a LEFT JOIN nm nb ON nb.doc_id = p.id_b""")
def _(spark, d):
    pairs = docs(spark, d).select(F.col("doc_id").alias("id_a"), (F.col("doc_id") + 1).alias("id_b"))
    parts = TT.text_parts(docs(spark, d), "text", TT.PART_CHARS)
    return rounded(TT.cosine_pairs(TT.tfidf(docs(spark, d), "doc_id", "text", bigrams=False), pairs, doc="doc_id", parts=parts), "similarity")


@query("t_09_similar_docs", f"""WITH {UNI}, qw AS (SELECT item_id, {TOKENS} AS t FROM benchmark), qf AS (SELECT item_id, term, count(*) / any_value(total) AS tf FROM (SELECT item_id, len(t) AS total, unnest(t) AS term FROM qw) GROUP BY 1, 2),
 qv AS (SELECT item_id, qf.term, tf * coalesce(idf, ln((SELECT count(*) FROM documents) + 1)) AS x FROM qf LEFT JOIN i ON i.term = qf.term), qn AS (SELECT item_id, sqrt(sum(x * x)) AS nq FROM qv GROUP BY 1),
 dt AS (SELECT item_id, doc_id, sum(v.x * qv.x) AS s FROM v JOIN qv USING (term) GROUP BY 1, 2), z AS (SELECT item_id, doc_id, s / (nd * nq) AS sim FROM dt JOIN nm USING (doc_id) JOIN qn USING (item_id) WHERE nd > 0 AND nq > 0)
 SELECT item_id, doc_id, {R('sim')} AS similarity, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, doc_id) AS INTEGER) AS rank FROM z QUALIFY rank <= 5""")
def _(spark, d):
    df = TT.similar_docs(table(spark, d, "benchmark"), docs(spark, d), query="item_id", query_text="text", doc="doc_id", text="text")
    return rounded(df, "similarity")


POS, NEG = ["the", "ing", "ble"], ["idiot", "loser", "clown", "tion", "th "]


def sentiment_sql(pos, neg, source="documents", ident="doc_id", text="text"):
    return f"""x AS (SELECT *, {total(f'lower({text})', pos)} AS n_positive, {total(f'lower({text})', neg)} AS n_negative FROM {source}),
 y AS (SELECT *, CASE WHEN n_positive + n_negative = 0 THEN 0.5 ELSE n_positive / (n_positive + n_negative) END AS s FROM x)"""


@query("t_10_lexicon_sentiment", f"""WITH {sentiment_sql(POS, NEG)} SELECT doc_id, n_positive, n_negative, {R('s')} AS sentiment_score, CASE WHEN s > 0.6 THEN 'POSITIVE' WHEN s < 0.4 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label,
 {R('greatest(n_positive, n_negative) / (n_positive + n_negative + 1)')} AS confidence FROM y""")
def _(spark, d):
    return rounded(T.lexicon_sentiment(docs(spark, d), "text", positive=POS, negative=NEG), "sentiment_score", "confidence").drop("text")


MY_ASSETS = {"north": ["rewh", "thanedble"], "south": ["inoran"], "rude": ["idiot", "clown", "loser"]}
ASSET_CASES = ", ".join(f"CASE WHEN {anyof('lower(text)', ts)} THEN '{a}' END" for a, ts in MY_ASSETS.items())


@query("t_11_score_news", f"""WITH n AS (SELECT doc_id, substr(text, 1, 30) AS title, substr(text, 31) AS body, concat_ws(' ', substr(text, 1, 30), substr(text, 31)) AS text FROM documents), {sentiment_sql(POS, NEG, 'n')}
 SELECT doc_id, {R('s')} AS sentiment_score, array_to_string(list_filter([{ASSET_CASES}], lambda a: a IS NOT NULL), '|') AS related FROM y WHERE title <> '' OR body <> ''""")
def _(spark, d):
    news = docs(spark, d).select("doc_id", F.substring("text", 1, 30).alias("title"), F.expr("substring(text, 31)").alias("body"))
    df = T.score_news(news, "title", "body", positive=POS, negative=NEG, assets=MY_ASSETS)
    return df.select("doc_id", r("sentiment_score"), F.array_join("related_assets", "|").alias("related"))


SENT = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 1)"
SENTS = f"""CASE WHEN len({SENT}) > 0 THEN {SENT} WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 THEN [regexp_replace(text, '^\\s+|\\s+$', '', 'g')] ELSE [] END"""


@query("t_12_rollup_sentences", f"""WITH s0 AS (SELECT doc_id, {SENTS} AS ss FROM documents), s AS (SELECT doc_id, unnest(ss) AS sentence FROM s0),
 l AS (SELECT doc_id, sentence, CASE length(sentence) % 3 WHEN 0 THEN 'POSITIVE' WHEN 1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label, 0.5 + (length(sentence) % 50) / 100 AS score FROM s),
 g AS (SELECT doc_id, count(*) AS n_sentences, coalesce(sum(score) FILTER (label = 'POSITIVE'), 0) AS p, coalesce(sum(score) FILTER (label = 'NEUTRAL'), 0) AS u, coalesce(sum(score) FILTER (label = 'NEGATIVE'), 0) AS n,
   avg(score) FILTER (label = 'POSITIVE') AS ap, avg(score) FILTER (label = 'NEGATIVE') AS an, var_pop(score) FILTER (label = 'NEUTRAL') AS vu FROM l GROUP BY 1),
 h AS (SELECT *, list_sort([p, u, n], 'DESC') AS k FROM g), z AS (SELECT *, CASE WHEN k[1] - k[2] < 0.05 THEN 'NEUTRAL' WHEN p = k[1] THEN 'POSITIVE' WHEN u = k[1] THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS label FROM h)
 SELECT doc_id, label, n_sentences, round(CASE label WHEN 'POSITIVE' THEN 0.6 + 0.4 * ap WHEN 'NEGATIVE' THEN 0.4 * an ELSE 0.45 + least(0.1, coalesce(vu, 0.0)) END, 3) AS score FROM z""")
def _(spark, d):
    s = docs(spark, d).select("doc_id", F.explode(X.sentences("text")).alias("sentence"))
    n = F.length("sentence")
    scored = s.withColumn("label", F.when(n % 3 == 0, "POSITIVE").when(n % 3 == 1, "NEGATIVE").otherwise("NEUTRAL")).withColumn("score", 0.5 + (n % 50) / 100)
    return T.rollup_sentences(scored, "doc_id").select("doc_id", "label", "n_sentences", "score")


@query("t_13_asset_counts", " UNION ALL ".join(f"SELECT doc_id, '{a}' AS asset, {total('lower(text)', ts)} AS n FROM documents WHERE {anyof('lower(text)', ts)}" for a, ts in MY_ASSETS.items()))
def _(spark, d):
    return T.asset_counts(docs(spark, d), "doc_id", "text", MY_ASSETS)


MY_ASPECTS = [("REGULATION", ["idiot", "clown"]), ("MARKET", ["rewh", "license"]), ("TECHNOLOGY", ["tion"])]


@query("t_14_aspect", "SELECT doc_id, CASE " + " ".join(f"WHEN {anyof('lower(text)', ts)} THEN '{a}'" for a, ts in MY_ASPECTS) + " ELSE 'GENERAL' END AS aspect FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", T.aspect("text", MY_ASPECTS).alias("aspect"))


MY_TYPES = {"agreement": ["the", "license"], "legal_case": ["les", "de la"], "whitepaper": ["und", "der"], "regulation": ["que", "rewh"]}
MY_BONUS = {"agreement": ["permission is"], "regulation": ["idiot"]}
TYPE_SCORES = {k: total("b", [key(t) for t in ts]) + (f" + CASE WHEN {anyof('l', MY_BONUS[k])} THEN 5 ELSE 0 END" if k in MY_BONUS else "") for k, ts in MY_TYPES.items()}


@query("t_15_classify_docs", f"""WITH x AS (SELECT doc_id, source, {PAD} AS b, lower(text) AS l FROM documents), y AS (SELECT doc_id, source, {', '.join(f'{s} AS {k}' for k, s in TYPE_SCORES.items())} FROM x), z AS (SELECT *, greatest({', '.join(MY_TYPES)}) AS best FROM y)
 SELECT doc_id, CASE WHEN contains(source || '-report', 'src7') THEN 'financial_analysis' WHEN best <= 0 THEN 'other' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in MY_TYPES)} END AS document_type, CAST(best AS BIGINT) AS type_score FROM z""")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("source").contains("src7"), F.concat("source", F.lit("-report"))).otherwise("plain").alias("file"))
    return T.classify_docs(df, "text", "file", types=MY_TYPES, bonus=MY_BONUS).select("doc_id", "document_type", "type_score")


MY_CATS = {"technical": (["tion", "ing"], 200), "legal": (["the", "license"], 100)}


CAT_COLS = ", ".join(R(f"least(100.0, {total('lower(text)', ts)} / {e} * 100)") + f" AS {c}_score" for c, (ts, e) in MY_CATS.items())


@query("t_16_category_scores", f"SELECT doc_id, {CAT_COLS} FROM documents")
def _(spark, d):
    return rounded(T.category_scores(docs(spark, d), "text", MY_CATS), "technical_score", "legal_score").drop("text")


MY_RISK = {"regulatory": ["license", "rewh"], "financial": ["loser", "orre"], "technical": ["idiot", "thanedble"], "fraud": ["clown", "inoran"]}
MY_WEIGHTS = {"regulatory": 1.2, "financial": 1.0, "technical": 1.1, "fraud": 1.3}


@query("t_17_category_risk", f"""WITH x AS (SELECT doc_id, {', '.join(f"{total('lower(text)', ts)} AS n_{c}" for c, ts in MY_RISK.items())} FROM documents),
 o AS (SELECT doc_id, c, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS k FROM ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS c, n_{c} AS n, {i} AS i FROM x" for i, c in enumerate(MY_RISK))}) WHERE n > 0)
 SELECT x.*, {R('least(100.0, (' + ' + '.join(f'n_{c} * {w}' for c, w in MY_WEIGHTS.items()) + f') / {10 * sum(MY_WEIGHTS.values())} * 100)')} AS risk_score, coalesce((SELECT string_agg(c, '|' ORDER BY k) FROM o WHERE o.doc_id = x.doc_id AND k <= 3), '') AS top FROM x""")
def _(spark, d):
    df = T.category_risk(docs(spark, d), "text", categories=MY_RISK, weights=MY_WEIGHTS)
    return rounded(df, "risk_score").withColumn("top", F.array_join("top_categories", "|")).drop("text", "top_categories")


@query("t_17_risk_contexts", f"""WITH s0 AS (SELECT doc_id, {SENTS} AS ss FROM documents), s AS (SELECT doc_id, i - 1 AS i, ss[i] AS context FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0)),
 h AS ({' UNION ALL '.join(f"SELECT doc_id, i, context, {i * 1000 + j} AS o, '{c}' AS category, '{t}' AS term FROM s WHERE contains(lower(context), '{t}')" for i, (c, ts) in enumerate(MY_RISK.items()) for j, t in enumerate(ts))})
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, i) AS INTEGER) AS rank, category, term, context FROM h WHERE len(regexp_extract_all(context, '[^\\s]+')) > 5""")
def _(spark, d):
    return T.risk_contexts(docs(spark, d), "doc_id", "text", categories=MY_RISK)


MY_POINTS = {"rewh": 30, "thanedble": 25, "of the": 15, "inoran": -20, "license": -25, "idiot": 40}


@query("t_18_document_risk", f"""WITH x AS (SELECT doc_id, {PAD} AS b FROM documents), y AS (SELECT doc_id, least(100.0, greatest(0.0, 10.0 + {' + '.join(f"CASE WHEN contains(b, '{key(t)}') THEN {p} ELSE 0 END" for t, p in MY_POINTS.items())})) AS s,
 array_to_string(list_filter([{', '.join(f"CASE WHEN contains(b, '{key(t)}') THEN '{t}' END" for t in MY_POINTS)}], lambda q: q IS NOT NULL), '|') AS triggered FROM x)
 SELECT doc_id, CAST(s AS DOUBLE) AS risk_score, triggered, CASE WHEN s < 20 THEN 'Very Low' WHEN s < 40 THEN 'Low' WHEN s < 60 THEN 'Moderate' WHEN s < 80 THEN 'High' ELSE 'Very High' END AS risk_category FROM y""")
def _(spark, d):
    return T.document_risk(docs(spark, d), "text", MY_POINTS).select("doc_id", "risk_score", F.array_join("triggered", "|").alias("triggered"), "risk_category")


@query("t_19_density_risk", f"""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS word_count, {total('lower(text)', ['rewh', 'idiot', 'inoran'])} AS risk_count FROM documents)
 SELECT doc_id, word_count, risk_count, {R('CASE WHEN word_count > 0 THEN least(100.0, risk_count / word_count * 1000) ELSE 0 END')} AS risk_score FROM x""")
def _(spark, d):
    return rounded(T.density_risk(docs(spark, d), "text", ["rewh", "idiot", "inoran"]), "risk_score").drop("text")


MY_TOPICS = {"kyc": ["rewh", "the license"], "tax": ["inoran", "tion"]}
MY_TERMS = ["rewh", "thanedble", "inoran", "license", "clown", "idiot"]


@query("t_20_compliance_topics", f"""WITH x AS (SELECT doc_id, {', '.join(f"{total('lower(text)', ts)} AS n_{c}" for c, ts in MY_TOPICS.items())}, {' + '.join(f"CASE WHEN contains(lower(text), '{t}') THEN 1 ELSE 0 END" for t in MY_TERMS)} AS nt FROM documents)
 SELECT doc_id, n_kyc, n_tax, {R('least(100.0, (n_kyc + n_tax) / 20 * 100)')} AS compliance_score, CASE WHEN nt > 10 THEN 'high' WHEN nt > 5 THEN 'medium' WHEN nt > 0 THEN 'low' ELSE 'unknown' END AS compliance_level FROM x""")
def _(spark, d):
    df = T.compliance_topics(docs(spark, d), "text", topics=MY_TOPICS, terms=MY_TERMS)
    return rounded(df, "compliance_score").select("doc_id", "n_kyc", "n_tax", "compliance_score", "compliance_level")


@query("t_21_domain_risks", f"""WITH x AS (SELECT doc_id, lower(text) AS b FROM documents), y AS (SELECT doc_id, b, list_filter([{', '.join(f"CASE WHEN contains(b, '{t}') THEN '{t}' END" for t in ('rewh', 'license', 'orre'))}], lambda q: q IS NOT NULL) AS dr,
 list_filter([{', '.join(f"CASE WHEN contains(b, '{t}') THEN '{t}' END" for t in ('idiot', 'clown', 'inoran'))}], lambda q: q IS NOT NULL) AS ind FROM x),
 z AS (SELECT *, len(ind) + 2 * len(list_filter(ind, lambda q: contains(q, 'idiot'))) + len(dr) AS n FROM y)
 SELECT doc_id, array_to_string(dr, '|') AS domain_risks, CAST(n AS INTEGER) AS risk_total, CASE WHEN n > 10 THEN 'high' WHEN n > 5 THEN 'medium' WHEN n > 0 THEN 'low' ELSE 'minimal' END AS risk_level,
 CASE WHEN contains(b, 'rewh') THEN substr(b, greatest(instr(b, 'rewh') - 20, 1), instr(b, 'rewh') + 20 - greatest(instr(b, 'rewh') - 20, 1)) END AS context FROM z""")
def _(spark, d):
    df = T.domain_risks(docs(spark, d), "text", 20, factors=["rewh", "license", "orre"], security=["rewh"], indicators=["idiot", "clown", "inoran"], severe=["idiot"])
    return df.select("doc_id", F.array_join("domain_risks", "|").alias("domain_risks"), "risk_total", "risk_level", F.try_element_at("security_contexts", F.lit(1))["context"].alias("context"))


MY_REG = {"us": ["rewh", "orre"], "eu": ["inoran"]}
MY_PLACES = {"us": ["thatin"], "eu": ["ononst", "hehely"]}


def _primary(groups):
    terms = [t for ts in groups.values() for t in ts]
    best = "greatest(" + ", ".join(hits("b", t) for t in terms) + ")"
    return f"CASE WHEN {best} <= 0 THEN NULL " + " ".join(f"WHEN {hits('b', t)} = {best} THEN '{t}'" for t in terms) + " END"


@query("t_22_regulatory_mentions", f"""WITH x AS (SELECT doc_id, lower(text) AS b FROM documents) SELECT doc_id, {total('b', MY_REG['us'])} AS n_regulators_us, {total('b', MY_REG['eu'])} AS n_regulators_eu, {total('b', MY_PLACES['us'])} AS n_places_us,
 {total('b', MY_PLACES['eu'])} AS n_places_eu, CAST(least(100, ({total('b', MY_REG['us'] + MY_REG['eu'])}) * 10) AS BIGINT) AS legal_score, {_primary(MY_REG)} AS primary_regulator, {_primary(MY_PLACES)} AS primary_jurisdiction,
 array_to_string(list_filter([CASE WHEN contains(b, 'idiot') THEN 'idiot' END, CASE WHEN contains(b, 'clown') THEN 'clown' END], lambda q: q IS NOT NULL), '|') AS actions FROM x""")
def _(spark, d):
    df = T.regulatory_mentions(docs(spark, d), "text", regulators=MY_REG, places=MY_PLACES, actions=["idiot", "clown"], penalties=["loser"])
    return df.select("doc_id", "n_regulators_us", "n_regulators_eu", "n_places_us", "n_places_eu", "legal_score", "primary_regulator", "primary_jurisdiction", F.array_join("legal_actions", "|").alias("actions"))


def _req(cue):
    return f"list_transform(regexp_extract_all(text, '(?i){cue}\\s+([^.;:]+)', 1), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"


@query("t_23_requirements", f"SELECT doc_id, array_to_string(list_filter(list_concat({_req('ingly')}, {_req('the')}), lambda s: length(s) > 10), ' | ') AS requirements FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.requirements("text", cues=["ingly", "the"]), " | ").alias("requirements"))


MY_PATTERNS = {"ips": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "emails": r"[a-zA-Z0-9._]+@[a-zA-Z0-9.]+", "hex40": r"[a-f0-9]{40}", "phones": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"}


@query("t_24_extract_patterns", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS value FROM documents" for k, p in MY_PATTERNS.items()))
def _(spark, d):
    return T.pattern_rows(docs(spark, d), "doc_id", "text", MY_PATTERNS)


# Fund documents are written from the tables: one labelled text per supplier.
FUND_TEXT = """SELECT s_suppkey AS doc_id, 'Fund Name: ' || s_name || chr(10) || 'AUM: $' || CAST(s_suppkey % 900 + 1 AS VARCHAR) || ' million' || chr(10) || 'Management Fee: ' || CAST(s_suppkey % 4 AS VARCHAR) || '.5%' || chr(10)
 || 'Strategy: Market neutral ' || s_nationkey || chr(10) || 'Launch Date: 20' || lpad(CAST(s_suppkey % 20 AS VARCHAR), 2, '0') || '-03-15' || chr(10) || 'Lock-up: ' || s_nationkey || ' months' || chr(10) || chr(10)
 || 'Portfolio Allocation:' || chr(10) || '- Bitcoin: ' || CAST(s_suppkey % 50 AS VARCHAR) || '%' || chr(10) || '- Ether: ' || CAST(50 - s_suppkey % 50 AS VARCHAR) || '%' || chr(10) || '- Cash: 0.5' || chr(10) || chr(10)
 || 'Cold storage wallet 0x' || lpad(to_hex(s_suppkey), 40, 'a') || ' holds 12.5 ETH with multi-sig 2-of-3 and a ledger' || chr(10) || chr(10)
 || 'Risk Factors:' || chr(10) || 'Market swings: 7/10 hedged' || chr(10) || 'Custody: ' || CAST(s_suppkey % 100 AS VARCHAR) || '% insured' || chr(10) || chr(10)
 || 'Key Personnel:' || chr(10) || 'Ada Lovelace, Chief Engineer' || chr(10) || 'Grace Hopper, Risk Officer' || chr(10) || chr(10) || 'Compliance Framework:' || chr(10) || 'Registered: SEC adviser ' || s_nationkey || chr(10) AS text FROM supplier"""


def fund_docs(spark, d):
    k, n, nl = F.col("s_suppkey"), F.col("s_nationkey"), F.lit("\n")

    def t(x):
        return F.lit(x)

    text = F.concat(t("Fund Name: "), "s_name", nl, t("AUM: $"), k % 900 + 1, t(" million"), nl, t("Management Fee: "), k % 4, t(".5%"), nl, t("Strategy: Market neutral "), n, nl, t("Launch Date: 20"),
                    F.lpad((k % 20).cast("string"), 2, "0"), t("-03-15"), nl, t("Lock-up: "), n, t(" months"), nl, nl, t("Portfolio Allocation:"), nl, t("- Bitcoin: "), k % 50, t("%"), nl, t("- Ether: "),
                    50 - k % 50, t("%"), nl, t("- Cash: 0.5"), nl, nl, t("Cold storage wallet 0x"), F.lpad(F.hex(k), 40, "a"), t(" holds 12.5 ETH with multi-sig 2-of-3 and a ledger"), nl, nl,
                    t("Risk Factors:"), nl, t("Market swings: 7/10 hedged"), nl, t("Custody: "), k % 100, t("% insured"), nl, nl, t("Key Personnel:"), nl, t("Ada Lovelace, Chief Engineer"), nl,
                    t("Grace Hopper, Risk Officer"), nl, nl, t("Compliance Framework:"), nl, t("Registered: SEC adviser "), n, nl)
    return table(spark, d, "supplier").select(k.alias("doc_id"), text.alias("text"))


@query("t_25_fund_fields", f"""WITH f AS ({FUND_TEXT}) SELECT doc_id, regexp_extract(text, 'Fund Name: ([^\\n]+)', 1) AS fund_name, CAST(regexp_extract(text, 'AUM: .([0-9]+)', 1) AS DOUBLE) AS aum, {R("CAST(regexp_extract(text, 'Management Fee: ([0-9.]+)%', 1) AS DOUBLE) / 100")} AS management_fee,
 regexp_extract(text, 'Strategy: ([^\\n]+)', 1) AS strategy, CAST(regexp_extract(text, 'Launch Date: ([^\\n]+)', 1) AS DATE) AS launch, regexp_extract(text, 'Lock-up: ([^\\n]+)', 1) AS lock_up FROM f""")
def _(spark, d):
    return T.fund_fields(fund_docs(spark, d), "text").select("doc_id", "fund_name", "aum", r("management_fee"), "strategy", F.to_date("launch_date").alias("launch"), "lock_up")


@query("t_26_allocations", "SELECT s_suppkey AS doc_id, 'Bitcoin' AS asset, CAST(s_suppkey % 50 AS DOUBLE) / 100 AS share FROM supplier UNION ALL SELECT s_suppkey, 'Ether', CAST(50 - s_suppkey % 50 AS DOUBLE) / 100 FROM supplier UNION ALL SELECT s_suppkey, 'Cash', 0.5 FROM supplier")
def _(spark, d):
    return T.allocations(fund_docs(spark, d), "doc_id", "text")


@query("t_26_top_holdings", """WITH a AS (SELECT s_suppkey AS doc_id, 'Bitcoin' AS asset, CAST(s_suppkey % 50 AS DOUBLE) / 100 AS share FROM supplier UNION ALL SELECT s_suppkey, 'Ether', CAST(50 - s_suppkey % 50 AS DOUBLE) / 100 FROM supplier UNION ALL SELECT s_suppkey, 'Cash', 0.5 FROM supplier)
 SELECT doc_id, asset, share, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, asset) AS INTEGER) AS rank FROM a QUALIFY rank <= 2""")
def _(spark, d):
    return T.top_holdings(T.allocations(fund_docs(spark, d), "doc_id", "text"), "doc_id", 2)


@query("t_26_team_and_compliance", "SELECT s_suppkey AS doc_id, 'Ada Lovelace' AS name, 'Chief Engineer' AS title, 'SEC adviser ' || s_nationkey AS status FROM supplier UNION ALL SELECT s_suppkey, 'Grace Hopper', 'Risk Officer', 'SEC adviser ' || s_nationkey FROM supplier")
def _(spark, d):
    f = fund_docs(spark, d)
    status = T.compliance_lists(f, "text").select("doc_id", F.array_join("regulatory_status", "|").alias("status"))
    return T.team_members(f, "doc_id", "text").join(status, "doc_id")


@query("t_27_wallet_mentions", "SELECT s_suppkey AS doc_id, '0x' || lpad(to_hex(s_suppkey), 40, 'a') AS address, 'Cold Storage' AS wallet_type, 12.5::DOUBLE AS balance, 'Multi-sig (2-of-3)|Hardware Security' AS features FROM supplier")
def _(spark, d):
    df = T.wallet_mentions(fund_docs(spark, d), "doc_id", "text")
    return df.select("doc_id", "address", "wallet_type", "balance", F.array_join("security_features", "|").alias("features"))


@query("t_28_risk_table", "SELECT s_suppkey AS doc_id, 'Market swings' AS factor, 7.0::DOUBLE AS rating, 'hedged' AS mitigation FROM supplier UNION ALL SELECT s_suppkey, 'Custody', CAST(s_suppkey % 100 AS DOUBLE) / 10, 'insured' FROM supplier")
def _(spark, d):
    return T.risk_table(fund_docs(spark, d), "doc_id", "text").select("doc_id", "factor", r("rating"), "mitigation")


@query("t_29_technical_doc_features", """WITH p AS (SELECT p_partkey AS doc_id, p_size AS z FROM part) SELECT doc_id, CAST(z % 3 AS BIGINT) AS n_critical, CAST(z % 4 AS BIGINT) AS n_high, least(100.0, ((z % 3) * 10 + (z % 4) * 5) / 20 * 100) AS vulnerability_score,
 CASE WHEN z % 3 > 0 THEN 'Critical' WHEN z % 4 > 0 THEN 'High Risk' ELSE 'Secure' END AS security_rating, CASE WHEN z % 2 = 0 THEN 60.0 ELSE 50.0 END::DOUBLE AS code_quality, CAST(CASE WHEN z > 0 THEN z END AS INTEGER) AS horizon_years, '1.' || z AS version, (z + 1) * CASE z % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e9 ELSE 1 END AS token_supply FROM p""")
def _(spark, d):
    z = F.col("p_size")
    text = F.concat(F.repeat(F.lit("critical issue found. "), (z % 3).cast("int")), F.repeat(F.lit("high severity note. "), (z % 4).cast("int")), F.when(z % 2 == 0, "clean code. ").otherwise(""),
                    F.lit("version 1."), z, F.lit("; from 2010 to 20"), F.lpad((z + 10).cast("string"), 2, "0"), F.lit(". total supply of "), z + 1, F.when(z % 3 == 0, " million").when(z % 3 == 1, " billion").otherwise(""), F.lit(" tokens."))
    df = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    cols = ["doc_id", "n_critical", "n_high", "vulnerability_score", "security_rating", "code_quality", "horizon_years", "version", "token_supply"]
    return T.technical_doc_features(df, "text").select(*cols)


KEYS = ["rewh", "inoran", "thanedble", "ononst", "hehely", "orre"]
KEY_LIST = "[" + ", ".join(f"'{w}'" for w in KEYS) + "]"


@query("t_30_summarize", f"""WITH s0 AS (SELECT doc_id, {SENTS} AS ss FROM documents), s AS (SELECT doc_id, len(ss) AS n, i - 1 AS position, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0)),
 p AS (SELECT *, ' ' || regexp_replace(lower(sentence), '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || ' ' AS pw, len(list_filter({KEY_LIST}, lambda w: contains(lower(sentence), w))) AS hits FROM s),
 c AS (SELECT * FROM p WHERE n <= 3 OR position < 3 OR position >= n - 2 OR contains(pw, '{key('attion')}') OR len(list_filter({KEY_LIST}, lambda w: contains(lower(sentence), w))) > 0),
 u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(sentence), '\\s+', ' ', 'g')) ORDER BY hits DESC, position) = 1)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, position) AS INTEGER) AS rank, CAST(position AS INTEGER) AS position, CAST(hits AS INTEGER) AS hits, sentence FROM u QUALIFY rank <= 5""")
def _(spark, d):
    df = docs(spark, d).withColumn("keys", F.array(*[F.lit(w) for w in KEYS]))
    return T.summarize(df, "doc_id", "text", "keys", cues=["attion"])


@query("t_31_key_points", f"""WITH x AS (SELECT doc_id, list_filter({SENTS}, lambda s: length(s) >= 40) AS ss FROM documents) SELECT doc_id, CAST(len(ss) AS INTEGER) AS n, array_to_string(ss, ' | ') AS points FROM x""")
def _(spark, d):
    p = docs(spark, d).select("doc_id", T.key_points("text").alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.array_join("p", " | ").alias("points"))


@query("t_31_risk_sentences", f"""WITH s0 AS (SELECT doc_id, {SENTS} AS ss FROM documents), s AS (SELECT doc_id, i - 1 AS position, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s0))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY length(sentence) DESC, position) AS INTEGER) AS rank, sentence FROM s WHERE (contains(lower(sentence), 'idiot') OR contains(lower(sentence), 'rewh')) AND length(sentence) > 10 QUALIFY rank <= 5""")
def _(spark, d):
    return T.risk_sentences(docs(spark, d), "doc_id", "text", terms=["idiot", "rewh"]).select("doc_id", "rank", "sentence")


@query("t_32_word_freq", f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE length(word) >= 4 AND NOT list_contains({STOPS}, word) GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def _(spark, d):
    return TT.word_freq(docs(spark, d), "text")


@query("t_33_doc_metadata", f"SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS word_count, CAST(len({SENTS}) AS BIGINT) AS sentence_count, {R('len(regexp_extract_all(text, $$[^\\s]+$$)) / 200')} AS reading_minutes, length(substr(text, 1, 5000))::INTEGER AS preview_chars FROM documents")
def _(spark, d):
    df = T.doc_metadata(docs(spark, d), "text")
    return rounded(df, "reading_minutes").select("doc_id", "word_count", "sentence_count", "reading_minutes", F.length("preview").alias("preview_chars"))


GRAPH = f"""WITH {_mention_sql()}, e AS (SELECT a.doc_id, a.entity AS src, b.entity AS dst, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.entity <> b.entity
 AND ((b.s >= greatest(a.s - 150, 0) AND b.s <= a.s + a.size + 150) OR (b.s + b.size >= greatest(a.s - 150, 0) AND b.s + b.size <= a.s + a.size + 150)) GROUP BY 1, 2, 3)"""


@query("t_34_cooccurrence_graph", GRAPH + " SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n_docs FROM e WHERE weight > 1 GROUP BY 1, 2")
def _(spark, d):
    return T.cooccurrence_graph(J.mentions(docs(spark, d), NAMES, doc="doc_id", text="text"), doc="doc_id")


@query("t_34_degree_centrality", GRAPH + f", g AS (SELECT doc_id, entity, count(*) AS deg FROM (SELECT doc_id, src AS entity FROM e UNION ALL SELECT doc_id, dst FROM e) GROUP BY 1, 2) SELECT doc_id, entity, {R('deg / (count(*) OVER (PARTITION BY doc_id) - 1)')} AS centrality FROM g")
def _(spark, d):
    edges = J.proximity_join(J.mentions(docs(spark, d), NAMES, doc="doc_id", text="text"), doc="doc_id")
    return rounded(T.degree_centrality(edges, doc="doc_id"), "centrality")


@query("t_35_top_nodes", """WITH n AS (SELECT DISTINCT p_name AS label FROM part), w AS (SELECT label, unnest(regexp_extract_all(label, '[A-Za-z]{3,}')) AS x FROM n), c AS (SELECT x, count(*) AS k FROM w GROUP BY 1), s AS (SELECT label, sum(k) AS t FROM w JOIN c USING (x) GROUP BY 1)
 SELECT label, CAST(coalesce(t, 0) + CASE WHEN contains(lower(label), 'part') THEN 50 ELSE 0 END + CASE WHEN contains(lower(label), '7') THEN 50 ELSE 0 END AS BIGINT) AS importance FROM n LEFT JOIN s USING (label) ORDER BY importance DESC, label LIMIT 100""")
def _(spark, d):
    return T.top_nodes(table(spark, d, "part").select(F.col("p_name").alias("label")), "label", 100, ["part", "7"])


@query("t_36_relevant_passages", """WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 4))) AS w FROM benchmark),
 k AS (SELECT item_id, w FROM q WHERE w NOT IN ('what','when','where','who','why','how','does','should','could','would','will','with','from','that','this')),
 p0 AS (SELECT doc_id, regexp_split_to_array(text, '\\n') AS ps FROM documents), p AS (SELECT doc_id, i - 1 AS position, ps[i] AS passage FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p0)),
 x AS (SELECT doc_id, position, passage, unnest(list_distinct(regexp_extract_all(lower(passage), '[\\p{L}\\p{N}_]+'))) AS w FROM p), h AS (SELECT item_id, doc_id, position, count(*) AS hits, any_value(passage) AS passage FROM x JOIN k USING (w) GROUP BY 1, 2, 3)
 SELECT item_id, doc_id, CAST(position AS INTEGER) AS position, hits, passage, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id, position) AS INTEGER) AS rank FROM h QUALIFY rank <= 3""")
def _(spark, d):
    return T.relevant_passages(table(spark, d, "benchmark"), docs(spark, d), question="item_id", question_text="text", doc="doc_id", text="text")


MY_QCATS = {"risk": ["the", "ing"], "market": ["que", "les"], "legal": ["und", "der", "die"]}
QH = {c: " + ".join(f"CASE WHEN contains(q, '{t}') THEN 1 ELSE 0 END" for t in ts) for c, ts in MY_QCATS.items()}


@query("t_37_classify_questions", f"""WITH x AS (SELECT conv_id, turn, lower(text) AS q, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM conversations WHERE role = 'user'), y AS (SELECT conv_id, turn, q, n, {', '.join(f'{s} AS {c}' for c, s in QH.items())} FROM x), z AS (SELECT *, greatest({', '.join(MY_QCATS)}) AS best FROM y)
 SELECT conv_id, turn, CASE WHEN best <= 0 THEN 'general' {' '.join(f"WHEN {c} = best THEN '{c}'" for c in MY_QCATS)} END AS primary_category,
 CASE WHEN {anyof('q', ['was', 'were', 'did', 'had', 'happened', 'occurred', 'previous', 'historically', 'before', 'earlier', 'last', 'past', 'history'])} THEN 'past'
      WHEN {anyof('q', ['will', 'going to', 'shall', 'may', 'might', 'could', 'would', 'predict', 'forecast', 'projection', 'expect', 'anticipate', 'future', 'soon', 'upcoming', 'next', 'tomorrow'])} THEN 'future' ELSE 'present' END AS temporality,
 {anyof("' ' || q || ' '", [f' {t} ' for t in ('compare', 'or', 'more', 'less', 'better', 'worse', 'between', 'against', 'best', 'worst', 'higher', 'lower', 'vs', 'versus', 'similar')])} AS is_comparison,
 CASE WHEN n > 30 OR {' + '.join(f"CASE WHEN contains(' ' || q || ' ', ' {t} ') THEN 1 ELSE 0 END" for t in ('and', 'or', 'but', 'if', 'while', 'however'))} > 2 OR length(q) - length(replace(q, '?', '')) > 1 THEN 'high'
      WHEN n > 15 OR {' + '.join(f"CASE WHEN contains(' ' || q || ' ', ' {t} ') THEN 1 ELSE 0 END" for t in ('and', 'or', 'but', 'if', 'while', 'however'))} > 0 THEN 'medium' ELSE 'low' END AS complexity FROM z""")
def _(spark, d):
    df = table(spark, d, "conversations").where("role = 'user'")
    out = T.classify_questions(df, "text", MY_QCATS)
    return out.select("conv_id", "turn", "primary_category", "temporality", "is_comparison", "complexity")


@query("t_38_extraction_confidence", """SELECT s_suppkey AS doc_id, CAST(15 + 10 + 10 + 20 + CASE WHEN s_suppkey % 2 = 0 THEN 20 ELSE 0 END AS INTEGER) AS confidence FROM supplier""")
def _(spark, d):
    f = T.fund_fields(fund_docs(spark, d), "text").withColumn("n_wallets", F.size(X.extract_all(F.col("text"), "0x[a-fA-F0-9]{40}"))).withColumn("n_holdings", F.when(F.col("doc_id") % 2 == 0, 3).otherwise(0))
    return T.extraction_confidence(f).select("doc_id", "confidence")


@query("t_39_assemble_document", f"""WITH x AS (SELECT doc_id, lower(text) AS b FROM documents) SELECT doc_id, CASE WHEN contains(b, 'rewh') THEN 'rewh' ELSE 'fallback' END AS keyword, CAST(least(100, 50 + 5 * ({' + '.join(f"CASE WHEN contains(b, '{t}') THEN 1 ELSE 0 END" for t in ('idiot', 'inoran', 'orre'))})) AS INTEGER) AS extracted_risk_score,
 array_to_string(list_distinct([t FOR t IN [CASE WHEN contains(b, 'tion') THEN 'tion' END] IF t IS NOT NULL]), '|') AS assets FROM x""")
def _(spark, d):
    low = F.lower("text")
    df = docs(spark, d).select("doc_id", X.found_terms(low, ["rewh"]).alias("k"), F.array(F.lit("fallback")).alias("f"), X.found_terms(low, ["tion"]).alias("p"), X.found_terms(low, ["tion"]).alias("s"),
                               X.found_terms(low, ["idiot", "inoran", "orre"]).alias("i"))
    out = T.assemble_document(df, keywords="k", fallback_keywords="f", protocols="p", standards="s", indicators="i")
    return out.select("doc_id", F.col("keywords_final")[0].alias("keyword"), "extracted_risk_score", F.array_join("asset_entities", "|").alias("assets"))


# --------------------------------------------------------------------------------------- search
COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def query_vectors(spark, d):
    """Each benchmark item asks with the vector of the same number."""
    items = table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("question"))
    return items.join(vectors(spark, d).withColumnRenamed("vec_id", "item_id"), "item_id")


@query("v_01_knn", f"""WITH q AS (SELECT item_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id), s AS (SELECT item_id AS query_id, vec_id AS item_id, round({COS}, 9) AS similarity FROM q, embeddings v)
 SELECT query_id, item_id, {R('similarity')} AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS INTEGER) AS rank FROM s WHERE similarity >= 0.2 QUALIFY rank <= 10""")
def _(spark, d):
    df = V.knn(query_vectors(spark, d), vectors(spark, d), query="item_id", query_vec="embedding", item="vec_id", vec="embedding", k=10, min_sim=0.2)
    return rounded(df, "similarity")


EXACT10 = f"""q AS (SELECT item_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id), s AS (SELECT q.item_id AS query_id, vec_id, round({COS}, 9) AS similarity FROM q, embeddings v),
 t AS (SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10)"""


@query("v_02_knn_sketch", f"""WITH {EXACT10} SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, {R('avg(similarity)')} AS mean_similarity, true AS recall_from_90 FROM t""")
def _(spark, d):
    """The exact neighbours as SQL finds them, and whether nine tenths of them come back from the sketches."""
    v, q = vectors(spark, d), query_vectors(spark, d)
    options = dict(query="item_id", query_vec="embedding", item="vec_id", vec="embedding", k=10)
    report = cells.recall_report(V.knn_sketch(q, v, **options), V.knn(q, v, **options))
    return report.select("queries", "neighbours", r("mean_similarity"), (F.col("recall") >= 0.9).alias("recall_from_90"))


@query("v_02_knn_cells", f"""WITH {EXACT10} SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, {R('avg(similarity)')} AS mean_similarity, true AS recall_from_90 FROM t""")
def _(spark, d):
    """The exact neighbours as SQL finds them, and whether nine tenths of them come back from the index."""
    v, q = vectors(spark, d), query_vectors(spark, d)
    options = dict(query="item_id", query_vec="embedding", item="vec_id", vec="embedding", k=10)
    near = cells.knn_cells(q, v, cells.fit_cells(v, item="vec_id", vec="embedding"), **options)
    report = cells.recall_report(near, V.knn(q, v, **options))
    return report.select("queries", "neighbours", r("mean_similarity"), (F.col("recall") >= 0.9).alias("recall_from_90"))


KW = """qk AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3))) AS w FROM benchmark)"""


def kw_sql(source, ident):
    return f"""SELECT item_id, {ident}, count(*) AS hits FROM (SELECT {ident}, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM {source}) JOIN qk USING (w) GROUP BY 1, 2"""


@query("v_03_keyword_search", f"""WITH {KW}, h AS ({kw_sql('documents', 'doc_id')}) SELECT item_id, doc_id, hits, round(least(0.8, hits * 0.1), 6)::DOUBLE AS relevance, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 10""")
def _(spark, d):
    return V.keyword_search(table(spark, d, "benchmark"), docs(spark, d), query="item_id", query_text="text", doc="doc_id", text="text", k=10)


def bm25_sql(source):
    return f"""b AS (SELECT doc_id, {TOKENS} AS t FROM {source}), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM b), aq AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS term FROM benchmark),
 pf AS (SELECT doc_id, any_value(l) AS l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM b) GROUP BY doc_id, term), dfq AS (SELECT term, count(*) AS df FROM pf GROUP BY 1),
 bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS s FROM pf JOIN aq USING (term) JOIN dfq USING (term), st GROUP BY 1, 2)"""


BM25_TOP = f"""WITH {bm25_sql('documents')} SELECT item_id, doc_id, {R('s')} AS bm25, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 10"""


@query("v_04_bm25", BM25_TOP)
def _(spark, d):
    return rounded(V.bm25(table(spark, d, "benchmark"), docs(spark, d), query="item_id", query_text="text", doc="doc_id", text="text", k=10), "bm25")


@query("v_04_bm25_blocks", BM25_TOP)
def _(spark, d):
    return rounded(V.bm25_blocks(table(spark, d, "benchmark"), docs(spark, d), query="item_id", query_text="text", doc="doc_id", text="text", k=10), "bm25")


HYBRID = f"""WITH dv AS (SELECT doc_id, text, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id), {bm25_sql('dv')}, q AS (SELECT item_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id),
 s AS (SELECT item_id, doc_id, CASE WHEN v.embedding IS NOT NULL THEN round({COS}, 9) END AS c FROM q, dv v), vr AS (SELECT item_id, min(c) AS lo, max(c) AS hi FROM s GROUP BY 1), tr AS (SELECT item_id, min(s) AS lo, max(s) AS hi FROM bm GROUP BY 1),
 f AS (SELECT s.item_id AS query_id, s.doc_id, CASE WHEN c IS NULL THEN 0 WHEN vr.hi > vr.lo THEN (c - vr.lo) / (vr.hi - vr.lo) ELSE 1 END AS vp, CASE WHEN bm.s IS NULL THEN 0 WHEN tr.hi > tr.lo THEN (bm.s - tr.lo) / (tr.hi - tr.lo) ELSE 1 END AS kp
       FROM s JOIN vr USING (item_id) LEFT JOIN bm ON bm.item_id = s.item_id AND bm.doc_id = s.doc_id LEFT JOIN tr ON tr.item_id = s.item_id),
 g AS (SELECT *, round(0.5 * vp + 0.5 * kp, 9) AS score FROM f)"""


def hybrid_inputs(spark, d):
    both = docs(spark, d).join(vectors(spark, d).withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return dict(query="item_id", query_text="question", query_vec="embedding", doc="doc_id", text="text", vec="embedding", k=10), query_vectors(spark, d), both


@query("v_05_hybrid_search", HYBRID + f" SELECT query_id, doc_id, {R('score')} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10")
def _(spark, d):
    options, q, both = hybrid_inputs(spark, d)
    return rounded(V.hybrid_search(q, both, **options), "score")


@query("v_06_cascade_search", f"""WITH {KW}, a AS ({kw_sql('documents', 'doc_id')}), b AS ({kw_sql('(SELECT page_id AS doc_id, html AS text FROM pages)', 'doc_id')}), c AS ({kw_sql('(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)', 'doc_id')}),
 u AS (SELECT item_id, doc_id, hits, 0 AS tier FROM a WHERE hits >= 6 UNION ALL SELECT item_id, doc_id, hits, 1 FROM b WHERE hits >= 3 UNION ALL SELECT item_id, doc_id, hits, 2 FROM c), m AS (SELECT item_id, min(tier) AS tier FROM u GROUP BY 1)
 SELECT item_id, doc_id, hits, tier, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM u SEMI JOIN m USING (item_id, tier) QUALIFY rank <= 5""")
def _(spark, d):
    q = table(spark, d, "benchmark")
    opts = dict(query="item_id", query_text="text", doc="doc_id", text="text")
    a = V.keyword_hits(q, docs(spark, d), **opts).where("hits >= 6")
    b = V.keyword_hits(q, table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), **opts).where("hits >= 3")
    c = V.keyword_hits(q, table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), **opts)
    return V.cascade_search([a, b, c], query="item_id", k=5, order=[F.col("hits").desc(), F.col("doc_id")])


@query("v_07_search_all", f"""WITH {KW}, a AS ({kw_sql('documents', 'doc_id')}), b AS ({kw_sql('(SELECT conv_id * 1000 + turn AS id, text FROM conversations)', 'id')})
 SELECT 'documents' AS table_name, item_id, doc_id AS id, hits, round(least(0.8, hits * 0.1), 6)::DOUBLE AS relevance, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS INTEGER) AS rank FROM a QUALIFY rank <= 3
 UNION ALL SELECT 'conversations', item_id, id, hits, round(least(0.8, hits * 0.1), 6)::DOUBLE, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, id) AS INTEGER) AS rank FROM b QUALIFY rank <= 3""")
def _(spark, d):
    talk = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return V.search_all(table(spark, d, "benchmark"), {"documents": (docs(spark, d), "doc_id", "text"), "conversations": (talk, "id", "text")}, query="item_id", query_text="text", k=3)


@query("v_08_explain_score", HYBRID + f" SELECT query_id, doc_id, {R('score')} AS score, {R('vp')} AS vector_part, {R('kp')} AS keyword_part, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 10")
def _(spark, d):
    options, q, both = hybrid_inputs(spark, d)
    return rounded(V.hybrid_search(q, both, explain=True, **options), "score", "vector_part", "keyword_part")


TOPIC_WORDS = ["rewh", "inoran", "ononst", "orre", "hehely", "orantion", "thatin", "idiot"]


@query("v_09_related_by_topics", f"""WITH t AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in TOPIC_WORDS)}], lambda x: x IS NOT NULL) AS s FROM documents), n AS (SELECT * FROM t WHERE len(s) > 0),
 p AS (SELECT a.doc_id, b.doc_id AS related_id, len(list_intersect(a.s, b.s)) AS shared FROM n a JOIN n b ON a.doc_id <> b.doc_id AND list_has_any(a.s, b.s))
 SELECT doc_id, related_id, CAST(shared AS BIGINT) AS shared, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, related_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 3""")
def _(spark, d):
    df = docs(spark, d).select("doc_id", X.found_terms(F.lower("text"), TOPIC_WORDS).alias("topics"))
    return V.related_by_topics(df, doc="doc_id", topics="topics")


@query("v_10_project_2d")
def _(spark, d):
    return rounded(V.project_2d(vectors(spark, d), item="vec_id", vec="embedding"), "x", "y")
