"""Tokens, n-grams, TF-IDF, keywords and similarity.

Terms live in long form ``(doc, term, ...)``: counts combine on the map side, and
per-document steps only ever see one document's terms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import scale
from tidemark.functions.texts import words
from tidemark.lexicons import BOOST_TERMS, STOPWORDS
from tidemark.operators import termparts
from tidemark.session import written

#: Characters of text whose terms one task unfolds, and of a part of :func:`tfidf`: the larger a part, the more of its documents share what it asks.
CHARS, PART_CHARS = 1 << 22, 1 << 23
#: Parts whose different words, and whose different pairs of words, one task adds up: every part sends a message to each such task, so they are kept few.
BUCKET_PARTS = 8, 2
#: Rows of weights one task of :func:`cosine_pairs` joins.
PAIR_ROWS = 1 << 20


def tokens(text: str | Column, stopwords: Sequence[str] = tuple(STOPWORDS), min_len: int = 3) -> Column:
    """Lower-case words without stop-words and short words, in order."""
    stops = list(stopwords)
    return F.filter(words(text), lambda t: (F.length(t) >= min_len) & ~t.isin(stops) if stops else F.length(t) >= min_len)


def ngrams(tokens_col: Column, n: int = 2) -> Column:
    """Neighbouring words joined by a blank."""
    count = F.size(tokens_col) - (n - 1)
    parts = [F.slice(tokens_col, i + 1, F.greatest(count, F.lit(0))) for i in range(n)]
    joined = parts[0]
    for part in parts[1:]:
        joined = F.zip_with(joined, part, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(count > 0, joined).otherwise(F.array().cast("array<string>"))


def doc_terms(docs: DataFrame, doc: str | Sequence[str], text: str, *, bigrams: bool = True, stopwords: Sequence[str] = tuple(STOPWORDS)) -> DataFrame:
    """(document, or other columns to keep, array of its terms with repeats)."""
    keep = scale.as_keys(doc)
    base = docs.select(*keep, tokens(F.col(text), stopwords).alias("_t"))
    return base.select(*keep, F.concat("_t", ngrams(F.col("_t"), 2)).alias("_t")) if bigrams else base


def runs(base: DataFrame, *arrays: str) -> DataFrame:
    """``base`` with every named array of terms replaced by an array of (term, n): its different terms, ascending, and how often each occurs.

    Equal terms lie side by side once they are sorted, so a text is counted inside its own row: nothing is shuffled and no task holds the terms of more than one text.
    """
    rest = [c for c in base.columns if c not in arrays]
    ordered = base.select(*rest, *[F.sort_array(a).alias(a) for a in arrays])

    def starts(a: str) -> Column:
        placed = F.transform(a, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
        return F.filter(placed, lambda x: (x["at"] == 0) | (x["term"] != F.get(F.col(a), x["at"] - 1)))

    def counts(a: str) -> Column:
        return F.transform(a, lambda x, j: F.struct(x["term"].alias("term"), (F.coalesce(F.get(F.col(a), j + 1)["at"], F.col(f"_size_{a}")) - x["at"]).cast("long").alias("n")))

    found = ordered.select(*rest, *[starts(a).alias(a) for a in arrays], *[F.size(a).alias(f"_size_{a}") for a in arrays])
    return found.select(*rest, *[counts(a).alias(a) for a in arrays])


def term_freq(docs: DataFrame, doc: str, text: str, *, bigrams: bool = True, stopwords: Sequence[str] = tuple(STOPWORDS)) -> DataFrame:
    """(document, term, count, share of the document's terms).

    Over texts from :func:`spread` the per-document counts need no shuffle of the (far
    larger) exploded terms.
    """
    base = doc_terms(docs, doc, text, bigrams=bigrams, stopwords=stopwords)
    rows = scale.unnest(base, [doc, F.size("_t").alias("_total")], "_t", "term")
    counts = rows.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("n"), F.first("_total").alias("_total"))
    return counts.select(doc, "term", "n", (F.col("n") / F.col("_total")).alias("tf"))


def idf(docs: DataFrame, doc: str, text: str, *, bigrams: bool = True, stopwords: Sequence[str] = tuple(STOPWORDS)) -> DataFrame:
    """(term, documents with it, ln((N + 1) / (df + 1))); each document adds its distinct terms, combined on the map side."""
    base = doc_terms(docs, doc, text, bigrams=bigrams, stopwords=stopwords).select(doc, F.array_distinct("_t").alias("_t"))
    df = scale.unnest(base, [], "_t", "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.ln((doc_total(docs) + 1) / (F.col("df") + 1)))


def spread(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Texts hash-partitioned by document id: everything per document then stays in its task.

    The number of partitions follows the characters of the whole table, counted first, and is not coalesced: a task unfolds the terms of about
    :data:`CHARS` characters, however large the table. Left to their size in bytes, partitions of texts are joined into ones whose terms are many times as large.
    """
    return docs.select(doc, text).repartition(text_parts(docs, text), doc)


def text_parts(docs: DataFrame, text: str, size: int | None = None) -> int:
    """Number of partitions of about ``size`` (:data:`CHARS`) characters; at least the session's shuffle partitions."""
    return _parts(docs, docs.agg(F.sum(F.length(text).cast("long"))).first()[0], size or CHARS)


def _parts(docs: DataFrame, chars: int | None, size: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(chars or 0) // size))


def doc_total(docs: DataFrame) -> Column:
    """Number of documents as a scalar of the plan."""
    return docs.agg(F.count(F.lit(1))).scalar()


def tfidf(docs: DataFrame, doc: str, text: str, *, bigrams: bool = True, stopwords: Sequence[str] = tuple(STOPWORDS), heaviest: tuple[int, Sequence[str], float] | None = None) -> DataFrame:
    """(document, term, tf * idf); all rows of a document come out of one task, unless it has more text, in several rows, than a part.

    Texts are dealt once, as blank-joined tokens, to parts of about :data:`PART_CHARS` characters, which count terms as numbers (:mod:`tidemark.operators.termparts`). A part sends each of its
    different words once, with the number of its rows that have it, and gets back the sum over all parts and the word's number in the whole table; then each different pair of
    neighbouring words as two such numbers, and gets back their sum. Terms of documents never leave their part, and no task is larger in a larger table.
    Rows that share an id, or have none, and together are larger than a part are dealt by their texts, and the counts of their terms added up over the parts.

    With ``heaviest`` (k, boosted words, their factor) a part holds back terms that cannot be among the ``k`` heaviest of their document.
    """
    sizes = docs.groupBy(F.xxhash64(doc).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.length(text).cast("long")).alias("_chars"))
    large = F.when((F.col("_rows") > 1) & (F.col("_chars") > PART_CHARS), F.struct("_hash", "_chars"))
    rows, chars, large = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.sum("_chars"), F.collect_list(large)).first()
    parts = _parts(docs, chars, PART_CHARS)
    kind = docs.select(doc).schema[0].dataType
    key = [F.to_json(F.struct(doc)).alias("_key")] if isinstance(kind, (T.ArrayType, T.StructType)) else []
    several = F.xxhash64(doc).isin([x["_hash"] for x in large]) if large else F.lit(False)
    part = F.xxhash64(doc)
    if large:
        part = F.when(several, F.xxhash64(F.xxhash64(doc), F.pmod(F.xxhash64(text), F.lit(-(-max(x["_chars"] for x in large) // PART_CHARS))))).otherwise(part)
    texts = docs.select(F.pmod(part, F.lit(parts)).cast("int").alias("_part"), F.col(doc).alias("_doc"), F.array_join(tokens(F.col(text), stopwords), " ").alias("_text"), several.alias("_several"), *key)
    texts = texts.repartitionById(parts, "_part")
    by_word, by_pair = (-(-parts // n) for n in BUCKET_PARTS)

    def dealt(messages: DataFrame, to: str, among: int = parts) -> GroupedData:
        return messages.repartitionById(among, to).groupBy(to)

    asked = texts.groupBy("_part").applyInArrow(termparts.sender_of_words(by_word), termparts.SENT_WORDS)
    answers = dealt(asked, "_bucket", by_word).applyInArrow(termparts.numberer_of_words(by_word), termparts.NUMBERED_WORDS)
    if bigrams:
        asked = texts.groupBy("_part").cogroup(dealt(answers, "_part")).applyInArrow(termparts.sender_of_pairs(by_word, by_pair), termparts.SENT_PAIRS)
        added = dealt(asked, "_bucket", by_pair).applyInArrow(termparts.adder_of_pairs(), termparts.ADDED_PAIRS)
        answers = answers.unionByName(added, allowMissingColumns=True)
    schema = T.StructType().add("doc", kind).add("term", "string").add("n", "long").add("total", "long").add("df", "long")

    def weighed(several: bool, kept: termparts.Heaviest | None) -> DataFrame:
        return texts.groupBy("_part").cogroup(dealt(answers, "_part")).applyInArrow(termparts.weigher(by_word, by_pair, bigrams, several, kept), schema)

    found = weighed(False, heaviest and termparts.Heaviest(*heaviest, rows))
    if large:
        again = weighed(True, None).groupBy("doc", "term").agg(F.sum("n").alias("n"), F.first("total").alias("total"), F.first("df").alias("df"))
        found = found.unionByName(again)
    return found.select(F.col("doc").alias(doc), "term", (F.col("n") / F.col("total") * F.ln(F.lit(rows + 1) / (F.col("df") + 1))).alias("weight"))


def keywords(docs: DataFrame, doc: str, text: str, k: int = 10, *, boost: Sequence[str] = tuple(BOOST_TERMS), factor: float = 1.5,
             min_chars: int = 100, bigrams: bool = True) -> DataFrame:
    """The ``k`` heaviest terms per document; terms that contain a boosted word weigh more; short documents give none.

    All rows of a document lie in one task, which makes rows only of terms that can be among its first ``k`` and sends these only.
    """
    weights = tfidf(docs, doc, text, bigrams=bigrams, heaviest=(k, tuple(boost), factor))
    long_enough = docs.where(F.length(text) >= min_chars).select(doc)
    boosted = F.lit(False)
    for term in boost:
        boosted = boosted | F.col("term").contains(term)
    weights = weights.withColumn("weight", F.when(boosted, F.col("weight") * factor).otherwise(F.col("weight")))
    top = scale.top_per_key(weights, doc, [F.round("weight", 12).desc(), F.col("term")], k, rank="rank", salts=1)
    return top.join(long_enough, doc, "left_semi")


def keywords_count(docs: DataFrame, doc: str, text: str, k: int = 10, *, boost: Sequence[str] = tuple(BOOST_TERMS), min_chars: int = 50,
                   stopwords: Sequence[str] = tuple(STOPWORDS)) -> DataFrame:
    """Keywords by raw count: the k/2 best bigrams, then words that no chosen bigram contains.

    A document of one row is counted, ordered and answered inside that row; only rows that share an id, or have none, are unfolded and added up.
    """
    rows = docs.where(F.length(text) >= min_chars).transform(lambda d: spread(d, doc, text))
    rows = rows.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(doc)))
    stops = list(stopwords)
    good = F.transform(words(F.col(text)), lambda w: F.when((F.length(w) > 3) & ~w.isin(stops), w)).alias("_g")
    alone = (F.col("_copies") == 1) & F.col(doc).isNotNull()
    once, several = (rows.where(w).select(doc, good) for w in (alone, ~alone))
    return _keywords_in_row(once, doc, k=k, boost=boost).unionByName(_keywords_over_rows(several, doc, k=k, boost=boost))


def _pairs(good: str) -> Column:
    """Neighbouring words joined by a blank, where neither is null."""
    last = F.greatest(F.size(good) - 1, F.lit(0))
    return F.array_compact(F.zip_with(F.slice(good, F.lit(1), last), F.slice(good, F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b)))


def _first(base: DataFrame, array: str, k: Column) -> DataFrame:
    """``base`` with only the first ``k`` of an array of (less, term) by both, which is ascending by term: what has the ``k``-th value need not be sorted."""
    values = F.sort_array(F.transform(array, lambda x: x["less"]))
    marked = base.withColumn("_kth", F.get(values, F.least(F.size(array), k) - 1))
    chosen = F.concat(F.sort_array(F.filter(array, lambda x: x["less"] < F.col("_kth"))), F.filter(array, lambda x: x["less"] == F.col("_kth")))
    return marked.withColumn(array, F.slice(F.when(k > 0, chosen).otherwise(F.slice(array, 1, 0)), F.lit(1), F.greatest(k, F.lit(0)))).drop("_kth")


def _keywords_in_row(base: DataFrame, doc: str, *, k: int, boost: Sequence[str]) -> DataFrame:
    """Keywords of documents of one row, ``_g`` its words: a text's counts, order and choice never leave its row."""
    def weighed(array: str, inside: Callable[[Column, str], Column]) -> Column:
        def less(x: Column) -> Column:
            hit = F.lit(False)
            for term in boost:
                hit = hit | inside(x["term"], term)
            return F.struct((F.when(hit, -2 * x["n"]).otherwise(-x["n"])).alias("less"), x["term"].alias("term"))

        return F.transform(array, less).alias(array)

    counts = runs(base.select(doc, _pairs("_g").alias("_p"), F.array_compact("_g").alias("_s")), "_p", "_s")
    top = _first(counts.select(doc, weighed("_p", lambda t, b: t.contains(b)), weighed("_s", lambda t, b: t == b)), "_p", F.lit(k // 2))
    top = top.select(doc, "_p", "_s", F.concat_ws(" ", F.array_sort(F.transform("_p", lambda x: x["term"]))).alias("_in"), F.size("_p").alias("_have"))
    left = F.filter("_s", lambda x: (F.col("_have") == 0) | ~F.contains(F.col("_in"), x["term"]))
    out = _first(top.select(doc, "_p", "_have", left.alias("_s")), "_s", F.lit(k) - F.col("_have"))
    out = scale.unnest(out.select(doc, F.concat("_p", "_s").alias("_x")), [doc], "_x", "_t", position="_at")
    return out.select(doc, F.col("_t.term").alias("term"), (-F.col("_t.less")).alias("n"), (F.col("_at") + 1).cast("int").alias("rank"))


def _keywords_over_rows(base: DataFrame, doc: str, *, k: int, boost: Sequence[str]) -> DataFrame:
    """Keywords of documents of several rows, whose counts add up."""
    marked = F.concat(F.transform(_pairs("_g"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("kind"))),
                      F.transform(F.array_compact("_g"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("kind"))))
    counts = scale.unnest(base, [doc], marked, "_x")
    counts = counts.groupBy(doc, "_x.term", "_x.kind").agg(F.count(F.lit(1)).alias("n"))
    inside = F.lit(False)
    for term in boost:
        inside = inside | F.when(F.col("kind") == 0, F.col("term").contains(term)).otherwise(F.col("term") == term)
    counts = counts.withColumn("n", F.when(inside, F.col("n") * 2).otherwise(F.col("n")))
    top_pairs = scale.top_per_key(counts.where("kind = 0"), doc, [F.col("n").desc(), F.col("term")], k // 2, rank="rank", salts=1)
    chosen = top_pairs.groupBy(doc).agg(F.concat_ws(" ", F.array_sort(F.collect_list("term"))).alias("_in"), F.count(F.lit(1)).alias("_have"))
    words_left = counts.where("kind = 1").join(chosen, doc, "left").where(F.col("_in").isNull() | ~F.contains(F.col("_in"), F.col("term")))
    ranked = scale.top_per_key(words_left, doc, [F.col("n").desc(), F.col("term")], k, rank="_r", salts=1)
    fill = ranked.withColumn("rank", (F.col("_r") + F.coalesce("_have", F.lit(0))).cast("int")).where(F.col("rank") <= k)
    return top_pairs.select(doc, "term", "n", "rank").unionByName(fill.select(doc, "term", "n", "rank"))


def cosine_pairs(vectors: DataFrame, pairs: DataFrame, *, doc: str, left: str = "id_a", right: str = "id_b", parts: int | None = None) -> DataFrame:
    """Cosine similarity of given document pairs over long-form term weights, one row per document and term; 0 without shared terms.

    The weights of a document are packed into one row, after one shuffle for both sides; a pair is answered in its row, where shared terms lie side by side once both sides are
    sorted. The shuffles have ``parts`` tasks, else one for about :data:`PAIR_ROWS` weights, however large the table; the weights are then written to count them.
    All pairs of one ``right`` meet in one task, which holds a document at a time.
    """
    if parts is None:
        vectors = written(vectors, "vectors")
        parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PAIR_ROWS))
    packed = vectors.select(doc, "term", "weight").repartition(parts, doc).groupBy(doc).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"), F.collect_list(F.struct("term", "weight")).alias("_v"))
    a = packed.select(F.col(doc).alias(left), F.col("_norm").alias("_na"), F.col("_v").alias("_va"))
    b = packed.select(F.col(doc).alias(right), F.col("_norm").alias("_nb"), F.col("_v").alias("_vb"))
    asked = pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("_times"))
    met = asked.join(a, left).join(b, right).where((F.col("_na") > 0) & (F.col("_nb") > 0))
    met = met.select(left, right, (F.col("_times") / (F.col("_na") * F.col("_nb"))).alias("_scale"), F.sort_array(F.concat("_va", "_vb")).alias("_v"))
    rest = F.size("_v") - 1
    products = F.zip_with(F.slice("_v", F.lit(1), rest), F.slice("_v", F.lit(2), rest), lambda x, y: F.when(x["term"] == y["term"], x["weight"] * y["weight"]).otherwise(0.0))
    found = met.select(left, right, (F.aggregate(products, F.lit(0.0), lambda s, x: s + x) * F.col("_scale")).alias("_similarity"))
    return pairs.join(found, [left, right], "left").select(left, right, F.coalesce("_similarity", F.lit(0.0)).alias("similarity"))


def similar_docs(queries: DataFrame, docs: DataFrame, *, query: str, query_text: str, doc: str, text: str, k: int = 5, bigrams: bool = False) -> DataFrame:
    """The ``k`` most similar documents per query text by TF-IDF cosine (corpus statistics of ``docs``).

    The terms asked for are written with their weights, which Spark then knows to be small: products are summed where a document's terms are.
    Only the norms need the weight of every term; inverse frequencies are written once for both.
    """
    docs = spread(docs, doc, text)
    freqs = term_freq(docs, doc, text, bigrams=bigrams)
    total = doc_total(docs)
    table = written(idf(docs, doc, text, bigrams=bigrams).select("term", "idf"), "idf")
    weight = F.col("tf") * F.col("idf")
    norms = freqs.join(table, "term").groupBy(doc).agg(F.sqrt(F.sum(weight * weight)).alias("_nd"))
    asked = term_freq(queries, query, query_text, bigrams=bigrams).join(table, "term", "left")
    asked = written(asked.select(query, "term", (F.col("tf") * F.coalesce("idf", F.ln(total + 1))).alias("_wq"), "idf"), "asked")
    asked_norms = asked.groupBy(query).agg(F.sqrt(F.sum(F.col("_wq") * F.col("_wq"))).alias("_nq"))
    # A term that no document has meets none here.
    dots = freqs.join(asked.where(F.col("idf").isNotNull()), "term").groupBy(query, doc).agg(F.sum(weight * F.col("_wq")).alias("_dot"))
    scored = (dots.join(norms, doc).join(asked_norms, query).where((F.col("_nd") > 0) & (F.col("_nq") > 0))
              .select(query, doc, (F.col("_dot") / (F.col("_nd") * F.col("_nq"))).alias("similarity")))
    return scale.top_per_key(scored, query, [F.round("similarity", 9).desc(), F.col(doc)], k, rank="rank")


def word_freq(docs: DataFrame, text: str, k: int = 50, *, stopwords: Sequence[str] = tuple(STOPWORDS), min_len: int = 4) -> DataFrame:
    """Most frequent words of the corpus."""
    found = scale.unnest(docs, [], tokens(F.col(text), stopwords, min_len), "word")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(k)
