"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, hardneg, idfiles, langid, near, packing, passages, quality, repeats, secret_scan, toxicity, whitening
from tidemark.llm.tokens import vocabulary
from tidemark.session import scratch_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"), 1, keep_ids=False)


@query
def op5_token_ids(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_dir(spark, "token-ids")
    idfiles.write_ids(table(spark, d, "documents"), path, vocabulary("byte_bpe_50k.json"), 0)
    return idfiles.read_ids(spark, path)


@query
def op6_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicates(spark, table(spark, d, "documents"))


ORACLE["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS seen FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.seen = u.a),
c AS (SELECT doc_id, min(seen) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query
def op9_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.matches(spark, table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE["op9_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM b),
ks AS (SELECT DISTINCT k FROM bw),
pl AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM pl) JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op1_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < secret_scan.STRONG)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.assess(spark, table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op10_chat_windows(spark: SparkSession, d: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.windows(turns, budget=1024, history=128))
    whole = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select("conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@query
def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.predict(docs.select("doc_id", "text", langid.in_fold("doc_id").alias("held_out")), langid.learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.learn(docs, table(spark, d, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text", langid.in_fold("doc_id").alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ORACLE["op10_chat_windows"] = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS n FROM c),
z AS (SELECT *, len(regexp_extract_all(x, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) + 3 AS size,
      6 + length(r) + 2 * length(x) - length(replace(replace(x, '\', ''), '<', '')) + 9 AS chars FROM t),
b AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) - size AS before FROM z),
s AS (SELECT *, before // 448 AS span, n = 1 AND r = 'system' AS sys FROM b),
f AS (SELECT conv_id, span, lead(min(before)) OVER (PARTITION BY conv_id ORDER BY span) AS follower FROM s GROUP BY conv_id, span),
k AS (SELECT conv_id, count(*) FILTER (span > 0) AS later FROM f GROUP BY 1),
g AS (SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY n)) AS turns_sha256, coalesce(string_agg(x, '' ORDER BY n) FILTER (r = 'assistant'), '') AS loss,
      sum(chars + CASE WHEN NOT sys AND follower - before <= 128 THEN chars ELSE 0 END) AS own, coalesce(sum(chars) FILTER (sys), 0) AS sys_chars
      FROM s JOIN f ON f.conv_id = s.conv_id AND f.span = s.span GROUP BY 1)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (own + sys_chars * later)::BIGINT AS formatted_chars FROM g JOIN k USING (conv_id)
"""


@query
def op4_repeats(spark: SparkSession, d: str) -> DataFrame:
    found = repeats.repeated_spans(spark, table(spark, d, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"), (removed > 0).alias("repeats"))


@query
def op13_passages(spark: SparkSession, d: str) -> DataFrame:
    found = passages.repeated_passages(spark, table(spark, d, "documents"), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


@query
def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, d, "embeddings").withColumn("label", moved)
    return hardneg.hard_negatives(spark, rows, F.col("vec_id") % 100 == 0, scale=256, positives=5, negatives=10, low=30, high=90)


ORACLE["op11_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT *, row_number() OVER () AS n FROM v),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM r a JOIN r b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
p AS (SELECT n, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, id) AS j FROM s WHERE same QUALIFY j <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.n, j ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.n = p.n AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda c: F.floor(c.cast("double") * 64) + 1000000))
    rows = rows.where(whitening.finite("embedding"))
    found = whitening.whiten(spark, rows.select("vec_id", "x"), vec_id="vec_id", vec="x", components=32)
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")
