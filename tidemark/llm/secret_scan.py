"""Secrets in whole texts: strong patterns, and weak parts of credentials that count only next to their counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.graph import put_back, set_aside

#: Kind, part of a credential it is, pattern (leftmost, non-overlapping), group whose length counts, least length. The first three are reported always.
KINDS = [
    ("assign", "secret", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32),
    ("identifier", "access", r"""(?<![A-Za-z0-9])(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|account[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    ("endpoint", "endpoint", r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9])(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{4,}""", 0, 4),
]
STRONG = 3
#: Code points between parts of one credential, from the end of one to the start of the other.
SCOPE = 300


def _found(number: int, text: Column) -> Column:
    """array<struct<kind, i, gap, size, good>>: matches in order, each with the length of the text since the match before."""
    _, _, pattern, group, least = KINDS[number]
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = (lambda m: F.length(F.regexp_extract(m, pattern, group))) if group else F.length
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matched.alias("hit"))
    rows = F.transform(F.slice(both, 1, F.size(matched)), lambda x, i: F.struct(
        F.lit(number).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"), (counted(x["hit"]) >= least).alias("good")))
    nothing = F.array().cast("array<struct<kind:int,i:int,gap:bigint,size:bigint,good:boolean>>")
    return F.when(F.col("text").rlike(pattern), rows).otherwise(nothing)


def spans(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, kind, name, start, end, uncovered): spans to report, in code points, end exclusive.

    Base kinds are reported wherever they match. Weak parts (an identifier, an opaque string, an endpoint) are reported only if they overlap no base span
    and their counterparts stand at most `scope` code points before or after them: an identifier needs a secret, an opaque string an access identifier, an
    endpoint both. A counterpart must not overlap the part itself, nor an endpoint's two counterparts each other. That interval join is a range frame over
    the starts and ends of a text's parts in order, so no pairs arise. `uncovered` is where text not covered by earlier spans begins.

    One shuffle, of the parts alone: rows with the same doc_id and text are one (they have the same spans), rows that share only the doc_id are told
    apart by text_hash. Null and empty texts have no spans. Other columns are not read. Matching and positions are Spark's own functions throughout.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with_base = plain.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *[_found(k, F.col("text")).alias(KINDS[k][0]) for k in range(STRONG)])
    has_access = (F.size("access") > 0) | F.col("text").rlike(KINDS[STRONG][2])
    weak = F.concat(*[_found(k, F.col("text")) for k in range(STRONG, len(KINDS))])
    parts = with_base.select("doc_id", "text_hash", F.concat("assign", "access", "hex", F.when(has_access, weak).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,size:bigint,good:boolean>>"))).alias("parts"))
    parts = parts.where(F.size("parts") > 0).repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash"])
    rows = parts.select("doc_id", "text_hash", F.inline("parts"))

    whole = Window.partitionBy("doc_id", "text_hash")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i"))).withColumn("start", F.col("end") - F.col("size")).where("good")
    strong = F.col("kind") < STRONG
    rows = rows.withColumn("strong_end", F.max(F.when(strong, F.col("end"))).over(whole.orderBy("start")))
    rows = rows.withColumn("strong_start", F.min(F.when(strong, F.col("start"))).over(whole.orderBy(F.desc("start"))))
    clear = (F.coalesce("strong_end", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("strong_start") >= F.col("end"), F.lit(True)))
    rows = rows.where(strong | clear)
    part = F.element_at(F.array(*[F.lit(k[1]) for k in KINDS]), F.col("kind") + 1)
    # A part's start sees the ends up to `scope` before it, its end the starts up to `scope` behind it. Two sets of intervals hold a pair that doesn't overlap
    # if the last start of one is not before the first end of the other.
    sides = rows.select("*", F.explode(F.array(F.col("start"), F.col("end"))).alias("at")).withColumn("opens", F.col("at") == F.col("start"))
    ends = [f(F.when((part == p) & (F.col("opens") == opens), F.col(c))).over(whole.orderBy("at").rangeBetween(*frame)) for opens, frame in ((False, (-scope, 0)), (True, (0, scope))) for p in ("secret", "access") for f, c in ((F.max, "start"), (F.min, "end"))]
    sides = sides.withColumns({c: F.when(F.col("opens"), before).otherwise(behind) for c, before, behind in zip(("secret_start", "secret_end", "access_start", "access_end"), ends[:4], ends[4:])})
    rows = sides.groupBy("doc_id", "text_hash", "kind", "start", "end").agg(F.max("secret_start").alias("secret_start"), F.min("secret_end").alias("secret_end"), F.max("access_start").alias("access_start"), F.min("access_end").alias("access_end"))
    apart = (F.col("secret_start") >= F.col("access_end")) | (F.col("access_start") >= F.col("secret_end"))
    linked = F.when(part == "access", F.col("secret_start").isNotNull()).when(part == "secret", F.col("access_start").isNotNull()).otherwise(F.coalesce(apart, F.lit(False)))
    rows = rows.where(strong | linked)
    before = whole.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    return rows.select("doc_id", "text_hash", "kind", name.alias("name"), "start", "end", F.coalesce(F.max("end").over(before), F.lit(0)).alias("uncovered"))


def scan(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and `spans`, its reported spans (start, kind, name, end, uncovered) by start, then kind; empty if there are none, as in null and empty texts.

    Every row of the table has its row, repeated ones too; whole texts are searched, however long. Empty table: no rows.
    """
    found = spans(docs, scope, doc_id, text).groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"))
    found = found.agg(F.sort_array(F.collect_list(F.struct("start", "kind", "name", "end", "uncovered"))).alias("spans"))
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    joined = keys.join(found, keys["doc_id"].eqNullSafe(found["found_id"]) & (F.col("text_hash") == F.col("found_hash")), "left")
    return joined.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,name:string,end:bigint,uncovered:bigint>>")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns and rows, with every reported span of the text replaced by `mark`; texts without spans (and nulls) stay as they are.

    Other columns may have any names. Long texts are masked whole. Empty table: no rows.
    """
    found = spans(docs, scope, doc_id, text).groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"))
    found = found.agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "uncovered"))).alias("found"))
    own = F.col("body")
    pieces = F.transform("found", lambda s: F.when(s["start"] >= s["uncovered"], F.concat(F.substring(own, s["uncovered"] + 1, s["start"] - s["uncovered"]), F.lit(mark))).otherwise(F.lit("")))
    tail = F.substring(own, F.array_max(F.transform("found", lambda s: s["end"])) + 1, F.length(own))
    joined = set_aside(docs, doc_id, text).join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.xxhash64(F.coalesce("body", F.lit(""))) == F.col("found_hash")), "left")
    masked = F.when(F.col("found").isNull(), own).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return put_back(joined, docs.columns, doc_id, text, {text: masked})
