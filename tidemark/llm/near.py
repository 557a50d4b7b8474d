"""Near duplicates on word shingles: HyperMinHash registers, banding, exact confirmation, components."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.graph import components, put_back, set_aside, write_table
from tidemark.llm.textarrays import BLANK_SEPARATED, mix, runs, slices, word_hashes, words
from tidemark.session import scratch_dir

#: Registers per text, mantissa bits of each (the leading-zero count takes the other six of 16), registers per band and bands.
BUCKETS, MANTISSA, BAND, BANDS = 128, 10, 4, 24
EMPTY = 0xFFFF
#: Estimates more than this below the asked similarity are not confirmed: eight standard deviations of 128 registers at 0.85.
SLACK = 0.25
#: Shingles in a block of a cluster.
BLOCK = 100_000
SKETCH = "doc_id long, text_hash long, n_shingles long, class binary, registers binary"


def shingle_hashes(data: np.ndarray, borders: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's word k-grams, and how many each text has."""
    mapped, starts, ends, counts = words(data, borders, BLANK_SEPARATED)
    return runs(word_hashes(mapped, starts, ends), counts, k)


def registers(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """HyperMinHash, one row of 16-bit registers a text: the smallest hash of a bucket as its leading-zero count and the bits after its first one."""
    low = np.full(len(per) * BUCKETS, 1 << 53, np.uint64)
    text = np.repeat(np.arange(len(per)), per)
    np.minimum.at(low, text * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), hashes >> np.uint64(11))
    fraction, bits = np.frexp(low.astype(np.float64))
    zeros = 53 - bits
    out = (np.maximum(zeros, 0) << MANTISSA) + np.maximum((fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
    return np.where(zeros < 0, EMPTY, out).astype(np.uint16).reshape(len(per), BUCKETS)


@functools.lru_cache(maxsize=1)
def lenders() -> np.ndarray:
    """For each bucket, the rank of every bucket as its lender."""
    rng = np.random.default_rng(128)
    return np.stack([np.argsort(rng.permutation(BUCKETS)) for _ in range(BUCKETS)]).astype(np.uint8)


def filled(regs: np.ndarray) -> np.ndarray:
    """Empty buckets borrow from the first filled one in an order of their own, so that each register of two sets agrees as often as their elements do."""
    out = regs.copy()
    for at in range(0, len(regs), 64):
        part = regs[at : at + 64]
        full = part != EMPTY
        rank = np.where(full[:, None, :], lenders()[None], np.uint8(255))
        donor = rank.argmin(axis=2)
        out[at : at + 64] = np.where(full, part, np.take_along_axis(part, donor, axis=1))
    return out


@functools.lru_cache(maxsize=4096)
def collisions(n: int, m: int) -> float:
    """The share of registers that agree by chance between disjoint sets of about 2**(n/2) and 2**(m/2) elements: summed over all register values."""
    per = [2 ** (x / 2) / BUCKETS for x in (n, m)]
    edges = [0.0]
    for z in range(53, -1, -1):
        edges += list(2.0 ** -(z + 1) * (1 + np.arange(1, (1 << MANTISSA) + 1) / (1 << MANTISSA)))
    edges = np.array(edges)
    shares = [np.exp(-p * edges[:-1]) - np.exp(-p * edges[1:]) for p in per]
    either = 1 - np.exp(-per[0] - per[1])
    return float((shares[0] * shares[1]).sum() / either)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Similarity from registers, less what chance makes agree."""
    used = (a != EMPTY) | (b != EMPTY)
    if not used.any():
        return 0.0
    same = float(((a == b) & used).sum() / used.sum())
    chance = collisions(round(2 * np.log2(max(n, 1))), round(2 * np.log2(max(m, 1))))
    return max(0.0, (same - chance) / (1 - chance))


def sketch(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SKETCH per document. `class` is a digest of the shingle set; texts without words have neither class nor registers."""

    def rows(batches):
        for batch in batches:
            for a, b, data, borders in slices(batch, "text"):
                hashes, per = shingle_hashes(data, borders, k)
                regs = registers(hashes, per)
                sizes, classes = [], []
                at = 0
                for n in per.tolist():
                    own = np.sort(hashes[at : at + n])
                    at += n
                    if n > 1:
                        own = own[np.append(True, own[1:] != own[:-1])]
                    sizes.append(len(own))
                    classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                kept = [r.tobytes() if n else None for r, n in zip(regs, sizes)]
                ids = [batch.column(c).slice(a, b - a) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "class", "registers"])

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, SKETCH)


def banded(classes: DataFrame) -> DataFrame:
    """(class, key): one row per class and band of its filled registers."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = filled(regs)[:, : BAND * BANDS].copy().view(np.uint64)
            keys = mix(keys + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            names = [c for c in batch.column("class").to_pylist() for _ in range(BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(keys.ravel().view(np.int64))], names=["class", "key"])

    return classes.select("class", "registers").mapInArrow(rows, "class binary, key long")


def _linked(a: list[dict], b: list[dict], same: bool, percent: int) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between two blocks of members (class, registers, hashes): what connects them, not every pair.

    Registers leave out whom the estimate rules out; the others are confirmed on their full sets, counted over the second block's posting lists.
    """
    sets = [np.frombuffer(m["hashes"], np.uint64) for m in b]
    sizes = np.array([len(x) for x in sets])
    owners, hashes = np.repeat(np.arange(len(b)), sizes), np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    terms, first = np.unique(hashes[order], return_index=True)
    owners, last = owners[order], np.append(first[1:], len(hashes))
    regs = np.stack([np.frombuffer(m["registers"], np.uint16) for m in b])
    classes = np.round(2 * np.log2(sizes)).astype(int)
    label = np.arange(len(a) + len(b))  # members of a, then of b
    if same:
        label = np.append(np.arange(len(b)), np.arange(len(b)))
    out = []
    for i, m in enumerate(a):
        own, mine = np.frombuffer(m["registers"], np.uint16), np.frombuffer(m["hashes"], np.uint64)
        used = (regs != EMPTY) | (own != EMPTY)
        share = ((regs == own) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
        kind = round(2 * np.log2(len(mine)))
        kinds = np.unique(classes)
        chance = np.array([collisions(kind, int(c)) for c in kinds])[np.searchsorted(kinds, classes)]
        may = ((share - chance) / (1 - chance) >= percent / 100 - SLACK) & (100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine)))
        if same:
            may[: i + 1] = False
        if not may.any():
            continue
        at = np.minimum(np.searchsorted(terms, mine), len(terms) - 1)
        at = at[terms[at] == mine]
        many = last[at] - first[at]
        place = np.repeat(first[at] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
        both = np.bincount(owners[place], minlength=len(b))
        good = np.flatnonzero(may & (100 * both >= percent * (sizes + len(mine) - both)))
        for j in good[np.unique(label[len(a) + good], return_index=True)[1]]:  # one link into each component
            if label[i] != label[len(a) + j]:
                out.append((m["class"], b[j]["class"]))
                label[label == label[len(a) + j]] = label[i]
    return out


def _links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the members of a cluster, block against block."""

    def rows(batches):
        for batch in batches:
            for left, right, same in zip(*(c.to_pylist() for c in batch.columns)):
                found = _linked(left, right, same, percent)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    left = blocks.select("cluster", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"), F.col("members").alias("mine"))
    pairs = left.join(blocks.select("cluster", "block", "members"), ["cluster", "block"])
    # A row holds two blocks, so a batch has few of them.
    return pairs.select("mine", "members", (F.col("i") == F.col("block")).alias("same")).mapInArrow(rows, "a binary, b binary")


def grouped(spark: SparkSession, docs: DataFrame, percent: int = 85, k: int = 5, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The sketch of every document (doc_id, text_hash, n_shingles, class), and (class, component) for every class."""
    folder = scratch_dir(spark, "near")
    sketched = write_table(sketch(docs, k), f"{folder}/sketch")
    members = sketched.where("class is not null")
    # The representative is named by id and text, as many texts may share an id (or have none).
    one = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")]
    classes = write_table(members.groupBy("class").agg(*one).select("class", "one.doc_id", "one.text_hash", "n_shingles", "registers"), f"{folder}/classes")
    smallest = -(-100 // (100 - percent)) if percent < 100 else 1 << 60  # unequal sets need so large a union
    bands = banded(classes.where(F.col("n_shingles") >= smallest - 1))
    sizes = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("class").alias("first")).where("size > 1")
    meets = write_table(bands.join(sizes, "key").where(F.col("class") != F.col("first")).select(F.col("class").alias("a"), F.col("first").alias("b")).distinct(), f"{folder}/meets")
    clusters = write_table(components(meets, f"{folder}/clusters").select(F.col("node").alias("class"), F.col("component").alias("cluster")), f"{folder}/clustered")
    wanted = clusters.join(classes, "class")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (own == wanted["text_hash"])).select(wanted["class"], "cluster", "registers", "text")
    sets = write_table(_sets(texts, k).dropDuplicates(["class"]), f"{folder}/sets")
    total = sets.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("hashes")) / (8 * block)).cast("int").alias("blocks"))
    placed = sets.join(total, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int")).repartition("cluster", "block")
    blocks = write_table(placed.groupBy("cluster", "block", "blocks").agg(F.collect_list(F.struct("class", "registers", "hashes")).alias("members")), f"{folder}/blocks")
    links = write_table(_links(blocks, percent), f"{folder}/links")
    return sketched, components(links, f"{folder}/linked").select(F.col("node").alias("class"), "component")


def _lowest(sketched: DataFrame, linked: DataFrame) -> DataFrame:
    """(class, component, lowest doc_id and text_hash of the component)."""
    per_class = sketched.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("low"))
    named = per_class.join(linked, "class", "left").select("class", "low", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("lowest"))
    return named.join(least, "component").select("class", "component", F.col("lowest.doc_id").alias("lowest"), F.col("lowest.text_hash").alias("lowest_text"))


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, k: int = 5, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id it is linked with, over any number of links), kept.

    Documents are linked if their sets of word k-grams share at least `percent` per cent. 1. Equal sets form one class, which goes on as one row.
    2. Classes meet where a band of registers is equal; with 24 bands of 4 a pair at the threshold is missed once in fifty million. A bucket is a star
    around its first class, and the stars' components are the clusters in which links can lie. 3. A cluster's members are spread over blocks of at most
    about `block` shingles. Each two blocks of a cluster meet in one row: registers are compared all at once, whom the corrected estimate leaves is
    confirmed on full sets by counting posting lists, and only the links that join components are passed on, fewer than the blocks have members. So the
    work on a large cluster spreads over its pairs of blocks, and neither buckets nor clusters have a cap. 4. Components of the links.

    Nulls and texts without words: no shingles, linked with nothing. Fewer than k words: the whole sequence is one shingle. Rows with null doc_id
    get the smallest id of the others in their component. Repeated rows are one class. Other columns are not read. Empty table: no rows.
    """
    sketched, linked = grouped(spark, _plain(docs, doc_id, text), percent, k, block)
    out = sketched.select("doc_id", "n_shingles", "class").join(_lowest(sketched, linked), "class", "left")
    component = F.coalesce("lowest", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(component.isNull())).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, percent: int = 85, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group of near duplicates: the smallest doc_id, then the smallest text hash.

    Of rows that agree in both, one stays. Texts without words are in no group, and all of them stay. Other columns may have any names. Empty table: no rows.
    """
    sketched, linked = grouped(spark, _plain(docs, doc_id, text), percent, k)
    keepers = _lowest(sketched, linked).select(F.col("lowest").alias("keep_id"), F.col("lowest_text").alias("keep_hash"), F.lit(True).alias("one")).distinct()
    loose = sketched.where("class is null").select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"), F.lit(False).alias("one")).distinct()
    keyed = set_aside(docs, doc_id, text).withColumn("hash", F.xxhash64(F.coalesce("body", F.lit(""))))
    kept = keyed.join(keepers.unionByName(loose), F.col("id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col("hash") == F.col("keep_hash")))
    # Only rows that repeat an id and a text could stay twice; where there are none, nothing needs to be told apart.
    if not sketched.where("class is not null").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        again = kept.withColumn("n", F.when(F.col("one"), F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.lit(1)))).otherwise(1))
        kept = again.where("n = 1")
    return put_back(kept, docs.columns, doc_id, text)


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """The rows with their sorted shingle hashes instead of the text; rows of another class (texts of one id with equal hashes) are left out."""

    def check(batches):
        for batch in batches:
            keep, sets = np.zeros(batch.num_rows, bool), []
            names = batch.column("class").to_pylist()
            for a, b, data, borders in slices(batch, "text"):
                hashes, per = shingle_hashes(data, borders, k)
                at = 0
                for i, n in enumerate(per.tolist()):
                    own = np.unique(hashes[at : at + n]).tobytes()
                    keep[a + i] = hashlib.blake2b(own, digest_size=16).digest() == names[a + i]
                    sets.append(own)
                    at += n
            columns = [batch.column(c) for c in ("class", "cluster", "registers")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=["class", "cluster", "registers", "hashes"]).filter(pa.array(keep))

    return rows.mapInArrow(check, "class binary, cluster binary, registers binary, hashes binary")
