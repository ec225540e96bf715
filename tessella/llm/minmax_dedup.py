"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Under each of PERMUTATIONS hash functions both the least and the
greatest value over the set are kept: each agrees between two sets with a probability equal to their Jaccard similarity,
so one evaluation gives two signature values. The 2 * PERMUTATIONS values are cut into bands of ROWS values from different
permutations; sets that agree in a band become candidates (a pair at similarity 0.8 is missed once in twenty million).

Candidates don't expand into all pairs of a bucket:
1. Equal sets form one class, with the smallest doc_id as its representative; only representatives go on.
2. In every bucket each member meets the bucket's smallest and largest member. These pairs are confirmed on full sets.
3. Confirmed links give components. Buckets whose members now lie in one component are done: more links would change
   nothing. The members of the others are joined exactly: in one order by rarity, two similar sets share one of their
   first shingles, and enough of what follows it. Pairs across components that share such a shingle, with sizes and places
   that allow the similarity, are confirmed as well, so no link is lost. Copies edited in different places have their
   edits first, so they don't all meet.
Confirming reads full sets, made once from the whole texts of all members of buckets; the partners of a crowded end are
dealt to several parts. No bucket, class or component is gathered in one task.

Defined cases: a null or blank text has an empty set, is linked with nothing and stands for itself. Fewer words than a
shingle has make one shingle. Rows with a null doc_id are left out. Rows that share a doc_id are one document, of the
smallest of their texts that isn't null; each row comes back with its result. Ties go to the smaller doc_id. An empty table gives an empty result.
Shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import few, parted, whole, written
from .components import components

PERMUTATIONS, ROWS = 64, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z are lower-cased, words end at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    key = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        key = key * _MIX + h[i : len(h) - width + 1 + i]
    return np.unique(_mixed(key))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(4)
    return r.integers(1, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, PERMUTATIONS, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key a band, over the least and the greatest values."""
    a, b = _permutations()
    least, most = np.full(PERMUTATIONS, np.uint64(2**64 - 1)), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * a + b
        least, most = np.minimum(least, values.min(axis=0)), np.maximum(most, values.max(axis=0))
    bands = np.concatenate([least, most]).reshape(-1, ROWS)
    key = np.arange(len(bands), dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * _MIX + bands[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_shingles, set_a and set_b (a 128-bit hash of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, bands = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text.as_py(), words)
                whole = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                first.append(int.from_bytes(whole[:8], "little", signed=True))
                second.append(int.from_bytes(whole[8:], "little", signed=True))
                bands.append(band_keys(s) if len(s) else [])
            made = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id, shingles: the sorted shingle set of each document asked for, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(text.as_py(), words).tobytes() for text in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], sets], ["id", "shingles"])

    return docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id").mapInArrow(run, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. pairs: a, b and centre, the one of both that may have
    very many partners.

    The n partners of a centre are dealt to about sqrt(n) / 4 parts. Each part begins with the centre's set, which is
    copied no oftener than that, and streams its partners' sets past it, so no pair carries two sets and no part is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for centre, i, shingles in zip(batch["centre"].to_pylist(), batch["id"].to_pylist(), batch["shingles"], strict=True):
                s = np.frombuffer(shingles.as_buffer(), np.uint64)
                if i == centre:
                    own = s.copy()
                    continue
                both = len(np.intersect1d(s, own, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(own) - both):
                    a.append(max(i, centre))
                    b.append(min(i, centre))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = F.ceil(F.sqrt(F.count("*")) / 4).cast("int")
    centres = written(pairs.groupBy("centre").agg(parts.alias("parts")), "minmax-centres")
    member = F.when(F.col("centre") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    members = pairs.select("centre", member.alias("id")).join(few(centres.filter("parts > 1")), "centre", "left").select("centre", part.alias("part"), F.lit(1).alias("turn"), "id")
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    first = centres.select("centre", copies, F.lit(0).alias("turn"), F.col("centre").alias("id"))
    met = first.unionByName(members).join(sets, "id").repartition("centre", "part").sortWithinPartitions("centre", "part", "turn")
    return met.select("centre", "id", "shingles").mapInArrow(run, "a long, b long")


def prefixes(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """id, n, token, pos: of each document the rarest shingles, in one order for all, that can't all be missing from a
    similar document; pos counts from 1. Shingles that no other of these documents has are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shingles in zip(batch["id"].to_pylist(), batch["shingles"], strict=True):
                s = np.frombuffer(shingles.as_buffer(), np.int64)
                for at in range(0, len(s), 10_000):
                    part = s[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(part)], ["id", "token"])

    each = sets.join(ids, "id").select("id", "shingles").mapInArrow(run, "id long, token long")
    counts = written(each.groupBy("token").agg(F.count("*").alias("df")), "minmax-counts")
    ordered = each.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    sized = ordered.withColumn("n", F.size("s").cast("long"))
    first = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    return sized.select("id", "n", F.posexplode(first).alias("p", "t")).filter("t.df > 1").select("id", "n", F.col("t.token").alias("token"), (F.col("p") + 1).alias("pos"))


def _open(members: DataFrame) -> DataFrame:
    """The members of keys that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    return members.join(keys, "key")


def _near_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row per row of docs."""
    one_set = ["set_a", "set_b", "n_shingles"]
    rows = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    given = written(signatures(rows, words), "minmax-signatures")
    again = written(given.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "minmax-again")
    once = written(rows.join(few(again), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "minmax-once")
    docs = rows.join(few(again), "doc_id", "left_anti").unionByName(once)
    signed = given.join(few(again), "doc_id", "left_anti").unionByName(written(signatures(once, words), "minmax-signatures"))
    full = signed.filter("n_shingles > 0")
    classes = written(full.groupBy(*one_set).agg(F.min("doc_id").alias("rep")), "minmax-classes")
    chosen = full.join(classes, one_set).filter("doc_id = rep")

    banded = chosen.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    ends = banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.max(F.struct("id", "n")).alias("high")).filter("low.id <> high.id")
    members = written(banded.join(ends, "key"), "minmax-members")
    stars = members.select("id", "n", F.explode(F.array("low", "high")).alias("end")).filter("id <> end.id").filter(_near_size("n", "end.n", percent))
    met = stars.groupBy(F.greatest("id", "end.id").alias("a"), F.least("id", "end.id").alias("b")).agg(F.max("end.id").alias("centre"))
    met = written(met, "minmax-pairs")
    # what can be asked for below are members of buckets: their sets are made once
    sets = written(shingle_sets(docs, few(written(members.select("id").distinct(), "minmax-asked")), words), "minmax-sets")
    links = written(confirmed(met, sets, percent), "minmax-links")
    found = written(components(links), "minmax-components")

    own = members.select("key", "id", "n").join(found, members["id"] == found["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    rest = written(_open(own).select("id", "c").distinct(), "minmax-open")
    listed = _open(prefixes(rest.select("id"), sets, percent).join(rest, "id").withColumnRenamed("token", "key"))
    # from its place on, a document must have enough in common with even the smallest one listed under the shingle
    listed = written(listed, "minmax-listed")
    left = F.col("n") - F.col("pos") + 1
    least = listed.groupBy("key").agg(F.min("n").alias("least"))
    listed = listed.join(least, "key").filter((100 + percent) * left >= percent * (F.col("n") + F.col("least")))
    listed = written(_open(listed.select("key", "id", "n", "c", left.alias("left"))), "minmax-listed")
    x, y = (listed.select("key", *(F.col(c).alias(f"{c}{s}") for c in ("id", "n", "c", "left"))) for s in "xy")
    enough = (100 + percent) * F.least("leftx", "lefty") >= percent * (F.col("nx") + F.col("ny"))
    across = x.join(y, "key").filter("idx > idy AND cx <> cy").filter(_near_size("nx", "ny", percent) & enough)
    across = across.select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    across = written(across.withColumn("centre", F.col("b")), "minmax-pairs")
    more = written(confirmed(across, sets, percent), "minmax-links")
    if more.limit(1).count():
        found = written(components(links.unionByName(more)), "minmax-components")

    labelled = classes.join(found, classes["rep"] == found["node"], "left").select(*one_set, F.coalesce("component", "rep").alias("component_id"))
    out = signed.drop("bands").join(labelled, one_set, "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    each = given.select("doc_id").join(few(again), "doc_id").join(written(out.join(few(again), "doc_id"), "minmax-repeated"), "doc_id")
    return out.join(few(again), "doc_id", "left_anti").unionByName(each)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are near a smaller doc_id; the columns of docs. Of rows that share a doc_id the first by
    text stays; rows without one all stay."""
    gone = group(docs, words, percent).filter("NOT kept").select("doc_id").distinct()
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id IS NOT NULL AND n > 1").select("doc_id")
    again = few(written(again, "minmax-again"))
    left = whole(docs, "doc_id", "text").join(gone, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.xxhash64("_doc"))
    once = left.join(again, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return parted(left.join(again, "doc_id", "left_anti").unionByName(once), docs)
