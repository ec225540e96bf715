"""The trie of conversation prefixes, built as a z-fast trie.

A conversation is its sequence of turns (role, text). A prefix is known by a 128-bit hash, the running exclusive-or of hashes
of (place, turn), so prefixes of all lengths come from one pass; equal conversations are one string from there on.

The trie is compacted: a node stands for the edge (up, extent] that ends where strings branch or end. It is found by the hash
of its handle, the prefix whose length is the two-fattest number in (up, extent]: the one with the most trailing zeros in
binary. Every prefix length of the trie belongs to one string that runs through it first, its owner: string s owns the
lengths from `begin` on, and below that it has branched off another's.

Strings are inserted in three batches of growing size (BATCHES). For each string of a batch:

1. its exit node is found by fat binary search: the two-fattest length of an interval is looked up among the handles; a hit
   moves the lower end to that node's extent, a miss the upper end below that length. The node of which the string's next
   turn is the name, if there is one, is the exit node, and a binary search on that edge alone gives the length they share;
2. what goes on from there is new: new prefixes are grouped over the batch, their least string owns them;
3. the string's end, and the length where its own part branches off, become nodes; edges are cut there and get new handles.

All strings of a batch take one step together, so a search is a few joins, whose number grows with the logarithm of the longest
conversation. At last every node's members are counted, and edges are expanded into one row a length.

No step holds a conversation, a node's members or an edge in one row or task: turns are numbered by a range sort, running
hashes and neighbours on an edge are taken in chunks of CHUNK lengths, members meet their nodes by joins that Spark can
split, and the ids under a digest are joined in chunks before the one task that must read them in order.

Defined cases: null roles and texts are empty; turns are ordered by (turn, role, text), null turns first, and repeated rows are
turns of their own. Rows with a null conv_id are left out. Conversations without turns (after rebuilding) are members of the
root. Without conversations there is no row. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_GAP, written

#: Of 64 parts by a hash, those below the first number are the first batch, and so on.
BATCHES = (1, 8, 64)
CHUNK = 1024
IDS = 4096
#: Bytes of a text that take part in the ranges of the sort; ties are sorted inside a range.
RANGE_CHARS = 64
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, place (from 1), n (turns), a and b (a turn's hashes), w (its words)."""
    text = F.coalesce("text", F.lit(""))
    given = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role"]
    placed = given.repartitionByRange(*order, F.left("text", F.lit(RANGE_CHARS))).sortWithinPartitions(*order, "text")
    hashes = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b")]
    turns = written(placed.select("conv", *hashes, _words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("at")), "trie-turns")
    turns = turns.withColumn("part", F.shiftright("at", 33))
    parts = turns.groupBy("conv", "part").agg(F.min("at").alias("least"), F.count("*").alias("n_part"))
    own = Window.partitionBy("conv")
    before = F.coalesce(F.sum("n_part").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("conv", "part", "least", before.alias("before"), F.sum("n_part").over(own).alias("n"))
    return turns.join(parts, ["conv", "part"]).select("conv", (F.col("at") - F.col("least") + F.col("before") + 1).alias("place"), "n", "a", "b", "w")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `head` turns (most, at most) come from another one, `base`; both are expressions of conv.
    Rows (conv, d, a, b, w), and (conv, len) of every conversation."""
    convs = turns.filter("place = 1").select("conv", "n", base.alias("base"), head.cast("long").alias("head"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(sizes, "base", "left").select("conv", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("len"))
    convs = written(convs, "trie-conversations")
    firsts = turns.filter(F.col("place") <= most).select(F.col("conv").alias("base"), F.col("place").alias("d"), "a", "b", "w")
    heads = convs.select("conv", "base", "taken").join(firsts, "base").filter("d <= taken").select("conv", "d", "a", "b", "w")
    tails = turns.join(convs.select("conv", "head", "taken"), "conv").filter("place > head").select("conv", (F.col("taken") + F.col("place") - F.col("head")).alias("d"), "a", "b", "w")
    return heads.unionByName(tails), convs.select("conv", "len")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, d, a, b (hashes of the first d turns), before (words of the turns before the dth), upto (and with it)."""
    terms = rows.select("conv", "d", F.xxhash64("d", "a", "b").alias("a"), F.xxhash64(F.lit(3), "d", "b", "a").alias("b"), "w").withColumn("chunk", F.floor(F.col("d") / CHUNK))
    inside, earlier = Window.partitionBy("conv", "chunk").orderBy("d"), Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"a": F.bit_xor, "b": F.bit_xor, "w": F.sum}
    running = terms.select("conv", "chunk", "d", F.col("w").alias("own"), *(f(c).over(inside).alias(c) for c, f in sums.items()))
    tops = terms.groupBy("conv", "chunk").agg(*(f(c).alias(c) for c, f in sums.items()))
    tops = tops.select("conv", "chunk", *(f(c).over(earlier).alias(f"{c}0") for c, f in sums.items())).filter("chunk > 0")
    met = running.join(tops, ["conv", "chunk"], "left")
    whole = {c: F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))) for c in "ab"}
    upto = F.col("w") + F.coalesce("w0", F.lit(0))
    return met.select("conv", "d", whole["a"].alias("a"), whole["b"].alias("b"), (upto - F.col("own")).alias("before"), upto.alias("upto"))


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with the most trailing zeros in binary."""
    zeros = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, zeros), zeros)


def _at(paths: DataFrame, name: str = "s", d: str = "d", to: str = "") -> DataFrame:
    """The prefixes' hashes under other names, for joins."""
    return paths.select(F.col("s").alias(name), F.col("d").alias(d), F.col("a").alias(f"a{to}"), F.col("b").alias(f"b{to}"))


def _rounds(state: DataFrame, step, label: str) -> DataFrame:
    """Steps until no row has low < high; each step's rows are a table."""
    state = written(state, label)
    done = [state.filter("low >= high")]
    while not (going := state.filter("low < high")).isEmpty():
        state = written(step(going), label)
        done.append(state.filter("low >= high"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def locate(strings: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """s, len, owner, shared: how much of each string is in the trie, and who owns that length (null at the root)."""
    none = F.lit(None).cast("long")
    handles = nodes.select(F.col("handle").alias("f"), F.col("handle_a").alias("a"), F.col("handle_b").alias("b"), F.col("owner").alias("hit"), F.col("extent").alias("hit_extent"))

    def halve(now: DataFrame) -> DataFrame:
        asked = now.withColumn("f", fattest(F.col("low"), F.col("high"))).join(_at(paths, d="f"), ["s", "f"]).join(handles, ["f", "a", "b"], "left")
        found = F.col("hit").isNotNull()
        return asked.select(
            "s",
            "len",
            F.when(found, F.col("hit_extent")).otherwise(F.col("low")).alias("low"),
            F.when(found, F.col("high")).otherwise(F.col("f") - 1).alias("high"),
            F.coalesce("hit", "owner").alias("owner"),
            F.coalesce("hit_extent", "extent").alias("extent"),
            F.when(found, F.col("f")).otherwise(F.col("handle")).alias("handle"),
        )

    zero = F.lit(0).cast("long")
    found = _rounds(strings.select("s", "len", zero.alias("low"), F.col("len").alias("high"), none.alias("owner"), zero.alias("extent"), zero.alias("handle")), halve, "trie-search")
    # whether the found node's extent is a prefix; if so, the exit node is the child by whose name the string goes on
    extents = nodes.select("owner", "extent", F.col("extent_a").alias("ea"), F.col("extent_b").alias("eb"))
    met = found.drop("low", "high").join(_at(paths, d="extent"), ["s", "extent"], "left").join(extents, ["owner", "extent"], "left")
    met = met.withColumn("whole", F.col("owner").isNull() | F.coalesce((F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), F.lit(False))).drop("a", "b", "ea", "eb")
    names = nodes.select(F.col("up").alias("extent"), F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.col("owner").alias("child"), F.col("extent").alias("child_extent"))
    met = met.withColumn("next", F.when(F.col("whole"), F.col("extent") + 1)).join(_at(paths, d="next"), ["s", "next"], "left").join(names, ["extent", "a", "b"], "left")
    child = F.col("child").isNotNull()
    low = F.when(child, F.col("extent") + 1).when(F.col("whole"), F.col("extent")).otherwise(F.col("handle"))
    high = F.when(child, F.least("child_extent", "len")).when(F.col("whole"), F.col("extent")).otherwise(F.least("extent", "len"))

    def compare(now: DataFrame) -> DataFrame:
        asked = now.withColumn("mid", F.floor((F.col("low") + F.col("high") + 1) / 2))
        both = asked.join(_at(paths, d="mid"), ["s", "mid"]).join(_at(paths, "owner", "mid", "_o"), ["owner", "mid"])
        same = (F.col("a") == F.col("a_o")) & (F.col("b") == F.col("b_o"))
        return both.select("s", "len", "owner", F.when(same, F.col("mid")).otherwise(F.col("low")).alias("low"), F.when(same, F.col("high")).otherwise(F.col("mid") - 1).alias("high"))

    edge = met.select("s", "len", F.coalesce("child", "owner").alias("owner"), low.alias("low"), high.alias("high"))
    return _rounds(edge, compare, "trie-edge").select("s", "len", "owner", F.col("low").alias("shared"))


def previous(points: DataFrame, key: str, at: str, name: str) -> DataFrame:
    """points with the next smaller `at` of the same key, null for the first."""
    chunked = points.withColumn("_chunk", F.floor(F.col(at) / CHUNK))
    near = F.lag(at).over(Window.partitionBy(key, "_chunk").orderBy(at))
    tops = chunked.groupBy(key, "_chunk").agg(F.max(at).alias("_top"))
    tops = tops.select(key, "_chunk", F.lag("_top").over(Window.partitionBy(key).orderBy("_chunk")).alias("_top")).filter("_top IS NOT NULL")
    return chunked.withColumn("_near", near).join(tops, [key, "_chunk"], "left").select(*points.columns, F.coalesce("_near", "_top").alias(name))


def compacted(points: DataFrame, owners: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes from the points (owner, extent) where edges end: up, handle, and the hashes at the extent, handle, name and up."""
    cut = previous(points.join(owners.select("owner", "begin"), "owner"), "owner", "extent", "up")
    edges = cut.select("owner", "extent", F.coalesce("up", F.col("begin") - 1).alias("up")).withColumn("handle", fattest(F.col("up"), F.col("extent")))
    wanted = {"extent": F.col("extent"), "handle": F.col("handle"), "name": F.col("up") + 1, "up": F.col("up")}
    asked = edges.withColumn("d", F.explode(F.array_distinct(F.array(*wanted.values())))).join(_at(paths, "owner"), ["owner", "d"], "left")
    got = [F.max(F.when(F.col("d") == at, F.col(c))).alias(f"{n}_{c}") for n, at in wanted.items() for c in "ab"]
    return asked.groupBy("owner", "extent", "up", "handle").agg(*got)


def insert(batch: DataFrame, nodes: DataFrame | None, owners: DataFrame | None, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and owners with the batch's strings (s, len). owners: owner, len, begin, before (words before its own part), and
    branch, branch_a, branch_b (the prefix it branches off at)."""
    if nodes is None:
        exits = batch.select("s", "len", F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("shared"))
    else:
        exits = written(locate(batch, nodes, paths), "trie-exits")
    fresh = paths.join(exits.select("s", "shared"), "s").filter("d > shared")
    groups = written(fresh.groupBy("d", "a", "b").agg(F.min("s").alias("owner")), "trie-groups")
    begins = groups.groupBy(F.col("owner").alias("s")).agg(F.min("d").alias("begin"))
    got = exits.join(begins, "s", "left").withColumnRenamed("owner", "of")
    got = written(got, "trie-begins")
    # the ends of strings and the places where owners branch off: those in the old trie have their owner from there
    ends = got.select("s", "shared", "of", F.col("len").alias("d"))
    branches = got.filter("begin > 1").select("s", "shared", "of", (F.col("begin") - 1).alias("d"))
    points = ends.unionByName(branches).join(_at(paths), ["s", "d"]).groupBy("d", "a", "b").agg(F.max(F.when(F.col("d") <= F.col("shared"), F.col("of"))).alias("of"))
    points = points.join(groups, ["d", "a", "b"], "left").select(F.coalesce("of", "owner").alias("owner"), F.col("d").alias("extent"))
    at = lambda d, to: paths.select("s", F.col("d").alias(d), F.col("a").alias(f"{to}_a"), F.col("b").alias(f"{to}_b"), F.col("before").alias(f"{to}_before"))
    grown = got.filter("begin IS NOT NULL").withColumn("branch", F.col("begin") - 1).join(at("branch", "branch"), ["s", "branch"], "left").join(at("begin", "begin"), ["s", "begin"])
    grown = grown.select(F.col("s").alias("owner"), "len", "begin", F.col("begin_before").alias("before"), "branch", "branch_a", "branch_b")
    if nodes is not None:
        grown, points = owners.unionByName(grown), nodes.select("owner", "extent").unionByName(points).distinct()
    grown = written(grown, "trie-owners")
    return written(compacted(points, grown, paths), "trie-nodes"), grown


def digests(ends: DataFrame) -> DataFrame:
    """extent, extent_a, extent_b, sha: over the ascending ids (conv) of those that end there, joined by commas."""
    key = ["extent", "extent_a", "extent_b"]
    kind = "extent long, extent_a long, extent_b long"

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids = None, []
        for batch in batches:
            out = []
            for *k, conv in zip(*(batch[c] for c in key), batch.conv, strict=True):
                if ids and (k != now or len(ids) == IDS):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = k
                ids.append(conv)
            if out:
                yield pd.DataFrame(out, columns=[*key, "first", "ids"])
        if ids:
            yield pd.DataFrame([(*now, ids[0], ",".join(map(str, ids)))], columns=[*key, "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch[c] for c in key), batch.ids, strict=True):
                if k == now:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=[*key, "sha"])
        if sha:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "sha"])

    parts = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInPandas(chunks, f"{kind}, first long, ids string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(hashed, f"{kind}, sha string")


def build(strings: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and owners of the trie of all strings (s, len), inserted in batches."""
    nodes = owners = None
    part, begin = F.pmod(F.xxhash64(F.lit(11), "s"), F.lit(BATCHES[-1])), 0
    for end in BATCHES:
        batch = strings.filter((part >= begin) & (part < end)).select("s", "len")
        begin = end
        if not batch.isEmpty():
            nodes, owners = insert(batch, nodes, owners, paths)
    return nodes, owners


def counted(nodes: DataFrame, owners: DataFrame, strings: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with conv_id, n_convs, n_children, n_leaves, saved; and one row of these for the root, but for n_children."""
    key = ["extent", "extent_a", "extent_b"]
    branches = owners.groupBy(F.col("branch").alias("extent"), F.col("branch_a").alias("extent_a"), F.col("branch_b").alias("extent_b")).agg(F.count("*").alias("n_branches"))
    nodes = nodes.join(branches, key, "left").join(owners.select("owner", "len"), "owner")
    nodes = nodes.withColumn("n_children", F.coalesce("n_branches", F.lit(0)) + (F.col("len") > F.col("extent")).cast("long")).drop("n_branches", "len")
    nodes = written(nodes, "trie-compact")
    # a node without children is its owner's end
    leaves = nodes.filter("n_children = 0").select(F.col("owner").alias("s"), F.lit(1).cast("long").alias("leaf"))
    about = strings.select("s", "n", "words").join(owners.select(F.col("owner").alias("s"), "begin", F.col("before").alias("own_before")), "s", "left").join(leaves, "s", "left")
    about = written(about, "trie-strings-known")
    members = paths.join(nodes.select(F.col("extent").alias("d"), F.col("extent_a").alias("a"), F.col("extent_b").alias("b")), ["d", "a", "b"]).join(about, "s")
    # words of all members from here on, less those of each prefix once
    own = F.when(F.col("begin").isNull(), 0).when(F.col("begin") <= F.col("d"), F.col("words") - F.col("before")).otherwise(F.col("words") - F.col("own_before"))
    sums = [F.min("s").alias("conv_id"), F.sum("n").alias("n_convs"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves")]
    found = members.groupBy(F.col("d").alias("extent"), F.col("a").alias("extent_a"), F.col("b").alias("extent_b")).agg(*sums, F.sum(F.col("n") * (F.col("words") - F.col("before")) - own).alias("saved"))
    root = about.agg(*sums, F.sum(F.col("n") * F.col("words") - F.when(F.col("begin").isNull(), 0).otherwise(F.col("words") - F.col("own_before"))).alias("saved"))
    return written(nodes.join(found, key), "trie-counted"), root


def expanded(nodes: DataFrame, paths: DataFrame, ends: DataFrame, root_conv: int) -> DataFrame:
    """One row a length of each edge."""
    parents = nodes.select(F.col("extent").alias("up"), F.col("extent_a").alias("up_a"), F.col("extent_b").alias("up_b"), F.col("conv_id").alias("parent"))
    met = nodes.join(parents, ["up", "up_a", "up_b"], "left").join(ends, ["extent", "extent_a", "extent_b"], "left")
    met = met.join(paths.select(F.col("s").alias("owner"), F.col("d").alias("extent"), F.col("before").alias("last_before")), ["owner", "extent"])
    parts = F.explode(F.sequence(F.floor(F.col("up") / CHUNK), F.floor((F.col("extent") - 1) / CHUNK)))
    met = met.withColumn("part", parts)
    inside = F.sequence(F.greatest(F.col("up"), F.col("part") * CHUNK) + 1, F.least(F.col("extent"), (F.col("part") + 1) * CHUNK))
    rows = met.withColumn("d", F.explode(inside)).join(paths.select(F.col("s").alias("owner"), "d", "before"), ["owner", "d"])
    last, first = F.col("d") == F.col("extent"), F.col("d") == F.col("up") + 1
    return rows.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(~first, F.col("conv_id")).otherwise(F.coalesce("parent", F.lit(root_conv).cast("long"))).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.col("last_before") - F.col("before"))).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node. rows: conv, d, a, b, w (a turn's hashes and words at place d, from 1); convs: conv, len."""
    spark, zero = rows.sparkSession, F.lit(0).cast("long")
    about = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    if not about.n:
        return spark.createDataFrame([], NODES)
    known = written(prefixes(rows), "trie-prefixes")
    ends = convs.filter("len > 0").join(known, (known.conv == convs.conv) & (known.d == convs.len)).select(convs.conv, F.col("len").alias("extent"), F.col("a").alias("extent_a"), F.col("b").alias("extent_b"), "upto")
    ends = written(ends, "trie-ends")
    strings = ends.groupBy("extent", "extent_a", "extent_b").agg(F.min("conv").alias("s"), F.count("*").alias("n"), F.min("upto").alias("words"))
    strings = written(strings.select("s", F.col("extent").alias("len"), "n", "words"), "trie-strings")
    shas = written(digests(ends.unionByName(convs.filter("len = 0").select("conv", zero.alias("extent"), zero.alias("extent_a"), zero.alias("extent_b"), zero.alias("upto")))), "trie-digests")
    turnless = shas.filter("extent = 0").first()
    if strings.isEmpty():
        return spark.createDataFrame([(about.least, 0, None, about.n, 0, 1, 0, turnless.sha)], NODES)
    paths = written(known.withColumnRenamed("conv", "s").join(strings.select("s"), "s", "left_semi").drop("upto"), "trie-paths")
    nodes, owners = build(strings, paths)
    nodes, root = counted(nodes, owners, strings, paths)
    top, n_children = root.first(), owners.filter("branch = 0").count()
    first = spark.createDataFrame([(about.least, 0, None, about.n, n_children, top.n_leaves, top.saved, turnless.sha if turnless else NOTHING)], NODES)
    return first.unionByName(expanded(nodes, paths, shas, about.least))


def prefix_nodes(conversations: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """The trie of conversations whose first `head` turns are those of conversation `base`, both expressions of conv."""
    turns = written(numbered(conversations), "trie-numbered")
    return trie(*rebuilt(turns, base, head, most))
