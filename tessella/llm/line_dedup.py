"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Lines are the \\n-separated parts of all documents that have a word. Equal lines form one class, named by its first place
(doc_id, line_no). Two classes are linked if their lines are within `threshold` edits, which grows with the shorter
line's length: one edit, and two from `long` characters on (LONG, if not given). A line stays at its class's first place, unless that class is
linked with one that begins earlier.

The join: a line is cut into threshold + 1 segments; a line within the threshold must hold one of them unchanged, at a
place that the edits left and right of it allow. Segments are index keys (with length and number); a line probes those of
its own length and of lines up to threshold shorter, by the substrings at the allowed places. Keys are 64-bit hashes.
They are counted before anything meets: a key of two lines gives that pair, a key of up to TOGETHER lines its pairs. The
lines of a more crowded key are cut again, only where that key leaves something out, so the new keys are all the rest and
one half (one edit: a quarter) of it:

* one edit: what is left out shrinks to a piece of 128 (of 32 for lines of up to 128 characters), then to single characters.
  Who shares the rest of a line but for one character is linked for certain, hence counted without forming pairs; who is
  a character shorter is looked up by its own hash.
* two edits: they are either in one piece (the rest of the line, left and right of it, is the key), or in two, with one edit
  in each, so that lines which agree in either piece don't belong there: a key whose lines are all equal in a piece is dropped. Pieces are
  halved until no key is crowded, at last to single characters, where those who meet are linked.

So lines that follow one template and differ in a slot part as soon as a piece is shorter than what they differ in.
Whoever meets is verified on the full lines by a bit-parallel automaton over the band of 2 * threshold + 1 diagonals,
after equal beginnings and endings are taken off.

A class is one row however often its line occurs, and keys are counted before they are joined, so neither a line nor a
key with a third of all rows is one task's work.

Defined cases: null texts have no lines; blank lines are neither compared nor removed; lines of any length are compared.
Rows with a null doc_id keep all lines and don't count. Rows that share a doc_id are one place: what is equal at the same
number stays in each. Ties can't occur, as places differ. A text that loses all its lines with a word goes in
`deduplicate`; one that had none stays. Other columns pass through.
"""

from __future__ import annotations

import json
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, functions as F

from .common import few, let, parted, whole, written

#: Lines of so many characters and more are linked within two edits, shorter ones within one.
LONG = 1000
#: By threshold: into how many segments lines are cut, first and when keys are crowded; each a multiple of the one before.
#: With two edits, pieces are halved from there on.
SEGMENTS = {1: (2, 8, 32, 128), 2: (3,)}
#: Lengths by which two lines, and two pieces with an edit each, may differ: the longer line looks for the shorter one.
MOVES = [(0, 0), (1, -1), (-1, 1), (0, 1), (1, 0), (1, 1)]
#: Keys of more lines are crowded.
TOGETHER = 8
_WORD = r"[^\x20\x09-\x0D]"
_CLASS = ["a", "b", "n"]


def places(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, line_no, line for every line with a word."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return given.filter(F.col("doc").isNotNull() & F.col("line").rlike(_WORD))


def _identity(line: Column) -> list[Column]:
    """A 128-bit hash of a line, and its length."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(9), line).alias("b"), F.length(line).alias("n")]


def patterns(k: int, cut: int) -> list[tuple[int, int, bool, list[tuple[int, int, int]]]]:
    """How keys are taken when k of `cut` segments may be changed: (number of the choice of segments, how much shorter the
    indexed line is, whether it is an index key, runs of unchanged segments as (first, end, shift)).

    Of up to k edits, k segments can be chosen so that no block of neighbours holds more edits than segments. So a block
    moves what follows by its number of segments at most."""
    found = []
    for number, changed in enumerate(combinations(range(cut), k)):
        blocks: list[list[int]] = []
        for c in changed:
            if blocks and blocks[-1][1] == c:
                blocks[-1][1] = c + 1
            else:
                blocks.append([c, c + 1])
        for moves in product(*(range(begin - end, end - begin + 1) for begin, end in blocks)):
            if 0 <= sum(moves) <= k:
                runs, at, shift = [], 0, 0
                for (begin, end), move in zip(blocks, moves, strict=True):
                    runs.append((at, begin, shift))
                    at, shift = end, shift + move
                runs.append((at, cut, shift))
                found.append((number, sum(moves), not any(moves), [r for r in runs if r[0] < r[1]]))
    return found


def _run(line: Column, m: Column, cut: int | Column, first, end, shift) -> Column:
    """The substring where segments first to end of an indexed line of length m are looked for."""
    border = lambda j: F.floor(m * j / cut).cast("int")
    return F.substr(line, border(first) + shift + 1, border(end) - border(first))


def first_keys(lines: DataFrame, long: int) -> DataFrame:
    """a, own, kind, key by the first cut."""
    line, n = F.col("line"), F.col("n")

    def keys(k: int, own: bool) -> list[Column]:
        out = []
        for number, less, is_own, runs in patterns(k, SEGMENTS[k][0]):
            m = n - less
            key = F.xxhash64(F.lit(k), F.lit(number), m, *(_run(line, m, SEGMENTS[k][0], *r) for r in runs))
            if is_own == own:
                out.append(F.when((m > 0) & ((m < long) if k == 1 else (m >= long)), key))
        return out

    # index keys come first; near `long` both thresholds have a part
    cases = [(n < long, (1,)), (n >= long + 2, (2,)), (None, (1, 2))]
    arrays, kinds, counts = [], [], []
    for _, ks in cases:
        arrays.append(F.array(*(x for own in (True, False) for k in ks for x in keys(k, own))))
        kinds.append(F.array(*(F.lit(_kind(k, p[0], p[1])) for own in (True, False) for k in ks for p in patterns(k, SEGMENTS[k][0]) if p[2] == own)))
        counts.append(F.lit(sum(SEGMENTS[k][0] for k in ks)))
    pick = lambda x: F.when(cases[0][0], x[0]).when(cases[1][0], x[1]).otherwise(x[2])
    got = lines.select("a", pick(counts).alias("n_own"), pick(kinds).alias("kinds"), F.posexplode(pick(arrays)).alias("at", "key")).filter("key IS NOT NULL")
    return got.select("a", (F.col("at") < F.col("n_own")).alias("own"), F.get("kinds", F.col("at")).alias("kind"), "key")


def _kind(k: int, number: int, less: int) -> int:
    """What a key leaves out, and how much shorter the indexed line is."""
    return 1_000_000 * k + 10 * number + less


def later_keys(lines: DataFrame, long: int, level: int) -> DataFrame:
    """a, own, kind, key by a later cut for one edit, for lines with the kind of a crowded key of the cut before."""
    line, n = F.col("line"), F.col("n")
    names = "k:int,cut:int,number:int,less:int,own:boolean,kind:int,of:int,runs:array<struct<first:int,end:int,shift:int>>"
    before, cut = SEGMENTS[1][level - 1 : level + 1]
    told = [(1, cut, number, less, own, _kind(1, number, less), _kind(1, number * before // cut, less), runs) for number, less, own, runs in patterns(1, cut)]
    given = F.from_json(F.lit(_json(told, names)), F.lit(f"array<struct<{names}>>"))

    def key(p: Column) -> Column:
        m = n - p["less"]
        kept = F.transform(p["runs"], lambda r: _run(line, m, p["cut"], r["first"], r["end"], r["shift"]))
        applies = (m > 0) & (m < long)
        return F.struct(p["own"].alias("own"), p["kind"].alias("kind"), F.when(applies, F.xxhash64(p["k"], p["number"], m, kept)).alias("key"))

    own = F.transform(F.filter(given, lambda p: p["of"] == F.col("kind")), key)
    return lines.select("a", F.inline(F.filter(own, lambda x: x["key"].isNotNull()))).distinct()


def _json(told: list, names: str) -> str:
    fields = [x.split(":")[0] for x in names.split(",")[:7]]
    return json.dumps([{**dict(zip(fields, p[:7], strict=True)), "runs": [dict(zip(("first", "end", "shift"), r, strict=True)) for r in p[7]]} for p in told])


def met(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed: a, own, kind, key; h1 and h2, what the lines of a key must not all agree in; last, if none of its keys counts
    as crowded. Pairs (x, y) of lines that share an index key of few lines, and the lines of crowded keys as a, kind."""
    apart = [x for h in ("h1", "h2") for x in (F.min(h).alias(f"{h}_low"), F.max(h).alias(f"{h}_high"))] if "h1" in keyed.columns else []
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min("a").alias("x"), F.max("a").alias("y"), F.max("own").alias("own"), *apart)
    shared = shared.filter("own AND x < y")
    if apart:
        shared = shared.filter("h1_low < h1_high AND h2_low < h2_high")
    shared = written(shared.select("key", "rows", "x", "y"), "line-keys")
    more = written(shared.filter("rows > 2").select("key"), "line-more")
    last = F.max("last") if "last" in keyed.columns else F.lit(False)
    members = written(keyed.join(few(more), "key").groupBy("key", "a").agg(F.max("own").alias("own"), F.max("kind").alias("kind"), last.alias("last")), "line-members")
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("rows"), F.max("last").alias("final")), "key")
    together = (F.col("rows") <= TOGETHER) | F.col("final")
    near = written(sized.filter(together).select("key", "a", "own"), "line-near")
    x, y = (near.select("key", F.col("a").alias(c), F.col("own").alias(f"own_{c}")) for c in "xy")
    pairs = x.join(y, "key").filter("x < y AND (own_x OR own_y)").select("x", "y")
    pairs = shared.filter("rows = 2").select("x", "y").unionByName(pairs)
    return pairs, sized.filter(~together).select("a", "kind").distinct()


def piece_keys(lines: DataFrame, long: int, cut: int) -> DataFrame:
    """a, own, kind, key, h1, h2, last for lines with a place (i, j) among `cut` pieces: two edits in the one piece i = j,
    or one in each of i < j. The kind is the place."""
    line, n, i, j = F.col("line"), F.col("n"), F.col("i"), F.col("j")

    def key(one: int, two: int) -> Column:
        m = n - (one + two)
        border = lambda k: F.floor(m * k / cut).cast("int")
        part = lambda begin, end: F.substr(line, begin + 1, F.greatest(end - begin, F.lit(0)))
        first, after = border(i), border(i + 1) + one
        second, rest = border(j) + one, border(j + 1) + (one + two)
        in_two = F.xxhash64(F.lit(cut), i, j, m, part(F.lit(0), first), part(after, second), part(rest, n))
        pieces = [F.when(i < j, F.xxhash64(part(*x))).otherwise(F.col("a")) for x in ((first, after), (second, rest))]
        in_one = F.xxhash64(F.lit(cut), i, j, m, part(F.lit(0), first), part(rest, n))
        # in one piece only the difference of lengths counts
        made = F.when(i < j, in_two) if (one, two) in ((1, -1), (-1, 1), (1, 0)) else F.when(i < j, in_two).otherwise(in_one)
        fields = [F.lit((one, two) == (0, 0)).alias("own"), F.when(m >= long, made).alias("key"), pieces[0].alias("h1"), pieces[1].alias("h2"), (m <= cut).alias("last")]
        return F.struct(*fields)

    keyed = lines.select("a", _place(i, j).alias("kind"), F.inline(F.array(*(key(*x) for x in MOVES))))
    return keyed.filter("key IS NOT NULL")


def _place(i: Column, j: Column) -> Column:
    return i.cast("long") * (1 << 31) + j


def _halved(crowded: DataFrame) -> DataFrame:
    """a, i, j: the places that the halves of the pieces of a, kind make."""
    i, j = F.shiftright("kind", 31), F.col("kind") % (1 << 31)
    at = lambda x, y: F.struct(x.alias("i"), y.alias("j"))
    one = F.array(at(2 * i, 2 * i), at(2 * i + 1, 2 * i + 1), at(2 * i, 2 * i + 1))
    two = F.array(*(at(2 * i + x, 2 * j + y) for x in (0, 1) for y in (0, 1)))
    return crowded.select("a", F.inline(F.when(i == j, one).otherwise(two)))


def two_edit_pairs(crowded: DataFrame, texts: DataFrame, long: int) -> list[DataFrame]:
    """Pairs (x, y) from the crowded keys (a, kind) of the first cut."""
    cut = SEGMENTS[2][0]
    choices = F.array(*(F.array(*map(F.lit, c)) for c in combinations(range(cut), 2)))
    chosen = F.get(choices, F.floor((F.col("kind") - 2_000_000) / 10).cast("int"))
    at = lambda x, y: F.struct(chosen[x].cast("long").alias("i"), chosen[y].cast("long").alias("j"))
    places = crowded.filter("kind >= 2000000").select("a", F.inline(F.array(at(0, 0), at(1, 1), at(0, 1)))).distinct()
    found = []
    while True:
        places = written(places, "line-places")
        if places.isEmpty():
            return found
        pairs, crowded = met(piece_keys(texts.join(places, "a"), long, cut))
        found.append(written(pairs, "line-pairs"))
        places, cut = _halved(crowded), 2 * cut


def within(s: Column, r: Column, k: int = 1) -> Column:
    """Whether two texts are at most k edits apart."""

    def common(x: Column, y: Column) -> Column:
        """How many elements two arrays have in common at their beginnings."""
        at = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), False)
        return F.when(at > 0, at - 1).otherwise(F.greatest(F.size(x), F.size(y))).cast("int")

    def middle(p: Column) -> Column:
        """p: struct x, y. Both without their common beginning and, after that, their common ending."""
        at = common(p["x"], p["y"])
        rest = F.struct(*(F.slice(p[c], at + 1, F.size(p[c])).alias(c) for c in "xy"))

        def cut(q: Column) -> Column:
            end = common(F.reverse(q["x"]), F.reverse(q["y"]))
            return F.struct(*(F.slice(q[c], 1, F.size(q[c]) - end).alias(c) for c in "xy"))

        return let(rest, cut)

    width, full = 2 * k + 1, (1 << (2 * k + 1)) - 1

    def automaton(q: Column) -> Column:
        """Bit b of level d: after j characters of y, x is read up to j + b - k with d edits."""
        n, m = F.size(q["x"]), F.size(q["y"])
        # before y begins, d edits may have dropped up to d characters of x
        start = F.struct(*(F.lit(sum(1 << (k + e) for e in range(d + 1))).alias(f"d{d}") for d in range(k + 1)))

        def step(now: Column, j: Column) -> Column:
            c = F.get(q["y"], j - 1)
            same = sum(
                (F.when((j + (b - k) >= 1) & (F.get(q["x"], j + (b - k) - 1) == c), F.lit(1 << b)).otherwise(F.lit(0)) for b in range(width)), F.lit(0)
            )

            def levels(mask: Column) -> Column:
                made = [now["d0"].bitwiseAND(mask)]
                for d in range(1, k + 1):
                    stay, less = now[f"d{d}"].bitwiseAND(mask), now[f"d{d - 1}"]
                    made.append(stay.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(made[-1], 1)).bitwiseAND(F.lit(full)))
                return F.struct(*(x.alias(f"d{d}") for d, x in enumerate(made)))

            return let(same, levels)

        ends = F.call_function("shiftleft", F.lit(1), F.greatest(n - m + k, F.lit(0)))
        last = F.aggregate(F.sequence(F.lit(1), m), start, step)
        read = F.when(m == 0, n <= k).otherwise(let(last, lambda s: s[f"d{k}"].bitwiseAND(ends) != 0))
        return (F.abs(n - m) <= k) & read

    letters = F.struct(F.split(s, "").alias("x"), F.split(r, "").alias("y"))
    return let(letters, lambda p: let(middle(p), automaton))


def single_changes(texts: DataFrame) -> DataFrame:
    """a, b, n with the number of lines that one changed character makes of it, and the first place
    among them and itself. Lines that are equal but for one character share the key of that character, so they are
    counted, not paired. Characters are tried where the rows' spans (first, end) say."""
    at = F.sequence(F.col("span.first"), F.col("span.end") - 1)
    left = lambda i: F.concat(F.substr("line", F.lit(1), i), F.substr("line", i + 2))
    keys = F.transform(at, lambda i: F.struct(F.xxhash64(i, F.col("n"), left(i)).alias("key"), F.xxhash64(left(i), F.col("n"), i).alias("key2")))
    rows = texts.filter("span.first < span.end").select(*_CLASS, "first", F.inline(keys))
    groups = rows.groupBy("key", "key2").agg(F.count("*").alias("others"), F.min("first").alias("earliest")).filter("others > 1")
    counted = rows.drop("first").join(groups, ["key", "key2"])
    return counted.groupBy(*_CLASS).agg(F.sum(F.col("others") - 1).alias("n_links"), F.min("earliest").alias("earliest"))


def single_drops(texts: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (x, y) of one of texts and one of others that it becomes by dropping a character of its span."""
    at = F.sequence(F.col("span.first"), F.col("span.end") - 1)
    left = F.transform(at, lambda i: F.xxhash64(F.concat(F.substr("line", F.lit(1), i), F.substr("line", i + 2))))
    drops = texts.filter("n > 1 AND span.first < span.end").select(F.col("a").alias("of"), F.explode(F.array_distinct(left)).alias("a")).filter("of <> a")
    return drops.join(others.select("a").distinct(), "a").select(F.least("of", "a").alias("x"), F.greatest("of", "a").alias("y"))


def _span(first, end) -> Column:
    return F.struct(F.lit(first).cast("int").alias("first"), end.cast("int").alias("end")).alias("span")


def links(lines: DataFrame, long: int = LONG) -> DataFrame:
    """a, b, n, n_links and earliest (the first place among linked classes, or its own if that is earlier) of every class
    that is linked. lines: as places(), with a, b, n."""
    pairs, crowded = met(first_keys(lines, long))
    found = [written(pairs, "line-pairs")]
    crowded = written(crowded, "line-crowded")
    wanted = found[0].select(F.explode(F.array("x", "y")).alias("a")).unionByName(crowded.select("a")).distinct()
    texts = lines.join(few(written(wanted, "line-wanted")), "a").groupBy(*_CLASS)
    texts = written(texts.agg(F.min(F.struct("doc", "line_no")).alias("first"), F.min("line").alias("line")), "line-texts")
    found += two_edit_pairs(crowded, texts, long)
    crowded = crowded.filter("kind < 2000000")
    for level in range(1, len(SEGMENTS[1]) - 1):
        pairs, crowded = met(later_keys(texts.join(crowded, "a"), long, level))
        found.append(written(pairs, "line-pairs"))
        crowded = written(crowded, "line-crowded")
    rest = written(texts.join(crowded, "a"), "line-rest")
    # lines up to this length go on by single characters, longer ones after one more cut, inside of what it leaves out
    cut = SEGMENTS[1][-1]
    short = min(cut, long - 1)
    n, number, less = F.col("n"), F.floor((F.col("kind") - 1_000_000) / 10), F.col("kind") % 10
    singles = written(rest.filter(n <= short + 1).drop("kind").dropDuplicates(_CLASS).withColumn("span", _span(0, n)), "line-singles")
    found.append(written(single_drops(singles, singles.filter(n <= short)), "line-pairs"))
    singles = singles.filter(n <= short)
    pairs, crowded = met(later_keys(rest.filter(n > short), long, len(SEGMENTS[1]) - 1))
    found.append(written(pairs, "line-pairs"))
    border = lambda j: F.floor((n - less) * j / cut)
    inside = written(texts.join(crowded, "a").withColumn("span", _span(border(number), border(number + 1) + less)), "line-inside")
    changed = inside.filter(less == 0)
    found.append(written(single_drops(inside.filter(less == 1), changed), "line-pairs"))
    counted = written(single_changes(singles.select(*_CLASS, "first", "line", "span").unionByName(changed.select(*_CLASS, "first", "line", "span"))), "line-counted")

    every = found[0]
    for p in found[1:]:
        every = every.unionByName(p)
    side = lambda c: texts.select(F.col("a").alias(c), *(F.col(f).alias(f"{f}_{c}") for f in ("b", "n", "first", "line")))
    both = every.distinct().join(side("x"), "x").join(side("y"), "y")
    # lines of one length that differ where the characters of both are counted are in these counts
    spans = written(singles.select("a", "span").unionByName(changed.select("a", "span")).groupBy("a").agg(F.array_sort(F.collect_set("span")).alias("spans")), "line-spans")
    for c in "xy":
        both = both.join(spans.select(F.col("a").alias(c), F.col("spans").alias(f"spans_{c}")), c, "left")
    s, r, brief = F.col("line_x"), F.col("line_y"), F.least("n_x", "n_y") < long
    near = both.filter(F.abs(F.col("n_x") - F.col("n_y")) <= F.when(brief, 1).otherwise(2))
    near = near.filter(F.when(brief, within(s, r, 1)).otherwise(within(s, r, 2)))
    differ = F.array_position(F.zip_with(F.split(s, ""), F.split(r, ""), lambda u, v: u == v), False) - 1
    holds = let(differ.cast("int"), lambda i: F.exists(F.array_intersect("spans_x", "spans_y"), lambda x: (x["first"] <= i) & (i < x["end"])))
    near = near.filter(~F.coalesce(F.when((F.col("n_x") == F.col("n_y")) & F.col("spans_x").isNotNull() & F.col("spans_y").isNotNull() & brief, holds), F.lit(False)))
    near = written(near.drop("line_x", "line_y", "spans_x", "spans_y"), "line-links")
    ends = [near.select(F.col(u).alias("a"), F.col(f"b_{u}").alias("b"), F.col(f"n_{u}").alias("n"), F.lit(1).cast("bigint").alias("n_links"), F.col(f"first_{v}").alias("earliest")) for u, v in ("xy", "yx")]
    return ends[0].unionByName(ends[1]).unionByName(counted).groupBy(*_CLASS).agg(F.sum("n_links").alias("n_links"), F.min("earliest").alias("earliest"))


def judge(docs: DataFrame, long: int = LONG) -> DataFrame:
    """One row per line with a word: doc_id, line_no, class_doc and class_line (its class's first place), n_links, kept."""
    lines = places(docs)
    lines = lines.select("*", *_identity(F.col("line")))
    linked = written(links(lines, long), "line-linked")
    light = lines.select("doc", "line_no", *_CLASS)
    named = light.groupBy(*_CLASS).agg(F.min(F.struct("doc", "line_no")).alias("first")).join(linked, _CLASS, "left")
    # as a table, so that Spark can split a line with very many places
    out = light.join(written(named, "line-named"), _CLASS)
    own = F.struct("doc", "line_no")
    kept = (own == F.col("first")) & (F.col("earliest").isNull() | (F.col("first") <= F.col("earliest")))
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("line_no").cast("long"),
        F.col("first.doc").alias("class_doc"),
        F.col("first.line_no").cast("long").alias("class_line"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        kept.alias("kept"),
    )


def deduplicate(docs: DataFrame, long: int = LONG) -> DataFrame:
    """docs without the lines that don't stay, and without texts that lose all they had; the columns of docs."""
    gone = judge(docs.select("doc_id", "text"), long).filter("NOT kept").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone"))
    met = whole(docs, "doc_id", "text").join(gone, F.col("doc_id") == F.col("_id"), "left")
    left = let(F.split("text", "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone")), lambda i: F.get(x, i)))
    # explode() of one struct is worked out once, and the filter on it isn't pushed below it
    changed = F.explode(F.array(F.struct(F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")))).alias("_new")
    stays = F.col("_gone").isNull() | F.col("_new.text").rlike(_WORD)
    text = F.col("_new.text")
    n_chars = F.when(F.col("_gone").isNull(), F.col("_doc.n_chars")).otherwise(F.length(text).cast("bigint")) if "n_chars" in docs.columns else F.lit(None)
    return parted(met.select("_doc", "_gone", changed).filter(stays), docs, text=text, n_chars=n_chars)
