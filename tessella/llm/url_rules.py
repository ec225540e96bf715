"""URL filters by a sort-merge range join, in DataFrame functions alone.

A host's canonical key is its labels in reverse order, each closed by a dot (`www.example.com` -> `com.example.www.`).
The hosts under a rule's host are then the interval of keys that start with the rule's key; the paths under a rule's path
are, within one rule host, an interval too. Such intervals are nested or apart, never crossed.

The sweep: the intervals' begins and ends and the points asked for are sorted into one sequence. A begin is pushed onto a
stack, an end pops it; the stack's height is a running sum, and what stands at a height is the last begin that reached it.
So a point under `height` rules finds each of them as a running last() among the begins of that height. The sequence is cut
into range partitions that are swept at the same time; from those before it a partition takes the height, and the last
begin at each height, by tables of one row per partition (and height).

Two sweeps judge a URL: over host keys, which gives the rule hosts over each distinct host, however many rules these have;
then over pairs of rule host and path, which gives each the innermost rule. Of the rule hosts' answers the longest rule
wins. No rules are gathered in a row. Hosts and paths are made distinct first, so a host with a third of all pages is one
point of the first sweep, and its paths are spread over the partitions of the second.

Defined cases: a null URL, or one without `://`, has an empty host and an empty path. Rows that repeat are judged each
for itself. Of rules with the same host and path the one with the smaller verdict holds; a rule's null host or path is
empty. A rule with an empty host fits every host. Without rules, or for URLs that none fits, the rule is null and the
verdict `default`. URLs of any length are judged whole. Columns named host, path, rule or verdict are replaced; all
others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import few, whole, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("host", "path", "rule", "verdict")
_BEGIN, _POINT, _END = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def _bytes(*texts: Column) -> Column:
    """Texts as one sort key; the bytes FE between them and FF after them occur in no text."""
    parts: list[Column] = []
    for t in texts:
        parts += [F.lit(b"\xfe"), F.encode(t, "UTF-8")]
    return F.concat(*parts[1:])


def sweep(intervals: DataFrame, points: DataFrame, innermost: bool) -> DataFrame:
    """point, interval for every point inside of intervals: all of them, or the innermost. Both tables have one column
    `key`, of different binaries; an interval holds the keys that start with its own."""
    rows = (
        intervals.select("key", F.lit(_BEGIN).alias("kind"), F.lit(1).alias("push"))
        .unionByName(intervals.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(_END).alias("kind"), F.lit(-1).alias("push")))
        .unionByName(points.select("key", F.lit(_POINT).alias("kind"), F.lit(0).alias("push")))
    )
    # partition numbers must be the same for every reader, hence the table
    dealt = written(rows.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "url-sweep")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("push").alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    height = (F.col("base") + F.sum("push").over(order)).cast("int")
    high = dealt.join(few(parts), "part").withColumn("height", height).filter(f"height > 0 AND kind <> {_END}")
    asked = F.when((F.col("kind") == _POINT) & F.lit(not innermost), F.sequence(F.lit(1), F.col("height"))).otherwise(F.array("height"))
    levels = high.select("part", "key", "kind", F.explode(asked).alias("height"))
    begin = F.when(F.col("kind") == _BEGIN, F.col("key"))
    here = Window.partitionBy("part", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = levels.withColumn("interval", F.last(begin, ignorenulls=True).over(here)).filter(F.col("kind") == _POINT)
    open_before = Window.partitionBy("height").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = levels.groupBy("part", "height").agg(F.max(begin).alias("last")).withColumn("carried", F.last("last", ignorenulls=True).over(open_before))
    met = met.join(carried.filter("carried IS NOT NULL").select("part", "height", "carried"), ["part", "height"], "left")
    return met.select(F.col("key").alias("point"), F.coalesce("interval", "carried").alias("interval"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict. The longest rule that fits holds."""
    own = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    own = own.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    own = own.withColumn("above", _bytes(host_key(F.col("rule_host")))).withColumn("interval", _bytes(host_key(F.col("rule_host")), F.col("rule_path")))
    own = written(own, "url-rules")

    host, path = host_and_path(F.col(url))
    split = whole(pages, host.alias("host"), path.alias("path"))
    asked = split.select("host", "path").distinct().withColumn("key", _bytes(host_key(F.col("host"))))
    asked = written(asked, "url-asked")
    over = sweep(own.select(F.col("above").alias("key")).distinct(), asked.select("key").distinct(), innermost=False)
    over = written(over.select(F.col("point").alias("key"), F.col("interval").alias("above")), "url-hosts")
    pairs = asked.join(over, "key").select("host", "path", F.concat("above", F.lit(b"\xfe"), F.encode("path", "UTF-8")).alias("point"))
    pairs = written(pairs, "url-pairs")
    inner = sweep(own.select(F.col("interval").alias("key")), pairs.select(F.col("point").alias("key")).distinct(), innermost=True)
    fits = pairs.join(inner, "point").join(own.drop("above"), "interval")
    size = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("of_host"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    best = written(fits.groupBy("host", "path").agg(F.max(size).alias("best")), "url-best")
    judged = split.join(best, ["host", "path"], "left")
    return judged.select(
        *(F.col("_doc").getField(c).alias(c) for c in pages.columns if c not in RESULTS),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
