"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Each cell's token mass is raked: in turn, the masses of each
marginal's values are scaled to their targets, until all hold; where the targets contradict each other, as cells that
don't occur can make them, it ends once a round of sweeps gains nothing and logs what remains. A document's calibrated probability is its cell's raked
mass over its observed mass, scaled so that the expected tokens are KEEP of all and no probability is above 1 (what
saturated cells can't give, the others do). A document is drawn if a hash of its id is below its probability: the draw is
the same whatever the partitioning, and repeated rows are drawn together.

Topics are the nearest of TOPICS centroids of hashed word counts, fitted by k-means on all documents that have words.
Vectors are written once, in whole numbers, and so are the centroids: sums and distances are exact, hence topics are the
same whatever the partitioning. The first centroids are drawn one after another from all vectors, far ones more likely,
by a hash of the vector. Masses, marginals and probabilities cover all documents. Raking works on the
table of cells, which is aggregated before anything is shuffled by a key, so a source with a third of all rows is a few
rows there. Cells are joined back by key.

Defined cases: null texts count as empty, null source or lang as a value of its own; texts without words have no mass and
the probability of their cell (1 in a cell without mass). Rows with a null doc_id are drawn by the hash of their text. Target values
without documents have no effect; values without a target keep their observed share. An empty table gives an empty one.
"""

from __future__ import annotations

import logging
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import parted, written

_log = logging.getLogger(__name__)

MARGINS = ("source", "lang", "topic")
#: Targets, where none are given: each marginal's observed shares to these powers.
TEMPERING = {"source": 0.5, "lang": 0.7, "topic": 0.8}
KEEP = 0.7
TOPICS, BUCKETS = 8, 64
#: K-means ends after so many rounds, or once no centroid moves further.
ROUNDS, MOVED = 15, 1e-4
#: Vectors and centroids are whole numbers of these parts of 1.
UNIT, FINE = 1 << 14, 1 << 20
#: Raking ends within TOLERANCE, or once SWEEPS more leave more than STALLED of the deviation.
SWEEPS, TOLERANCE, STALLED = 4, 1e-3, 0.98
#: Tables of cells up to this size are raked in one task.
FEW_CELLS = 200_000


class Hasher:
    """Hashed word counts, scaled to unit length; words' buckets are remembered, up to a bound."""

    REMEMBERED = 300_000

    def __init__(self) -> None:
        bound = self.REMEMBERED

        class Known(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= bound:
                    self.clear()
                self[word] = out = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
                return out

        self.known = Known()

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        words = (text or "").split()
        counts = Counter(words)
        at = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
        vector = np.bincount(at, np.fromiter(counts.values(), float, len(counts)), BUCKETS)
        return len(words), vector / max(np.linalg.norm(vector), 1.0)


def with_vectors(docs: DataFrame) -> DataFrame:
    """docs (text and others) with _vector (16-bit whole numbers of 1 / UNIT) and _tokens (words)."""

    @F.pandas_udf("vector binary, tokens long")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        hasher = Hasher()
        read = [hasher(t) for t in texts]
        return pd.DataFrame({"vector": [np.rint(v * UNIT).astype("<i2").tobytes() for _, v in read], "tokens": [n for n, _ in read]})

    return docs.withColumn("_m", vectors("text")).select(*docs.columns, F.col("_m.vector").alias("_vector"), F.col("_m.tokens").alias("_tokens"))


def _array(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i2").reshape(-1, BUCKETS).astype(float)


def _far(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances less the vectors' own squares, in parts of 1 / FINE ** 2: whole numbers, held exactly."""
    return (centers**2).sum(axis=1)[None, :] - 2 * (FINE // UNIT) * v @ centers.T


def centroids(read: DataFrame, topics: int = TOPICS) -> np.ndarray:
    """Whole numbers of 1 / FINE; fewer than topics if there aren't as many different vectors."""
    used = read.filter("_tokens > 0").select("_vector", F.xxhash64("_vector").alias("h"))
    centers = np.zeros((0, BUCKETS))

    def races(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _array(batch["_vector"])
            apart = np.ones(len(v)) if not len(centers) else ((FINE // UNIT) ** 2 * (v**2).sum(axis=1) + _far(v, centers).min(axis=1)) / FINE**2
            u = ((batch["h"].to_numpy() >> 11) + 2.0**52 + 0.5) / 2.0**53
            at = apart > 0
            yield pd.DataFrame({"key": -np.log(u[at]) / apart[at], "v": batch["_vector"][at]})

    while len(centers) < topics:
        first = used.mapInPandas(races, "key double, v binary").agg(F.min(F.struct("key", "v")).alias("m")).first().m
        if first is None:
            break
        centers = np.vstack([centers, _array([bytes(first.v)]) * (FINE // UNIT)])
    if not len(centers):
        return np.zeros((1, BUCKETS))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((len(centers), BUCKETS)), np.zeros(len(centers))
        for batch in batches:
            v = _array(batch["_vector"])
            topic = _far(v, centers).argmin(axis=1)
            total += np.eye(len(centers))[topic].T @ v
            count += np.bincount(topic, minlength=len(centers))
        yield pd.DataFrame({"topic": np.repeat(np.arange(len(centers)), BUCKETS + 1), "at": np.tile(np.arange(BUCKETS + 1), len(centers)), "s": np.column_stack([total, count]).ravel().astype("int64")})

    for _ in range(ROUNDS):
        got = np.zeros((len(centers), BUCKETS + 1))
        for r in used.mapInPandas(sums, "topic long, at long, s long").groupBy("topic", "at").agg(F.sum("s").alias("s")).collect():
            got[r.topic, r["at"]] = r.s
        count = got[:, -1:]
        before, centers = centers, np.where(count > 0, np.rint(got[:, :-1] * (FINE // UNIT) / np.maximum(count, 1)), centers)
        if np.linalg.norm(centers - before, axis=1).max() <= MOVED * FINE:
            break
    return centers


def with_topics(read: DataFrame, centers: np.ndarray) -> DataFrame:
    """The rows of with_vectors() with _topic (int) in place of _vector."""

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(_far(_array(vectors), centers).argmin(axis=1).astype("int32"))

    return read.select(*(c for c in read.columns if c not in ("_vector", "_tokens")), nearest("_vector").alias("_topic"), "_tokens")


def _targets(cells: DataFrame, m: str, given: DataFrame | None) -> DataFrame:
    """value, target: the shares that a marginal's values with mass are to have; they sum to 1."""
    sums = cells.groupBy(F.col(m).alias("value")).agg(F.sum("mass").cast("double").alias("mass")).filter("mass > 0")
    if given is None:
        shares = sums.select("value", F.pow("mass", F.lit(TEMPERING[m])).alias("share"))
    else:
        part = F.col("mass") / F.greatest(F.lit(float(sums.agg(F.sum("mass")).first()[0] or 0)), F.lit(1e-9))
        asked = given.select("value", F.col("share").cast("double").alias("asked"))
        shares = sums.join(asked, "value", "left").select("value", F.coalesce("asked", part).alias("share"))
    total = float(shares.agg(F.sum("share")).first()[0] or 0)
    return shares.select("value", (F.col("share") / F.lit(max(total, 1e-300))).alias("target"))


class Ending:
    """Tells when raking is to end: within the tolerance, or once SWEEPS more leave most of the deviation."""

    def __init__(self) -> None:
        self.last, self.sweeps = float("inf"), 0

    def reached(self, off: float) -> bool:
        """off: the largest deviation of a marginal met in the sweep just done."""
        self.sweeps += 1
        if off < TOLERANCE:
            return True
        if self.sweeps % SWEEPS == 0:
            if off > STALLED * self.last:
                return True
            self.last = off
        return False


def _raked_at_once(rows: pd.DataFrame) -> pd.DataFrame:
    """All sweeps over the cells of one table, each with the targets of its three values."""
    rows = rows.sort_values(list(MARGINS)).reset_index(drop=True)
    codes = [rows[m].factorize()[0] for m in MARGINS]
    aims = [np.zeros(c.max() + 1) for c in codes]
    for aim, code, m in zip(aims, codes, MARGINS, strict=True):
        aim[code] = rows[f"to_{m}"].fillna(0.0)
    weight, ending = rows.mass.to_numpy(float), Ending()
    while True:
        off = 0.0
        for aim, code in zip(aims, codes, strict=True):
            sums = np.bincount(code, weight, len(aim))
            at = (sums > 0) & (aim > 0)
            off = max(off, float(np.abs(sums[at] / aim[at] - 1).max(initial=0)))
            weight = weight * np.divide(aim, sums, out=np.zeros(len(aim)), where=at)[code]
        if ending.reached(off):
            break
    return rows[[*MARGINS, "mass"]].assign(weight=weight, off=off)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells (source, lang, topic, mass) with weight: the raked share of each, the marginals at their targets.

    targets: for a marginal a table (value, share); without one its observed shares are tempered. Up to FEW_CELLS cells,
    however many documents they stand for, are raked in one task. Beyond that a cell's weight is its mass times one factor
    for each of its three values: to scale a marginal, the cells' masses times the two other factors are summed by its
    values, by partial sums, and only the factors are written anew. Both do the same sweeps."""
    cells = written(cells, "mixing-cells")
    aims = {m: written(_targets(cells, m, (targets or {}).get(m)), "mixing-targets") for m in MARGINS}
    if cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS:
        met = cells
        for m in MARGINS:
            met = met.join(aims[m].select(F.col("value").alias(m), F.col("target").alias(f"to_{m}")), m, "left")

        def at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = list(batches)
            if sum(map(len, rows)):
                yield _raked_at_once(pd.concat(rows))

        kinds = dict(cells.dtypes)
        schema = ", ".join([*(f"{m} {kinds[m]}" for m in MARGINS), "mass long", "weight double", "off double"])
        done = written(written(met, "mixing-cells").coalesce(1).mapInPandas(at_once, schema), "mixing-raked")
        _tell(done.agg(F.max("off")).first()[0] or 0.0)
        return done.drop("off")
    factors = {m: aims[m].withColumn("factor", F.lit(1.0)) for m in MARGINS}

    def weighed(by: tuple[str, ...]) -> tuple[DataFrame, Column]:
        met, weight = cells, F.col("mass").cast("double")
        for m in by:
            met = met.join(factors[m].select(F.col("value").alias(m), F.col("factor").alias(f"_{m}")), m, "left")
            weight *= F.coalesce(f"_{m}", F.lit(0.0))
        return met, weight

    ending = Ending()
    while True:
        off = 0.0
        for m in MARGINS:
            met, weight = weighed(tuple(x for x in MARGINS if x != m))
            sums = met.groupBy(F.col(m).alias("value")).agg(F.sum(weight).alias("sum"))
            scaled = factors[m].join(sums, "value").withColumn("off", F.when(F.col("sum") > 0, F.abs(F.col("factor") * F.col("sum") / F.col("target") - 1)))
            factors[m] = written(scaled.select("value", "target", F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("factor"), "off"), "mixing-factors")
            off = max(off, factors[m].agg(F.max("off")).first()[0] or 0.0)
        if ending.reached(off):
            break
    _tell(off)
    met, weight = weighed(MARGINS)
    return written(met.select(*MARGINS, "mass", weight.alias("weight")), "mixing-raked")


def _tell(off: float) -> None:
    if off >= TOLERANCE:
        _log.warning("raking ended with a marginal off its target by %.3g of it (tolerance %g)", off, TOLERANCE)


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """raked with probability: weight / mass, scaled to the expected tokens and held at 1."""
    total = raked.agg(F.sum("mass")).first()[0] or 0
    scale, full = keep * total, -1.0
    for _ in range(64):
        over = F.col("weight") * F.lit(scale) >= F.col("mass")
        got = raked.filter("mass > 0").agg(F.sum(F.when(over, F.col("mass"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("rest")).first()
        if (got.full or 0) == full or not got.rest:
            break
        full = got.full or 0
        scale = max(scale, (keep * total - full) / got.rest)
    return raked.withColumn("probability", F.when(F.col("mass") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(float(scale)) / F.col("mass"))).otherwise(F.lit(1.0)))


def _mixed(docs: DataFrame, carried: list[str], targets: dict[str, DataFrame] | None, keep: float) -> DataFrame:
    """_doc (the carried columns), _topic, _tokens, _probability and _drawn."""
    id_hash = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(11))
    keys = [F.coalesce(F.col(m).cast("string"), F.lit("\0")).alias(f"_{m}") for m in ("source", "lang")]
    read = with_vectors(docs.select(F.struct(*carried).alias("_doc"), "text", *keys, id_hash.alias("_hash")))
    read = written(read.drop("text"), "mixing-docs")
    marked = with_topics(read, centroids(read))
    cells = marked.groupBy(*(F.col(f"_{m}").alias(m) for m in MARGINS)).agg(F.sum("_tokens").alias("mass"))
    chances = calibrate(rake(cells, targets), keep).select(*(F.col(m).alias(f"_{m}") for m in MARGINS), F.col("probability").alias("_probability"))
    met = marked.join(written(chances, "mixing-chances"), [f"_{m}" for m in MARGINS])
    u = F.pmod(F.col("_hash"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return met.select("_doc", "_topic", "_tokens", "_probability", (u < F.col("_probability")).alias("_drawn"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, carried: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all, if not given) with _topic, _tokens, _probability and _drawn, which replace
    columns of these names."""
    made = ["_topic", "_tokens", "_probability", "_drawn"]
    carried = [c for c in carried or docs.columns if c not in made]
    return _mixed(docs, carried, targets, keep).select(*(F.col("_doc").getField(c).alias(c) for c in carried), *made)


def draw(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> DataFrame:
    """The documents drawn; the columns of docs."""
    return parted(_mixed(docs, docs.columns, targets, keep).filter("_drawn"), docs)
