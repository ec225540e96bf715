import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tessella.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, base=lambda c: c - c % 20, head=lambda c: zlib.crc32(str(c).encode()) % 4):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    seqs = {c: own.get(base(c), [])[: head(c)] + v[head(c) :] for c, v in own.items()}
    nodes = {}
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(seqs[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, base=lambda c: c - c % 20, head=lambda c: F.crc32(c.cast("string").cast("binary")) % 4):
    df = spark.createDataFrame(rows, ROWS).withColumns({"a": F.lit("clash"), "conv": F.lit(1), "d": F.lit(2)}).repartition(3)
    c = F.col("conv")
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(df, base(c), head(c), 3).collect()), key=str)


def grown(seed, n, letters, depth):
    """Conversations that often share long beginnings, or all of another."""
    r, made = random.Random(seed), []
    for _ in range(n):
        head = r.choice(made)[: r.randint(0, depth)] if made and r.random() < 0.7 else []
        made.append((head + [(r.choice("ua"), r.choice(letters)) for _ in range(r.randint(0, depth))])[:depth])
    return [(c, t, *x) for c, v in enumerate(made) for t, x in enumerate(v)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "BATCHES", (6, 20, 64))
    rows = grown(1, 90, ["a", "b b", "c  c\tc"], 11)
    assert run(spark, rows) == brute(rows)
    # as they are, each from its own first turn
    assert run(spark, rows, lambda c: c, lambda c: F.lit(0)) == brute(rows, lambda c: c, lambda c: 0)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    long = [(1, t, "user", f"x{t % 3}") for t in range(130)] + [(2, t, "user", f"x{t % 3}") for t in range(70)]
    rows = long + [(c, t, "user", "same words") for c in range(20, 60) for t in range(2)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("kind", ["empty", "odd", "turnless"])
def test_cases(spark, kind):
    odd = [(None, 0, "user", "x"), (5, None, None, None), (5, None, None, None), (5, 1, "user", ""), (5, 1, "assistant", "z"), (6, 0, "b", "a"), (6, 0, "a", "b"), (-3, 0, "user", "x y"), (-3, 0, "user", "x y")]
    rows = {"empty": [], "odd": odd, "turnless": [(c, 0, "user", "x") for c in (1, 3)]}[kind]
    if kind == "turnless":  # all turns come from a conversation that isn't there
        assert run(spark, rows, lambda c: c - 100, lambda c: F.lit(3)) == brute(rows, lambda c: c - 100, lambda c: 3)
    else:
        at = lambda c: c - (c % 20 if c >= 0 else -(-c % 20))
        assert run(spark, rows) == brute(rows, at)


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)
