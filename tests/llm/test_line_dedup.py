import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, long):
    lines = sorted({(d, i, x) for d, t in rows if t is not None and d is not None for i, x in enumerate(t.split("\n")) if re.search("[^\x20\x09-\x0d]", x)})
    first = {}
    for d, i, x in lines:
        first.setdefault(x, (d, i))
    own = list(first)
    near = {x: [] for x in own}
    for a, x in enumerate(own):
        for y in own[:a]:
            k = 1 if min(len(x), len(y)) < long else 2
            if abs(len(x) - len(y)) <= k and distance(x, y) <= k:
                near[x].append(y)
                near[y].append(x)
    return {(d, i): (*first[x], len(near[x]), (d, i) == first[x] and all(first[y] > first[x] for y in near[x])) for d, i, x in lines}


def edit(text, r):
    at = r.randrange(len(text))
    return r.choice([text[:at] + text[at + 1 :], text[:at] + r.choice("aéx ") + text[at:], text[:at] + r.choice("aéz") + text[at + 1 :]])


@pytest.fixture
def rows(words):
    r = random.Random(6)
    base = [words(n, 50 + n) for n in (3, 4, 5, 8, 20, 60)] + ["é" * 16, "x" * 40]
    out = []
    for d in range(60):
        lines = [r.choice(base) for _ in range(4)] + [words(6, d)]
        for _ in range(3):
            x = r.choice(base)
            for _ in range(r.randint(1, 3)):
                x = edit(x, r)
            lines.append(x)
        r.shuffle(lines)
        out.append((d, "\n".join(lines)))
    return out + [(100, None), (101, ""), (102, " \n\t\n"), (103, "short\nshort\nshorx"), (104, words(20_000, 1)), (105, words(20_000, 1)), (None, "x" * 40)]


def judged(docs, long):
    return {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.n_links, r.kept) for r in line_dedup.judge(docs, long).collect()}


@pytest.mark.parametrize(("long", "together"), [(10**6, 8), (0, 1), (30, 2)])
def test_matches_brute_force(documents, rows, long, together, monkeypatch):
    monkeypatch.setattr(line_dedup, "TOGETHER", together)
    rows = [r for r in rows if r[0] is None or r[0] < 104]
    assert judged(documents(rows), long) == plain(rows, long)


def test_short_and_counted_lines(documents):
    r = random.Random(8)
    lines = [*"abcdefghijklmnop", "ab", "ac", "bb", "aa", "aaa", "aab", "é", "éé", *(f"no. {i}" for i in range(150)), *(f"no. {i} of them" for i in range(0, 300, 7))]
    lines += [f"{'x' * 40} {i:03d} {'y' * 30}" for i in range(60)]
    r.shuffle(lines)
    rows = [(d, "\n".join(lines[at : at + 9])) for d, at in enumerate(range(0, len(lines), 9))]
    assert judged(documents(rows), 50) == plain(rows, 50)


def told(spark, lines):
    return spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "doc long, line_no int, line string").withColumns({c: e for c, e in zip("abn", line_dedup._identity(F.col("line")), strict=True)})


@pytest.mark.parametrize("long", [10**6, 200])
def test_lines_that_share_a_part_do_not_all_meet(spark, words, long):
    half = words(40, 1)[:150]
    lines = [f"{half}{words(60, 10 + i)[:150]}" for i in range(2000)] + [f"{words(60, 7)[:60]} {i:04d}" for i in range(1000)]
    rows = told(spark, lines)
    pairs, crowded = line_dedup.met(line_dedup.first_keys(rows, long))
    assert pairs.count() < 1000 and crowded.select("a").distinct().count() > 2500
    got = line_dedup.links(rows, long)
    assert got.filter("n < 100").agg(F.sum("n_links")).first()[0] == 1000 * 27  # one of three changing digits, 0 to 9
    assert got.filter("n > 100").count() == 0


@pytest.fixture
def pairs_written(monkeypatch):
    """The tables of pairs that are written on the way."""
    found = []
    real = line_dedup.written

    def keep(df, label):
        out = real(df, label)
        if label == "line-pairs":
            found.append(out)
        return out

    monkeypatch.setattr(line_dedup, "written", keep)
    return found


@pytest.mark.parametrize(("length", "slot"), [(1200, 30), (1200, 0), (900, 0)])
def test_templated_lines_make_few_pairs(spark, words, pairs_written, length, slot):
    """Lines of one template: with a random slot none are linked, with a number all those a digit (or two) apart."""
    many = 4000 if slot else 300
    text = words(400, 3)[:length]
    fill = lambda i: words(12, i)[:slot].ljust(slot) if slot else f"{(i * 7919) % 100_000:05d}"
    lines = [f"{text[:500]}{fill(i)}{text[500:]}" for i in range(many)]
    got = line_dedup.links(told(spark, lines))
    n = sum(p.distinct().count() for p in pairs_written)
    if slot:
        assert n < 2 * len(lines) and got.count() == 0
        return
    k = 2 if length >= line_dedup.LONG else 1
    numbers = {fill(i) for i in range(many)}
    r = random.Random(1)
    asked = r.sample(range(many), 5)
    expected = {i: sum(distance(fill(i), x) <= k for x in numbers) - 1 for i in asked}
    by_line = {r.a: r.n_links for r in got.collect()}
    hashed = {r.doc: r.a for r in told(spark, lines).select("doc", "a").collect()}
    assert {i: by_line.get(hashed[i], 0) for i in asked} == expected
    total = sum(by_line.values())
    assert n < 2 * len(lines) + 2 * total


@pytest.mark.parametrize("k", [1, 2, 3])
def test_automaton_is_the_edit_distance(spark, k):
    r = random.Random(k)
    pairs = [("", ""), ("", "a"), ("abc", ""), ("a" * 12, "a" * (12 + k))]
    for _ in range(300):
        x = "".join(r.choice("ab") for _ in range(r.randint(0, 12)))
        y = x
        for _ in range(r.randint(0, k + 2)):
            y = edit(y or "a", r)
        pairs.append((x, y))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup.within(F.col("x"), F.col("y"), k).alias("near")).collect()
    assert [(g.x, g.y) for g in got if g.near != (distance(g.x, g.y) <= k)] == []


def test_deduplicate_rebuilds_texts(documents, rows):
    docs = documents(rows, {"line_no": 1, "_gone": "theirs"})
    left = {r.doc_id: r for r in line_dedup.deduplicate(docs).collect()}
    judged = {(r.doc_id, r.line_no): r.kept for r in line_dedup.judge(docs).collect()}
    for d, text in rows:
        lines = (text or "").split("\n")
        stays = [x for i, x in enumerate(lines) if judged.get((d, i), True)]
        gone = len(stays) < len(lines)
        if gone and not any(re.search("[^\x20\x09-\x0d]", x) for x in stays):
            assert d not in left
        else:
            assert left[d].text == (text if not gone else "\n".join(stays))
            assert left[d].n_chars == len(left[d].text or "") and left[d]["_gone"] == "theirs"
    assert 105 not in left


def test_empty_table(documents):
    assert line_dedup.judge(documents([])).count() == 0
    assert line_dedup.deduplicate(documents([])).count() == 0
