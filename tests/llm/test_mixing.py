import logging
import math

import numpy as np
import pytest
import xxhash

from tessella.llm import mixing


def raked(cells, targets):
    w = {c: m for c, m in cells.items()}
    for _ in range(500):
        for axis, target in enumerate(targets):
            sums = {}
            for c, x in w.items():
                sums[c[axis]] = sums.get(c[axis], 0) + x
            w = {c: x * target[c[axis]] / sums[c[axis]] for c, x in w.items()}
    return w


@pytest.mark.parametrize("few", [mixing.FEW_CELLS, 0])
def test_raking_meets_the_marginals(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    cells = {(s, g, t): 10 + 7 * i + 3 * j * t for i, s in enumerate("abc") for j, g in enumerate(["en", "de"]) for t in range(3)}
    targets = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"en": 0.6, "de": 0.4}, {0: 0.2, 1: 0.3, 2: 0.5}]
    df = spark.createDataFrame([(*c, m) for c, m in cells.items()], "source string, lang string, topic int, mass long")
    given = {m: spark.createDataFrame(list(t.items()), f"value {'int' if m == 'topic' else 'string'}, share double") for m, t in zip(mixing.MARGINS, targets, strict=True)}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, given).collect()}
    for axis, target in enumerate(targets):
        for value, share in target.items():
            assert sum(w for c, w in got.items() if c[axis] == value) == pytest.approx(share, rel=2e-3)
    want = raked(cells, targets)
    assert all(got[c] == pytest.approx(want[c], rel=2e-2) for c in cells)


def test_calibration_keeps_the_budget(spark):
    rows = [("a", "en", 0, 900, 0.2), ("b", "en", 0, 50, 0.5), ("c", "en", 0, 50, 0.3), ("d", "en", 0, 0, 0.0)]
    got = {r.source: r for r in mixing.calibrate(spark.createDataFrame(rows, "source string, lang string, topic int, mass long, weight double"), 0.5).collect()}
    assert got["b"].probability == got["c"].probability == got["d"].probability == 1
    assert sum(r.mass * r.probability for r in got.values()) == pytest.approx(500)


def test_mix_is_reproducible_and_near_its_budget(spark, documents, words):
    rows = [(i, words(20 + i % 30, i), ("en", "de")[i % 3 == 0], "big" if i % 2 else f"s{i % 7}", 1) for i in range(600)]
    docs = documents(rows)
    mixed = mixing.mix(docs).toPandas()
    assert abs((mixed._tokens * mixed._probability).sum() / mixed._tokens.sum() - mixing.KEEP) < 0.01
    assert abs(mixed[mixed._drawn]._tokens.sum() / mixed._tokens.sum() - mixing.KEEP) < 0.1
    big = mixed[mixed.source == "big"]
    assert big._probability.mean() < mixed[mixed.source != "big"]._probability.mean()
    again = mixing.draw(docs.repartition(7)).toPandas()
    assert set(again.doc_id) == set(mixed[mixed._drawn].doc_id)


def test_defined_cases(documents, words):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "a b", None, "s", 3), (4, "x " * 50_000, "en", "s", 1), (4, "x " * 50_000, "en", "s", 1)]
    docs = documents(rows, {"_drawn": "theirs", "topic": 1})
    got = mixing.draw(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} >= {1, 2}
    assert mixing.draw(documents([])).count() == 0


def test_hasher_counts_words():
    n, v = mixing.Hasher()("a b a")
    assert n == 3 and math.isclose(np.linalg.norm(v), 1) and mixing.Hasher()(None)[0] == 0


def test_topics_are_fitted_on_all_documents(documents):
    # each of seven rare kinds is one of 9,000 documents
    rows = [(i, "common shared plain", "en", "s", 1) for i in range(8993)] + [(9000 + k, f"rare{k} odd{k} only{k} here{k}", "en", "s", 1) for k in range(7)]
    topic = {r.doc_id: r._topic for r in mixing.mix(documents(rows)).collect()}
    assert len(set(topic.values())) == 8 and len({topic[9000 + k] for k in range(7)} - {topic[0]}) == 7
    again = {r.doc_id: r._topic for r in mixing.mix(documents(rows[::-1]).repartition(7)).collect()}
    assert topic == again


def test_few_documents_have_topics(documents):
    rows = [(i, f"kind{i % 3} of{i % 3} text{i % 3}", "en", "s", 1) for i in range(9)]
    assert len({r._topic for r in mixing.mix(documents(rows)).collect()}) == 3


@pytest.mark.parametrize("few", [mixing.FEW_CELLS, 0])
def test_raking_goes_on_until_it_holds_or_says_so(spark, caplog, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    df = spark.createDataFrame([("a", "en", 0, 1000), ("a", "de", 0, 1), ("b", "en", 0, 1), ("b", "de", 0, 2000), ("c", "en", 0, 5), ("c", "de", 0, 3)], "source string, lang string, topic int, mass long")
    given = {m: spark.createDataFrame(rows, "value string, share double") for m, rows in {"source": [("a", 0.3), ("b", 0.6), ("c", 0.1)], "lang": [("en", 0.7), ("de", 0.3)]}.items()}
    got = mixing.rake(df, given).collect()
    for m, want in (("source", {"a": 0.3, "b": 0.6, "c": 0.1}), ("lang", {"en": 0.7, "de": 0.3})):
        for value, share in want.items():
            assert sum(r.weight for r in got if r[m] == value) == pytest.approx(share, rel=2e-3)
    assert not caplog.records
    never = df.filter("source <> 'c' AND mass > 1")
    with caplog.at_level(logging.WARNING, "tessella.llm.mixing"):
        assert mixing.rake(never, given).count() == 2
    assert "off its target" in caplog.text


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def draw_number(i):
    """The number in [0, 1) that decides whether a document is drawn."""
    return (signed(xxhash.xxh64_intdigest((11).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(i), 42))) % 2**40) / 2**40


def plain_mix(rows, targets, keep):
    """The whole operator over lists: topics, cells, raking, calibration and draw. rows: doc_id, text, lang, source."""
    hasher, fine = mixing.Hasher(), mixing.FINE // mixing.UNIT
    read = [hasher(t) for _, t, *_ in rows]
    vectors = [np.rint(v * mixing.UNIT).astype("<i2") for _, v in read]
    used = [v for (n, _), v in zip(read, vectors, strict=True) if n]
    centers = []
    while len(centers) < mixing.TOPICS:
        races = []
        for v in used:
            x = v.astype(float) * fine
            far = min((((x - c) ** 2).sum() / mixing.FINE**2 for c in centers), default=1.0)
            u = ((signed(xxhash.xxh64_intdigest(v.tobytes(), 42)) >> 11) + 2.0**52 + 0.5) / 2.0**53
            if far > 0:
                races.append((-math.log(u) / far, v.tobytes()))
        if not races:
            break
        centers.append(np.frombuffer(min(races)[1], "<i2").astype(float) * fine)

    def nearest(v):
        return int(np.argmin([((v.astype(float) * fine - c) ** 2).sum() for c in centers])) if centers else 0

    for _ in range(mixing.ROUNDS):
        before, members = centers, [[] for _ in centers]
        for v in used:
            members[nearest(v)].append(v.astype(float) * fine)
        centers = [np.rint(sum(m) / len(m)) if m else c for m, c in zip(members, before, strict=True)]
        if max((np.linalg.norm(a - b) for a, b in zip(centers, before, strict=True)), default=0) <= mixing.MOVED * mixing.FINE:
            break
    cell = [(source if source is not None else "\0", lang if lang is not None else "\0", nearest(v)) for (_, _, lang, source), v in zip(rows, vectors, strict=True)]
    mass = {}
    for c, (n, _) in zip(cell, read, strict=True):
        mass[c] = mass.get(c, 0) + n
    weight, total = {c: float(m) for c, m in mass.items() if m}, sum(mass.values())
    aims = []
    for axis, m in enumerate(mixing.MARGINS):
        sums = {}
        for c, x in weight.items():
            sums[c[axis]] = sums.get(c[axis], 0) + x
        aim = {v: targets[m].get(v, s / total) if m in targets else s ** mixing.TEMPERING[m] for v, s in sums.items()}
        aims.append({v: a / sum(aim.values()) for v, a in aim.items()})
    weight = raked(weight, aims)
    low, high = 0.0, 1e9 * total
    for _ in range(200):  # the scale at which the expected tokens are those to keep
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(mass[c], middle * x) for c, x in weight.items()) < keep * total else (low, middle)
    chance = {c: min(1.0, weight[c] * high / mass[c]) if mass[c] else 1.0 for c in mass}
    return [(r[0], c[2], n, chance[c]) for r, c, (n, _) in zip(rows, cell, read, strict=True)]


@pytest.mark.parametrize("targets", [{}, {"lang": {"en": 0.6, "de": 0.2, "xx": 0.3}, "source": {"s1": 0.5}}])
def test_whole_operator_matches_a_plain_version(spark, documents, words, targets):
    rows = [(i, words(5 + i % 40, i % 90) + f" kind{i % 9} of{i % 9}", ("en", "de", "fr")[i % 7 % 3], "big" if i % 3 else f"s{i % 5}") for i in range(300)]
    rows += [(900, None, None, None), (901, "", "en", "big"), (902, "a b c d", None, "s1")]
    given = {m: spark.createDataFrame(list(t.items()), "value string, share double") for m, t in targets.items()}
    got = {r.doc_id: r for r in mixing.mix(documents([(*r, 0) for r in rows]), given).collect()}
    want = plain_mix(rows, targets, mixing.KEEP)
    assert len(got) == len(want)
    for i, topic, tokens, chance in want:
        assert (got[i]._topic, got[i]._tokens) == (topic, tokens)
        assert got[i]._probability == pytest.approx(chance, rel=1e-2)
        assert got[i]._drawn == (draw_number(i) < got[i]._probability)


def test_clashing_columns(documents):
    docs = documents([(1, "a b", "en", "s", 1), (2, "c d", "de", "t", 1)], {"_topic": "theirs", "_key_source": 1, "_source": 2, "_doc": 3})
    got = mixing.mix(docs).collect()
    assert len(got) == 2 and {type(r._topic) for r in got} == {int} and all((r["_key_source"], r["_source"], r["_doc"]) == (1, 2, 3) for r in got)
    assert mixing.draw(docs).columns == docs.columns
