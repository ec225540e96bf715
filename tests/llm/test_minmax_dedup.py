import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import components, minmax_dedup


def plain(rows, k, percent):
    """Components by comparing all sets that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i in sorted(sets):
        for j, both in Counter(j for g in sets[i] for j in having[g]).items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            having[g].append(i)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def edited(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "new" + str(r.randrange(1000))
    return " ".join(w)


@pytest.fixture
def rows(words):
    out = [(i, words(60, i)) for i in range(10, 60)]
    out += [(100 + i, edited(words(200, 1), i, 3)) for i in range(60)]  # links at various similarities
    out += [(200 + i, edited(words(200, 2), i, i % 12)) for i in range(60)]
    chain = words(200, 3)
    for i in range(30):  # each near the one before, the ends far apart
        chain = edited(chain, i, 3)
        out.append((300 + i, chain))
    out += [(400 + i, words(80, 4)) for i in range(80)]
    out += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "a b c"), (506, "a b c"), (507, words(30_000, 9)), (508, words(30_000, 9) + " more")]
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(documents, rows, k):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.group(documents(rows), k, 80).collect()}
    assert got == plain(rows, k, 80)


def test_repeated_rows_in_a_crowded_bucket(documents, words, monkeypatch):
    # all documents fall into one bucket, so links come from its ends and from the prefix filter
    monkeypatch.setattr(minmax_dedup, "band_keys", lambda s: np.zeros(1, np.int64))
    base = words(100, 2)
    rows = [(1, words(100, 1)), (3, base), (4, edited(base, 5, 2)), (9, words(100, 3)), (10, edited(words(100, 3), 1, 2)), (11, None)]
    for repeated in ([], [(3, base)] * 3, [(3, base), (3, None), (4, words(120, 8) + "zzz"), (11, None)]):
        given = [*rows, *repeated]
        once = {i: min((t for j, t in given if j == i and t is not None), default=None) for i, _ in given}
        want = plain(list(once.items()), 5, 80)
        got = [(r.doc_id, (r.n_shingles, r.component_id, r.kept)) for r in minmax_dedup.group(documents(given), 5, 80).collect()]
        assert sorted(got) == sorted((i, want[i]) for i, _ in given)
        assert want[9][1] == want[10][1] and (want[3][1] == want[4][1] or len(repeated) > 3)


def test_deduplicate_keeps_one_of_each(documents, rows):
    docs = documents([*rows, (505, "a b c"), (None, "no id"), (None, "no id")], {"n": 1, "component_id": "theirs"})
    left = minmax_dedup.deduplicate(docs, 5, 80).collect()
    assert left[0].asDict().keys() == set(docs.columns)
    assert Counter(r.doc_id for r in left) == Counter([i for i, (_, _, kept) in plain(rows, 5, 80).items() if kept] + [None, None])


def test_empty_table(documents):
    assert minmax_dedup.group(documents([]), 5, 80).count() == 0
    assert minmax_dedup.deduplicate(documents([])).count() == 0


def test_both_ends_estimate_similarity():
    rng = np.random.default_rng(1)
    a, b = minmax_dedup._permutations()
    both = rng.integers(0, 2**63, 900, np.uint64)
    left, right = (np.concatenate([both, rng.integers(0, 2**63, 100, np.uint64)]) for _ in range(2))
    agree = [f(left[:, None] * a + b, axis=0) == f(right[:, None] * a + b, axis=0) for f in (np.min, np.max)]
    assert abs(np.mean(agree) - 900 / 1100) < 0.1


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300), (None, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(41), 0) | {100: 100, 299: 299, 300: 299} | {200 + i: 100 for i in range(50)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
