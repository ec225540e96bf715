import re
from collections import Counter

from tessella.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed)


def test_counts_match_a_plain_version(documents, words):
    texts = [None, "", " \n\t ", "one", "a b c d e a b c d e a b c d e", words(40, 1) + ".", words(9, 2), "x\x0by\x0cz " * 8, "é ü\n" * 6, "# $ % | <a> " * 9]
    texts += [words(60, s) + ".\n" + words(30, s % 3) + ".\n" + words(30, s % 3) + "." for s in range(8)] + [words(30_000, 5)]
    texts += [" ".join(["same"] * 20_000)]
    got = quality.judge(documents(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert own == plain(texts[r.doc_id]), texts[r.doc_id][:60]
        assert not (r.base_failed and r.kept)


def test_line_rules_decide(documents, words):
    prose = words(30, 7) + "."
    cases = {
        1: (prose, True),
        2: (prose + "\nHome\nAll rights reserved.\n" + words(3, 1), True),
        3: ("\n".join(words(9, s) for s in range(9)), False),  # nothing closes
        4: (" | ".join(words(40, 8).split()) + ".", False),
        6: (prose + "\n" + words(60, 3)[:250] + " Click here " + words(60, 4)[:250] + ".", False),  # a long line is judged too
        7: (prose + "\n" + words(60, 5)[:100] + ".'\"))))))))))))", True),
        5: ("\n".join(f"{w}### {w}*** {w}%%%." for w in words(40, 9).split()), False),
    }
    docs = documents([(k, t) for k, (t, _) in cases.items()], {"kept": "theirs", "_w": 1, "n_words": 3})
    cleaned = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(cleaned) == {k for k, (_, stays) in cases.items() if stays}
    assert cleaned[2].text == prose and cleaned[2].n_chars == len(prose)
    assert cleaned[1].asDict()["kept"] == "theirs" and cleaned[1]["n_words"] == 3


def test_empty_table_and_nulls(documents):
    assert quality.clean(documents([])).count() == 0
    got = quality.judge(documents([(None, None, None, None, None), (1, "a", None, None, None)])).collect()
    assert [(r.n_words, r.kept) for r in got] == [(0, False), (1, False)]
