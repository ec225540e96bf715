import random

import pytest
from tessella.llm import token_counts
from tokenizers import Tokenizer

P = pytest.importorskip("public_tokenizers")
PIECES = ["don't", "I'll", "12", "a1b2", " ", "  ", "\n", "\n\n ", "\t", " ", "　", "\x1c", " ", "<|endoftext|>", "<|endof", "text|>", "。", "、", "漢字", "かな", "́", "é", "🙂", "...", "'s", "_", "--", "ſ", "᠎", "x", " y", "Ünder "]


def texts():
    r = random.Random(5)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(1, 120))) for _ in range(400)] + ["", "a" * 700, " " * 700, "word " * 300, "漢字。" * 200]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_pieces_add_up_to_the_whole(name):
    path = P.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda t: len(model.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        whole = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    counter, given = token_counts.Counter(path, piece=16), texts()
    assert counter.count(given) == [whole(t) for t in given]
    cut = [list(counter.pieces(t)) for t in given]
    if name.startswith("byte"):
        assert ["".join(c) for c in cut] == given
    if counter.safe:
        assert max(map(len, cut)) > 20
        assert max(len(c) for c in counter.pieces("word " * 300)) <= 16
    else:
        assert all(len(c) == 1 for c in cut)


def test_special_strings_are_never_cut():
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"), piece=4)
    counter.special.append("a b")
    assert all("a b" in x for t in ["xx a b a b yy"] for x in counter.pieces(t) if "a" in x)


def test_counts_of_a_table(spark, documents):
    rows = [(1, None), (2, ""), (3, "word " * 2000), (3, "word " * 2000), (None, "über"), (4, "<|endoftext|> x")]
    got = token_counts.count(documents(rows, {"n_bytes": 7, "n_tokens": "x"}), P.path("byte_bpe_50k.json"), piece=100)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    expected = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count(documents([(1, "a")]).filter("false"), P.path("byte_bpe_50k.json")).count() == 0
