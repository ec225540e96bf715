"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths leave them.

A task reads its texts as Arrow batches and deals them into encoding batches of about BATCH bytes, whatever the number of
texts: many short ones fill a batch together, a long one is split into pieces that fill several. Pieces end at safe
boundaries only, where the tokenizer itself begins anew whatever stands on the other side, so the lengths of a text's
pieces add up to the length of the whole:

* byte-level files with the usual splitting: before a space or line end behind a visible character, and between an ideograph
  or kana and ideographic punctuation. No special token's string may reach over the boundary.
* sentencepiece files without pieces that go on behind a space: at one space between two ASCII letters; the space itself
  goes, as the library puts one before every text.
* other files: nowhere, so that a text is encoded whole.

Where a text has no safe boundary for a while, its piece is longer; nothing is ever cut elsewhere. As in packing, tiktoken stands for a byte-level file where it gives the same ids, in a
fraction of the time; pieces with special tokens' strings go to the file's own library. Nothing is shuffled: a
task's share are the bytes of its input split.

Defined cases: a null or empty text has no bytes and no tokens. Repeated rows and ids, null ids included, are counted each
for itself; without rows there is no row. Special tokens' strings count as the library reads them by default. Other columns
are dropped.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import Encoder

#: Characters of a piece at most, where boundaries allow; bytes of an encoding batch.
PIECE, BATCH = 1 << 16, 1 << 18
LIMIT = 1024

_AT_GAPS = re.compile(r"(?<=[!-~\w])(?=[ \n])|(?<=[一-龥ぁ-ゖァ-ヺ])(?=[、。！，？])")
_AT_SPACES = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Counter:
    """Lengths of texts by one tokenizer file: .model is sentencepiece's, others are those of tokenizers."""

    def __init__(self, path: str, piece: int = PIECE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.piece, self.special = piece, []
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            crossing = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.vocab_size()))
            self.safe = None if crossing or model.encode("a b") != model.encode("a") + model.encode("b") else _AT_SPACES
        else:
            encoder = Encoder(path)
            tokenizer, quick = encoder.tokenizer, encoder.quick
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            if quick:
                plain_lengths, special = self.lengths, encoder.special

                def lengths(texts: list[str]) -> list[int]:
                    out = [len(x) for x in quick.encode_ordinary_batch(texts, num_threads=1)]
                    other = [i for i, t in enumerate(texts) if special.search(t)]
                    for i, n in zip(other, plain_lengths([texts[i] for i in other]) if other else (), strict=True):
                        out[i] = n
                    return out

                self.lengths = lengths
            file = json.loads(tokenizer.to_str())
            split, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
            usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            plain = not file.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            self.safe = _AT_GAPS if usual and plain else None
            self.special = [t["content"] for t in added]

    def _is_safe(self, text: str, begin: int, end: int) -> bool:
        """Whether no special token's string reaches over the boundary."""
        return not any((k := text.find(s, max(0, begin - len(s) + 1), begin + len(s) - 1)) >= 0 and k < begin and k + len(s) > begin for s in self.special if len(s) > 1)

    def pieces(self, text: str) -> Iterator[str]:
        """The text, split at safe boundaries."""
        at = 0
        while self.safe and len(text) - at > self.piece:
            # the last one of the second half, else the first behind
            near = [m.span() for m in self.safe.finditer(text, at + self.piece // 2, at + self.piece)]
            cut = next((x for x in reversed(near) if self._is_safe(text, *x)), None)
            cut = cut or next((m.span() for m in self.safe.finditer(text, at + self.piece) if self._is_safe(text, *m.span())), None)
            if not cut:
                break
            yield text[at : cut[0]]
            at = cut[1]
        yield text[at:]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, by batches of about BATCH bytes."""
        totals, batch, of, size = [0] * len(texts), [], [], 0

        def flush() -> None:
            for i, n in zip(of, self.lengths(batch) if batch else (), strict=True):
                totals[i] += n
            batch.clear()
            of.clear()

        for i, text in enumerate(texts):
            for piece in self.pieces(text or ""):
                if not piece:
                    continue
                batch.append(piece)
                of.append(i)
                size += len(piece.encode())
                if size >= BATCH:
                    flush()
                    size = 0
        flush()
        return totals


def count(docs: DataFrame, path: str, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path, piece)
            made = pa.array(counter.count(batch["text"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], made], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
