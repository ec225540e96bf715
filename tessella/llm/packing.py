"""Packing along a space-filling curve.

1. Every whole text becomes token ids, with an end id behind them. The ids' hashed histogram, scaled to unit length, is
   projected onto a few fixed random directions; the quantised point's place on the Hilbert curve is the document's key.
2. Documents are range-sorted by (key, doc_id): neighbours along the curve stand next to each other. Since doc_id is part
   of the sort key, a group of equal texts, however large, spreads over as many partitions as it fills.
3. The sorted stream is cut every `length` ids. Where a document starts follows from running sums inside partitions and a
   table of partition totals, one row a partition. Only the last sequence is short; it is cut at powers of two.
Ids move once, to meet their document's place; what is sorted are three numbers a document.

Defined cases: a null or empty text is the end id alone. Rows with a null doc_id are packed too (sorted first). Repeated
rows, also with equal doc_id, are packed each for itself. Without documents there are no pieces. Other columns are
dropped. A text with the tokenizer's special strings gets the ids that its library gives by default.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import written

DIMENSIONS, BITS, BUCKETS = 3, 10, 512
LENGTH = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids by a byte-level BPE file of the tokenizers library.

    The file's vocabulary and splitting pattern are handed to tiktoken, which gives the same ids in a fifth of the time
    (the tests compare the two), as long as the file is of the kind that tiktoken can stand for: plain merges, ranked by their
    ids, after that splitting alone. Other files, and texts that hold a special token's string, go to tokenizers itself.
    """

    #: Fixed value: how byte-level BPE files split texts when they name no pattern of their own.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.quick = self._quick(json.loads(self.tokenizer.to_str()), special)

    def _quick(self, file: dict, special: list[str]):
        """tiktoken's encoding, or None if it couldn't give the same ids."""
        import tiktoken

        model, split = file["model"], file.get("pre_tokenizer") or {}
        ids = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model.get("merges", ())]
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (plain and not file.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)):
            return None
        if None in ids or ids != sorted(ids):
            return None
        byte = self._bytes_of_letters()
        ranks = {bytes(byte[c] for c in word): i for word, i in self.tokenizer.get_vocab().items() if word not in special}
        return tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes_of_letters() -> dict[str, int]:
        """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as letters from 256 on."""
        shown = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return self.plain(text) if self.quick is None or self.special.search(text) else self.quick.encode_ordinary(text)


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """The places of points (rows of unsigned integers below 2 ** bits) on the Hilbert curve."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        q = 1 << shift
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] & (1 << shift), flip ^ ((1 << shift) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> shift) & 1)
    return key


def _directions() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


def curve_keys(histograms: np.ndarray) -> np.ndarray:
    """Histograms (rows of BUCKETS counts) -> Hilbert keys; the scale is fixed, so a key depends on its row alone."""
    norms = np.maximum(np.linalg.norm(histograms, axis=1, keepdims=True), 1)
    at = (histograms / norms) @ _directions()
    cells = ((1 / (1 + np.exp(-1.7 * at))) * (1 << BITS)).astype(np.int64)
    return hilbert_key(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens (with the end id), curve, width (bytes an id), ids (deflated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, codec = Encoder(tokenizer), pa.Codec("zstd", 1)
        for batch in batches:
            n, widths, packed, histograms = [], [], [], np.zeros((len(batch), BUCKETS))
            for row, text in enumerate(batch["text"]):
                ids = np.array([*encoder.ids(text.as_py()), end_id], dtype="<u4")
                histograms[row] = np.bincount(ids % BUCKETS, minlength=BUCKETS)
                width = 2 if ids.max() < 65536 else 4
                n.append(len(ids))
                widths.append(width)
                packed.append(codec.compress(ids.astype(f"<u{width}").tobytes(), asbytes=True))
            made = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(curve_keys(histograms)), pa.array(widths, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_tokens", "curve", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, curve long, width int, ids binary")


def placed(tokens: DataFrame) -> DataFrame:
    """row, at: where each document begins in the stream of all documents along the curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far = 0
        for batch in batches:
            ends = batch.n_tokens.cumsum() + so_far
            yield pd.DataFrame({"row": batch.row, "part": batch.part, "n_tokens": batch.n_tokens, "local": ends - batch.n_tokens})
            so_far = int(ends.iloc[-1])

    light = tokens.select("row", "doc_id", "n_tokens", "curve").repartitionByRange("curve", "doc_id", "row").sortWithinPartitions("curve", "doc_id", "row")
    local = light.withColumn("part", F.spark_partition_id()).mapInPandas(run, "row long, part int, n_tokens long, local long")
    local = written(local, "packing-order")  # each reader must see the same partition numbers
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return local.join(F.broadcast(offsets), "part").select("row", (F.col("local") + F.col("offset")).alias("at"), "total")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    # the row number tells repeated rows apart; it must be the same for both readers, hence the table
    tokens = written(tokenized(docs, tokenizer).withColumn("row", F.monotonically_increasing_id()), "packing-ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                size, at, n = r["width"], r["at"], r["n_tokens"]
                ids = np.frombuffer(codec.decompress(r["ids"], n * size, asbytes=True), dtype=f"<u{size}").astype("<u4")
                for sequence, begin, end in spans(at, at + n, r["total"], length):
                    a, b = max(at, begin), min(at + n, end)
                    out.append((r["doc_id"], a - at, b - a, zlib.crc32(ids[a - at : b - at].tobytes()), n, sequence, a - begin))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    return tokens.drop("curve").join(placed(tokens), "row").mapInArrow(cut, PIECES)


def spans(at: int, end: int, total: int, length: int) -> Iterator[tuple[int, int, int]]:
    """The sequences (id, begin, end) that the stretch from at to end of a stream of `total` ids touches."""
    full = total // length
    for s in range(at // length, min(full, -(-end // length))):
        yield s, s * length, (s + 1) * length
    begin, s, rest = full * length, full, total - full * length
    while rest:  # the last ids: one sequence for each power of two in their number
        size = 1 << (rest.bit_length() - 1)
        if begin < end and at < begin + size:
            yield s, begin, begin + size
        begin, s, rest = begin + size, s + 1, rest - size
