"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives byte strings and their ranks.  The library works on characters, so each byte has a
character of its own (``byte_characters``), and the ranks become a vocabulary and merges:
of each entry all splits into two other entries, in the order of the ranks, so that the library merges
whatever pair has the lowest rank, as a rank encoder does.  Texts are cut by the split pattern first
and each match is encoded separately; no special tokens are known.

Decoding reverses the byte table: ids become the bytes of their entries, joined.  A character may be
split over several tokens: ``decode`` joins bytes before it reads characters, ``pieces`` holds
bytes back until their character is whole, and the character offsets of a token that begins or ends inside a
character cover all of it.

Defined results: a null or empty text has no tokens and decodes to no bytes.  Equal texts have equal
ids; repeated rows and null doc_id are kept as any other row.  Very long texts are read whole, about 4 MB
(one text at least) at a time; those of more than ``PART`` characters are encoded in parts that end
before white space, where a match ends in any case, so ids don't change.  An empty table gives an empty table.  Other
columns are not read, whatever their names.  A rank file that lacks one of the 256 bytes is an
error; ids outside the table are an error in decoding, and a null list of ids decodes to null.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import arrow_map, slices

#: Characters of a text that are encoded at once.
PART = 1 << 20
_BREAK = re.compile(r"(?<=\S)(?=[ \n\t\r])")


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable Latin-1, else the next of U+0100 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    out = [ranks.get(i) for i in range(len(ranks))]
    if None in out or not {bytes([b]) for b in range(256)} <= set(out):
        raise ValueError(f"{path}: ranks have gaps, or a byte has no rank")
    return out


def tokenizer_json(entries: list[bytes], pattern: str) -> str:
    """The library's form of the ranks and the split pattern."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    char = byte_characters()
    named = {e: "".join(char[b] for b in e) for e in entries}
    merges = [(named[e[:i]], named[e[i:]]) for e in entries for i in range(1, len(e)) if e[:i] in named and e[i:] in named]
    out = Tokenizer(models.BPE(vocab={named[e]: i for i, e in enumerate(entries)}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out.to_str()


class Codec:
    """Encodes and decodes texts; made once for each Python worker."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.bytes = [b""] * len(vocab)
        for name, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in name)
        self.widths = np.array([len(b) for b in self.bytes])
        self.shown = [str(i) for i in range(len(vocab))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [_parts(t) for t in texts]
        coded = iter(self.tokenizer.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False))
        out = []
        for ps in parts:
            ids: list[int] = next(coded).ids if ps else []
            for _ in ps[1:]:
                ids += next(coded).ids
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each token completes: a split character stands at its last token, bytes of none become U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes[i], j == len(ids) - 1) for j, i in enumerate(ids)]

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.widths[ids]) if ids else np.zeros(0, dtype=np.int64)
        return (char[end - self.widths[ids]], char[end - 1] + 1) if ids else (end, end)


def _parts(text: str) -> list[str]:
    """``text`` in parts of about ``PART`` characters that end before white space after a character that is none: no match of the pattern goes over such a place."""
    if len(text) <= PART:
        return [text] if text else []
    out, start = [], 0
    while len(text) - start > PART:
        cut = _BREAK.search(text, start + PART)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


_HELD: dict[int, Codec] = {}


def _codec(spec: Broadcast) -> Codec:
    key = hash(spec.value)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Codec(spec.value)
    return _HELD[key]


def _spec(spark: SparkSession, ranks: str | None, pattern: str | None) -> Broadcast:
    """The vocabulary, whose size doesn't depend on the texts."""
    import public_tokenizers

    return spark.sparkContext.broadcast(tokenizer_json(read_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends (character offsets of each token) of every row."""
    spec = _spec(docs.sparkSession, ranks, pattern)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = _codec(spec)
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            ids = codec.encode(texts)
            at = [codec.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
            yield {"doc_id": part.column("doc_id"), "ids": ids, "starts": [a for a, _ in at], "ends": [z for _, z in at]}

    return arrow_map(_texts(docs), run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def decode(coded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes, text (bytes of no character become U+FFFD), pieces (the text that each token completes) of rows of ids."""
    spec = _spec(coded.sparkSession, ranks, pattern)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = _codec(spec)
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids = part.column("ids").to_pylist()
            raw = [None if x is None else codec.decode(x) for x in ids]
            yield {"doc_id": part.column("doc_id"), "bytes": raw, "text": [None if r is None else r.decode("utf-8", "replace") for r in raw], "pieces": [None if x is None else codec.pieces(x) for x in ids]}

    return arrow_map(coded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id bigint, bytes binary, text string, pieces array<string>")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 (of the bytes decoded from the ids) of every row."""
    spec = _spec(docs.sparkSession, ranks, pattern)
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        codec = _codec(spec)
        for part in slices(batch, "text", 1 << 20):
            ids = codec.encode(part.column("text").to_pylist())
            shown = [digest(" ".join([codec.shown[i] for i in x]).encode()) for x in ids]
            yield {"doc_id": part.column("doc_id"), "n_tokens": [len(x) for x in ids], "ids_sha256": shown, "decoded_sha256": [digest(codec.decode(x)) for x in ids]}

    return arrow_map(_texts(docs), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
