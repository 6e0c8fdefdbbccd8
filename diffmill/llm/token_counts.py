"""Token counts of whole texts by a two-tier lookup on the map side.

The first tier is a table of pre-token lengths, built once on the driver and broadcast in a compact form. Its
pre-tokens are the vocabulary's own entries, which are the frequent pre-tokens by how such a vocabulary comes about; its
size is bounded by the vocabulary, whatever the corpus holds. Pre-tokens that it misses are encoded by the library and
kept in a bounded cache of the worker process. Nothing is shuffled: each row's count is made where the row is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm import tokens
from diffmill.llm.common import table

OVER = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_lengths(path: str, pattern: str) -> bytes:
    """The first tier, compressed: a line for each length, the pre-tokens in it ended by the code point 0.

    An entry of the vocabulary is taken if its bytes are text that is one pre-token; its length is what the library gives.
    """
    import regex
    from tokenizers import Tokenizer

    tok, alphabet, find = Tokenizer.from_file(path), {c: b for b, c in tokens.byte_alphabet().items()}, regex.compile(pattern).fullmatch
    texts = []
    for entry in tok.get_vocab(with_added_tokens=False):
        try:
            text = bytes(alphabet[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if find(text) and "\0" not in text and not tokens.UNSAFE.search(text) and len(regex.findall(pattern, text)) == 1:
            texts.append(text)
    texts.sort()
    lengths = [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return zlib.compress(bytes(lengths) + b"\0" + "\0".join(texts).encode())


def unpacked(packed: bytes) -> Iterator[tuple[str, int]]:
    lengths, _, texts = zlib.decompress(packed).partition(b"\0")
    return zip(texts.decode().split("\0"), lengths, strict=True) if lengths else iter(())


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str | None, packed, over: int, key: tuple) -> Iterator[pa.RecordBatch]:
    def make():
        return tokens.ByteCounter(path, pattern, unpacked(packed.value))

    counter = tokens.once(("count", key), make) if pattern else tokens.once(("piece", key), lambda: _Pieces(path))
    for batch in batches:
        texts = batch.column(1)
        n = pa.array((counter.count(x.as_py()) for x in texts), pa.int64())
        sizes = pa.array((len(x.as_buffer() or b"") if x.is_valid else 0 for x in texts), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pa.array((k > over for k in n.to_pylist()), pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


class _Pieces:
    """Counts by sentencepiece, whose pieces may cross words: whole texts are encoded."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str | None) -> int:
        return len(self.model.encode(text)) if text else 0


def token_counts(docs: DataFrame, tokenizer: str, pattern: str | None = None, over: int = OVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > over).

    tokenizer: path of a byte-level BPE (.json, with the pattern of its pre-tokens) or of a sentencepiece .model, found at
    the same path on all workers. Null and empty texts have 0 bytes and 0 tokens. Strings of special tokens inside a text
    count as the library counts them by default. Repeated rows and null ids are returned as they are; no rows give none.
    Other columns are not read.
    """
    spark = docs.sparkSession
    if not tokenizer.endswith(".model") and not pattern:
        raise ValueError("a .json tokenizer needs the pattern of its pre-tokens")
    use = None if tokenizer.endswith(".model") else pattern
    packed = spark.sparkContext.broadcast(frequent_lengths(tokenizer, use) if use else b"")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_count, path=tokenizer, pattern=use, packed=packed, over=over, key=(tokenizer, use)), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the whole documents table, by the byte-level BPE."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
