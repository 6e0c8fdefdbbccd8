from __future__ import annotations

import struct
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from diffmill.llm import token_counts, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b ", "a\nb", "a\n\nb", "a \nb", "a\n b", "a\n  b\n", "\ta\tb", "it's we'll I'M ''s !'s x's", "don't’t",
    "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> x", "<|startoftext|>ABC<|endoftext|>", "<|endoftext", "12 345 6.7", "²x½٠Ⅳ 一二", "ΑΣ ΣΑΣ İI", "é é", "x y  z", "a\x1cb \x1f c",
    "\x85a\x85 b", "\U0001f600 \U0001f468‍\U0001f469", "՘x ꟎", "snake_case __init__", "a\r\nb", "x" * 5000, "ab " * 3000, "a\u0000b", "　a　　b", "ééé, où? «oui»", "a\x0bb\x0c c",
]


def hard_rows():
    return [(i, x) for i, x in enumerate(HARD)] + [(900, None), (900, None), (None, "null id")]


def test_counts_are_those_of_the_library(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = hard_rows()
    docs = spark.createDataFrame([(a, b, 7, "x") for a, b in rows], "doc_id long, text string, n_tokens int, TEXT2 string")
    got = token_counts.token_counts(docs, BYTE, public_tokenizers.PATTERN, over=3).collect()
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 3) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_rows_and_sentencepiece(spark):
    import sentencepiece

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(empty, BYTE, public_tokenizers.PATTERN).collect() == []
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Hello there  friend"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()} == {1: len(model.encode("Hello there  friend")), 2: 0}
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, BYTE)


def test_counters_are_kept_by_pattern(spark):
    docs = spark.createDataFrame([(1, "it's we'll 12 345")], "doc_id long, text string").coalesce(1)
    for pattern in (public_tokenizers.PATTERN, r"\S|\s"):
        counter = tokens.ByteCounter(BYTE, pattern)
        assert [r.n_tokens for r in token_counts.token_counts(docs, BYTE, pattern).collect()] == [counter.count("it's we'll 12 345")]
    assert counter.count("it's we'll 12 345") == 17


def test_first_tier_is_exact_and_bounded():
    table = dict(token_counts.unpacked(token_counts.frequent_lengths(BYTE, public_tokenizers.PATTERN)))
    tok = Tokenizer.from_file(BYTE)
    assert 20_000 < len(table) <= tok.get_vocab_size()
    assert all(len(tok.encode(x, add_special_tokens=False).ids) == n for x, n in list(table.items())[::97])


def test_every_code_point_that_takes_the_fast_way():
    counter, words = tokens.ByteCounter(BYTE, public_tokenizers.PATTERN), tokens.WordEncoder(WORD)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    fast = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not tokens.UNSAFE.search(chr(c))]
    assert len(fast) > 30_000
    texts = ["".join(f"a{c}1{c}{c}B x {c} {c}{c}é\n" for c in fast[i : i + 200]) for i in range(0, len(fast), 200)]
    for text in texts:
        assert counter.plain(text) == len(byte.encode(text, add_special_tokens=False).ids), ascii(text[:80])
        ids = word.encode(text, add_special_tokens=False).ids
        assert words.plain(text) == struct.pack(f"<{len(ids)}I", *ids), ascii(text[:80])


def test_word_ids_are_those_of_the_library():
    words, tok = tokens.WordEncoder(WORD), Tokenizer.from_file(WORD)
    for text in [*HARD, unicodedata.normalize("NFD", "Éé ñ"), "Mixed CASE's 12,3"]:
        ids = tok.encode(text, add_special_tokens=False).ids
        assert words.ids(text) == struct.pack(f"<{len(ids)}I", *ids), ascii(text)
    assert words.ids(None) == b""


def test_caches_are_bounded_and_keep_what_is_frequent():
    seen = []
    memo = tokens.Memo(lambda x: seen.append(x) or len(x), most=6)
    for x in [*"abcabdabeabfabg"]:
        assert memo[x] == 1
    assert len(memo) <= 3 and len(memo.old) <= 3 and seen == [*"abcdefg"]
    assert memo["y" * 99] == 99 and "y" * 99 not in memo
