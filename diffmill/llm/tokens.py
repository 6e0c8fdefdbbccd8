"""Tokenising on workers with caches: what token counts and packing share.

Both tokenizers split a text into pre-tokens that are encoded independently, so the ids of a text are those of its
chunks as long as no pre-token crosses a chunk's edge. A worker keeps the result of each chunk it has met.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts with other code points are encoded whole: there, Unicode tables of the libraries differ by their version.
#: The information separators 1C to 1F are left out, as are the surrogates: white space to Python, not to the tokenizer.
UNSAFE = re.compile(r"[^\x00-\x1b\x20-՗ -ⁿ₠-⃀℀-ↈ←-➿　ぁ-ゖァ-ヾ一-龥가-힣\U0001f300-\U0001f64f]")
PAIR = re.compile(r"\s\s")
ODD_SPACE = re.compile(r"[^\S\n ]")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Entries of each worker cache. A full one forgets what it met least recently: that costs time and no correctness.
CACHE = 300_000
#: Marks that are a pre-token of their own after a word.
MARKS = frozenset(".,;:!?")
#: Longer chunks are not kept.
LONGEST = 64


class Memo(dict):
    """A bounded cache of two generations: when the young one is full it becomes the old one, and what is met again moves
    back, so frequent keys stay. f gives the value of a key that neither holds."""

    def __init__(self, f: Callable, most: int = CACHE):
        self.f, self.most, self.old = f, max(most // 2, 1), {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.f(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others move past 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(moved)}


_BYTES = byte_alphabet()


def as_symbols(piece: str) -> str:
    """A pre-token as its model sees it: the stand-ins of its bytes, which printable ASCII itself is."""
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    return piece.encode().decode("latin-1").translate(_BYTES)


def specials(path: str) -> re.Pattern | None:
    """A pattern of the added tokens' strings, which the library finds before it splits anything else."""
    added = json.load(open(path, encoding="utf-8")).get("added_tokens", [])
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
        raise ValueError("added tokens with options are not supported")
    return re.compile("|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None


class ByteCounter:
    """Numbers of tokens of whole texts, for a byte-level BPE that splits by the pattern given.

    frequent: (pre-token, length) pairs, the first tier. The second is a cache of what this worker has encoded.
    """

    def __init__(self, path: str, pattern: str, frequent: Iterable[tuple[str, int]] = ()):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.special = specials(path)
        self.find = regex.compile(pattern).findall
        self.frequent = dict(frequent)
        self.pre = Memo(lambda piece: len(self.model.tokenize(as_symbols(piece))))
        self.lead = Memo(self.chunk)
        self.inner = Memo(lambda part: self.chunk(" " + part))

    def encode(self, piece: str) -> int:
        return len(self.tok.encode(piece, add_special_tokens=False).ids)

    def chunk(self, text: str) -> int:
        frequent, pre, n = self.frequent, self.pre, 0
        for piece in self.find(text):
            n += frequent.get(piece) or pre[piece]
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if UNSAFE.search(text):
            return self.encode(text)
        if self.special and self.special.search(text):
            return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))
        return self.plain(text)

    def plain(self, text: str) -> int:
        """A text without strings of special tokens. Chunks end before a space between two other characters, and at
        line feeds between two other characters: there no pre-token crosses."""
        if not text:
            return 0
        if text[0].isspace() or text[-1].isspace() or PAIR.search(text) or ODD_SPACE.search(text):
            first, *rest = SAFE_CUT.split(text)
            return self.lead[first] + sum(map(self.inner.__getitem__, rest))
        lines = text.split("\n")
        n = (len(lines) - 1) * self.lead["\n"]
        lead, inner = self.lead, self.inner.__getitem__
        for line in lines:
            first, *rest = line.split(" ")
            n += lead[first] + sum(map(inner, rest))
        return n


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, for a BPE that drops white space and lower-cases.

    White space ends a chunk, a chunk is cut into words by the tokenizer's own pattern, and a word that the cache doesn't
    hold is given to the tokenizer's model.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.special = specials(path)
        split = json.load(open(path, encoding="utf-8"))["pre_tokenizer"]["pretokenizers"][0]
        if (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError("a pattern of the words to keep is needed")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.memo = Memo(self.chunk, 2 * CACHE)
        self.packed = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]

    def chunk(self, chunk: str) -> bytes:
        """Most chunks are a word, or one and a mark after it; only others are cut by the pattern."""
        if chunk.isalpha():
            return self.word(chunk)
        if chunk[-1] in MARKS and chunk[:-1].isalpha():
            return self.memo[chunk[:-1]] + self.memo[chunk[-1]]
        pieces = self.find(chunk)
        return self.word(chunk) if pieces == [chunk] else b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[x.id] for x in self.model.tokenize(as_symbols(word))])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if UNSAFE.search(text):
            return self.encode(text)
        if self.special and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [self.plain(text[at : m.start()]), self.tok.token_to_id(m[0]).to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self.plain(text[at:])])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Normalised as the tokenizer does it (Python gives a final sigma of its own), then by words between white space."""
        flat = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.memo.__getitem__, flat.lower().split()))


_KEPT: dict = {}


def once(key: tuple, make: Callable):
    """One object for each worker process and key."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]
