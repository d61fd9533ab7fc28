"""Token ids of whole texts.

The vocabulary's own library encodes.  Where its normaliser and pre-tokeniser
are known to work word by word, each distinct token of the pre-tokeniser is encoded
once and looked up afterwards; every other text goes through the library as it is.
Plain texts are cut many at a time: each distinct token among them is looked up once.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

KNOWN_WORDS = 600_000  # twice as many are kept
PART_CHARS = 1 << 20

# Fixed values of the vocabulary file: what makes its words independent of each other.
_NORMALIZER = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Characters for which the rules above are plain: no combining marks, no odd case pairs.
_LETTERS = "a-zß-öø-ÿĀ-įı-ňŊ-ž"
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
_PLAIN_TEXT = re.compile("[ \t\n\v\f\r!-~À-ÖØ-öø-įı-ňŊ-ž]*")
_TOKENS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9{_LETTERS}]+")
# The same rules on the bytes of plain texts in lower case, where all beyond ASCII are letters:
# 0 space, 1 letter, 2 digit, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*b" \t\n\v\f\r"]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = 1
_KIND[[*b"0123456789"]] = 2
# The characters that stand for bytes: printable ones for themselves, the others from 256 on.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _KEPT} | {
    b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_KEPT)))}
_OTHER_SPACE = re.compile(
    "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _word_by_word(tokenizer: Tokenizer) -> bool:
    rules = json.loads(tokenizer.to_str())
    normalizer = rules["normalizer"] or {}
    first, *rest = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return (
        normalizer.get("normalizers") == _NORMALIZER
        and first.get("pattern") == {"Regex": _SPLIT}
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest]
        == [("ByteLevel", False, False)]
        and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"])


def _cut(data: np.ndarray) -> np.ndarray:
    """Where the tokens of plain texts in lower case begin: ``_TOKENS`` on their bytes."""
    kind = _KIND[data]
    begins = kind != 0
    begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # An apostrophe that begins a token takes the ending after it, and letters go on as a new token.
    quote = np.flatnonzero((data == ord("'")) & begins)
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [*b"stmd"])
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | (
        (one == ord("l")) & (two == ord("l")))
    for found, size in ((short, 1), (long, 2)):
        begins[quote[found] + 1] = False
        after = quote[found] + 1 + size
        after = after[after < len(data)]
        begins[after[kind[after] == 1]] = True
    return begins


class _Known(dict):
    """Encoded words or tokens; a missing one is encoded.

    A full table is set aside and a new one begun.  What is looked up again moves over from the old
    table, so only words that weren't used for a whole table are forgotten.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.old = dict(self)
            self.clear()
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _word_by_word(self.tokenizer)
        self.model = self.tokenizer.model
        self.tokens = _Known(self._token)
        self.words = _Known(self._word)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _token(self, token: str) -> bytes:
        if not token.isascii():
            token = "".join(map(_BYTE_CHARS.__getitem__, token.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(token)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word or not _PLAIN.fullmatch(word):
            return self._whole(word)
        known = self.tokens
        return b"".join([known[t] for t in _TOKENS.findall(word.lower())])

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of ``text``, a part at a time."""
        if not self.by_word or _OTHER_SPACE.search(text):
            yield self._whole(text)
            return
        at = 0
        while at < len(text):
            end = at + PART_CHARS
            while end < len(text) and text[end] not in " \t\n\v\f\r":
                end += 1
            part = text[at:end]
            if "<|" not in part and _PLAIN_TEXT.fullmatch(part):
                yield b"".join(map(self.tokens.__getitem__, _TOKENS.findall(part.lower())))
            else:
                yield b"".join(map(self.words.__getitem__, part.split()))
            at = end

    def encode_all(self, texts: Sequence[str]) -> Iterator[Iterable[bytes]]:
        """The ids of each text in turn, a part at a time."""
        plain = [self.by_word and len(t) <= PART_CHARS and "<|" not in t
                 and _PLAIN_TEXT.fullmatch(t) is not None for t in texts]
        found = iter(self._plain([t for t, is_plain in zip(texts, plain) if is_plain]))
        for text, is_plain in zip(texts, plain):
            yield (next(found),) if is_plain else self.encode(text)

    def _plain(self, texts: list[str]) -> list[bytes]:
        lowered = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(lowered), np.uint8)
        if not len(data):
            return [b""] * len(texts)
        begins = _cut(data)
        kept = _KIND[data] != 0
        # Without the spaces the tokens follow each other, as in an Arrow column.
        edges = np.append(np.flatnonzero(begins[kept]), np.count_nonzero(kept)).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.string(), len(edges) - 1, [
            None, pa.py_buffer(edges), pa.py_buffer(data[kept])]).dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(tokens.dictionary)], tokens.dictionary)
        known = list(map(self.tokens.__getitem__, pc.binary_join(distinct, " ")[0].as_py().split()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        firsts = np.cumsum(sizes) - sizes
        token = tokens.indices.to_numpy()
        counts = sizes[token]
        ends = np.concatenate(([0], np.cumsum(counts)))
        at = np.repeat(firsts[token] - ends[:-1], counts) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(known), "<u4")[at].tobytes()
        lengths = np.array([len(t) + 1 for t in lowered])
        starts = np.cumsum(lengths) - lengths
        # The ids before each text, from the tokens before it.
        before = ends[np.searchsorted(np.flatnonzero(begins), starts)]
        before = (4 * np.append(before, ends[-1])).tolist()
        return [ids[a:b] for a, b in zip(before, before[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
