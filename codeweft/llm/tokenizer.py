"""Byte-level BPE of a public tokenizer as a bounded-lookahead streaming transducer.

Three exact facts make streaming possible:

* a merge only ever yields a token of the vocabulary, so between two bytes that stand side by side in no token there
  is always a token boundary: everything before it is final with one byte of lookahead;
* where no such boundary comes, the last token of the encoding of a prefix lies within the longest token's length of
  its end; every future encoding passes through one of the prefixes in that window, so a token is final as soon as
  the encodings of all prefixes in the window share it;
* the pre-tokenizer's pattern looks at most two pieces back from the end of what has been read.

The memory of :class:`StreamEncoder` is hence a window and the undecided pieces, not the text.
"""

from __future__ import annotations

import base64
import os
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: The pre-tokenizer's pattern; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS_KEPT = 200_000
SEGMENT_BYTES = 192


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary lies; ``CODEWEFT_TOKENIZERS`` names another folder."""
    folder = os.environ.get("CODEWEFT_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


LETTER, NUMBER, OTHER, SPACE, BREAK = range(5)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The pattern's class of each code point."""
    kinds = bytearray([OTHER]) * (sys.maxunicode + 1)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(c := chr(code))[0]
        if kind == "L":
            kinds[code] = LETTER
        elif kind == "N":
            kinds[code] = NUMBER
        elif c.isspace() and not 0x1C <= code < 0x20:
            kinds[code] = SPACE
    return np.frombuffer(bytes(kinds), np.uint8)


def piece_starts(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where PATTERN begins a piece, over many texts at once; ``breaks`` are positions that stand between two texts.

    Runs of one class are pieces. A space joins the run behind it, so a longer run of white space gives its last
    character away; an apostrophe that begins a run splits off a contraction.
    """
    kind = _classes()[codes]
    kind[breaks] = BREAK
    before = np.empty_like(kind)
    before[0], before[1:] = BREAK, kind[:-1]
    blank = codes == 32
    blank[breaks] = False
    joined = np.zeros(len(kind), bool)
    joined[1:] = blank[:-1]
    start = (kind != before) | (kind == BREAK)
    start &= ~(joined & (kind < SPACE))
    last = np.zeros(len(kind), bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] < SPACE)
    start |= last
    for at in np.flatnonzero((codes == 39) & (kind == OTHER) & start).tolist():
        for word in CONTRACTIONS:
            end = at + 1 + len(word)
            if end <= len(codes) and codes[at + 1 : end].tolist() == word and (kind[at + 1 : end] != BREAK).all():
                start[at + 1 : end] = False
                if end < len(codes):
                    start[end] = True
                break
    return np.flatnonzero(start)


#: The contractions of PATTERN in its order; fixed values.
CONTRACTIONS = [[*map(ord, w)] for w in ("s", "t", "re", "ve", "m", "ll", "d")]


class BPE:
    """The merge list and what is computed from it once: side-by-side bytes, tokens by last byte, the longest token."""

    def __init__(self, path: str | None = None):
        self.ranks = load_ranks(path or default_path())
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        inside = np.zeros((256, 256), dtype=bool)
        for t in self.ranks:
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                inside[a[:-1], a[1:]] = True
        self.inside = inside
        bpe = self

        class Words(dict):
            def __missing__(self, word: str) -> tuple[int, ...]:
                if len(self) >= WORDS_KEPT:
                    self.clear()
                ids = self[word] = tuple(bpe.encode_bytes(word.encode("utf-8", "replace")))
                return ids

        class Sizes(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= WORDS_KEPT:
                    self.clear()
                n = self[word] = len(bpe.words[word])
                return n

        self.words, self.sizes, self.segments = Words(), Sizes(), {}

    def pieces(self, text: str) -> list[str]:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(codes, np.empty(0, np.int64)).tolist() if len(codes) else []
        return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]

    def batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The pieces of many texts and, for each text, how many of them are its own."""
        joined = "\n".join(t or "" for t in texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.cumsum([len(t or "") + 1 for t in texts]) - 1
        starts = piece_starts(codes, breaks)
        ends = np.append(starts[1:], len(codes))
        own = np.searchsorted(starts, breaks) - np.arange(len(texts))  # pieces before each break, without breaks
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, breaks)] = False
        pieces = [joined[a:b] for a, b in zip(starts[real].tolist(), ends[real].tolist())]
        return pieces, np.diff(own, prepend=0)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end."""
        short = [t if t is not None and len(t) <= StreamEncoder.BLOCK else None for t in texts]
        pieces, own = self.batch(short)
        ids = list(map(self.words.__getitem__, pieces))
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        ends = upto[np.cumsum(own)]
        if long := [k for k, (t, s) in enumerate(zip(texts, short)) if t is not None and s is None]:
            parts = np.split(flat, ends[:-1])
            for k in long:
                parts[k] = np.array(self.encode(texts[k]), np.int32)
            flat, ends = np.concatenate(parts), np.cumsum([*map(len, parts)])
        return flat, ends

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        short = [t if t is not None and len(t) <= StreamEncoder.BLOCK else None for t in texts]
        pieces, own = self.batch(short)
        sizes = np.fromiter(map(self.sizes.__getitem__, pieces), np.int64, len(pieces))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(upto[np.cumsum(own)], prepend=0)
        for k, (t, s) in enumerate(zip(texts, short)):
            if t is not None and s is None:
                counts[k] = self.count(t)
        return counts

    def cuts(self, data: bytes) -> list[int]:
        """Positions between two bytes that no token holds side by side: certain token boundaries."""
        a = np.frombuffer(data, np.uint8)
        return (np.flatnonzero(~self.inside[a[:-1], a[1:]]) + 1).tolist()

    def _merge(self, data: bytes) -> list[int]:
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _segment(self, data: bytes) -> list[int]:
        if len(data) > SEGMENT_BYTES:
            run = RunEncoder(self)
            return [*run.feed(data), *run.finish()]
        ids = self.segments.get(data)
        if ids is None:
            if len(self.segments) >= WORDS_KEPT:
                self.segments.clear()
            ids = self.segments[data] = self._merge(data)
        return ids

    def encode_bytes(self, data: bytes) -> list[int]:
        """One pre-token."""
        if data in self.ranks and len(data) < 3:
            return [self.ranks[data]]
        if len(data) < 12:
            return self._merge(data)
        ends = [*self.cuts(data), len(data)]
        return [i for a, b in zip([0, *ends], ends) for i in self._segment(data[a:b])]

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no tokens."""
        if not text:
            return []
        if len(text) > StreamEncoder.BLOCK:
            run = StreamEncoder(self)
            blocks = (text[i : i + run.BLOCK] for i in range(0, len(text), run.BLOCK))
            return [*chain.from_iterable(map(run.feed, blocks)), *run.finish()]
        return list(chain.from_iterable(map(self.words.__getitem__, self.pieces(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > StreamEncoder.BLOCK:
            run, n = StreamEncoder(self), 0
            for i in range(0, len(text), run.BLOCK):
                n += len(run.feed(text[i : i + run.BLOCK]))
            return n + len(run.finish())
        return sum(map(self.sizes.__getitem__, self.pieces(text)))


class RunEncoder:
    """One pre-token of any length, byte by byte: keeps the last token of each prefix within a window.

    Two neighbouring tokens may stand together in an encoding exactly if merging their joined bytes gives the two back.
    Exactly one token that ends at a prefix's end may follow the encoding before it, so each prefix has one last token.
    """

    def __init__(self, bpe: BPE):
        self.bpe, self.start = bpe, 0
        self.data = bytearray()
        self.last: list[bytes] = []  # the last token of the prefix that ends behind data[k]
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def _fits(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 50_000:
                self.fits.clear()
            r = self.bpe.ranks
            known = self.fits[a, b] = self.bpe._merge(a + b) == [r[a], r[b]]
        return known

    def _step(self) -> None:
        end = len(self.data)
        for n in range(min(self.bpe.longest, end), 0, -1):
            token = bytes(self.data[end - n : end])
            if token in self.bpe.ranks and self.bpe._merge(token) == [self.bpe.ranks[token]]:
                if n == end:
                    if self.start and not self._fits(self.before, token):
                        continue
                elif not self._fits(self.last[end - n - 1], token):
                    continue
                self.last.append(token)
                return
        raise AssertionError("every byte is a token")

    before: bytes = b""

    def _back(self, end: int, until: int = 0) -> list[bytes]:
        out = []
        while end > until:
            out.append(self.last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for byte in data:
            self.data.append(byte)
            self._step()
            if len(self.data) > 3 * self.bpe.longest:
                out += self._settle()
        return out

    def _settle(self) -> list[int]:
        """Tokens that the encodings of all prefixes in the window share."""
        size, low = len(self.data), len(self.data) - self.bpe.longest
        marks = None
        for end in range(low, size + 1):
            at, seen = end, {0}
            while at > 0:
                seen.add(at)
                at -= len(self.last[at - 1])
            marks = seen if marks is None else marks & seen
        upto = max(m for m in marks if m <= low)
        tokens = self._back(upto)
        if tokens:
            self.before, self.start = tokens[-1], self.start + upto
            del self.data[:upto], self.last[:upto]
        return [self.bpe.ranks[t] for t in tokens]

    def finish(self) -> list[int]:
        tokens = self._back(len(self.data))
        self.data.clear(), self.last.clear()
        return [self.bpe.ranks[t] for t in tokens]


class StreamEncoder:
    """Text in blocks to ids; keeps back the two pieces at the end whose bounds later text may still move."""

    BLOCK = 1 << 16

    def __init__(self, bpe: BPE):
        self.bpe, self.kept = bpe, ""
        self.run: RunEncoder | None = None

    def feed(self, block: str) -> list[int]:
        out: list[int] = []
        if self.run is not None:  # inside a piece longer than a block
            same = self.inner.match(block)
            out += self.run.feed(same.group().encode("utf-8", "replace"))
            if same.end() == len(block):
                return out
            out += self.run.finish()
            self.run, block = None, block[same.end() :]
        text = self.kept + block
        pieces = self.bpe.pieces(text)
        done, rest = pieces[:-2], pieces[-2:]
        if rest and len(rest[-1]) > self.BLOCK // 2 and not rest[-1].isspace():
            c = rest[-1].lstrip(" ")[0]
            kind = r"\p{L}*" if regex.match(r"\p{L}", c) else r"\p{N}*" if regex.match(r"\p{N}", c) else r"[^\s\p{L}\p{N}]*"
            self.inner, self.run = regex.compile(kind), RunEncoder(self.bpe)
            done, self.kept = pieces[:-1], ""
            out += chain.from_iterable(map(self.bpe.words.__getitem__, done))
            return out + self.run.feed(rest[-1].encode("utf-8", "replace"))
        self.kept = "".join(rest)
        return out + list(chain.from_iterable(map(self.bpe.words.__getitem__, done)))

    def finish(self) -> list[int]:
        if self.run is not None:
            out, self.run = self.run.finish(), None
            return out
        out = list(chain.from_iterable(map(self.bpe.words.__getitem__, self.bpe.pieces(self.kept))))
        self.kept = ""
        return out


class StreamDecoder:
    """Ids to text, one at a time: a state machine over UTF-8 that holds at most three bytes of an open character."""

    def __init__(self, bpe: BPE):
        self.bpe, self.open = bpe, b""

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        for i in ids:
            data, text, at = self.open + self.bpe.tokens[i], "", 0
            while at < len(data):
                b = data[at]
                n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
                if n and at + n > len(data) and all(0x80 <= x < 0xC0 for x in data[at + 1 :]):
                    break
                try:
                    text += data[at : at + n].decode() if n else "�"
                    at += n or 1
                except UnicodeDecodeError:
                    text, at = text + "�", at + 1
            self.open = data[at:]
            if text:
                yield text

    def finish(self) -> str:
        out, self.open = "�" * bool(self.open), b""
        return out


@lru_cache(2)
def shared(path: str | None = None) -> BPE:
    """One vocabulary for each Python worker."""
    return BPE(path)
