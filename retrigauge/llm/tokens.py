"""Whole-text tokenization by a public word BPE vocabulary, one encoding per distinct word.

White space always separates pre-tokens of this vocabulary, so a text's ids are its words' ids in
order. Words of plain letters and punctuation take a byte-pair route that gives the same ids (checked
against the tokenizer in the tests); all others go to the tokenizer itself.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "word_bpe_49k.json"
#: Distinct words and word pieces kept by a worker before its cache starts anew; bounds memory, never results.
CACHE_WORDS, CACHE_PIECES = 350_000, 150_000

_PLAIN = regex.compile("[!-~¡¿-ÖØ-öø-ÿ]+")
#: The vocabulary's pre-token pattern.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same over joined plain words: each line break is a match of its own.
_PIECES = regex.compile(_PIECE.pattern + r"|\n")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")
_END = "</w>"


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable bytes as themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _gathered(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of lists `at` stand, in order, if list i is starts[i] to starts[i + 1]; entries per list."""
    first = starts[at]
    counts = starts[at + 1] - first
    shift = np.repeat((first - np.cumsum(counts) + counts).astype(np.int32), counts)
    shift += np.arange(len(shift), dtype=np.int32)
    return shift, counts


class WordTokenizer:
    """ids and character spans of words; spans count code points from the word's start."""

    def __init__(self, path: str, spans: bool = False):
        self.with_spans = spans
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.merger = self._merger(path)
        self.clear_pieces()
        self.clear()

    def clear_pieces(self) -> None:
        """Piece 0 is the line break between words, which has no ids."""
        self.pieces: dict[str, int] = {"\n": 0}
        self.piece_ids = np.zeros(0, np.uint32)
        self.piece_starts = np.zeros(2, np.int64)

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.span_start = self.span_end = np.zeros(0, np.int32)

    def release(self) -> None:
        """Caches empty and their memory back to the machine: idle workers live on beside the stages that follow."""
        self.clear_pieces()
        self.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    def _merger(self, path: str):
        """The same merges for tiktoken: a word's end is the byte 255, which no UTF-8 text has."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, ranks = _byte_letters(), {}
        for token, at in model["vocab"].items():
            body, end = (token[: -len(_END)], b"\xff") if token.endswith(_END) else (token, b"")
            if all(c in letters for c in body):
                ranks[bytes(letters[c] for c in body) + end] = at
        for i, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            if model["vocab"][left + right] != 512 + i:
                raise ValueError("merges are not in the order of ids")
        ranks[b"\xff"] = 1 << 20  # a lone end never remains: every byte merges with it first
        self.width = [0] * (1 + max(model["vocab"].values()))
        for body, at in ranks.items():
            if at < len(self.width):
                self.width[at] = len(body.removesuffix(b"\xff"))
        self.widths = np.array(self.width, np.int64)
        core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return core._core_bpe.encode_single_piece

    def encode(self, word: str) -> list[int]:
        if not self.plain(word):
            return self.slow.encode(word, add_special_tokens=False).ids
        return [i for piece in _PIECE.findall(word.lower()) for i in self.merger(piece.encode() + b"\xff")]

    @staticmethod
    def plain(word: str) -> bool:
        """Printable ASCII (words have no blanks), or such with letters of Latin-1."""
        return word.isprintable() if word.isascii() else bool(_PLAIN.fullmatch(word))

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain words in order, ids per word: one search for the pieces of all words, one encoding per distinct piece."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = "\n".join(words).lower()
        found = (_ASCII_PIECES if joined.isascii() else _PIECES).findall(joined)
        if len(self.pieces) >= CACHE_PIECES:
            self.clear_pieces()
        pieces = self.pieces
        new = [x for x in set(found) if x not in pieces]
        if new:
            merger = self.merger
            encoded = [merger(x.encode() + b"\xff") for x in new]
            pieces.update(zip(new, range(len(pieces), len(pieces) + len(new)), strict=True))
            self.piece_starts = np.concatenate([self.piece_starts, np.cumsum(np.fromiter(map(len, encoded), np.int64, len(new))) + len(self.piece_ids)])
            self.piece_ids = np.concatenate([self.piece_ids, np.fromiter(chain.from_iterable(encoded), np.uint32)])
        at = np.fromiter(map(pieces.__getitem__, found), np.int64, len(found))
        shift, counts = _gathered(self.piece_starts, at)
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = np.append(total[np.flatnonzero(at == 0)], total[-1])
        return self.piece_ids[shift], np.diff(ends, prepend=0)

    def spans(self, word: str, ids: list[int]) -> list[tuple[int, int]]:
        """[start, end) of each id in code points of the word; bytes of one character share its span."""
        if not self.plain(word):
            return self.slow.encode(word, add_special_tokens=False).offsets
        ends = list(accumulate(map(self.width.__getitem__, ids), initial=0))
        if not word.isascii():  # bytes to characters
            char = [i for i, c in enumerate(word) for _ in range(1 if c < "\x80" else 2)]
            return [(char[a], char[b - 1] + 1) for a, b in pairwise(ends)]
        return list(pairwise(ends))

    def _places(self, words: list[str]) -> np.ndarray:
        """The place of each of these distinct words in the cache; unknown ones are encoded and added."""
        known = self.known
        if len(known) >= CACHE_WORDS:
            self.clear()
            known = self.known
        new = [w for w in words if w not in known]
        if new:
            plain = [w for w in new if self.plain(w)]
            others = [w for w in new if not self.plain(w)] if len(plain) < len(new) else []
            new = plain + others
            ids, counts = self._encode_plain(plain)
            slow = [self.encode(w) for w in others]
            counts = np.concatenate([counts, np.fromiter(map(len, slow), np.int64, len(slow))])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, np.cumsum(counts) + len(self.flat)])
            self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(slow), np.uint32)])
            if self.with_spans:
                self._add_spans(new, counts)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _add_spans(self, new: list[str], counts: np.ndarray) -> None:
        """Spans of new words: where every character is one byte of a token, running sums of widths for all words at once."""
        first = np.cumsum(counts) - counts
        ids = self.flat[len(self.flat) - int(counts.sum()) :]
        width = self.widths[ids]
        total = np.concatenate([[0], np.cumsum(width)])
        end = total[1:] - np.repeat(total[first], counts)
        start = end - width
        wide = total[first + counts] - total[first]
        for i, w in enumerate(new):
            if not (w.isascii() and wide[i] == len(w)) and counts[i]:
                at = slice(int(first[i]), int(first[i] + counts[i]))
                start[at], end[at] = zip(*self.spans(w, ids[at].tolist()), strict=True)
        self.span_start = np.concatenate([self.span_start, start.astype(np.int32)])
        self.span_end = np.concatenate([self.span_end, end.astype(np.int32)])

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts in order; ids per word; first word of each text (and the end)."""
        at, counts, first_words = self.places(texts)
        return self.flat[at], counts, first_words

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As batch, but places in flat, span_start and span_end instead of ids; a leading blank makes an empty word."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        first_words = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        if not len(coded):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), first_words
        places = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        return *_gathered(self.starts, places), first_words

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


def chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, so that a worker's arrays stay small."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


_TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, spans: bool = False) -> WordTokenizer:
    """One per Python worker."""
    if (path, spans) not in _TOKENIZERS:
        _TOKENIZERS[path, spans] = WordTokenizer(path, spans)
    return _TOKENIZERS[path, spans]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)
