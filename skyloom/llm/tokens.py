"""Encoding of whole texts with public tokenizer files, inside tasks.

The word tokenizer never joins tokens across white space, so the text's pieces between spaces are encoded once each and
looked up after that; the result is that of encoding the whole text. A text that holds a special token's string goes to the
tokenizer as a whole, which turns the string into its id. Each Python worker keeps one encoder per file, with a bounded
number of pieces of bounded length.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np

#: Pieces that an encoder keeps in each of two generations: the current one, and the one before, from which what is met
#: again moves over; so frequent pieces stay and rare ones go.
KEEP = 300_000
#: Characters that a piece may have to be kept: with KEEP, a bound in bytes.
LONGEST = 40
#: Marks that may end a word; a word and a run of these are separate pre-tokens.
MARKS = ".,;:!?"


class Kept(dict):
    """Ids of pieces. A piece that is missing moves over from the generation before, or gets an empty place here and in ``new``, to be
    filled once all new pieces of some texts are known; so a text's pieces are looked up once."""

    def __init__(self, before: dict[str, bytes]):
        super().__init__({"": b""})
        self.before, self.new = before, {}

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.new[piece] = bytearray()
        self[piece] = ids
        return ids


class WordEncoder:
    """Ids of texts by a tokenizers file whose pre-tokens hold no white space and whose last id of a word ends in ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in pieces, as lower-casing may have made a special token's string of another
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: For words of lower-case letters in composed form, which no normaliser changes and no pre-tokeniser splits.
        self.plain = Tokenizer(self.tokenizer.model)  # one model for both
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.kept = Kept({})

    @staticmethod
    def pieces(text: str | None) -> list[str]:
        """The text between white space; A-Z in lower case where that can't change what the tokenizer's own steps give."""
        text = text or ""
        if text.isascii():
            text = text.lower()
        elif unicodedata.is_normalized("NFC", text := text.encode("utf-8", "replace").decode("utf-8")) and unicodedata.is_normalized("NFC", low := text.encode().lower().decode()):
            text = low
        for white in "\n\t\r":
            if white in text:
                text = text.replace(white, " ")
        return text.split(" ")

    def _encode_words(self, words: set[str]) -> None:
        """Words of letters only: many in one call, told apart by the ids that end a word."""
        plain = [w for w in words if w.islower() and (w.isascii() or w == w.lower() and unicodedata.is_normalized("NFC", w))]
        self._encode_joined(plain, self.plain)
        self._encode_joined(list(words.difference(plain)), self.tokenizer)

    def _encode_joined(self, words: list[str], tokenizer) -> None:
        for a in range(0, len(words), 2000):
            some = words[a : a + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                data, at = ids.astype("<u4").tobytes(), 0
                for w, end in zip(some, (4 * last).tolist()):
                    self.kept[w] = data[at:end]
                    at = end
            else:
                self._encode_each(some)

    def _encode_each(self, pieces: list[str]) -> None:
        for w, e in zip(pieces, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)):
            self.kept[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        whole = {i: t for i, t in enumerate(texts) if t and "<|" in t and any(s in t for s in self.special)}
        if whole:
            got = self._encode_texts([None if i in whole else t for i, t in enumerate(texts)])
            self.tokenizer.encode_special_tokens = False
            for i, e in zip(whole, self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False)):
                got[i] = np.array(e.ids, "<u4").tobytes()
            self.tokenizer.encode_special_tokens = True
            return got
        return self._encode_texts(texts)

    def _encode_texts(self, texts: list[str | None]) -> list[bytes]:
        if len(self.kept) > KEEP:
            self.kept.before.clear()
            self.kept = Kept(dict(self.kept))
        try:
            get = self.kept.__getitem__
            parts = [list(map(get, self.pieces(t))) for t in texts]
            self._encode_new()
            return list(map(b"".join, parts))
        except BaseException:  # no place stays empty
            self.kept = Kept({})
            raise

    def _encode_new(self) -> None:
        """Fills the empty places."""
        kept, before, new = self.kept, self.kept.before, self.kept.new
        words, other, parted = set(filter(str.isalpha, new)), set(), []
        for w in filterfalse(words.__contains__, new):
            stem = w.rstrip(MARKS)
            if stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()):  # no mark at its end
                tail = w[len(stem) :]
                parted.append((w, stem, tail))
                if stem not in kept:
                    if stem in before:
                        kept[stem] = before[stem]
                    else:
                        words.add(stem)
                if tail not in kept:
                    other.add(tail)
            else:
                other.add(w)
        self._encode_words(words)
        if other:
            self._encode_each(list(other))
        for w, stem, tail in parted:
            kept[w] = kept[stem] + kept[tail]
        for w, place in new.items():
            place += kept[w]
        new.clear()
        for w in [w for w in chain(words, other, (p[0] for p in parted)) if len(w) > LONGEST]:
            del kept[w]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str):
    """A tiktoken encoding of a ranks file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
