"""Token ids of whole texts by a public tokenizer file, through a bounded cache of piece ids.

A text falls into pieces that the tokenizer's byte-pair model treats apart from each other; the ids of
a text are those of its pieces in order. Common pieces are looked up, only unseen ones are given to
the library. Texts of Latin-1 characters are cut into exactly the tokenizer's own pieces, which go to
its model; all other texts are cut at plain spaces only, where none of its patterns matches across,
and the parts go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

CACHE_PIECES = 400_000
"""Pieces whose ids a Python worker remembers; beyond that it starts afresh, or with those of the last texts."""

SLICE_CHARS = 1 << 20
"""Characters looked up at once; longer texts are split at safe places."""

BATCH_CHARS = 1 << 23
"""Characters of short texts that are cut and looked up together."""

# Of the 256 Latin-1 characters: letters and numbers as Unicode classes them.
_L = rb"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = rb" \t\n\r"
_ENDINGS = rb"'s|'t|'re|'ve|'m|'ll|'d|"
_DROPPED_SPACE = re.compile(_ENDINGS + b"[" + _L + b"]+|[" + _N + b"]|[^" + _S + _L + _N + b"]+")
_KEPT_SPACE = re.compile(
    _ENDINGS + b" ?[" + _L + b"]+| ?[" + _N + b"]+| ?[^" + _S + _L + _N + b"]+|[" + _S + rb"]+(?![^" + _S + b"])|[" + _S + b"]+"
)
# Spaces that Python and the tokenizers' pattern engines may class differently.
_ODD = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_LOWER = bytes(ord(chr(i).lower()) if i != 0xB5 else i for i in range(256))


def _classes() -> bytes:
    """Class of every Latin-1 character: 0 white space, 1 letter, 2 number, 3 other."""
    found = []
    for i in range(256):
        c = bytes([i])
        if re.match(b"[" + _S + b"]", c):
            found.append(0)
        elif re.match(b"[" + _L + b"]", c):
            found.append(1)
        else:
            found.append(2 if re.match(b"[" + _N + b"]", c) else 3)
    return bytes(found)


_CLASSES = _classes()
_ENDING = re.compile(_ENDINGS[:-1])

_PLAIN_WORDS = re.compile(r"[^ \n\t\r]+")
_SAFE_BORDER = re.compile(r"(?<=[!-~])(?=[ \n\t\r])")

_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for letters from 256 on."""
    own = [i for i in range(256) if 33 <= i <= 126 or 161 <= i <= 172 or 174 <= i]
    rest = [i for i in range(256) if i not in own]
    return {i: chr(i) for i in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class PieceEncoder:
    """Encodes texts by a ``tokenizers`` file of one of the two byte-level families.

    ``spaced``: the tokenizer keeps white space and case; otherwise it lower-cases and drops white
    space. Special strings inside texts are handled as the file says; none is added.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.pattern = _KEPT_SPACE if spaced else _DROPPED_SPACE
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.sizes: dict[bytes | str, int] = {}

    def _latin(self, text: str) -> bytes | None:
        """The text as Latin-1 if it can be cut by this module's patterns."""
        try:
            plain = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if len(plain.translate(None, _ODD)) != len(plain) or any(s in text for s in self.specials):
            return None
        return plain if self.spaced else plain.translate(_LOWER)

    def _word(self, piece: bytes) -> str:
        if piece.isalpha():  # of ASCII letters, which stand for themselves
            return piece.decode()
        return piece.decode("latin-1").encode().decode("latin-1").translate(self.letters)

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, from the tokenizer's model."""
        ids: list[int] = []
        ends = [0]
        tokenize = self.model.tokenize
        for word in map(self._word, pieces):
            ids += [t.id for t in tokenize(word)]
            ends.append(4 * len(ids))
        return list(map(np.array(ids, "<u4").tobytes().__getitem__, map(slice, ends[:-1], ends[1:])))

    def _piece(self, piece: bytes) -> bytes:
        return self._new([piece])[0]

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of about ``SLICE_CHARS`` characters, cut before a space that follows a printable character."""
        start = 0
        while len(text) - start > SLICE_CHARS:
            border = _SAFE_BORDER.search(text, start + SLICE_CHARS)
            if border is None:
                break
            yield text[start : border.start()]
            start = border.start()
        yield text[start:]

    def _encode_latin(self, plain: bytes) -> bytes:
        pieces = self.pattern.findall(plain)
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        for p in pieces:
            if p not in known:
                known[p] = self._piece(p)
        return b"".join(map(known.__getitem__, pieces))

    def _pieces(self, plains: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Pieces of some texts as ``_DROPPED_SPACE`` cuts them, and how many there are up to the end of each text."""
        text = b" ".join(plains) + b"   "
        classes = np.frombuffer(text.translate(_CLASSES), np.uint8)
        first = classes != 0
        first[1:] &= (classes[1:] != classes[:-1]) | (classes[1:] == 2)
        marks = np.flatnonzero(first & (np.frombuffer(text, np.uint8) == ord("'")))
        for at in marks[classes[marks + 1] == 1].tolist():
            ending = _ENDING.match(text, at)
            if ending:
                first[at + 1] = False
                first[ending.end()] = classes[ending.end()] != 0
        ends = np.cumsum([len(p) + 1 for p in plains])
        upto = np.searchsorted(np.flatnonzero(first), ends)
        data = text.translate(None, b" \t\n\r")
        borders = np.append(np.flatnonzero(first[classes != 0]), len(data)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(data)])
        return cut.dictionary_encode(), upto

    def _encode_latins(self, plains: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that ``_latin`` takes; a distinct piece of them is looked up once."""
        pieces, upto = self._pieces(plains)
        _, borders, data = pieces.dictionary.buffers()
        raw, borders = data.to_pybytes(), np.frombuffer(borders, np.int32)[: len(pieces.dictionary) + 1].tolist()
        distinct = list(map(raw.__getitem__, map(slice, borders[:-1], borders[1:])))
        ids = list(map(self.known.get, distinct))
        new = [i for i, e in enumerate(ids) if e is None]
        new_pieces = [distinct[i] for i in new]
        new_ids = self._new(new_pieces)
        for i, e in zip(new, new_ids, strict=True):
            ids[i] = e
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known = dict(zip(distinct, ids, strict=True))
        else:
            self.known.update(zip(new_pieces, new_ids, strict=True))
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        which = pieces.indices.to_numpy(zero_copy_only=False)
        sizes = size[which]
        ends = np.cumsum(sizes, dtype=np.int32)
        shift = (np.cumsum(size, dtype=np.int32) - size)[which] - (ends - sizes)  # from a place in the result to that in ``flat``
        places = np.repeat(shift, sizes)
        places += np.arange(len(places), dtype=np.int32)
        return np.split(flat[places], np.append(0, ends)[upto[:-1]])

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in order; texts that need no care beyond Latin-1 are cut and looked up together."""
        held: list[bytes] = []
        n_held = 0
        for text in texts:
            plain = None if self.spaced or len(text or "") > SLICE_CHARS else self._latin(text or "")
            if held and (plain is None or n_held > BATCH_CHARS):
                yield from self._encode_latins(held)
                held, n_held = [], 0
            if plain is None:
                yield np.frombuffer(self.encode_one(text), "<u4")
            else:
                held.append(plain)
                n_held += len(plain)
        if held:
            yield from self._encode_latins(held)

    def _encode_other(self, text: str) -> bytes:
        parts = _SAFE_BORDER.split(text) if self.spaced else _PLAIN_WORDS.findall(text)
        known = self.parts
        if len(known) > CACHE_PIECES:
            known.clear()
        new = list({p for p in parts if p not in known})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = b"".join(i.to_bytes(4, "little") for i in e.ids)
        return b"".join(map(known.__getitem__, parts))

    def count_batch(self, texts: Sequence[str]) -> list[int]:
        """Numbers of ids of a batch of texts; pieces not seen before are encoded once for the batch, and no ids are kept."""
        cut: list[list[Sequence]] = []
        new: set[bytes | str] = set()
        for text in texts:
            own: list[Sequence] = []
            for part in self._cut(text):
                plain = self._latin(part)
                if plain is not None:
                    own.append(self.pattern.findall(plain))
                else:
                    own.append(_SAFE_BORDER.split(part) if self.spaced else _PLAIN_WORDS.findall(part))
                new.update(own[-1])
            cut.append(own)
        if len(self.sizes) > CACHE_PIECES:
            self.sizes.clear()
        new.difference_update(self.sizes)
        for p in [x for x in new if isinstance(x, bytes)]:
            self.sizes[p] = len(self._piece(p)) // 4
        rest = [x for x in new if isinstance(x, str)]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.sizes[p] = len(e.ids)
        return [sum(sum(map(self.sizes.__getitem__, part)) for part in own) for own in cut]

    def encode_one(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text counts as empty."""
        out = []
        for part in self._cut(text or ""):
            plain = self._latin(part)
            out.append(self._encode_other(part) if plain is None else self._encode_latin(plain))
        return out[0] if len(out) == 1 else b"".join(out)


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """The worker's encoder for a file, made once."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, spaced)
    return _ENCODERS[key]
