"""Exact tokenizer output with bounded memos of words; a worker's building block for operators 6 and 10."""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress, islice

import numpy as np
import pyarrow as pa

from .textkit import by_bytes

#: A piece is cut only where every pre-tokenizer used here ends a token too: around line ends between
#: words, and between a run of Latin letters and a comma or full stop.
_CHUNK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ ,.\n]|$)|[,.]+(?=[ \n]|$)|\n(?=\S)|\s*\S+|\s+")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Special tokens and characters that the libraries class differently: such texts go through whole.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Words a memo may hold before it is cut back to those met in more than one batch.
MEMO = 500_000
#: Bytes of texts that are cut at once (one text at least).
SLICE = 4 << 20
#: ASCII letters, the second bytes of À to ÿ without the signs × and ÷, which follow a byte 0xC3, and
#: ASCII signs that end a word in every pre-tokenizer (an apostrophe may not).
_ASCII, _SECOND, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: bytes without a visible Latin-1 character stand at 256 and up, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Memo:
    """Words' ids; forgets, when full, what was not met again after the batch that brought it."""

    def __init__(self):
        self.ids: dict = {}
        self.again: set = set()

    def missing(self, seen: set) -> set:
        new = seen.difference(self.ids)  # quick for a plain dict
        self._room(len(new), seen.difference(new))
        return new

    def look(self, names: list) -> list:
        """The ids of different names, None for those to be encoded."""
        found = list(map(self.ids.get, names))
        self._room(found.count(None), set(compress(names, found)))
        return found

    def _room(self, new: int, old: set) -> None:
        if len(self.ids) + new > MEMO:
            keep = old | self.again if len(self.again) < MEMO * 3 // 4 else old.union(islice(self.again, MEMO // 2))
            self.ids = {c: self.ids[c] for c in keep}
            self.again = set()
        else:
            self.again |= old


def _strings(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(number of each stretch of ``data`` among the different ones, the different ones)."""
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    coded = rows.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def _list(strings: pa.LargeBinaryArray) -> list[bytes]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of all rows, one after the other."""
    first = _starts(size)
    return values[np.repeat(start - first[:-1], size) + np.arange(first[-1])]


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.

    Equal to ``Tokenizer.encode(text, add_special_tokens=False)``. Texts are cut at single spaces
    and before line ends, many at a time as bytes; a piece that occurs again is looked at once. Of a
    piece that is a run of Latin letters, the line end before it, signs after it and, where the
    tokenizer lower-cases, its capitals are set aside, and what is left is encoded once and
    remembered. A text with other runs of white space takes the finer cut whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.lower = self.tokenizer.normalizer is not None
        self.pieces, self.words = _Memo(), _Memo()
        self.four = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.line = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _word(self, word: str) -> bytes:
        """One run of letters is one pre-token: straight to the model."""
        if self.lower:
            word = word.lower().lstrip(" ")
        return self._letters(word.encode())

    def _letters(self, word: bytes) -> bytes:
        """Ids of a word in lower case where the tokenizer takes it so, without a space where it takes none."""
        coded = word.decode("latin-1")
        coded = coded.replace(" ", "\u0120") if word.isascii() else coded.translate(self.letters)
        found = self.model.tokenize(coded)
        # a word of one token, as most are, shares its bytes with all others of that token
        return self.four[found[0].id] if len(found) == 1 else b"".join([self.four[t.id] for t in found])

    def _split(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, ...]:
        """(number of the key, number of the signs after it) of different pieces, the keys, whether they are words, the signs.

        A word's key has no signs; where the tokenizer lower-cases, and so takes line ends for spaces,
        no line end and no capitals either. Any other piece is its own key, without signs after it.
        """
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: bounds[-1]]
        start, end = bounds[:-1], bounds[1:]
        lead = (end > start) & (data[np.minimum(start, len(data) - 1)] == 10)
        second = np.concatenate([[False], data[:-1] == 0xC3])
        odd = _starts(~(_ASCII[data] | (data == 0xC3) | (second & _SECOND[data])))
        first = start + lead
        # behind the last byte that is no sign
        last = np.maximum.accumulate(np.where(_SIGN[data], 0, np.arange(1, len(data) + 1)))
        behind = np.maximum(first, last[end - 1])
        word = (behind > first) & (behind <= end) & (odd[behind] == odd[first])
        behind = np.where(word, behind, end)
        keep = np.ones(len(data), bool)
        if self.lower:
            keep[start[word & lead]] = False
            capital = ((data >= 65) & (data <= 90)) | (second & (data >= 0x80) & (data <= 0x9E))
            data = data + 32 * (capital & np.repeat(word, end - start)).astype(np.uint8)
        after, signs = _strings(_gather(data, behind, end - behind), _starts(end - behind))
        keep &= ~np.repeat(np.tile([False, True], len(start)), np.stack([behind - start, end - behind], 1).ravel())
        number, keys = _strings(data[keep], _starts(keep)[bounds])
        words = np.zeros(len(keys), bool)
        words[number] = word
        return number, after, _list(keys), words, _list(signs)

    def _look(self, names: list[bytes], words: np.ndarray) -> tuple[list[bytes], list[int]]:
        """(the keys' ids, new ones encoded; numbers of the keys where white space leaves no boundary)."""
        found, rest, odd = self.pieces.look(names), [], []
        ids = self.pieces.ids
        space = b"" if self.lower else b" "
        kinds = words.tolist()
        for i, x in enumerate(found):
            if x is not None:
                continue
            k = names[i]
            line = k[:1] == b"\n"
            if kinds[i]:
                found[i] = ids[k] = self.line + self._letters(k[1:]) if line else self._letters(space + k)
                continue
            p = k.decode()
            if p in ("", "\n") or p[-1].isspace() or not line and p[0].isspace():
                found[i] = b""
                odd.append(i)
            else:
                rest.append((i, p if line else " " + p))
        for (i, _), x in zip(rest, self._encode([p for _, p in rest]), strict=True):
            found[i] = ids[names[i]] = x
        return found, odd

    def _plain(self, blobs: list[bytes]) -> list[bytes | None]:
        """Ids of texts that begin with other characters than white space; None for those that need the finer cut."""
        # a line end stands before each text, so that its first word has no space; its ids are dropped again
        blobs = [(b"\n" + b).replace(b"\n", b" \n").replace(b"\n \n", b"\n\n") for b in blobs]
        data = np.frombuffer(b"".join(blobs), np.uint8)
        gap = data == 32
        at = np.flatnonzero(gap)
        texts = np.searchsorted(at, _starts([len(b) for b in blobs]))
        piece, pieces = _strings(data[~gap], np.append(at, len(data)) - np.arange(len(at) + 1))
        number, after, names, words, signs = self._split(pieces)
        found, odd = self._look(names, words)
        found += self._cut([x.decode() for x in signs])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # a piece's ids: its key's, then those of the signs after it
        parts = np.stack([number, len(names) + after], 1)
        joined = _gather(np.frombuffer(b"".join(found), "<u4"), _starts(size)[parts].ravel(), size[parts].ravel())
        size = size[parts].sum(1)
        ids = _gather(joined, _starts(size)[piece], size[piece]).tobytes()
        ends = 4 * _starts(size[piece])[texts]
        none = np.zeros(len(names), bool)
        none[odd] = True
        bad = np.diff(_starts(none[number][piece])[texts]) > 0
        return [None if x else ids[a + len(self.line) : b] for x, a, b in zip(bad.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _cut(self, texts: list[str]) -> list[bytes]:
        cut = [_CHUNK.findall(t) for t in texts]
        seen = set().union(*cut)
        new = self.words.missing(seen)
        rest, ids = [], self.words.ids
        for w in new:
            if _WORD(w):
                ids[w] = self._word(w)
            else:
                rest.append(w)
        ids.update(zip(rest, self._encode(rest), strict=True))
        get = ids.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if any(x in t for x in _WHOLE):
                out[i] = self._encode([t])[0]
            elif t and not t[0].isspace():
                plain.append(i)
        for at, blobs in by_bytes([texts[i] for i in plain], SLICE):
            for i, x in zip(plain[at : at + len(blobs)], self._plain(blobs), strict=True):
                out[i] = x
        return [self._cut([t])[0] if x is None else x for t, x in zip(texts, out, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
