"""Byte-level BPE of many texts with the tokenizers library.

Most words recur, so ids are remembered by piece. Texts are cut as the library's pre-tokenizer for byte-level BPE does (a
fixed pattern, for characters whose class is beyond doubt), by classes of bytes of a whole batch; Arrow tells its distinct
pieces, and those that aren't remembered go to the library's model. Texts with other characters, and tokenizers of another
kind, are encoded by the library whole.
"""

from __future__ import annotations

import contextlib
import gc
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Pieces that a worker remembers (some 120 bytes each) before it forgets them all.
MEMO = 256_000
#: Bytes of text that are cut into pieces at once.
SLICE = 2 << 20
# Classes of the characters below U+0250 (letters, numbers, white space), and other signs in use.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = range(5)


def _classes() -> np.ndarray:
    """Class by code point of up to three bytes."""
    out = np.full(1 << 16, _UNSURE, np.uint8)
    for first, last in ((0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)):
        out[first : last + 1] = _OTHER
    for kind, signs in ((_LETTER, _L), (_NUMBER, _N), (_SPACE, _S)):
        out[[c for c in range(0x250) if re.match(f"[{signs}]", chr(c))]] = kind
    return out


_CLASS = _classes()
_CLASS_OF_BYTE = _CLASS[:256].tobytes()
_encoders: dict[str, Encoder] = {}


@contextlib.contextmanager
def without_collection() -> Iterator[None]:
    """While a task encodes: passes of the garbage collector over the remembered chunks find nothing."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one after another, and where each text begins (and the last one ends)."""
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def _texts(data: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def _without(begin: np.ndarray, data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces, bytes and beginnings of texts, where those of rows are empty."""
    size = np.diff(at)
    moved = np.concatenate(([0], np.where(rows, size, 0).cumsum()))
    row = np.searchsorted(at, begin, side="right") - 1
    stays = ~rows[row]
    return (begin - moved[row])[stays], data[np.repeat(~rows, size)], at - moved


def classes_of(data: np.ndarray) -> np.ndarray:
    """Class of the character that each byte (of UTF-8) belongs to."""
    kind = np.frombuffer(bytearray(data.tobytes().translate(_CLASS_OF_BYTE)), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    two, three, four = lead[first < 0xE0], lead[(first >= 0xE0) & (first < 0xF0)], lead[first >= 0xF0]
    tail = lambda i: (data[i] & 0x3F).astype(np.int32)
    kind[two] = kind[two + 1] = _CLASS[(data[two] & 0x1F).astype(np.int32) << 6 | tail(two + 1)]
    kind[three] = kind[three + 1] = kind[three + 2] = _CLASS[(data[three] & 0x0F).astype(np.int32) << 12 | tail(three + 1) << 6 | tail(three + 2)]
    kind[four] = kind[four + 1] = kind[four + 2] = kind[four + 3] = _UNSURE
    return kind


def piece_starts(data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, as the pattern of byte-level BPE cuts them:

    '(?:[stmd]|re|ve|ll)| ?letters+| ?numbers+| ?others+|spaces+(?!no space)|spaces+. kind: classes_of(data); at: where texts
    begin, and the end.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    # behind white space: a blank goes with what follows, another last one stands alone
    behind = np.flatnonzero(cut[1:n] & (kind[:-1] == _SPACE)) + 1
    first = np.zeros(n + 1, bool)
    first[at] = True
    behind = behind[~first[behind]]
    blank = data[behind - 1] == 0x20
    cut[behind[blank]] = False
    cut[behind - 1 - (data[behind - 1] >= 0x80)] = True
    cut[at] = True
    # short forms, where a piece begins with the apostrophe
    mark = np.flatnonzero((data == 0x27) & cut[:n])
    padded = np.concatenate((data, np.zeros(2, np.uint8)))
    one, other = padded[mark + 1], padded[mark + 2]
    inside = ~first[mark + 1]
    short = inside & np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = inside & ~first[np.minimum(mark + 2, n)] & np.isin(one.astype(np.uint16) << 8 | other, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
    cut[mark[short | long] + 1] = False
    cut[mark[short] + 2] = True
    cut[mark[long] + 3] = True
    return np.flatnonzero(cut[:n])


def forget() -> None:
    """In tasks that follow the encoding: the worker process stays, what it remembers should not."""
    for e in _encoders.values():
        e.known.clear()


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        # the library gives the strings of added tokens their own ids, special or not: texts that hold one are left to it
        added = [re.escape(t["content"].encode()) for t in spec.get("added_tokens") or () if t["content"]]
        self.added = re.compile(b"|".join(added)) if added else None
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        step, every = self.dtype.itemsize, np.arange(self.vocabulary, dtype=self.dtype).tobytes()
        self.id_bytes = [every[i : i + step] for i in range(0, len(every), step)]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        stand_in = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in visible)}
        #: The letter (code point) that byte-level BPE writes for each byte.
        self.letters = np.array([stand_in.get(b, b) for b in range(256)], "<u4")
        #: Ids by piece, as bytes of its text (half the size of such letters).
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def encode_many(self, texts: pa.LargeStringArray | list[str]) -> list[np.ndarray]:
        """Ids of each text; no special tokens are added."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        data, at = _bytes_of(texts)
        kind = classes_of(data)
        whole = np.zeros(len(texts), bool)
        if not self.by_piece:
            whole[:] = True
        else:
            whole[np.searchsorted(at, np.flatnonzero(kind == _UNSURE), side="right") - 1] = True
            if self.added and self.added.search(data.tobytes()):
                whole |= [self.added.search(t) is not None for t in _texts(data, at)]
        begin = piece_starts(data, kind, at)
        if whole.any():
            begin, data, at = _without(begin, data, at, whole)
        ids, ends = self._ids_of_pieces(data, begin)
        of_row = np.concatenate(([0], ends))[np.searchsorted(begin, at)].tolist()
        out = [ids[a:b] for a, b in zip(of_row[:-1], of_row[1:], strict=True)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.frombuffer(self._whole(texts[i].as_py()), self.dtype)
        return out

    def _ids_of_pieces(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of data that begin at begin, one after another, and where each piece's end."""
        ends = np.append(begin, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        del ends
        flat, size = self._ids_of_distinct(pieces.dictionary)
        code, first = pieces.indices.to_numpy(), size.cumsum() - size
        n = size[code]
        last = n.cumsum()
        # where each id stands in flat
        at = np.repeat(first[code] - (last - n), n)
        at += np.arange(len(at))
        return flat[at], last

    def _ids_of_distinct(self, distinct: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, and the number of each one's."""
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1].tolist()
        held = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)[: bounds[-1]]
        whole = held.tobytes()
        keys = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        known, by_id, model = self.known, self.id_bytes, self.tokenizer.model
        if len(known) > MEMO:
            known.clear()
        found = list(map(known.get, keys))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            spelled = self.letters[held].tobytes().decode("utf-32-le")
            for i in missing:
                found[i] = known[keys[i]] = b"".join([by_id[t.id] for t in model.tokenize(spelled[bounds[i] : bounds[i + 1]])])
        return np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]
