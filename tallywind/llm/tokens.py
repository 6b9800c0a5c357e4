"""Token ids by the tokenizers library, for whole Arrow columns.

The bytes of a column are cut at its rows' ends, before each run of ASCII white space (but for one that follows other
white space), and between an ASCII letter and an ASCII mark. The patterns by which the two kinds of vocabulary split text
(byte-level, and words without white space) start anew at such places. Arrow's dictionary encoding finds the distinct segments of a few megabytes at a time, the library encodes those that a cache lacks (its
model alone where a segment is one word of Latin letters, its whole chain for the rest), and the ids of all segments are gathered by number. The ids are the library's own for the whole text; tests compare them.

Bounds: a step takes STEP bytes, a longer text takes more than one; the cache is two Arrow arrays, of segments of at
most SHORT bytes and of their ids, CACHE bytes in all; when it is full it starts anew from the last step's segments.
A segment without white space is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallywind.llm.common import give_back

STEP, SHORT, CACHE = 8 << 20, 64, 32 << 20
_loaded: dict[str, Encoder] = {}
_SPACE, _LETTER, _MARK = np.zeros((3, 256), bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def cuts(data: np.ndarray, marks: np.ndarray = _MARK) -> np.ndarray:
    """Where bytes of UTF-8 can be cut: before a run of ASCII white space that other white space doesn't precede, and
    before one of `marks` that follows an ASCII letter."""
    space = _SPACE[data]
    at = np.flatnonzero((space[1:] & ~space[:-1]) | (marks[data[1:]] & _LETTER[data[:-1]])) + 1
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    if len(wide):
        p = at[wide]
        last, mid, first = data[p - 1], data[p - 2], data[np.maximum(p - 3, 0)]
        # White space beyond ASCII is U+0085 and U+00A0, or has one of these first two bytes; to leave out more cuts is safe.
        other = (mid == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (first == 0xE1) & (mid == 0x9A) | (first == 0xE2) & ((mid == 0x80) | (mid == 0x81)) | (first == 0xE3) & (mid == 0x80)
        at = np.delete(at, wide[other])
    return at


def byte_chars() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(own))}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = _MARK.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():  # they are found in whole texts: no cut within them
            raw = np.frombuffer(token.content.encode(), np.uint8)
            if _SPACE[raw].any():
                raise ValueError(f"an added token with white space: {token.content!r}")
            self.marks[raw[1:][_LETTER[raw[:-1]]]] = False
        pre, before = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer))
        self.chars, self.model = byte_chars(), self.tokenizer.model
        self.spaced = pre.get("type") == "ByteLevel" and not before  # tokens start with a space; else white space is dropped and case folded
        words = [x["type"] for x in before.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"]
        self.word = re.compile((r" ?" if self.spaced else r"[\t-\r ]*") + r"[A-Za-zÀ-ÖØ-öø-ÿ]+" if self.spaced or words else r"(?!)").fullmatch
        self.forget()

    def forget(self) -> None:
        self._start(pa.array([], pa.binary()), pa.array([], pa.list_(pa.uint32())))

    def _start(self, known: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.binary_length(known), SHORT)
        self.known, self.ids = known.filter(short), ids.filter(short)

    def _encode(self, segments: list[str]) -> list[list[int]]:
        out, rest = [], []
        for i, x in enumerate(segments):
            if self.word(x):
                x = x if self.spaced else x.lstrip("\t\n\v\f\r ").lower()
                out.append([t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.chars))])
            else:
                out.append([])
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([segments[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _lists(self, distinct: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(lists of ids, the list of each segment)."""
        at = pc.index_in(distinct, value_set=self.known)
        fresh, lists = distinct.filter(at.is_null()), [self.ids]
        for s in range(0, len(fresh), 4096):
            lists.append(pa.array(self._encode(fresh[s : s + 4096].cast(pa.string()).to_pylist()), pa.list_(pa.uint32())))
        found, of = pa.concat_arrays(lists), at.fill_null(0).to_numpy().copy()
        of[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(found))
        if len(fresh):
            if self.known.nbytes + self.ids.nbytes + fresh.nbytes > CACHE:
                self._start(distinct, found.take(pa.array(of)))
            else:
                self._start(pa.concat_arrays([self.known, fresh]), found)
        return found, of

    def _step(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each row) of rows that lie between bounds in data."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        begins = np.zeros(len(data), bool)
        begins[cuts(data, self.marks)] = True
        begins[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        at = np.flatnonzero(begins)
        offsets = np.append(at, len(data)).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        lists, of = self._lists(segments.dictionary)
        of = of[segments.indices.to_numpy()]
        total = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())[of]))
        return lists.take(pa.array(of)).flatten().to_numpy(), np.diff(total[np.searchsorted(at, bounds)])

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text of any length, in steps that end at cuts."""
        out, at = [], 0
        while at < len(data):
            end, size = len(data), STEP
            while at + size < len(data):
                found = cuts(data[at : at + size], self.marks)
                if len(found):
                    end = at + int(found[-1])
                    break
                size *= 2
            out.append(self._step(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(out)

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids of each row) for successive rows of a column of strings; a null text has no ids."""
        texts = texts.fill_null("")
        if not len(texts):
            return
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP, "right")) - 1)
            part = data[bounds[row] : bounds[end]]
            if len(part) > STEP:
                ids = self._long(part)
                yield row, ids, np.array([len(ids)])
            else:
                yield row, *self._step(part, bounds[row : end + 1] - bounds[row])
            row = end

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As column(), with end_id after each row's ids."""
        for row, ids, sizes in self.column(texts):
            yield row, np.insert(ids, np.cumsum(sizes), end_id).astype("<u4"), sizes + 1

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit numbers."""
        return b"".join(ids.tobytes() for _, ids, _ in self.column(pa.array([text], pa.string())))


@contextmanager
def encoder(path: str | Callable[[], str]) -> Iterator[Encoder]:
    """The worker process's encoder, for one task: the vocabulary outlives it, the cache doesn't. path: of the vocabulary
    file, or what gives it on the worker's machine."""
    path = path() if callable(path) else path
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    try:
        yield _loaded[path]
    finally:
        _loaded[path].forget()
        give_back()
