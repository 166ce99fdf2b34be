"""Encoding texts with the tokenizers library through units that a tokenizer never joins, each distinct unit once.

A unit begins at a space (or a line end, or a mark after a letter) where the pre-tokenizer always cuts: the pattern ends a
piece there, and what comes after the cut never changes a piece before it. Units are cut, counted out, sorted into runs of
letters and others and put together again as Arrow columns; Python sees the distinct units of a batch only.
"""

from __future__ import annotations

import codecs
import json
import os
from itertools import chain, repeat
from string import punctuation
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _visible() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(hidden)}


VISIBLE = _visible()
#: The same as a table of ``codecs.charmap_decode``, with line ends as they are.
_SHOWN = "".join("\n" if b == 0x0A else VISIBLE[b] for b in range(256))
#: The normaliser and pattern under which a piece ends between a letter and a mark, and which change nothing but the case
#: of a run of ``_LATIN`` letters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": _PATTERN, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"


def word_cuts(data: np.ndarray) -> np.ndarray:
    """For tokenizers that drop white space: every space and line end."""
    return np.flatnonzero((data == 0x20) | (data == 0x0A))


def marked_cuts(data: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Those and every mark (``marks`` by byte) after a letter from A to Z or from U+00C0 to U+00FF."""
    mark = np.flatnonzero(marks[data])
    mark = mark[mark > 0]
    one = data[mark - 1]
    two = data[np.maximum(mark, 2) - 2]
    plain = ((one | 0x20) >= 0x61) & ((one | 0x20) <= 0x7A)
    return np.concatenate([word_cuts(data), mark[plain | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]])


def spaced_cuts(data: np.ndarray) -> np.ndarray:
    """For byte-level tokenizers with the usual pattern, which puts one space before a word: spaces after a character that
    is not white space. Characters before the space that might be are taken as such: control characters and all of
    U+0800 and above, as well as U+0080 to U+00BF."""
    space = np.flatnonzero(data == 0x20)
    space = space[space > 0]
    one = data[space - 1]
    two = data[np.maximum(space, 2) - 2]
    return space[((one > 0x20) & (one < 0x7F)) | ((one >= 0x80) & (two >= 0xC3) & (two < 0xE0))]


class Encoded(NamedTuple):
    """``ids`` of all texts; ``units[k]`` is where unit k begins among them, ``texts[i]`` the first unit of text i.
    ``distinct`` and ``index`` give the units' own texts."""

    ids: np.ndarray
    units: np.ndarray
    texts: np.ndarray
    distinct: list[str]
    index: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each text begins among the ids; one entry more than texts."""
        return self.units[self.texts]

    def unit(self, k: int) -> str:
        return self.distinct[self.index[k]]


class UnitEncoder:
    """``cuts`` says where units begin in UTF-8. Ids of units that recur, also between batches, come from a cache of
    ``most`` units; units that find it full are forgotten after the call, and when four times as many were, the cache
    starts anew."""

    def __init__(self, path: str, cuts, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.cuts, self.most = Tokenizer.from_file(path), cuts, most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the library's merges without its normaliser and pattern, for runs of letters that neither changes
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.plain.no_truncation()
        self.plain.no_padding()
        config = json.loads(self.tokenizer.to_str())
        self.suffix = config["model"]["end_of_word_suffix"] or ""
        self.lower = "Lowercase" in json.dumps(config["normalizer"])
        self.known = config["normalizer"] == _NORMALIZER and config["pre_tokenizer"] == _PIECES and not any(t["single_word"] for t in config["added_tokens"])
        self.run = f"^[ {chr(10) if self.suffix else ''}]?[{_LATIN if self.known else 'A-Za-z'}]+$"
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token.removesuffix(self.suffix) if self.suffix else token)
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.forgotten = 0

    def _letters(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of units that are a space at most and letters (``run``)."""
        bare = pc.ascii_ltrim(units, " \n") if self.suffix else units
        bare = pc.utf8_lower(bare) if self.lower else bare
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(bare), 2000), len(bare)], pa.int32()), bare)
        joined = [codecs.charmap_decode(x.as_buffer(), "strict", _SHOWN)[0] for x in pc.binary_join(lists, "\n")]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)), np.uint32)
        ends = np.cumsum(pc.binary_length(bare).to_numpy(), dtype=np.int64)
        last = np.searchsorted(np.cumsum(self.length[ids]), ends)  # of each unit; tokens are no empty texts
        return ids, np.diff(last, prepend=-1)

    def _whole(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for any units, by the whole tokenizer."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(units.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _learn(self, units: pa.StringArray) -> np.ndarray:
        """Add units that are not in the cache; returns their places in it."""
        plain, base = pc.match_substring_regex(units, self.run).to_numpy(zero_copy_only=False), len(self.sizes)
        rows, flat, sizes = np.empty(len(units), np.int64), [self.flat], [self.sizes]
        for some, encode in ((plain, self._letters), (~plain, self._whole)):
            which = np.flatnonzero(some)
            rows[which] = base + np.arange(len(which))
            base += len(which)
            for a in range(0, len(which), 100_000):
                ids, n = encode(units.take(pa.array(which[a : a + 100_000])))
                flat.append(ids)
                sizes.append(n)
        self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        return rows

    def _forget(self, fresh: list[str], kept: int) -> None:
        self.forgotten += len(fresh)
        if not kept or self.forgotten > 4 * self.most:
            self._clear()
            return
        for unit in fresh:
            del self.at[unit]
        self.sizes, self.starts = self.sizes[:kept], self.starts[:kept]
        self.flat = self.flat[: int(self.sizes.sum())]

    def _split(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """All units as one column, and the first unit of each text (one entry more than texts)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        begins = (offsets - offsets[0]).astype(np.int64)
        marks = np.zeros(len(data), bool)
        marks[self.cuts(data)] = marks[begins[:-1][np.diff(begins) > 0]] = True
        starts = np.flatnonzero(marks)
        first = np.searchsorted(starts, begins)
        ends = np.append(starts, len(data)).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))), first

    def encode(self, texts: list[str] | pa.Array) -> Encoded:
        """No text may be null."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        units, first = self._split(column.cast(pa.string()) if column.type != pa.string() else column)
        coded = units.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        rows = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        new, kept = np.flatnonzero(rows < 0), len(self.at)
        fresh = [distinct[i] for i in new.tolist()]
        if fresh:
            rows[new] = self._learn(coded.dictionary.take(pa.array(new)))
            self.at.update(zip(fresh, rows[new].tolist(), strict=True))
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        if len(self.at) > self.most:
            self._forget(fresh, kept)
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.concatenate([[0], 4 * ends])), pa.py_buffer(ids)])
        whole = table.take(coded.indices)
        at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] // 4 if len(whole) else np.zeros(1, np.int64)
        flat = np.frombuffer(whole.buffers()[2], np.uint32)[: int(at[-1])] if at[-1] else np.empty(0, np.uint32)
        return Encoded(flat, at, first, distinct, index)


_encoders: dict[tuple, UnitEncoder] = {}


def encoder(path: str, kind) -> UnitEncoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if (path, kind.__name__) not in _encoders:
        _encoders[path, kind.__name__] = kind(path)
    return _encoders[path, kind.__name__]


def word_encoder(path: str) -> UnitEncoder:
    """Cuts at marks too where the tokenizer's pattern is known to; a mark inside a special token never cuts."""
    enc = UnitEncoder(path, word_cuts)
    if enc.known:
        marks = np.zeros(256, bool)
        marks[[ord(c) for c in punctuation if not any(c in s[1:] for s in enc.special)]] = True
        enc.cuts = lambda data: marked_cuts(data, marks)
    return enc
