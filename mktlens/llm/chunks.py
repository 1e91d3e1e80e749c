"""Texts as runs of repeated chunks, so that tokenizer work is done once for each distinct chunk.

A chunk ends where a single blank or newline stands between two characters that
are no white space. The split pattern of the byte-level tokenizers never matches
across such a place: a run of white space before it is empty, the blank goes with
what follows it and the newline stands alone. So a text's tokens are its chunks'
tokens, one after another, and a table ``chunk -> values`` serves all texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather, offsets_of

_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)")


def split_chunks(text: str) -> list[str]:
    """The chunks of a text, with the blank or newline that starts them. ``"".join`` gives the text back."""
    return _BOUNDARY.split(text) if text else []


def one_by_one(values: Iterable[Sequence[int]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the sequences, one after another, and the sequences' lengths."""
    values = list(values)
    lens = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return np.fromiter(chain.from_iterable(values), dtype=dtype, count=int(lens.sum())), lens


#: Characters that are no white space for certain, nor control or format characters.
_PLAIN = "[^\\x00-\\x20\\x7f-\\x{a0}\\x{ad}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}-\\x{206f}\\x{3000}\\x{feff}]+$"


def can_follow(chunks: pa.Array) -> np.ndarray:
    """Which chunks can stand after any chunk that doesn't end in white space and be chunks there too (some that could are left out)."""
    return pc.match_substring_regex(chunks, "^[ \\n]" + _PLAIN).to_numpy(zero_copy_only=False)


_rng = np.random.default_rng(20240911)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def chunk_hashes(chunks: pa.Array) -> np.ndarray:
    """A 64-bit hash of each chunk's bytes. Different chunks may share one."""
    offsets = np.frombuffer(chunks.buffers()[1], dtype=np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
    lens = np.diff(offsets)
    out = lens.astype(np.uint64)
    full = np.flatnonzero(lens)
    if len(full):
        data = np.frombuffer(chunks.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        power = np.full(int(lens.max()), _STEP, dtype=np.uint64).cumprod(dtype=np.uint64)
        heads = (offsets[:-1] - offsets[0])[full]
        place = np.arange(len(data)) - np.repeat(heads, lens[full])
        out[full] += np.add.reduceat(_BYTE[data] * power[place], heads)
    return out


class ChunkTable:
    """Numbers of chunks and a value run for each, computed once per chunk while it is remembered.

    ``compute`` gets new chunks (Arrow strings) and returns their numbers, one chunk after
    another, and how many each has (``one_by_one`` makes that of a sequence for each). Beyond ``max_chunks`` chunks or ``max_bytes`` bytes, the half that was asked for
    most often stays; that bounds the memory and changes no result. Chunks are looked up by
    hash in a sorted array and compared whole, so that a call costs by its own chunks, not by those known.
    """

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], dtype,
                 max_chunks: int = 1_000_000, max_bytes: int = 16_000_000):
        self.compute, self.dtype, self.max_chunks, self.max_bytes = compute, np.dtype(dtype), max_chunks, max_bytes
        self.known = pa.array([], pa.large_string())
        self.flat, self.lens = np.zeros(0, dtype=self.dtype), np.zeros(0, dtype=np.int64)
        self.asked = np.zeros(0, dtype=np.int64)
        self.hashes, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        if len(self.known) <= self.max_chunks and pc.binary_length(self.known).to_numpy().sum() <= self.max_bytes:
            return
        keep = np.sort(np.argsort(-self.asked, kind="stable")[:self.max_chunks // 2])
        room = np.cumsum(pc.binary_length(self.known).to_numpy()[keep]) <= self.max_bytes // 2
        keep = keep[room]
        starts = offsets_of(self.lens)[:-1]
        self.flat, self.lens = gather(self.flat, starts[keep], self.lens[keep]), self.lens[keep]
        self.known, self.asked = self.known.take(pa.array(keep)), self.asked[keep] // 2
        hashes = chunk_hashes(self.known)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]

    def _find(self, chunks: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the chunks, -1 for those not known."""
        out = np.full(len(chunks), -1, dtype=np.int64)
        if len(self.hashes):
            order = np.argsort(hashes)
            at = np.empty(len(hashes), dtype=np.int64)
            at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            numbers = self.number[at[hit]]
            same = pc.equal(chunks.take(pa.array(hit)), self.known.take(pa.array(numbers))).to_numpy(zero_copy_only=False)
            out[hit[same]] = numbers[same]
        return out

    def _numbers(self, chunks: pa.Array, times: np.ndarray) -> np.ndarray:
        """Numbers of distinct chunks, new ones included."""
        hashes = chunk_hashes(chunks)
        numbers = self._find(chunks, hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = chunks.take(pa.array(new))
            flat, lens = self.compute(fresh)
            numbers[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.flat, self.lens = np.concatenate([self.flat, flat.astype(self.dtype, copy=False)]), np.concatenate([self.lens, lens])
            self.asked = np.concatenate([self.asked, np.zeros(len(new), dtype=np.int64)])
            order = new[np.argsort(hashes[new], kind="stable")]
            at = np.searchsorted(self.hashes, hashes[order], side="right")
            self.hashes, self.number = np.insert(self.hashes, at, hashes[order]), np.insert(self.number, at, numbers[order])
        self.asked[numbers] += times
        return numbers

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, the texts' chunks as places among them, and where each text's begin (the total last)."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, "^\\n?" + _PLAIN).to_numpy(zero_copy_only=False)
        blank = pc.if_else(pc.starts_with(distinct, "\n"), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        named = pc.binary_join_element_wise(blank, distinct, pa.scalar("", pa.large_string()))
        places = coded.indices.to_numpy().astype(np.int64)
        starts = parts.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        heads = starts[:-1]
        good = plain[places]
        # a text's first part has no blank before it, a chunk of its own kind
        extra: dict[str, int] = {}
        first = pc.list_element(parts, 0).to_pylist()
        head_plain = good[heads]
        for k in np.flatnonzero(head_plain):
            if first[k][0] != "\n":
                places[heads[k]] = len(distinct) + extra.setdefault(first[k], len(extra))
        odd = np.flatnonzero(~np.logical_and.reduceat(good, heads))
        if len(odd):
            pieces, last, lens = [], 0, np.diff(starts)
            for k in odd:
                whole = [len(distinct) + extra.setdefault(c, len(extra)) for c in split_chunks(texts[int(k)].as_py())]
                pieces += [places[last:starts[k]], np.array(whole, dtype=np.int64)]
                last, lens[k] = starts[k + 1], len(whole)
            places, starts = np.concatenate([*pieces, places[last:]]), offsets_of(lens)
        chunks = pa.concat_arrays([named, pa.array(list(extra), pa.large_string())])
        # the same chunk may come both ways
        used = np.bincount(places, minlength=len(chunks)) > 0
        places = (np.cumsum(used) - 1)[places]
        coded = chunks.take(pa.array(np.flatnonzero(used))).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)[places], starts

    def values(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts' chunks, one after another, and where each text's values start (the total last).

        ``texts``: an Arrow array of strings; null counts as empty.
        """
        if not len(texts):
            return np.zeros(0, dtype=self.dtype), np.zeros(1, dtype=np.int64)
        self._forget()
        chunks, places, starts = self._chunks(texts.cast(pa.large_string()).fill_null(""))
        numbers = self._numbers(chunks, np.bincount(places, minlength=len(chunks)))[places]
        lens = self.lens[numbers]
        return gather(self.flat, offsets_of(self.lens)[:-1][numbers], lens), offsets_of(lens)[starts]
