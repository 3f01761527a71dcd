"""Byte-level BPE of many texts at once, with each distinct word encoded once.

A text is cut before every run of ASCII white space.  The tokenizer's own split has a cut there too, and it
encodes the pieces of its split each for itself, so a text's ids are those of its segments, one after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.byte_bpe import ByteBPE
from lodestone.llm.text import SPACE_CHARS

_SPACE = SPACE_CHARS.encode()
_BLANK = np.isin(np.arange(256), list(_SPACE))
#: Characters of a segment from which on texts that hold it are encoded whole.
LONG = 10_000


def _raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of large_binary."""
    offsets = np.frombuffer(values.buffers()[1] or bytes(8), np.int64)[values.offset : values.offset + len(values) + 1]
    return offsets - offsets[0], np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


class WordBPE:
    """Keeps the words met since clear(), each behind one blank, and their ids."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        if any(c in a for a in bpe.added for c in SPACE_CHARS):
            raise ValueError("an added token holds white space")
        self.added = [a.encode() for a in bpe.added]
        self.width = np.zeros(65536, np.int64)  # bytes of each id
        self.width[list(bpe.ranks.values())] = list(map(len, bpe.ranks))
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.begins = pa.array([], pa.large_binary()), np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def _encoded(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, each segment's end in them) of segments that begin with white space and end in a word.

        Those whose ids may depend on what stands around them have none: white space beyond ASCII could go on
        after them.
        """
        offsets, data = _raw(segments)
        sizes = np.diff(offsets)
        odd, last = sizes >= LONG, data[offsets[1:] - 1]
        for i in np.flatnonzero((last > 127) | (last >= 28) & (last < 32)):
            odd[i] |= segments[int(i)].as_py().decode()[-1].isspace()
        line = data.tobytes()
        if any(a in line for a in self.added):
            odd |= np.array([any(a in s for a in self.added) for s in segments.to_pylist()])
        if odd.any():
            sizes[odd], line = 0, _raw(segments.filter(pa.array(~odd)))[1].tobytes()
        ids = np.array(self.bpe.ordinary(line.decode()), np.uint16)
        return ids, np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes), side="right")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end, numbers of all words, where each text's begin)."""
        texts = texts.cast(pa.large_binary())
        offsets, data = _raw(texts)
        blank = _BLANK[data]
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        cuts = np.append(np.flatnonzero(starts), len(data))
        first = np.searchsorted(cuts[:-1], offsets)  # segment of each text
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        at, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        begin, heads = _raw(distinct)
        second = heads[np.minimum(begin[:-1] + 1, len(heads) - 1)] if len(heads) else heads
        plain = (heads[begin[:-1]] == 32) & (np.diff(begin) > 1) & ~_BLANK[second]
        others = np.flatnonzero(~plain)
        rest = distinct.take(pa.array(others)).to_pylist()

        # each segment's word gets its number, -1 where there is none
        bare = [s.strip(_SPACE) for s in rest]
        keys = pa.concat_arrays([distinct.filter(pa.array(plain)), pa.array([b" " + w for w in bare if w], pa.large_binary())])
        found = pc.index_in(keys, value_set=self.words)
        fresh = keys.filter(found.is_null()).dictionary_encode()
        numbers = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        numbers[found.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + fresh.indices.to_numpy(zero_copy_only=False)
        number = np.full(len(distinct), -1, np.int32)
        number[np.concatenate([np.flatnonzero(plain), others[np.array([len(w) > 0 for w in bare], bool)]])] = numbers
        ids, ends = self._encoded(fresh.dictionary)
        self.words = pa.concat_arrays([self.words, fresh.dictionary])
        self.begins = np.append(self.begins, len(self.ids) + ends)
        self.ids = np.append(self.ids, ids)

        begin, count = self.begins[number], self.begins[number + 1] - self.begins[number]
        pool = [self.ids]
        if rest:
            # a word without white space before it gets a line feed, whose id is dropped
            first_word = np.array([s[0] not in _SPACE for s in rest])
            alone = [not w or f and w.decode()[0].isspace() for w, f in zip(bare, first_word)]
            ids, ends = self._encoded(pa.array([b" x" if a else b"\n" + s if f else s for s, a, f in zip(rest, alone, first_word)], pa.large_binary()))
            begin[others] = len(self.ids) + np.append(0, ends[:-1]) + first_word
            count[others] = np.maximum(np.diff(ends, prepend=0) - first_word, 0)
            pool.append(ids)
            size = len(self.ids) + len(ids)
            for i, s, a in zip(others, rest, alone):
                if a:
                    own = np.array(self.bpe.ids(s.decode()), np.uint16)
                    begin[i], count[i], size = size, len(own), size + len(own)
                    pool.append(own)

        count, begin = count[at], begin[at]
        line = np.append(0, np.cumsum(count))
        out = np.concatenate(pool)[np.repeat(begin - line[:-1], count) + np.arange(line[-1])]
        where, word = line[first], number[at]
        real = word >= 0
        places = np.append(0, np.cumsum(real))[first]
        whole = np.unique(np.searchsorted(first, np.flatnonzero(count == 0), side="right") - 1)
        if len(whole):
            parts = [out[a:b] for a, b in zip(where, where[1:])]
            for i in whole:
                parts[i] = np.array(self.bpe.ids(texts[i].as_py().decode()), np.uint16)
            out, where = np.concatenate(parts), np.append(0, np.cumsum(list(map(len, parts))))
        return out, where, word[real], places
