"""Words of many texts at a time, as spans over their Arrow buffers."""

from __future__ import annotations

import numpy as np

#: The widespread pattern of byte-level BPE that Splitter finds without a regular expression. Fixed value.
COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are split at a time, if no single text is longer.
SLICE = 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs of `size` that start at `at`, in a row."""
    ends = np.cumsum(size)
    return np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def stretches(sizes: np.ndarray, most: int):
    """(first, end) of stretches of rows of about `most` in sum, if no single row has more."""
    if len(sizes):
        ends = np.cumsum(sizes, dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(sizes)]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def slices(texts, size: int = SLICE):
    """(first row, string array without nulls) of stretches of about `size` bytes; a null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    for a, b in stretches(pc.binary_length(texts).to_numpy(zero_copy_only=False), size):
        yield a, texts.slice(a, b - a)


def _classes() -> np.ndarray:
    import regex

    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, OTHER, np.uint8)
    for kind, form in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(form, every):
            out[m.start() : m.end()] = kind
    return out


class Splitter:
    """split(texts) -> (words, firsts): all matches of the pattern in a row, and where each text's words begin, and the end.

    Texts are UTF-8 and not null. COMMON covers every character, so its words are cut by a mask of their starts; matches of any
    other pattern are found by the regex library, text by text.
    """

    def __init__(self, pattern: str):
        import regex

        self.classes = _classes() if pattern == COMMON else None
        self.find = regex.compile(pattern)

    def __call__(self, texts):
        import pyarrow as pa

        if self.classes is None:
            # an empty match is no word
            found = [[m.group() for m in self.find.finditer(t) if m.group()] for t in texts.to_pylist()]
            return pa.array([w for x in found for w in x], pa.string()), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = self._starts(data, offsets)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
        return words, np.searchsorted(starts, offsets)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The bytes at which words start."""
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        n = len(at)
        if not n:
            return at
        lead = data[at]
        c = self.classes[lead] if n == len(data) else self.classes[self._points(data, at)]
        new = np.zeros(n + 3, bool)  # a text starts
        new[np.searchsorted(at, offsets[:-1])] = True
        new[n:] = True
        start = new.copy()
        start[1:n] |= c[1:] != c[:-1]
        # The last of a run of spaces stands apart if more text follows; a plain space goes to what follows.
        space = c == SPACE
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~new[1:n]
        start[:n] |= last
        start[np.flatnonzero(last & (lead == 0x20)) + 1] = False
        # An apostrophe that starts a word takes s, t, m, d, re, ve or ll.
        k = np.flatnonzero((lead == 0x27) & start[:n])
        k = k[~new[k + 1]]
        k = k[c[k + 1] == LETTER]
        pad = np.append(lead, [0, 0, 0])
        one, two = pad[k + 1], np.where(new[k + 2], 0, pad[k + 2])
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        wide = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))
        start[k[short | wide] + 1] = False
        start[k[short] + 2] = True
        start[k[wide] + 3] = True
        return at[start[:n]]

    @staticmethod
    def _points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code points of the characters that start at `at`."""
        pad = np.append(data, [0, 0, 0]).astype(np.uint8)
        lead = pad[at]
        out = lead.astype(np.int32)
        for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            k = np.flatnonzero((lead >= low) & (lead < high))
            point = (lead[k] & mask).astype(np.int32)
            for j in range(1, more + 1):
                point = point << 6 | (pad[at[k] + j] & 0x3F)
            out[k] = np.minimum(point, 0x10FFFF)
        return out
