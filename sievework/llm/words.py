"""Words of many texts at once, as numbers: bounds, counts per text, and codes of equal words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a word under ``[^\x20\x09-\x0D]+``: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word under ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case: digits, a-z, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of texts given as UTF-8 bytes behind each other and their n + 1 offsets; no word crosses texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        if len(data):
            np.logical_not(inside[:-1], out=before[1:])
            np.logical_not(inside[1:], out=after[:-1])
            before |= cut[:-1]
            after |= cut[1:]
        self.data = data
        self.inside = inside
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        #: Number of the first word of every text, and of all words at the end.
        self.first = np.searchsorted(self.starts, offsets)

    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """Code of every word and the different words in order of codes (first occurrence)."""
        place = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        letters = np.ascontiguousarray(self.data[self.inside])
        whole = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(place), pa.py_buffer(letters)])
        coded = whole.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
