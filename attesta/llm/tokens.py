"""Words of many texts, and a growing table of runs of token ids, for what treats every chunk of a text alone."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class RunTable:
    """Runs of ids in one flat array. `most` runs are kept; a table that is over it starts anew between batches."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.code: dict = {}
        self.starts, self.lens = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.n, self.used = np.zeros(8192, np.int32), 0, 0

    def add(self, runs: list) -> int:
        """Appends runs (lists of ids); the number of the first."""
        lens = np.fromiter(map(len, runs), np.int64, len(runs))
        return self.add_flat(np.fromiter(chain.from_iterable(runs), np.int32, int(lens.sum())), lens)

    def add_flat(self, ids: np.ndarray, lens: np.ndarray) -> int:
        """The same with the runs' ids one after another."""
        first, total = self.n, len(ids)
        while self.n + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.lens[first : first + len(lens)] = lens
        self.starts[first : first + len(lens)] = self.used + np.cumsum(lens) - lens
        self.n, self.used = self.n + len(lens), self.used + total
        return first

    def expand(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries' runs one after another, and each run's length."""
        lens = self.lens[entries]
        return self.flat[gather(self.starts[entries], lens)], lens


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the slices [start, start + len), one after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(int(ends[-1]) if len(ends) else 0)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words (between ASCII white space; an empty one may be among them) of many texts, the place of each
    word in that list, one text after another, and each text's number of words. Null counts as empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), counts
