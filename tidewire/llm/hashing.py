"""Word and window hashes of many texts at once, and runs of equal keys in sorted batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finalizer)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each text's words, and all words; a null text has none."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    bounds = bounds - bounds[0]
    some = pc.not_equal(flat, "")
    if not pc.all(some).as_py():  # an empty text splits into one empty word
        upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
        bounds, flat = upto[bounds], flat.filter(some)
    return bounds, flat


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    d = words.dictionary_encode()
    if not len(d.dictionary):
        return np.zeros(0, U)
    return pd.util.hash_array(np.array(d.dictionary.to_pylist(), dtype=object), categorize=False)[d.indices.to_numpy()]


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes; there are max(0, n - k + 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j, m in enumerate(odd_numbers(k, seed)):
        out += h[j : j + n] * m
    return mixed(out)


def runs(batches, key: str):
    """Tables of the rows of equal key, from batches sorted by key; memory holds one run and one batch."""
    left: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if left and k[a] != last:
                yield pa.concat_tables(left)
                left = []
            left.append(t.slice(a, b - a))
            last = k[a]
    if left:
        yield pa.concat_tables(left)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member reachable from each of n members over links a - b."""
    out = np.arange(n)
    while True:
        low = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, out[a], low)
        np.minimum.at(new, out[b], low)
        new = new[new]
        if (new == out).all():
            return out
        out = new
