"""Exact substring dedup: consecutive windows that share a minimiser travel as one packed string to its bucket and are counted there."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import U, mixed, runs, split_words, window_hashes, word_hashes
from tidewire.llm.shared import keep, tidy
from tidewire.llm.token_files import slices

#: Words of the m-gram whose least hash is a window's minimiser.
M = 4
#: Windows of one bucket group, on average.
GROUP = 1 << 20
#: Windows beyond which a minimiser is hot, whatever the input's size, and how many hot ones tasks are told of at most.
HOT, HOT_MOST = GROUP // 16, 1 << 18
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def super_kmers(bounds: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in all words), windows and minimiser of each run of windows that share a minimiser."""
    n = len(h) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    low, span, want = window_hashes(h, M), 1, width - M + 1
    while span < want:  # least of the next `span` m-grams, by doubling
        step = min(span, want - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[:n] == text[width - 1 : width - 1 + n]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (text[1:n] != text[: n - 1])
    start = np.flatnonzero(begins)
    at = np.cumsum(begins) - 1
    count = np.bincount(at[whole], minlength=len(start))
    return text[start], start, count, low[start]


def _rolling(codes: np.ndarray, width: int, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A hash of the `width` codes from each place of `at` (rising), in constant time each and bounded memory beside the result:
    sums of code * ODD**i over a stretch, divided by ODD**i modulo 2**64."""
    n = min(len(codes), step + width)
    up = np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), U(ODD))]))[:n]
    down = np.cumprod(np.concatenate([[U(1)], np.full(max(n - 1, 0), U(ODD_INVERSE))]))[:n]
    out = np.zeros(len(at), U)
    for lo in range(0, len(codes), step):
        part = codes[lo : lo + step + width]
        i, j = np.searchsorted(at, [lo, lo + step])
        total = np.concatenate([[U(0)], np.cumsum(mixed(part.astype(U) + U(1)) * up[: len(part)])])
        k = at[i:j] - lo
        out[i:j] = mixed((total[k + width] - total[k]) * down[k])
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range, in a row."""
    upto = np.cumsum(length)
    return np.repeat(start - upto + length, length) + np.arange(upto[-1] if len(upto) else 0)


def _stretches(owner: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """text, first and last of the stretches of words that windows cover; `start` counts words of all texts and rises."""
    order = np.argsort(start, kind="stable")
    owner, start = owner[order], start[order]
    opens = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + width)]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return np.stack([owner[first], start[first], start[last] + width], axis=1)


def _pack(words: pa.Array, alpha: np.ndarray, codes: np.ndarray, width: int, doc: np.ndarray, key: np.ndarray, start: np.ndarray, local: np.ndarray, count: np.ndarray, twice: np.ndarray, known: np.ndarray) -> bytes:
    """Super-k-mers as one string: their words once, then numbers. `known`: text, first and last word of stretches known to repeat."""
    used, at, times = np.unique(codes[_ranges(start, count + width - 1)], return_inverse=True, return_counts=True)
    # frequent words get small numbers, whose upper bytes are zeros; words of like frequency are in alphabetical order
    order = np.argsort((64 - np.floor(np.log2(times)).astype(np.int64) << 40) + alpha[used])
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    used, at = used[order], place[at]
    # joined in Arrow: a Python string for each word would take most of the time
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), words.take(pa.array(used)).cast(pa.string())), "\n")[0].as_py().encode()
    docs, own = np.unique(np.concatenate([doc, known[:, 0]]), return_inverse=True)
    head = np.array([len(text), len(at), len(start), len(docs), len(known)], "<i8")
    parts = [head, text, np.ascontiguousarray(at.astype("<u4").view("u1").reshape(-1, 4).T), key[docs].astype("<i8"), own[: len(doc)].astype("<u4"), local.astype("<u4"), count.astype("<u4"), twice.astype("u1"), own[len(doc) :].astype("<u4"), known[:, 1].astype("<u4"), known[:, 2].astype("<u4")]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def _unpack(blob: bytes) -> tuple:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n_text, n_at, n, n_docs, n_known = np.frombuffer(data, "<i8", 5).tolist()
    # split in Arrow: millions of words as Python strings would take most of a worker's memory
    text, at = pa.array([data[40 : 40 + n_text]], pa.large_binary()).cast(pa.large_string()), 40 + n_text
    out = []
    out.append(np.frombuffer(data, "u1", 4 * n_at, at).reshape(4, n_at).T.copy().view("<u4").ravel())  # byte planes
    at += 4 * n_at
    for kind, size in (("<i8", 2 * n_docs), ("<u4", n), ("<u4", n), ("<u4", n), ("u1", n), ("<u4", n_known), ("<u4", n_known), ("<u4", n_known)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * int(np.dtype(kind).itemsize)
    return pc.split_pattern(text, "\n").flatten() if n_text else pa.array([], pa.large_string()), *out


def frequent(docs: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The number of windows of all documents, and the hot minimisers.

    A minimiser with a share of all windows has that share in some slice, so slices report what has the share that HOT is of the
    input, estimated from its bytes, and no slice more than the inverse of that share.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = max(HOT / max(n_bytes / 4, 1), 1 / HOT_MOST)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                bounds, words = split_words(part.column("text"))
                _, _, count, low = super_kmers(bounds, word_hashes(words), width)
                m, at = np.unique(low, return_inverse=True)
                n = np.bincount(at, count, len(m)).astype(np.int64)
                hot = n >= max(2, share * int(n.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([None] + m[hot].view(np.int64).tolist(), pa.int64()), pa.array([int(n.sum())] + n[hot].tolist(), pa.int64())], names=["m", "windows"])

    found = keep(docs.select("text").mapInArrow(run, "m long, windows long").groupBy("m").agg(F.sum("windows").alias("windows")), "minimisers")
    total = found.filter("m IS NULL").first()
    if total is None:
        return 0, np.zeros(0, U)
    hot = found.filter((F.col("m").isNotNull()) & (F.col("windows") >= HOT / 2)).orderBy(F.desc("windows"), "m").limit(HOT_MOST).select("m").collect()
    return total.windows, np.sort(np.array([r.m for r in hot], np.int64).view(U))


def packed(docs: DataFrame, width: int, groups: int, hot: np.ndarray) -> DataFrame:
    """Rows (g, blob): for each slice of documents and bucket group, the super-k-mers of its buckets.

    Windows of a hot minimiser go singly, to the bucket of their whole hash; of equal ones in a slice one goes, marked as found twice.
    Where those lie is known then: they leave as the stretches of words that they cover, to any group.
    """

    @tidy

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                bounds, flat = split_words(part.column("text"))
                h = word_hashes(flat)
                d = flat.dictionary_encode()
                codes = d.indices.to_numpy()
                alpha = np.argsort(pc.sort_indices(d.dictionary).to_numpy())
                key = np.stack([part.column("doc").to_numpy(), part.column("h").to_numpy()], axis=1)
                text, start, count, low = super_kmers(bounds, h, width)
                bucket, twice = mixed(low), np.zeros(len(start), bool)
                known = np.zeros((0, 3), np.int64)
                is_hot = np.isin(low, hot)
                if is_hot.any():
                    singles = _ranges(start[is_hot], count[is_hot])
                    owner = np.repeat(text[is_hot], count[is_hot])
                    own = window_hashes(h, width, seed=1)[singles]
                    _, first, place, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
                    more = times[place] > 1
                    known = _stretches(owner[more], singles[more], width)
                    known[:, 1:] -= bounds[known[:, 0], None]
                    cold = ~is_hot
                    text, start = np.concatenate([text[cold], owner[first]]), np.concatenate([start[cold], singles[first]])
                    count = np.concatenate([count[cold], np.ones(len(first), np.int64)])
                    bucket, twice = np.concatenate([bucket[cold], own[first]]), np.concatenate([np.zeros(int(cold.sum()), bool), times > 1])
                group, known_group = (bucket % U(groups)).astype(np.int64), (mixed(key[known[:, 0], 1].view(U)) % U(groups)).astype(np.int64)
                order, known_order = np.argsort(group, kind="stable"), np.argsort(known_group, kind="stable")
                cuts = np.searchsorted(group[order], np.arange(groups + 1))
                known_cuts = np.searchsorted(known_group[known_order], np.arange(groups + 1))
                gs, blobs = [], []
                for g in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(known_cuts) > 0)).tolist():
                    i, j = order[cuts[g] : cuts[g + 1]], known_order[known_cuts[g] : known_cuts[g + 1]]
                    gs.append(g)
                    blobs.append(_pack(d.dictionary, alpha, codes, width, text[i], key, start[i], start[i] - bounds[text[i]], count[i], twice[i], known[j]))
                yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(blobs, pa.binary())], names=["g", "blob"])

    return docs.mapInArrow(run, "g long, blob binary")


def _repeated(codes: np.ndarray, at: np.ndarray, twice: np.ndarray, width: int) -> np.ndarray:
    """Which windows (beginning at `at`) have a sequence that another window has too: sorted by hash, then compared word by word."""
    if not len(at):
        return np.zeros(0, bool)
    h = _rolling(codes, width, at)
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    first = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
    group = np.cumsum(first) - 1
    lead = order[np.flatnonzero(first)][group]
    same = np.ones(len(at), bool)
    check = np.flatnonzero(~first)
    for k in range(width):
        same[check] &= codes[at[order[check]] + k] == codes[at[lead[check]] + k]
    size, marked = np.bincount(group)[group], np.bincount(group, weights=twice[order])[group]
    out = np.zeros(len(at), bool)
    out[order] = (size > 1) | (marked > 0)
    for g in np.unique(group[check[~same[check]]]):  # two sequences with one hash: count them by their words
        members = order[group == g]
        names = [codes[at[i] : at[i] + width].tobytes() for i in members]
        out[members] = [names.count(x) > 1 or any(twice[j] for j, y in zip(members, names, strict=True) if y == x) for x in names]
    return out


def covered(blobs: DataFrame, groups: int, width: int) -> DataFrame:
    """doc, h and spans: the stretches of words [first, last) of a document that a group finds in repeated windows, in one row."""

    @tidy

    def run(batches):
        for t in runs(batches, "g"):
            parts = [_unpack(b) for b in t.column("blob").to_pylist()]
            words = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
            base = np.cumsum([0] + [len(p[0]) for p in parts])
            code = words.indices.to_numpy()
            codes = np.concatenate([code[b:e][p[1]] for p, b, e in zip(parts, base[:-1], base[1:], strict=True)])
            count = np.concatenate([p[5] for p in parts]).astype(np.int64)
            begin = np.cumsum(count + width - 1) - (count + width - 1)
            at = _ranges(begin, count)
            kmer = np.repeat(np.arange(len(count)), count)
            twice = np.repeat(np.concatenate([p[6] for p in parts]), count)
            found = _repeated(codes, at, twice, width) & (twice == 0)  # where the others are is known
            key = np.concatenate([p[2].reshape(-1, 2) for p in parts])
            docs = np.cumsum([0] + [len(p[2]) // 2 for p in parts])
            owner = np.concatenate([p[3].astype(np.int64) + b for p, b in zip(parts, docs, strict=False)])
            local = np.concatenate([p[4] for p in parts]).astype(np.int64)
            # runs of found windows within a super-k-mer
            opens = found.copy()
            opens[1:] &= ~found[:-1] | (kmer[1:] != kmer[:-1])
            i = np.flatnonzero(opens)
            length = np.bincount((np.cumsum(opens) - 1)[found], minlength=len(i))
            first = local[kmer[i]] + at[i] - begin[kmer[i]]
            who, last = owner[kmer[i]], first + length + width - 1
            known = np.concatenate([p[7].astype(np.int64) + b for p, b in zip(parts, docs, strict=False)])
            who = np.concatenate([who, known])
            first, last = (np.concatenate([x, *(p[k] for p in parts)]).astype(np.int32) for k, x in ((8, first), (9, last)))
            order = np.argsort(who, kind="stable")
            who, spans = who[order], pa.StructArray.from_arrays([pa.array(first[order]), pa.array(last[order])], names=["first", "last"])
            heads = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, int)
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(who)), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([pa.array(key[who[heads], 0]), pa.array(key[who[heads], 1]), lists], names=["doc", "h", "spans"])

    return blobs.repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions("g").mapInArrow(run, "doc long, h long, spans array<struct<first: int, last: int>>")


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text: words in a window of `width` words whose sequence starts elsewhere too are removed.

    Windows are judged on the input, all at once: every copy goes. Kept words are joined by one space. Null and empty texts, and texts
    of fewer than `width` words, have no window; a null doc_id is fine. Rows that repeat count as places of their own. An empty table
    gives an empty result; other columns are not read.

    A bucket group holds what hashing deals it; the few minimisers that are too frequent for one (copies, common lines) are found
    beforehand, and their windows go to buckets of their own, once for each slice of documents.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("h"), "text")
    windows, hot = frequent(rows, width)
    groups = max(1, -(-windows // GROUP))
    found = covered(packed(keyed, width, groups, hot), groups, width)
    spans = found.groupBy("doc", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    whole = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("h")).join(spans, ["doc", "h"], "left").select("doc_id", "text", "spans")

    @tidy

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                bounds, flat = split_words(part.column("text"))
                step = np.zeros(len(flat) + 1, np.int64)
                spans = part.column("spans")
                some = spans.drop_null() if spans.null_count else spans
                if len(some):
                    owner = np.repeat(np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)), pc.list_value_length(some).to_numpy())
                    pairs = some.flatten()
                    np.add.at(step, bounds[owner] + pairs.field("first").to_numpy(), 1)
                    np.add.at(step, bounds[owner] + pairs.field("last").to_numpy(), -1)
                left = np.cumsum(step)[:-1] == 0
                upto = np.concatenate([[0], np.cumsum(left)])[bounds]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), flat.filter(pa.array(left)).cast(pa.string()))
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(n - np.diff(upto)), pc.binary_join(lists, " ")], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle(width: int = 35) -> str:
    """The registered query in DuckDB."""
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY v) AS c FROM g),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i FROM r WHERE c > 1), (SELECT unnest(range(0, {width})) AS o)),
y AS (SELECT doc_id, list(i) AS l FROM x GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(l), 0) AS m, w, l FROM d LEFT JOIN y USING (doc_id)),
f AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM x) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN f USING (doc_id)"""
