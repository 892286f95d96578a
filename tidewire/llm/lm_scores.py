"""Cross-entropy difference: a target and a background bigram model over one vocabulary score every document."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import U, runs, split_words, window_hashes, word_hashes
from tidewire.llm.shared import keep, tidy
from tidewire.llm.token_files import slices

#: Bits of the filter that tells the target's ids from most others, as a power of two.
BITS = 26
#: Ids of documents that the filter takes for the target's by mistake: so many are listed; with more, the texts it lets pass are joined.
FALSE = 1 << 20
#: N-gram occurrences of one key group, on average.
GROUP = 1 << 21
#: Occurrences beyond which an n-gram is hot, whatever the input's size, and how many hot ones tasks are told of at most.
HOT, HOT_MOST = GROUP // 64, 1 << 17
#: Added to each bigram's count, as a share of the vocabulary's mass.
SMOOTH = 50.0
#: Bytes of text whose n-grams are counted together before they leave a task.
SLICE = 8 << 20
WORD, CONTEXT, BIGRAM = range(3)
#: Rows of a slice: its documents; keys with counts; the documents that hold each key.
DOCS, KEYS, HOLDERS = range(3)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of little-endian numbers, by byte planes: all first bytes, all second ones and so on."""
    head = np.array([len(a) for a in arrays], "<u4")
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(a.view("u1").reshape(len(a), a.itemsize).T.tobytes() for a in arrays))


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 4 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(data, "<u4", len(kinds)).tolist(), strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, "u1", n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def n_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words; the text, the context key and the bigram key of each word that follows another in its text.

    A word's context count and a bigram's count are two kinds of key: the loss of a word after another is a sum of a term of either.
    """
    bounds, words = split_words(texts)
    h = word_hashes(words)
    who = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(h) < 2:
        return h, np.zeros(0, int), np.zeros(0, U), np.zeros(0, U)
    pairs = who[1:] == who[:-1]
    return h, who[:-1][pairs], window_hashes(h, 1, seed=3)[:-1][pairs], window_hashes(h, 2, seed=4)[pairs]


def vocabulary(docs: DataFrame) -> tuple[int, int, np.ndarray]:
    """The number of distinct words and of words of all documents, and the keys that may be hot, sorted.

    Each slice hands on its distinct words once, and the keys with the share of its n-grams that HOT is of all, estimated from the
    input's bytes: a key with a share of all n-grams has it in some slice.
    """
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    share = max(HOT / max(n_bytes / 4, 1), 1 / HOT_MOST)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE):
                h, _, context, bigram = n_grams(part.column("text"))
                least = max(2, share * len(context))
                own, n = np.unique(h, return_counts=True)
                often = n >= least
                # a frequent word is a frequent context, but for texts that it ends; frequent bigrams begin with one
                seen = window_hashes(own[often], 1, seed=3)
                pairs, m = np.unique(bigram[np.isin(context, seen)], return_counts=True)
                found = [own, seen, pairs[m >= least]]
                kinds = np.repeat(np.array([WORD, CONTEXT, BIGRAM], np.int32), [len(x) for x in found])
                counts = [n, n[often], m[m >= least]]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=["kind", "w", "n"])

    every = docs.select("text").mapInArrow(run, "kind int, w long, n long").groupBy("kind", "w").agg(F.sum("n").alias("n"))
    every = keep(every.filter((F.col("kind") == WORD) | (F.col("n") >= HOT / 2)), "vocabulary")
    r = every.filter(F.col("kind") == WORD).agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    hot = every.filter(F.col("kind") != WORD).orderBy(F.desc("n"), "w").limit(HOT_MOST).select("w").collect()
    return r.v, r.n, np.sort(np.array([x.w for x in hot], np.int64).view(U))


def told_target(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """`docs` with what tells which rows have a doc_id among `ids` (doc_id, long), and a function of its batches that tells it.

    A bit map of the ids' hashes, of a fixed size, lets all of them pass and a few others; those others are listed, from the ids
    alone, so no text travels. Where they are more than FALSE, the texts that pass are joined with `ids`, and kept.
    """

    def bit() -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(1 << BITS))

    own = ids.filter("doc_id IS NOT NULL").select("doc_id")
    blocks = own.select(bit().alias("b")).groupBy(F.shiftright("b", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(32767)).alias("bits")).toArrow()
    bits = np.zeros((max(1, 1 << BITS >> 15), 4096), np.uint8)
    for block, x in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        bits[block] = np.frombuffer(x, np.uint8)
    sc = docs.sparkSession.sparkContext
    packed = sc.broadcast(bits.reshape(-1))

    def passes(b: np.ndarray) -> np.ndarray:
        return (packed.value[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)

    @F.pandas_udf("boolean")
    def maybe(b: pd.Series) -> pd.Series:
        return pd.Series(passes(b.to_numpy()))

    some = docs.filter(F.col("doc_id").isNotNull()).filter(maybe(bit()))
    wrong = some.select("doc_id").join(own, "doc_id", "left_anti").distinct().limit(FALSE + 1).toArrow().column("doc_id").to_numpy()
    if len(wrong) > FALSE:
        some = some.join(own.distinct().withColumn("own", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.col("own").isNotNull().alias("own"))
        rest = docs.filter(F.col("doc_id").isNull() | ~maybe(F.coalesce(bit(), F.lit(0)))).select("doc_id", "text", F.lit(False).alias("own"))
        return rest.unionByName(keep(some, "target")), lambda part: part.column("own").to_numpy(zero_copy_only=False)
    listed = sc.broadcast(np.sort(wrong))

    def told(part: pa.RecordBatch) -> np.ndarray:
        known, at = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False), part.column("bit").to_numpy()
        yes = known & passes(at)
        if len(listed.value):
            doc = part.column("doc_id").fill_null(0).to_numpy()
            yes &= listed.value[np.minimum(np.searchsorted(listed.value, doc), len(listed.value) - 1)] != doc
        return yes

    return docs.withColumn("bit", bit()), told


def hot_terms(docs: DataFrame, told: Callable[[pa.RecordBatch], np.ndarray], hot: np.ndarray, words: int, smooth: float) -> np.ndarray:
    """The terms of the hot keys, from their counts in all documents and in the target's."""
    if not len(hot):
        return np.zeros(0)

    @tidy
    def run(batches):
        for batch in batches:
            for part in slices(batch, size=SLICE // 4):
                is_target = told(part)
                _, who, *keys = n_grams(part.column("text"))
                for kind, key in zip((CONTEXT, BIGRAM), keys, strict=True):
                    place = np.searchsorted(hot, key)
                    mine = hot[np.minimum(place, len(hot) - 1)] == key
                    place, own = place[mine], is_target[who[mine]]
                    n, t = np.bincount(place, minlength=len(hot)), np.bincount(place[own], minlength=len(hot))
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[some]), pa.array(t[some])], names=["kind", "place", "n", "t"])

    out = np.zeros(len(hot))
    for r in docs.mapInArrow(run, "kind int, place long, n long, t long").groupBy("kind", "place").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
        out[r.place] = float(_terms(np.array([r.kind == BIGRAM]), np.array([r.t]), np.array([r.n]), words, smooth)[0])
    return out


def _terms(bigram: np.ndarray, target: np.ndarray, total: np.ndarray, words: int, smooth: float) -> np.ndarray:
    """Target loss minus background loss of w after v is the sum of log(c(v) + smooth) and -log(c(v, w) + smooth / words) in either."""
    add = np.where(bigram, smooth / max(words, 1), smooth)
    return np.where(bigram, -1.0, 1.0) * (np.log(target + add) - np.log(total + add))


def dealt(task: int, k: int, n: int) -> int:
    """One of n places for a task's k-th item: two golden-ratio-like steps, so that few of all items share one, as they would by a hash."""
    return ((task * 0x9E3779B9 + k * 0x6A09E667 & 0xFFFFFFFF) * n) >> 32


def _grouped(key: np.ndarray, kind: np.ndarray, who: np.ndarray, is_target: np.ndarray, hot: np.ndarray, terms: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[int, int, bytes]], tuple]:
    """The sums of hot terms by document; of all other n-grams (g, place of its first key, keys with counts), and their holders:
    the number of documents of each key, these documents, and how often each holds it. Documents rise for each kind of key."""
    n = len(is_target)
    order = np.argsort(key, kind="stable")  # groups rise with their keys
    key, kind, who = key[order], kind[order], who[order]
    del order
    head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    at = np.flatnonzero(head | np.concatenate([[True], who[1:] != who[:-1]])[: len(key)])
    times = np.diff(at, append=len(key)).astype(np.uint32)
    lead = np.flatnonzero(head[at])
    key, kind, who = key[at][lead], kind[at][lead], who[at]
    per_key = np.diff(lead, append=len(at))
    c_all, c_target = (np.add.reduceat(x, lead) if len(lead) else x for x in (times, times * is_target[who]))
    add = np.zeros(n)
    if len(hot) and len(key):
        place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[place] == key
        mine = np.repeat(is_hot, per_key)
        add = np.bincount(who[mine], np.repeat(terms[place[is_hot]], per_key[is_hot]) * times[mine], n)
        who, times = who[~mine], times[~mine]
        key, kind, c_all, c_target, per_key = (x[~is_hot] for x in (key, kind, c_all, c_target, per_key))
    cuts, out = np.searchsorted(((key >> U(32)) * U(groups)) >> U(32), np.arange(groups + 1).astype(U)), []
    for g in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = int(cuts[g]), int(cuts[g + 1])
        out.append((g, a, _zip(np.diff(key[a:b], prepend=U(0)).astype("<u8"), kind[a:b], c_all[a:b].astype("<u4"), c_target[a:b].astype("<u4"))))
    return add, out, (per_key.astype("<u4"), who.astype("<u4"), times.astype("<u4"))


def counted(docs: DataFrame, told: Callable[[pa.RecordBatch], np.ndarray], groups: int, hot: np.ndarray, terms: np.ndarray) -> DataFrame:
    """Rows (g, slice, home, part, place, blob): a slice's n-grams of one key group, each once, with counts; `place` is the rank of
    the first of them in the slice, `home` the partition that the slice's rows meet in.

    More rows a slice, dealt over the groups, have its documents, their numbers of pairs and their sums of hot terms, and the
    documents that hold each key, by the same ranks.
    """

    @tidy
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, size=SLICE):
                ids = part.column("doc_id").to_pylist()
                is_target, n = told(part), len(ids)
                _, who, *keys = n_grams(part.column("text"))
                n_pairs, add = np.bincount(who, minlength=n), np.zeros(n)
                who = who.astype(np.uint32)
                place, rows = 0, []
                for q in range(4):  # a quarter of the keys, and so of the groups, at a time
                    some = [np.flatnonzero(key >> U(62) == U(q)) for key in keys]
                    key, at = np.concatenate([key[i] for key, i in zip(keys, some, strict=True)]), np.concatenate([who[i] for i in some])
                    hot_sums, found, holders = _grouped(key, np.repeat(np.array([0, 1], np.uint8), [len(i) for i in some]), at, is_target, hot, terms, groups)
                    del some, key, at
                    add += hot_sums
                    rows += [(g, KEYS, place + first, blob) for g, first, blob in found]
                    rows.append((dealt(task, 4 * k + q, groups), HOLDERS, place, _zip(*holders)))
                    place += len(holders[0])
                    del found, holders
                rows.append((dealt(task, 4 * k, groups), DOCS, 0, _zip(np.array([d if d is not None else -(2**63) for d in ids], "<i8"), n_pairs.astype("<i8"), add.astype("<f8"))))
                gs, parts, places, blobs = zip(*rows, strict=True)
                name, home = pa.array([(task << 32) + k] * len(gs), pa.int64()), pa.array([dealt(task, k, groups)] * len(gs), pa.int32())
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int32()), name, home, pa.array(parts, pa.int32()), pa.array(places, pa.int64()), pa.array(blobs, pa.binary())], names=["g", "slice", "home", "part", "place", "blob"])

    return docs.mapInArrow(run, "g int, slice long, home int, part int, place long, blob binary")


def totals(blobs: DataFrame, groups: int) -> DataFrame:
    """Rows (slice, home, part, place, blob): the keys of a slice give way to their kinds and counts in all documents and in the target's.

    What a slice gets back hangs on the number of its keys, not on the number of groups.
    """

    @tidy
    def run(batches):
        for t in runs(batches, "g"):
            blobs = t.column("blob").to_pylist()
            which = np.flatnonzero(t.column("part").to_numpy() == KEYS).tolist()
            parts = [_unzip(blobs[i], "<u8", "u1", "<u4", "<u4") for i in which]
            own, at = np.unique(np.concatenate([np.zeros(0, U), *(np.cumsum(p[0], dtype=U) for p in parts)]), return_inverse=True)
            every, target = (np.bincount(at, np.concatenate([np.zeros(0), *(p[c] for p in parts)]), len(own)).astype("<i8") for c in (2, 3))
            first = 0
            for i, p in zip(which, parts, strict=True):
                mine = at[first : first + len(p[0])]
                first += len(p[0])
                blobs[i] = _zip(p[1], every[mine], target[mine])
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("slice", "home", "part", "place")] + [pa.array(blobs, pa.binary())], names=["slice", "home", "part", "place", "blob"])

    return blobs.repartitionById(groups, "g").sortWithinPartitions("g").mapInArrow(run, "slice long, home int, part int, place long, blob binary")


def lm_scores(docs: DataFrame, target_ids: list[int] | DataFrame, smooth: float = SMOOTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pairs (words after another) and score: mean target loss minus mean background loss per word, in nats; less is nearer.

    The background model counts every document, the target model those of `target_ids` (a list, or a frame of any size
    with the column doc_id; null counts for nothing), whole and all; both are bigram models with smoothing towards the one vocabulary of all documents. Texts of fewer than two words, and null ones, have score null. Repeated
    rows are scored, and counted, each. An empty table gives an empty result; other columns are not read.

    N-grams go once per slice of documents to the group of their key, which holds all counts of a key and sends each slice the
    counts of its keys. Hot n-grams, which most documents hold, go nowhere: their counts alone are summed beforehand, and a slice
    adds their terms itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words, total, hot = vocabulary(rows)
    ids = target_ids if isinstance(target_ids, DataFrame) else docs.sparkSession.createDataFrame([(d,) for d in target_ids], "doc_id long")
    rows, told = told_target(rows, ids.select(F.col("doc_id").cast("long").alias("doc_id")))
    terms = hot_terms(rows, told, hot, words, smooth)
    groups = max(1, -(-2 * total // GROUP))
    counts = totals(counted(rows, told, groups, hot, terms), groups)

    @tidy
    def run(batches):
        for t in runs(batches, "slice"):
            parts, places, blobs = (t.column(c).to_pylist() for c in ("part", "place", "blob"))
            ids, n, sums = _unzip(blobs[0], "<i8", "<i8", "<f8")
            term = [np.zeros(0)]
            for part, place, blob in zip(parts, places, blobs, strict=True):
                if part == KEYS:  # in the order of their places
                    kind, every, target = _unzip(blob, "u1", "<i8", "<i8")
                    term.append(_terms(kind.astype(bool), target, every, words, smooth))
                elif part == HOLDERS:
                    term = [np.concatenate(term)]
                    per_key, who, times = _unzip(blob, "<u4", "<u4", "<u4")
                    sums = sums + np.bincount(who, np.repeat(term[0][place : place + len(per_key)], per_key) * times, len(n))
            score = np.where(n > 0, sums / np.maximum(n, 1), np.nan)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == -(2**63)), pa.array(n), pa.array(score, mask=n == 0)], names=["doc_id", "n_pairs", "score"])

    return counts.repartitionById(groups, "home").sortWithinPartitions("slice", "part", "place").mapInArrow(run, "doc_id long, n_pairs long, score double")


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id of all documents that are labelled good."""
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
