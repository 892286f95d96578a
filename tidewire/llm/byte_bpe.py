"""Byte-level BPE: ranked merges folded over the bytes of words with higher-order functions and a literal rank map.

Texts are split and words looked up over Arrow buffers; of the words that the dictionary does not have, each stretch of texts folds
every one once.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewire.llm.shared import keep, let, tidy
from tidewire.llm.word_spans import Splitter, ragged, slices, stretches

#: Buckets of the literal map. A Spark map is searched from its start, so the map is held as an array of very small maps by key.
PAIR_BUCKETS = 262_139
#: Bounds of the dictionary of frequent words; other words are folded once in each stretch of texts.
DICT_WORDS, DICT_BYTES = 400_000, 32
#: Bytes of a stretch, if no single text has more, and words that are folded in one row.
GATHER, ROW = 16 << 20, 2048
#: Longer words (bytes) are folded rank by rank: folding merge by merge costs the square of a word's length.
LONG = 256
#: Ids that are completed and decoded at a time, if no single text has more.
IDS = 1 << 18
#: Stands for no rank; ranks, ids and places in short words are below.
NO_RANK = (1 << 20) - 1


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """The pieces and ranks of a rank file: a line each, base64 and number."""
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


def _rank(pairs: Column, left: Column, right: Column) -> Column:
    """The rank (long) of a pair of neighbouring ids; NO_RANK where there is none, null where an id is."""
    found = lambda k: F.coalesce(F.try_element_at(F.get(pairs, (k % PAIR_BUCKETS).cast("int"))["m"], k), F.when(k.isNotNull(), NO_RANK))
    return let(left.cast("long") * F.lit(1 << 20) + right, lambda k: found(k).cast("long"))


def fold(start: Column, pairs: Column) -> Column:
    """The ids of one word: merge the leftmost pair of the lowest rank until no pair has a rank.

    `start`: p, the ids of the word's bytes, and r, the rank of each neighbouring pair (null: none). `pairs`: ranks by pair of
    neighbouring ids; a rank is the id of what the pair makes.
    """
    return F.when(F.size(start["p"]) <= LONG, fold_short(start, pairs)).otherwise(fold_long(start, pairs))


def fold_short(start: Column, pairs: Column) -> Column:
    """fold, merge by merge. A token is one number, of the rank of its pair with the next, its first place and its id: the least
    number is the leftmost pair of the lowest rank. A merge looks up the two pairs that it makes."""
    mask, most = F.lit(NO_RANK), F.lit(1 << 30)
    id_of = lambda x: x.bitwiseAND(mask)

    def token(v: Column, i: Column) -> Column:
        return F.shiftleft(F.coalesce(F.get(start["r"], i), mask).cast("long"), 40) + F.shiftleft(i.cast("long"), 20) + v

    def merge(x: Column, best: Column, j: Column) -> Column:
        k = F.shiftright(best, 40)
        made = F.shiftleft(F.coalesce(_rank(pairs, k, id_of(F.get(x, j + 1))), mask.cast("long")), 40) + best.bitwiseAND(F.lit(NO_RANK << 20)) + k
        # the token before it forms a pair with it
        before = F.transform(F.slice(x, F.lit(1), j - 1), lambda l, i: F.when(i == j - 2, F.shiftleft(_rank(pairs, id_of(l), k), 40) + l.bitwiseAND(F.lit((1 << 40) - 1))).otherwise(l))
        return F.concat(before, F.array(made), F.slice(x, j + 2, most))

    def step(x: Column, _: Column) -> Column:
        return let(F.array_min(x), lambda best: F.when(best >= F.lit(NO_RANK << 40), x).otherwise(let(F.array_position(x, best).cast("int"), lambda j: merge(x, best, j))))

    return F.transform(F.aggregate(start["r"], F.transform(start["p"], token), step), lambda x: id_of(x).cast("int"))


def fold_long(start: Column, pairs: Column) -> Column:
    """fold, rank by rank: a step merges all pairs of the lowest rank, so there are no more steps than ranks that occur.

    Runs of such pairs merge every other one from the left. Where that would make a pair of a lower rank, which had to merge before
    the next one, a step merges the leftmost pair alone.
    """
    none = F.lit(NO_RANK)

    def merged(acc: Column, m: Column) -> Column:
        """acc with the pairs merged whose place in m holds '1'."""
        p, r, k = acc["p"], acc["r"], acc["k"]
        hit = lambda i: F.coalesce(F.get(m, i) == "1", F.lit(False))
        every = F.transform(p, lambda v, i: F.struct(F.when(hit(i), k).otherwise(v).alias("id"), F.get(r, i).alias("r"), hit(i).alias("new"), ((i > 0) & hit(i - 1)).alias("gone"), (hit(i) & hit(i + 2) & (_rank(pairs, k, F.get(p, i + 2)) < k)).alias("early")))

        def close(q: Column) -> Column:
            ranks = F.transform(q, lambda e, j: F.when(j + 1 == F.size(q), none).when(e["new"] | F.get(q, j + 1)["new"], _rank(pairs, e["id"], F.get(q, j + 1)["id"]).cast("int")).otherwise(e["r"]))
            early = F.exists(q, lambda e: e["early"])
            return let(ranks, lambda x: F.struct(F.transform(q, lambda e: e["id"]).alias("p"), x.alias("r"), F.array_min(x).alias("k"), early.alias("early")))

        return let(F.filter(every, lambda e: ~e["gone"]), close)

    def step(acc: Column, _: Column) -> Column:
        k = acc["k"]
        marks = F.transform(acc["r"], lambda v: F.when(v == k, F.lit("1")).otherwise(F.lit("0")))
        alone = lambda j: F.transform(acc["r"], lambda _, i: F.when(i == j, F.lit("1")).otherwise(F.lit("0")))
        lone = let(F.array_position(acc["r"], k).cast("int") - 1, lambda j: let(alone(j), lambda m: merged(acc, m)))
        all_ = let(F.split(F.replace(F.array_join(marks, ""), F.lit("11"), F.lit("10")), ""), lambda m: merged(acc, m))
        return F.when(k >= none, acc).otherwise(let(all_, lambda x: F.when(x["early"] | (x["k"] < k), lone).otherwise(x)))

    ranks = F.transform(start["p"], lambda v, i: F.coalesce(F.get(start["r"], i), none))
    first = let(ranks, lambda r: F.struct(start["p"].alias("p"), r.alias("r"), F.array_min(r).alias("k"), F.lit(False).alias("early")))
    return F.aggregate(start["r"], first, step, lambda acc: acc["p"])


class Starts:
    """Where folding starts, for many words at a time: ids of single bytes and ranks of pairs of bytes."""

    def __init__(self, pairs: list[tuple[bytes, int]]):
        self.one, self.two = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32)
        for piece, i in pairs:
            if len(piece) == 1:
                self.one[piece[0]] = i
            elif len(piece) == 2:
                self.two[piece[0] << 8 | piece[1]] = i

    def of(self, words):
        """A struct array (p, r) of a string array without empty words."""
        import pyarrow as pa

        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inner = np.ones(len(data), bool)
        inner[offsets[1:] - 1] = False
        ranks = np.zeros(len(data), np.int32)
        ranks[:-1] = self.two[data[:-1].astype(np.int32) << 8 | data[1:]]
        ranks = ranks[inner]
        p = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.one[data]))
        r = pa.ListArray.from_arrays(pa.array((offsets - np.arange(len(offsets))).astype(np.int32)), pa.array(ranks, mask=ranks < 0))
        return pa.StructArray.from_arrays([p, r], names=["p", "r"])


START = "struct<p: array<int>, r: array<int>>"


class Lookup:
    """Ids of the known words of texts: pieces of the vocabulary and the dictionary. One of it is kept per worker."""

    kept: dict = {}

    @classmethod
    def get(cls, shared, pairs, pattern):
        if shared.value[0] not in cls.kept:
            cls.kept.clear()
            cls.kept[shared.value[0]] = cls(shared.value[1], pairs.value, pattern)
        return cls.kept[shared.value[0]]

    def __init__(self, table: bytes, pairs, pattern: str):
        import pyarrow as pa
        import pyarrow.compute as pc

        self.split, self.starts = Splitter(pattern), Starts(pairs)
        whole = []
        for piece, i in pairs:
            try:
                whole.append((piece.decode(), i))
            except UnicodeDecodeError:
                continue  # half a character is never a word
        vocabulary = pa.array([w for w, _ in whole], pa.string())
        head = pa.ipc.open_stream(table).read_all().combine_chunks()
        head = head.filter(pc.invert(pc.is_in(head["word"], value_set=vocabulary)))
        ids = head["ids"].combine_chunks() if len(head) else pa.array([], pa.list_(pa.int32()))
        self.words = pa.concat_arrays([vocabulary, *head["word"].cast(pa.string()).chunks])
        self.flat = np.concatenate([np.array([i for _, i in whole], np.int32), ids.flatten().to_numpy(), [-1]]).astype(np.int32)
        self.size = np.concatenate([np.ones(len(whole), np.int64), ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), [1]])
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def of(self, texts):
        """(ids, rare) of a string array: per text the ids, -1 for each unknown word, and all unknown words in order."""
        import pyarrow as pa
        import pyarrow.compute as pc

        words, firsts = self.split(texts)
        found = pc.index_in(words, value_set=self.words).fill_null(len(self.words)).to_numpy()
        size = self.size[found]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = pa.ListArray.from_arrays(pa.array(ends[firsts].astype(np.int32)), pa.array(self.flat[ragged(self.at[found], size)]))
        return ids, words.filter(pa.array(found == len(self.words)))

    def rows(self, texts):
        """(first row or None, ids, rare) in turn: the starts of a stretch's unknown words, each once, in rows without ids; then the
        ids of its texts, with -1 - n for the n-th of those words."""
        import pyarrow as pa

        for k, stretch in slices(texts, GATHER):
            parts = [(k + j, *self.of(part)) for j, part in slices(stretch)]
            d = pa.concat_arrays([rare for *_, rare in parts]).dictionary_encode()
            for j in range(0, len(d.dictionary), ROW):
                starts = self.starts.of(d.dictionary.slice(j, ROW))
                yield None, pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(starts)], pa.int32()), starts)
            code, at = d.indices.to_numpy(), 0
            for row, ids, rare in parts:
                flat = ids.flatten().to_numpy().copy()
                flat[flat < 0] = -1 - code[at : at + len(rare)]
                at += len(rare)
                yield row, pa.ListArray.from_arrays(ids.offsets, pa.array(flat)), pa.nulls(len(ids), pa.list_(self.starts.of(rare.slice(0, 0)).type))


class Folded:
    """The folded words of the stretch at hand, as its rows without ids bring them."""

    def __init__(self):
        self.parts, self.open = [], True
        self.flat, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words) -> None:
        """Words (lists of lists) of the next rows; the first after a text's row begin a new stretch."""
        if not self.open:
            self.parts, self.open = [], True
        self.parts.append(words.flatten())

    def fill(self, ids):
        """The lists `ids` with each -1 - n replaced by the ids of word n."""
        import pyarrow as pa

        if self.open:
            self.open = False
            lists = pa.concat_arrays(self.parts) if self.parts else pa.array([], pa.list_(pa.int32()))
            self.flat = lists.flatten().to_numpy()
            self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            self.at = np.cumsum(self.size) - self.size
        offsets = ids.offsets.to_numpy()
        flat = ids.flatten().to_numpy()
        holes = np.flatnonzero(flat < 0)
        if not len(holes):
            return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(flat))
        word = -1 - flat[holes]
        size, at = np.ones(len(flat), np.int64), np.arange(len(flat))
        size[holes], at[holes] = self.size[word], len(flat) + self.at[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        return pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]].astype(np.int32)), pa.array(np.concatenate([flat, self.flat])[ragged(at, size)]))


class Decoder:
    """The bytes of lists of ids, and the ids as bytes."""

    def __init__(self, pairs):
        import pyarrow as pa

        by = dict((i, p) for p, i in pairs)
        self.top = max(by) + 1
        self.pieces = pa.array([by.get(i, b"") for i in range(self.top + 1)], pa.large_binary())

    def of(self, ids):
        """(decoded, id bytes) as binary arrays."""
        import pyarrow as pa

        flat = ids.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        found = self.pieces.take(pa.array(np.where((flat < 0) | (flat > self.top), self.top, flat)))
        offsets = np.frombuffer(found.buffers()[1], np.int64)[ends] if len(found) else ends
        binary = lambda at, data: pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at), data]).cast(pa.binary())
        return binary(offsets, found.buffers()[2]), binary(ends * 4, pa.py_buffer(flat.astype("<i4")))


class ByteBpe:
    """Encoder and decoder of one rank file. `pattern` splits texts into words, as the tokenizer's own pattern does."""

    def __init__(self, spark: SparkSession, path: str, pattern: str, dict_words: int = DICT_WORDS):
        self.spark, self.pattern, self.dict_words, self.pairs = spark, pattern, dict_words, read_ranks(path)
        import pandas as pd

        by = dict(self.pairs)
        pairs = [((by[p[:k]] << 20) + by[p[k:]], i) for p, i in self.pairs for k in range(1, len(p)) if p[:k] in by and p[k:] in by]
        self.table = spark.createDataFrame(pd.DataFrame(pairs, columns=["pair", "id"]), "pair long, id int").coalesce(1)
        self.shared = spark.sparkContext.broadcast(self.pairs)

    def literal(self) -> Column:
        """The literal ranks by pair of ids: every way to make a piece of two pieces."""
        return _dense_scalar(self.table, "pair", "id", PAIR_BUCKETS).alias("_p")

    def dictionary(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """(word, ids) of the most frequent words of all documents.

        Words are counted over the whole corpus, summed before the shuffle. Counts are cut at an eighth of a power of two so that
        at most `dict_words` words of at most DICT_BYTES bytes are left: the dictionary's size has a bound that no corpus moves.
        """
        pattern, pairs = self.pattern, self.shared

        @tidy

        def count(batches):
            import pyarrow as pa

            split = Splitter(pattern)
            for b in batches:
                chunks = [split(part)[0] for _, part in slices(b.column(0))]
                found = pa.chunked_array(chunks, pa.string()).value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        @tidy

        def start(batches):
            import pyarrow as pa

            starts = Starts(pairs.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), starts.of(b.column(0).cast(pa.string()))], names=["word", "s"])

        parts = docs.select(F.col(text_col).alias("_text")).mapInArrow(count, "word string, n long")
        counts = keep(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.octet_length("word") <= DICT_BYTES), "words")
        grade = F.floor(F.log2("n") * 8).cast("int")
        cut, total = 1 << 30, 0
        for g, n in sorted(((r.g, r.words) for r in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True):
            if (total := total + n) > self.dict_words:
                break
            cut = g
        head = counts.filter(grade >= cut).select("word").mapInArrow(start, f"word string, s {START}")
        return head.select("*", self.literal()).select("word", let(F.col("_p"), lambda p: fold(F.col("s"), p)).alias("ids"))

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
        """id and ids (array of int), one row per input row; with `decoded`, what decode() adds follows.

        A null or empty text has no ids. Repeated rows are encoded one by one; other columns are not read; an empty table gives an
        empty result. There is no shuffle of texts: frequent words are looked up in the dictionary, which is broadcast and has a
        bound; of all others, each stretch of about GATHER bytes of texts folds every distinct one once, in the task that reads them.
        """
        import uuid

        import pyarrow as pa

        table, sink = self.dictionary(docs, text_col).toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        head, pairs, pattern = self.spark.sparkContext.broadcast((uuid.uuid4().hex, sink.getvalue().to_pybytes())), self.shared, self.pattern

        @tidy

        def look_up(batches):
            coder = Lookup.get(head, pairs, pattern)
            for b in batches:
                for k, ids, rare in coder.rows(b.column(1)):
                    own = pa.nulls(1, b.column(0).type) if k is None else b.column(0).slice(k, len(ids))
                    yield pa.RecordBatch.from_arrays([own, ids, rare], names=["_id", "ids", "rare"])

        @tidy

        def fill(batches):
            decoder, folded = Decoder(pairs.value) if decoded else None, Folded()
            for batch in batches:
                text = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(text[1:] != text[:-1]) + 1).tolist(), len(text)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if i < j and not text[i]:
                        folded.add(batch.column(2).slice(i, j - i))
                        continue
                    part = batch.slice(i, j - i)
                    for k, end in stretches(part.column(1).value_lengths().to_numpy(zero_copy_only=False), IDS):
                        b = part.slice(k, end - k)
                        ids = folded.fill(b.column(1))
                        yield pa.RecordBatch.from_arrays([b.column(0), ids, *(decoder.of(ids) if decoded else ())], names=names)

        kind, names = docs.schema[id_col].dataType.simpleString(), ["_id", "ids", "decoded", "id_bytes"][: 4 if decoded else 2]
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(look_up, f"_id {kind}, ids array<int>, rare array<{START}>")
        folded = let(F.col("_p"), lambda p: F.transform("rare", lambda s: fold(s, p)))
        done = rows.select("*", self.literal()).select("_id", "ids", F.when(F.col("rare").isNotNull(), folded).alias("folded"))
        return done.mapInArrow(fill, f"_id {kind}, ids array<int>{', decoded binary, id_bytes binary' * decoded}").withColumnRenamed("_id", id_col)

    def decode(self, df: DataFrame) -> DataFrame:
        """Adds decoded, the bytes (binary) of column ids: their pieces in a row; they need not be UTF-8 if ids were cut. Also adds
        id_bytes, the ids as little-endian unsigned 32-bit integers. Null ids give no bytes, and ids beyond the vocabulary none of theirs.
        """
        pairs, at = self.shared, df.columns.index("ids")

        @tidy

        def run(batches):
            import pyarrow as pa

            decoder = Decoder(pairs.value)
            for batch in batches:
                for k, end in stretches(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), IDS):
                    b = batch.slice(k, end - k)
                    yield pa.RecordBatch.from_arrays([*b.columns, *decoder.of(b.column(at))], names=[*b.schema.names, "decoded", "id_bytes"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("decoded", BinaryType()), StructField("id_bytes", BinaryType())]))


def _dense_scalar(df: DataFrame, key: str, value: str, n: int) -> Column:
    """A (key, value) frame of bounded size as one value: an array of n small maps, by the key's remainder.

    It is a scalar subquery, which is a literal when tasks run. Spark takes no subquery within a higher-order function, so it is
    selected as a column that one let() below refers to; the optimizer puts it there, and no row ever carries it.
    """
    at = F.pmod(F.col(key), F.lit(n)).cast("int")
    maps = df.groupBy(at.alias("b")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    every = df.sparkSession.range(0, n, 1, 1).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    return every.orderBy("b").coalesce(1).agg(F.collect_list(F.struct("m")).alias("a")).scalar()


def digest(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each document's ids and of what they decode to."""
    e = bpe.encode(docs, id_col, text_col, decoded=True)
    return e.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
