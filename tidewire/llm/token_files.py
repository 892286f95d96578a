"""Token-id files: blocks of ids transposed into byte or bit planes, each plane compressed with zstandard, and a chunk index.

Layout of a shard, all numbers little-endian:
  b"TWPLANE1", then per chunk its planes in turn, then the footer (zstandard of JSON), its length (u64) and b"TWPLANE1".
The footer holds block, planes ("byte" or "bit"), ids (the shard's ids), chunks: [[offset, ids, [plane lengths]], ...] and docs:
the offset and length of the document index, which is doc ids (i64), null flags (u8) and token counts (u32), each compressed.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shared import keep, scratch, tidy
from tidewire.llm.word_spans import ragged

MAGIC = b"TWPLANE1"
BLOCK = 1 << 16
#: Texts are encoded in slices of about so many bytes, and shards hold about so many bytes of text.
SLICE, SHARD = 12 << 20, 32 << 20
#: Pieces and words whose ids a worker remembers, about.
MEMORY = 1 << 19


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids; plane k holds byte (bit) k of every id."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1).copy().view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").copy().view("<u4").ravel()


class ShardWriter:
    """Writes one shard to an open file; memory holds one block of ids and the documents' ids and counts."""

    def __init__(self, out, block: int = BLOCK, kind: str = "byte", level: int = 3):
        self.out, self.block, self.kind, self.zip = out, block, kind, zstandard.ZstdCompressor(level=level)
        self.at, self.chunks, self.parts, self.waiting, self.total = len(MAGIC), [], [], 0, 0
        self.ids, self.nulls, self.counts = [], [], []
        out.write(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, ids: np.ndarray) -> None:
        start, lengths = self.at, []
        for plane in to_planes(ids, self.kind):
            packed = self.zip.compress(plane)
            lengths.append(len(packed))
            self._put(packed)
        self.chunks.append([start, len(ids), lengths])

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order, the number of ids of each, and all their ids."""
        self.ids.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.nulls.append(np.array([d is None for d in doc_ids], np.uint8))
        self.counts.append(counts.astype("<u4"))
        self.total += len(ids)
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            every = np.concatenate(self.parts)
            for k in range(0, len(every) - self.block + 1, self.block):
                self._chunk(every[k : k + self.block])
            rest = every[len(every) // self.block * self.block :]
            self.parts, self.waiting = [rest], len(rest)

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.concatenate(self.parts))
        docs = [self.at]
        for part, kind in ((self.ids, "<i8"), (self.nulls, "u1"), (self.counts, "<u4")):
            packed = self.zip.compress(np.concatenate(part or [np.zeros(0, kind)]).astype(kind).tobytes())
            docs.append(len(packed))
            self._put(packed)
        footer = self.zip.compress(json.dumps({"block": self.block, "planes": self.kind, "ids": self.total, "n_docs": sum(map(len, self.counts)), "chunks": self.chunks, "docs": docs}).encode())
        self._put(footer + struct.pack("<Q", len(footer)) + MAGIC)


class ShardReader:
    """Reads a shard: documents() streams (doc_id, ids) in order; ids(first, last) reads only the chunks that it needs."""

    def __init__(self, file):
        self.file, self.zip = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        n = struct.unpack("<Q", tail[:8])[0]
        self.footer = json.loads(self.zip.decompress(self._at(size - 16 - n, n)))

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, lengths = self.footer["chunks"][k]
        data, planes = self._at(at, sum(lengths)), []
        for m in lengths:
            planes.append(self.zip.decompress(data[:m]))
            data = data[m:]
        return from_planes(planes, n, self.footer["planes"])

    def ids(self, first: int, last: int) -> np.ndarray:
        block = self.footer["block"]
        if first >= last:
            return np.zeros(0, "<u4")
        found = np.concatenate([self.chunk(k) for k in range(first // block, (last - 1) // block + 1)])
        return found[first % block : first % block + last - first]

    def index(self) -> tuple[list, np.ndarray]:
        at, *lengths = self.footer["docs"]
        parts = []
        for n, kind in zip(lengths, ("<i8", "u1", "<u4"), strict=True):
            parts.append(np.frombuffer(self.zip.decompress(self._at(at, n)), kind))
            at += n
        return [None if z else int(d) for d, z in zip(parts[0], parts[1], strict=True)], parts[2]

    def documents(self):
        doc_ids, counts = self.index()
        left, k = np.zeros(0, "<u4"), 0
        for d, n in zip(doc_ids, counts.tolist(), strict=True):
            if len(left) < n:
                parts, have = [left], len(left)
                while have < n:
                    parts.append(self.chunk(k))
                    have, k = have + len(parts[-1]), k + 1
                left = np.concatenate(parts)
            yield d, left[:n]
            left = left[n:]


#: The split of words into pieces that simple_pieces finds, the longest contraction first. Fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def piece_coder(spec: str) -> tuple[str, bool, bytes, str] | None:
    """For a file whose SIMPLE words have the ids of their PIECES in a row: the same model for words that are lowered and split
    already (JSON), whether words are lowered, which ids end a piece, and a pattern of the file's own tokens, which are found before
    anything is split. None for any other file."""
    parts = json.loads(spec)
    normal, split, suffix = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}, parts["model"].get("end_of_word_suffix")
    steps = normal.get("normalizers", [normal] if normal else [])
    first, *rest = split.get("pretokenizers") or [{}]
    known = first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECES} and first.get("behavior") == "Removed" and first.get("invert") is True
    known = known and [x["type"] for x in rest] == ["ByteLevel"] and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
    known = known and all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} for x in steps)
    if not known or not suffix:
        return None
    ends = np.zeros(1 + max(parts["model"]["vocab"].values()), bool)
    ends[[i for w, i in parts["model"]["vocab"].items() if w.endswith(suffix)]] = True
    bare = {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, rest[0]]}}
    special = "|".join(re.escape(t["content"]) for t in parts.get("added_tokens") or ()) or r"[^\s\S]"
    return json.dumps(parts | bare), any(x["type"] == "Lowercase" for x in steps), ends.tobytes(), special


#: Printable ASCII, and the Latin letters that are composed already and have one small letter each.
SIMPLE = r"\x21-\x7E\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}"
#: 0 for bytes of letters, 1 for digits, 2 for other marks.
CLASSES = np.array([0 if c > 127 or chr(c).isalpha() else 1 if chr(c).isdigit() else 2 for c in range(256)], np.uint8)


def simple_pieces(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The PIECES of words of SIMPLE characters, none empty, in a row; where each word's begin, and the end."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets, n = offsets - offsets[0], len(data)
    c = CLASSES[data]
    new = np.zeros(n + 3, bool)  # a word starts, or none follows
    new[offsets[:-1]] = True
    new[n:] = True
    start = new.copy()
    start[1:n] |= (c[1:] != c[:-1]) | (c[1:] == 1)
    k = np.flatnonzero((data == 0x27) & start[:n])
    k = k[~new[k + 1]]
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    one, two = pad[k + 1], np.where(new[k + 2], 0, pad[k + 2])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    wide = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (two == ord("l")) & (one == ord("l"))
    start[k[short | wide] + 1] = False
    start[k[short] + 2] = True
    start[k[wide] + 3] = True
    at = np.flatnonzero(start[:n])
    pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(at, n).astype(np.int32)), pa.py_buffer(data)])
    return pieces, np.searchsorted(at, offsets)


class WordEncoder:
    """Ids of texts by a tokenizers file. White space splits words there, so each distinct word is encoded once and remembered.

    Where the file splits words on into runs of letters, digits and runs of other marks, as PIECES does, words of SIMPLE characters
    are put together of their pieces, which are fewer and are encoded many at a time. So are all other words, with a mark between
    them: a private-use character, whose ids are its bytes alone. Words that hold the mark are encoded by themselves.
    """

    MARK = "\ue000"

    def __init__(self, spec: str, end: int, bare: tuple[str, bool, bytes, str] | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder, self.end = Tokenizer.from_str(spec), end
        self.mark = np.array(self.coder.encode(self.MARK, add_special_tokens=False).ids, "<u4")
        self.by_piece = bare is not None
        if self.by_piece:
            pieces, self.lower, ends, self.special = bare
            self.bare, self.ends = Tokenizer.from_str(pieces), np.frombuffer(ends, bool)
        self._forget()

    def _forget(self) -> None:
        """The end id is the first of the pool."""
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.pool, self.size = np.array([self.end], "<u4"), np.ones(1, np.int64)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and the number of each word's."""
        own: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if self.MARK not in w]
        odd = [i for i, w in enumerate(words) if self.MARK in w]
        groups = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
        for group, e in zip(groups, self.coder.encode_batch_fast([f" {self.MARK} ".join([*(words[i] for i in g), ""]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            n, m = len(ids), len(self.mark)
            found = np.ones(n - m + 1, bool)
            for k in range(m):
                found &= ids[k : n - m + 1 + k] == self.mark[k]
            ends = np.flatnonzero(found)
            if len(ends) != len(group):
                odd += group
                continue
            for i, a, b in zip(group, [0, *(ends[:-1] + m).tolist()], ends.tolist(), strict=True):
                own[i] = ids[a:b]
        for i, e in zip(odd, self.coder.encode_batch_fast([words[i] for i in odd], add_special_tokens=False), strict=True):
            own[i] = np.array(e.ids, "<u4")
        return np.concatenate([*own, np.zeros(0, "<u4")]), np.array([len(x) for x in own], np.int64)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_encoded, for words that are one piece each."""
        found = [np.array(e.ids, "<u4") for e in self.bare.encode_batch_fast([" ".join(pieces[k : k + 1000]) for k in range(0, len(pieces), 1000)], add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, "<u4")])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(pieces):
            raise ValueError("a piece does not end where the model's words do")
        return ids, np.diff(ends, prepend=-1)

    def _add(self, names: dict[str, int], words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        names.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.pool, self.size = np.concatenate([self.pool, ids]), np.concatenate([self.size, size])

    def _at(self, names: dict[str, int], words: list[str], encode) -> np.ndarray:
        """Where the words are in the pool; those not known yet are encoded."""
        if new := [w for w in words if w not in names]:
            self._add(names, new, *encode(new))
        return np.fromiter(map(names.__getitem__, words), np.int64, len(words))

    def _lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pool, begin and size: the ids of each of these distinct words are pool[begin : begin + size]."""
        whole = np.ones(len(words), bool)
        if self.by_piece and len(words):
            # an empty text is one empty word
            whole = pc.or_(pc.match_substring_regex(words, f"^$|[^{SIMPLE}]"), pc.match_substring_regex(words, self.special)).to_numpy(zero_copy_only=False)
        rest, plain = words.filter(pa.array(whole)).to_pylist(), words.filter(pa.array(~whole))
        at, local = self._at(self.known, rest, self._encoded), np.zeros(0, "<u4")
        size, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(plain):
            pieces, firsts = simple_pieces(pc.utf8_lower(plain) if self.lower else plain)
            d = pieces.dictionary_encode()
            piece = self._at(self.pieces, d.dictionary.to_pylist(), self._of_pieces)[d.indices.to_numpy()]
            length = self.size[piece]
            size[~whole] = np.add.reduceat(length, firsts[:-1])
            local = self.pool[ragged((np.cumsum(self.size) - self.size)[piece], length)]
            begin[~whole] = len(self.pool) + np.cumsum(size[~whole]) - size[~whole]
        size[whole], begin[whole] = self.size[at], (np.cumsum(self.size) - self.size)[at]
        return np.concatenate([self.pool, local]), begin, size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts per text, end id included, and all ids."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        del lists
        if len(self.size) > MEMORY:
            self._forget()
        pool, begin, size = self._lookup(words.dictionary.cast(pa.string()))
        begin, size = np.append(begin, 0), np.append(size, 1)
        # each text's words, then the end mark
        order = np.insert(words.indices.to_numpy(), bounds[1:] - bounds[0], len(size) - 1)
        length = size[order]
        upto = np.cumsum(length)
        ends = np.cumsum(np.diff(bounds) + 1)
        return np.diff(np.concatenate([[0], upto[ends - 1]])), pool[ragged(begin[order], length)]


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE):
    """Parts of a batch of about `size` bytes of text, so that memory doesn't hang on the batch's number of rows."""
    n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts, k = np.cumsum(n) // size, 0
    while k < len(n):
        upto = int(np.searchsorted(parts, parts[k], "right"))
        yield batch.slice(k, upto - k)
        k = upto


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, spec: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = 1, kind: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encodes every text into shards in ascending id order; returns the manifest: shard, path, docs, ids and base (ids before it).

    `spec` is the JSON of a tokenizer that drops white space and joins nothing across it. The null id comes first; rows of equal id
    are ordered by their text. A null or empty text is the end id alone. Each task attempt writes a file of its own name and only
    the attempt that ends well is in the manifest, so a lost executor leaves at most an unused file.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    rows, bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), piece_coder(spec)
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // SHARD))
    mix = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), mix).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), mix, "text")

    @tidy

    def run(batches):
        import uuid

        shard = TaskContext.get().partitionId()
        files, top = _filesystem(folder)
        files.create_dir(top, recursive=True)
        path = f"{top}/shard-{shard:06d}-{uuid.uuid4().hex}"
        coder = WordEncoder(spec, end, bare)
        with files.open_output_stream(path) as out:
            w = ShardWriter(out, block, kind)
            for batch in batches:
                for part in slices(batch):
                    counts, ids = coder(part.column("text"))
                    w.add(part.column("doc_id").to_pylist(), counts, ids)
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [path.rpartition("/")[2]], "docs": [sum(map(len, w.counts))], "ids": [w.total]}, pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    shards = keep(ordered.mapInArrow(run, "shard int, name string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).withColumn("path", F.concat(F.lit(folder + "/"), "name")).drop("name")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, computed from the files alone."""

    @tidy

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                files, name = _filesystem(path)
                out, start = ([], [], [], []), base
                with files.open_input_file(name) as f:
                    for d, ids in ShardReader(f).documents():
                        for column, v in zip(out, (d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(v)
                        start += len(ids)
                for k in range(0, len(out[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 10_000], pa.int64()) for c in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.select("shard", "path", "base").repartitionById(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
