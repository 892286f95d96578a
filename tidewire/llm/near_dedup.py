"""Near-duplicates by chosen paths: documents branch by minwise tokens, small nodes are compared whole, independent trees repeat it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import components
from tidewire.llm.hashing import U, labels, mixed, odd_numbers, runs, split_words, window_hashes, word_hashes
from tidewire.llm.shared import keep, tidy
from tidewire.llm.token_files import slices

#: Independent trees, and levels at which an oversize node branches on.
TREES, LEVELS = 10, 4
#: Trees for documents of oversize nodes: as many as part a pair at the limit no more often at the last level than TREES do at the first.
DEEP_TREES = next(t for t in range(TREES, 1000) if (1 - 0.8**LEVELS) ** t <= 0.2**TREES)
#: Minwise values of a sketch. DEEP_TREES * LEVELS of them choose the paths.
SKETCH = 64
#: Documents of a node or unit that are compared with each other, and shingles of a unit.
NODE, UNIT, UNIT_SHINGLES = 2048, 4096, 4_000_000
#: Pairs below this share of equal minwise values are not confirmed: six deviations below 0.8.
LEAST = 0.5


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; of fewer than k words, one of the whole sequence; of none, none."""
    bounds, words = split_words(texts, lower=True)
    h = word_hashes(words)
    g, out = window_hashes(h, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - k + 1]) if b - a >= k else window_hashes(h[a:b], b - a, seed=b - a) if b > a else np.zeros(0, U))
    return out


def minwise(sets: list[np.ndarray], n: int = SKETCH) -> np.ndarray:
    """n minwise values of each set that isn't empty, as rows."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    flips, factors = mixed(np.arange(n, dtype=U) + U(77)), odd_numbers(n, 5)
    return np.stack([np.minimum.reduceat((flat ^ f) * m, starts) for f, m in zip(flips, factors, strict=True)], axis=1)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, sk (low bytes of the minwise values) and mins (those that choose paths)."""

    @tidy

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), k)
                some = [i for i, s in enumerate(sets) if len(s)]
                sk, mins = [None] * len(sets), [None] * len(sets)
                if some:
                    m = mixed(minwise([sets[i] for i in some], max(SKETCH, DEEP_TREES * LEVELS)))
                    low, path = m[:, :SKETCH].astype(np.uint8), m[:, : DEEP_TREES * LEVELS].astype(np.uint32).view(np.int32)
                    for j, i in enumerate(some):
                        sk[i], mins[i] = low[j].tobytes(), path[j]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(sk, pa.binary()), pa.array(mins, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "digest", "sk", "mins"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sk binary, mins array<int>")


def small_nodes(reps: DataFrame) -> DataFrame:
    """Rows (node, rep, n, sk): every tree's nodes of at most NODE documents, split on level by level; what is larger at the last
    level is cut into blocks that all meet each other, so no pair of a node is left out.

    A pair that meets in an oversize node may part below it, so the documents of such nodes go to all DEEP_TREES trees.
    """
    done, large = _split(reps, 0, TREES)
    if large is not None:
        done += _split(reps.join(large, "rep", "left_semi"), TREES, DEEP_TREES)[0]
    return _union(done)


def _split(reps: DataFrame, first: int, end: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The nodes of the trees from first to end, and the documents of oversize nodes of the first level, if any."""
    tree = F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("tree")
    active = reps.select("rep", "n", "sk", "mins", tree).select("rep", "n", "sk", F.slice("mins", F.col("tree") * LEVELS + 1, F.lit(LEVELS)).alias("path"), F.xxhash64("tree").alias("node"))
    active = keep(active, "paths")  # each level reads these rows twice
    done, large = [], None
    for level in range(LEVELS):
        active = active.withColumn("node", F.xxhash64("node", F.lit(level), F.get("path", F.lit(level))))
        big = keep(active.groupBy("node").count().filter(F.col("count") > NODE), "nodes")
        many = big.count()
        if not many:
            done.append(active.select("node", "rep", "n", "sk"))
            return done, large
        hint = F.broadcast(big) if many <= 50_000 else big
        done.append(active.join(hint, "node", "left_anti").select("node", "rep", "n", "sk"))
        active = active.join(hint.select("node"), "node", "left_semi")
        if level == 0:
            large = keep(active.select("rep").distinct(), "large")
        if level == LEVELS - 1:
            cut = active.join(hint, "node").withColumn("blocks", F.ceil(F.col("count") * 2 / NODE).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            done.append(cut.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "n", "sk"))
    return done, large


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _sorted_by(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(F.col(key)).sortWithinPartitions(key)


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, rep, root): documents of a node that may be linked, by equal minwise values and by size; a star for each cluster."""

    @tidy

    def run(batches):
        out = ([], [], [])
        for t in runs(batches, "node"):
            m = t.num_rows
            if m < 2:
                continue
            rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            sk = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint8).reshape(m, SKETCH)
            a, b = [], []
            for i in range(0, m, 256):
                same = np.zeros((min(256, m - i), m), np.uint8)
                for j in range(SKETCH):
                    same += sk[i : i + 256, j, None] == sk[None, :, j]
                x, y = np.nonzero(same >= LEAST * SKETCH)
                x = x + i
                ok = (x < y) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                a.append(x[ok])
                b.append(y[ok])
            a, b = np.concatenate(a), np.concatenate(b)
            if not len(a):
                continue
            order = np.argsort(rep, kind="stable")
            place = np.argsort(order, kind="stable")
            root = order[labels(m, place[a], place[b])[place]]
            some = np.unique(np.concatenate([a, b]))
            node = t.column("node")[0].as_py()
            out[0].extend([node] * len(some))
            out[1].extend(rep[some].tolist())
            out[2].extend(rep[root[some]].tolist())
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "rep", "root"])
                out = ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "rep", "root"])

    return _sorted_by(nodes, "node").mapInArrow(run, "node long, rep long, root long")


def confirmed(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with percent of their union in common, from exact intersection sizes."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return (np.array([0]), np.array([1])) if 100 * both >= percent * (size.sum() - both) else (np.zeros(0, int), np.zeros(0, int))
    flat, doc = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    del order, flat
    token = np.cumsum(first, dtype=np.int32) - 1
    often = np.bincount(token)[token] > 1  # a token of one set adds to no intersection
    doc, token = doc[often], token[often]
    common = np.zeros((m, m), np.float32)
    if len(token):
        token = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]), dtype=np.int32)
        width = max(64, min(4096, (1 << 22) // m))
        for lo in range(0, int(token[-1]) + 1, width):
            a, b = np.searchsorted(token, [lo, lo + width])
            part = np.zeros((m, width), np.float32)
            part[doc[a:b], token[a:b] - lo] = 1
            for i in range(0, m, 256):  # in rows, so that no second table of all pairs is made
                common[i : i + 256] += part[i : i + 256] @ part.T
    found = ([], [])
    for i in range(0, m, 256):
        both = common[i : i + 256].astype(np.float64)
        x, y = np.nonzero(100.0 * both >= percent * (size[i : i + 256, None] + size[None, :] - both))
        x = x + i
        found[0].append(x[x < y])
        found[1].append(y[x < y])
    return np.concatenate(found[0]), np.concatenate(found[1])


def links(units: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that span each unit's linked documents, confirmed on full sets. units: unit, rep, text."""

    @tidy

    def run(batches):
        def hashed():
            for batch in batches:
                for part in slices(batch):
                    yield pa.RecordBatch.from_arrays([part.column("unit"), part.column("rep"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), k)], pa.large_binary())], names=["unit", "rep", "set"])

        a, b = [], []
        for t in runs(hashed(), "unit"):
            if t.num_rows < 2:
                continue
            rep = t.column("rep").to_numpy()
            x, y = confirmed([np.frombuffer(s, U) for s in t.column("set").to_pylist()], percent)
            root = labels(t.num_rows, x, y)
            far = np.flatnonzero(root != np.arange(t.num_rows))
            a.extend(rep[far].tolist())
            b.extend(rep[root[far]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _sorted_by(units, "unit").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept (doc_id = component_id), a row per input row.

    Texts whose sets of k-word shingles share at least `percent` of their union are linked. Null, empty and wordless texts have no
    set and no links; fewer than k words are one shingle. A null doc_id is linked with nothing: its component_id is null and it is
    kept. Rows that repeat a doc_id are one document to the links. An empty table gives an empty result; other columns are not read.

    Equal sets are one document from the start. In each of TREES trees a document goes to the node of its minwise token, and on to
    the next level where a node is larger than NODE; two documents at the limit part in all trees with a chance of 0.2 ** TREES. The
    documents of oversize nodes go to DEEP_TREES trees, which keep the chance to part below such nodes no higher. Clusters of pairs that agree in half of the sketch are joined over all trees and each
    document's text goes once to its cluster, where all pairs are confirmed on full sets; only clusters beyond UNIT are confirmed
    node by node instead.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = keep(sketches(rows, k), "sketches")
    named = d.filter("doc_id IS NOT NULL AND n_shingles > 0")
    reps = keep(named.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sk").alias("sk"), F.first("mins").alias("mins")).withColumnRenamed("n_shingles", "n"), "sets")
    found = keep(candidates(small_nodes(reps), percent), "candidates")
    cluster = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "clusters")
    member = found.select("rep").distinct().join(cluster, F.col("rep") == F.col("v"), "left").select("rep", F.coalesce("root", "rep").alias("unit"))
    sized = member.join(reps.groupBy("rep").agg(F.max("n").alias("n")), "rep")
    large = keep(sized.groupBy("unit").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).filter((F.col("m") > UNIT) | (F.col("s") > UNIT_SHINGLES)), "large")
    few = member.join(large, "unit", "left_anti")
    rest = found.join(member.join(large, "unit", "left_semi").select("rep"), "rep", "left_semi").select("rep", F.xxhash64("node", "root").alias("unit")).distinct()
    units = few.unionByName(rest)
    texts = rows.join(units, F.col("doc_id") == F.col("rep")).select("unit", "rep", "text")
    root = components(links(texts, k, percent), "links")
    ids = reps.select("digest", "rep").join(root, F.col("rep") == F.col("v"), "left").select("digest", F.coalesce("root", "rep").alias("component_id"))
    some = d.select("doc_id", "n_shingles", "digest").filter("doc_id IS NOT NULL AND n_shingles > 0").join(ids, "digest").select("doc_id", "n_shingles", "component_id")
    lone = d.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(lone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def oracle(k: int = 4, percent: int = 80) -> str:
    """The registered query in DuckDB: all pairs that share a shingle, with exact sizes."""
    gram = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, {gram} AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k}) UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, d.doc_id = coalesce(c.root, d.doc_id) AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id"""
