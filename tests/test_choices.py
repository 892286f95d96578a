"""Selections, geometry, poll values and centrality against plain Python on small frames."""

import itertools
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.functions import geometry
from tidewire.operators import centrality, selection


def test_quota_equals_the_walk(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.choice(["x", "y", None])) for i in range(200)]
    used, want = {}, []
    for i, a, b in rows:
        groups = [(("a", a), 7), (("b", b), 11)] if b else [(("a", a), 7)]
        if any(used.get(g, 0) < q for g, q in groups):
            want.append(i)
            for g, _ in groups:
                used[g] = used.get(g, 0) + 1
    got = selection.quota(spark.createDataFrame(rows, "i int, a string, b string"), {"a": 7, "b": 11}, [F.col("i")])
    assert sorted(r.i for r in got.collect()) == want


def test_diverse_equals_the_walk(spark):
    rng = random.Random(6)
    rows = [(i, "g", [f"w{rng.randrange(14)}" for _ in range(5)]) for i in range(60)] + [(99, "h", [])]
    want = []
    for i, g, w in rows[:60]:
        if len(want) < 8 and not any(len(set(w) & set(v)) >= 3 and len(set(w) & set(v)) >= 0.5 * min(len(set(w)), len(set(v))) for _, v in want):
            want.append((i, w))
    got = selection.diverse(spark.createDataFrame(rows, "i int, g string, w array<string>"), "g", [F.col("i")], "i", "w", 8).orderBy("g", "rank").collect()
    assert [r.i for r in got if r.g == "g"] == [i for i, _ in want]
    assert [(r.rank, r.i) for r in got if r.g == "h"] == [(1, 99)]


def test_diverse_looks_past_copies(spark):
    """More copies than a round looks at stand before unlike rows; rows of few words, a repeated row, a null and a short group."""
    many = [(i, "g", ["a", "b", "c", f"x{i % 3}"]) for i in range(230)] + [(230, "g", ["a"]), (231, "g", ["a"]), (231, "g", ["a"])]
    many += [(240 + i, "g", [f"{k}{i // 220}" for k in "pqr"]) for i in range(500)] + [(800, "g", None)]
    rows = many + [(900, None, ["a", "b", "c"]), (901, None, ["a", "b", "c"]), (902, None, ["d", "e", "f"]), (-1, "g", [])]
    want = Counter()
    for g in ("g", None):
        kept = []
        for i, _, w in sorted((r for r in rows if r[1] == g), key=lambda r: r[0]):
            if len(kept) < 9 and not any(len(set(w or ()) & set(v or ())) >= 3 and 2 * len(set(w or ()) & set(v or ())) >= min(len(set(w)), len(set(v))) for _, v in kept):
                kept.append((i, w))
        want.update((g, k + 1, i) for k, (i, _) in enumerate(kept))
    got = selection.diverse(spark.createDataFrame(rows, "i int, g string, w array<string>"), "g", [F.col("i")], "i", "w", 9)
    assert Counter(map(tuple, got.collect())) == want


def test_pack(spark):
    rows = [("d", 1, 200), ("d", 2, 100), ("d", 3, 1), ("d", 4, 900), ("d", 5, 1), ("d", 6, 1), ("d", 7, 1)]
    got = selection.pack(spark.createDataFrame(rows, "day string, i int, size int"), "day", ["i"], "size", 300, 2).orderBy("i").collect()
    assert [r.message for r in got] == [0, 0, 1, 2, 3, 3, 4]


def test_pack_in_stretches_equals_the_walk(spark, monkeypatch):
    """Groups that spread over many stretches, a null group, ties, null, negative and huge sizes, a repeated row, and no rows."""
    monkeypatch.setattr(selection, "STRETCH", 7)
    rng = random.Random(11)
    sizes = [1, 1, 40, 90, 149, 150, 151, 301, 0, -3, None, 2**63 - 1]
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(900), rng.choice(sizes)) for _ in range(1500)] + [("c", 1, 5), ("c", 1, 5), ("d", None, 400)]
    want = Counter()
    for g in {r[0] for r in rows}:
        m, used, n = 0, 0, 0
        for _, i, z in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
            if n and (n >= 6 or (None not in (used, z) and used + z > 300)):
                m, used, n = m + 1, 0, 0
            used, n = None if None in (used, z) else used + z, n + 1
            want[g, i, m] += 1
    df = spark.createDataFrame(rows, "day string, i int, size long").repartition(5)
    assert Counter(map(tuple, selection.pack(df, "day", ["i"], "size", 300, 6).collect())) == want
    assert selection.pack(df.filter("i < 0"), "day", ["i"], "size", 300, 6).count() == 0


def test_pack_of_one_large_group(spark):
    """One day of 200,000 rows: an array that is copied for each row would take 80 GB."""
    df = spark.range(200_000).selectExpr("'d' AS day", "id", "id * 7 % 100 AS size")
    m, used, n = 0, 0, 0
    for i in range(200_000):
        if n and (n >= 6 or used + i * 7 % 100 > 300):
            m, used, n = m + 1, 0, 0
        used, n = used + i * 7 % 100, n + 1
    began = time.time()
    got = selection.pack(df, "day", ["id"], "size", 300, 6).agg(F.count("*").alias("n"), F.max("message").alias("m")).first()
    assert (got.n, got.m) == (200_000, m)
    assert time.time() - began < 60


def test_geometry(spark):
    square = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0))]
    df = spark.createDataFrame([(square, 1.0, 1.5), (square, 5.0, 1.0)], f"ring {geometry.RING}, x double, y double")
    ring, x, y = F.col("ring"), F.col("x"), F.col("y")
    got = df.select(geometry.signed_area(ring).alias("a"), geometry.centroid(ring).alias("c"), geometry.contains(ring, x, y).alias("i"), geometry.border_distance(ring, x, y).alias("d"), geometry.box(ring).alias("b")).collect()
    assert [(r.a, tuple(r.c), r.i, r.d, tuple(r.b)) for r in got] == [(8.0, (2.0, 1.0), True, 0.5, (0.0, 0.0, 4.0, 2.0)), (8.0, (2.0, 1.0), False, 1.0, (0.0, 0.0, 4.0, 2.0))]


def test_simplified(spark):
    line = [{"x": float(i), "y": y} for i, y in enumerate((0.0, 0.1, 0.0, 5.0, 0.0))]
    rows = spark.createDataFrame([(line,), (line[:1],), ([],), (None,)], f"line {geometry.RING}")
    got = [[p.x for p in r.k] for r in rows.select(geometry.simplified(F.col("line"), 0.5).alias("k")).collect()]
    assert got == [[0.0, 2.0, 3.0, 4.0], [0.0], [], []]


def test_betweenness_equals_all_paths():
    rng = random.Random(7)
    edges = {v: set() for v in "abcdefg"}
    for a, b in itertools.combinations(edges, 2):
        if rng.random() < 0.4:
            edges[a].add(b)
            edges[b].add(a)

    def shortest(s, t):
        level = [[s]]
        while level and not any(p[-1] == t for p in level):
            level = [[*p, w] for p in level for w in edges[p[-1]] if w not in p]
        return [p for p in level if p[-1] == t]

    want = dict.fromkeys(edges, 0.0)
    for s, t in itertools.permutations(edges, 2):
        found = shortest(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found) / 30
    assert centrality.betweenness(edges) == pytest.approx(want)


def test_longest_entities_link_every_name(spark, tmp_path):
    """More than 200 names, names of one word, overlaps, a repeated doc_id, null and empty texts, against the walk."""
    from tidewire.plans import extraction

    items = [f"Ka{i:03} lo{i % 7} more words" for i in range(300)] + ["lo1 ka299 x", "solo", "", None]
    rng = random.Random(8)
    texts = ["", None, "ka299 lo5", "x ka000 lo0 lo1 ka299 lo5 solo"] + [" ".join(rng.choice([f"ka{rng.randrange(300):03} lo{rng.randrange(7)}", "lo1", "solo", "x"]) for _ in range(60)) for _ in range(20)]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known, want = {" ".join(x.lower().split()[:2]) for x in items if x}, []
    for d, t in rows:
        w, i = (t or "").split(), 0
        while i < len(w):
            name = next((n for k in (2, 1) if (n := " ".join(w[i : i + k])) in known), None)
            want += [(d, name)] if name else []
            i += name.count(" ") + 1 if name else 1
    assert (1, "ka299 lo5") in want
    assert sorted(map(tuple, extraction.longest_entities(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("items", [["solo", "two words", "three of them", "four of them here", "", None, "Solo!"], ["three of them"], []])
def test_dict_join_finds_phrases_of_any_length(spark, tmp_path, items):
    from tidewire.plans import joins

    texts = ["solo", "a solo; two\nwords", "x" * 500 + " Three of them HERE four of them here", "", None, "two", "of them here", "two words two words"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import re

    norm = lambda t: f" {' '.join(re.findall('[a-z0-9]+', (t or '').lower()))} "
    want = [(i, d) for i, p in enumerate(items) if norm(p).strip() for d, t in enumerate(texts) if t is not None and norm(p) in norm(t)]
    assert sorted(map(tuple, joins.dict_join(spark, str(tmp_path)).collect())) == want
