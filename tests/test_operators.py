"""Operators on small frames written by hand, and properties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import dates, text
from tidewire.operators import figures, graphs, windows
from tidewire.plans import networks, registry


def test_fold_and_keys(spark):
    df = spark.createDataFrame([("Él Niño - Diario",), ("el nino",), (None,)], "t string")
    assert [r[0] for r in df.select(text.title_key(F.col("t"))).collect()] == ["el nino", "el nino", None]


def test_boolean_query(spark):
    df = spark.createDataFrame([(1, "the tion map"), (2, "of the ment"), (3, "then tion")], "i int, t string")
    assert [r.i for r in df.filter(text.boolean_query(F.col("t"), 'the tion|ment -"of the"')).collect()] == [1]


def test_dates(spark):
    df = spark.createDataFrame([("Tue, 02 Jan 2024 03:04:05 GMT",), ("2024-01-02T03:04:05",), ("nonsense",)], "t string")
    got = [str(r[0]) for r in df.select(dates.published(F.col("t"))).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "None"]
    urls = spark.createDataFrame([("http://a/2024/02/30/x",), ("http://a/2024/02/3/x",), ("http://a/20240204.html",)], "u string")
    assert [str(r[0]) for r in urls.select(dates.url_date(F.col("u"))).collect()] == ["None", "2024-02-03", "2024-02-04"]
    mixed = spark.createDataFrame([("2024",), ("2024-05",), ("2024-05-06",), ("x",)], "t string")
    assert [str(r[0]) for r in mixed.select(dates.mid_period(F.col("t"))).collect()] == ["2024-07-01", "2024-05-15", "2024-05-06", "None"]


def test_streaks(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True)], "k string, t int, bad boolean")
    got = windows.streaks(df, ["k"], ["t"], F.col("bad")).orderBy("since").collect()
    assert [(r.since, r.length) for r in got] == [(1, 2), (4, 1)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=12), st.integers(1, 200))
def test_seats_add_up(spark, weights, seats):
    df = spark.createDataFrame(list(enumerate(weights)), "k int, w long")
    got = figures.largest_remainder(df, "w", seats, "k").collect()
    assert sum(r.seats for r in got) == seats
    assert all(abs(r.seats - r.w * seats / sum(weights)) < 1 for r in got)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=25))
def test_components_equal_union_find(spark, edges):
    up = {v: v for e in edges for v in e}

    def root(v):
        return v if up[v] == v else root(up[v])

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.root for r in got} == {v: root(v) for v in up}


def test_paths(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 4), (1, 3, 1)], "a long, b long, w long")
    got = {tuple(r.path): (r.steps, r.weakest) for r in graphs.paths(e, 1, 3).collect()}
    assert got == {(1, 3): (1, 1), (1, 2, 3): (2, 4)}


def test_label_propagation_reads_all_suppliers(spark, tmp_path):
    from tidewire.plans import networks

    rows = [(o, s) for o, pair in enumerate([(1, 2), (1, 2), (70, 90), (70, 90), (59, 61), (59, 61)]) for s in pair]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.v for r in networks.label_propagation(spark, str(tmp_path)).collect()} == {1, 2, 70, 90, 59, 61}


def test_label_propagation_equals_the_walk(spark):
    """All vertices at once, by weight, ties to the least label."""
    import random

    r = random.Random(3)
    edges = [(a, b, r.randrange(1, 6)) for a in range(14) for b in range(a + 1, 14) if r.random() < 0.25]
    near: dict = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {v: v for v in near}
    for _ in range(5):
        new = {}
        for v, around in near.items():
            votes: dict = {}
            for b, w in around:
                votes[label[b]] = votes.get(label[b], 0) + w
            new[v] = min(votes, key=lambda x: (-votes[x], x))
        label = new
    got = graphs.propagate(spark.createDataFrame(edges, "a long, b long, w long"), 5).collect()
    assert {x.v: x.label for x in got} == label


def test_components_of_large_ids(spark):
    e = spark.createDataFrame([(2**62, 2**62 + 1), (2**62 + 1, 2**62 + 5), (-(2**62), 7)], "a long, b long")
    assert {r.v: r.root for r in graphs.components(e).collect()} == {2**62: 2**62, 2**62 + 1: 2**62, 2**62 + 5: 2**62, -(2**62): -(2**62), 7: -(2**62)}


def test_numbered_rows(spark):
    """Ties keep the order's other columns; an empty table and one of a single row are fine."""
    rows = [(i, (i * 7919) % 50) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, x long")
    want = {i: k + 1 for k, (x, i) in enumerate(sorted((x, i) for i, x in rows))}
    assert {r.i: r.row for r in windows.numbered(df, [F.col("x"), F.col("i")]).collect()} == want
    assert windows.numbered(df.limit(0), [F.col("x")]).count() == 0
    assert [r.row for r in windows.numbered(df.filter("i = 3"), [F.desc("x")]).collect()] == [1]


def test_thresholds(spark):
    df = spark.createDataFrame([(5.0,), (50.0,)], "m double")
    got = df.select(figures.threshold(F.col("m")).alias("a"), figures.threshold(F.col("m"), True).alias("b")).collect()
    assert [(round(r.a, 6), round(r.b, 6)) for r in got] == [(0.4, 1.0), (4.0, 4.0)]


def test_leader_clusters_equal_the_walk(spark, tmp_path):
    """Headlines in id order join the first leader that shares three words and 0.3 of the union, else they lead."""
    import random

    from tidewire.plans import extraction

    r = random.Random(5)
    pool = [f"word{c}{d}" for c in "abcd" for d in "efgh"]
    rows = [(i, " ".join(r.sample(pool, r.randrange(2, 7))), f"s{i % 2}") for i in range(160)] + [(700, "worde wordf", "s0"), (701, "", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want, leaders = {}, {}
    import re

    for i, t, s in sorted(rows):
        words = set(re.findall("[a-z]{4,}", t))
        own = leaders.setdefault((s, i // 500), [])
        hit = next((k for k, w in own if len(w & words) >= 3 and len(w & words) >= 0.3 * len(w | words)), None)
        if hit is None:
            own.append((i, words))
            hit = i
        want[i] = hit
    assert {x.doc_id: x.leader for x in extraction.leader_clusters(spark, str(tmp_path)).collect()} == want


def test_overlapping_equals_all_pairs(spark):
    """Pairs of one day or of two days running that share three words and 0.55 of the smaller set, whichever side is the smaller."""
    rng = random.Random(5)
    sets = {i: sorted(rng.sample([f"word{c}" for c in "abcdefghijklmnop"], rng.randint(0, 12))) for i in range(60)}
    d = spark.createDataFrame([(i, i // 20, t, len(t)) for i, t in sets.items()] + [(60, 2, None, None)], "doc_id long, day long, t array<string>, size int")
    for gap in (0, 1):
        want = set()
        for a, x in sets.items():
            for b, y in sets.items():
                n = len(set(x) & set(y))
                if a < b and b // 20 - a // 20 == gap and n >= 3 and n * 100 >= 55 * min(len(x), len(y)):
                    want.add((b // 20, a, b, n))
        got = [tuple(r) for r in networks.overlapping(d, gap).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_headline_queries_read_whole_texts(spark, tmp_path):
    """Words that stand far behind the beginning of a text count like those before."""
    filler = " ".join(f"filler{c}" for c in "abcdefghijklmnopqrstuvwxyz" * 3)
    spark.createDataFrame([(1, f"{filler} economía", "s", "en"), (2, f"{filler} economia", "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    assert [r.df for r in q["trending_terms"](spark, str(tmp_path)).collect() if r.term == "economia"] == [2]
    assert len({r.key for r in q["title_key"](spark, str(tmp_path)).collect()}) == 1
    assert {r.stem for r in q["stems"](spark, str(tmp_path)).collect()} >= {"econom"}
    assert [(r.a, r.b) for r in q["near_dup_pairs"](spark, str(tmp_path)).collect()] == [(1, 2)]
