"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shared import WORD, keep, words

#: Slot k of the schedule is at the point k / golden ratio mod 1, in units of 2**-31: an odd multiplier visits every unit once.
UNIT, GOLDEN = 1 << 31, 1327217885
BINS = 1024
#: Slots that are ranked together.
CHUNK = 1 << 16
#: Words of a block at most, and slots that a mix has about, at least: the points miss a source's share by a few slots.
BLOCK, SLOTS = 1024, 1 << 17
#: Documents of a bucket of a source's stream, on average.
BUCKET = 1024


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size (the words of the text; null: 0)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_pct: int = 150, cap: int = 2) -> DataFrame:
    """One row per source: idx, source, source_size, n_docs, target (double) and quota (whole words).

    Sources in code point order, null last, get the weights in turn. The level that share_pct of all words fills under the caps is
    found in order of cap / weight: sources before the first one that stays below its cap are full, the rest share what is left.
    Only rows of sources, not of documents, meet in one task.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("idx"), F.lit(len(weights))) + 1).cast("int"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("idx", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long")).withColumn("w", weight.cast("long")).withColumn("cap", cap * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "idx")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("pos", F.row_number().over(order)).withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(after)).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    left = share_pct * F.col("all") - 100 * F.col("full_before")
    s = s.withColumn("left", left).withColumn("full", 100 * F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
    first = F.min(F.when(~F.col("full"), F.struct("pos", "left", "w_left"))).over(Window.partitionBy())
    s = s.withColumn("open", first).withColumn("target", F.when(F.col("open").isNull() | (F.col("pos") < F.col("open.pos")), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("open.left")).cast("double") / (100 * F.col("open.w_left")).cast("double")))
    return s.select("idx", "source", "source_size", "n_docs", "target", F.least(F.floor("target"), F.col("cap")).cast("long").alias("quota"))


def _place(seed: int) -> Column:
    """Where a document stands in its source's shuffled order: 60 bits of a digest."""
    named = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def offsets(sized: DataFrame, sources: DataFrame, seed: int = 17) -> DataFrame:
    """Documents of some size in a shuffled order of their source: `at` is where one begins in its source's stream.

    The order is that of a seeded hash. Its leading bits make buckets, so a source with very many documents is summed and ordered
    in many tasks: totals of buckets first, then positions within each bucket.
    """
    many = sources.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    bits = max(1, (many // BUCKET).bit_length())
    d = sized.filter("size > 0").withColumn("h", _place(seed)).withColumn("bucket", F.shiftright("h", 60 - bits))
    totals = d.groupBy("source", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.withColumn("base", F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    t = totals.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "base")
    return d.join(t, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).select("doc_id", "source", "size", (F.col("base") + F.col("own")).alias("at"))


def block_size(sources: DataFrame, most: int = BLOCK, slots: int = SLOTS) -> int:
    """Words of a block: small enough that the mix has about `slots` slots, and `most` at most."""
    return max(1, min(most, (sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]) // slots))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, idx, rank: the golden-ratio points mapped through the sources' cumulative quotas, ranked per source.

    There is a slot for each block of all quotas. Ranks are counted per chunk of slots and source first, so no source's slots meet
    in one task.
    """
    spark = sources.sparkSession
    need = sources.select("idx", "quota").filter("quota > 0")
    total = need.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    n = -(-total // block)
    edge = lambda sums: F.floor(sums.cast("double") / F.lit(float(max(total, 1))) * UNIT).cast("long")
    upto = F.sum("quota").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    spans = need.select("idx", edge(upto - F.col("quota")).alias("lo"), edge(upto).alias("hi")).filter("hi > lo")
    spans = spans.select("idx", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS / UNIT).cast("long"), F.floor((F.col("hi") - 1) * BINS / UNIT).cast("long"))).alias("bin"))
    x = F.pmod(F.pmod(F.col("id") + 1, F.lit(UNIT)) * GOLDEN, F.lit(UNIT))
    slots = spark.range(n).select(F.col("id").alias("slot"), x.alias("x")).withColumn("bin", F.floor(F.col("x") * BINS / UNIT).cast("long"))
    drawn = slots.join(spans, "bin").filter("x >= lo AND x < hi").select("slot", "idx", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("idx", "chunk").count().withColumn("base", F.coalesce(F.sum("count").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.withColumn("own", F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1)
    return ranked.join(counts.select("idx", "chunk", "base"), ["idx", "chunk"]).select("slot", "idx", (F.col("base") + F.col("own")).alias("rank"))


def mix(sized: DataFrame, sources: DataFrame, block: int, seed: int = 17, cap: int = 2) -> DataFrame:
    """The mix as pieces: slot, doc_id, source, size, at, epoch and the words [first, last) of the document that the slot takes.

    A source's shuffled documents form one stream, which may be read `cap` times; slot `rank` of the source takes block `rank` of
    it, so a source gives what its slots drew. The points give a source its quota but for a few blocks (their discrepancy grows with
    the logarithm of the number of slots), and never more than cap times its size: slots beyond the stream's end stay empty.
    """
    slots = keep(schedule(sources, block), "slots")
    drawn = slots.groupBy("idx").agg(F.max("rank").alias("top"))
    ends = sources.join(drawn, "idx").select(F.col("source").alias("s2"), "idx", "source_size", F.least((F.col("top") + 1) * block, cap * F.col("source_size")).alias("end"))
    d = offsets(sized, sources, seed).join(ends, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")

    def run(e: int):
        lo = F.col("at") + e * F.col("source_size")
        hi = F.least(lo + F.col("size"), F.col("end"))
        blocks = F.sequence(F.floor(lo / block).cast("long"), F.floor((hi - 1) / block).cast("long"))
        return F.when(hi > lo, F.transform(blocks, lambda b: F.struct(F.lit(e).alias("epoch"), b.alias("rank"), (F.greatest(lo, b * block) - lo).alias("first"), (F.least(hi, (b + 1) * block) - lo).alias("last")))).otherwise(F.array())

    pieces = d.select("doc_id", "source", "idx", "size", "at", F.explode(F.concat(*map(run, range(cap)))).alias("p")).select("doc_id", "source", "idx", "size", "at", "p.*")
    return pieces.join(slots, ["idx", "rank"]).drop("idx", "rank")


def mix_totals(docs: DataFrame, block: int | None = None, seed: int = 17, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken, the words that the slots of the mix take of it.

    Null texts and texts without words have size 0 and give nothing. A null source is a source. Repeated rows have places of their
    own in the stream, so each counts by itself. An empty table gives an empty result; other columns are not read.
    """
    sized = keep(sizes(docs), "sizes")
    sources = keep(targets(sized, **how), "sources")
    taken = mix(sized, sources, block or block_size(sources), seed, how.get("cap", 2)).groupBy("doc_id", "source", "size", "at").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    placed = offsets(sized, sources, seed)
    same = [placed[c].eqNullSafe(taken[c]) for c in ("doc_id", "source", "size", "at")]
    on = same[0] & same[1] & same[2] & same[3]
    some = placed.join(taken, on, "left").select(placed["doc_id"], placed["source"], placed["size"], F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    every = some.unionByName(sized.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    t = sources.select(F.col("source").alias("s2"), "source_size", "target")
    return every.join(t, F.col("source").eqNullSafe(F.col("s2"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int | None = None, seed: int = 17, cap: int = 2, slots: bool = False, **how) -> DataFrame:
    """The documents of the mix: a row for each time that one is taken, with the columns of the input, in the order of the schedule.

    A document stands at the slot of its first block, those of one slot as in their source's stream; with `slots`, a column slot
    tells it. The one document of a source at which its slots end is cut to the words taken (joined by one space, n_chars set anew);
    all others are whole. Documents without words are in no source's stream and not in the mix. Placements are matched to rows by
    id, source and size, and rows that agree in all three by their order, so repeated rows give no more than they are.
    """
    sized = keep(sizes(docs), "sizes")
    sources = keep(targets(sized, cap=cap, **how), "sources")
    taken = mix(sized, sources, block or block_size(sources), seed, cap).groupBy("doc_id", "source", "size", "at", "epoch").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("slot").alias("slot"))
    parts = taken.groupBy("doc_id", "source", "size", "at").agg(F.collect_list(F.struct("epoch", "first", "last", "slot")).alias("_parts"))
    same = ["doc_id", "source", "size"]
    parts = parts.withColumn("_nth", F.row_number().over(Window.partitionBy(*same).orderBy("at"))).select(*(F.col(c).alias(f"_{c}") for c in same), "_nth", F.col("at").alias("_at"), "_parts")
    rows = docs.withColumn("_n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "source", "_n").orderBy(F.xxhash64("text"))))
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")) & (F.col("_k") == F.col("_nth"))
    out = rows.join(parts, on).withColumn("_p", F.explode("_parts")).orderBy("_p.slot", "_source", "_p.epoch", "_at")
    whole = (F.col("_p.first") == 0) & (F.col("_p.last") == F.col("_n"))
    cut = F.array_join(F.slice(words(F.col("text")), (F.col("_p.first") + 1).cast("int"), (F.col("_p.last") - F.col("_p.first")).cast("int")), " ")
    text = F.when(whole, F.col("text")).otherwise(cut)
    named = {"text": text, "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(cut).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return out.select(*(named[c].alias(c) if c in named else F.col(c) for c in docs.columns), *([F.col("_p.slot").alias("slot")] if slots else ()))


def oracle(weights: tuple[int, ...] = (5, 2, 1), share_pct: int = 150, cap: int = 2, seed: int = 17) -> str:
    """The registered query in DuckDB: quotas, then the number of slots whose points fall to each source, then its stream up to there."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, {cap} * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(map(str, weights))}])[1 + idx % {len(weights)}]::BIGINT AS w FROM s),
o AS (SELECT *, row_number() OVER k AS pos, coalesce(sum(cap) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(w) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left, (sum(n) OVER ())::BIGINT AS total FROM w WINDOW k AS (ORDER BY cap / w, idx)),
l AS (SELECT *, {share_pct} * total - 100 * before AS rest FROM o),
f AS (SELECT min(pos) AS pos FROM l WHERE NOT 100 * cap * w_left <= w * rest),
t AS (SELECT l.idx, l.source, l.n, l.cap, CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN l.cap::DOUBLE ELSE (l.w * a.rest)::DOUBLE / (100 * a.w_left)::DOUBLE END AS target
  FROM l CROSS JOIN f LEFT JOIN l a ON a.pos = f.pos),
q AS (SELECT *, least(floor(target), cap)::BIGINT AS quota FROM t),
c AS (SELECT *, (sum(quota) OVER (ORDER BY idx))::BIGINT AS upto, (sum(quota) OVER ())::BIGINT AS quotas FROM q WHERE quota > 0),
b AS (SELECT *, floor((upto - quota)::DOUBLE / quotas::DOUBLE * {UNIT})::BIGINT AS lo, floor(upto::DOUBLE / quotas::DOUBLE * {UNIT})::BIGINT AS hi, greatest(1, least({BLOCK}, quotas // {SLOTS})) AS block FROM c),
p AS (SELECT (((k + 1) % {UNIT}) * {GOLDEN}) % {UNIT} AS x FROM (SELECT unnest(range((SELECT max((quotas + block - 1) // block) FROM b))) AS k)),
e AS (SELECT b.idx, least(count(*) * any_value(block), any_value(cap))::BIGINT AS stop FROM b JOIN p ON p.x >= b.lo AND p.x < b.hi GROUP BY b.idx),
h AS (SELECT doc_id, source, size, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS h FROM d WHERE size > 0),
m AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM h),
z AS (SELECT doc_id, source, size, place FROM m UNION ALL SELECT doc_id, source, size, NULL FROM d WHERE size = 0)
SELECT z.doc_id, z.size, q.n AS source_size, q.target, ({" + ".join(f"coalesce(greatest(0, least(z.place + {k} * q.n + z.size, e.stop) - z.place - {k} * q.n), 0)" for k in range(cap))})::BIGINT AS taken
FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source LEFT JOIN e ON e.idx = q.idx"""
