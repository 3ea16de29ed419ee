"""Mixing sources to target weights by entropy balancing, in native Spark.

Each document gets a rate, the number of times the mix takes it.  Rates stay as near to 1 as they can
in relative entropy while each source's words meet their target: minimise sum of q (w log w - w + 1)
with sum of size * w = target for each source.  With prior precision q = size + mean size of the
source the solution is w = min(cap, exp(lambda * size / q)), a tilt that grows with length but is
bounded.  The convex dual in lambda is solved by safeguarded Newton steps; each step is one
distributed aggregate over a (source, size) histogram, whatever the number of documents.  Rates are
rounded to copies by carrying the running sum of rates through documents ordered by size, so that
rounding errors cancel; at last a few single copies move each source onto its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import word_count, written

WEIGHTS, CAP = (1.0, 2.0, 3.0), 3
#: Documents of equal source and size are ranked in chunks of about this many.
CHUNK = 4096
ROUNDS, CLOSE, FIXES = 60, 1e-9, 3


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds `target` to (source, source_size): weights repeat over sources by code point, null last.

    Targets share the sum of all sizes by weight, stop at cap times the source's size, and what a stop
    frees is shared again by weight.  The fixed point is a level: target = min(cap size, level weight).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("most", F.col("source_size").cast("double") * cap).withColumn("turn", F.col("most") / F.col("weight"))
    up = Window.orderBy("turn", F.col("source").asc_nulls_last())
    s = s.withColumn("k", F.row_number().over(up))
    s = s.withColumn("spent", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("spent")) / F.col("left"))
    s = s.withColumn("fill", F.min_by("level", F.when(F.col("level") <= F.col("turn"), F.col("k"))).over(whole))
    return s.select("source", "source_size", F.least("most", F.col("fill") * F.col("weight")).alias("target"))


def _same(left: str, right: str):
    return F.col(f"l.{left}").eqNullSafe(F.col(f"r.{right}"))


def _rates(hist: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """lambda for each source; one aggregate of the histogram a round."""
    goals = goals.join(hist.filter("size > 0").groupBy("source").agg(F.sum("n").alias("docs")).withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
    state = goals.withColumn("mean", F.col("source_size") / F.greatest(F.coalesce("docs", F.lit(0)), F.lit(1)))
    ok = (F.col("target") > 0) & (F.col("source_size") > 0)
    state = state.withColumn("lam", F.when(ok, 2 * F.log(F.when(ok, F.col("target") / F.col("source_size")))).otherwise(F.lit(0.0))).withColumn("lo", F.lit(-1e5)).withColumn("hi", F.lit(1e5)).withColumn("gap", F.when(ok, F.lit(1.0)).otherwise(F.lit(0.0)))
    state = written(state, "dual0")
    for k in range(ROUNDS):
        at = hist.alias("l").join(state.alias("r"), _same("source", "source")).select("r.*", "l.size", "l.n")
        x = F.col("size") / (F.col("size") + F.col("mean"))
        w = F.least(F.lit(float(cap)), F.exp(F.col("lam") * x))
        words = F.col("n") * F.col("size")
        free = F.col("lam") * x < F.log(F.lit(float(cap)))
        sums = at.filter("size > 0").groupBy("source").agg(F.sum(words * w).alias("got"), F.sum(F.when(free, words * w * x).otherwise(0.0)).alias("slope")).withColumnRenamed("source", "s2")
        state = state.join(sums, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
        live = (F.col("got") > 0) & (F.col("target") > 0)
        g = F.when(live, F.log(F.when(live, F.col("got") / F.col("target")))).when(F.col("target") > 0, F.lit(-1.0)).otherwise(F.lit(0.0))
        state = state.withColumn("g", g).withColumn("lo", F.when(F.col("g") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("g") > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - F.col("g") * F.col("got") / F.when(F.col("slope") > 0, F.col("slope"))
        safe = (step > F.col("lo")) & (step < F.col("hi"))
        state = state.withColumn("lam", F.when(F.abs("g") <= CLOSE, F.col("lam")).when(safe, step).otherwise((F.col("lo") + F.col("hi")) / 2)).withColumn("gap", F.abs("g"))
        state = written(state.drop("got", "slope", "g"), f"dual{k + 1}")
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= CLOSE:
            break
    return state


def _missed(part: DataFrame) -> DataFrame:
    """Adds `miss`: words that the source lacks (over 0) or has too many of."""
    left = part.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("miss")).withColumnRenamed("source", "s2")
    return part.join(left, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")


def mix_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies.

    Size is the number of words (null text: 0).  A null source is a source, last in order; a null id is
    an id like others; repeated rows count each.  Documents without words get copies that take nothing.
    An empty table gives no rows.  Columns beside the three are ignored.
    """
    rec = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # Rows without an id are told apart by their place, so that they too are ranked in chunks.
    rec = written(rec.withColumn("place", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "sizes")
    hist = written(rec.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    goals = written(source_targets(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap), "targets")
    dual = _rates(hist, goals, cap)
    rate = F.least(F.lit(float(cap)), F.exp(F.col("lam") * F.when(F.col("l.size") > 0, F.col("l.size") / (F.col("l.size") + F.col("mean"))).otherwise(0.0)))
    rates = hist.alias("l").join(dual.alias("r"), _same("source", "source")).select("l.source", "l.size", "l.n", "r.source_size", "r.target", rate.alias("rate"))
    chunks = F.ceil(F.col("r.n") / CHUNK).cast("long")
    rec = rec.alias("l").join(rates.alias("r"), _same("source", "source") & (F.col("l.size") == F.col("r.size"))).select("l.*", "r.source_size", "r.target", "r.rate", F.pmod(F.xxhash64("l.doc_id", "l.place"), chunks).alias("chunk"))
    rec = written(rec, "rated")
    part = rec.groupBy("source", "size", "chunk").agg(F.count("*").alias("m"), F.first("rate").alias("rate"), F.first("target").alias("target"))
    run = Window.partitionBy("source").orderBy(F.desc("size"), "chunk").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("c", F.sum(F.col("m") * F.col("rate")).over(run))
    up = F.floor(F.col("c") + 0.5) - F.floor(F.col("c") - F.col("m") * F.col("rate") + 0.5)
    low, high = F.col("m") * F.floor("rate"), F.col("m") * F.ceil("rate")
    part = part.withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).withColumn("copies", F.greatest("low", F.least("high", up)).cast("long"))
    part = written(part.select("source", "size", "chunk", "m", "low", "high", "copies", "target"), "quotas")
    # What is missed, longest documents first, as far as each stays between the floor and the ceiling of its rate.
    both = _missed(part).withColumn("want", F.abs("miss"))
    slack = F.when(F.col("miss") > 0, F.col("high") - F.col("copies")).otherwise(F.col("copies") - F.col("low"))
    both = both.withColumn("slack", F.when((F.col("size") > 0) & (F.col("size") <= F.col("want")), slack).otherwise(F.lit(0)))
    ahead = F.coalesce(F.sum(F.col("slack") * F.col("size")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = F.least(F.col("slack"), F.floor((F.col("want") - ahead) / F.greatest(F.col("size"), F.lit(1))))
    moved = F.col("copies") + F.signum("miss").cast("long") * F.greatest(some, F.lit(0))
    part = written(both.select("source", "size", "chunk", "m", "target", moved.cast("long").alias("copies")), "spread")
    for k in range(FIXES):  # then single copies of the best-fitting size in each source
        both = _missed(part)
        can = F.when(F.col("miss") > 0, F.col("copies") < cap * F.col("m")).otherwise(F.col("copies") > 0)
        can = can & (F.col("size") > 0) & (F.abs(F.col("size") - F.abs("miss")) < F.abs("miss"))
        best = both.filter(can).groupBy("source").agg(F.min_by(F.struct("size", "chunk", F.signum("miss").cast("long").alias("by")), F.struct(F.abs(F.col("size") - F.abs("miss")), "size", "chunk")).alias("p"))
        part = part.alias("l").join(best.alias("r"), _same("source", "source") & (F.col("l.size") == F.col("p.size")) & (F.col("l.chunk") == F.col("p.chunk")), "left")
        part = written(part.select("l.source", "l.size", "l.chunk", "l.m", (F.col("l.copies") + F.coalesce("p.by", F.lit(0))).alias("copies"), "l.target"), f"fixed{k}")
    part = part.withColumn("base", F.floor(F.col("copies") / F.col("m"))).withColumn("extra", F.col("copies") - F.col("base") * F.col("m"))
    rec = rec.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "chunk").orderBy(F.xxhash64(F.lit(5), F.col("doc_id")), "doc_id", "place")))
    rec = rec.alias("l").join(part.alias("r"), _same("source", "source") & (F.col("l.size") == F.col("r.size")) & (F.col("l.chunk") == F.col("r.chunk")))
    copies = F.col("base") + F.when(F.col("k") <= F.col("extra"), 1).otherwise(0)
    return rec.select("l.doc_id", "l.source", "l.size", "l.source_size", "l.target", "l.rate", copies.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each row as often as its copies say, columns unchanged.

    Rows that share id, source and size share what `mix_copies` gives them all: each gets the same
    number of copies and some of them one more, so the words that come out are the words taken.
    """
    own = docs.columns
    of = mix_copies(docs, weights, cap, id_col, source_col, text_col).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    of = written(of.filter("copies > 0"), "copies")
    size = word_count(F.col(f"l.{text_col}"))
    on = F.col(f"l.{id_col}").eqNullSafe(F.col("r.doc_id")) & F.col(f"l.{source_col}").eqNullSafe(F.col("r.source")) & (F.col("r.size") == size)
    row = [F.col(f"l.{x}") for x in own]
    many = lambda n: F.explode(F.sequence(F.lit(1), n)).alias("__copy")
    out = docs.alias("l").join(of.filter("rows = 1").alias("r"), on).select(*row, many(F.col("r.copies"))).drop("__copy")
    several = of.filter("rows > 1")
    if several.isEmpty():
        return out
    # Rows of one key are numbered by what they hold and the part of the table they came in, parts being counted on top.
    tag = [F.xxhash64(F.to_json(F.struct(*row))), F.xxhash64(F.lit(1), F.to_json(F.struct(*row)))]
    part = docs.alias("l").join(several.alias("r"), on).select(F.struct(*[c.alias(x) for c, x in zip(row, own, strict=True)]).alias("row"), "r.copies", "r.rows", F.xxhash64("r.doc_id", "r.source", "r.size").alias("key"), tag[0].alias("t1"), tag[1].alias("t2"), F.spark_partition_id().alias("part"))
    part = written(part, "repeated")
    sizes = part.groupBy("key", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.join(sizes.select("key", "part", ahead.alias("ahead")), ["key", "part"])
    part = part.withColumn("k", F.col("ahead") + F.row_number().over(Window.partitionBy("key", "part").orderBy("t1", "t2")))
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("k") <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    part = part.withColumn("each", each).filter("each > 0").select("row", many(F.col("each"))).select("row.*")
    return out.unionByName(part)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
