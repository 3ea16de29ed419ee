"""Line dedup in native Spark: range-partitioned hashes, first occurrences, keep bitmaps.

Lines become (hash of the key, document, position) records.  They are range-partitioned by hash and
sorted by hash, document and position, so first occurrences stream past in order.  Hashes that a
sample shows to be hot get salts and spread over ranges; the few salts' firsts are combined
afterwards, so salting moves work and never changes a result.  Per document the operator returns a
keep bitmap, compressed to its runs of dropped lines, and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, hash128, lower_ascii, written

MIN_KEY = 10
#: One document in HOT_ONE_IN is looked at for hot lines; a line in over HOT_SHARE of their lines is salted.
HOT_ONE_IN, HOT_SHARE, SALTS = 50, 0.002, 64
NO_ID = (1 << 63) - 1


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.btrim(lower_ascii(line), F.lit(SPACES))


def _records(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    text = F.col(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("x"), F.posexplode(lines_of(text)).alias("pos", "line"))
    rows = rows.select("d", "x", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    h1, h2 = hash128(F.col("key"))
    return rows.select(h1.alias("h1"), h2.alias("h2"), "d", "x", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """Compressed keep bitmaps of the documents that lose lines: d (id), x (hash of the text), dropped.

    `dropped` holds the cleared bits as runs (start, length), in order; every other line is kept.  A
    line goes if its key (white space stripped, A-Z lower-cased) has at least `min_key` code points
    and a smaller id holds it too; lines of the smallest id stay, repeats included.  A null text is
    one empty line.  Rows with the same id count as one holder; a null id counts as the largest.
    """
    # Written once: range partitioning samples its input, and the text must not be split again for that.
    rec = written(_records(docs, id_col, text_col, min_key), "lines")
    seen = rec.filter(F.pmod(F.xxhash64("d"), F.lit(HOT_ONE_IN)) == 0).groupBy("h1").count()
    # At most 1 / HOT_SHARE hashes can hold such a share, so what reaches the driver is bounded.
    all_seen = seen.agg(F.sum("count")).first()[0] or 0
    hot = [r.h1 for r in seen.filter(F.col("count") > max(2, HOT_SHARE * all_seen)).select("h1").collect()]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    rec = rec.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("d"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rec = rec.repartitionByRange(parts, "h1", "salt").sortWithinPartitions("h1", "h2", "salt", "d", "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("d", "pos")
    rec = rec.withColumn("first", F.first("d").over(stream))
    if hot:
        # One row for each hot hash at most.
        firsts = rec.filter(is_hot).groupBy("h1", "h2").agg(F.min("first").alias("lowest"))
        rec = rec.join(F.broadcast(firsts), ["h1", "h2"], "left").withColumn("first", F.coalesce("lowest", "first"))
    gone = rec.filter(F.col("d") > F.col("first")).groupBy("d", "x").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    n = F.size("p")
    starts = F.filter("p", lambda v, i: (i == 0) | (F.get("p", i - 1) != v - 1))
    ends = F.filter("p", lambda v, i: (i == n - 1) | (F.get("p", i + 1) != v + 1))
    return gone.select("d", "x", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """`docs` with the dropped lines gone from the text column; with `counts` also n_lines and n_dropped.

    A text that loses nothing stays as it is (null stays null).  The counts replace columns of their names."""
    own = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    text, d, x = F.col(f"l.{text_col}"), F.coalesce(F.col(f"l.{id_col}").cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(f"l.{text_col}"))
    joined = docs.alias("l").join(bitmaps.alias("b"), (d == F.col("b.d")) & (x == F.col("b.x")), "left")
    lines, runs = lines_of(text), F.col("b.dropped")
    cleared = F.flatten(F.transform(runs, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    # The bits of the bitmap, as a string of 0 and 1 built run by run.
    edges = F.transform(runs, lambda r, i: F.concat(F.repeat(F.lit("1"), r["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"])), F.repeat(F.lit("0"), r["length"])))
    bits = F.split(F.array_join(edges, ""), "")
    kept = F.array_join(F.filter(lines, lambda v, i: F.coalesce(F.get(bits, i), F.lit("1")) != "0"), "\n")
    new = F.when(runs.isNull(), text).otherwise(kept)
    texts = [(new.alias(c) if c == text_col else F.col(f"l.{c}")) for c in own]
    if not counts:
        return joined.select(*texts)
    return joined.select(*texts, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(cleared), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """Bitmaps made and applied in one go."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_key), id_col, text_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
with l as (
  select doc_id, generate_subscripts(a, 1) as pos, unnest(a) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)
), k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key, min(doc_id) as first_doc from k where length(key) >= 10 group by key
), m as (
  select k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) as gone from k left join f on k.key = f.key
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
