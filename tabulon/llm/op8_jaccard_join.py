"""N-gram Jaccard join with a token-group matrix.

Documents with equal shingle sets are one class.  Every class has a prefix: its first shingles in a
global order that puts frequent ones last.  Two classes at Jaccard >= 3/4 share at least
ceil(3 (n1 + n2) / 7) shingles, and of those at least that many less the longer rest lie in both
prefixes; that bound is exact for any order, so nothing is lost.

Classes that are near each other by size in the lists of shared prefix shingles are candidates; the
best few of each class are checked exactly and give first components.  Shingles that one component
has alone say nothing more and go.  What is left is partitioned into groups of about GROUP similar
classes: parts of one large component, or of the classes that have the same most common shingle, of
like size and like number of shingles left.  The matrix stores each group's union of prefix
shingles.  Groups meet groups on it, never classes classes: the overlap of two unions, and the most
that any member has left, bound every link between them, and only pairs of groups that reach the
bound are opened.  There classes that share too few of their prefix shingles with every other go, a
query must reach the union of the other group's whole sets, and then every member is tested exactly.  Each group's best partner is opened first; pairs whose groups that has put
into one component are dropped before the rest is opened.  Links inside a component change nothing
and are not looked for, so a group of thousands of near copies is not compared pair by pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, written
from .components import connected_components, star_labels
from .textkernels import U64, Texts, mix, shingles, slices

WORDS, NUM, DEN = 5, 3, 4
#: Bins of the frequency sketch that orders shingles, and the bins that travel in one row.
BITS, CHUNK_BITS = 22, 14
#: Neighbours looked at in a list, candidates of a class that are checked at once, classes and shingles in a group (one longer
#: set is a group of its own), and entries of a frequent shingle's list that one task sorts.
LAGS, BEST, GROUP, GROUP_SHINGLES, LIST = 8, 4, 128, 1 << 15, 4096
#: Bits of the filter that picks the texts to read again.
FILTER_BITS = 23
NO_ID = (1 << 63) - 1


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each text."""
    for lo, hi in slices(column):
        t = Texts(column.slice(lo, hi - lo), lower=True)
        start, end, first = t.words()
        h, before = shingles(t.hashes(start, end), first, size)
        for k in range(t.n):
            yield lo + k, np.unique(h[before[k] : before[k + 1]])


def prefix_length(n):
    """Shingles in the prefix of a set of n."""
    return n - -(-NUM * n // DEN) + 1


def fingerprint(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([(mix(u) * (u | U64(1))).sum(dtype=U64) + U64(len(u))], U64)).view(np.int64)[0])


def _frequency_classes(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin of a sketch of all shingles, how far it lies above chance: 0, or a class that grows with the excess.

    Also, for each class, into how many lists its shingles are dealt.  Tasks send their counts as packed rows of bins; these are added up in streams and 1 byte a bin comes back.
    """
    step = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros(1 << BITS, np.int32)
        for b in batches:
            column = b.column("text")
            for lo, hi in slices(column):
                t = Texts(column.slice(lo, hi - lo), lower=True)
                start, end, first = t.words()
                h, _ = shingles(t.hashes(start, end), first, size)
                np.add.at(bins, (h >> U64(64 - BITS)).astype(np.int64), 1)
        for k in range(len(bins) // step):
            part = bins[k * step : (k + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["k", "bins"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(x.as_py()), np.int32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], ["k", "bins"])

    parts = docs.select("text").mapInArrow(count, "k int, bins binary").repartition("k").mapInArrow(add, "k int, bins binary")
    total = np.zeros(1 << BITS, np.int64)
    for r in parts.collect():  # 2 ** BITS numbers at most
        total[r.k * step : (r.k + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.bins)), np.int64)
    mean = max(float(total.mean()), 1.0)
    excess = (total - mean) / np.sqrt(mean)
    cuts = np.maximum(1, np.ceil(3 * 2 ** (np.arange(251) / 4) * np.sqrt(mean) / LIST))
    cuts[0] = 1
    return np.where(excess < 3, 0, np.clip(np.floor(4 * np.log2(np.maximum(excess, 1) / 3)) + 1, 1, 250)).astype(np.uint8), np.minimum(cuts, 1 << 30).astype(np.int32)


def _needed(n1, n2):
    """Least number of shared shingles at Jaccard NUM / DEN."""
    return F.ceil(F.lit(NUM) * (n1 + n2) / (NUM + DEN))


def _rest(n):
    """Shingles outside the prefix of a set of n, as a Column."""
    return F.ceil(F.lit(NUM) * n / DEN) - 1


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A null or blank text has no shingles and is its own component.  Rows with equal texts, repeated
    rows included, are in one component.  A null id is never the smallest unless all are null.  An
    empty table gives no rows; other columns are ignored.
    """
    return jaccard_groups(docs, id_col, text_col, size).select("doc_id", "n_shingles", "component_id")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, carry: dict[str, Column] | None = None) -> DataFrame:
    """Like `jaccard_components`, with `root` (a long that rows of one component share, null without shingles) and the columns of `carry`."""
    carry = carry or {}
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(k) for k, c in carry.items()])
    docs = whole.select("doc_id", "text")
    order, cuts = _frequency_classes(docs, size)
    carried = list(carry)
    names = ["doc_id", "n", "f", "prefix", "hot", "cuts", *carried]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for b in batches:
            n, f, p, often, lists = [], [], [], [], []
            for _, u in _sets(b.column("text"), size):
                n.append(len(u))
                f.append(key := fingerprint(u) if len(u) else 0)
                if not len(u) or key in known:  # copies in this task send their prefix once
                    for x in (p, often, lists):
                        x.append(None)
                    continue
                if len(known) < 1 << 20:
                    known.add(key)
                at = order[(u >> U64(64 - BITS)).astype(np.int64)]
                top = np.lexsort((u, at))[: int(prefix_length(len(u)))]
                into = cuts[at[top]]
                p.append(u[top[into == 1]].view(np.int64))
                often.append(u[top[into > 1]].view(np.int64))
                lists.append(into[into > 1])
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(p, long), pa.array(often, long), pa.array(lists, pa.list_(pa.int32())), *(b.column(k) for k in carried)], names)

    more = "".join(f", `{k}` {whole.schema[k].dataType.simpleString()}" for k in carry)
    found = written(whole.mapInArrow(prefixes, "doc_id long, n long, f long, prefix array<long>, hot array<long>, cuts array<int>" + more), "prefixes")
    rows = written(found.select("doc_id", "n", "f", *carry), "rows")
    classes = written(rows.filter("n > 0").groupBy("f", "n").agg(F.min("doc_id").alias("low")), "classes")
    # Shingles that two classes have in their prefixes; a frequent shingle has several lists, and is taken as shared.
    token = Window.partitionBy("token")
    rare = found.filter("prefix is not null").select(F.explode("prefix").alias("token"), "f", "n")
    rare = rare.withColumn("a", F.min("f").over(token)).withColumn("z", F.max("f").over(token)).filter("a <> z").select("token", "f", "n").dropDuplicates()
    often = found.filter("size(hot) > 0").select(F.explode(F.arrays_zip("hot", "cuts")).alias("s"), "f", "n").dropDuplicates()
    often = often.select(F.col("s.hot").alias("token"), "f", "n", F.pmod(F.xxhash64("f"), F.col("s.cuts")).cast("int").alias("list"))
    shared = written(rare.select("token", "f", "n", F.lit(-1).alias("list")).unionByName(often), "shared")
    discard(found)

    # Neighbours by size in the lists, kept where the bound allows a link.
    by_size = Window.partitionBy("token", "list").orderBy("n", "f")
    back = F.array(*[F.struct(F.lag("f", k).over(by_size).alias("f2"), F.lag("n", k).over(by_size).alias("n2")) for k in range(1, LAGS + 1)])
    pairs = shared.select("f", "n", back.alias("back")).select("f", "n", F.inline("back")).filter(f"f2 is not null and {DEN} * n2 >= {NUM} * n")
    pairs = pairs.groupBy("f", "n", "f2", "n2").agg(F.count("*").alias("c"))
    pairs = pairs.filter(F.col("c") >= _needed(F.col("n"), F.col("n2")) - F.greatest(_rest(F.col("n")), _rest(F.col("n2"))))
    # The best of each class from both ends; the rest is left to the matrix.
    share = (F.col("c") / (F.col("n") + F.col("n2"))).alias("share")
    ends = pairs.select("f", "f2", share).unionByName(pairs.select(F.col("f2").alias("f"), F.col("f").alias("f2"), share))
    ends = ends.withColumn("k", F.row_number().over(Window.partitionBy("f").orderBy(F.desc("share"), "f2"))).filter(F.col("k") <= BEST)
    pairs = written(ends.select(F.least("f", "f2").alias("f"), F.greatest("f", "f2").alias("f2")).dropDuplicates(), "neighbours")
    sets = _whole_sets(docs, classes, pairs.select("f").unionByName(pairs.select(F.col("f2").alias("f"))), size)
    both = pairs.join(sets.select("f", F.col("tokens").alias("x")), "f").join(sets.select(F.col("f").alias("f2"), F.col("tokens").alias("y")), "f2")
    links = written(both.select("f", "f2", "x", "y").mapInArrow(_linked, "u long, v long"), "links")
    discard(pairs)
    parts = connected_components(links)

    # The shingles that are left: those of more than one component.
    heavy = parts.groupBy("root").agg(F.count("*").alias("weight"))
    parts = written(parts.join(heavy, "root").withColumnRenamed("id", "f"), "parts")
    left = shared.join(parts, "f", "left").withColumns({"root": F.coalesce("root", "f"), "weight": F.coalesce("weight", F.lit(1))})
    rare = left.filter("list < 0").withColumn("a", F.min("root").over(token)).withColumn("z", F.max("root").over(token)).withColumn("many", F.count("*").over(token)).filter("a <> z")
    often = left.filter("list >= 0")
    several = often.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count("*").alias("many")).filter("a <> z").select("token", "many")
    own = ["token", "f", "n", "root", "weight", "many"]
    placed = written(rare.select(*own).unionByName(often.join(several, "token").select(*own)), "placed")
    discard(shared, parts)

    member = written(_groups(placed), "members")
    groups = member.groupBy("g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("m").alias("m"))
    grouped = written(placed.select("token", "f").join(member.select("f", "n", "root", "g"), "f"), "grouped")
    discard(placed)
    matrix = grouped.groupBy("token", "g").agg(F.min("root").alias("a"), F.max("root").alias("z"))
    matrix = written(matrix.join(groups, "g"), "matrix")
    opened = written(_qualifying(matrix), "opened")
    discard(matrix)
    # Inside, first the shingles that are left tell which classes may have a link at all; only their whole sets travel.
    light = _only(grouped, opened).groupBy("g", "f").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list("token")).alias("tokens"))
    light = written(light.groupBy("g").agg(F.collect_list(F.struct("f", "root", "n", "tokens")).alias("members")), "light")  # bounded groups
    opened = written(_pairs(opened, light, "c").mapInArrow(_may_link, "g1 long, g2 long, c long, f array<long>"), "candidates")
    discard(grouped, light)
    sets = _whole_sets(docs, classes, opened.select(F.explode("f").alias("f")), size)
    packs = written(sets.join(member.select("f", "root", "g"), "f").groupBy("g").agg(F.collect_list(F.struct("f", "root", "tokens")).alias("members")), "packs")

    # Each group's best partner and what lies inside groups first, then the pairs that still join components.
    two = opened.filter("g1 <> g2")
    ends = two.select(F.col("g1").alias("g"), F.col("g2").alias("other"), "c").unionByName(two.select(F.col("g2").alias("g"), F.col("g1").alias("other"), "c"))
    best = ends.groupBy("g").agg(F.max(F.struct("c", "other")).alias("s"))
    best = best.select(F.least("g", "s.other").alias("g1"), F.greatest("g", "s.other").alias("g2")).dropDuplicates()
    first = written(best.unionByName(opened.filter("g1 = g2").select("g1", "g2")), "best")
    links = links.unionByName(written(_pairs(first, packs).mapInArrow(_open_groups, "u long, v long"), "first"))
    parts = connected_components(links)
    now = packs.select("g", F.explode("members.f").alias("f")).join(member.select("f", "root"), "f").join(parts.toDF("f", "new"), "f", "left")
    now = now.groupBy("g").agg(F.min(F.coalesce("new", "root")).alias("a"), F.max(F.coalesce("new", "root")).alias("z"))
    apart = two.join(first, ["g1", "g2"], "left_anti").join(now.toDF("g1", "a1", "z1"), "g1").join(now.toDF("g2", "a2", "z2"), "g2").filter("least(a1, a2) <> greatest(z1, z2)")
    apart = written(apart.select("g1", "g2"), "apart")
    if not apart.isEmpty():
        parts = connected_components(links.unionByName(written(_pairs(apart, packs).mapInArrow(_open_groups, "u long, v long"), "second")))
    discard(packs)

    known = classes.join(parts.withColumnRenamed("id", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(least, "root").select("f", "n", "root", "component")
    out = rows.select("doc_id", "n", "f", *carry).join(known, ["f", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "root", *carry)


def _groups(placed: DataFrame) -> DataFrame:
    """(f, n, root, m, g): the classes of `placed` in groups of at most about GROUP classes and GROUP_SHINGLES shingles.

    m is the number of shingles that a class has left.
    """
    member = placed.groupBy("f", "n", "root", "weight").agg(F.count("*").alias("m"), F.max(F.struct("many", "token")).alias("common"))
    # A component that fills a group has groups of its own; others go to the most common shingle they have.
    small = member.filter(F.col("weight") < GROUP)
    home = small.groupBy("root").agg(F.max("common").alias("common"))
    small = small.drop("common").join(home, "root").withColumn("at", F.xxhash64("common.token"))
    large = member.filter(F.col("weight") >= GROUP).withColumn("at", F.xxhash64(F.lit(1), F.col("root")))
    own = ["f", "n", "root", "m", "at"]
    member = small.select(*own).unionByName(large.select(*own)).withColumn("scale", F.floor(F.log(F.col("n").cast("double")) * 10).cast("int"))
    full = (F.count("*") > GROUP) | (F.sum("n") > GROUP_SHINGLES)
    member = member.join(member.groupBy("at", "scale").agg(full.alias("full")), ["at", "scale"])
    member = member.withColumn("fine", F.when(F.col("full"), F.floor(F.log(F.col("n").cast("double")) * 50)).otherwise(-1).cast("int")).withColumn("some", F.when(F.col("full"), F.floor(F.col("m") / 4)).otherwise(-1).cast("int"))
    key = ["at", "scale", "fine", "some"]
    cut = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_SHINGLES))
    member = member.join(member.groupBy(*key).agg(cut.alias("cut")), key)
    return member.select("f", "n", "root", "m", F.xxhash64(*key, F.pmod(F.xxhash64("f"), F.col("cut"))).alias("g"))


def _qualifying(matrix: DataFrame) -> DataFrame:
    """(g1, g2, c), g1 <= g2: pairs of groups, a group with itself too, that may hold a link between two components."""
    of = ["g", "a", "z", "lo", "hi", "m"]
    x, y = (matrix.select("token", *[F.col(c).alias(f"{c}{i}") for c in of]) for i in (1, 2))
    met = x.join(y, "token").filter(f"g1 <= g2 and least(a1, a2) <> greatest(z1, z2) and {DEN} * hi1 >= {NUM} * lo2 and {DEN} * hi2 >= {NUM} * lo1")
    met = met.groupBy("g1", "g2", "lo1", "hi1", "m1", "lo2", "hi2", "m2").agg(F.count("*").alias("c"))
    # What _needed less _rest is at least, times DEN (NUM + DEN), where the longer set has `a` and the shorter `b` shingles.
    both = NUM + DEN
    least = lambda a, b: F.lit(NUM * DEN) * (F.col(a) + F.col(b)) - F.lit(NUM * both) * F.col(a) + both
    bound = F.greatest(F.lit(DEN * both), F.least(least("hi1", "lo2"), least("hi2", "lo1")))
    return met.filter(F.least("c", "m1", "m2") * (DEN * both) >= bound).select("g1", "g2", "c")


def _only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose group g is in a pair."""
    return rows.join(pairs.select(F.explode(F.array("g1", "g2")).alias("g")).dropDuplicates(), "g", "left_semi")


def _pairs(pairs: DataFrame, packs: DataFrame, *more: str) -> DataFrame:
    """(g1, g2, one, two, ...): the members of both groups of each pair; `two` is null for a group with itself."""
    same, other = pairs.filter("g1 = g2"), pairs.filter("g1 <> g2")
    same = same.join(packs.toDF("g1", "one"), "g1").select("g1", "g2", "one", F.lit(None).cast(packs.schema["members"].dataType).alias("two"), *more)
    second = packs.join(other.select(F.col("g2").alias("g")).dropDuplicates(), "g", "left_semi").toDF("g2", "two")
    return other.join(packs.toDF("g1", "one"), "g1").join(second, "g2").select("g1", "g2", "one", "two", *more).unionByName(same)


def _whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(f, tokens) of the wanted classes, dealt by f, computed again where a fixed-size filter of ids lets a text through.

    Texts are not shuffled; what the filter lets through wrongly goes in the semi-join.
    """
    wanted = written(wanted.dropDuplicates(), "wanted")
    spot = F.shiftrightunsigned(F.xxhash64(F.coalesce("low", F.lit(NO_ID))), 64 - FILTER_BITS)
    spots = classes.join(wanted, "f", "left_semi").select(spot.alias("s"))
    bits = spots.groupBy(F.expr("bitmap_bucket_number(s + 1)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s + 1))").alias("bits"))
    parts = {r["at"]: np.frombuffer(bytes(r["bits"]), np.uint8) for r in bits.collect()}  # 1 MB at most
    table = np.zeros(1 << FILTER_BITS, dtype=bool)
    for at, x in parts.items():
        table[(at - 1) * 32768 : at * 32768] = np.unpackbits(x, bitorder="little")[:32768]
    table = np.packbits(table)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column("s").to_numpy()
            b = b.filter(pa.array((table[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1))
            if not b.num_rows:
                continue
            f, t = [], []
            for _, u in _sets(b.column("text"), size):
                if len(u):
                    f.append(fingerprint(u))
                    t.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(t, pa.binary())], ["f", "tokens"])

    ids = docs.select(F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))), 64 - FILTER_BITS).alias("s"), "text")
    got = ids.mapInArrow(sets, "f long, tokens binary").join(wanted, "f", "left_semi")
    return got.dropDuplicates(["f"])


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = np.array([_near(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)) for x, y in zip(b.column("x"), b.column("y"), strict=True)], dtype=bool)
        yield pa.RecordBatch.from_arrays([b.column("f").filter(pa.array(keep)), b.column("f2").filter(pa.array(keep))], ["u", "v"])


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of groups with the classes that share enough of what is left to have a link; others go."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for row in range(b.num_rows):
            one, two = b.column("one")[row].as_py(), b.column("two")[row].as_py()
            asks, told = sorted([one, one if two is None else two], key=len)
            ids, roots, n, many = (np.array(x) for x in ([m["f"] for m in told], [m["root"] for m in told], [m["n"] for m in told], [len(m["tokens"]) for m in told]))
            whole, owner = np.array([t for m in told for t in m["tokens"]], np.int64), np.repeat(np.arange(len(told)), many)
            keep: set[int] = set()
            for q in asks:
                x = np.array(q["tokens"], np.int64)
                at = np.minimum(np.searchsorted(x, whole), len(x) - 1)
                both = np.bincount(owner[x[at] == whole], minlength=len(told))
                rest = -(-NUM * np.maximum(n, q["n"]) // DEN) - 1
                near = (both >= np.maximum(1, -(-NUM * (n + q["n"]) // (NUM + DEN)) - rest)) & (roots != q["root"]) & (DEN * np.minimum(n, q["n"]) >= NUM * np.maximum(n, q["n"]))
                if near.any():
                    keep |= {q["f"], *ids[near].tolist()}
            if keep:
                for c, v in zip(out, (b.column("g1")[row].as_py(), b.column("g2")[row].as_py(), b.column("c")[row].as_py(), sorted(keep)), strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["g1", "g2", "c", "f"])


def _open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        u, v = [], []
        for row in range(b.num_rows):
            one, two = b.column("one")[row].as_py(), b.column("two")[row].as_py()
            asks, told = sorted([one, one if two is None else two], key=len)
            ids, roots, size = (np.array(x) for x in ([m["f"] for m in told], [m["root"] for m in told], [len(m["tokens"]) // 8 for m in told]))
            whole, owner = np.frombuffer(b"".join(m["tokens"] for m in told), U64), np.repeat(np.arange(len(told)), size)
            union = np.unique(whole)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for q in asks:
                x = np.frombuffer(q["tokens"], U64)
                at = np.minimum(np.searchsorted(union, x), len(union) - 1)
                if DEN * int((union[at] == x).sum()) < NUM * len(x):
                    continue
                at = np.minimum(np.searchsorted(x, whole), len(x) - 1)
                both = np.bincount(owner[x[at] == whole], minlength=len(told))
                near = ids[(DEN * both >= NUM * (len(x) + size - both)) & (roots != q["root"])]
                found.append((np.full(len(near), q["f"]), near))
            if found:
                ends = np.column_stack([np.concatenate(c) for c in zip(*found, strict=True)])
                known, at = np.unique(ends, return_inverse=True)
                at = at.reshape(ends.shape)
                label = star_labels(len(known), at[:, 0], at[:, 1])
                other = np.flatnonzero(label != np.arange(len(known)))
                u.append(known[label[other]])
                v.append(known[other])
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *u])), pa.array(np.concatenate([none, *v]))], ["u", "v"])


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as a from documents
), s as (
  select distinct doc_id, unnest(case when len(a) = 0 then [] when len(a) < 5 then [array_to_string(a, ' ')]
    else list_transform(generate_series(1, len(a) - 4), lambda i: array_to_string(a[i:i+4], ' ')) end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n + nb.n - c)),
reach as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a, min(b) as m from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id
"""
