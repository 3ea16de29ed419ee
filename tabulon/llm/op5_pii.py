"""PII in native Spark: pattern spans, and terms that reveal them by co-occurrence.

Base kinds are found by linear-time patterns; positions come from the lengths of matches and of the
gaps between them.  Kind `secret` is added to them: runs of key characters that hold letters and
digits and carry at least SECRET_BITS bits by the entropy of their own characters.  The method then
asks which terms give a protected entity away: with document frequencies over the whole corpus, a
term t discloses an entity e when PMI(t; e) >= ALPHA * IC(e), that is, when seeing t tells nearly all
there is to know about e's presence.  Co-occurrence counts distinct texts that hold both, anywhere in
the text, so copies of a text count once.  No support is asked for: p(e | t) is drawn to p(e) by one
text's weight, and every pair is judged.  Terms over the threshold become spans of kind `term` in the
texts that hold both, and `sanitise` generalises base spans and secrets to their kind and removes the terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash128, written

KINDS = ("email", "ip", "card", "phone")
#: Possessive and anchored where a run starts (or the last match ended), so that scanning is linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": None, "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SECRET, SECRET_GATE, SECRET_BITS = r"(?<![A-Za-z0-9_./@%+-])[A-Za-z0-9_-]{20,}+(?![@%+/]|\.[A-Za-z0-9_@%+.-])", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20}", 64.0
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Running folds go by parts of this many elements, so that a list of many spans is not gone through for each of them.
PART = 128
#: Share of an entity's information that a term must give; weight, in texts, by which p(e | t) is drawn to p(e); code points
#: on each side for callers of `find_pii` who want near terms only (the query takes whole texts).
ALPHA, PRIOR, CONTEXT = 0.8, 1.0, 60
TERM = r"\p{L}{4,}"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits, for up to 19 digits; leading zeros do not count."""
    plain = F.lpad(digits, 19, "0")
    doubled = F.translate(plain, "0123456789", "0246813579")  # the digit sums of doubled digits
    total = sum(F.substring(plain if k % 2 else doubled, k, 1).try_cast("int") for k in range(1, 20))
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(v))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op) -> Column:
    """For each of some ints, `op` folded over those before it, from 0."""
    fold = lambda a: F.aggregate(a, F.lit(0), op)

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(PART))

        def part(sums: Column, b: Column) -> Column:
            ahead = fold(F.slice(sums, F.lit(1), F.floor(b / PART).cast("int")))
            return _let(F.struct(F.slice(v, b + 1, F.lit(PART)).alias("p"), ahead.alias("a")), lambda s: F.transform(s["p"], lambda _, i: op(s["a"], fold(F.slice(s["p"], F.lit(1), i)))))

        sums = F.transform(starts, lambda b: fold(F.slice(v, b + 1, F.lit(PART))))
        return _let(sums, lambda x: F.flatten(F.transform(starts, lambda b: part(x, b))))

    return _let(values, whole)


def _positions(text: Column, kind: str, pattern: str) -> Column:
    """Spans of all matches, from the lengths of the matches and of the gaps before them."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("gap"))

    def spans(z: Column) -> Column:
        before = _running(F.transform(z, lambda s: F.length(s["gap"]) + F.coalesce(F.length(s["v"]), F.lit(0))), lambda a, x: a + x)

        def span(ahead: Column, s: Column, i: Column) -> Column:
            start = F.get(ahead, i) + F.length(s["gap"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(s["v"])).alias("end"), s["v"].alias("value"))

        return _let(before, lambda ahead: F.transform(z, lambda s, i: span(ahead, s, i)))

    return F.filter(_let(pieces, spans), lambda s: s["value"].isNotNull())


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value>> of the valid matches of a base kind, in order."""
    gate = F.contains(text, F.lit("@")) if GATES[kind] is None else text.rlike(GATES[kind])
    return F.when(gate, F.filter(_positions(text, kind, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def _bits(v: Column) -> Column:
    """Length times the entropy of the characters of a string, in bits: sum of n log2(length / n) over its characters."""

    def whole(chars: Column) -> Column:
        each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)).cast("double"))
        return F.aggregate(each, F.lit(0.0), lambda a, k: a + k * F.log2(F.size(chars) / k))

    return _let(F.split(v, ""), whole)


def secrets_of(text: Column) -> Column:
    """Spans of kind `secret`. None touches an e-mail: neither of the two can go on where the other stands."""
    sound = lambda v: (F.regexp_count(v, F.lit("[0-9]")) >= 4) & (F.regexp_count(v, F.lit("[A-Za-z]")) >= 4) & (_bits(v) >= SECRET_BITS)
    return F.when(text.rlike(SECRET_GATE), F.filter(_positions(text, "secret", SECRET), lambda s: sound(s["value"]))).otherwise(F.array().cast(SPAN))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_pieces(rows: DataFrame, text: str, spans: Column) -> DataFrame:
    """Adds `pieces`, array<struct<start, piece, kind>>: the text before each span and after the last, with the span's kind.

    A span that starts inside another gives an empty piece and no kind.  The text is held in chunks of
    equal length, so that cutting a piece costs its own length and not that of the text before it.
    """
    size, whole = 4096, F.length(text)

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / size).cast("int"), F.floor(b / size).cast("int")
        one = F.substring(F.get(chunks, i), a % size + 1, b - a)
        many = F.concat(F.substring(F.get(chunks, i), a % size + 1, F.lit(size)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), F.coalesce(F.substring(F.get(chunks, j), F.lit(1), b % size), F.lit("")))
        return F.when(a >= b, F.lit("")).when(i == j, one).otherwise(many)

    def cut(chunks: Column, s: Column, at: Column) -> Column:
        return F.struct(at.alias("start"), piece(chunks, at, s["start"]).alias("piece"), F.when(s["start"] >= at, s["kind"]).alias("kind"))

    def cuts(order: Column) -> Column:
        both = F.struct(_running(order["end"], lambda a, x: F.greatest(a, x)).alias("ahead"), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("chunks"))
        return _let(both, lambda x: F.transform(order, lambda s, i: cut(x["chunks"], s, F.get(x["ahead"], i))))

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    last = F.array(F.struct(whole.alias("start"), whole.alias("end"), F.lit(None).cast("string").alias("kind")))
    return rows.withColumn("pieces", _let(F.concat(order, last), cuts))


def _term(w: Column) -> Column:
    return F.xxhash64(F.lower(w))


def _terms(text: Column) -> Column:
    """array<bigint>: hashes of the distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), _term))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, context: int | None = CONTEXT) -> DataFrame:
    """One row per document: doc_id, text (of documents with spans, else null), base, secrets, terms.

    `base`, `secrets` and `terms` are arrays of (kind, start, end, value), code points, end exclusive.  A
    null text has no spans; a null id is kept; repeated rows are treated each for itself; an empty table
    gives no rows; other columns are ignored.  Terms never overlap other spans.  With `context` a term
    must lie within so many code points of an entity to occur with it; with None anywhere in the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2 = hash128(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"))
    rows = rows.select("doc_id", "text", "h1", "h2", *[spans_of(F.col("text"), k).alias(k) for k in KINDS], secrets_of(F.col("text")).alias("secrets"))
    rows = rows.select("doc_id", "text", "h1", "h2", F.concat(*KINDS).alias("base"), "secrets")
    # Texts are kept only where something was found.
    rows = written(rows.select("doc_id", "h1", "h2", "base", "secrets", F.when(F.size("base") + F.size("secrets") > 0, F.col("text")).alias("text")), "base")
    some = with_pieces(rows.filter("text is not null").drop("doc_id").dropDuplicates(["h1", "h2"]), "text", F.concat("base", "secrets"))
    some = some.withColumn("t", _terms(F.array_join("pieces.piece", " ")))
    some = written(some.select("h1", "h2", "text", "t", F.concat("base", "secrets").alias("base"), F.transform("pieces", lambda p: F.struct(p["start"].alias("start"), p["piece"].alias("piece"))).alias("pieces")), "some")

    # Document frequencies over the distinct texts, as co-occurrence is counted.
    plain = docs.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")).dropDuplicates(["h1", "h2"]).join(some.select("h1", "h2"), ["h1", "h2"], "left_anti")
    words = plain.select(F.explode(_terms(F.col("text"))).alias("term")).unionByName(some.select(F.explode("t").alias("term")))
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    n = max(1, rows.select("h1", "h2").distinct().count())
    p = F.col("ne") / F.lit(float(n))
    least = F.pow(p, F.lit(1.0 - alpha))  # p(e | t) from which on PMI >= alpha * IC

    def given(co: Column) -> Column:
        return (co + PRIOR * p) / (F.col("df") + PRIOR)

    if context is None:
        # Entities held by the same texts have the same verdicts: their group is known by the xor of the texts' hashes.
        held = some.select("h1", "h2", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
        groups = held.groupBy("entity").agg(F.count("*").alias("ne"), F.bit_xor("h1").alias("g1"), F.bit_xor("h2").alias("g2"))
        held = held.join(groups, "entity").select("h1", "h2", "ne", "g1", "g2").dropDuplicates()
        pairs = held.join(some.select("h1", "h2", F.explode("t").alias("term")).join(df, "term"), ["h1", "h2"])
    else:
        each = some.select("h1", "h2", "text", "t", F.explode("base").alias("s")).select(
            "h1",
            "h2",
            "t",
            F.lower("s.value").alias("entity"),
            F.concat(F.substring(F.col("text"), F.greatest(F.col("s.start") - context + 1, F.lit(1)), F.least(F.col("s.start"), F.lit(context))), F.lit(" "), F.substring(F.col("text"), F.col("s.end") + 1, F.lit(context))).alias("near"),
        )
        groups = each.groupBy("entity").agg(F.count_distinct("h1", "h2").alias("ne"))
        g1, g2 = hash128(F.col("entity"))
        near = each.select("h1", "h2", "entity", F.explode(F.array_intersect(_terms(F.regexp_replace("near", r"\S*@\S*", " ")), "t")).alias("term")).dropDuplicates()
        pairs = near.join(groups, "entity").join(df, "term").withColumns({"g1": g1, "g2": g2})
    # A pair that could not tell if all texts of the rarer side had both need not be counted.
    able = (F.col("ne") < n) & (given(F.least("df", "ne")) >= least)
    pairs = written(pairs.filter(able).select("h1", "h2", "ne", "g1", "g2", "term", "df"), "pairs")
    key = ["ne", "g1", "g2", "term"]
    telling = pairs.groupBy(*key, "df").agg(F.count("*").alias("co")).filter(given(F.col("co")) >= least).select(*key)

    # The words of the texts with their places, where they tell: nearly all of these texts have some, so none is left out before.
    flagged = pairs.join(telling, key).select("h1", "h2", "term").dropDuplicates()
    hit = some.select("h1", "h2", F.explode("pieces").alias("p"))
    hit = hit.select("h1", "h2", "p.start", F.explode(_positions(F.col("p.piece"), "term", TERM)).alias("s"))
    hit = hit.select("h1", "h2", _term(F.col("s.value")).alias("term"), F.struct((F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.end")).alias("end"), F.col("s.value").alias("w")).alias("s"))
    terms = hit.join(flagged, ["h1", "h2", "term"], "left_semi").groupBy("h1", "h2").agg(F.sort_array(F.collect_list("s")).alias("t"))
    terms = terms.select("h1", "h2", F.transform("t", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["w"].alias("value"))).alias("terms"))
    none = F.array().cast(SPAN)
    # The verdict goes to all copies; documents without spans need no join.
    found = rows.filter("text is not null").join(terms, ["h1", "h2"], "left").select("doc_id", "text", "base", "secrets", F.coalesce("terms", none).alias("terms"))
    return found.unionByName(rows.filter("text is null").select("doc_id", "text", "base", "secrets", none.alias("terms")))


def sanitise(found: DataFrame) -> DataFrame:
    """Adds clean_text to rows of `find_pii`: base spans and secrets become [KIND], telling terms go; null where there is nothing to change."""
    cut = with_pieces(found, "text", F.concat("base", "secrets", "terms"))
    mark = lambda kind: F.when(kind.isNull() | (kind == "term"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))
    clean = F.array_join(F.transform("pieces", lambda p: F.concat(p["piece"], mark(p["kind"]))), "")
    return cut.withColumn("clean_text", F.when(F.size("pieces") > 1, clean)).drop("pieces")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More columns follow the contract's: n_secret, n_term, and flagged (whether the document has any span)."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), context=None)
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.concat("base", "secrets", "terms")
    more = [F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"), (F.size(spans) > 0).alias("flagged")]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(spans).alias("spans"), *more)
