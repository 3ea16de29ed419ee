"""Text analytics on document tables: tokens, bags of words and n-grams, encodings, similarity, sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.elementwise import NAN

#: A small English stop-word list.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "we", "were", "which", "will", "with", "you"]
#: Sentiment strengths of a small demonstration lexicon; callers pass their own.
LEXICON = {"good": 1.9, "great": 3.1, "best": 3.2, "happy": 2.7, "love": 3.2, "nice": 1.8, "bad": -2.5, "worst": -3.1, "sad": -2.1, "hate": -2.7, "terrible": -2.1, "awful": -2.0}
BOOSTERS = {"very": 1, "extremely": 1, "really": 1, "so": 1, "absolutely": 1, "slightly": -1, "somewhat": -1, "barely": -1, "hardly": -1}
NEGATIONS = ["not", "no", "never", "none", "nothing", "without", "neither", "nor", "cannot"]


def tokens(text, pattern: str = r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*") -> Column:
    return F.regexp_extract_all(text if isinstance(text, Column) else F.col(text), F.lit(pattern), F.lit(0))


def words(df: DataFrame, key: str, text: str, lower: bool = True) -> DataFrame:
    """(key, place, word): the token table of a document table."""
    t = F.coalesce(F.lower(text) if lower else F.col(text), F.lit(""))
    return df.select(key, F.posexplode(tokens(t)).alias("place", "word"))


def bag_of_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse counts (key, word, count)."""
    return words(df, key, text).groupBy(key, "word").agg(F.count("*").alias("count"))


def bag_of_ngrams(df: DataFrame, key: str, text: str, n: int = 2) -> DataFrame:
    """Sparse counts of n-grams, words joined by a space; grams are cut from the array of a row, without a window."""
    t = tokens(F.lower(F.coalesce(text, F.lit(""))))
    grams = F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return df.select(key, t.alias("t")).select(key, F.explode(grams).alias("ngram")).groupBy(key, "ngram").agg(F.count("*").alias("count"))


def vocabulary(df: DataFrame, key: str, text: str) -> DataFrame:
    """(word, index, count): 1-based places by first appearance over (key, place)."""
    from tabulon.operators.table import number_rows

    v = words(df, key, text).groupBy("word").agg(F.min(F.struct(key, "place")).alias("at"), F.count("*").alias("count"))
    return number_rows(v.select("word", "count", F.col(f"at.{key}").alias("__k"), F.col("at.place").alias("__l")), ["__k", "__l"], "index").select("word", "index", "count")


def word2ind(df: DataFrame, word: str, vocab: DataFrame) -> DataFrame:
    """Adds the index of a word; NaN if unknown."""
    v = vocab.select(F.col("word").alias("__w"), F.col("index").cast("double").alias("__i"))
    return df.join(v, F.col(word) == F.col("__w"), "left").withColumn("index", F.coalesce("__i", F.lit(NAN))).drop("__w", "__i")


def ind2word(df: DataFrame, index: str, vocab: DataFrame) -> DataFrame:
    return df.join(vocab.select(F.col("index").alias(index), "word"), index, "left")


def is_vocabulary_word(df: DataFrame, word: str, vocab: DataFrame) -> DataFrame:
    return word2ind(df, word, vocab).withColumn("known", ~F.isnan("index")).drop("index")


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """Sparse counts over a fixed vocabulary (key, index, count)."""
    return bag_of_words(df, key, text).join(vocab.select("word", "index"), "word").select(key, "index", "count")


def remove_words(df: DataFrame, word: str = "word", stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    return df.filter(~F.col(word).isin(list(stop)))


def topkwords(bag: DataFrame, k: int = 10) -> DataFrame:
    return bag.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(k)


def tfidf(bag: DataFrame, key: str, documents: int, term: str = "word") -> DataFrame:
    """Adds weight = count * ln(N / df); the term counts partial-aggregate before their join."""
    df = bag.groupBy(term).agg(F.count("*").alias("df"))
    return bag.join(df, term).withColumn("weight", F.col("count") * F.ln(F.lit(float(documents)) / F.col("df")))


def cosine_similarity(a: DataFrame, b: DataFrame, key: str, term: str = "word") -> DataFrame:
    """Cosine of every pair of rows of two weighted bags that share a term with a weight (others are 0)."""
    norm = lambda d: d.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    x = a.filter("weight <> 0").select(F.col(key).alias("a"), term, F.col("weight").alias("wa"))
    y = b.filter("weight <> 0").select(F.col(key).alias("b"), term, F.col("weight").alias("wb"))
    s = x.join(y, term).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("s"))
    s = s.join(norm(a).select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(norm(b).select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return s.select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("cosine"))


def sentiment(df: DataFrame, key: str, text: str, lexicon: dict[str, float] = LEXICON) -> DataFrame:
    """(key, compound, positive, negative, neutral) from a strength lexicon.

    Up to three tokens back, boosters and dampeners add 0.293 * 0.95^(d-1) toward or against the sign and
    a negation multiplies by -0.74; capitals in a mixed-case text add 0.733; ! adds 0.292 each (4 at
    most), ? adds 0.18 each for 2 or 3 and 0.96 beyond.  Lexicon and lists are arguments, so literals.
    """
    t = F.coalesce(text, F.lit(""))
    base = df.select(F.col(key), t.alias("t"), tokens(t).alias("w"))
    base = base.withColumn("l", F.transform("w", lambda x: F.lower(x)))
    lex = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), F.lit(float(v)))])
    boost = F.create_map(*[x for k, v in BOOSTERS.items() for x in (F.lit(k), F.lit(0.293 * v))])
    caps = F.transform("w", lambda x: (x == F.upper(x)) & (x != F.lower(x)))
    base = base.withColumn("caps", caps)
    mixed = F.exists("caps", lambda c: c) & F.exists("caps", lambda c: ~c)
    l = F.col("l")  # noqa: E741

    def strength(w: Column, i: Column) -> Column:
        v = F.coalesce(lex[w], F.lit(0.0))
        sign = F.signum(v)
        v = v + F.when(mixed & F.get("caps", i), sign * 0.733).otherwise(0.0)
        for d in (1, 2, 3):
            v = v + sign * F.coalesce(boost[F.get(l, i - d)], F.lit(0.0)) * 0.95 ** (d - 1)
        for d in (1, 2, 3):
            prev = F.get(l, i - d)
            v = F.when(F.coalesce(prev.isin(NEGATIONS) | prev.endswith("n't"), F.lit(False)), v * -0.74).otherwise(v)
        return F.when(sign == 0, 0.0).otherwise(v)

    base = base.withColumn("s", F.transform("l", strength))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    bangs, asks = F.least(F.size(F.split("t", "!", -1)) - 1, F.lit(4)), F.size(F.split("t", r"\?", -1)) - 1
    punct = bangs * 0.292 + F.when(asks < 2, 0.0).when(asks <= 3, asks * 0.18).otherwise(0.96)
    base = base.withColumn("sum", total).withColumn("sum", F.col("sum") + F.signum("sum") * punct)
    part = lambda f: F.aggregate(F.filter("s", f), F.lit(0.0), lambda a, x: a + F.abs(x) + 1)
    base = base.withColumn("p", part(lambda x: x > 0)).withColumn("n", part(lambda x: x < 0)).withColumn("z", F.size(F.filter("s", lambda x: x == 0)).cast("double"))
    all_ = F.col("p") + F.col("n") + F.col("z")
    share = lambda c: F.when(all_ > 0, F.col(c) / F.nullif(all_, F.lit(0.0))).otherwise(0.0)
    return base.select(key, (F.col("sum") / F.sqrt(F.col("sum") * F.col("sum") + 15)).alias("compound"), share("p").alias("positive"), share("n").alias("negative"), share("z").alias("neutral"))


def html_text(html) -> Column:
    """Text of HTML: scripts, styles, comments and tags gone, a few entities resolved, white space squeezed."""
    h = html if isinstance(html, Column) else F.col(html)
    t = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def entity_details(token) -> Column:
    """A rule-based tag for a token: email, url, number, or other."""
    t = token if isinstance(token, Column) else F.col(token)
    return F.when(t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email-address").when(t.rlike(r"^(?i)https?://"), "web-address").when(t.rlike(r"^[0-9][0-9.,]*$"), "number").otherwise("non-entity")


def normalize_words(word) -> Column:
    """A light suffix-stripping stem for English plurals, -ing and -ed."""
    w = F.lower(word if isinstance(word, Column) else F.col(word))
    w = F.regexp_replace(w, "(ss|i)es$", "$1")
    w = F.regexp_replace(w, "([^s])s$", "$1")
    w = F.when(w.rlike("[aeiouy].*ed$"), F.regexp_replace(w, "ed$", "")).otherwise(w)
    return F.when(w.rlike("[aeiouy].*ing$"), F.regexp_replace(w, "ing$", "")).otherwise(w)


def part_of_speech(word) -> Column:
    """A rule-based coarse tag."""
    w = F.lower(word if isinstance(word, Column) else F.col(word))
    return F.when(w.rlike("^[0-9]"), "numeral").when(w.isin("the", "a", "an", "this", "that"), "determiner").when(w.isin("and", "or", "but"), "conjunction").when(w.isin("of", "in", "on", "at", "to", "for", "with", "by", "from"), "preposition").when(w.rlike("ly$"), "adverb").when(w.rlike("(ing|ed)$"), "verb").otherwise("noun")


def first_appearance(df: DataFrame, key: str, text: str) -> DataFrame:
    w = words(df, key, text)
    return w.withColumn("n", F.row_number().over(Window.partitionBy(key, "word").orderBy("place"))).filter("n = 1").drop("n")
