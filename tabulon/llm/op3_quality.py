"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Words and word pairs are hashed into BINS bins.  Two multinomials over the bins, smoothed, are
counted: one over all trusted documents, one over the whole raw corpus.  A document's score is the
mean, over its n-grams, of log p_trusted - log p_raw, so length does not count.  The threshold is fixed
by rule from the scores of all trusted documents, each by the multinomial of the thirds of trusted
documents it is not in, as unlabelled clean documents are scored; every document is judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernels import PLACE, SPACE, U64, Texts, mix, slices, windows

BITS = 16
BINS = 1 << BITS
SMOOTH = 1.0
#: Parts that trusted documents fall into, by hash of the id; each is scored by the multinomial of the others.
#: The threshold lies SPREAD standard deviations below the mean of these scores.
HELD_OUT, SPREAD = 3, 6.0
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEAT = 8, 20, 30


def bins_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words and word pairs, and the text of each."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    one = (mix(words + PLACE[12]) >> U64(64 - BITS)).astype(np.int64)
    pair, before = windows(words, first, 2)
    two = (mix(pair + PLACE[13]) >> U64(64 - BITS)).astype(np.int64)
    return np.concatenate([one, two]), np.concatenate([doc, np.repeat(np.arange(n), np.diff(before))])


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive marks."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[first[1:]] - run[first[:-1]]


def base_counts(t: Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; word hashes and marks."""
    start, end, first = t.words()
    words = t.hashes(start, end)
    lead = (t.data & 0xC0) != 0x80  # one byte of each code point
    out = {"n_words": np.diff(first), "word_chars": per_text(lead & ~SPACE[t.data], t.off), "n_symbols": per_text(SYMBOLS[t.data], t.off)}
    ls, le, lines = t.lines()
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    doc = np.repeat(np.arange(t.n), np.diff(lines))[full]
    out["n_dup_lines"] = np.bincount(doc[_later(doc, t.hashes(ls[full], le[full]))], minlength=t.n)
    h, before = windows(words, first, REPEAT_WINDOW)
    wdoc = np.repeat(np.arange(t.n), np.diff(before))
    order = np.lexsort((h, wdoc))
    same = (wdoc[order][1:] == wdoc[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    at = at - before[wdoc[at]] + first[wdoc[at]]
    cover = np.zeros(len(words) + REPEAT_WINDOW + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = per_text((np.cumsum(cover) > 0)[: len(words)], first)
    return out, words, first


def _later(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions whose (doc, h) came before."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    return order[1:][same]


def _parts(b: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    texts = b.column(column)
    for lo, hi in slices(texts):
        yield b.slice(lo, hi - lo), Texts(texts.slice(lo, hi - lo))


class Model:
    """Log ratio of every bin, and the threshold of the verdict."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        bins, doc = bins_of(words, first)
        n = len(first) - 1
        return np.bincount(doc, self.ratio[bins], n) / np.maximum(np.bincount(doc, minlength=n), 1)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Distinct ids of documents labelled good and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).dropDuplicates()


def trusted_ids(labels: DataFrame, most: int | None = None) -> list[int]:
    """Ids of documents labelled good and not toxic, as a list; with `most` that many at most, those of smallest hash."""
    ids = trusted_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id")
    return [r.doc_id for r in (ids if most is None else ids.limit(most)).collect()]


def _ratio(own: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of every bin; 0 where nothing is trusted."""
    if not own.sum():
        return np.zeros(BINS)
    return np.log((own + SMOOTH) / (own.sum() + SMOOTH * BINS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BINS))


def fit(docs: DataFrame, trusted: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", spread: float = SPREAD, labelled: DataFrame | None = None) -> Model:
    """Counts the raw multinomial over all documents and the trusted one over all those of `labelled` (distinct ids; else the list).

    All trusted documents set the threshold, each scored by the multinomial of the parts it is not in.
    Without trusted documents every ratio is 0 and nothing falls below.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(HELD_OUT * BINS, np.int64)
        for b in batches:
            for own, t in _parts(b, "text"):
                start, end, first = t.words()
                bins, doc = bins_of(t.hashes(start, end), first)
                sums += np.bincount(own.column("part").to_numpy()[doc] * BINS + bins, minlength=HELD_OUT * BINS)
        sums = sums.reshape(HELD_OUT, BINS)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, sums[:, some])], names)

    names = ["bin", *(f"n{k}" for k in range(HELD_OUT))]

    def counted(of: DataFrame) -> np.ndarray:
        """Counts of each part's bins."""
        out = np.zeros((HELD_OUT, BINS))
        for r in of.mapInArrow(count, ", ".join(f"{c} long" for c in names)).groupBy("bin").agg(*(F.sum(c) for c in names[1:])).collect():  # BINS rows at most
            out[:, r[0]] = r[1:]
        return out

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)).cast("long"))
    ids = labelled if labelled is not None else spark.createDataFrame([(int(i),) for i in set(trusted or ())], "doc_id long")
    # Labels grow with the documents, so they are joined and not sent to the tasks.
    own = counted(d.join(ids.hint("merge"), "doc_id", "left_semi"))
    raw = counted(d).sum(axis=0)
    if not own.sum():
        return Model(np.zeros(BINS), -np.inf)
    model = Model(_ratio(own.sum(axis=0), raw), -np.inf)
    others = [own.sum(axis=0) - own[k] for k in range(HELD_OUT)]
    scored = np.array([o.sum() > 0 for o in others])  # a part that holds all has no others
    ratios = np.array([_ratio(o, raw) for o in others])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, t in _parts(b, "text"):
                start, end, first = t.words()
                of = some.column("part").to_numpy()
                bins, doc = bins_of(t.hashes(start, end), first)
                n = np.maximum(np.bincount(doc, minlength=t.n), 1)
                x = np.bincount(doc, ratios[of[doc], bins], t.n) / n
                out = pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(x)], ["doc_id", "x"])
                yield out.filter(pa.array((np.diff(first) >= LEAST_WORDS) & scored[of]))

    # Every document is scored where it lies, so that only ids and scores meet the labels.
    s = d.mapInArrow(score, "doc_id long, x double").join(ids.hint("merge"), "doc_id", "left_semi").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    model.threshold = -np.inf if s.m is None else s.m - spread * (s.s or 0.0)
    return model


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with counts, score and verdict.

    A null or empty text has no words and fails the base rules; a null id is kept as it is; repeated
    rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    names = [x.split()[0] for x in JUDGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in _parts(b, "text"):
                c, words, first = base_counts(t)
                score = model.scores(words, first)
                failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEAT * c["n_words"])
                cols = [part.column("doc_id"), *(pa.array(c[k].astype(np.int64)) for k in names[1:6]), pa.array(failed), pa.array(score), pa.array(~failed & (score >= model.threshold))]
                yield pa.RecordBatch.from_arrays(cols, names)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, JUDGED)


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `docs` that pass, columns unchanged; the verdict is taken where the row is, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col)
            for lo, hi in slices(texts):
                c, words, first = base_counts(Texts(texts.slice(lo, hi - lo)))
                failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEAT * c["n_words"])
                yield b.slice(lo, hi - lo).filter(pa.array(~failed & (model.scores(words, first) >= model.threshold)))

    return docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))).mapInArrow(run, docs.schema)


def fit_apart(docs: DataFrame, labels: DataFrame, held: list[int]) -> Model:
    """A model to try the method with, of no query: ids of `held` are not counted as trusted, and they alone set the threshold."""
    model = fit(docs, labelled=trusted_labels(labels).filter(~F.col("doc_id").isin(held)))
    x = judge(docs.filter(F.col("doc_id").isin(held)), model).filter(F.col("n_words") >= LEAST_WORDS)
    s = x.agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s")).first()
    model.threshold = -np.inf if s.m is None else s.m - SPREAD * (s.s or 0.0)
    return model


def model_for(docs: DataFrame, labels: DataFrame) -> Model:
    """The queries' model, of all documents labelled good; only where `trusted_ids` was given a bound as its default, every HELD_OUT-th of its ids is held apart."""
    if trusted_ids.__defaults__[0] is None:
        return fit(docs, labelled=trusted_labels(labels))
    return fit_apart(docs, labels, trusted_ids(labels)[::HELD_OUT])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labelled=trusted_labels(labels)))
