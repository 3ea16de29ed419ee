"""Best-fit packing by non-negative least squares over length patterns.

Documents become token pieces of at most `room` tokens.  Only the histogram of piece lengths, at most
`room` numbers, reaches the driver.  There, patterns of few lengths that fill a sequence are
enumerated on a grid, and their repeat counts are fitted to the histogram by non-negative least
squares and rounded down.  A pattern's slots take real lengths from their cells, the last one the
best fit to the room left; residual pieces are packed best-fit, longest first.  All of it works on
runs of equal sequences, so the plan's length depends on `room` and not on the number of documents.
Pieces are then numbered within their length and look their sequence and offset up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .textkernels import U64, Texts, same_bytes, slices

ROOM, CELL, MOST_IN_PATTERN = 2048, 64, 3
#: Words whose tokens and bytes a worker remembers, at most, and those it holds aside before they are sorted in.
REMEMBERED, ASIDE = 1_500_000, 60_000
#: Stands between words that are tokenized together; it is a token of its own.
MARK = "\x01"
CHUNK = 4096


class Words:
    """Token ids of texts, word by word.

    Words are split at U+0009..U+000D and space.  The tokenizer's own splitting never joins characters
    across white space, so the ids of a text are those of its words, and each word is tokenized once.
    Words are looked up by 64-bit hashes, and the bytes found are compared with the bytes asked for.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.kept, self.kept_used = np.zeros(1 << 20, np.uint8), 0
        self.blocks = np.ndarray(len(self.kept) - 7, dtype="<u8", buffer=self.kept.data, strides=(1,))
        # (sorted hashes, starts, sizes, places and lengths of the bytes): the main table and a small one of new words.
        none = (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4)))
        self.main, self.new = none, none

    def _ids(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; many words go in one text with marks between them."""
        texts = [w.decode() for w in words]
        alone = len(self.mark) != 1 or any(MARK in t for t in texts)
        if alone:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        sep = f" {MARK} "
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            ids = np.array(self.tok.encode_batch_fast([sep.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(cuts) != len(part) - 1:  # a word gave the mark's token
                out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
                continue
            start = np.concatenate([[0], cuts + 1])
            end = np.concatenate([cuts, [len(ids)]])
            out += [ids[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return out

    def learn(self, h: np.ndarray, words: list[bytes]) -> None:
        """h: sorted hashes of the new words."""
        got = self._ids(words)
        size, length = np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(map(len, words), np.int64, len(words))
        total, raw = int(size.sum()), np.frombuffer(b"".join(words), np.uint8)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        while self.kept_used + len(raw) > len(self.kept) - 8:
            self.kept = np.concatenate([self.kept, np.zeros(len(self.kept), np.uint8)])
        start, place = self.used + np.cumsum(size) - size, self.kept_used + np.cumsum(length) - length
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(got)
        self.kept[self.kept_used : self.kept_used + len(raw)] = raw
        self.used, self.kept_used = self.used + total, self.kept_used + len(raw)
        self.blocks = np.ndarray(len(self.kept) - 7, dtype="<u8", buffer=self.kept.data, strides=(1,))
        self.new = self._merged(self.new, (h, start, size, place, length))
        if len(self.new[0]) > ASIDE:
            self.main = self._merged(self.main, self.new)
            self.new = tuple(x[:0] for x in self.new)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size, place, length) of sorted hashes as columns, and which are known."""
        found, known = np.zeros((4, len(h)), np.int64), np.zeros(len(h), dtype=bool)
        for keys, *cols in (self.main, self.new):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                for row, c in zip(found, cols, strict=True):
                    row[hit] = c[at[hit]]
                known |= hit
        return found, known

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with a closing 0, and the marks between texts."""
        lo, hi, first = texts.words()
        h, at, inverse = np.unique(texts.hashes(lo, hi), return_index=True, return_inverse=True)
        found, known = self._find(h)
        if not known.all():
            if len(self.main[0]) + len(self.new[0]) + len(h) > REMEMBERED:
                self.clear()
                known[:] = False
            raw = texts.data.tobytes()
            at = at[~known]
            self.learn(h[~known], [raw[a:b] for a, b in zip(lo[at].tolist(), hi[at].tolist(), strict=True)])
            found, known = self._find(h)
        start, size, place, length = found[:, inverse]
        sound = length == hi - lo
        sound[sound] = same_bytes(self.blocks, place[sound], texts.blocks, lo[sound], length[sound])
        flat = self.flat
        if not sound.all():  # words whose hash another word holds: tokenized anew
            raw, wrong = texts.data.tobytes(), np.flatnonzero(~sound)
            got = self._ids([raw[a:b] for a, b in zip(lo[wrong].tolist(), hi[wrong].tolist(), strict=True)])
            size[wrong] = list(map(len, got))
            start[wrong] = self.used + np.cumsum(size[wrong]) - size[wrong]
            flat = np.concatenate([flat[: self.used], *got])
        # Each text's words, then room for its 0.
        before = np.cumsum(size) - size
        run = np.concatenate([[0], np.cumsum(size)])[first]
        marks = run + np.arange(len(first))
        total = int(size.sum())
        out = np.zeros(total + texts.n, np.uint32)
        doc = np.repeat(np.arange(texts.n), np.diff(run))
        out[np.arange(total) + doc] = flat[np.arange(total) + np.repeat(start - before, size)]
        return out, marks


_words: dict[str, Words] = {}


def tokenizer(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, room: int = ROOM, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    if room < 1:
        raise ValueError("room must be positive")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    names = [f[0] for f in fields] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        for b in batches:
            texts = b.column(1).fill_null("")
            for lo, hi in slices(texts):
                ids, marks = words.encode(Texts(texts.slice(lo, hi - lo)))
                raw = ids.astype("<u4").tobytes()
                docs_, out, held = b.column(0).slice(lo, hi - lo).to_pylist(), ([], [], [], [], []), []
                for d, a, z in zip(docs_, marks[:-1].tolist(), marks[1:].tolist(), strict=True):
                    for k, s in enumerate(range(a, z, room)):
                        e = min(s + room, z)
                        for c, v in zip(out, (d, k, s - a, e - s, zlib.crc32(raw[4 * s : 4 * e])), strict=True):
                            c.append(v)
                        if with_ids:
                            held.append(ids[s:e].astype(np.int32))
                cols = [pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)]
                if with_ids:
                    cols.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def patterns(cells: int, most: int = MOST_IN_PATTERN) -> list[tuple[int, ...]]:
    """Non-increasing tuples of at most `most` cell numbers (1..cells) that sum to `cells`."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < most:
            top = min(left, head[-1] if head else left)
            for c in range(top, (left - 1) // (most - len(head)), -1):
                grow((*head, c), left - c)

    grow((), cells)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Non-negative least squares by the active-set method; stops after `rounds` at the best point so far."""
    m, n = a.shape
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    gram, right = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        w = right - gram @ x
        w[active] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= tol or active.sum() >= m:
            break
        active[k] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(on, on)], right[on], rcond=None)[0]
            bad = s <= 1e-12
            if not bad.any():
                x[:] = 0
                x[on] = s
                break
            step = np.where(bad, x[on] / np.maximum(x[on] - s, 1e-300), np.inf)
            t = min(1.0, float(step.min()))
            x[on] += t * (s - x[on])
            active[on[bad & (step <= t + 1e-15)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_sequences(hist: dict[int, int], room: int = ROOM, cell: int = CELL) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences), for piece lengths counted in `hist`."""
    left = {n: c for n, c in hist.items() if c > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if room in left:
        out.append(((room,), left.pop(room)))
    have = sorted(left)  # lengths with pieces left

    def best(limit: int, taken: list[int]) -> int | None:
        """The longest length of at most `limit` that has a piece beyond those taken."""
        i = bisect_left(have, limit + 1)
        while i and left[have[i - 1]] <= taken.count(have[i - 1]):
            i -= 1
        return have[i - 1] if i else None

    def take(n: int, count: int) -> None:
        left[n] -= count
        if not left[n]:
            del left[n]
            have.remove(n)

    def fits(lengths: list[int], count: int) -> int:
        return min([count, *(left[n] // lengths.count(n) for n in set(lengths))])

    cells = room // cell
    if cells > 1 and have:
        forms = [p for p in patterns(cells) if len(p) > 1]
        a = np.zeros((cells, len(forms)))
        for j, p in enumerate(forms):
            for c in p:
                a[c - 1, j] += 1
        b = np.zeros(cells)
        for n, c in left.items():
            b[min(cells, -(-n // cell)) - 1] += c
        x = np.floor(nnls(a, b) + 1e-9).astype(np.int64)
        for j in sorted(range(len(forms)), key=lambda k: forms[k], reverse=True):  # the longest pieces first, so that short ones are left to fill
            todo = int(x[j])
            while todo > 0:
                lengths: list[int] = []
                for c in forms[j][:-1]:  # the longest piece of the cell that is there
                    spare = [n for n in have[bisect_left(have, (c - 1) * cell + 1) : bisect_left(have, c * cell + 1)] if left[n] > lengths.count(n)]
                    if not spare or sum(lengths) + spare[-1] > room:
                        break
                    lengths.append(spare[-1])
                if len(lengths) < len(forms[j]) - 1:
                    break
                while last := best(room - sum(lengths), lengths):
                    lengths.append(last)
                k = fits(lengths, todo)
                if not k:
                    break
                out.append((tuple(lengths), k))
                for n in set(lengths):
                    take(n, k * lengths.count(n))
                todo -= k
    # Residual pieces, longest first, each filled by best fits.
    while have:
        lengths, space = [], room
        used: dict[int, int] = {}
        i = len(have)
        while i:
            n = have[i - 1]
            if n > space:
                i = bisect_left(have, space + 1)
                continue
            if left[n] <= used.get(n, 0):
                i -= 1
                continue
            lengths.append(n)
            used[n] = used.get(n, 0) + 1
            space -= n
        k = min(left[n] // c for n, c in used.items())
        out.append((tuple(lengths), k))
        for n, c in used.items():
            take(n, k * c)
    return out


def pack_pieces(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """`pieces` (doc_id, piece, length, ...) with sequence_id and offset; the table must be a written one.

    Pieces of one length are interchangeable.  They are numbered in chunks of about CHUNK, by hash of the
    document, so a length that a third of all pieces share is spread over many tasks.
    """
    hist = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `room` rows
    plan = plan_sequences(hist, room)
    # For each length, runs of consecutive pieces: (first rank, first sequence, offset).
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    seq = 0
    for lengths, count in plan:
        at = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), seq, at))
            used[n] = used.get(n, 0) + count
            at += n
        seq += count
    tables = {n: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for n, v in runs.items()}
    chunk = pieces.select("length").groupBy("length").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    # At most `room` rows.
    p = pieces.join(F.broadcast(chunk), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.col("chunks")))
    sums = p.groupBy("length", "chunk").agg(F.count("*").alias("m"))
    sums = sums.select("length", "chunk", F.coalesce(F.sum("m").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    p = p.join(sums, ["length", "chunk"]).withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")) - 1)
    own = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s, o = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for k in np.unique(n):
                mine = n == k
                first, seqs, at = tables[int(k)]
                i = np.searchsorted(first, r[mine], side="right") - 1
                s[mine], o[mine] = seqs[i] + r[mine] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(s), pa.array(o)], [*own, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    # Shuffle partitions of a few rows go together: a task and a file for each CHUNK rows or so.
    return p.select(*own, "rank").coalesce(max(1, -(-sum(hist.values()) // CHUNK))).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = ROOM, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's tokens and a closing 0, packed into sequences of at most `room` tokens.

    A null or empty text is the closing 0 alone; only documents longer than `room` are cut; a null id
    and repeated rows are packed like others; an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(written(token_pieces(docs, tokenizer_path, room, with_ids, id_col, text_col), "pieces"), room)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
