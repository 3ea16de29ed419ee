"""Every operator against a plain Python version on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import op1_embedding_dedup as op1
from tabulon.llm import op2_line_dedup as op2
from tabulon.llm import op3_quality as op3
from tabulon.llm import op4_mixing as op4
from tabulon.llm import op5_pii as op5
from tabulon.llm import op6_packing as op6
from tabulon.llm import op7_sharding as op7
from tabulon.llm import op8_jaccard_join as op8
from tabulon.llm import op9_warc as op9
from tabulon.llm import op10_url_filters as op10
from tabulon.llm import components as components_module
from tabulon.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, h long, n long, d long"


def table(spark, rows, schema=SCHEMA):
    """Rows as (id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], schema)


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["alpha", "Beta", "gämma", "delta9", "eps#", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mü", "nu", "xi"] + [f"w{i}" for i in range(80)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 12, 30, 80, 200]))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words)
        rows.append((i, text, rng.choice(["a", "b", "c", None])))
    for i in range(n, n + 20):  # copies, near copies and shared lines
        base = rows[rng.randrange(n)][1]
        words = base.split(" ")
        if len(words) > 20 and i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "a"))
    long = " ".join(rng.choice(vocab) for _ in range(6000))
    shared = "A line that many documents share  "
    rows += [(900, None, None), (901, "", "b"), (902, long, "c"), (903, shared + "\nown line of the third", "a"), (904, " " + shared.lower() + "\n\nshort\nshort", "a"), (905, "same words here " * 40, "b"), (906, "\n", "b"), (907, shared, None)]
    return rows


def words_of(t):
    return WORD.findall(t or "")


# 1 -------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((25, 16))
    vecs = [list(map(float, v)) for v in base]
    for k in range(40):
        vecs.append(list(map(float, base[k % 6] + rng.standard_normal(16) * 0.12)))
    vecs += [vecs[0], vecs[0], [2 * x for x in vecs[1]], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e300] * 16, [1e-300] * 16]
    df = spark.createDataFrame([(i, v, 7) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, cls int")
    got = {r.vec_id: r for r in op1.near_duplicates(df).collect()}
    ok = [i for i, v in enumerate(vecs) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(vecs[i]) / np.abs(vecs[i]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: {j for j in ok if j != i and len(vecs[i]) == len(vecs[j]) and unit[i] @ unit[j] >= 0.95} for i in ok}
    assert len(got) == len(vecs)
    comp = components({i: links.get(i, set()) for i in range(len(vecs))})
    for i in range(len(vecs)):
        assert got[i].n_links == len(links.get(i, ())), i
        assert got[i].component_id == comp[i]
        assert got[i].kept == (i == comp[i])


def test_embedding_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(16) + rng.standard_normal((150, 16)) * 0.05
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(op1, "BLOCK", 16)
    got = {r.vec_id: r for r in op1.near_duplicates(df).collect()}
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n = (u @ u.T >= 0.95).sum(1) - 1
    assert [got[i].n_links for i in range(150)] == n.tolist()


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op1.near_duplicates(df).collect() == []


def test_embedding_shape():
    assert op1.shape(0) == op1.shape(10_000) == (op1.TABLES, op1.PROJECTIONS)
    near, far = op1.collision(op1.THRESHOLD), op1.collision(0.0)
    for n in (20_000, 10**6, 10**9):
        tables, k = op1.shape(n)
        assert 1 - (1 - near**k) ** tables >= 0.985  # links of the least cosine that are found
        assert n * far**k <= 2 * 10_000 * far**op1.PROJECTIONS  # unrelated vectors met in one table



def components(links: dict) -> dict:
    root = {}
    for i in sorted(links):
        if i in root:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return root


@pytest.mark.parametrize("task", [1_000_000, 40])
def test_connected_components(spark, monkeypatch, task):
    monkeypatch.setattr(components_module, "EDGES_A_TASK", task)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(150)] + [(800, 800), (1, 1), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = {r.id: r.root for r in connected_components(df).collect()}
    links: dict = {}
    for a, b in edges:
        if a is not None:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    assert got == components(links)
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


# 2 -------------------------------------------------------------------------------------------------


def line_dedup(rows):
    first: dict = {}
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x).strip(" \t\n\x0b\x0c\r")
    big = (1 << 63) - 1
    key_id = lambda i: big if i is None else i
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(low(x)) >= 10:
                first[low(x)] = min(first.get(low(x), big), key_id(i))
    out = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(low(x)) >= 10 and key_id(i) > first[low(x)])]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("hot", [0.002, 0.0])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(op2, "HOT_SHARE", hot)
    monkeypatch.setattr(op2, "HOT_ONE_IN", 1)
    rows = corpus() + [(950 + i, "A hot line of this corpus\nanother line\nA HOT LINE of this corpus " + "x" * i, "a") for i in range(30)]
    rows += [(903, rows[-1][1], "a"), (None, "A hot line of this corpus\nheld by none else, null id", None), (None, "held by none else, null id", None)]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in op2.dedup_lines(table(spark, rows)).collect())
    assert got == line_dedup(rows)
    assert op2.dedup_lines(table(spark, rows).limit(0)).collect() == []
    clash = table(spark, rows).withColumn("n_lines", F.lit("x")).withColumn("dropped", F.lit("y"))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in op2.dedup_lines(clash).collect()) == got
    assert op2.apply_bitmaps(clash, op2.keep_bitmaps(clash), counts=False).columns == clash.columns


# 3 -------------------------------------------------------------------------------------------------


def base_counts(t):
    w = words_of(t)
    lines = (t or "").split("\n")
    seen, dup = set(), 0
    for x in lines:
        if words_of(x):
            dup += x in seen
            seen.add(x)
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = set()
    for i in range(len(w) - 7):
        if win[tuple(w[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)


def test_quality_counts(spark):
    rows = corpus() + [(910, "a b # $\n a b # $\na b # $\na b # $\n\n \n \n", "a"), (911, "one two three four five six seven eight nine " * 3 + "x y z " * 20, "b"), (911, "repeated id", "b")]
    model = op3.fit(table(spark, rows), [])
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in op3.judge(table(spark, rows), model).collect())
    want = Counter()
    for i, t, _ in rows:
        c = base_counts(t)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want[(i, *c, failed, not failed)] += 1
    assert got == want
    assert op3.judge(table(spark, rows).limit(0), model).collect() == []
    kept = op3.keep_good(table(spark, rows), model)
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == sum(v for k, v in want.items() if k[-1])


def test_quality_scores_and_held_out(spark):
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(300)], [f"bad{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(200):
        words = [rng.choice(good if i % 4 else bad) for _ in range(60)]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(i % 4 > 0), 0))
    docs = table(spark, rows)
    lab = spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int")
    trusted = op3.trusted_ids(lab)
    assert set(trusted) == {i for i in range(100) if i % 4}
    model = op3.fit(docs, trusted)
    got = {r.doc_id: r for r in op3.judge(docs, model).collect()}
    # held out: labels of documents from 100 on were not used
    assert all(got[i].kept == bool(i % 4) for i in range(100, 200))
    # brute force of the score of one document
    t = op3.Texts(__import__("pyarrow").array([rows[5][1]]))
    s, e, first = t.words()
    bins, _ = op3.bins_of(t.hashes(s, e), first)
    assert len(bins) == 60 + 59
    assert got[5].score == pytest.approx(model.ratio[bins].mean())


def test_quality_counts_all_trusted(spark, monkeypatch):
    monkeypatch.setattr(op3.trusted_ids, "__defaults__", (6,))
    rows = [(i, f"one{i} two{i} three{i} four{i}", "a") for i in range(40)]
    lab = spark.createDataFrame([(i, int(i < 30), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    first = op3.trusted_ids(lab)
    assert len(first) == 6
    model = op3.model_for(table(spark, rows), lab)

    def counts(some):
        t = op3.Texts(__import__("pyarrow").array(some))
        s, e, at = t.words()
        return np.bincount(op3.bins_of(t.hashes(s, e), at)[0], minlength=op3.BINS)

    own, raw = counts([t for i, t, _ in rows if i < 30 and i not in first[::3]]), counts([t for _, t, _ in rows])
    assert model.ratio == pytest.approx(np.log((own + 1) / (own.sum() + op3.BINS)) - np.log((raw + 1) / (raw.sum() + op3.BINS)))


def test_quality_model_and_threshold_take_all_trusted(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", f"own{i}"]) + str(rng.randrange(6)) for _ in range(15 + i % 20)), "a") for i in range(90)] + [(None, "w " * 30, "a"), (3, "repeated id " * 15, "a")]
    lab = spark.createDataFrame([(i, int(i % 3 < 2), 0) for i in range(90)] + [(4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = op3.model_for(docs, lab)
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("p")).collect()}

    def bins(t):
        x = op3.Texts(__import__("pyarrow").array([t]))
        s, e, at = x.words()
        return op3.bins_of(x.hashes(s, e), at)[0]

    def ratio(own, raw):
        own, raw = (sum((np.bincount(bins(t), minlength=op3.BINS) for t in some), np.zeros(op3.BINS)) for some in (own, raw))
        return np.log((own + 1) / (own.sum() + op3.BINS)) - np.log((raw + 1) / (raw.sum() + op3.BINS))

    raw, good = [t for _, t, _ in rows], [(i, t) for i, t, _ in rows if i is not None and i % 3 < 2]
    assert model.ratio == pytest.approx(ratio([t for _, t in good], raw))
    other = [ratio([t for i, t in good if part[i] != k], raw) for k in range(3)]
    scores = [other[part[i]][bins(t)].mean() for i, t in good if len(words_of(t)) >= 20]
    assert model.threshold == pytest.approx(np.mean(scores) - 6 * np.std(scores, ddof=1))
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert op3.model_for(docs, one).threshold == -np.inf  # no other trusted document to be scored by


# 4 -------------------------------------------------------------------------------------------------


def targets(sizes: dict) -> dict:
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in order if s not in fixed}
        share = {s: (total - sum(fixed.values())) * w[s] / sum(rest.values()) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    rows = corpus(n=300) + [(2000, "tiny source", "zz"), (2001, None, "empty"), (None, "null id with words", "a"), (2002, "rep rep", "b"), (2002, "rep rep", "b")]
    got = op4.mix_copies(table(spark, rows)).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words_of(t))
    want, taken = targets(size), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.copies <= 3
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]), s
    again = op4.mix_copies(table(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = op4.mix_documents(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns
    assert op4.mix_copies(table(spark, rows).limit(0)).collect() == []


def test_dual_is_solved(spark):
    rows = corpus(n=200)
    for r in op4.mix_copies(table(spark, rows)).groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("got"), F.first("target").alias("want")).collect():
        assert r.got == pytest.approx(r.want, rel=1e-6)


# 5 -------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(x):
    d = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(x))]
    return sum(v - 9 if v > 9 else v for v in d) % 10 == 0


def base_spans(t):
    for k, p in BASE.items():
        for m in re.finditer(p, t or ""):
            v, g = m[0], re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in v.split(".")) or k == "card" and not (16 <= len(g) <= 19 and luhn(g)) or k == "phone" and not 8 <= len(g) <= 15:
                continue
            yield f"{k}:{m.start()}:{m.end()}"


def test_pii_base(spark):
    texts = [
        "mail ä me.x+y@a-b.example.com, and x@y.z_w@q.r.s a@b a@b.c.", "..@..a@b.c-d.e@f.g", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 99999999999999999999.1.1.1",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (988) 555-2485 or +12 or +1.2.3.4.5.6.7.8.9.0 and +49 (0) 30-1234567890123456", None, "", "1" * 5000 + " " + "a" * 5000 + "@b.c", "6 " * 3000, "x@y.zz " * 200, "𝔘𝔫𝔦 a@b.cd 𝔠",
    ]
    rng = random.Random(9)
    texts += ["".join(rng.choice("01234@.+- ()aB_%\n") for _ in range(300)) for _ in range(120)]
    rows = [(i, t, None) for i, t in enumerate(texts)]
    found = op5.find_pii(table(spark, rows))
    got = {r.doc_id: (r.s, r.t) for r in found.select("doc_id", op5.digest(F.col("base")).alias("s"), op5.digest(F.col("terms")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == ",".join(base_spans(t)), t
    assert op5.find_pii(table(spark, rows).limit(0)).collect() == []


def test_pii_terms(spark):
    rng = random.Random(4)
    fill = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    some = lambda: " ".join(rng.choice(fill) for _ in range(12))
    rows = [(i, some(), "a") for i in range(200)]
    rows += [(300 + i, f"{some()} Springfield mayor Quimbyson mail boss@town.org {some()} Quimbyson again", "b") for i in range(6)]
    rows += [(400 + i, f"{some()} the mayor of another city got mail {some()}", "b") for i in range(60)]
    found = op5.find_pii(table(spark, rows))
    out = {r.doc_id: r for r in op5.sanitise(found).collect()}
    assert all({s["value"] for s in out[300 + i].terms} == {"Springfield", "Quimbyson"} for i in range(6))
    assert all(not out[i].terms and not out[i].base for i in [*range(200), *range(400, 460)])
    clean = out[300].clean_text
    assert "[EMAIL]" in clean and "Quimbyson" not in clean and "Springfield" not in clean and "mayor" in clean
    t = rows[200][1]
    assert [t[s["start"] : s["end"]] for s in out[300].terms] == [s["value"] for s in out[300].terms]


def told(texts):
    """Telling terms of each text by the definition: whole texts, each counted once, p(e | t) drawn to p(e) by one text."""
    some = sorted({t or "" for t in texts})
    ents, terms = {}, {}
    for t in some:
        ents[t] = set(re.findall(r"[a-z]+@[a-z]+\.org", t))
        terms[t] = set(re.findall(r"[^\W\d_]{4,}", re.sub(r"[a-z]+@[a-z]+\.org", " ", t).lower()))
    n, ne, df, co = len(some), Counter(e for t in some for e in ents[t]), Counter(w for t in some for w in terms[t]), Counter((e, w) for t in some for e in ents[t] for w in terms[t])
    telling = {(e, w) for (e, w), c in co.items() if ne[e] < n and math.log((c + ne[e] / n) / (df[w] + 1) * n / ne[e]) >= 0.8 * math.log(n / ne[e])}
    return {t: {w for e in ents[t] for w in terms[t] if (e, w) in telling} for t in some}


def pii_rows(spark, rows):
    found = op5.find_pii(table(spark, rows), context=None).collect()
    return [(r.doc_id, {s["value"].lower() for s in r.terms}) for r in found]


def test_pii_rare_and_far_terms(spark):
    rng = random.Random(6)
    fill = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    some = lambda k=12: " ".join(rng.choice(fill) for _ in range(k))
    rows = [(i, some(), "a") for i in range(300)]
    rows += [(400, f"Farword {some(60)} mail once@town.org {some()}", "b")]
    rows += [(410 + i, f"Pairword {some(40)} twice@town.org and also@town.org {some()}", "b") for i in range(2)]
    rows += [(420 + i, f"{some()} common@town.org {some(40)} shared {some()}", "b") for i in range(40)]
    want = told([t for _, t, _ in rows])
    got = dict(pii_rows(spark, rows))
    assert got == {i: want[t] for i, t, _ in rows}
    assert got[400] >= {"farword"} and got[410] >= {"pairword"} and got[420] == {"shared"} and got[0] == set()


def test_pii_copies_keep_verdicts(spark):
    rng = random.Random(7)
    fill = [f"filler{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    some = lambda: " ".join(rng.choice(fill) for _ in range(12))
    rows = [(i, some(), "a") for i in range(300)]
    rows += [(400 + i, f"{some()} Springfield boss@town.org {some()}", "b") for i in range(3)]
    plain = dict(pii_rows(spark, rows))
    rows += [(1000 + i, rows[300][1], "c") for i in range(400)]
    want = told([t for _, t, _ in rows])
    got = pii_rows(spark, rows)
    assert len(got) == len(rows) and dict(got) == {i: want[t] for i, t, _ in rows}
    assert all(dict(got)[i] == plain[i] for i in plain) and "springfield" in plain[400] and dict(got)[1399] == plain[400]


def test_pii_long_matches_and_many(spark):
    many = "".join(f"q{i}@ab.cd 10.0.{i % 300}.1 +1 (988) 555-{i % 9000 + 1000} 4111 1111 1111 1111 x, " for i in range(25_000))
    texts = ["mail a@b" + ".cd" * 1_000_000 + " end", many, "é" * 5000 + " ä@b.c q@r.st " + "ß" * 9000 + " z@y.xw"]
    found = op5.find_pii(table(spark, [(i, t, None) for i, t in enumerate(texts)]), context=None)
    got = {r.doc_id: r for r in op5.sanitise(found).select("doc_id", op5.digest(F.col("base")).alias("s"), "clean_text").collect()}
    for i, t in enumerate(texts):
        assert got[i].s == ",".join(base_spans(t))
    assert got[0].clean_text == "mail [EMAIL] end"
    assert got[1].clean_text.count("[EMAIL]") == 25_000 and "@" not in got[1].clean_text and "10.0.299.1" in got[1].clean_text
    assert got[2].clean_text == "é" * 5000 + " ä@b.c [EMAIL] " + "ß" * 9000 + " [EMAIL]"


def test_pii_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'some text token = "{key}" and more', None), (2, "Donaudampfschifffahrtsgesellschaftskapitaen 12345678901234567890123 aaaaaaaaaaaaaaaa1111", None)]
    rows += [(3, f"{key}@mail.example.com x@{key}.com {key}/path /{key} {key}. End", None), (4, None, None)]
    out = {r.doc_id: r for r in op5.sanitise(op5.find_pii(table(spark, rows), context=None)).collect()}
    assert [(s["start"], s["end"], s["value"]) for s in out[1].secrets] == [(19, 59, key)] and "[SECRET]" in out[1].clean_text and key not in out[1].clean_text
    assert out[2].secrets == [] and out[2].clean_text is None and out[4].secrets == []
    t = rows[2][1]
    assert [(s["start"], s["end"]) for s in out[3].secrets] == [(t.rindex(key), t.rindex(key) + 40)] and len(out[3].base) == 2
    spans = sorted((s["start"], s["end"]) for s in out[3].base + out[3].secrets + out[3].terms)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


# 6 -------------------------------------------------------------------------------------------------


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = corpus() + [(930, "ﬁ é don't I'LL x y\x1cz\x85q ΑΣ İ 12345 !!?? 日本語 <|endoftext|>", "a"), (930, "again", "a"), (None, "no id", "a")]
    room = 64
    got = op6.pack_documents(table(spark, rows), path, room, with_ids=True).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t, _ in rows if i not in (930, None)}
    by_doc: dict = {}
    for r in got:
        assert r.length == len(r.ids) and 1 <= r.length <= room
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, want in ids.items():
        p = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p)))
        assert [r.start for r in p] == [room * k for k in range(len(p))]
        assert [x for r in p for x in r.ids] == want
    want = tok.encode(rows[-3][1], add_special_tokens=False).ids
    assert [*want, 0] in [r.ids for r in by_doc[930]]
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= room
    total = sum(r.length for r in got)
    assert len(seqs) <= 1.05 * total / room + 2
    assert op6.pack_documents(table(spark, rows).limit(0), path, room).collect() == []


def test_packing_makes_no_tiny_files(spark):
    pieces = spark.createDataFrame([(i, 0, 1 + i % 50) for i in range(5000)], "doc_id long, piece int, length long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = op6.pack_pieces(pieces, 64)
        assert out.withColumn("p", F.spark_partition_id()).select("p").distinct().count() == -(-5000 // op6.CHUNK)
        assert out.count() == 5000 and out.select("sequence_id", "offset").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nnls_and_plan():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    b = a @ np.maximum(rng.standard_normal(30), 0)
    x = op6.nnls(a, b)
    assert (x >= 0).all() and np.allclose(a @ x, b, atol=1e-6)
    hist = {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 900), rng.integers(1, 400, 900), strict=True)}
    plan = op6.plan_sequences(hist)
    used = Counter()
    for lengths, k in plan:
        assert k > 0 and sum(lengths) <= 2048
        for n in lengths:
            used[n] += k
    assert used == Counter(hist)
    # Half of these are longer than half a sequence, so the sum of lengths is out of reach.
    assert sum(k for _, k in plan) <= 1.025 * sum(n * c for n, c in hist.items()) / 2048 + 1
    lengths = np.clip(rng.lognormal(6.3, 1.0, 50_000).astype(int), 1, 2048)
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    assert sum(k for _, k in op6.plan_sequences(hist)) <= 1.005 * sum(n * c for n, c in hist.items()) / 2048 + 1
    assert sorted(op6.patterns(6, 3)) == sorted([(6,), (5, 1), (4, 2), (3, 3), (4, 1, 1), (3, 2, 1), (2, 2, 2)])


# 7 -------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rows = corpus(n=500) + [(None, "x", "a"), (None, None, "a")] + [(3000 + i, "a group of copies " * 5, "b") for i in range(300)]
    got = op7.assign_shards(table(spark, rows), 8).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8))
    most = max(r.size for r in got)
    mean = sum(r.size for r in got) / 8
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - mean) <= 1.5 * most + 0.03 * mean
    assert Counter(map(tuple, got)) == Counter(map(tuple, op7.assign_shards(table(spark, rows), 8).collect()))
    assert op7.assign_shards(table(spark, rows).limit(0)).collect() == []


def test_sharding_keeps_small_groups_whole(spark):
    rows = [(i, "one hot text " * 3, "a") for i in range(3000)] + [(10_000 + i, f"group {i // 4} of four equal texts", "b") for i in range(6000)]
    got = op7.assign_shards(table(spark, rows), 8).collect()
    text = {i: t for i, t, _ in rows}
    homes: dict = {}
    for r in got:
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for t, v in homes.items() if t.startswith("group"))
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 0.03 * sum(sizes.values()) / 8


def test_write_shards(spark, tmp_path):
    rows = [r for r in corpus(n=50)]
    op7.write_shards(table(spark, rows), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 4


# 8 -------------------------------------------------------------------------------------------------


def shingle_set(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_family(seed: int, n: int, words: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w[: rng.randrange(int(words * 0.8), words + 1)]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed)
    texts = near_family(seed, 60, 60, 3) + near_family(seed + 10, 40, 25, 1) + near_family(seed + 20, 20, 300, 10) + near_family(seed + 30, 30, 9, 1)
    passage = " ".join(f"p{i}" for i in range(50))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30))) for _ in range(40)]
    rows += [(5000 + i, t, None) for i, t in enumerate(texts)]
    rows += [(5000, texts[0].upper(), None), (None, texts[1], None), (None, "only null id here with five words", None)]
    got = op8.jaccard_components(table(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = [(i, shingle_set(t)) for i, t, _ in rows]
    links: dict = {k: set() for k in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    root = components(links)
    low: dict = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    want = Counter((i, len(s), low.get(root[k])) for k, (i, s) in enumerate(sets))
    assert Counter(map(tuple, got)) == want
    assert op8.jaccard_components(table(spark, rows).limit(0)).collect() == []


# 9 -------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, top int, sha string")


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "ä\r\n\r\nWARC/1.0\r\n" * 200
    rows = [(1, "http://a/x y", big), (2, None, big), (9, "http://b", big), (3, "https://c/ü", ""), (4, "http://d", None), (5, "http://e", "small"), (6, "http://f", "small"), (7, "http://g", "x" * 999), (8, "http://h", "x" * 999), (10, "http://i", "y" * 1000), (11, "http://i", "y" * 1000), (11, "http://i", "y" * 1000), (None, "http://j", big), (12, "http://k", "z" * 300_000)]
    op9.write_warc(pages(spark, rows), str(tmp_path / "w"))
    got = op9.read_warc(spark, str(tmp_path / "w")).collect()
    top: dict = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            top[h] = max(top.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        rev = i is not None and h in top and top[h] != i
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if rev else "response", top[h] if rev else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.sound for r in got)
    op9.write_warc(pages(spark, rows).limit(0), str(tmp_path / "e"))
    assert op9.read_warc(spark, str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    recs = [("http://a/b", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nbody\nwith lines\n"), ("dns:a", b"20010203\na. 1 IN A 1.2.3.4\n"), ("http://e/", b"")]
    raw = op9.write_arc(recs, version, "20010203040506")
    back = list(op9.read_arc(raw))
    assert back[0]["url"].startswith("filedesc:") and [r["version"] for r in back] == [version] * 4
    assert [(r["url"], r["body"]) for r in back[1:]] == recs
    kinds = [next(op9.parse_warc(__import__("io").BytesIO(op9.to_warc(r) + b"\r\n\r\n"))) for r in back]
    assert [h["warc-type"] for h, _ in kinds] == ["warcinfo", "response", "resource", "response"]
    assert kinds[1][0]["warc-date"] == "2001-02-03T04:05:06Z"
    assert kinds[1][1] == recs[0][1]
    assert len({h["warc-record-id"] for h, _ in kinds}) == 4
    with pytest.raises(ValueError):
        list(op9.read_arc(raw[:-20]))


# 10 ------------------------------------------------------------------------------------------------


def test_urls(spark):
    can = lambda u: f'<html><link href="{u}" rel="canonical"></html>'
    rows = [
        (1, "http://a.com/en/x", None, "com/en/", "block"),
        (2, "HTTP://WWW.Example.COM/en/70?q#f", "", "example.com/en/7", "allow"),
        (3, "http://x.net/de/8", "", "net/de/", "allow"),
        (4, "http://b.example.net/de/8a", "", "example.net/de/8", "block"),
        (5, "http://alias.info/1", can("http://a.com/en/x#top"), None, "block"),
        (6, "http://alias.info/2", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=/1">', None, "block"),
        (7, "http://free.info/1", can("//example.com/en/7"), None, "allow"),
        (8, "http://free.info/2", can("1") + can("http://a.com/en/zz"), None, "allow"),
        (9, "http://lone.info", "<link rel=stylesheet href=x>", None, "allow"),
        (10, None, can("http://a.com/en/x"), None, "allow"),
        (11, "no scheme/en/", can("http://a.com/en/x"), None, "allow"),
        (12, "http://com/en/", "", "com/en/", "block"),
        (13, "http://xcom/en/", "", None, "allow"),
        (14, "http://a.org?x/es/", "", None, "allow"),
        (None, "http://alias.info/1", None, None, "block"),
    ]
    got = op10.judge_urls(pages(spark, [r[:3] for r in rows])).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter((r[0], r[3], r[4]) for r in rows)
    hosts = {r.page_id: (r.host, r.path) for r in got}
    assert hosts[2] == ("www.example.com", "/en/70") and hosts[10] == ("", "") and hosts[14] == ("a.org", "")
    assert op10.judge_urls(pages(spark, [r[:3] for r in rows]).limit(0)).collect() == []


def test_urls_against_sql(spark):
    """Chains, hubs, relative and canonical links, fragments, upper-case hosts, allow before block in a group."""
    import duckdb

    link = lambda to: f'<html><link rel="canonical" href="{to}"></html>'
    meta = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    rows = [(i, f"http://chain.io/{i}", meta(f"/{i + 1}")) for i in range(30)] + [(30, "http://chain.io/30", link("http://bad.org/es/x"))]
    rows += [(100 + i, f"http://hub.io/a/{i}#f", link("HTTP://Hub.IO/centre")) for i in range(40)] + [(140, "http://hub.io/centre", meta("//www.example.net/de/1"))]
    rows += [(200, "http://both.io/x/", link("../y?a=1&amp;b=2")), (201, "http://both.io/x/../y?a=1&b=2", link("http://m.org/es/1")), (202, "http://BOTH.io/x/", meta("http://sub.net/de/2")), (203, "http://both.io?q", link("rel"))]
    rows += [(300, "http://m.org/es/1", None), (301, None, link("http://m.org/es/1")), (302, "nothing", meta("x")), (303, "http://www.example.com/en/7", ""), (304, "http://a.com/en/7", None), (304, "http://a.com/en/7", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter(tuple(r) for r in op10.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect())
    pages = df.distinct().toPandas()  # noqa: F841
    want = {tuple(None if x != x else x for x in r) for r in duckdb.sql(op10.OP10_SQL).fetchall()}
    assert set(got) == want and sum(got.values()) == len(rows)
    by = {r[0]: r[4] for r in want}
    assert by[0] == by[30] == "block" and by[100] == by[140] == "allow" and by[201] == by[200] == "allow" and by[302] == "allow"
