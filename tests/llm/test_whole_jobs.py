"""Where an operator once did less than the whole job."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import islice, product

import numpy as np
import pyarrow as pa

from quarrylens.llm import line_dedup, ngram_lm, toxicity
from quarrylens.llm.common import ALNUM, remainder, shared_folder, table, tokenise

SF = "/root/testdata/sf0.001"


def test_language_model_query_is_of_order_three(spark):
    docs = table(spark, SF, "documents")
    # Order 3 itself is compared with brute force in test_llm_operators.py.
    model = ngram_lm.train(docs.filter(remainder("doc_id", ngram_lm.HELD_OUT[0]) != ngram_lm.HELD_OUT[1]), order=3)
    want = {r.doc_id: r.score for r in ngram_lm.score(docs, model).collect()}
    got = {r.doc_id: r.score for r in ngram_lm.op1_ngram_lm(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - x) < 1e-8 for i, x in want.items())


def test_line_dedup_of_short_texts_and_long_lines(spark):
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 9))) + r.choice(". ! ? .5 ".split(" "))
    pool = [sentence() for _ in range(12)]
    texts = ["one", "one", "two\nlines", "two\nlines", "\n one \n", "two lines", "A b.  C d!\n\nE f? ", "x A b. C d! E f?", "0. A b.\tC d! E f? 9", None, ""]
    texts += [r.choice(["", " "]) + "".join(r.choice(pool) + r.choice([" ", "  ", "\n", " \n\n"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in line_dedup.dedup_lines(df, whole=True).collect()}
    seen = set()
    for i, t in enumerate(texts):
        pieces = re.split(r"(\n|(?<=[.!?])[ \t]+)", t or "")
        parts, ends = pieces[::2], ["", *pieces[1::2]]
        full = [k for k, p in enumerate(parts) if p.strip()]
        lines, gone = [parts[k].strip() for k in full], set()
        for k in range(max(len(lines) - 2, 1) if lines else 0):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= set(range(k, min(k + 3, len(lines))))
            seen.add(w)
        left = [k for k in range(len(parts)) if k not in {full[g] for g in gone}]
        want = "".join((ends[k] if n else "") + parts[k] for n, k in enumerate(left))
        assert (got[i].n_lines, got[i].n_removed, got[i].clean_text) == (len(lines), len(gone), want), (i, t)
    assert sum(got[i].n_removed > 0 for i in (1, 3, 4)) == 3 and got[7].n_removed == 0 and got[8].n_removed > 0


def test_toxicity_keeps_every_significant_word(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKET_ENTRIES", 20_000)
    marked = ["".join(w) + "xy" for w in islice(product("abcdefghijklmnop", repeat=4), 60_000)]
    rows = [(" ".join(marked), 1)] * 9 + [("quiet words", 0)] * 171
    lexicon, share = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), shared_folder(spark, "test"))
    t = tokenise(pa.array([" ".join(marked), "quiet words"]), ALNUM)
    s = lexicon.scores(t.hash, t.prefix(toxicity.STEM))
    assert share == 0.05 and (s[:60_000] > 0).all() and not (s[60_000:] > 0).any() and lexicon.ordinary < 0


def test_toxicity_among_50000_random_words(spark):
    """Chance words, however many, neither enter the lexicon nor keep toxic texts from being found."""
    r = np.random.default_rng(8)
    pool = np.array(["".join(x) for x in product("abcdefghijklmno", repeat=4)])[:50_000]
    rows = []
    for i in range(3000):
        w = list(r.choice(pool, 120))
        if i % 10 == 3:
            for k in r.integers(0, 120, 3):
                w[k] = "zz" + str(r.integers(0, 10)) + "vile"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 == 3)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, marks).collect()
    caught = [q.predicted for q in got if q.doc_id % 10 == 3 and q.held_out]
    wrong = [q.predicted for q in got if q.doc_id % 10 != 3 and q.held_out]
    assert sum(caught) > 0.95 * len(caught) and sum(wrong) < 0.01 * len(wrong)


def test_toxicity_against_brute_force(spark):
    """The whole score, from the counts to the curve, in plain Python."""
    r = random.Random(9)
    pool = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(90)]
    rows = []
    for i in range(260):
        w = [r.choice(pool) for _ in range(r.randint(3, 60))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = "vile" + r.choice("abcdef")
            w[r.randrange(len(w))] = "vile" + r.choice("abcdef")
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    rows += [(900 + k, rows[k][1], rows[k][2]) for k in range(20)] + [(990, None, 0), (991, "", 0)]
    got = {q.doc_id: q for q in toxicity.score_toxicity(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")).collect()}
    train = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 != 0]
    texts = {}
    for i, t, y in train:
        texts.setdefault(t, []).append((i, y))
    one = [(t, int(2 * sum(y for _, y in v) >= len(v)), min(i for i, _ in v)) for t, v in texts.items()]
    share = sum(y for _, y, _ in one) / len(one)
    pos, neg, clean = Counter(), Counter(), Counter()
    for t, y, _ in ((t or "", y, i) for t, y, i in one):
        for word in set(t.split()):
            (pos if y else neg)[word, 1] += 1
        for stem in {x[:4] for x in t.split()}:
            (pos if y else neg)[stem, 0] += 1
        if not y:
            clean.update((x, 1) for x in t.split())
            clean.update((x[:4], 0) for x in t.split())
    keys = {k for k in pos} | {k for k in neg}

    def tail(k, n, s):
        x = k / n
        return n * ((x * math.log(x / s) if x else 0) + ((1 - x) * math.log((1 - x) / (1 - s)) if x < 1 else 0)) if x > s else 0.0

    def discovered(levels):
        step = {k: math.floor(min(v, 150) * 8) for k, v in levels.items()}
        best = None
        for v in sorted(set(step.values()), reverse=True):
            rank = sum(x >= v for x in step.values())
            if v and -v / 8 <= math.log(toxicity.FALSE_SHARE * rank / len(step)):
                best = v
        return {k for k, v in step.items() if best is not None and v >= best}

    logit = lambda p: math.log(p / (1 - p))
    theta = {k: (pos[k] + 4 * share) / (pos[k] + neg[k] + 4) for k in keys if k[1] == 0}
    theta |= {k: (pos[k] + 4 * theta[k[0][:4], 0]) / (pos[k] + neg[k] + 4) for k in keys if k[1] == 1}
    score = {k: logit(v) - logit(share) for k, v in theta.items()}
    level = {k: tail(pos[k], pos[k] + neg[k], share) for k in keys}
    stems = discovered({k: level[k] for k in keys if k[1] == 0})
    words = {k for k in keys if k[1] == 1}
    under = {k: tail(neg[k], pos[k] + neg[k], 1 - theta[k[0][:4], 0]) for k in words if (k[0][:4], 0) in stems}
    own = discovered({k: level[k] for k in words}) | (discovered(under) if under else set())
    mass = {k: clean[k] for k in own} | {k: clean[k] - sum(clean[w] for w in own if w[0][:4] == k[0]) for k in stems}
    total = sum(v for k, v in clean.items() if k[1] == 1)
    p = {k: (v + 0.5) / (total + 1) for k, v in mass.items()}
    dense = sum(v * math.exp(score[k]) for k, v in p.items())
    shift = min(0.0, math.log(0.5 / dense))
    ordinary = math.log((1 - dense * math.exp(shift)) / (1 - sum(p.values())))
    assert p and ordinary < 0 and any(k[0].startswith("vile") for k in p)

    def segments(t):
        s, at = [], []
        for k, w in enumerate((t or "").split()):
            e = (w, 1) if (w, 1) in p else (w[:4], 0) if (w[:4], 0) in p else None
            if e:
                at.append(k)
                s.append(score[e] + shift)
        return toxicity.maximal_segments(at, s, ordinary)

    n = {x[0]: len((x[1] or "").split()) for x in rows}
    found = {x[0]: segments(x[1]) for x in rows}
    firsts = [i for _, y, i in one if not y]
    best = {i: max([x for _, _, x in found[i]], default=0.0) for i in firsts}
    k = (sum(b > 0 for b in best.values()) + 0.5) / (sum(n[i] * math.exp(-max(b, 0)) for i, b in best.items()) + 0.5)
    want = {}
    for i, segs in found.items():
        want[i] = min(60.0, sum(x - math.log(k * n[i]) for _, _, x in segs if k * n[i] * math.exp(-x) <= 1))
    bins = {}
    for i, _, y in train:
        b = bins.setdefault(math.floor(want[i] / 0.25 + 0.5), [0, 0])
        b[1 - y] += 1
    x = np.array(sorted(bins), float)
    a, b = toxicity.fit_curve(x * 0.25, np.array([bins[v][0] for v in sorted(bins)], float), np.array([bins[v][1] for v in sorted(bins)], float))
    for i in got:
        assert abs(got[i].score - 1 / (1 + math.exp(-(a + b * want[i])))) < 1e-6, i
    assert sum(q.predicted == 1 for q in got.values()) > 50
