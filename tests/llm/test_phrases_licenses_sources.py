"""Collocations, license scans and source divergence against plain Python, on odd tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import collocations, divergence, license_scan
from quarrylens.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n long, docs long, w string, words string, text_hash string, piece string, rank int, value long, base string, template string, p string"


def table(spark, rows):
    """(text, lang, source) rows, with columns named like the operators' own."""
    return spark.createDataFrame([(k if k % 7 else None, *r, *(None,) * (len(SCHEMA.split(",")) - 4)) for k, r in enumerate(rows)], SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    words = ["the", "of", "New", "York", "city", "É", "ß", "a-b", "x"]
    rows = []
    for k in range(90):
        text = " ".join(r.choice(words) + r.choice(["", "", "", ",", ".", "\t", "  ", "\n", "\x0b", "\x00"]) for _ in range(r.randint(1, 60)))
        rows.append((text, r.choice(["en", "de", None]), r.choice(["s0", "s1", "s2", None, ""])))
    rows += [(None, "en", "s0"), ("", "en", "s9"), ("", "fr", "s0"), ("...", "en", "s1"), ("new york city " * 4000, "en", "s0"), ("12 34", "xx", "s1"), ("12 34", "xx", None)]
    return rows + rows[:5] * 2


def phrase_brute(rows, least, top):
    words, f = Counter(), Counter()
    for text, lang, _ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in many.items():
        inside = any(q == lang and len(x) > len(w) and 100 * b >= 80 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (q, x), b in many.items())
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        if not inside:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], words[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def test_collocations(spark, prose, monkeypatch):
    got = collocations.collocations(table(spark, prose))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrase_brute(prose, 30, 2000)
    assert want and sorted(tuple(r) for r in got.collect()) == want
    # Many blocks, several passes, few ranks.
    monkeypatch.setattr(collocations, "BLOCK_KEYS", 40)
    monkeypatch.setattr(collocations, "PASS_KEYS", 100)
    monkeypatch.setattr(collocations, "FILE_CELLS", 8)
    got = collocations.collocations(table(spark, prose), least=5, top=7)
    assert sorted(tuple(r) for r in got.collect()) == phrase_brute(prose, 5, 7)


def test_guards():
    assert collocations.guarded([b"A b,c", b"", b"d\te ", b",,"]) == " a b \n c \n d e \n "


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(None, None, None), ("one two", "en", "s")])).count() == 0


def test_counts_beyond_32_bits(spark):
    big = 3 * 10**14
    freq = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, 2 * big)], "lang string, phrase string, size int, f long")
    (r,) = collocations.score_phrases(freq).collect()
    assert r.score == 2_000_000 * big // (3 * big + 1)


def divergence_brute(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for q, _, w in docs if q == lang for t in set(w))
        terms = sorted(t for t, n in df.items() if n >= least)
        n = {s: Counter() for q, s, _ in docs if q == lang}
        for q, s, w in docs:
            if q == lang:
                n[s].update(t for t in w if df[t] >= least)
        every = sum(n.values(), Counter())

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(terms)) for t in terms}

        q, p = share(every), {s: share(c) for s, c in n.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in terms), o.encode()) for o in n if o != s))
            over = sorted((-f(p[s][t], q[t]), t.encode()) for t in terms if n[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", over)):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence(spark, prose):
    got = divergence.divergence(table(spark, prose))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergence_brute(prose, 10, 10)
    assert sorted(tuple(r) for r in divergence.divergence(table(spark, prose), least_docs=1, top=2).collect()) == divergence_brute(prose, 1, 2)
    assert divergence.divergence(table(spark, [])).count() == 0


@pytest.mark.parametrize("few", [1, 1024])
def test_radix_selection(spark, monkeypatch, few):
    """Ties in plenty, items that begin alike, values of many bits."""
    monkeypatch.setattr(divergence, "FEW", few)
    r = random.Random(9)
    rows = [(g, "".join(r.choice(("a", "b", "é", "😀", "￿")) for _ in range(r.randint(0, 6))) + str(i), r.choice((0, 1, 5, 2**40, 2**40 + 1, 2**62))) for i in range(300) for g in ("x", "y")]
    rows += [("z", "only", 3), ("t", "ab", 7), ("t", "a", 7), ("t", "", 7), ("t", "abc", 7)]
    df = spark.createDataFrame(rows, "g string, item string, v long")
    for k in (1, 3, 60, 1000):
        got = {(x.g, x.rank): (x.v, x.item) for x in divergence.radix_top(df, ["g"], "v", "item", k, shared_folder(spark, "t")).collect()}
        want = {}
        for g in "xyzt":
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1].encode()))[:k]
            want |= {(g, i): (v, item) for i, (_, item, v) in enumerate(own, 1)}
        assert got == want


def test_shares_beyond_64_bits(spark):
    n, total = 5 * 10**17, 9 * 10**17
    df = spark.createDataFrame([(n, total, 10**6)], "n long, total long, terms long")
    assert df.select(divergence.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * 10**6)


MIT = "Released UNDER the MIT-License."
LICENSES = [
    MIT, f"{MIT} {MIT}\nall CC BY-NC.", None, "", "under the mit", "apache license, version 2.0 of under the mit license",
    "Permission is hereby granted free of charge to EVERY person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense and or sell copies of the Software",
    "Permission is hereby granted free of charge. " + "Other words stand here. " * 30, "all rights reserved " * 500, "x" * 50_000 + " under the mit license", "cc by nc cc by nc", "CC BY NC é",
]


def test_license_scan(spark):
    docs = table(spark, [(t, "en", "s") for t in LICENSES + LICENSES[:2] * 3])
    got = license_scan.license_scan(docs).join(docs.select(F.col("doc_id").alias("i"), "text"), F.col("doc_id").eqNullSafe(F.col("i")))
    assert license_scan.license_scan(docs).count() == len(LICENSES) + 6
    by_text = {r.text: r for r in got.collect() if r.doc_id is not None}
    assert license_scan.license_scan(docs).filter("doc_id IS NULL").count() == 3
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for text, r in by_text.items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        at = sorted((i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_text[LICENSES[6]].labels == "mit" and by_text[LICENSES[6]].n_base == 0 and 0.8 <= by_text[LICENSES[6]].score < 1
    assert by_text[LICENSES[8]].labels == "all-rights-reserved" and by_text[LICENSES[8]].score == 1.0
    assert license_scan.license_scan(table(spark, [])).count() == 0


def test_license_plan_has_no_python(spark, prose):
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("under the mit license").alias("text"))
    out = license_scan.license_scan(docs)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|PythonRDD", plan) and "PythonRDD" not in out._jdf.queryExecution().toRdd().toDebugString()


def test_short_template_is_an_error(spark):
    with pytest.raises(Exception, match="fewer than 3 words"):
        license_scan.license_scan(table(spark, [("a b c", "en", "s")]), (license_scan.Template("t", "t", "two words"),)).collect()
