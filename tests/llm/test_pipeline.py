"""Each stage of the pipeline against a brute-force version of it, on that stage's own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarrylens.llm import token_files
from quarrylens.llm.common import kept, shared_folder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output rows of each stage, over a small folder of tables."""
    r = np.random.default_rng(11)
    vocabulary = ["".join(r.choice(list("abcdefghij"), r.integers(2, 8))) for _ in range(400)]
    words = lambda n: [str(x) for x in r.choice(vocabulary, n)]
    phrase = words(14)
    rows, labels = [], []
    for i in range(240):
        w = words(int(r.integers(60, 160)))
        if i % 6 == 0:
            w = [x + "***" for x in w]
        elif i % 10 == 1:
            w[20:20] = phrase
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 6 != 0), 0))
    for i in (1, 2, 3, 5):
        w = rows[i][1].split()
        rows += [(1000 + i, rows[i][1]), (2000 + i, " ".join([*w[:-1], "other"]))]
    rows += [(3000, " ".join(phrase)), (3001, None), (3002, "")]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in rows], COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, " ".join(phrase))], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{top}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = kept(stage(spark, docs, str(top)), shared_folder(spark, "test"), name)
        out[name] = ([x.asDict() for x in docs.collect()], [x.asDict() for x in done.collect()])
        docs = done
    return out, " ".join(phrase)


def test_quality_keeps_clean_and_drops_bad(stages):
    before, after = stages[0]["quality"]
    left = {x["doc_id"] for x in after}
    full = [x for x in before if x["text"] and len(x["text"].split()) > 20]
    assert {x["doc_id"] for x in full if "***" not in x["text"]} <= left
    assert not {x["doc_id"] for x in full if "***" in x["text"]} & left
    assert all(set(x) == {"doc_id", "text", "lang", "source", "n_chars"} for x in after)


def _shingles(t):
    w = (t or "").split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_stays(stages):
    before, after = stages[0]["near_duplicates"]
    sets = {x["doc_id"]: _shingles(x["text"]) for x in before}
    group = {i: i for i in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                group[q] = p
    assert Counter(x["doc_id"] for x in after) == Counter({top(i) for i in sets})
    assert len(after) <= len(before) - 8


def test_benchmark_words_are_gone(stages):
    out, phrase = stages
    before, after = out["decontamination"]
    left = {x["doc_id"]: x for x in after}
    for x in before:
        t = x["text"]
        if t == phrase:
            assert x["doc_id"] not in left
        elif t and phrase in t:
            a, b = t.split(phrase)
            assert left[x["doc_id"]]["text"] == a + b and left[x["doc_id"]]["n_chars"] == len(a + b)
        else:
            assert left[x["doc_id"]] == x


def test_sources_meet_their_targets(stages):
    before, after = stages[0]["mixing"]
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or ""))
    sizes, took = Counter(), Counter()
    for x in before:
        sizes[x["source"]] += size(x)
    for x in after:
        took[x["source"]] += size(x)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = min(1.5, 2) * sum(sizes.values()), {}, set(names)
    while open_:  # share by weight; who has more than twice its size is full
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    longest = max(map(size, before))
    assert all(abs(took[s] - target[s]) <= longest for s in names)
    assert max(Counter(x["doc_id"] for x in after).values()) <= 2
    rows = {(x["doc_id"], x["text"]) for x in before}
    assert all((x["doc_id"], x["text"]) in rows for x in after)


def test_token_files_hold_all_rows(stages):
    from tokenizers import Tokenizer

    before, after = stages[0]["tokens"]
    t = Tokenizer.from_file(token_files.tokenizer_path())
    want, start = [], 0
    for x in sorted(before, key=lambda x: (x["doc_id"], x["text"] or "")):
        ids = np.array([*t.encode(x["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((x["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) for x in after) == sorted(want)
