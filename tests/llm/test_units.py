import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarrylens.llm import common as C
from quarrylens.llm.fm_index import FMIndex, suffix_array
from quarrylens.llm.jaccard_join import keep_least, overlaps
from quarrylens.llm.quality_rules import text_counts
from quarrylens.llm.toxicity import maximal_segments


def test_tokens_are_the_regular_expressions(corpus):
    texts = [t for _, t in corpus] + [None, ""]
    for member, pattern in ((C.PLAIN, rb"[^\x20\x09-\x0D]+"), (C.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        t = C.tokenise(pa.array(texts), member)
        got = [[] for _ in texts]
        seen = {}
        for h, r, a, b in zip(t.hash.tolist(), t.row.tolist(), t.start.tolist(), t.end.tolist()):
            word = t.data[a:b].tobytes().lower()
            got[r].append(word)
            assert seen.setdefault(h, word) == word
        assert got == [re.findall(pattern, (x or "").encode().lower()) for x in texts]


def test_prefix_hashes():
    t = C.tokenise(pa.array(["straße stra strand é"]), C.PLAIN)
    p = t.prefix(4)
    assert p[0] == p[1] == p[2] == t.hash[1] and p[3] == t.hash[3]


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 1, 30, 2, 0)] + [None]})
    parts = list(C.slices(b, limit=6))
    assert [p.num_rows for p in parts] == [2, 1, 3] and list(C.slices(b.slice(0, 0))) == []


def test_stored_arrays_come_back_mapped(tmp_path):
    C.store(f"file://{tmp_path}/a/b", [np.arange(7, dtype=np.uint64), np.zeros(0, np.uint8), np.array([1.5])])
    a, b, c = C.mapped(f"file://{tmp_path}/a/b")
    assert a.tolist() == list(range(7)) and len(b) == 0 and c[0] == 1.5
    with pytest.raises(FileNotFoundError):
        C.mapped(f"file://{tmp_path}/a/none")


def test_words_that_collide_under_polynomials():
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    for size in (64, 65, 1024):
        assert len({int(C.tokenise(pa.array([w[:size]])).hash[0]) for w in (one, two)}) == 2
    assert C.tokenise(pa.array([("x" * 70).upper()])).hash[0] == C.tokenise(pa.array(["x" * 70])).hash[0] != C.tokenise(pa.array(["X" * 70]), lower=False).hash[0]


def test_no_local_folder_on_a_cluster():
    class Session:
        conf, sparkContext = {}, type("Context", (), {"master": "spark://x"})

    with pytest.raises(ValueError):
        C.shared_folder(Session(), "x")


def test_fm_index_against_brute_force():
    r = np.random.default_rng(3)
    for n, sigma in ((1, 3), (50, 3), (400, 9), (300, 2)):
        seq = np.concatenate((r.integers(1, max(sigma, 2), n), [0]))
        text = seq.tolist()
        assert suffix_array(seq).tolist() == sorted(range(n + 1), key=lambda i: text[i:])
        index = FMIndex(seq, sigma)
        for m in (1, 2, 5):
            patterns = r.integers(1, max(sigma, 2), (20, m))
            which, at = index.locate(*index.search(patterns))
            want = sorted((k, i) for k, p in enumerate(patterns.tolist()) for i in range(n - m + 1) if text[i : i + m] == p)
            assert sorted(zip(which.tolist(), at.tolist())) == want


def test_overlaps_and_thresholds():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 9000, r.integers(1, 5000)).astype(np.uint64)) for _ in range(6)]
    assert overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert all(0 <= m <= k for k, m in keep_least()) and keep_least()[-1][1] > 50


def test_maximal_segments_against_definition():
    def brute(x):
        if not x:
            return []
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [(a, b) for a, b in brute(x[:i])] + [(i, j)] + [(a + j, b + j) for a, b in brute(x[j:])]

    r = random.Random(2)
    for _ in range(200):
        x = [r.choice((-1.37, -1.37, 2.11, -0.53, 0.71)) for _ in range(r.randint(0, 12))]
        at = [i for i, v in enumerate(x) if v != -1.37]
        got = maximal_segments(at, [x[i] for i in at], -1.37)
        assert sorted((a, b) for a, b, _ in got) == sorted(brute(x))
        assert all(abs(s - sum(x[a:b])) < 1e-9 for a, b, s in got)


def test_text_counts_against_brute_force(corpus):
    texts = [t for _, t in corpus] + [None, ""]
    got = text_counts(pa.array(texts))
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        cover = {j + o for j, x in enumerate(three) if three.count(x) > 1 for o in range(3)} if len(w) < 400 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(set(w)))
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == want
