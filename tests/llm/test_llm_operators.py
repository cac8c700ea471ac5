import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.llm import chat_format, decontaminate, jaccard_join, line_dedup, mixing, ngram_lm, quality_classifier, quality_rules, token_files, toxicity
from quarrylens.llm.common import remainder, shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_decontaminate_against_brute_force(spark, docs, corpus):
    items = [(k, " ".join(re.findall(r"\w+", t)[3:20])) for k, t in corpus[:6]] + [(90, "one"), (91, "ONE"), (92, None), (93, " ; "), (94, corpus[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    def check(got):
        for i, t in corpus:
            w, hit, found = words(t), set(), set()
            for item, x in items:
                x = words(x)
                n = min(10, len(x))
                for k in range(len(x) - n + 1 if n else 0):
                    for j in range(len(w) - n + 1):
                        if w[j : j + n] == x[k : k + n]:
                            hit |= set(range(j, j + n))
                            found.add(str(item))
            r = got[i]
            assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(found))
            assert [x for a, b in r.spans for x in range(a, b)] == sorted(hit)
            assert words(r.clean_text) == [x for k, x in enumerate(w) if k not in hit]

    check({r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()})
    decontaminate.BLOCK_PHRASES, before = 7, decontaminate.BLOCK_PHRASES
    try:  # several blocks give the same
        check({r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()})
    finally:
        decontaminate.BLOCK_PHRASES = before


def test_decontaminate_edges(spark, edges, none, docs):
    bench = spark.createDataFrame([(1, "words here again")], "item_id long, text string")
    got = decontaminate.decontaminate(edges, bench).collect()
    assert len(got) == 7 and sum(r.n_hit for r in got) == 9
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(edges, bench.limit(0)).collect())


def _links(corpus):
    sets = {}
    for i, t in corpus:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_jaccard_against_brute_force(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)  # every group is cut
    got = {r.doc_id: r for r in jaccard_join.similarity_classes(docs).collect()}
    n = Counter()
    for a, b in _links(corpus):
        n[a] += 1
        n[b] += 1
        assert got[a].group_id == got[b].group_id
    assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i, _ in corpus}
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {min(i for i in got if got[i].group == r.group) if r.group is not None else r.doc_id for r in got.values()}


def test_jaccard_edges(edges, none):
    got = jaccard_join.similarity_classes(edges).collect()
    assert len(got) == 7 and sorted(r.n_links for r in got) == [0, 0, 0, 0, 2, 2, 2]
    kept = jaccard_join.keep_one(edges).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 5)]
    assert jaccard_join.similarity_classes(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def _kneser_ney(train, texts, order):
    tokens = lambda t: [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + ["end"]
    c = [Counter() for _ in range(order + 1)]
    one = Counter()
    for t in train:
        one.update(tokens(t))
        w = ["start"] * (order - 1) + tokens(t)
        c[order].update(tuple(w[j - order + 1 : j + 1]) for j in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        c[k].update(g[1:] for g in c[k + 1])
    cut, at = {}, {}
    for k in range(1, order + 1):
        n = [0, *(sum(v == x for v in c[k].values()) for x in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        d = [j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0 for j in (1, 2, 3)]
        cut[k] = [0, *(x if 0 < x < j else f for x, j, f in zip(d, (1, 2, 3), (0.5, 1.0, 1.5)))]
        at[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, v in c[k].items():
            at[k][g[:-1]][0] += v
            at[k][g[:-1]][min(v, 3)] += 1
    out = []
    for t in texts:
        w, s = ["start"] * (order - 1) + tokens(t), 0.0
        for j in range(order - 1, len(w)):
            p = 1 / (len(one) + 1)
            for k in range(1, order + 1):
                g = tuple(w[j - k + 1 : j + 1])
                if x := at[k].get(g[:-1]):
                    v = c[k].get(g, 0)
                    p = max(v - cut[k][min(v, 3)], 0) / x[0] + sum(cut[k][q] * x[q] for q in (1, 2, 3)) / x[0] * p
            s += math.log10(p)
        base = sum(math.log10((one[x] + 1) / (sum(one.values()) + len(one) + 1)) for x in tokens(t))
        out.append((s, base, len(tokens(t)), sum(one[x] > 0 for x in tokens(t)), sum(one.values())))
    return out


@pytest.mark.parametrize(("order", "hot", "fan"), [(2, 20, 256), (3, 1 << 60, 256), (3, 20, 2), (4, 20, 256)])
def test_language_model_against_brute_force(docs, corpus, order, hot, fan, monkeypatch):
    """Without and with frequent words, and with more buckets than a task deals to."""
    for name, value in (("BUCKET_TEXT_BYTES", 3000), ("BUCKET_WORD_BYTES", 10_000), ("HOT_TOKENS", hot), ("FAN", fan), ("FLUSH_TOKENS", 2000)):
        monkeypatch.setattr(ngram_lm, name, value)
    train = docs.filter(remainder("doc_id", 7) != 2)
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.train(train, order=order)).collect()}
    want = _kneser_ney([t for i, t in corpus if zlib.crc32(str(i).encode()) % 7 != 2], [t for _, t in corpus], order)
    for (i, _), (s, base, n, known, total) in zip(corpus, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.score - s) < 1e-8 and abs(r.base_score - base) < 1e-8


def test_language_model_edges(edges, none):
    model = ngram_lm.train(edges)
    got = ngram_lm.score(edges, model).collect()
    assert len(got) == 7 and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert ngram_lm.score(none, model).count() == 0
    assert all(r.score == 0 and r.train_tokens == 0 for r in ngram_lm.score(edges, ngram_lm.train(none)).collect())


def _targets(sizes, weights, share):
    """Water filling by bisection on the level."""
    budget = min(share * sum(sizes), 2 * sum(sizes))
    low, high = 0.0, max(2 * s / w for s, w in zip(sizes, weights))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) > budget else (mid, high)
    return [min(2 * s, low * w) for s, w in zip(sizes, weights)]


def test_mix_meets_targets(docs, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 5)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert {r.doc_id: r.size for r in got} == {i: len(WORD.findall(t)) for i, t in corpus}
    sources = sorted({r.source for r in got})
    sizes = [sum(r.size for r in got if r.source == s) for s in sources]
    for s, size, target in zip(sources, sizes, _targets(sizes, (3, 1, 2), 1.5)):
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == size and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2
    turns = mixing.mix(docs, sequence=True).orderBy("position").collect()
    assert [r.finish for r in turns] == sorted(r.finish for r in turns) and sum(r.words for r in turns) == sum(r.taken for r in got) == turns[-1].position


def test_mix_edges(edges, none, docs):
    got = mixing.mix(edges).collect()
    assert len(got) == 7 and sum(r.size == 0 for r in got) == 2
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(docs).collect()
    assert set(Counter(r.doc_id for r in out).values()) <= {1, 2} and mixing.mixed(edges).columns == edges.columns


def test_line_dedup_against_brute_force(docs, corpus):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    seen = set()
    for i, t in corpus:
        parts = t.split("\n")
        full = [k for k, p in enumerate(parts) if p.strip(" \t\n\x0b\x0c\r")]
        lines = [parts[k].strip(" \t\n\x0b\x0c\r") for k in full]
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        drop = {full[k] for k in gone}
        r = got[i]
        assert (r.n_lines, r.n_removed) == (len(lines), len(gone))
        assert r.clean_text == "\n".join(p for k, p in enumerate(parts) if k not in drop)
        assert [x for a, b in r.spans for x in range(a, b)] == sorted(gone)


def test_line_dedup_edges(edges, none):
    assert line_dedup.dedup_lines(edges, keep=("text_hash", "hit")).count() == 7 and line_dedup.dedup_lines(none).count() == 0


def test_chat_trees(spark):
    odd = "</s>[INST] \\ <\\|turn|> <|turn|>user\n<|end|>\n [\\\\/INST] 100%0A"
    rows = [(1, 1, None, "user", odd, 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", odd, 0.9), (1, 4, 3, "us%0Aer\n", None, 0.5), (1, 5, 4, "assistant", "deep", 0.7),
            (2, 1, 9, None, "orphan", None), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat_format.read_back(chat_format.format_trees(m, top_k=2)).collect()}
    assert set(got) == {(1, 5), (1, 2), (2, 1)}
    assert [tuple(t) for t in got[1, 5].turns] == [("user", odd), ("assistant", odd), ("us%0Aer\n", ""), ("assistant", "deep")]
    assert got[1, 5].loss_text == odd + "deep" and got[1, 2].loss_text == "low" and [tuple(t) for t in got[2, 1].turns] == [("", "orphan")]
    assert got[1, 5].formatted.count("<|turn|>") == 4
    best = chat_format.format_trees(m).filter("tree = 1").collect()
    assert [r.leaf for r in best] == [5]
    assert chat_format.format_trees(m.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs, corpus, edges, none, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "GROUP_TOKENS", 500)
    t = Tokenizer.from_file(token_files.tokenizer_path())
    files = token_files.write_tokens(docs, shared_folder(spark, "t"), metadata=("lang",))
    got = token_files.read_tokens(spark, files, ("lang",)).orderBy("doc_id").collect()
    start = 0
    for (i, text), r in zip(corpus, got, strict=True):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes())) and r.lang in ("en", "de")
        start += len(ids)
    for d, n in ((edges, 7), (none, 0)):
        assert token_files.read_tokens(spark, token_files.write_tokens(d, shared_folder(spark, "t"))).count() == n


def test_rules_learn_a_planted_rule(spark, docs, labels, edges, none):
    r = np.random.default_rng(0)
    x = {"a": r.random(3000), "b": r.random(3000), "c": r.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.4)) | (x["c"] > 0.95)
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3)
    hit = np.any([q.holds(x) for q in rules], axis=0)
    assert (hit & bad).sum() > 0.85 * bad.sum() and (hit & ~bad).sum() < 0.03 * bad.sum()
    assert quality_rules.learn_rules(quality_rules.statistics(none), labels) == []
    out = quality_rules.statistics(edges).withColumn("bad", quality_rules.base_failed()).collect()
    assert len(out) == 7 and all(q.bad for q in out)


def test_quality_classifier(spark, labels, edges, none):
    r = np.random.default_rng(4)
    word = lambda bad: "".join(r.choice(list("abcdefgh"), 5)) + ("###" if bad else "")
    rows = [(i, " ".join(word(i % 4 == 0) for _ in range(60)), "en", "bad.org" if i % 4 == 0 else "good.org") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_classifier.classify(d, labels).collect()
    assert all((q.p_good >= 0.5) == (q.doc_id % 4 != 0) for q in got)
    hosts = {rows[q.doc_id][3]: q.host_mean for q in got}
    assert hosts["bad.org"] < 0.3 < 0.7 < hosts["good.org"]
    assert quality_classifier.classify(edges, labels, keep=("doc_id", "hit")).count() == 7 and quality_classifier.classify(none, labels).count() == 0
    assert all(q.p_good > 0.5 for q in quality_classifier.classify(d, labels.limit(0)).collect())


def test_toxicity(spark, labels, edges, none):
    r = np.random.default_rng(6)
    vocabulary = ["".join(r.choice(list("abcdefgh"), 6)) for _ in range(500)]
    rows = []
    for i in range(600):
        w = list(r.choice(vocabulary, 80))
        if i % 5 == 0:
            for k in r.integers(0, 80, 3):
                w[k] = "vile" + str(r.integers(0, 9))
        rows.append((i, " ".join(w), i % 5 == 0))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(d, marks).collect()
    assert all(q.held_out == (zlib.crc32(str(q.doc_id).encode()) % 5 == 0) and 0 <= q.score <= 1 for q in got)
    assert sum(q.predicted == int(q.doc_id % 5 == 0) for q in got) >= 590
    vile = next(q for q in got if q.doc_id == 5)
    words = rows[5][1].split()
    assert any("vile" in words[k] for s in vile.segments for k in range(s.first, s.past))
    assert toxicity.score_toxicity(edges, labels).count() == 7 and toxicity.score_toxicity(none, labels).count() == 0
    assert all(q.score == 0 for q in toxicity.score_toxicity(edges, marks.limit(0)).collect())


def test_registered_queries_name_all_operators():
    from quarrylens.llm import registry

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_digests_of_the_chat_query(spark, tmp_path):
    spark.createDataFrame([(7, 0, "user", "a"), (7, 1, "assistant", "b\nc"), (None, 0, "assistant", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op5_chat_format(spark, str(tmp_path)).collect()}
    assert got[7].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nc\n").hexdigest() and got[7].loss_sha256 == hashlib.sha256(b"b\nc").hexdigest()
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 21 and got[None].loss_chars == 1
