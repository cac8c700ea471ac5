"""Clashing names, repeated rows, ties, selective reads, and verdicts against plain Python."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylens.llm import decontaminate, jaccard_join, line_dedup, mixing, ngram_lm, quality_classifier, quality_rules, token_files, toxicity
from quarrylens.llm.common import kept, running_before, shared_folder

OWN = "copies mix_id mix_hash mix_copies one_id one_hash w_id w_hash m_id n_words n_lines p_good taken first n_tokens start again h score p_document text_hash hit key host path k0 c0 x cls band"


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like those that the operators make; repeated rows, ties, nulls and a long text."""
    names = OWN.split()
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "l one\nl two\nl three\nmore"), (3, "l one\nl two\nl three\nmore"), (4, None), (5, ""), (None, "z " * 40_000), (6, "L one")]
    rows = [(i, t, "en", f"s{k % 2}", None if t is None else len(t), *(f"{n}{k % 2}" for n in names)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))


def test_clashing_columns(spark, clashing, labels):
    n, every = clashing.count(), clashing.columns
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    assert mixing.mixed(clashing).columns == every and jaccard_join.keep_one(clashing).columns == every and jaccard_join.keep_one(clashing).count() == 6
    out = decontaminate.decontaminate(clashing, bench, keep=("n_words", "hit"))
    assert out.columns[:2] == ["_n_words", "hit"] and out.select("_n_words").first()[0].startswith("n_words") and out.count() == n
    assert line_dedup.dedup_lines(clashing, keep=("n_lines", "again", "h")).columns[1:4] == ["_n_lines", "again", "h"]
    assert quality_classifier.classify(clashing, labels, keep=("p_good", "x", "host")).columns[:3] == ["_p_good", "x", "host"]
    assert mixing.mix(clashing, carry=("taken", "copies")).columns[1:3] == ["_taken", "_copies"]
    files = token_files.write_tokens(clashing, shared_folder(spark, "t"), metadata=("first", "n_tokens", "lang", "start"))
    got = token_files.read_tokens(spark, files, ("first", "lang", "start"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "_first", "lang", "_start"] and {r._first for r in got.collect()} == {"first0", "first1"}
    model = ngram_lm.train(clashing)
    assert ngram_lm.score(clashing, model).count() == n and toxicity.score_toxicity(clashing, labels).count() == n and quality_rules.statistics(clashing).count() == n


def test_repeated_rows_are_later_occurrences(clashing):
    got = line_dedup.dedup_lines(clashing, keep=("n_chars",)).filter("doc_id = 3").collect()
    assert sorted(r.n_removed for r in got) == [0, 4] and sorted(r.clean_text for r in got) == ["", "l one\nl two\nl three\nmore"]


def test_sums_in_two_levels(spark):
    r = np.random.default_rng(2)
    rows = [(k, i, int(v)) for k in ("a", None) for i, v in enumerate(r.integers(0, 9, 200))]
    got = {(x.k, x.i): x.b for x in running_before(spark.createDataFrame(rows, "k string, i long, v long"), ("k",), "i", "v", "b", 16).collect()}
    for k in ("a", None):
        own = [v for q, _, v in rows if q == k]
        assert all(got[k, i] == sum(own[:i]) for i in range(200))


def test_selective_reads(spark, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP_TOKENS", 4000)
    r = np.random.default_rng(3)
    rows = [(i, " ".join("".join(r.choice(list("abcdefghijkl"), 7)) for _ in range(60)), f"lang{i % 3}") for i in range(1500)]
    folder = shared_folder(spark, "t")
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    token_files.write_tokens(d, folder, metadata=("lang",))

    import glob

    import pyarrow.parquet as pq

    # What the plans ask of the reader, and the bytes of the row groups whose statistics can hold the ids.
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, light = token_files.fetch(spark, folder, [700, 701, 9999]), token_files.token_table(spark, folder).select("doc_id", "lang")
    assert "EqualTo(doc_id,700)" in plan(few) and "ids" not in plan(light).split("ReadSchema")[1] and "lang" not in plan(few).split("ReadSchema")[1]
    every = held = ids = 0
    for f in glob.glob(f"{folder.removeprefix('file://')}/part-*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in (meta.row_group(k) for k in range(meta.num_row_groups)):
            size = sum(g.column(c).total_compressed_size for c in range(g.num_columns))
            low, high = g.column(0).statistics.min, g.column(0).statistics.max
            every, held = every + size, held + size * any(low <= i <= high for i in (700, 701))
            ids += sum(g.column(c).total_compressed_size for c in range(g.num_columns) if g.column(c).path_in_schema.startswith("ids"))
    assert held < 0.25 * every and every - ids < 0.25 * every and (few.count(), light.count()) == (2, 1500)
    t = token_files._tokenizer(token_files.tokenizer_path())
    got = {x.doc_id: x.ids for x in token_files.fetch(spark, folder, [3, 700]).collect()}
    assert got == {i: [*t.encode(rows[i][1], add_special_tokens=False).ids, 1] for i in (3, 700)}


def test_token_files_have_groups_indexes_and_encodings(spark, docs, none, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "GROUP_TOKENS", 500)
    folder = shared_folder(spark, "t")
    file = token_files.write_tokens(docs, folder).first().file.removeprefix("file://")
    meta = pq.ParquetFile(file).metadata
    for g in range(meta.num_row_groups):
        columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in columns.values()) and columns["doc_id"].statistics.has_min_max
        assert "DELTA_BINARY_PACKED" in columns["first"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert meta.row_group(g).num_rows == 1 or columns["ids.list.element"].num_values <= 500
    empty = token_files.write_tokens(none, shared_folder(spark, "t"), metadata=("lang",))
    assert token_files.read_tokens(spark, empty, ("lang",)).columns[-1] == "lang" and token_files.read_tokens(spark, empty).count() == 0


def test_site_posteriors_against_brute_force(spark, docs, labels):
    got = quality_classifier.classify(docs, labels).collect()
    rows = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    p = {r.doc_id: r.p_document for r in got}
    mean = float(np.clip(np.mean(list(p.values())), 1e-6, 1 - 1e-6))

    def sums(key):
        out = {}
        for i, v in p.items():
            out.setdefault(key(rows[i]), []).append(v)
        return out

    def strength(groups):
        k, n = len(groups), sum(map(len, groups.values()))
        within = sum(sum(v * v for v in g) - sum(g) ** 2 / len(g) for g in groups.values()) / (n - k)
        between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values())
        v = (between - (k - 1) * within) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
        return float(np.clip(mean * (1 - mean) / max(v, 1e-12) - 1, 1.0, 1e4))

    hosts, paths = sums(lambda x: x[0]), sums(lambda x: x)
    up, down = strength(hosts), strength(paths)
    logit = lambda x: math.log(x / (1 - x))
    clip = lambda x, e: min(max(x, e), 1 - e)
    for r in got:
        h, q = hosts[rows[r.doc_id][0]], paths[rows[r.doc_id]]
        host = (sum(h) - r.p_document + up * mean) / (len(h) - 1 + up)
        path = (sum(q) - r.p_document + down * host) / (len(q) - 1 + down)
        odds = logit(clip(r.p_document, 1e-9)) + logit(clip(path, 1e-6)) - logit(mean)
        assert abs(r.host_mean - host) < 1e-9 and abs(r.path_mean - path) < 1e-9 and abs(r.p_good - 1 / (1 + math.exp(-odds))) < 1e-9


def test_bins_as_an_expression(spark):
    r = np.random.default_rng(1)
    x = r.random((300, 3))
    model = quality_classifier.fit(x, (x[:, 0] + 0.3 * r.random(300)) > 0.6)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    assert np.allclose([v[0] for v in df.select(model.column("x")).collect()], model.log_odds(x))


def test_rule_verdicts_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(12)
    rows, marks = [], []
    for i in range(900):
        w = ["".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(int(r.integers(30, 120)))]
        bad = i % 5 == 0
        rows.append((i, " ".join(x + ("##" if bad else "") for x in w)))
        marks.append((i, int(not bad), 0))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rules = quality_rules.learn_rules(quality_rules.statistics(spark.read.parquet(f"{tmp_path}/documents.parquet")), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = {q.doc_id: q for q in quality_rules.op9_quality_rules(spark, str(tmp_path)).collect()}
    assert rules and any("symbols_per_word" in str(x) for x in rules)
    for i, t in rows:
        w = t.split()
        x = {"words": len(w), "chars_per_word": sum(map(len, w)) / len(w), "symbols_per_word": t.count("#") / len(w), "dup_line_share": 0.0, "repeat_share": got[i].n_repeat_words / len(w), "variety": math.log(len(set(w))) / math.log(len(w)), "words_per_line": len(w), "upper_share": 0.0, "digit_share": 0.0, "marks_per_word": 0.0, "longest_word": max(map(len, w))}
        first = next((k for k, q in enumerate(rules) if all((x[n] >= c) == at_least for n, at_least, c in q.conditions)), None)
        assert got[i].rule == first and got[i].base_failed == (len(w) < 50) and got[i].kept == (len(w) >= 50 and first is None)
    assert all(not got[i].kept for i in range(0, 900, 5))


def test_an_imprecise_rule_does_not_end_the_list():
    r = np.random.default_rng(5)
    n = 6000
    x = {"noise": r.random(n), "sure": r.random(n)}
    bad = (x["sure"] > 0.97) | ((x["noise"] > 0.5) & (r.random(n) < 0.5))
    rules = quality_rules.learn(x, bad, np.arange(n) % 3)
    assert any(all(c[0] == "sure" for c in q.conditions) for q in rules)


@pytest.mark.parametrize("rows", [[], [(9, None, None, None, None)] + [(1, "same text of six words here", "en", "a", 27)] * 3 + [(2, "same text of six words here", "en", "a", 27), (None, "w " * 50_000, None, None, 100_000), (3, "", "en", None, 0)]])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    """Empty tables, nulls in all columns, repeated rows, copies, a very long text, further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).withColumn("copies", F.lit(1)).withColumn("n_words", F.lit("x"))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, str(tmp_path)), shared_folder(spark, "odd"), name)
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert counts[0] == len(rows) and counts[1] == len({(r[0], r[1]) if not r[1] else r[1] for r in rows}) and counts[2] == counts[1] and counts[4] == counts[3]


def test_crc_of_ids(spark, docs):
    """ids_crc32 is of the ids as unsigned 32-bit integers."""
    folder = shared_folder(spark, "t")
    files = token_files.write_tokens(docs, folder)
    ids = {r.doc_id: r.ids for r in token_files.token_table(spark, folder).collect()}
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()) for r in token_files.read_tokens(spark, files).collect())
