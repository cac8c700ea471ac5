import datetime
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from quarrylens.plans import signals
from quarrylens.sources import records, saved, sinks, typescript


def test_typescript_imports_and_graph(spark):
    files = {
        "web/packages/a/src/x.ts": "import { one, two as b } from './y'\nimport type { T } from '@app/t'\nimport 'side'\n// import z from './no'\nconst q = 1\nexport { three } from './lib'\n",
        "web/packages/a/src/y.ts": "import { one } from '../../b/src/index'\n",
        "web/packages/a/src/lib/index.ts": "export { three, four } from './deep'\n",
        "web/packages/a/src/lib/deep.ts": "import { x } from '../x'\n",
        "web/packages/b/src/index.ts": "export { one } from './one'\n",
        "web/packages/b/src/one.ts": "export const one = 1\n",
        "web/src/t.ts": "",
        "web/ui/page.tsx": "import { q } from '../db/q'\n",
        "web/db/q.ts": "",
        "x.py": "import os\n",
    }
    rows = [(p, records.LANGUAGES[p.rsplit(".", 1)[1]], len(c), c.count("\n") + 1, c) for p, c in files.items()]
    df = spark.createDataFrame(rows, "path string, language string, size_bytes long, line_count int, content string")
    i = {(r.path, r.module): r for r in typescript.imports(df).collect()}
    x = "web/packages/a/src/x.ts"
    assert i[x, "./y"].names == ["one", "two"] and i[x, "./y"].line == 1 and i[x, "@app/t"].names == ["T"] and i[x, "./lib"].reexport and i[x, "./lib"].line == 6 and (x, "side") in i and (x, "./no") not in i
    g = {(r.src, r.dst) for r in typescript.import_graph(df, {"@app/": "web/src/"}).collect()}
    a = "web/packages/a/src/"
    assert {(x, a + "y.ts"), (x, "web/src/t.ts"), (x, a + "lib/deep.ts"), (a + "y.ts", "web/packages/b/src/one.ts"), (a + "lib/deep.ts", x), ("web/ui/page.tsx", "web/db/q.ts")} <= g
    found = {(r.file_path, r.detail.split(":")[0]) for r in signals.run({"files": df}, {"ts_architecture"}).collect()}
    assert ("web/ui/page.tsx", "infrastructure") in found and (a + "y.ts", "other package") in found and any(d.startswith("cycle of") for _, d in found)


def test_commit_index(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 3, d)
    rows = lambda *x: spark.createDataFrame([(h, t(d)) for h, d in x], "hash string, ts timestamp")
    got = lambda df: sorted(r.hash for r in df.collect())
    path = f"{tmp_path}/index"
    assert got(saved.index_commits(spark, path, rows(("a", 1), ("b", 2), ("b", 2)), ancestor=True, as_of=t(3))) == ["a", "b"]
    assert got(saved.index_commits(spark, path, rows(("b", 2), ("c", 20)), ancestor=True, as_of=t(21), window_days=19)) == ["b", "c"]
    assert spark.read.parquet(path).count() == 3
    assert got(saved.index_commits(spark, path, rows(("z", 9)), ancestor=False, as_of=t(10))) == ["z"]
    merges = spark.createDataFrame([("m1", "dependabot[bot]", "x", t(5), 2, True), ("m2", "Ann", "x\n\nCo-authored-by: Claude <c>", t(6), 2, True), ("m3", "Bob", None, t(7), 2, True), ("m4", "Bob", "", t(8), 1, True), ("m5", "Bob", "", t(8), 2, False)], "hash string, author string, message string, ts timestamp, n_parents int, on_main boolean")
    assert [(r.hash, r.author_class) for r in saved.recent_merges(merges, t(9), limit=2).collect()] == [("m3", "human"), ("m2", "assisted")] and saved.recent_merges(merges, t(9)).count() == 3


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor Ann\nauthor-mail <ann@x>\nauthor-time 1700000000\nsummary s\nfilename f\n\tone\n{a} 2 2\n\ttwo\n{b} 1 3 1\nauthor Bob\nauthor-mail <bob@x>\nauthor-time 1700000100\nfilename f\n\t\n"
    got = saved.blame(spark.createDataFrame([("f", text)], "path string, value string")).orderBy("line").collect()
    assert [(r.line, r.author, r.email, r.text) for r in got] == [(1, "Ann", "ann@x", "one"), (2, "Ann", "ann@x", "two"), (3, "Bob", "bob@x", "")]
    r = saved.blame_ranges(spark.createDataFrame([("f", 3, 5), ("f", 9, 9)], "file_path string, start_line int, end_line int"), 3).first()
    assert (r["first"], r["last"]) == (1, 12)


def test_snapshots_trend_baseline_analysis(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for k, ts in enumerate(("2024-02-01T00:00:00Z", "2024-01-01T00:00:00Z")):
        (tmp_path / f"s/{k}.json").write_text(json.dumps({"ts": ts, "commit": f"c{k}", "score": 0.5, "findings": [{"signal": "x", "file_path": "f", "line": 1, "score": 0.3, "fingerprint": "p"}]}, indent=1))
    (tmp_path / "s/bad.json").write_text("{")
    assert [r.commit for r in saved.snapshots(spark, f"{tmp_path}/s").collect()] == ["c1", "c0"]
    (tmp_path / "t.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","score":0.1,"n_findings":3}\n{"ts":"2024-01-02T00:00:00Z","score":0.2,"n_findings":4}\nbroken\n')
    runs, broken = saved.trend(spark, f"{tmp_path}/t.jsonl")
    assert broken and runs.count() == 2
    saved.save_trend(runs, f"{tmp_path}/t2", 1)
    again, broken = saved.trend(spark, f"{tmp_path}/t2")
    assert not broken and [r.score for r in again.collect()] == [0.2]
    (tmp_path / "b1.json").write_text('{"version":1,"fingerprints":["a","b","a"]}')
    (tmp_path / "b2.json").write_text('{"version":2,"findings":[{"fingerprint":"c","fingerprint_v1":"a"},{"fingerprint":"d"}]}')
    assert sorted(r[0] for r in saved.baseline(spark, f"{tmp_path}/b1.json").collect()) == ["a", "b"] and sorted(r[0] for r in saved.baseline(spark, f"{tmp_path}/b2.json").collect()) == ["a", "c", "d"]
    (tmp_path / "a.json").write_text(json.dumps({"findings": [{"fingerprint": "p", "score": 0.1, "file_path": "f"}, {"fingerprint": "p", "score": 0.4, "file_path": "g"}, {"fingerprint": "q", "score": 0.2}]}))
    assert {r.fingerprint: r.score for r in saved.analysis(spark, f"{tmp_path}/a.json").collect()} == {"p": 0.4, "q": 0.2}


def test_decisions(spark):
    rows = [("d/one.md", "---\nid: ADR-1\nstatus: Accepted\nscope: [src/api/**, src/db]\n---\n# Use rows\n"), ("d/two.md", "---\nstatus: accepted\nscope:\n  - lib/**\n---\n# About caching\n"), ("d/three.md", "---\nstatus: superseded\nscope: src/api\n---\n"), ("d/none.md", "# no\n")]
    d = saved.decisions(spark.createDataFrame([(p, "markdown", c) for p, c in rows], "path string, language string, content string"))
    assert {r.id: r.scopes for r in d.collect()} == {"ADR-1": ["src/api/**", "src/db"], "two": ["lib/**"], "three": ["src/api"]}
    assert [(r.id, r.why) for r in saved.relevant_decisions(d, ["src/api/x.py"], "improve caching").collect()] == [("ADR-1", "scope"), ("two", "task")]


def test_queue_and_graph(spark, tmp_path):
    t = "2024-01-01T00:00:00Z"
    rows = [("a", "claim", "w1", t, 1), ("a", "done", "w1", t, 2), ("b", "claim", "w1", t, 3), ("c", "claim", "w1", "2024-01-01T00:59:00Z", 4), *(("d", "claim", "w", t, 5 + k) for k in range(4))]
    saved.append_json(spark.createDataFrame(rows[:3], "task string, event string, worker string, ts string, seq long"), f"{tmp_path}/log")
    saved.append_json(spark.createDataFrame(rows[3:], "task string, event string, worker string, ts string, seq long"), f"{tmp_path}/log")
    e = saved.replay(spark, f"{tmp_path}/log")
    assert [r.seq for r in e.collect()] == list(range(1, 9))
    s = {r.task: (r.state, r.worker) for r in saved.queue_state(e, datetime.datetime(2024, 1, 1, 1)).collect()}
    assert s == {"a": ("done", None), "b": ("open", None), "c": ("claimed", "w1"), "d": ("failed", None)}
    v, w = spark.createDataFrame([("m",)], "node string"), spark.createDataFrame([("m", "n")], "src string, dst string")
    assert saved.load_graph(spark, f"{tmp_path}/graph") is None
    saved.save_graph(v, w, f"{tmp_path}/graph")
    assert [df.count() for df in saved.load_graph(spark, f"{tmp_path}/graph")] == [1, 1]
    now = datetime.datetime(2024, 1, 1)
    fresh = lambda **k: saved.baseline_is_fresh(now, "h", "s", k.pop("n", 3), now=now + datetime.timedelta(seconds=k.pop("age", 9)), saved_head=k.pop("head", "h"), saved_stash="s", saved_changed=k.pop("had", 3))
    assert fresh() and not fresh(age=901) and not fresh(head="x") and not fresh(n=11) and fresh(n=30, had=12)
    files = spark.createDataFrame([("CLAUDE.md",), ("a.py",)], "path string")
    assert [r.tool for r in saved.tool_indicators(files).collect()] == ["claude"]


def test_report_files(spark, tmp_path):
    f = spark.createDataFrame([("s<1>", 0.9, "a.py", "g", 3, 'say "no" & go'), ("s2", 0.3, "b.py", None, None, None), ("s2", 0.5, "c.py", None, 7, "x")], "signal string, score double, file_path string, symbol string, line int, detail string")
    suites = [ET.fromstring(r.value) for r in sinks.junit(f).collect()]
    assert sorted((s.get("name"), s.get("failures"), len(s)) for s in suites) == [("s2", "2", 2), ("s<1>", "1", 1)]
    assert next(s for s in suites if s.get("name") == "s<1>")[0][0].get("message") == 'say "no" & go'
    e = json.loads(sinks.envelope(f).first().value)
    assert e["schema_version"] == "2.2" and e["total"] == 3 and [x["score"] for x in e["findings"]] == [0.9, 0.5, 0.3] and e["severity_counts"]["critical"] == 1
    sinks.sarif(f, f"{tmp_path}/sarif")
    s = json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/sarif").collect()))
    assert s["version"] == "2.1.0" and len(s["runs"][0]["results"]) == 3 and [r["id"] for r in s["runs"][0]["tool"]["driver"]["rules"]] == ["s2", "s<1>"]
    sinks.write_csv(f, f"{tmp_path}/csv")
    c = spark.read.csv(f"{tmp_path}/csv", header=True)
    assert c.columns == ["signal", "severity", "score", "title", "file", "start_line", "end_line", "impact"] and [r.file for r in c.collect()] == ["a.py", "c.py", "b.py"]
    runs = spark.createDataFrame([("r", "b", datetime.datetime(2024, 1, 2), 0.5, 2), ("r", "a", datetime.datetime(2024, 1, 1), 0.4, 1)], "repo string, commit string, ts timestamp, score double, n_findings long")
    saved.timeline(runs, f"{tmp_path}/time")
    assert [(r.commit, r.delta) for r in spark.read.csv(f"{tmp_path}/time", header=True).collect()] == [("a", None), ("b", "0.1")]


def test_signals_over_history(spark):
    """Signals that need commits or an earlier version of the sources."""
    old = "def f(a):\n    raise ValueError(a)\n\ndef g(a):\n    return a\n"
    new = "def f(a):\n    raise KeyError(a)\n\ndef g(a):\n    return a\n"
    files = lambda x: spark.createDataFrame([(p, "python", len(c), c.count("\n"), c) for p, c in x.items()], "path string, language string, size_bytes long, line_count int, content string")
    now = signals.tables(files({"src/a/x.py": new, "src/b/y.py": "import pandas\nimport os\n", "src/b/z.py": "import os\n", "src/c/q.py": ""}))
    now["functions_before"] = signals.tables(files({"src/a/x.py": old}))["functions"]
    now["first_commits"] = spark.createDataFrame([("src/a/x.py", False), ("src/b/y.py", True), ("src/b/z.py", False)], "path string, recent boolean")
    now["commits"] = spark.createDataFrame([(f"h{k}", False, k == 7) for k in range(8)], "hash string, is_merge boolean, is_automated boolean")
    now["changes"] = spark.createDataFrame([(f"h{k}", p) for k in range(8) for p in ("src/a/x.py", "src/b/y.py")] + [("h0", "src/b/z.py")], "hash string, path string")
    now["histories"] = spark.createDataFrame([(f"f{k}", 30.0 if k == 0 else 1.0, 9 if k == 0 else 1, 5 if k == 0 else 0, 0.5) for k in range(12)], "path string, commits_30d double, authors int, fixes int, tool_share double")
    got = {(r.signal, r.file_path): (r.score, r.detail) for r in signals.run(now, {"exception_contract_divergence", "system_misalignment", "co_change_coupling", "temporal_volatility"}).collect()}
    assert got["exception_contract_divergence", "src/a"] == (1.0, "1") and got["system_misalignment", "src/b"] == (0.25, "pandas")
    assert got["co_change_coupling", "src/a/x.py"][1] == "src/b/y.py" and abs(got["co_change_coupling", "src/a/x.py"][0] - 0.79) < 1e-9
    assert [p for s, p in got if s == "temporal_volatility"] == ["f0"] and 0 < got["temporal_volatility", "f0"][0] <= 1


def test_logs_count_without_other_columns(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"signal":"s"}\nbad\n')
    assert records.feedback_log(spark, f"{tmp_path}/x.jsonl").count() == 1 and records.feedback_log(spark, f"{tmp_path}/x.jsonl").filter(F.col("signal") == "s").count() == 1
