"""The checks of architecture and documentation on trees made by hand."""

from quarrylens.plans import signals


def table(spark, files):
    rows = [(p, "python" if p.endswith("py") else "markdown", len(c), c.count("\n") + 1, c) for p, c in files.items()]
    return signals.tables(spark.createDataFrame(rows, "path string, language string, size_bytes long, line_count int, content string"))


def found(t, name):
    return {(r.file_path, r.detail): r.score for r in signals.run(t, {name}).collect()}


def test_architecture(spark):
    body = "def f(a):\n    return a\n"
    files = {"core/base.py": body + "class A:\n    pass\n" + "x = 1\n" * 20, "core/abstract.py": "from abc import ABC\nclass B(ABC):\n    def g(self):\n        return 1\n", "core/small.py": body}
    for i in range(5):
        files[f"use/u{i}.py"] = f"import core.base\nimport core.abstract\nimport core.small\nimport use.u{(i + 1) % 5 if i < 4 else 9}\n{body}"
    files["lib/stable.py"] = "import lib.wild\n" + body
    files["lib/wild.py"] = "".join(f"import core.{m}\n" for m in ("base", "abstract", "small")) + "def h():\n    import torch.nn\n    return torch\n"
    for i in range(2):
        files[f"lib/by{i}.py"] = "import lib.stable\nimport torch\n" + body
    t = table(spark, files)
    t["policy"] = signals.policy(spark, boundaries=(("no-core", "use/u0.py", ("core/s*",)),), lazy=(("heavy", "**/*.py", ("torch",), True),))
    t["histories"] = spark.createDataFrame([("core/base.py", 9, 1, 0, 0.0), ("lib/wild.py", 1, 1, 0, 0.0)], "path string, commits_30d long, authors long, fixes long, tool_share double")
    pairs = [("use/u0.py", "lib/by0.py"), ("use/u0.py", "use/u1.py"), ("lib/by0.py", "lib/stable.py")]
    t["changes"] = spark.createDataFrame([(f"c{k}-{i}", p) for k, pair in enumerate(pairs) for i in range(4 - k) for p in pair], "hash string, path string")
    got = found(t, "architecture_violation")
    kinds = lambda start: {k[0]: v for k, v in got.items() if k[1].startswith(start)}
    assert kinds("denied by no-core") == {"use/u0.py": 0.8} and kinds("lazy by heavy") == {"lib/by0.py": 0.75, "lib/by1.py": 0.75}
    # Eight import core.base, through others too; it alone changes. Six or more make even a small file count.
    n = len(files)
    assert kinds("blast radius") == {"core/base.py": min(1.0, round((n - 3) / n * 0.8, 2))}
    assert kinds("zone of pain") == {"core/base.py": 0.7, "core/small.py": 0.7}
    assert kinds("unstable dependency") == {"lib/stable.py": round(0.75 * 0.6 + min(7 / 30, 2) * 0.2, 2)}
    assert kinds("changes with") == {"lib/by0.py": 0.47}
    assert not found(table(spark, {"a.py": body}), "architecture_violation")


def test_docs(spark):
    readme = "`core/` [x](./web/) `gone/sub/` `v1.2/` https://x.y/`no/` `api/`"
    old = "---\nid: 1\nstatus: Superseded\n---\n`dead/`"
    files = {"README.md": readme, "core/a.py": "", "src/api/b.py": "", ".web/c.py": "", "misc/d.py": "", "tests/t.py": "", "docs/adr/1.md": "## Status\n\nAccepted\n\n`lost/` `core/`", "docs/adr/2.md": old, "docs/other/3.md": "`away/`"}
    assert found(table(spark, files), "stale_docs") == {("README.md", "gone/sub"): 0.3, ("docs/adr/1.md", "lost"): 0.4, ("misc", "not in the README"): 0.15, ("src", "not in the README"): 0.15}
    assert found(table(spark, {"a.py": "", "b.py": ""}), "stale_docs") == {("", "no README"): 0.4} and not found(table(spark, {"p/__init__.py": "", "q/__init__.py": ""}), "stale_docs")
