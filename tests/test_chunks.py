"""Chunks of Markdown and JSON against what a reader would cut by hand."""

import json

from quarrylens.sources import chunks as C

MD = """intro
# Top
text a
## One
body
```
# not a heading
```
### Deep ###
deep body
## 2. Rules
2.1 First rule.
3.1 elsewhere
 2.2 Second rule.
| ID | Risk | ID |
|----|:----:|---|
| A-1 | high | x |
| B\\|2 | low |

| no | header |
# Other
#### Skipped
end"""
DATA = {"a": {"b": [1, {"c": None, "d e": "x"}, []], "t": True}, "n": 1.5, "s": "text", "o": {}}


def files(spark):
    return spark.createDataFrame([("doc/a.md", MD), ("b.MD", ""), ("n.md", None), ("x.json", json.dumps(DATA)), ("y.json", "{broken"), ("z.json", "[[1, 2], []]"), ("e.json", None)], "path string, content string")


def test_sections(spark):
    md = files(spark).filter("lower(path) like '%.md'")
    got = {tuple(r.headings): (r.level, r.first, r.last, r.text) for r in C.sections(md).collect()}
    assert {k: v[:3] for k, v in got.items()} == {("Top",): (1, 2, 20), ("Top", "One"): (2, 4, 10), ("Top", "One", "Deep ###"): (3, 9, 10), ("Top", "2. Rules"): (2, 11, 20), ("Other",): (1, 21, 23), ("Other", "Skipped"): (4, 22, 23)}
    assert got["Top", "One", "Deep ###"][3] == "deep body" and got["Other", "Skipped"][3] == "end"


def test_rows_and_paragraphs(spark):
    md = files(spark)
    assert [(r.heading, r.line, r.key, r.cells) for r in C.table_rows(md).orderBy("line").collect()] == [("2. Rules", 17, "A-1", {"ID": "A-1", "Risk": "high", "ID#3": "x"}), ("2. Rules", 18, "B\\|2", {"ID": "B\\|2", "Risk": "low"})]
    assert [(r.number, r.line, r.text) for r in C.paragraphs(md).orderBy("line").collect()] == [("2.1", 12, "First rule."), ("2.2", 14, "Second rule.")]


def test_json_keys(spark):
    got = {(r.path, r.key): r.value for r in C.json_keys(files(spark).filter("path like '%.json'")).collect()}

    def walk(v, key):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                yield from walk(x, f"{key}.{k}")
        elif isinstance(v, list) and v:
            for i, x in enumerate(v):
                yield from walk(x, f"{key}[{i}]")
        else:
            yield key, v if isinstance(v, str) else json.dumps(v)

    assert got == {("x.json", k): v for k, v in walk(DATA, "$")} | {("z.json", k): v for k, v in walk([[1, 2], []], "$")}


def test_all_chunks(spark):
    got = C.chunks(files(spark)).collect()
    assert len({r.id for r in got}) == len(got) and {r.kind for r in got} == {"section", "row", "paragraph", "key"}
    assert C.chunks(files(spark).limit(0)).count() == 0
