"""TypeScript by tokens and brackets, the signals on it, cycles of any length, and kept findings against a sequential walk."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import dedup, graph
from quarrylens.plans import signals
from quarrylens.sources import typescript
from quarrylens.sources.records import flat

TS = r'''
import { A } from "./a";
/** Adds. */
export async function add<T extends { x: number }>(a: number, { b, c }: Opts = {}, ...rest: string[]): Promise<Map<string, { z: number }>> {
  // if (comment) {
  const s = `if ${a ? `x${b}` : "}"} {`;
  if (a && b || c) { for (const x of rest) { while (x) { y(); } } } else if (/[/{]+/.test(s)) { return null!; }
  do { a--; } while (a > 0);
  switch (a) { case 1: return; case 2: break; default: }
  p.catch(() => 1);
  return x as unknown as Foo;
}
export const mul = (a: number, b?: number): number => a * (b ?? 1);
const one = x => x + 1
const typed: Handler<string> = async (req, res) => {
  return res.send(req.body as any);
}
@Injectable({ scope: "x" })
export class Svc<T> extends Base<T> implements IFoo, ns.IBar {
  private readonly x: number = 1;
  constructor(private readonly dep: Dep, @Inject() public other?: Other) { super(); }
  /** gets */
  get value(): number { return this.x!; }
  @Get("/x")
  async find(id: string): Promise<any> { if (!id) { throw new Missing(id); } return this.dep.get(id)!.name; }
  handler = (e: Event) => { this.x = e ? 1 : 2; };
  static *gen() { yield 1; }
}
export interface Shape extends A, B<C> { area(): number; name?: string; readonly id: number }
type U = | "a"
  | "b";
// @ts-ignore
export default function () { return 1 }
'''
TSX = r'''
export const App = ({ items }: Props) => {
  const [a, setA] = useState<string>("");
  return (
    <div className="it's" onClick={() => { if (a) { go(); } }}>
      Don't {items.map(i => <Item key={i.id} {...i} />)} {a ? <b>yes {`${a} }`}</b> : null}
      <></>
    </div>
  );
};
function isOpen() { return <p>It's {`a${1}`}</p>; }
function isShut(a: number): boolean { return a > 1 && a !== 3 }
'''


def tree(spark, files):
    rows = [(p, "python" if p.endswith("py") else "typescript", len(c or ""), (c or "").count("\n") + 1, c) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, language string, size_bytes long, line_count int, content string")


def test_declarations(spark):
    d = typescript.declarations(tree(spark, {"a.ts": TS, "b.tsx": TSX, "c.ts": "", "d.ts": None, "e.ts": "function f( {"}))
    f = {(r.path, r.name): r for r in flat(d, "functions").collect()}
    want = {
        ("a.ts", "add"): (4, 12, 12, ["a", "{ b , c }", "rest"], 3, True), ("a.ts", "mul"): (13, 13, 2, ["a", "b"], 0, True), ("a.ts", "one"): (14, 14, 1, ["x"], 0, False), ("a.ts", "typed"): (15, 17, 1, ["req", "res"], 0, False),
        ("a.ts", "Svc.constructor"): (21, 21, 1, ["dep", "other"], 0, False), ("a.ts", "Svc.value"): (23, 23, 1, [], 0, False), ("a.ts", "Svc.find"): (24, 25, 2, ["id"], 1, False), ("a.ts", "Svc.handler"): (26, 26, 2, ["e"], 0, False), ("a.ts", "Svc.gen"): (27, 27, 1, [], 0, False),
        ("b.tsx", "App"): (2, 10, 3, ["{ items }"], 1, True), ("b.tsx", "isOpen"): (11, 11, 1, [], 0, False), ("b.tsx", "isShut"): (12, 12, 2, ["a"], 0, False),
    }
    assert {k: (r.line, r.end_line, r.complexity, r.parameters, r.nesting, r.exported) for k, r in f.items()} == want
    assert f["a.ts", "add"].has_docstring and f["a.ts", "Svc.value"].has_docstring and not f["a.ts", "mul"].has_docstring and f["a.ts", "add"].returns == "Promise < Map < string , { z : number } > >" and f["a.ts", "Svc.find"].decorators == ["Get"]
    assert f["a.ts", "Svc.find"].exceptions == ["Missing"] and f["a.ts", "Svc.find"].guarded and f["b.tsx", "isShut"].boolean and not f["b.tsx", "isOpen"].boolean
    t = {r.name: r for r in flat(d, "types").collect()}
    assert {n: (r.kind, r.line, r.end_line, r.bases, r.members, r.exported) for n, r in t.items()} == {
        "Svc": ("class", 18, 28, ["Base", "IFoo", "ns.IBar"], ["x", "constructor", "value", "find", "handler", "gen"], True), "Shape": ("interface", 29, 29, ["A", "B"], ["area", "name", "id"], True), "U": ("type", 30, 31, [], [], False),
    }
    assert t["Svc"].decorators == ["Injectable"]
    assert [(r.kind, r.line) for r in flat(d, "bypasses").orderBy("line", "kind").collect()] == [("non_null_assertion", 7), ("double_cast", 11), ("as_any", 16), ("non_null_assertion", 23), ("non_null_assertion", 25), ("ts_ignore", 32)]
    assert {r.path: r.error for r in d.collect()} == {"a.ts": None, "b.tsx": None, "c.ts": None, "d.ts": None, "e.ts": "UnbalancedBrackets"}


def test_signals_of_scripts(spark):
    sdk = 'import { test } from "@playwright/test";\nconst p = q as unknown as Page;\nif (!p._client) { throw new Error("x"); }\nclient.on!("x", f);\nconst z = y as any;\n'
    keys = '@app.get("/keys")\ndef publishable_key(a):\n    """The public key."""\n    return a\n@app.get("/users")\ndef users(a):\n    return a\n'
    marks = "\n".join("x = 1  # noqa" if i % 10 == 0 else "y = cast(int, x)  # type: ignore" if i % 25 == 1 else "z = 2" for i in range(60)) + "\ndef f(a) -> Any:\n    return a\n"
    t = signals.tables(tree(spark, {"a.ts": TS, "b.tsx": TSX, "s.ts": sdk, "x.test.ts": "const a = b as any;", "app/k.py": "import fastapi\n" + keys, "cli/serving/s.py": keys, "m.py": marks, "test_m.py": marks, "few.py": "x = 1  # noqa\n"}))
    got = {(r.signal, r.file_path, r.symbol): (r.score, r.detail) for r in signals.run(t, {"type_safety_bypass", "missing_authorization", "bypass_accumulation", "naming_contract_violation"}).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "type_safety_bypass"} == {"a.ts": (1.0, "as_any 1, double_cast 1, non_null_assertion 3, ts_ignore 1"), "s.ts": (0.2, "as_any 1, double_cast_sdk_guarded 1, non_null_assertion_sdk 1")}
    assert {k[1:]: v[0] for k, v in got.items() if k[0] == "missing_authorization" and k[1] != "a.ts"} == {("app/k.py", "publishable_key"): 0.35, ("app/k.py", "users"): 0.85}
    (m,) = (v for k, v in got.items() if k[0] == "bypass_accumulation")
    assert m == (1.0, "13 (lint 6, type_safety 7), median 0.2063")
    assert {k[1:] for k in got if k[0] == "naming_contract_violation"} == {("b.tsx", "isOpen")}


def brute_cycles(edges):
    out = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1] and b == path[0]:
                out.add(path)
            elif a == path[-1] and b > path[0] and b not in path:
                walk((*path, b))

    for a in {a for a, _ in edges}:
        walk((a,))
    return {p for p in out if len(p) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles(spark, seed):
    r = random.Random(seed)
    edges = {(r.randint(1, 8), r.randint(1, 8)) for _ in range(8)} | {(i, i % 8 + 1) for i in range(1, 9)} | {(8, 9), (9, 10), (5, 5)}
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    want = brute_cycles({e for e in edges if e[0] != e[1]})
    assert {tuple(x.path) for x in graph.cycles(df).collect()} == want and any(len(c) > 5 for c in want)
    assert {tuple(x.path) for x in graph.cycles(df, 4).collect()} == {c for c in want if len(c) <= 4}
    # For each edge on a cycle a shortest one, each set of nodes once.
    got = [tuple(x.path) for x in graph.edge_cycles(df).collect()]
    on = lambda e, c: e in {(c[i], c[(i + 1) % len(c)]) for i in range(len(c))}
    assert set(got) <= want and len({frozenset(c) for c in got}) == len(got)
    for e in edges:
        through = [c for c in want if on(e, c)]
        assert not through or any(on(e, c) or set(c) in [set(x) for x in through] for c in got if len(c) == min(map(len, through)))
    assert graph.cycles(df.filter("src > 100")).count() == 0 and graph.edge_cycles(df.filter("src > 100")).count() == 0


def walk(rows):
    """The sequential rule: ranked findings one by one."""

    def bits(title):
        words = [w for w in re.split("[^a-z0-9]+", (title or "").lower()) if w]
        votes = [0] * 64
        for w in words:
            h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
            votes = [v + (1 if h >> i & 1 else -1) for i, v in enumerate(votes)]
        return sum(1 << i for i, v in enumerate(votes) if v >= 0) if words else 0

    kept, out = [], {}
    for i, rule, file, a, b, title in rows:
        key, h = (rule, file, a or 0, b or 0, (title or "").strip().lower()), bits(title)
        same = [k for k in kept if k[1] == key]
        near = [(band, n, k[0]) for n, k in enumerate(kept) for band in range(4) if file and k[1][:2] == key[:2] and abs(k[1][2] - key[2]) <= 3 and (k[2] ^ h).bit_count() <= 3 and (k[2] >> 16 * band) & 65535 == (h >> 16 * band) & 65535]
        out[i] = same[0][0] if same else min(near)[2] if near else i
        if out[i] == i:
            kept.append((i, key, h))
    return out


def test_kept_findings(spark):
    r = random.Random(6)
    titles = ["Long function in module", "long function in module ", "Long function in module again", "Other", "", None]
    rows = [(i, r.choice("ab"), r.choice(("x.py", "y.py", None)), r.choice((None, *range(1, 25))), r.choice((None, 3, 9)), r.choice(titles)) for i in range(400)]
    # A chain: each near the next, in order of rank and against it.
    rows += [(1000 + k, "c", "chain.py", 1 + 3 * k, 2, "Same title") for k in range(9)] + [(2000 + k, "d", "chain.py", 30 - 3 * k, 2, "Same title") for k in range(9)]
    df = spark.createDataFrame(rows, "finding_id long, signal string, file_path string, start_line int, end_line int, title string").repartition(3)
    got = {x.finding_id: x.canonical for x in dedup.keep_first(df, F.col("finding_id")).collect()}
    want = walk(rows)
    assert got == want and len(set(want.values())) < len(rows)
    counts = {x.finding_id: x.duplicates for x in dedup.duplicate_counts(dedup.keep_first(df, F.col("finding_id"))).collect()}
    assert sum(counts.values()) == len(rows) and [k for k in range(1000, 1009) if k in counts] == [1000, 1002, 1004, 1006, 1008]
    assert dedup.keep_first(df.limit(0), F.col("finding_id")).count() == 0


def test_workspaces_and_aliases(spark):
    config = '{ // comment\n "compilerOptions": {"baseUrl": "./web", "paths": {"@app/*": ["src/app/*",], "cfg": ["./conf/index"], "none": []}, "url": "http://x//y"}, /* end */ }'
    files = {"package.json": '{"name": "root", "workspaces": {"packages": ["packages/*", "./tools/**", "a.b"]}}', "packages/one/package.json": '{"name": "@x/one"}', "packages/two/package.json": "{}", "packages/deep/in/package.json": '{"name": "no"}', "tools/a/b/package.json": '{"name": "t"}', "axb/package.json": '{"name": "no"}', "tsconfig.json": config}
    files |= {"packages/one/src/x.ts": "", "packages/one/y.tsx": "", "packages/two/z.ts": "", "tools/a/b/c/d.ts": "", "root.ts": "", "packages/deep/in/q.ts": ""}
    rows = [(p, "json" if p.endswith("json") else "typescript", len(c), 1, c) for p, c in files.items()]
    df = spark.createDataFrame(rows, "path string, language string, size_bytes long, line_count int, content string")
    assert typescript.aliases(df) == {"@app/": "web/src/app/", "cfg": "web/conf/index"} and typescript.aliases(df.limit(0)) == {}
    assert {r.folder: r.package for r in typescript.workspaces(df).collect()} == {"packages/one": "@x/one", "packages/two": "two", "tools/a/b": "t"}
    assert {r.path: r.package for r in typescript.packages_of_files(df).collect()} == {"packages/one/src/x.ts": "@x/one", "packages/one/y.tsx": "@x/one", "packages/two/z.ts": "two", "tools/a/b/c/d.ts": "t", "root.ts": None, "packages/deep/in/q.ts": None}
    listed = spark.createDataFrame([("package.json", "json", 1, 1, '{"workspaces": ["packages/*"]}'), ("packages/one/package.json", "json", 1, 1, "{}")], df.schema)
    assert typescript.workspaces(listed).count() == 1
