"""Functions near in meaning: renamed and reordered copies are found, others aren't; against brute force over the same vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.operators import semantic as S
from quarrylens.operators import vector_index as V
from quarrylens.plans.index_queries import shared
from quarrylens.plans.signals import tables

A = "def load_user_profile(key):\n    rows = fetch(key)\n    total = 0\n    for row in rows:\n        if row.ok:\n            total += row.size\n    with open(key) as f:\n        f.write(str(total))\n    return total\n"
#: The same in another order and with other names.
B = "def load_user_profiles(name):\n    with open(name) as out:\n        out.write(str(name))\n    amount = 0\n    items = read(name)\n    for item in items:\n        if item.good:\n            amount += item.length\n    return amount\n"
C = "def parse(text):\n    try:\n        return {k: v for k, v in (x.split('=') for x in text.split(','))}\n    except ValueError:\n        raise KeyError(text)\n"
D = "class Q:\n    def visit(self, node):\n        while node:\n            node = node.next\n        assert node is None\n        del self.x\n"


@pytest.fixture(scope="module")
def functions(spark):
    files = [("src/a.py", A), ("src/b.py", B), ("src/c.py", C), ("src/d.py", D), ("src/e.py", A.replace("load_user_profile", "load_user_profile_again"))]
    df = spark.createDataFrame([(p, "python", len(c), c.count("\n") + 1, c) for p, c in files], "path string, language string, size_bytes long, line_count int, content string")
    return tables(df)["functions"].withColumn("key", F.concat_ws(":", "path", "name"))


def test_semantic_duplicates(spark, functions):
    got = {(r.a, r.b): r for r in S.semantic_duplicates(functions, "key", shared(spark, "t"), least=0.7, structural=0.9).collect()}
    a, b, e = "src/a.py:load_user_profile", "src/b.py:load_user_profiles", "src/e.py:load_user_profile_again"
    # Equal structure is left to the near duplicates; the reordered copy is found; unrelated ones aren't.
    assert set(got) == {(a, b), (b, e)} and all(r.structure < 0.9 for r in got.values())
    v = {r.key: np.array(r.vector) for r in S.hashed_vectors(functions, "key", S.function_features(functions)).collect()}
    cos = lambda x, y: v[x] @ v[y] / np.linalg.norm(v[x]) / np.linalg.norm(v[y])
    assert all(abs(r.similarity - cos(r.a, r.b)) < 1e-9 for r in got.values())
    assert [tuple(r)[:2] for r in S.semantic_duplicates(functions, "key", shared(spark, "t"), least=0.7, structural=0.9, cap=1).collect()] == [max(got, key=lambda k: (round(got[k].similarity, 6), -len(k[0])))]
    assert S.semantic_duplicates(functions.limit(0), "key", shared(spark, "t")).count() == 0


def test_index_is_loaded_and_extended(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    rows = [(i * 10 + j, [float(x) for x in base[i] + 0.05 * r.normal(size=16)]) for i in range(40) for j in range(10)] + [(9999, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    folder = shared(spark, "t")
    V.build_index(df.filter("id < 300 or id = 9999"), "id", "v", folder, lists=20)
    index = V.extend(V.load_index(spark, folder), df.filter("id >= 300 and id < 400"), "id", "v")
    assert sum(len(x.ids) for x in index.table(spark).collect()) == 400
    asked = df.filter("id % 20 = 0 and id < 400")
    found = V.search_index(index, asked, "id", "v", 9, least=2, most=3)
    x = np.array([v for _, v in rows[:-1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = {i: set(np.argsort(-(x[i] @ x.T))[1:10].tolist()) for i in range(0, 400, 20)}
    got = [(q.query, q.id) for q in found.collect()]
    assert sum(b in near[a] for a, b in got) >= 0.9 * sum(map(len, near.values())) and not any(a == b for a, b in got)
    assert V.probes(index, asked, "id", "v", least=2, most=3).groupBy("query").count().agg(F.max("count")).first()[0] <= 3
