"""The interaction audit against plain Python and SQL, and its carry-save counts against shifts."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np

from lamella.llm import interaction, queries


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). Applies every order document by document."""
    ids = defaultdict(list)
    for d, t, _ in docs:
        ids[t or ""].append(d)
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for d, t, lang in docs:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        own["E"] = d is not None and any(x is not None and x < d for x in ids[text])
        fails.append((lang or "", {k for k, v in own.items() if v}, d in good, d in toxic))
    out, total = {}, defaultdict(int)
    for part in {f[0] for f in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            every = left
            for step, k in enumerate(order, 1):
                gone, left = [f for f in left if k in f[1]], [f for f in left if k not in f[1]]
                redundant = sum(k in f[1] for f in every) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(f[1] == {k} for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                total[part, k] += len(gone)
    return {key: (*v, total[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_positional_popcount():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 7, 100, 4097):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert interaction.positional_popcount(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


def test_whole_table(spark, sf):
    rows = lambda t, c: duckdb.sql(f"select {c} from '{sf}/{t}.parquet'").fetchall()
    assert found(queries.op11_interactions(spark, sf)) == brute(rows("documents", "doc_id, text, lang"), rows("labels", "doc_id, quality, toxic"))


def test_oracle(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = con.execute(interaction.ORACLE).df(), queries.op11_interactions(spark, sf).toPandas()
    key = ["part", "filter_order", "step"]
    assert want.sort_values(key)[sorted(want)].values.tolist() == got.sort_values(key)[sorted(got)].values.tolist()


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    docs = [(1, None, None), (2, "", ""), (3, long, "en"), (3, long, "en"), (4, long, "en"), (None, long, "en"), (None, "X#", "en"), (5, "word " * 200_000, "de"), (6, "ÄÖ " * 250 + "ABC|", "de"), (-1, long, "fr"), (7, "\x1c \xa0a", "fr")]
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (4, None, 1), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, lang string, mask int, part int, __doc int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(interaction.filter_interactions(frame, known)) == brute(docs, labels)
    none = found(interaction.filter_interactions(frame, known.limit(0)))
    assert none == brute(docs, [])
    assert interaction.filter_interactions(frame.limit(0), known).count() == 0
