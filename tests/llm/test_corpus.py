"""Near-duplicates, language-model scores, toxicity and the pipeline against plain Python and planted cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lamella.llm import components, line_dedup, media, mixing, near_dedup, packing, quality, queries, scoring, token_counts, token_files, toxicity
from lamella.llm.common import materialise, shared_path
from lamella.llm.tokens import BYTE_BPE

WORD = re.compile(r"[^ \t-\r]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def shingles(text):
    words = WORD.findall((text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute_classes(docs, similarity=0.8):
    """Classes by the longest common subsequence of shingle sequences, all pairs with a shingle in common."""
    seq = {d: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for d, t in docs.items() if (w := WORD.findall((t or "").lower()))}
    sets = {d: set(s) for d, s in seq.items()}
    pairs = []
    ids = sorted(seq)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.3 * max(len(sets[a]), len(sets[b])):
                x, y = seq[a], seq[b]
                row = [0] * (len(y) + 1)
                for u in x:
                    last = 0
                    for j, v in enumerate(y, 1):
                        keep = row[j]
                        row[j] = last + 1 if u == v else max(row[j], row[j - 1])
                        last = keep
                m = row[-1]
                if m / (len(x) + len(y) - m) >= similarity:
                    pairs.append((a, b))
    return roots(pairs, docs)


def changed(words, rng, n):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(i, f"more{rng.randrange(10**6)}")
        elif len(out) > 30:
            del out[i]
    return out


@pytest.fixture(scope="module")
def planted():
    """Unrelated texts, near copies of some at several distances, a chain, a large group, a common passage."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [text(rng.randrange(30, 250)) for _ in range(60)]
    for base in docs[:20]:
        docs += [changed(base, rng, n) for n in (1, 2, 4)]
    chain = text(200)
    for _ in range(8):
        chain = changed(chain, rng, 3)
        docs.append(chain)
    big = text(150)
    docs += [changed(big, rng, rng.randrange(1, 4)) for _ in range(90)]
    passage = text(120)
    docs += [passage + text(60) for _ in range(70)]
    docs += [docs[3]] * 5
    rng.shuffle(docs)
    return {i: " ".join(d) for i, d in enumerate(docs)} | {1000: "", 1001: None, 1002: "", 1003: "two words", 1004: "two words", 1005: "Two Words"}


def test_near_duplicates(spark, planted):
    frame = spark.createDataFrame([(k, v) for k, v in planted.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == brute_classes(planted)


def test_near_duplicates_of_short_texts(spark):
    """No pair of short texts is missed, with a word more at an end or words changed, down to a similarity of exactly 0.8."""
    rng = random.Random(12)
    new = lambda: f"u{rng.randrange(10**9)}"
    docs, passage = [], [new() for _ in range(12)]
    for n in range(1, 50):
        for i in range(6):
            base = [new() for _ in range(n)]
            docs += [base, base + [new()] * (1 + i % 2) if i < 4 else [new(), *base]]
            docs += [base[: n // 2] + [new()] + base[n // 2 + 1 :]] if n > 40 else []
        docs += [passage + [new() for _ in range(n % 9)] for _ in range(3)]
    chain = [new() for _ in range(12)]
    docs += [chain[: 8 + i] for i in range(5)] + [[*chain, "x", "y"], [*chain, "y", "x"]]
    docs = {i: " ".join(d) for i, d in enumerate(docs)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(frame).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_whole_table(spark, sf):
    docs = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, sf).collect()}
    assert got == brute_classes(docs)


def test_near_duplicates_cases(spark):
    rows = [(1, "a b c d e f g", "s", "x", 1), (1, "a b c d e f g", "s", "x", 1), (None, "a b c d e f g", "s", "x", 1), (2, None, "s", "x", 0), (3, "", None, None, 0), (4, "long word " * 40_000, "s", "x", 5), (5, "long word " * 40_000, "s", "x", 5)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = near_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 2, 3, 4])
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_similarity_is_exact():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, rng.integers(2, 3000), n).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 1 + n // 6))):
            i = int(rng.integers(0, len(b)))
            b = np.insert(b, i, 10**6 + i) if rng.random() < 0.5 or len(b) < 2 else np.delete(b, i)
        row = [0] * (len(b) + 1)
        for u in a.tolist():
            last = 0
            for j, v in enumerate(b.tolist(), 1):
                keep = row[j]
                row[j] = last + 1 if u == v else max(row[j], row[j - 1])
                last = keep
        want = row[-1] / (len(a) + len(b) - row[-1])
        got = near_dedup.similarity(a, b)
        assert got == pytest.approx(want) if want >= near_dedup.KNOWN else got < near_dedup.KNOWN


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, i) for i in range(501, 900)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == roots(links, nodes | {x for p in links for x in p}) or got == {k: v for k, v in roots(links, {x for p in links for x in p}).items() if k in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_scores(docs, alpha=0.4):
    words = {i: WORD.findall(t or "") for i, t in docs}
    n = sum(map(len, words.values()))
    u = Counter(w for ws in words.values() for w in ws)
    ctx = Counter(w for ws in words.values() for w in ws[:-1])
    p = Counter(x for ws in words.values() for x in zip(ws, ws[1:]))
    out = {}
    for i, ws in words.items():
        own, s = Counter(zip(ws, ws[1:])), 0.0
        for j, w in enumerate(ws):
            if not j:
                s += math.log(u[w] / n)
            elif p[ws[j - 1], w] > own[ws[j - 1], w]:
                s += math.log((p[ws[j - 1], w] - own[ws[j - 1], w]) / ctx[ws[j - 1]])
            else:
                s += math.log(alpha * u[w] / n)
        out[i] = s
    return out


def test_scores(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("a b c d".split()) if rng.random() < 0.5 else f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "x " * 70_000), (1003, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for size in (100, 5_000_000):
        got = {r.doc_id: r.log_score for r in scoring.score_documents(frame, bucket_words=size).collect()}
        want = brute_scores(docs)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert scoring.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_oracle(spark):
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{where}/documents.parquet'")
    want = con.execute(queries.ORACLES["op5_scoring"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op5_scoring(spark, where).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    assert want.astype(str).equals(got.astype(str))


def dense_votes(index, examples, asked, k, smooth, same):
    """Votes by plain cosines with all examples, in the index's order; `same`: asked are the examples, each without itself."""
    size = len(index.features)

    def unit(c):
        v = np.zeros(size)
        for f, n in zip(*c):
            v[f] = (1 + math.log(n)) * index.idf[f]
        return v / (np.linalg.norm(v) or 1)

    own = sorted(((unit(e[:2]), e) for e in examples if len(e[0])), key=lambda x: (int(x[1][0][np.argmax(index.vector(*x[1][:2]))]), x[1][2]))
    matrix = np.array([v for v, _ in own])
    toxic = np.array([e[2] for _, e in own], float)
    out = []
    for i, c in enumerate([e[:2] for _, e in own] if same else asked):
        cosine = np.round(matrix @ unit(c), 6)
        if same:
            cosine[i] = 0
        at = np.lexsort((np.arange(len(cosine)), -cosine))[:k]
        at = at[cosine[at] > 0]
        out.append(((cosine[at] @ toxic[at] + smooth * index.rate) / (cosine[at].sum() + smooth), np.sort(cosine[at])[::-1]))
    return out


def test_nearest_is_exact(monkeypatch):
    """Cosines of the k nearest, with dense and listed features, many blocks, and votes, equal those of plain vectors."""
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = random.Random(1)
    some = lambda most: sorted(rng.sample(range(300), rng.randrange(0, most)))
    examples = []
    for _ in range(700):
        ids = sorted(set(some(12)) | {f for f in range(6) if rng.random() < 0.5})
        examples.append((np.array(ids, np.int64), np.array([rng.randrange(1, 4) for _ in ids], np.int64), rng.randrange(2)))
    index = toxicity.Index([f"f{i}#1" for i in range(300)], np.where(np.arange(300) % 7, np.arange(300) + 1.0, 900.0), 1000)
    index.fit(examples, 7, 0.5)
    assert 0 < len(index.dense) < 300 and index.blocks > 8
    asked = [e[:2] for e in examples if len(e[0])][:300]
    at, cosine = index.nearest([(i, index.vector(i, c)) for i, c in asked])
    got = index.votes(at, cosine)
    for i, (vote, want) in enumerate(dense_votes(index, examples, asked, 7, 0.5, False)):
        assert np.allclose(cosine[i][: len(want)], want, atol=3e-6)
        assert len(want) == (at[i] >= 0).sum()


def test_blocks_are_passed_over(monkeypatch):
    """Where examples have clusters, most postings of a query's features lie in blocks that its bound rules out."""
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = random.Random(2)
    examples = []
    for c in range(40):
        for _ in range(64):
            ids = sorted({1000 + 10 * c + rng.randrange(10) for _ in range(6)} | {rng.randrange(300) for _ in range(12)})
            examples.append((np.array(ids, np.int64), np.array([1 + 8 * (i >= 1000) for i in ids], np.int64), c % 2))
    index = toxicity.Index([f"f{i}#1" for i in range(1400)], np.where(np.arange(1400) < 300, 2500.0, 60.0), 3000)
    index.fit(examples, 5, 0.5)
    asked = [e[:2] for e in examples[::7]]
    every = sum(int((index.starts[i + 1] - index.starts[i]).sum()) for i, _ in asked)
    index.touched = 0
    at, cosine = index.nearest([(i, index.vector(i, c)) for i, c in asked])
    assert 0 < index.touched < 0.5 * every
    for i, (vote, want) in enumerate(dense_votes(index, examples, asked, 5, 0.5, False)):
        assert np.allclose(cosine[i][: len(want)], want, atol=3e-6)


def test_toxicity_brute_force(spark, sf):
    """Scores of the whole table by plain dense vectors over the same examples."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {d: y for d, y in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall() if zlib.crc32(str(d).encode()) % 3 != 1}
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    index = toxicity.learn(docs, labels)
    reader = toxicity.Reader(index.features)
    words = {d: set(re.findall(r"[^\W\d_]+", (t or "").lower())) for d, t in texts.items()}
    known = set().union(*(words[d] for d in truth if d in words))
    assert known == {f.removesuffix("#1") for f in index.features if f.endswith("#1") and "*" not in f}
    for f in random.Random(3).sample(sorted(known), 60):
        i = index.features.index(f"{f}#1")
        share = (1 + len(texts)) / (1 + sum(f in w for w in words.values()))
        assert index.idf[i] == pytest.approx(math.log(share) + 1)
    examples = sorted(((*reader.counts(texts[d] or ""), y) for d, y in truth.items() if d in texts), key=lambda e: (e[0].tobytes(), e[1].tobytes(), e[2]))
    own = np.array([v for v, _ in dense_votes(index, examples, [], index.k, index.smooth, True)])
    order = sorted(((index.vector(*e[:2]), e) for e in examples if len(e[0])), key=lambda x: (int(x[1][0][np.argmax(x[0])]), x[1][2]))
    curve = index.calibration(own, np.array([e[2] for _, e in order], float))
    asked = {d: reader.counts(t or "") for d, t in texts.items()}
    votes = dict(zip(asked, dense_votes(index, examples, list(asked.values()), index.k, index.smooth, False)))
    got = {r.doc_id: r.score for r in queries.op10_toxicity(spark, sf).collect()}
    for d, (vote, near) in votes.items():
        want = float(np.clip(np.interp(vote, *curve), 0, 1)) if len(near) else index.base
        assert got[d] == pytest.approx(want, abs=2e-3), d


def test_toxicity_held_out(spark):
    """Of held-out toxic rows four of five are found in every language, and next to no clean ones."""
    where = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, where).toPandas()
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{where}/labels.parquet'").fetchall())
    langs = dict(duckdb.sql(f"select doc_id, lang from '{where}/documents.parquet'").fetchall())
    out = got[got["held_out"] & got["doc_id"].isin(list(truth))]
    y, lang = out["doc_id"].map(truth), out["doc_id"].map(langs)
    found = out["predicted"][y == 1].groupby(lang[y == 1]).agg(["mean", "size"])
    assert len(found) == 4 and (found["mean"] >= 0.8).all() and found["size"].sum() > 100
    assert out["predicted"][y == 0].mean() <= 0.01
    assert got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, "bad bad words here" if i % 3 == 0 else "fine words here", "s", "en", 1) for i in range(120)] + [(None, "bad bad", None, None, 0), (200, None, None, None, 0), (201, "", None, None, 0), (202, "fine " * 100_000, None, None, 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert got[0] > 0.7 and got[1] < 0.3 and got[None] > 0.7 and got[200] < 0.3 and got[202] < 0.3
    assert toxicity.toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "packing":
            assert sorted(docs.columns) == sorted(before.columns), name
    assert docs.count() > 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    judged = {r.doc_id: r.kept for r in queries.op6_quality(spark, sf).collect()}
    assert {r.doc_id for r in stages["quality rules"](spark, docs, sf).collect()} == {d for d, k in judged.items() if k}
    classes = {r.doc_id: r.class_id for r in queries.op2_near_duplicates(spark, sf).collect()}
    assert sorted(r.doc_id for r in stages["near duplicates"](spark, docs, sf).collect()) == sorted(set(classes.values()))
    mixed = Counter(r.doc_id for r in stages["mixing"](spark, docs, sf).collect())
    for r in queries.op3_mixing(spark, sf).collect():
        assert abs(mixed[r.doc_id] - r["taken"] / max(1, r["size"])) <= 0.5
    tokens = defaultdict(int)
    for r in stages["packing"](spark, docs, sf).collect():
        tokens[r.doc_id] += r.length
    assert len(tokens) == docs.count()


def test_pipeline_brute_force(spark, sf):
    """Every stage on what the one before kept, odd rows among them, against plain Python."""
    odd = [(None, "an odd row " * 30, "en", None, 330, 1), (None, "an odd row " * 30, "en", None, 330, 2), (9_000_001, None, None, "web", 0, 3), (9_000_002, "", "en", "web", 0, 4), (9_000_003, "long text of many words here " * 9000, "en", "web", 261_000, 5)]
    odd += [(9_000_010 + i, " ".join(f"word{(i * 7 + j) % 97}x{j % 13}" for j in range(60 + i)) + "\nthis line is shared by all of them", "de", "books", 1, i) for i in range(6)] * 2
    base = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    docs = base.withColumn("__doc", F.lit(0)).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, __doc int"))
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: df.collect()

    kept = materialise(stages["quality rules"](spark, docs, sf), "t1")
    judged = quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert Counter(r.doc_id for r in rows(kept)) == Counter(r.doc_id for r in rows(judged) if r.kept)

    lined = materialise(stages["line dedup"](spark, kept, sf), "t2")
    low = lambda d: -(1 << 63) if d is None else d
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for r in rows(kept):
        for k in {key(x) for x in (r.text or "").split("\n")}:
            holders[k].append(low(r.doc_id))
    goes = lambda x, d: len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) > d
    want = Counter((r.doc_id, "\n".join(x for x in (r.text or "").split("\n") if not goes(x, low(r.doc_id)))) for r in rows(kept))
    assert Counter((r.doc_id, r.text) for r in rows(lined)) == want

    single = materialise(stages["near duplicates"](spark, lined, sf), "t3")
    every = sorted({(low(r.doc_id), r.text) for r in rows(lined)})
    found = brute_classes(dict(enumerate(t for _, t in every)))
    assert Counter((low(r.doc_id), r.text) for r in rows(single)) == Counter(every[i] for i in {min(j for j in found if found[j] == root) for root in set(found.values())})

    mixed = materialise(stages["mixing"](spark, single, sf), "t4")
    times = Counter(r.doc_id for r in rows(mixed))
    taken = {r.doc_id: r for r in rows(mixing.mix(single, mixing.quality_weights(spark.read.parquet(f"{sf}/labels.parquet"))))}
    assert all(abs(times[d] - r["taken"] / r["size"]) <= 0.5 for d, r in taken.items() if r["size"])
    assert mixed.columns == docs.columns

    tokens = Counter()
    for r in rows(stages["packing"](spark, mixed, sf)):
        tokens[r.doc_id] += r.length
    fresh, want = Tokenizer.from_file(BYTE_BPE), Counter()
    for r in rows(mixed):
        want[r.doc_id] += len(fresh.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert tokens == want


def written_tokens(docs):
    path = shared_path(docs.sparkSession, "clash")
    token_files.write_tokens(docs, path)
    return token_files.checksums(token_files.read_tokens(docs.sparkSession, path))


@pytest.mark.parametrize("apply", [
    lambda d, k: near_dedup.near_duplicates(d), lambda d, k: near_dedup.keep_one(d), lambda d, k: scoring.score_documents(d), lambda d, k: toxicity.toxicity(d, k),
    lambda d, k: token_counts.length_counts(d), lambda d, k: line_dedup.dedup_lines(d), lambda d, k: mixing.mix(d), lambda d, k: quality.judge(d, k),
    lambda d, k: packing.pack_along_curve(d), lambda d, k: media.page_features(media.read_pages(media.stored_texts(d))), lambda d, k: written_tokens(d),
], ids=["classes", "one", "scores", "toxicity", "lengths", "lines", "mix", "quality", "pack", "media", "tokens"])
def test_clashing_columns(spark, apply):
    """Columns with the operators' own names, null ids, null and repeated texts: nothing breaks, and no row is lost."""
    names = ["__id", "__t", "__own", "__gone", "id", "t", "n", "w", "bucket", "key", "length", "size", "u", "weight", "h1", "score", "toxic", "row", "__doc"]
    rows = [(None, "some words that are here " * 9, "s", *range(len(names))), (1, None, None, *range(len(names))), (1, "some words that are here " * 9, "s", *range(len(names)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{x} int" for x in names))
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert apply(docs, known).count() > 0
    assert apply(docs.limit(0), known).count() == 0

