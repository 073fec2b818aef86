"""Top-k search against brute force, with one block of requests and with many."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filigree.operators import retrieval as Q
from filigree.operators import terms as W
from filigree.operators import topk
from filigree.plans import standins as D


def brute_vectors(vectors, requests, k):
    out = {}
    for q, companies, a in requests:
        scored = []
        for c, ticker, b in vectors:
            if not companies or ticker in companies:
                x, y = np.array(a, float), np.array(b, float)
                norm = np.linalg.norm(x) * np.linalg.norm(y)
                scored.append((-round(float(x @ y / norm) if norm else 0.0, 6), c))
        out[q] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.fixture(params=["one block", "blocks"])
def way(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(topk, "BLOCK_REQUESTS", 4)
        monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCK_CELLS", 50)
    return request.param


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, f"T{i % 3}", [round(float(x), 3) for x in rng.normal(size=4)]) for i in range(30)]
    # A third of the rows are copies, so ties are decided by id; one vector is zero.
    rows += [(100 + i, "T0", rows[0][2]) for i in range(15)]
    return [*rows, (99, "T1", [0.0] * 4)]


@pytest.mark.parametrize("k", [4, 20])
def test_knn(spark, way, k):
    corpus = vectors()
    requests = [(i, [None, [], ["T0"], ["T1", "T2"], ["none"]][i % 5], corpus[i][2]) for i in range(11)]
    v = spark.createDataFrame(corpus, "chunk_id long, ticker string, embedding array<float>").repartition(5)
    v = v.unionByName(spark.createDataFrame([(500, "T0", None)], v.schema))
    r = spark.createDataFrame(requests, "query_id long, companies array<string>, embedding array<float>")
    rows = Q.knn_search(v, r, k).orderBy("query_id", "rank").collect()
    got = {}
    for row in rows:
        got.setdefault(row.query_id, []).append(row.chunk_id)
        assert row.rank == len(got[row.query_id])
    assert got == {q: ids for q, ids in brute_vectors(corpus, requests, k).items() if ids}


def brute_terms(chunks, requests, k):
    def count(text):
        return Counter(re.findall(r"[^\W_]+", text.lower()))

    n = len(chunks)
    df = Counter(t for _, _, text in chunks for t in count(text))
    def idf(t):
        return math.log((n + 1) / (df[t] + 1)) + 1

    def unit(text):
        w = {t: c * idf(t) for t, c in count(text).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    out = {}
    for q, text, companies in requests:
        a = unit(text)
        scored = []
        for c, ticker, body in chunks:
            if not companies or ticker in companies:
                b = unit(body)
                s = round(sum(x * b.get(t, 0.0) for t, x in a.items()), 6)
                if s > 0:
                    scored.append((-s, c))
        out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("known", [20_000, 2])
def test_lexical(spark, way, monkeypatch, known):
    monkeypatch.setattr(W, "HOT_TERMS", known)
    monkeypatch.setattr(topk, "DENSE_TERMS", 2)
    words = "the risk of revenue growth été market the the share cloud device".split()
    rng = np.random.default_rng(3)
    chunks = [(f"c{i:02d}", f"T{i % 3}", " ".join(rng.choice(words, size=rng.integers(1, 12)))) for i in range(40)]
    chunks += [("x1", "T0", "!!! 12 a"), *[(f"y{i}", "T1", "the same copy") for i in range(20)]]
    requests = [("q0", "The RISK of growth", None), ("q1", "Été market unseen", []), ("q2", "the", ["T1"]),
                ("q3", " \n ", None), ("q4", "nothing known", None), ("q5", "cloud device share", ["T0", "T2"]), ("q6", "the", None)]
    c = spark.createDataFrame(chunks, "chunk_id string, ticker string, content string").repartition(4)
    r = spark.createDataFrame(requests, "query_id string, query string, companies array<string>")
    got = {}
    for row in Q.lexical_search(Q.term_index(c), r, 3).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.chunk_id, row.score))
    wanted = {q: hits for q, hits in brute_terms(chunks, requests, 3).items() if hits}
    assert {q: [c for c, _ in h] for q, h in got.items()} == {q: [c for c, _ in h] for q, h in wanted.items()}
    for q, hits in wanted.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in hits], abs=1e-6)


def test_company_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    v = spark.createDataFrame(vectors(), "chunk_id long, ticker string, embedding array<float>")
    v.write.partitionBy("ticker").parquet(path)
    stored = spark.read.parquet(path)
    r = spark.createDataFrame([(1, ["T1"], [1.0, 0.0, 0.0, 0.0])], "query_id long, companies array<string>, embedding array<float>")
    plan = Q.knn_search(stored, r, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*ticker#\d+.*dynamicpruning", plan)
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_companies_are_normalized(spark):
    df = spark.createDataFrame([("A", 1, ["B"])], "s string, n int, a array<string>")
    row = df.select(*[Q.normalize_companies(F.col(c), t).alias(c) for c, t in df.dtypes]).first()
    assert (row.s, row.n, row.a) == (["A"], None, ["B"])


def test_rare_sums_equal_broadcast_sums(spark, sf_dir, monkeypatch):
    counted = W.counted_terms(D.table(spark, sf_dir, "documents"), ["doc_id"], "text")
    words = W.vocabulary(counted)
    first = {r.doc_id: (r.mean_idf, r.norm) for r in W.idf_sums(counted, ["doc_id"], words, ["the"]).collect()}
    monkeypatch.setattr(W, "HOT_TERMS", 50)
    second = {r.doc_id: (r.mean_idf, r.norm) for r in W.idf_sums(counted, ["doc_id"], words, ["the"]).collect()}
    assert first.keys() == second.keys()
    for key, sums in first.items():
        assert second[key] == pytest.approx(sums)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_broken_vectors_take_no_place(spark, k):
    rows = [(1, "T", [1.0, 0.0]), (2, "T", [1.0, None]), (3, "T", [float("nan"), 1.0]), (4, "T", [0.5, 0.5]), (5, "T", None)]
    v = spark.createDataFrame(rows, "chunk_id long, ticker string, embedding array<double>")
    r = v.select(F.col("chunk_id").alias("query_id"), F.lit(None).cast("array<string>").alias("companies"), "embedding")
    got = {}
    for row in Q.knn_search(v, r, k).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.chunk_id)
    assert got == {1: [1, 4][:k], 4: [4, 1][:k]}


def test_unequal_lengths_fail(spark):
    v = spark.createDataFrame([(1, "T", [1.0, 0.0, 2.0]), (2, "T", [1.0])], "chunk_id long, ticker string, embedding array<double>")
    r = spark.createDataFrame([(1, None, [1.0, 2.0])], "query_id long, companies array<string>, embedding array<double>")
    with pytest.raises(Exception, match="another length"):
        Q.knn_search(v, r, 1).collect()


def test_terms_of_every_script(spark):
    chunks = [("a", "T", "Umsatz 2023 und έσοδα"), ("b", "T", "revenue 2022 売上高"), ("c", "T", "x")]
    c = spark.createDataFrame(chunks, "chunk_id string, ticker string, content string")
    asked = [("1", "2023 revenue?", None), ("2", "ΈΣΟΔΑ", None), ("3", "売上高", None), ("4", "X", None)]
    r = spark.createDataFrame(asked, "query_id string, query string, companies array<string>")
    got = {}
    for row in Q.lexical_search(Q.term_index(c), r, 3).collect():
        got.setdefault(row.query_id, set()).add(row.chunk_id)
    assert got == {"1": {"a", "b"}, "2": {"a"}, "3": {"b"}, "4": {"c"}}


def test_one_table_for_both_routes(spark):
    from filigree.plans.ask import ask
    from filigree.schemas import CHUNKS

    meta = lambda t: (t, t, "10-K", "2023", "1", "Risk Factors", 0)
    chunks = spark.createDataFrame([("c1", "supply risk grows", meta("A")), ("c2", "cloud sales", meta("B"))], CHUNKS).withColumn(
        "ticker", F.col("metadata.ticker"))
    rows = [("q1", 1, "supply risk", ["A"]), ("q2", 2, "supply of both", ["A", "B"]), ("q3", 3, "cloud of both", ["A", "B"]), ("q4", 4, "zzz", None)]
    requests = spark.createDataFrame([(*r, r[0] == "q3") for r in rows],
                                     "query_id string, conv_id long, query string, companies array<string>, no_trace boolean")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, content string")
    asked = ask(Q.term_index(chunks), requests, messages)
    answers = spark.createDataFrame([(r[0], f"answer {r[0]}") for r in rows], "query_id string, answer string")
    none = spark.createDataFrame(
        [], "query_id string, step_no int, tool string, results array<struct<content:string,metadata:struct<company:string,ticker:string,"
            "filing_type:string,date:string,accession_number:string,section:string,chunk_index:int>>>")
    got = {r.query_id: r for r in asked.responses(answers, steps=none).collect()}
    assert set(got) == {"q1", "q2", "q3", "q4"}
    assert [c.ticker for c in got["q1"].citations] == ["A"]
    assert not got["q2"].citations and {c.company for c in got["q3"].citations} == {"A", "B"}
    assert {r.route for r in asked.prompts.filter("query_id in ('q2', 'q3')").collect()} == {"agent"}


def _search_table(rng, n, **columns):
    values = pa.array(rng.normal(size=n * 8).astype(np.float32))
    return pa.table({**columns, "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 8, pa.int32()), values)})


@pytest.mark.parametrize("companies", [None, ["T1"]])
def test_few_pairs_are_scored_exactly(monkeypatch, companies):
    """Only scores that can still be hits are looked at, and pairs that a company filter hides are never scored."""
    rng, n, m, tested, seen = np.random.default_rng(2), 50, 4_000, [], []

    class Counted(topk.VectorScorer):
        def scores(self, batch):
            seen.append(len(self.vectors) * batch.num_rows)
            return super().scores(batch)

        def exact(self, line, at):
            tested.append(len(line))
            return super().exact(line, at)

    monkeypatch.setattr(topk, "BLOCK_CELLS", 20_000)
    asked = _search_table(rng, n, query_id=pa.array(range(n)), companies=pa.array([companies] * n, pa.list_(pa.string())))
    rows = _search_table(rng, m, chunk_id=pa.array(range(m)), ticker=pa.array([f"T{i % 4}" for i in range(m)]))
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("ticker", pa.string()), ("score", pa.float64())])
    found = topk._score(asked, rows, Counted, 3, schema).to_pylist()
    a, b = (topk._matrix(topk._plain(t["embedding"]), 8) for t in (asked, rows))
    places = range(m) if companies is None else range(1, m, 4)
    wanted = [(q, c) for q in range(n) for c in sorted(places, key=lambda c: (-round(float(a[q] @ b[c]), 6), c))[:3]]
    assert [(r["query_id"], r["chunk_id"]) for r in found] == wanted
    assert sum(seen) == n * len(places) and sum(tested) < n * m / 50


def test_term_scores_are_single_and_hits_double():
    """All pairs in single precision, one line a row; rows a millionth apart are still told apart."""
    rng = np.random.default_rng(4)
    weights = [rng.random(40) + 0.1 for _ in range(6)]
    words = [f"w{i}" for i in range(40)]
    asked = pa.table({"query_id": [f"q{i}" for i in range(6)], "companies": pa.array([None] * 6, pa.list_(pa.string())),
                      "terms": [words] * 6, "weights": [(w / np.linalg.norm(w)).tolist() for w in weights]})
    counts = [np.ones(40) + np.where(np.arange(40) == i % 40, 2e-5 * i, 0) for i in range(200)]
    rows = pa.table({"chunk_id": [f"c{i:03d}" for i in range(200)], "ticker": ["T"] * 200, "terms": [words[::-1]] * 200,
                     "counts": [c[::-1].tolist() for c in counts], "norm": [float(np.linalg.norm(c)) for c in counts]})
    rows = topk.TermScorer.prepare(rows)
    kernel = topk.TermScorer(asked)
    scores = kernel.scores(rows.combine_chunks().to_batches()[0])
    assert scores.dtype == np.float32 and scores.shape == (200, 6)
    schema = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("ticker", pa.string()), ("score", pa.float64())])
    kth = np.full(6, np.finfo(float).min)
    found = topk._score(asked, rows, topk.TermScorer, 3, schema, kth).to_pylist()
    for i, w in enumerate(weights):
        exact = sorted((-round(float(w / np.linalg.norm(w) @ c / np.linalg.norm(c)), 6), f"c{j:03d}") for j, c in enumerate(counts))[:3]
        assert [(-r["score"], r["chunk_id"]) for r in found if r["query_id"] == f"q{i}"] == exact
    # A later run of a task hands on only what reaches the k-th best so far.
    worse = rows.set_column(4, "norm", pa.array([1e3] * 200))
    assert topk._score(asked, worse, topk.TermScorer, 3, schema, kth).num_rows == 0


@pytest.mark.parametrize(("k", "companies"), [(1, None), (3, None), (3, ["T1"]), (400, None), (3, "some")])
def test_lists_find_what_the_scan_finds(monkeypatch, k, companies):
    """Many requests meet posting lists: no pair is scored by the scan, and the hits are those of brute force in any run."""
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(300)])
    falling = 1 / np.arange(1, 301)
    half = np.where(np.arange(300) % 2 == 0, falling, falling / 50)

    def texts(n, size):
        return [sorted(set(rng.choice(words, rng.integers(1, size), p=(p := half if i % 2 else half[::-1]) / p.sum()).tolist())) for i in range(n)]

    def table(lists, **columns):
        flat = rng.integers(1, 4, sum(map(len, lists))).astype(float)
        cut = np.split(flat, np.cumsum([len(x) for x in lists])[:-1])
        return cut, pa.table({**columns, "terms": pa.array(lists, pa.list_(pa.string()))})

    asked_terms = [*texts(60, 12), ["unknown"], ["w0"], []]
    weights, asked = table(asked_terms, query_id=[f"q{i:02d}" for i in range(63)])
    weights = [w / np.linalg.norm(w) if len(w) else w for w in weights]
    lists = [None if companies is None else ["T1"] if companies == ["T1"] or i % 3 == 0 else [] if i % 3 == 1 else ["T0", "T2"] for i in range(63)]
    asked = asked.append_column("companies", pa.array(lists, pa.list_(pa.string()))).append_column("weights", pa.array(weights, pa.list_(pa.float64())))
    row_terms = texts(700, 40)
    row_terms[50:90] = [row_terms[50]] * 40  # ties
    row_terms[5] = []
    counts, rows = table(row_terms, chunk_id=[f"c{i:03d}" for i in range(700)], ticker=[f"T{i % 4}" for i in range(700)])
    counts[50:90] = [np.ones(len(row_terms[50]))] * 40
    norms = [float(np.linalg.norm(c)) for c in counts]
    rows = rows.append_column("counts", pa.array(counts, pa.list_(pa.float64()))).append_column("norm", pa.array(norms))
    for name, value in (("LISTED_REQUESTS", 1), ("GROUP_ROWS", 60), ("FREQUENT", 8), ("CENTRE_TERMS", 40), ("LINE_CELLS", 2_000), ("LIST_CELLS", 3_000),
                        ("EXACT_PAIRS", 100), ("FIRST_ROWS", 10)):
        monkeypatch.setattr(topk, name, value)
    monkeypatch.setattr(topk.TermScorer, "scores", lambda self, batch: pytest.fail("scored by the scan"))
    schema = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("ticker", pa.string()), ("score", pa.float64())])
    kth = np.full(63, np.finfo(float).min)
    found = [h for start in (0, 300, 600) for h in topk._score(
        asked, topk.TermScorer.prepare(rows.slice(start, 300).combine_chunks()), topk.TermScorer, k, schema, kth).to_pylist()]
    by_row = [dict(zip(t, c / n)) for t, c, n in zip(row_terms, counts, norms)]
    for i, names in enumerate(asked_terms):
        scored = [(-round(sum(w * by_row[j][t] for t, w in zip(names, weights[i]) if t in by_row[j]), 6), f"c{j:03d}")
                  for j in range(700) if set(names) & by_row[j].keys() and (not lists[i] or f"T{j % 4}" in lists[i])]
        got = sorted((-h["score"], h["chunk_id"]) for h in found if h["query_id"] == f"q{i:02d}")[:k]
        assert [c for _, c in got] == [c for _, c in sorted(scored)[:k]]


def test_lists_look_at_few_rows(monkeypatch):
    """Rows that share only frequent terms with a request are bounded, not multiplied out, and none of them is scored exactly."""
    n, exact = 20_000, []
    terms = [["the", "of", f"rare{i % 1000}", f"own{i}"] for i in range(n)]
    rows = pa.table({"chunk_id": [f"c{i:05d}" for i in range(n)], "ticker": ["T"] * n, "terms": terms,
                     "counts": [[0.2, 0.2, 1.0, 1.0]] * n, "norm": [1.5] * n})
    asked = pa.table({"query_id": [f"q{i}" for i in range(2000)], "companies": pa.array([None] * 2000, pa.list_(pa.string())),
                      "terms": [["the", "of", f"rare{i % 1000}"] for i in range(2000)], "weights": [[0.1, 0.1, 0.99]] * 2000})
    scored = topk.TermLists._exact
    monkeypatch.setattr(topk, "FREQUENT", 2)
    monkeypatch.setattr(topk.TermLists, "_exact", lambda self, pair, at, asked: exact.append(len(at)) or scored(self, pair, at, asked))
    schema = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("ticker", pa.string()), ("score", pa.float64())])
    kth = np.full(2000, np.finfo(float).min)
    met = topk.Met(topk.TermScorer.prepare(rows), topk.TermScorer)
    assert topk._found(met, asked, 3, schema, kth).num_rows == 6000
    exact.clear()
    assert topk._found(met, asked, 3, schema, kth).num_rows == 6000
    assert sum(exact) == 20 * 2000  # of 40,000,000 pairs


def test_scores_of_vectors_take_no_new_place():
    """Every batch of a run is scored in the same memory; flags are read in words, wherever they stand."""
    rng = np.random.default_rng(8)
    asked = _search_table(rng, 5, query_id=pa.array(range(5)), companies=pa.array([None] * 5, pa.list_(pa.string())))
    batches = _search_table(rng, 90, chunk_id=pa.array(range(90))).combine_chunks().to_batches(max_chunksize=40)
    kernel = topk.VectorScorer(asked)
    first = kernel.scores(batches[0])
    wanted = kernel.rows @ kernel.vectors.T
    assert first == pytest.approx(wanted, abs=1e-5)
    assert np.shares_memory(first, kernel.scores(batches[1])) and kernel.scores(batches[2]).shape == (10, 5)
    for n in (0, 1, 7, 8, 9, 100):
        flags = rng.random(n) < 0.2
        assert topk._places(flags).tolist() == np.flatnonzero(flags).tolist()


@pytest.mark.parametrize("rows", [1, 10**9])
def test_a_sample_gives_the_first_kth_best(spark, monkeypatch, rows):
    """Blocks of requests know the k-th best score of a sample, ties, zero vectors and company filters included; the hits stay."""
    monkeypatch.setattr(topk, "SAMPLED_ROWS", rows)
    monkeypatch.setattr(topk, "SHARE", 2)
    corpus, asked = vectors(), []
    stored = topk._stored
    monkeypatch.setattr(topk, "_stored", lambda *args: asked.append(stored(*args)) or asked[-1])
    requests = [(i, [None, [], ["T0"], ["T1", "T2"], ["none"]][i % 5], corpus[i][2]) for i in range(11)]
    v = spark.createDataFrame(corpus, "chunk_id long, ticker string, embedding array<float>").repartition(3)
    r = spark.createDataFrame(requests, "query_id long, companies array<string>, embedding array<float>")
    got = {}
    for row in Q.knn_search(v, r, 4).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.chunk_id)
    assert got == {q: ids for q, ids in brute_vectors(corpus, requests, 4).items() if ids}
    blocks = spark.read.parquet(asked[0][1])
    assert ("kth" in blocks.columns) == (rows == 1)
    assert rows > 1 or blocks.where("kth > -1").count() > 5
