import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlytics.llm import factor as M
from spanlytics.llm.common import read
from tests.llm.conftest import invented

SF = "/root/testdata/sf0.01"


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    model = M.FactorModel.blank(np.sort(rng.normal(0, 2, (len(M.STATS), M.BINS - 1)), axis=1))
    return M.FactorModel(0.3, rng.normal(0, 0.5, len(model.weights)), rng.normal(0, 0.5, model.factors.shape), model.edges)


def test_score_is_the_sum_over_all_pairs():
    model = small_model()
    for text, declared in (("a b c A1 b.", 4), ("", 0), (None, None), ("Ünï cödé ## 12\nline two\nline two", 99)):
        stats, at, x = M.vector_of(text, declared)
        at, x = model.complete(stats, at, x)
        plain = model.bias + sum(model.weights[i] * v for i, v in zip(at, x))
        for i in range(len(at)):
            for j in range(i):
                plain += float(model.factors[at[i]] @ model.factors[at[j]]) * x[i] * x[j]
        assert M._sigmoid(plain) == pytest.approx(model.score(text, declared))


def test_vector_against_a_plain_count():
    text = "One two two. THREE!! \n four two 55 $$\n\nfour two 55 $$"
    stats, at, x = M.vector_of(text, 60)
    got = dict(zip(M.STATS, stats))
    assert got["words"] == pytest.approx(np.log1p(12)) and got["exclamations"] == pytest.approx(2 / 12)
    assert got["repeated_lines"] == pytest.approx(1 / 3) and got["distinct_words"] == pytest.approx(7 / 12)
    assert got["repeated_runs"] == pytest.approx(1 / 9) and got["length_gap"] == pytest.approx(np.log1p(60 - len(text)))
    words = text.lower().split()
    want = {}
    for w in set(words):
        h = zlib.crc32(w.encode()) % M.WORDS
        want[h] = want.get(h, 0) + words.count(w)
    block = {a: v for a, v in zip(at.tolist(), x.tolist()) if a < M.WORDS}
    norm = np.sqrt(sum(np.log1p(v) ** 2 for v in want.values()))
    assert block == pytest.approx({k: np.log1p(v) / norm for k, v in want.items()})


def test_gradient_against_differences():
    model = small_model(2)
    rows = [(i % 2, *M.vector_of(" ".join(invented(i, 12, 30)), 50)) for i in range(6)]
    g = M.gradient(model, rows)
    rng = random.Random(3)
    used = np.flatnonzero(g[1 : 1 + len(model.weights)]).tolist()
    for i in rng.sample(used, 5):
        for change in ("weights", "factors"):
            losses = []
            for eps in (1e-5, -1e-5):
                other = M.FactorModel(model.bias, model.weights.copy(), model.factors.copy(), model.edges)
                if change == "weights":
                    other.weights[i] += eps
                else:
                    other.factors[i, 3] += eps
                losses.append(M.gradient(other, rows)[-1])
            own = g[1 + i] if change == "weights" else g[1 + len(model.weights) + i * M.FACTORS + 3]
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(own, abs=1e-5)
    assert g[-2] == 6
    parts = M.gradient(model, rows[:2]) + M.gradient(model, rows[2:])
    assert parts == pytest.approx(g)


def test_pairs_are_learned(spark):
    """Neither of two words alone tells the label; together they do."""
    rows = []
    for i in range(400):
        one, two = i % 2, i // 2 % 2
        rows.append((i, f"{'left' if one else 'right'} {'up' if two else 'down'}", 8, int(one == two)))
    model = M.fit(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, quality int"), passes=60)
    assert all((model.score(t, n) > 0.5) == bool(y) for _, t, n, y in rows)


def test_held_out_accuracy(spark):
    rows = M.op11_quality_classifier(spark, SF).collect()
    docs = read(spark, SF, "documents").count()
    truth = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    assert len(rows) == docs
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, _, t in held) / len(held) > 0.95
    good, bad = [s for _, s, t in held if t], [s for _, s, t in held if not t]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_edge_cases(spark, make_docs):
    model = small_model()
    docs = make_docs([(None, None), (1, ""), (1, ""), (2, "x" * 200_000), (3, "word " * 50_000), (4, "same text"), (4, "same text")])
    docs = docs.withColumns({"label": F.lit("mine"), "row": F.lit(1), "score": F.lit("old")})
    scored = M.score(docs, model, out="fm")
    rows = scored.collect()
    assert scored.columns == [*docs.columns, "fm"] and len(rows) == 7 and all(0 <= r["fm"] <= 1 and r["score"] == "old" for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault((r["doc_id"], r["text"]), set()).add(r["fm"])
    assert all(len(v) == 1 for v in by_id.values())
    assert M.score(make_docs([]), model).count() == 0
    nothing = M.fit(make_docs([]).withColumn("quality", F.lit(1)))
    assert nothing.score("any") == nothing.score(None) == 0.5
    one = M.fit(make_docs([(1, "a b"), (None, None)]).withColumn("quality", F.lit(1)), passes=30)
    assert one.score("c d") > 0.9
    twice = M.fit(make_docs([(1, "a b")] * 30).withColumn("quality", F.lit(0)), rows=5, passes=2)
    assert twice.score("a b") < 0.5
