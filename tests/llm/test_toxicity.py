import zlib

import pytest
from pyspark.sql import functions as F

from spanlytics.llm import toxicity as T
from tests.llm.conftest import invented


@pytest.fixture(scope="module")
def tables(spark, table_dir):
    insults = ["grumbol", "snarvik", "blechto"]
    docs, labels = [], []
    for i in range(600):
        words = invented(i, 20 + i % 60)
        toxic = i % 5 == 0
        if toxic:
            words[i % 15] = insults[i // 15 % 3] + ["", "s", "ed"][i % 2]
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return table_dir(documents=d, labels=lab), {i: i % 5 == 0 for i in range(600)}


def test_held_out_accuracy(spark, tables):
    sf, truth = tables
    rows = T.op10_toxicity(spark, sf).collect()
    assert len(rows) == 600
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_folding_and_exceptions():
    model = T.ToxicityModel({" trash ": 5.0, " idio": 6.0}, (-4.0, 1.0, 2.0))
    base = model.score("you are trash today")
    assert base > 0.5
    for same in ("you are TRASH today", "you are tr4sh today", "you are tra$h today", "you are trаsh today", "you are ｔｒａｓｈ today"):
        assert model.score(same) == pytest.approx(base)
    assert model.score("put it in the trash can now") < 0.1
    assert model.score("an idiotic plan") > 0.5 and model.score("trashy") < 0.1
    assert model.score("trash " + "fine " * 5000) < base
    assert model.score(None) == model.score("") == T.ToxicityModel({}, model.curve).score("any words")


def test_edge_cases(spark, make_docs, tables):
    model = T.fit_from_tables(spark, tables[0])
    docs = make_docs([(None, None), (1, ""), (1, ""), (2, "grumbol " * 3), (3, "x" * 100000)]).withColumn("toxicity_score", F.lit("mine"))
    kept = T.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4 and kept.filter("toxicity_score = 'mine'").count() == 4
    assert T.reject(make_docs([]), model).count() == 0
    empty = make_docs([]).withColumn("toxic", F.lit(1))
    assert T.fit(empty).weights == {} and 0 <= T.fit(empty).score("x") <= 1
    one = make_docs([(1, "a")]).withColumn("toxic", F.lit(1))
    assert T.fit(one).score("x") > 0.99


def plain_hits(model, text):
    """Every entry looked for at every place, without an automaton."""
    folded = T.fold(text)
    best, spared = {}, []
    for start in range(len(folded)):
        for entry, weight in model.weights.items():
            if folded.startswith(entry, start) and weight > best.get(start, 0.0):
                best[start] = weight
        for phrase in model.exceptions:
            own = T.fold(phrase)
            if folded.startswith(own, start):
                spared.append((start, start + len(own) - 1))
    total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))
    return total, len(folded.split())


def test_hits_equal_a_plain_search():
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(60):
        weights = {rng.choice([f" {word()}", f" {word()} "]): rng.uniform(0.5, 6) for _ in range(8)}
        model = T.ToxicityModel(weights, (0.0, 1.0, 1.0), tuple(f"{word()} {word()}" for _ in range(2)))
        for text in (" ".join(word() for _ in range(40)), "", None, "A8c C4B! b@a", "x" * 3000):
            got, want = model.hits(text), plain_hits(model, text)
            assert got[1] == want[1] and got[0] == pytest.approx(want[0])
            z = sum(c * f for c, f in zip(model.curve, (1.0, T.math.log1p(want[0]), T.math.log1p(100 * want[0] / max(want[1], 1)))))
            assert model.score(text) == pytest.approx(1 / (1 + T.math.exp(-z)))
