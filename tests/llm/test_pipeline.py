import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanlytics.llm import bpe, toxicity
from tests.llm.conftest import DOCS, invented
from tests.llm.test_jaccard import brute as components_by_hand
from tests.llm.test_lines import brute as lines_by_hand


@pytest.fixture(scope="module")
def tables(spark, table_dir):
    rng = random.Random(8)
    items = [(i, " ".join(invented(40_000 + i, 30 + i))) for i in range(6)]
    rows, toxic = [], {}
    for i in range(300):
        words = invented(i, 50 + i % 80)
        toxic[i] = i % 6 == 0
        if toxic[i]:
            words[7] = rng.choice(["grumbol", "snarvik"])
        if i % 25 == 3:
            words += items[i % 6][1].split()
        body = " ".join(words[:30]) + "\n" + " ".join(words[30:])
        rows.append((i, f"Shared menu line\n{body}" if i % 2 else body, "en", f"s{i % 3}", len(body)))
    for k in range(20):  # near copies of a clean document
        words = rows[79][1].split(" ")
        words[-1 - k % 5] = f"new{k}"
        rows.append((1000 + k, " ".join(words), "en", "s1", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", None, 0), (None, "no id but some words", "en", "s0", 1), (79, rows[79][1], "en", "s1", 5)]
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in toxic.items() if i % 4], "doc_id long, quality int, toxic int")
    sf = table_dir(documents=spark.createDataFrame(rows, DOCS), labels=labels, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    return sf, rows, items


def test_stages_match_brute_force(spark, tables):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, names = [docs], []
    for name, stage in P.STAGES:
        out = P.written(stage(spark, kept[-1], sf), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept.append(out)
        names.append(name)
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]

    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    model = toxicity.fit_from_tables(spark, sf)
    clean = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    assert 230 < len(clean) < len(rows) and {r[0] for r in clean} >= {2000, 2001, None}
    cut = [(r[0], t, r[3]) for r, t in zip(clean, lines_by_hand([(r[0], r[1], r[3]) for r in clean], 0.05, 5))]
    assert sorted(map(key, kept[2].collect())) == sorted((str(i), str(t)) for i, t, _ in cut)
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect() if r["text"] is not None)
    found = components_by_hand([(i, t) for i, t, _ in cut if i is not None])
    one = {(str(i), str(t)) for i, t, _ in cut if i is None or found[i][1] == i}
    assert sorted(map(key, kept[3].collect())) == sorted(one)
    assert not {str(1000 + k) for k in range(20)} & {i for i, _ in one}
    leaks = {(i, t) for i, t in one if any(x in t.replace("\n", " ") for _, x in items)}
    assert leaks and set(map(key, kept[4].collect())) == one - leaks
    vocabulary = bpe.public_vocabulary()
    want = sorted((i, len(ids := vocabulary.encoding.encode_ordinary("" if t == "None" else t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for i, t in one - leaks)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in kept[5].collect()) == want
    assert sorted(map(str, P.run(spark, sf).collect())) == sorted(map(str, kept[5].collect()))


def test_empty_table(spark, tables, table_dir):
    sf, _, items = tables
    none = table_dir(documents=spark.createDataFrame([], DOCS), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    assert P.run(spark, none).count() == 0


def test_extra_columns_survive(spark, tables):
    sf, _, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumns({c: F.lit("mine") for c in ("leaks", "toxicity_score", "line_keys", "gone", "row", "sid", "score", "item_id")})
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert set(docs.select("leaks", "toxicity_score", "line_keys", "gone", "row", "sid", "score", "item_id").distinct().first()) == {"mine"}
