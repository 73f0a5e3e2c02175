import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlytics.llm import resample as R
from spanlytics.llm.common import read
from tests.llm.conftest import invented

SF = "/root/testdata/sf0.001"


def plain_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    feats = [(d, *plain_features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in feats for f in fs)
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for d, n_words, fs in feats:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= min_words))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    keep = drawn[: len(drawn) * percent // 100]
    return sorted(((*r[:4], None) for r in rows), key=str), [r[:4] for r in keep]


def compare(spark, docs, target, percent=5):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = R.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent).collect()
    every, drawn = plain_resample(docs, target, percent)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], None) for r in got), key=str) == every
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in ranked] == drawn


def test_whole_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, SF, "documents").collect()]
    target = [r["text"] for r in read(spark, SF, "benchmark").collect()]
    every, drawn = plain_resample(docs, target)
    got = R.op12_resample(spark, SF)
    assert [d for d, t in got.dtypes if t == "bigint"] == got.columns
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], None) for r in rows), key=str) == every
    ranked = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in ranked] == drawn and drawn


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 300)
    rng = random.Random(5)
    texts = [" ".join(invented(i, rng.randrange(0, 60), 40)) for i in range(120)]
    odd = ["", " ", "...", "Éa ÉB é-b", "a", "a b", "A\x00b\tc", "日本 x_y z" * 20, "w1 " * 5000, "İ I ı Ünïcödé" * 8]
    docs = [(i, t) for i, t in enumerate(texts + odd)] + [(3, texts[3]), (3, "other " * 30), (None, "no id " * 20), (None, "no id " * 20), (None, None), (500, None)]
    compare(spark, docs, texts[:7] + ["", "UPPER case"], 40)
    compare(spark, docs, [], 100)
    compare(spark, [], ["a b"])
    compare(spark, [(1, None), (2, "few words")], ["a b"])


def test_equal_rows_get_their_own_ranks(spark):
    docs = [(7, "same words again " * 10)] * 40 + [(8, "same words again " * 10)] * 40
    compare(spark, docs, ["same words"], 75)


def test_extra_columns_and_kernels(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string").withColumns({"rank": F.lit("x"), "weight": F.lit("y"), "salt": F.lit(1)})
    assert R.resample(docs, docs, 100).collect()[0]["rank"] == 1
    n_words, runs = R.features_of(pa.array(["b a b a", None, "", "-a.A-", "b a"]))
    assert n_words.tolist() == [4, 0, 0, 2, 2]
    assert [len(at) for at, _ in runs] == [8, 5, 2]
    assert runs[1][1].tolist() == [zlib.crc32(f.encode()) % 10000 for f in ("b a", "a b", "b a", "a a", "b a")]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_words(n):
    assert [len(at) for at, _ in R.features_of(pa.array([" ".join("xyz"[:n])]))[1]] == [n, max(n - 1, 0), 0]
