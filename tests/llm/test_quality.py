import re
from collections import Counter

from pyspark.sql import functions as F

from spanlytics.llm import quality as Q
from tests.llm.conftest import invented

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


CASES = [None, "", " \n\x0b\x0c\r\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 40, "x\ny\nx\n\n \nx", "a#b *$%& |<>", "é ü b c"]


def test_counts_match_brute_force(make_docs):
    base = invented(1, 120)
    rows = list(enumerate(CASES)) + [(50, " ".join(base + base[20:60] + base[25:40])), (51, " ".join(invented(2, 20000))), (51, "again"), (51, "again"), (None, "no id here")]
    got = Q.measured(make_docs(rows)).select("text", *Q.COUNTS).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(r["text"])


def test_verdicts(make_docs):
    rows = [(i, " ".join(invented(i, 40 + i % 50)), "en", f"s{i % 2}") for i in range(200)]
    rows += [(300, " ".join(w + "###" for w in invented(1, 60)), "en", "s0"), (301, "short", "en", "s0"), (302, "same words again and so on it goes " * 9, "en", "s1")]
    rows += [(303, " ".join(invented(3, 50)), None, None), (304, None, "en", "s9"), (305, " ".join(w * 30 for w in invented(4, 60)), "en", "s1")]
    docs = make_docs(rows).withColumn("fence_lang", F.lit("mine"))
    got = {r["doc_id"]: r for r in Q.judged(Q.measured(docs)).collect()}
    assert len(got) == len(rows) and got[0]["fence_lang"] == "mine"
    assert all(got[i]["kept"] for i in range(200)) and got[303]["kept"]
    assert not any(got[i]["kept"] for i in (300, 301, 302, 304, 305))
    assert {i for i in got if got[i]["base_failed"]} == {301, 302, 304}
    assert Q.judged(Q.measured(make_docs([]))).count() == 0


def test_sketches_merge_and_stay_within_their_error(spark):
    df = spark.range(1, 5001).selectExpr("'en' lang", "concat('s', id % 3) source", "id n_words", "id * id word_chars", "0L n_symbols", "0L n_dup_lines", "1L n_lines", "0L n_repeat_words")
    sketch = Q.sketches(df, "lang", "source")
    row = Q.quantiles(sketch, ["metric"]).filter("metric = 'word_length'").first()
    for i in (1, 2, 3):
        assert abs(row[f"q{i}"] - 1250 * i) <= 0.011 * 1250 * i
    halves = Q.sketches(df.filter("n_words % 2 = 0"), "lang", "source").union(Q.sketches(df.filter("n_words % 2 = 1"), "lang", "source"))
    assert Q.quantiles(halves, ["metric"]).filter("metric = 'word_length'").first() == row
