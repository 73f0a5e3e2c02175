"""Locating spans in whole rows, against plain Python search."""

import random
import re

from spanlytics.operators import align as A
from spanlytics.operators.validate import span_rows, validate

SRC = "Lemma two carries the proof, yet its second case was never written down. Lemma two carries the corollary as well."


def located(spark, text, spans, mode="full", **options):
    docs = spark.createDataFrame([(1, text)], "review_id long, text string")
    rows = spark.createDataFrame([(1, i, *s) for i, s in enumerate(spans)], "review_id long, span_id int, text string, hint int")
    return [r for r in A.locate_spans(docs, rows, mode, **options).orderBy("span_id").collect()]


def test_occurrence_choice(spark):
    second = SRC.rindex("Lemma two carries")
    got = located(spark, SRC, [("Lemma two carries", None), ("Lemma two carries", 60), ("Lemma two carries", 0), ("Lemma two carries", second // 2), ("Lemma two carries", 9999), (" Lemma two carries\n", None)])
    assert [r["start"] for r in got] == [0, second, 0, 0, second, 0] and {r["n_candidates"] for r in got} == {2}
    assert [r["status"] for r in located(spark, SRC, [("", 1), ("  ", None), (None, None), ("absent", 3)])] == ["rejected"] * 4


def test_nearest_of_all_occurrences_by_plain_search(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab \\E") for _ in range(300))
    spans = [(text[a : a + rng.randint(1, 4)], rng.choice([None, rng.randrange(320)])) for a in (rng.randrange(295) for _ in range(150))]
    for (span, hint), r in zip(spans, located(spark, text, spans, "exact")):
        span = span.strip()
        if not span:
            assert r["status"] == "rejected"
            continue
        starts = [m.start() for m in re.finditer(f"(?={re.escape(span)})", text)]
        want = starts[0] if hint is None else min(starts, key=lambda s: (abs(s - hint), s))
        assert (r["status"], r["start"], r["end"], r["n_candidates"]) == ("exact", want, want + len(span), len(starts))


def test_normalized_match_covers_quotes_case_and_dashes(spark):
    text = "Split “left” and ‘right’ — twice. Then  half\n½ of it."
    a, b, c, d = located(spark, text, [("split \"left\" and 'right' - twice.", None), ("HALF 1⁄2 OF", 40), ("(then half", None), ("\"Split “left”\"", None)], "normalized")
    assert (a["status"], a["start"], a["end"]) == ("normalized", 0, text.index(" Then"))
    assert (b["status"], b["start"], b["end"]) == ("normalized", text.index("half"), text.index(" it."))
    assert (c["status"], c["start"], c["end"]) == ("normalized", text.index("Then"), text.index("half") + 4)
    assert d["status"] == "normalized" and (d["start"], d["end"]) == (0, 11)


def test_fuzzy_recovers_paraphrase_and_rejects_invention(spark):
    a, b = located(spark, SRC, [("its second case has never been written down", None), ("A longer bibliography would please everyone at once.", None)])
    assert a["status"] == "fuzzy" and SRC[a["start"] : a["end"]].startswith("its second case was never written down")
    assert a["token_end"] > a["token_start"] and a["similarity"] >= 0.8
    assert b["status"] == "rejected"
    assert located(spark, SRC, [("Its second case was never written down", None)], "exact")[0]["status"] == "rejected"


def test_fuzzy_ties_follow_the_hint_and_windows_are_whole_tokens(spark):
    text = "first the answer holds today. " + "x" * 50 + " then the answer holds today."
    near, far, free = located(spark, text, [("the answ#r h#lds today", 5), ("the answ#r h#lds today", 90), ("the answ#r h#lds today", None)])
    assert (near["start"], far["start"], free["start"]) == (6, text.rindex("the answer"), 6) and near["n_candidates"] == 2
    assert text[near["start"] : near["end"]] == "the answer holds today"


def test_ordered_spans_move_on_and_labels_restrict(spark):
    text = "go on. go on. go on. stop."
    docs = spark.createDataFrame([(1, text)], "review_id long, text string")
    items = [("go on.", "Eval_pos"), ("go on.", "Eval_pos"), ("go on.", None), ("go on.", "Eval_neg"), ("nothing like it at all", "Jus_neg"), (" ", None), ("stop.", "Eval_pos")]
    kind = "array<struct<ord: int, text: string, label_raw: string, label: string, occurrence: int, hint: int, hint_end: int>>"
    rows = spark.createDataFrame([(1, [(i, t, str(lab), lab, None, None, None) for i, (t, lab) in enumerate(items)], [])], f"review_id long, annotations {kind}, issues array<string>")
    both = ("Eval_pos", "Jus_neg")
    for mode in ("exact", "full"):
        open_ = A.align_responses(rows, docs, mode).first()["found"]
        # an unknown label moves nothing, so the span after it is found at the same place
        assert [f["start"] for f in open_] == [0, 7, 14, 14, None, None, 21] and not any(f["duplicate"] for f in open_)
        free = A.align_responses(rows, docs, mode, check_labels=False).first()["found"]
        assert [f["start"] for f in free] == [0, 7, 14, 0, None, None, 21]
    checked = validate(A.align_responses(rows, docs, allowed=both), allowed=both)
    r = checked.first()
    spans = {s["ord"]: s["status"] for s in span_rows(checked, ["review_id"]).collect()}
    assert spans == {0: "exact", 1: "exact", 4: "rejected", 6: "exact"}
    assert (r["n_illegal_label"], r["n_unrecoverable"], r["n_empty"]) == (3, 1, 1)
    only = validate(A.align_responses(rows, docs, allowed=("Eval_pos",)), allowed=("Eval_pos",)).first()
    # the label of the lost span exists but is not allowed: it counts as illegal, not as lost
    assert (only["n_illegal_label"], only["n_unrecoverable"], only["n_empty"]) == (4, 0, 1)
    assert sum(i["code"] == "EMPTY_SPAN" for i in only["issues"]) == 1


def test_passages_of_unknown_source(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 7)))
    docs, items, want = [], [], set()
    for d in range(30):
        docs.append([word() for _ in range(120)])
    for i in range(40):
        source = docs[i % 30]
        text = " ".join(source[40 : 40 + rng.choice([6, 9, 20])])
        chars = list(text)
        for at in rng.sample(range(len(chars)), int(0.2 * len(chars))):
            chars[at] = "#"
        items.append((i, "".join(chars).strip()))
        want.add((i, i % 30))
    items += [(100, ""), (101, None), (102, "zzzz qqqq wwww zzzz qqqq vvvv")]
    docs_df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)] + [(98, None), (99, "")], "review_id long, text string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    got = A.recover_passages(docs_df, items_df, "full").collect()
    assert want <= {(r["item_id"], r["review_id"]) for r in got} and all(r["similarity"] >= 0.8 for r in got)
    assert not {100, 101, 102} & {r["item_id"] for r in got}
    small = A.approximate_pairs(docs_df, items_df, block_chars=300)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in A.approximate_pairs(docs_df, items_df).collect()} >= want
    exact = A.recover_passages(docs_df, spark.createDataFrame([(1, " ".join(docs[3][5:9])), (2, "a")], "item_id long, text string"), "exact").collect()
    assert (1, 3) in {(r["item_id"], r["review_id"]) for r in exact}


def test_plans_hold_no_python_search(spark):
    docs = spark.createDataFrame([(1, SRC)], "review_id long, text string")
    rows = spark.createDataFrame([(1, 0, "Lemma two", 3)], "review_id long, span_id int, text string, hint int")
    plan = A.locate_spans(docs, rows, "exact", tokens=False)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_occurrences_and_size_of_the_text(spark):
    from pyspark.sql import functions as F

    from spanlytics.functions.locate import occurrences

    rows = spark.createDataFrame([("abcabcab", "bca"), ("aaaa", "aa"), ("abc", "x"), ("abc", "b"), ("a\\Eb\\E", "\\E"), ("né\U0001d518né", "né")], "t string, n string")
    assert [r[0] for r in rows.select(occurrences(F.col("t"), F.col("n"))).collect()] == [2, 3, 0, 1, 2, 2]
    docs = spark.createDataFrame([(1, "é\U0001d518"), (2, None)], "review_id long, text string")
    assert {r["review_id"]: r["source_size"] for r in A.searchable(docs, "exact", False).collect()} == {1: 2, 2: 0}


def test_texts_of_one_file_are_searched_in_many_tasks(spark):
    docs = spark.createDataFrame([(i, SRC + f" Number {i}.") for i in range(20)], "review_id long, text string").coalesce(1)
    wanted = spark.createDataFrame([(1, SRC[:40])], "item_id long, text string")
    pairs = A.approximate_pairs(docs, wanted)
    assert "RepartitionByExpression" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 20 == A.recover_passages(docs, wanted, "full").count()


def test_texts_of_responses_are_dealt_once(spark):
    docs = spark.createDataFrame([(1, SRC), (2, None)], "review_id long, text string")
    one = "array<struct<ord:int,text:string,label_raw:string,label:string,occurrence:long,hint:int,hint_end:int>>"
    rows = spark.createDataFrame([(i, [(1, "its second case", "Eval_neg_1", "Eval_neg", 1, None, None)]) for i in (1, 2)], f"review_id long, annotations {one}")
    aligned = A.align_responses(rows, docs, "normalized")
    assert aligned._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert {r["review_id"]: r["found"][0]["status"] for r in aligned.collect()} == {1: "exact", 2: "rejected"}
