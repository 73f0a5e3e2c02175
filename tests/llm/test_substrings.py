import random

from pyspark.sql import functions as F

from spanlytics.llm import substrings as S
from tests.llm.conftest import invented


def brute(rows, least):
    """Runs over the operator's pieces; documents in the order of ids, ``order`` gives that of one id's texts."""
    docs = {(i is None, i or 0, t): t for i, t in rows}
    seen, gone = {}, {}
    for key in sorted(docs, key=lambda k: (k[0], k[1], order(k[2]))):
        words = [x.lower().split() for x in S.sentences_of(docs[key])]
        spans = set()
        for a in range(len(words)):
            for step in (1, -1):
                total, b = 0, a
                while 0 <= b < len(words):
                    total += len(words[b])
                    if total >= least:
                        spans.add((min(a, b), max(a, b)))
                        break
                    b += step
        for a, b in sorted(spans):
            if words[a] and words[b]:
                text = " ".join(w for s in words[a : b + 1] for w in s)
                if seen.setdefault(text, (key, a)) != (key, a):
                    gone.setdefault(key, set()).update(range(a, b + 1))
    return {k: "".join(p for i, p in enumerate(S.sentences_of(t)) if i not in gone.get(k, ())) for k, t in docs.items()}


def order(text):
    """Spark's hash of the text, which the operator names in its docstring."""
    return HASHES.get(text, 0)


HASHES = {}


def sentences(seed, n, rng):
    words = invented(seed, n * 12)
    out, at = [], 0
    while at < len(words):
        k = rng.randrange(1, 15)
        out.append(" ".join(words[at : at + k]) + rng.choice([".", "!", "?\n", ".\n\n"]) + " ")
        at += k
    return out


def test_matches_brute_force(make_docs):
    rng = random.Random(2)
    passages = [sentences(900 + k, 6, rng) for k in range(8)]
    rows = []
    for i in range(200):
        own = sentences(i, 4 + i % 9, rng)
        for k in range(i % 3):
            at = rng.randrange(len(own) + 1)
            own[at:at] = passages[(i + k) % 8]
        rows.append((i, "".join(own)))
    rows += [(500, rows[7][1]), (501, rows[7][1] + rows[7][1]), (502, None), (503, ""), (None, rows[8][1]), (504, " \n \n"), (505, "".join(sentences(7, 2500, rng)))]
    for least in (25, 8):
        got = sorted((str(r["doc_id"]), r["text"] or "") for r in S.drop_repeated_spans(make_docs(rows), min_words=least).collect())
        want = brute(rows, least)
        assert got == sorted((str(i), want[(i is None, i or 0, t)]) for i, t in rows)


def test_rows_of_one_id_are_cut_by_themselves(make_docs):
    a, b, c = (" ".join(invented(k, 60)) + "." for k in (1, 2, 3))
    for rows in ([(0, a), (1, f"{a} {b}"), (1, f"{c} {b}")], [(0, a), (None, a), (None, c)]):
        got = {r["text"] for r in S.drop_repeated_spans(make_docs(rows)).collect()}
        assert a in got and any(c in t for t in got)
    rng = random.Random(6)
    passages = ["".join(sentences(400 + k, 4, rng)) for k in range(10)]
    rows = [(rng.choice([None, *range(12)]), "".join(rng.sample(passages, rng.randrange(1, 4))) + f" own {k % 40}.") for k in range(120)]
    docs = make_docs(rows)
    HASHES.update({r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    want = brute(rows, 25)
    got = sorted((str(r["doc_id"]), r["text"]) for r in S.drop_repeated_spans(docs).collect())
    assert got == sorted((str(i), want[(i is None, i or 0, t)]) for i, t in rows)


def test_first_place_stays_and_passages_are_covered(make_docs):
    rng = random.Random(4)
    passage = "".join(sentences(55, 6, rng))
    rows = [(i, f"Opening words of number {i} here.\n{passage}\nClosing line {i} of it.") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in S.drop_repeated_spans(make_docs(rows)).collect()}
    assert got[0] == rows[0][1]
    assert all(len(got[i].split()) <= 12 and got[i].startswith(f"Opening words of number {i}") for i in range(1, 30))


def test_repeated_rows_names_and_empty_table(make_docs):
    text = " ".join(invented(1, 60)) + "."
    docs = make_docs([(1, text), (1, text)]).withColumns({"ranges": F.lit("mine"), "cut": F.lit(0)})
    out = S.drop_repeated_spans(docs, counts=("n", "gone"))
    assert out.columns == docs.columns + ["n", "gone"] and [r["text"] for r in out.collect()] == [text, text]
    assert S.drop_repeated_spans(make_docs([])).count() == 0
    assert "".join(S.sentences_of("a. b!  c\n\nd? e")) == "a. b!  c\n\nd? e"


def test_passages_in_mid_sentence_are_cut(make_docs):
    """A passage of 51 words stands inside other sentences; nothing else repeats."""
    rng = random.Random(8)
    rows, passages = [], []
    for k in range(60):
        style = k % 3  # no end of a sentence, one long sentence between two ends, many short ones
        words = [f"p{k}x{i}" for i in range(51)]
        for i in {0: [], 1: [3, 47], 2: range(2, 50, 4)}[style]:
            words[i] += "."
        passages.append(" ".join(words))
        for copy in range(2):
            own = [f"d{k}c{copy}y{i}" for i in range(60 + rng.randrange(20))]
            rows.append((2 * k + copy, " ".join(own[:30]) + " " + passages[-1] + " " + " ".join(own[30:])))
    got = {r["doc_id"]: r["text"] for r in S.drop_repeated_spans(make_docs(rows)).collect()}
    for k, passage in enumerate(passages):
        assert got[2 * k] == rows[2 * k][1]
        left = got[2 * k + 1].split()
        assert len(set(passage.split()) & set(left)) <= 51 - S.MIN_WORDS, k
        assert [w for w in left if w[0] == "d"] == [w for w in rows[2 * k + 1][1].split() if w[0] == "d"]


def test_first_pass_marks_the_keys_that_repeat_and_the_second_sends_little(make_docs):
    rng = random.Random(9)
    passage = "".join(sentences(77, 6, rng))
    rows = [(i, "".join(sentences(3000 + i, 40, rng)) + (passage if i % 50 == 0 else "")) for i in range(150)]
    base = make_docs(rows).select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text")
    keys = base.select("text").mapInArrow(S._all_keys(25), "key long")
    sent = base.mapInArrow(S._marked_runs(25, S._marked(keys)), S._RUNS).collect()
    counts = {}
    for i, text in rows:
        for a, b, h in S.runs_of(text):
            counts.setdefault(h, set()).add((i, a, b))
    want = {p for places in counts.values() if len(places) > 1 for p in places}
    got = {(r["doc"], r["first"], r["last"]) for r in sent}
    assert want and want <= got and len(got) < len(want) + 5 and keys.count() > 50 * len(want)
