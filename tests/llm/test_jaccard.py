import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanlytics.llm import jaccard as J
from spanlytics.llm.components import components
from tests.llm.conftest import invented


def brute(rows, percent=80, n=5):
    sets = {i: J.grams_of(t, n) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(words, rng, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def family_rows():
    rng = random.Random(5)
    rows = [(i, " ".join(invented(100 + i, 30 + i % 200))) for i in range(150)]
    for f in range(4):
        base = invented(f, 120 + 60 * f)
        rows += [(1000 * (f + 1) + k, " ".join(edited(base, rng, 0.001 * (k % 60)))) for k in range(60)]
    rows += [(9000 + k, rows[3][1]) for k in range(5)]
    passage = " ".join(invented(77, 60))
    rows += [(9100 + k, passage + " " + " ".join(invented(500 + k, 40 + k))) for k in range(40)]
    rows += [(9300, "One two"), (9301, "ONE  two"), (9302, "one"), (9303, "a b c d e"), (9304, "a b c d e f")]
    return rows


def test_components_match_brute_force(spark, make_docs):
    rows = family_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_small_blocks_and_no_frequent_list_change_nothing(spark, make_docs, monkeypatch):
    rows = family_rows()
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "HOT", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_threshold_is_inclusive(make_docs):
    # 9 and 8 shared of 10 and 11 5-grams: exactly 0.8 links
    a = [f"t{i}" for i in range(14)]
    b = a[:12] + ["y1", "y2"]  # 8 of 12
    c = a[:13]  # 9 of 10
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(a[:12]))]  # 4: 8 of 10
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(make_docs(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    assert got[4] == 1


def test_edge_cases(spark, make_docs):
    long = " ".join(invented(1, 20000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "same text here"), (4, "same text here"), (None, "same text here"), (None, "alone in here"), (5, long), (6, long + " end")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(make_docs(rows)).collect()), key=str)
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got
    assert got.count((4, 1, 4)) == 2 and (None, 1, 4) in got and (None, 1, None) in got
    assert (6, 19997, 5) in got
    kept = J.keep_one(make_docs(rows)).collect()
    assert len([r for r in kept if r["doc_id"] == 4]) == 1
    assert len([r for r in kept if r["doc_id"] is None]) == 2
    assert {r["doc_id"] for r in kept} == {1, 2, 3, 4, 5, None}
    clash = make_docs(rows).withColumns({"sid": F.lit(1), "gone": F.lit(2), "component": F.lit(3)})
    assert J.keep_one(clash).columns == clash.columns
    assert J.jaccard_components(make_docs([])).count() == 0
    assert J.keep_one(make_docs([])).count() == 0


def test_long_chain_is_one_component(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(links).collect()} == {0}


def survivors(rows, n=5):
    """Rows that stay, by brute force over (id, text): links by whole sets, components, smallest row of each."""
    known = sorted({(i, t) for i, t in rows if i is not None and J.grams_of(t, n)})
    sets = [J.grams_of(t, n) for _, t in known]
    group = list(range(len(known)))
    for a in range(len(known)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old = max(group[a], group[b])
                new = min(group[a], group[b])
                group = [new if g == old else g for g in group]
    ids = {}
    for g, (i, t) in zip(group, known):
        ids.setdefault(g, []).append(i)
    return {g: min(v) for g, v in ids.items()}, known, group


def test_rows_of_one_id_are_told_apart(make_docs):
    a, c = " ".join(invented(1, 40)), " ".join(invented(2, 40))
    got = {(r["doc_id"], r["text"]) for r in J.keep_one(make_docs([(0, c), (1, a), (1, c), (2, a)])).collect()}
    assert got == {(0, c), (1, a)}
    rng = random.Random(5)
    texts = [" ".join(invented(k, 30 + k)) for k in range(12)]
    near = [t + " more" for t in texts]
    rows = [(rng.choice([None, *range(15)]), rng.choice([*texts, *near, None, ""])) for _ in range(150)]
    kept = J.keep_one(make_docs(rows)).collect()
    have = {(r["doc_id"], r["text"]) for r in kept}
    lowest, known, group = survivors(rows)
    assert len([r for r in kept if r["doc_id"] is not None and r["text"] is not None]) == len({x for x in have if x[0] is not None and x[1] is not None})
    for g in set(group):
        members = [k for k, own in zip(known, group) if own == g]
        stay = [m for m in members if m in have]
        assert len(stay) == 1 and stay[0][0] == lowest[g]
    loose = lambda i, t: i is None or not J.grams_of(t, 5)
    assert sorted(str(x) for x in have if loose(*x)) == sorted({str(x) for x in rows if loose(*x)})


def linked_rows(rows, percent=80, n=5):
    """Links of every row by brute force over all pairs of rows, copies included."""
    sets = [J.grams_of(t, n) for _, t in rows]
    return sorted(
        (str(i), sum(bool(s) and 100 * len(s & o) >= percent * len(s | o) for b, o in enumerate(sets) if b != a))
        for a, ((i, _), s) in enumerate(zip(rows, sets))
    )


def test_links_inside_a_component_are_counted(make_docs, monkeypatch):
    rows = [*family_rows(), (9001, family_rows()[3][1]), (9400, None)]
    counts = lambda: sorted((str(r["doc_id"]), r["n_links"]) for r in J.jaccard_components(make_docs(rows)).collect())
    assert counts() == linked_rows(rows)
    # blocks of few sets and few n-grams, matrices of all or of no columns
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "BLOCK_GRAMS", 500)
    monkeypatch.setattr(J, "DENSE", 3)
    monkeypatch.setattr(J, "PAIRS", 100)
    assert counts() == linked_rows(rows)


def test_rows_without_an_id_link_like_others(make_docs):
    words = [f"t{i}" for i in range(60)]
    # 1 and 2 are linked by way of the row without an id only
    rows = [(1, " ".join(words[:48])), (None, " ".join(words[:54])), (2, " ".join(words[:60])), (3, "quite another text than these are")]
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in J.jaccard_components(make_docs(rows)).collect()}
    assert got == {1: (1, 1), None: (1, 2), 2: (1, 1), 3: (3, 0)}
