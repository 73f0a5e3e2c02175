import math
import random

from pyspark.sql import functions as F

from spanlytics.llm import langid as L

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ver", "ent"], "cc": ["eau", "oir", "que", "ment"]}


def say(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_evidence(spark):
    rng = random.Random(1)
    langs = list(SYLLABLES)
    train = spark.createDataFrame([(langs[i % 3], say(langs[i % 3], 30, rng)) for i in range(300)] + [("aa", None), (None, "x")], "lang string, text string")
    names, table = L.fit(train)
    assert names == langs
    rows = [(i, say(langs[i % 3], 20, rng), langs[i % 3], "x" + langs[i % 3], f"h{i % 9}.site{i % 3}.org") for i in range(300)]
    rows += [(400, None, "bb", "xbb", "h1.site1.org"), (401, "", None, None, None), (402, None, None, None, "new.site2.org"), (403, None, "bb", None, "h0.site0.org")]
    rows += [(404, say("cc", 3000, rng), "aa", "xaa", None), (None, say("aa", 5, rng), None, None, None)] * 2
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string").withColumn("mine", F.lit(1))
    out = L.identified(df, names, table)
    assert out.columns == ["id", "declared", "suffix", "host", "mine", "lang", "confidence", "text_lang"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert sum(by[i]["lang"] == langs[i % 3] for i in range(300)) >= 297
    assert by[400]["lang"] == "bb" and by[400]["text_lang"] is None
    assert by[402]["lang"] == "cc"  # the domain speaks for a host not seen before
    assert by[404]["lang"] == "cc"  # a long text outweighs markup and address
    assert by[401]["confidence"] < 0.5 and all(0 < r["confidence"] <= 1 for r in got)


def test_empty_tables(spark):
    rng = random.Random(2)
    names, table = L.fit(spark.createDataFrame([("aa", say("aa", 9, rng))], "lang string, text string"))
    none = spark.createDataFrame([], "id long, text string, declared string, suffix string, host string")
    assert L.identified(none, names, table).count() == 0


def test_page_evidence(spark):
    rows = [('<HTML class="x" lang="FR"><p>a</p>', "https://www.a.co/de/1"), ("<html>", "http://b.fr/x"), (None, None)]
    got = L.page_evidence(spark.createDataFrame(rows, "html string, url string")).select("declared", "suffix", "host").collect()
    assert [tuple(r) for r in got] == [("fr", "de", "www.a.co"), (None, "fr", "b.fr"), (None, None, None)]


def plain_posterior(rows, names, table):
    """Every part of the posterior stated row by row."""
    def text_part(text):
        f = L.trigrams(text)
        if not len(f):
            return None
        ll = [sum(float(table[i, j]) for i in f) * min(1.0, L.EVIDENCE / len(f)) for j in range(len(names))]
        return [x - max(ll) for x in ll]

    lls = [text_part(r[1]) for r in rows]
    own = [None if ll is None else names[ll.index(max(ll))] for ll in lls]
    domain = lambda h: None if h is None else ".".join(h.split(".")[-2:]) if "." in h else ""
    count = lambda keep: [sum(o == n for o, r in zip(own, rows) if keep(r)) for n in names]
    every = count(lambda r: True)
    share = [(n + L.SMOOTH) / (sum(every) + L.SMOOTH * len(names)) for n in every]
    out = []
    for k, r in enumerate(rows):
        me = [int(own[k] == n) for n in names]
        less = lambda c, me=me: [a - b for a, b in zip(c, me)]
        host = less(count(lambda x: x[4] == r[4])) if r[4] is not None else [0] * len(names)
        site = less(count(lambda x: x[4] is not None and domain(x[4]) == domain(r[4]))) if r[4] is not None else [0] * len(names)
        site_share = [(n + L.PRIOR * s) / (sum(site) + L.PRIOR) for n, s in zip(site, share)]
        score = [math.log((n + L.PRIOR * s) / (sum(host) + L.PRIOR)) for n, s in zip(host, site_share)]
        if lls[k] is not None:
            score = [a + b for a, b in zip(score, lls[k])]
        for c in (2, 3):
            used = [(x[c], o) for x, o in zip(rows, own) if x[c] is not None and o is not None]
            if r[c] is not None and any(v == r[c] for v, _ in used):
                values = len({v for v, _ in used})
                for j, n in enumerate(names):
                    both, total = sum(v == r[c] and o == n for v, o in used), sum(o == n for _, o in used)
                    score[j] += math.log((both + L.SMOOTH) / (total + L.SMOOTH * (values + 1)))
        top = max(score)
        out.append((r[0], names[score.index(top)], 1 / sum(math.exp(s - top) for s in score), own[k]))
    return out


def test_posterior_equals_a_plain_computation(spark):
    rng = random.Random(7)
    langs = list(SYLLABLES)
    train = spark.createDataFrame([(langs[i % 3], say(langs[i % 3], 20, rng)) for i in range(60)], "lang string, text string")
    names, table = L.fit(train)
    pick = lambda *x: rng.choice([None, *x])
    rows = [(i, rng.choice([None, "", say(rng.choice(langs), rng.randrange(1, 15), rng)]), pick("aa", "bb"), pick("x", "y", "z"), pick("a.s.org", "b.s.org", "s.org", "c.net", "plain")) for i in range(80)]
    rows += [(200, None, "only here", "nowhere", "never.seen"), (201, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string").repartition(4)
    got = {r["id"]: r for r in L.identified(df, names, table).collect()}
    assert len(got) == len(rows)
    for i, lang, confidence, text_lang in plain_posterior(rows, names, table):
        assert got[i]["text_lang"] == text_lang and abs(got[i]["confidence"] - confidence) < 1e-4
        assert got[i]["lang"] == lang or confidence < 0.51
