from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanlytics.llm import lines as L


def brute(rows, ratio, least):
    pages, holds = Counter(), defaultdict(Counter)
    for _, text, site in rows:
        site = site or ""
        pages[site] += 1
        for x in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            holds[site][x] += 1
    bad = {s: {x for x, n in c.items() if n >= least and n > ratio * pages[s]} for s, c in holds.items()}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad.get(s or "", ())) for _, t, s in rows]


def test_matches_brute_force(make_docs):
    rows = []
    for i in range(300):
        site = ["a", "b", None, ""][i % 4] if i % 3 else "a"
        parts = [f"own {i}", "  menu \t", "", f"every {i % 7}", "shared everywhere"] if i % 2 else [f"own {i}", f"pair {i // 2}", "menu"]
        rows.append((i, "\n".join(parts), site))
    rows += [(900, None, "a"), (901, "", "b"), (902, "menu", "a"), (902, "menu", "a"), (903, "menu\n" * 4, "solo"), (904, "x " * 50000, "a")]
    docs = make_docs([(i, t, "en", s) for i, t, s in rows])
    for ratio, least in ((0.05, 5), (0.4, 2), (0.9, 1)):
        got = L.drop_site_lines(docs, "text", F.col("source"), ratio, least).orderBy("doc_id").collect()
        assert sorted((r["doc_id"], str(r["text"])) for r in got) == sorted((i, str(t)) for (i, _, _), t in zip(rows, brute(rows, ratio, least)))


def test_counts_names_and_empty_table(make_docs):
    docs = make_docs([(i, "head\nbody %d" % i) for i in range(10)]).withColumn("line_keys", F.lit("mine")).withColumn("line_site", F.lit(1))
    out = L.drop_site_lines(docs, "text", F.col("source"), dropped="n")
    assert out.columns == docs.columns + ["n"]
    assert {(r["text"][:4], r["n"], r["line_keys"]) for r in out.collect()} == {("body", 1, "mine")}
    assert L.drop_site_lines(make_docs([]), "text", F.col("source")).count() == 0


def test_page_lines(spark):
    html = '<html><head><title>T &amp; U</title><script>var x = "<p>";</script></head><body><!-- no --><p>One <b>two</b><br>three</p><ul><li> a </li><li></li></ul></body></html>'
    got = spark.createDataFrame([(html, "HTTPS://Www.Site.org:80/x")], "html string, url string").select(L.page_lines("html"), L.page_host("url")).first()
    assert tuple(got) == ("T & U\nOne two\nthree\na", "www.site.org")
