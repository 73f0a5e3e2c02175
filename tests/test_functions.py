"""Helpers against plain statements of the rules."""

import random
import re

import numpy as np
import pytest

from spanlytics.functions import approx as N
from spanlytics.functions import fingerprints as FP
from spanlytics.functions import tails as T
from spanlytics.functions import text as X
from spanlytics.functions.tokens import token_bounds

MESSY = "Both  figures share one caption,\r\nwhich hides the scale. <em>Please</em> split them – the “left” one first.\n\n\nNext part.\nThe proof\nis short."


def test_tokens_equal_the_regular_expression():
    rng = random.Random(3)
    pattern = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
    for _ in range(300):
        text = "".join(rng.choice("ab1_-'’ .é\n ") for _ in range(rng.randint(0, 40)))
        s, e = token_bounds(text)
        assert [(m.start(), m.end()) for m in pattern.finditer(text)] == list(zip(s.tolist(), e.tolist()))


def windows_by_hand(text, span, threshold):
    """Best similarity over all windows, by the full table of common subsequences of every suffix."""
    best, where = 0.0, set()
    for a in range(len(text)):
        row = [0] * (len(span) + 1)
        for b in range(a, len(text)):
            new = [0]
            for j, y in enumerate(span):
                new.append(row[j] + 1 if y == text[b] else max(row[j + 1], new[j]))
            row = new
            ratio = 2 * row[-1] / (b + 1 - a + len(span))
            if ratio > best + 1e-12:
                best, where = ratio, set()
            if abs(ratio - best) < 1e-12:
                where.add((a, b + 1))
    return (best, where) if best >= threshold - 1e-12 else (0.0, set())


def test_best_windows_equal_all_windows():
    rng = random.Random(6)
    texts, spans = [], []
    for k in range(120):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 45)))
        a = rng.randrange(len(text))
        span = "".join(c for c in text[a : a + rng.randint(1, 14)] if rng.random() > 0.15) or "a"
        texts.append(text), spans.append(span if k % 5 else "".join(rng.choice("abcd ") for _ in range(6)))
    found = N.best_windows([N.codes(t) for t in texts], [N.codes(s) for s in spans], 0.8)
    for t, s, (ratio, windows) in zip(texts, spans, found):
        want, where = windows_by_hand(t, s, 0.8)
        assert ratio == pytest.approx(want) and set(windows) <= where and bool(windows) == bool(where)
        assert {b for _, b in where} == {b for _, b in windows}  # one window for each end
    assert N.best_windows([N.codes(""), N.codes("x")], [N.codes("a"), N.codes("")], 0.8) == [(0.0, []), (0.0, [])]


def edits(text, span):
    row = [0] * (len(text) + 1)
    for j, y in enumerate(span, 1):
        new = [j]
        for i, x in enumerate(text, 1):
            new.append(min(row[i - 1] + (x != y), row[i] + 1, new[i - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh    ", "etaoin shrdlu"])
def test_no_occurrence_within_the_edits_is_lost(letters):
    rng = random.Random(len(letters))
    text = "".join(rng.choice(letters) for _ in range(500))
    spans = []
    for size in [*range(1, 12), 20, 30, 30, 31, 45, 60, 61, 100, 150] * 2:
        a = rng.randrange(500 - size)
        chars = list(text[a : a + size])
        for _ in range(rng.randint(0, N.allowed_edits(size, 0.8) + 1)):  # one more than allowed in some
            at = rng.randrange(len(chars) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                chars.insert(at, rng.choice(letters + "#"))
            elif at < len(chars) and len(chars) > 1:
                chars[at : at + 1] = [] if kind == 1 else [rng.choice(letters + "#")]
        spans.append("".join(chars))
    index = N.SpanSet([N.codes(s) for s in spans], 0.8)
    regions = index.regions(N.codes(text))
    for i, s in enumerate(spans):
        within = edits(text, s) <= N.allowed_edits(len(s), 0.8)
        mine = [text[a:b] for k, a, b in regions if k == i]
        assert not within or any(edits(part, s) == edits(text, s) for part in mine), (i, s)
    assert index.regions(N.codes("")) == [] and N.SpanSet([], 0.8).regions(N.codes(text)) == []


def test_piece_distances_equal_the_full_table():
    rng = random.Random(1)
    text = "".join(rng.choice("abc ") for _ in range(200))
    pieces = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    starts = np.array([rng.randrange(150) for _ in pieces])
    ends = starts + np.array([rng.randint(1, 40) for _ in pieces])
    got = N.piece_distances(N.codes(text), starts, ends, [N.codes(p) for p in pieces])
    assert got.tolist() == [edits(text[a:b], p) for a, b, p in zip(starts, ends, pieces)]


def test_piece_distances_of_repeated_pieces_in_small_lots(monkeypatch):
    monkeypatch.setattr(N, "LOT", 7)
    rng = random.Random(2)
    text = "".join(rng.choice("ab cé") for _ in range(300))
    pieces = ["".join(rng.choice("abcx ") for _ in range(n)) for n in (1, 5, 30, 45, 64)]
    which = np.array([rng.randrange(5) for _ in range(80)])
    starts = np.array([rng.randrange(300) for _ in which])
    ends = np.minimum(starts + np.array([rng.randint(0, 90) for _ in which]), 300)
    got = N.piece_distances(N.codes(text), starts, ends, [N.codes(p) for p in pieces], which)
    assert got.tolist() == [edits(text[a:b], pieces[k]) for a, b, k in zip(starts, ends, which)]


def spread(mapped):
    """Every character of a changed text with its source position."""
    text, at, source = mapped
    own = np.arange(len(text))
    k = np.searchsorted(at, own, side="right") - 1
    return text, (np.asarray(source)[k] + own - np.asarray(at)[k]).tolist() if len(text) else []


def plain_map(text, change, tags, keep_breaks):
    """The rules stated character by character."""
    hidden = {i for m in re.finditer(X.TAG, text) for i in range(*m.span())} if tags else set()
    pieces = [(c, i) for i, ch in enumerate(text) if i not in hidden for c in change(ch)]
    out, gap = [], None
    for c, i in pieces:
        if c.isspace():
            gap = (i if gap is None else gap[0], (gap is not None and gap[1]) or c in X.LINE_BREAKS)
            continue
        if gap is not None and out:
            out.append(("\n" if gap[1] and keep_breaks else " ", gap[0]))
        gap = None
        out.append((c, i))
    return "".join(c for c, _ in out), [i for _, i in out]


def test_normalised_text_maps_back_to_its_source():
    text, index = spread(X.normalize_with_map(MESSY))
    assert all(MESSY[i] == c for c, i in zip(text, index) if not c.isspace())
    assert "<em>" not in text and "\r" not in text and "  " not in text
    form, idx = spread(X.match_forms(["A  “B”\tc"])[0])
    assert form == 'a "b" c' and ["A  “B”\tc"[i] for i in idx] == ["A", " ", "“", "B", "”", "\t", "c"]
    assert len(X.match_forms(["plain words only " * 500 + "end"])[0][1]) == 1


def test_index_runs_equal_the_rules_character_by_character(monkeypatch):
    rng = random.Random(12)
    letters = list("aB .\n\t<>/i") + ["ﬁ", "½", "İ", "\u200b", "\xa0", "…", "“", "—", "\r\n", "<b>", "</i>", "日", "é", "ﷺ", "\x1c", "\u2028", "¨", "ß"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", " ", "\u200b"]
    normal = lambda c: "" if c in X.ZERO_WIDTH else X.unicodedata.normalize("NFKC", c)
    matching = lambda c: "".join(x.lower() for x in X.unicodedata.normalize("NFKC", X.UNIFIED.get(c, c)))
    monkeypatch.setattr(X, "BLOCK_CHARS", 100)
    for t, form in zip(texts, X.match_forms(texts)):
        assert spread(form) == plain_map(t, matching, False, False)
        assert spread(X.normalize_with_map(t)) == plain_map(t, normal, True, True)


def test_places_are_looked_up_by_binary_search(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", " ", "ﬁ", "  ", "\u200b", "ﷺ"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rows = [(t, a, a + rng.randint(0, 9)) for t in texts for a in range(0, len(t) + 2, 3)]
    df = spark.createDataFrame(rows, "t string, a int, b int").withColumn("m", X.normalized("t"))
    got = df.select("t", "a", "b", X.from_source("m", "a", "b").alias("f"), X.to_source("m", "a", "b").alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        _, index = spread(X.normalize_with_map(r.t))
        start, end = sum(i < r.a for i in index), sum(i < r.b for i in index)
        assert (r.f.start, r.f.end) == (start, max(start, end))
        if index:
            at = lambda p: index[min(max(p, 0), len(index) - 1)]
            assert (r.s.start, r.s.end) == (at(r.a), at(r.b - 1) + 1 if r.b > r.a else at(r.a))
        else:
            assert (r.s.start, r.s.end) == (r.a, r.b)


def test_sentences_follow_soft_wraps():
    text = "The method\nis novel. Second one.\n- Bullet item\nAnother line."
    found = [text[a:b] for a, b in zip(*X.sentence_bounds(text))]
    assert found == ["The method\nis novel.", "Second one.", "- Bullet item", "Another line."]


def test_shared_substring_leaves_a_shared_fingerprint():
    rng = random.Random(5)
    for _ in range(100):
        core = "".join(rng.choice("abcdefgh ") for _ in range(FP.Q + FP.W - 1))
        left = "".join(rng.choice("xyz") for _ in range(50)) + core
        right = core + "".join(rng.choice("uvw") for _ in range(30))
        assert set(FP.fingerprints(left)) & set(FP.fingerprints(right))


def test_tail_probabilities():
    assert T.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert T.gamma_sf(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert T.beta_cdf(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    assert T.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert T.normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_offsets_of_a_batch_in_slices():
    import pyarrow as pa

    from spanlytics.functions import tokens as T

    texts, seen = pa.array(["one two", None, "", "a-b c."] * 5), []

    def run(part):
        seen.append(len(part))
        return T.offsets_of(T.token_bounds)(part)

    assert T.in_slices(run, texts, 6).equals(run(texts)) and max(seen[:-1]) == 6
    assert len(T.in_slices(run, texts.slice(0, 0))) == 0


def test_matching_forms_of_a_batch_in_slices(monkeypatch):
    import pyarrow as pa

    from spanlytics.functions import text as X

    seen, plain = [], X.match_forms
    monkeypatch.setattr(X, "match_forms", lambda texts: seen.append(len(texts)) or plain(texts))
    texts = pa.array(["One  “two”", None, "", "<b>A</b> ½"] * 200)
    forms = X.match_normalized.func(texts)
    assert len(forms) == 800 and max(seen) <= 256 and forms.slice(400).to_pylist() == forms.slice(0, 400).to_pylist()
    lists = pa.array([["A  b", "C"], None, [], [None]] * 200)
    assert X.match_form_lists.func(lists).to_pylist() == [["a b", "c"], None, [], [""]] * 200
    assert X.decode_reference_lists.func(pa.array([["a &amp; b", None], None, []] * 200)).to_pylist() == [["a & b", None], [], []] * 200


def test_sentence_ranges_come_with_the_row(spark):
    from spanlytics.operators import align as A
    from spanlytics.operators import units as U

    texts = ["One two. Three-four five!\n\n\"Six\" sev", "", None, " . a.\n- B c. D", "x" * 600 + ". Yy " + "z " * 400]
    docs = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "review_id long, dataset string, text string")
    ranged = U.ranged_sentences(docs)
    want = A.with_token_ranges(U.sentences(docs).select("review_id", "k", "start", "end"), docs)
    columns = ["review_id", "k", "start", "end", "ts", "tj"]
    assert sorted(map(tuple, ranged.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert "Exchange" not in ranged._jdf.queryExecution().executedPlan().toString()


def test_a_near_span_is_compared_with_few_places(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = " ".join(rng.choice(words) for _ in range(120))
    span = text[200:238] + "⸮⸮" + text[240:280]
    widths, nearest = [], N._nearest
    monkeypatch.setattr(N, "_nearest", lambda texts, *rest: widths.extend(map(len, texts)) or nearest(texts, *rest))
    (similarity, windows), *_ = N.best_windows([N.codes(text)], [N.codes(span)], 0.8)
    assert similarity == pytest.approx(156 / 160) and (200, 280) in windows
    assert sum(widths) < 150 < len(text)
