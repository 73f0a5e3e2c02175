import json
import random

import pytest
from pyspark.sql import functions as F

from spanlytics.llm import chat as C

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string"
RESULTS = "conv_id long, turn long, call_id string, content string"


def test_arguments():
    check = lambda n, a: C.checked_arguments(n, a, C.SCHEMAS)
    assert check("search", '{"query": "é", "limit": 2.0}') == ('{"limit":2,"query":"é"}', [])
    assert check("search", '{"limit":true}') == ('{"limit":true}', ["missing query", "type limit"])
    assert check("lookup", '{"keys":[1.5,{"b":1,"a":null}],"x":1}') == ('{"keys":[1.5,{"a":null,"b":1}],"x":1}', ["unknown x"])
    for bad in (None, "", "{", '{"a":NaN}', "[" * 100000):
        assert check("search", bad) == (None, ["malformed"])
    assert check("search", "[1]")[1] == ["not an object"] and check("none", "{}")[1] == ["unknown tool"]


@pytest.mark.parametrize("shape", ["chain", "tree"])
def test_levels(spark, shape):
    n = 300
    parent = (lambda i: i - 1) if shape == "chain" else (lambda i: (i - 1) // 2 if i else -1)
    rows = [(str(i), str(parent(i))) for i in range(n)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("behind", "c2"), ("self", "self"), ("lost", "nowhere")]
    want = {}
    for i in range(n):
        want[str(i)] = want[str(parent(i))] + 1 if parent(i) >= 0 else 0
    want |= {"c1": None, "c2": None, "c3": None, "behind": None, "self": None, "lost": 0}
    got = {r["node"]: r["depth"] for r in C.levels(spark.createDataFrame(rows, "node string, parent string")).collect()}
    assert got == want


def test_linking(spark):
    ok = '{"query":"q"}'
    calls = [(1, 1, "a", "search", ok, None), (1, 3, "b", "search", ok, "a"), (1, 5, "b", "search", ok, None), (1, 7, "x", "search", ok, "y"), (1, 9, "y", "search", ok, "x")]
    calls += [(2, 1, None, "search", None, None), (2, 2, "d", "search", ok, "gone"), (2, 2, "d", "search", ok, "gone")]
    results = [(1, 2, "a", "one"), (1, 4, "b", None), (1, 4, "zz", "lost"), (1, 6, "a", "later"), (2, 9, None, "none")]
    df = C.linked_events(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS))
    got = sorted(((r["kind"], r["call_id"] or "-", r["turn"], r["level"], r["status"], ";".join(r["problems"])) for r in df.collect()), key=str)
    assert got == sorted(
        [
            ("call", "a", 1, 0, "linked", ""), ("call", "b", 3, 2, "linked", ""), ("call", "b", 5, None, "duplicate", ""),
            ("call", "x", 7, None, "unanswered", "cycle"), ("call", "y", 9, None, "unanswered", "cycle"), ("call", "-", 1, None, "unanswered", "malformed"),
            ("call", "d", 2, 0, "unanswered", "unknown predecessor"), ("call", "d", 2, None, "duplicate", "unknown predecessor"),
            ("result", "a", 2, 1, "linked", ""), ("result", "a", 6, None, "duplicate", ""), ("result", "b", 4, 3, "linked", ""),
            ("result", "zz", 4, None, "orphan", ""), ("result", "-", 9, None, "orphan", ""),
        ],
        key=str,
    )
    for r in df.collect():
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]


def plain_links(calls, results):
    """Status and level of every row, one conversation after the other."""
    def firsts(rows, order):
        best = {}
        for k, r in enumerate(rows):
            if r[2] is not None:
                best.setdefault((r[0], r[2]), []).append((tuple((x is not None, x if x is not None else "") for x in order(r)), k))
        return {k: min(v)[1] for k, v in best.items()}

    own, back = firsts(calls, lambda r: (r[1], r[3], r[4])), firsts(results, lambda r: (r[1], r[3]))

    def level(conv, call_id, seen=()):
        if (conv, call_id) in seen:
            return None
        after = calls[own[conv, call_id]][5]
        if after is None or (conv, after) not in own:
            return 0
        up = level(conv, after, (*seen, (conv, call_id)))
        return None if up is None else up + 2

    out = []
    for k, r in enumerate(calls):
        first = r[2] is not None and own[r[0], r[2]] == k
        status = "unanswered" if r[2] is None or first else "duplicate"
        out.append(("call", r[0], r[1], r[2], level(r[0], r[2]) if first else None, "linked" if first and (r[0], r[2]) in back else status))
    for k, r in enumerate(results):
        first = r[2] is not None and back[r[0], r[2]] == k
        if r[2] is not None and not first:
            out.append(("result", r[0], r[1], r[2], None, "duplicate"))
        elif r[2] is None or (r[0], r[2]) not in own:
            out.append(("result", r[0], r[1], r[2], None, "orphan"))
        else:
            up = level(r[0], r[2])
            out.append(("result", r[0], r[1], r[2], None if up is None else up + 1, "linked"))
    return sorted(out, key=str)


def test_identifiers_hold_within_their_conversation(spark):
    """Identifiers that start again, null conversations, clashing extra columns and a very long text, by brute force."""
    rng = random.Random(4)
    name = lambda: rng.choice(["call_1", "call_2", "call_3", "1", None])
    conv = lambda: rng.choice([1, 2, 11, -1, None])
    calls = [(conv(), t, name(), "search", '{"query":"q%d"}' % rng.randrange(3), name()) for t in range(120)]
    results = [(conv(), t, name(), rng.choice(["one", "two", None])) for t in range(120)] + [(1, 500, "call_1", "long " * 100_000)]
    extra = lambda df: df.withColumn("key", F.lit("mine")).withColumn("extra", F.lit(0)).withColumn("row_no", F.lit(1))
    got = C.linked_events(extra(spark.createDataFrame(calls, CALLS)), extra(spark.createDataFrame(results, RESULTS))).collect()
    assert sorted(((r["kind"], r["conv_id"], r["turn"], r["call_id"], r["level"], r["status"]) for r in got), key=str) == plain_links(calls, results)
    two = [(1, 1, "call_1", "search", '{"query":"a"}', None), (2, 1, "call_1", "search", '{"query":"b"}', None)]
    both = C.linked_events(spark.createDataFrame(two, CALLS), spark.createDataFrame([(1, 2, "call_1", "x"), (2, 2, "call_1", "y")], RESULTS))
    assert {r["status"] for r in both.collect()} == {"linked"}


def test_empty_tables(spark, table_dir):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.op6_chat_tool_links(spark, table_dir(conversations=turns)).count() == 0
    assert C.linked_events(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)).count() == 0


def test_every_turn_is_emitted_whole(spark, table_dir):
    text = lambda k: f"  turn {k}\n" + " ".join(f"w{k}_{i}" for i in range(40)) + ' "end" '
    rows = [(c, t, ("system", "user", "assistant")[t if t < 2 else 2 - t % 2], text(10 * c + t)) for c in range(1, 40) for t in range(6)]
    rows += [(90, 0, "user", None), (90, 1, None, "no role"), (90, 1, None, "no role")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = C.op6_chat_tool_links(spark, table_dir(conversations=frame)).collect()
    said = [(r["conv_id"], r["turn"], json.loads(r["json"])) for r in got if r["kind"] == "message"]
    assert sorted((c, t, str(m["role"]), m["content"]) for c, t, m in said) == sorted((c, t, str(r), x or "") for c, t, r, x in rows)
    seen = set()
    for r in C.derived_calls(frame).collect():
        try:
            arguments = json.loads(r["arguments"])
        except (TypeError, ValueError):
            continue
        if "more" in arguments:  # a dealt fault
            continue
        seen |= set(arguments)
        held = arguments.get("query", arguments.get("unit", " ".join(arguments.get("keys", []))))
        assert held == text(10 * r["conv_id"] + r["turn"])
    assert {"query", "unit", "keys"} <= seen
