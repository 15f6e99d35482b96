import json

from pyspark.sql import functions as F

from countwatch.llm import chat

SCHEMAS = "name string, param string, kind string, required boolean"
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
MESSAGES = "conv_id long, turn long, role string, text string"


def linked(spark, calls, results=(), messages=()):
    schemas = spark.createDataFrame(list(chat.SCHEMAS), SCHEMAS)
    return chat.link(spark.createDataFrame(list(messages), MESSAGES), spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), schemas).collect()


def flag(c, i, turn, needs=None):
    return (c, i, turn, "flag", '{"urgent":true}', needs)


def test_calls_follow_what_they_need(spark):
    calls = [flag(1, "a", 1, ["d"]), flag(1, "b", 3, ["a", "x", "b"]), flag(1, "c", 5), flag(1, "d", 7, ["c"]), flag(1, "e", 9), flag(2, "p", 4, ["q"]), flag(2, "q", 4), flag(2, "r", 4, ["p"])]
    rows = {(r.conv_id, r.call_id): r for r in linked(spark, calls)}
    place = {k: (r.at, r.depth) for k, r in rows.items()}
    for c, i, _, _, _, needs in calls:
        for n in needs or []:
            if n != i and (c, n) in place:
                assert place[c, n] < place[c, i]
    assert place[1, "a"] == (7, 1) and place[1, "b"] == (7, 2) and place[1, "e"] == (9, 0)
    assert all(r.status == "unanswered" for r in rows.values())


def test_cycles_are_told_and_stay(spark):
    calls = [flag(1, "a", 1, ["b"]), flag(1, "b", 2, ["c"]), flag(1, "c", 3, ["a"]), flag(1, "d", 4, ["c"]), flag(1, "f", 2, ["g"]), flag(1, "g", 3)]
    rows = {r.call_id: r for r in linked(spark, calls)}
    assert {k for k, r in rows.items() if r.status == "cyclic"} == {"a", "b", "c"}
    assert (rows["a"].at, rows["d"].at) == (1, 4) and (rows["f"].at, rows["f"].depth) == (3, 1)


def test_arguments_are_checked(spark):
    bad = [
        ("search", '{"query":"x","limit":3}', []), ("search", '{"limit":"many"}', ["kind:limit", "missing:query"]), ("search", '{"query":"x","more":1}', ["unknown:more"]),
        ("measure", '{"words":2,"ratio":-1.5e3}', []), ("measure", '{"words":2.5,"ratio":"1"}', ["kind:ratio", "kind:words"]), ("flag", '{"urgent":"yes"}', ["kind:urgent"]),
        ("nothing", "{}", ["tool"]), ("flag", "not json", ["json"]), ("flag", None, ["json"]), (None, "{}", ["tool"]),
    ]
    rows = linked(spark, [(1, f"c{i}", i, n, a, None) for i, (n, a, _) in enumerate(bad)], [(1, f"c{i}", i + 1, "r") for i in range(len(bad))])
    got = {r.call_id: (r.problems, r.status) for r in rows if r.kind == "call"}
    for i, (_, _, want) in enumerate(bad):
        assert got[f"c{i}"] == (want, "invalid" if want else "ok")


def test_arguments_must_have_the_json_type_of_their_kind(spark):
    bad = [
        ("measure", '{"words":"12","ratio":1}', ["kind:words"]), ("measure", '{"words":12,"ratio":true}', ["kind:ratio"]), ("measure", '{"words":-123456789012345678901234567890,"ratio":0.5}', []),
        ("measure", '{"words":null,"ratio":{}}', ["kind:ratio", "kind:words"]), ("measure", '{"words":12.5,"ratio":"x"}', ["kind:ratio", "kind:words"]), ("flag", '{"urgent":"true"}', ["kind:urgent"]),
        ("flag", '{"urgent":1}', ["kind:urgent"]), ("flag", '{"urgent":false,"note":"5"}', []), ("flag", '{"urgent":false,"note":false}', ["kind:note"]), ("search", '{"query":5}', ["kind:query"]),
        ("search", '{"query":{}}', ["kind:query"]), ("search", '{"query":[]}', ["kind:query"]), ("search", '{"query":null}', ["kind:query"]), ("search", '["query"]', ["json"]), ("search", '{"query":""}', []),
    ]
    rows = linked(spark, [(1, f"c{i}", i, n, a, None) for i, (n, a, _) in enumerate(bad)])
    got = {r.call_id: r.problems for r in rows}
    assert [got[f"c{i}"] for i in range(len(bad))] == [want for _, _, want in bad]


def test_the_query_has_typed_and_wrongly_typed_arguments(spark, sf_small):
    kinds = {(n, p): {"string": str, "integer": int, "number": (int, float), "boolean": bool}[k] for n, p, k, _ in chat.SCHEMAS}
    rows = chat.op5_chat(spark, sf_small).where("kind = 'call' and status != 'duplicate'").collect()
    right, wrong = set(), set()
    for r in rows:
        call = json.loads(r.json)
        for p, v in call["arguments"].items():
            if kind := kinds.get((call["name"], p)):
                fits = isinstance(v, kind) and (kind is bool or not isinstance(v, bool))
                assert fits == (f"kind:{p}" not in r.problems)
                (right if fits else wrong).add(p)
    assert right >= {"query", "limit", "words", "ratio", "urgent"} and wrong >= {"query", "limit", "words", "urgent"}


def test_results_duplicates_orphans_and_nulls(spark):
    calls = [flag(1, "a", 5), flag(1, "a", 3), flag(1, "a", 3), flag(None, "a", 1), flag(1, None, 1), flag(2, "a", None)]
    results = [(1, "a", 8, "late"), (1, "a", 4, "b"), (1, "a", 4, "a"), (1, "zz", 2, None), (3, "a", 1, "x"), (None, None, None, None)]
    messages = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "é\"\n")]
    rows = linked(spark, calls, results, messages)
    assert len(rows) == len(calls) + len(results) + len(messages)
    status = sorted((r.kind, r.status) for r in rows)
    assert status.count(("call", "ok")) == 1 and status.count(("call", "duplicate")) == 2 and status.count(("call", "unlinked")) == 3
    assert status.count(("result", "ok")) == 1 and status.count(("result", "duplicate")) == 2 and status.count(("result", "orphan")) == 2
    answer = next(r for r in rows if r.kind == "result" and r.status == "ok")
    assert json.loads(answer.json) == {"content": "a", "id": "a", "type": "result"} and (answer.at, answer.rank) == (3, 2)
    assert linked(spark, []) == []


def test_arguments_keep_their_types_and_sort_their_keys(spark):
    given = '{"z": {"b": [1, true, null], "a": "x"}, "query": "é", "limit": 3}'
    rows = linked(spark, [(1, "a", 1, "search", given, None), (1, "b", 2, "search", "not json", None), (1, "c", 3, "search", None, None)])
    told = {r.call_id: r.json for r in rows}
    assert told["a"] == '{"arguments":{"limit":3,"query":"é","z":{"a":"x","b":[1,true,null]}},"id":"a","name":"search","type":"call"}'
    assert json.loads(told["b"])["arguments"] == "not json" and "arguments" not in json.loads(told["c"])


def test_json_is_canonical(spark, sf_small):
    rows = chat.op5_chat(spark, sf_small).collect()
    said = spark.read.parquet(f"{sf_small}/conversations.parquet").collect()
    for r in rows:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    texts = sorted((r.conv_id, r.turn, json.loads(r.json)["content"]) for r in rows if r.kind == "message")
    assert texts == sorted((s.conv_id, s.turn, s.text) for s in said)
    assert sum(r.kind == "call" for r in rows) == sum(s.role == "assistant" for s in said)
    assert {"ok", "invalid", "unanswered"} <= {r.status for r in rows if r.kind == "call"}


def test_order_of_the_query_is_topological(spark, sf_small):
    conversations = spark.read.parquet(f"{sf_small}/conversations.parquet")
    calls = chat.calls_of(conversations).collect()
    rows = {(r.conv_id, r.call_id): r for r in chat.op5_chat(spark, sf_small).collect() if r.kind == "call"}
    for c in calls:
        for n in c.needs or []:
            other = rows.get((c.conv_id, n))
            own = rows[c.conv_id, c.call_id]
            if other is not None and "cyclic" not in (own.status, other.status):
                assert (other.at, other.depth) < (own.at, own.depth)


def test_schema_rows_repeat_and_hold_nulls(spark):
    """Repeats are one; required counts, then the first kind; a row without a parameter tells that the tool exists."""
    rows = [("t", "a", "string", False), ("t", "a", "string", False), ("t", "a", "integer", True), ("t", "b", "number", None), ("t", None, "string", True), ("bare", None, None, None), (None, "x", "string", True)]
    schemas = spark.createDataFrame(rows, "name string, param string, kind string, required boolean")
    calls = [("t", '{"a":1}', []), ("t", '{"a":"x"}', ["kind:a"]), ("t", '{"b":1}', ["missing:a"]), ("bare", "{}", []), ("bare", '{"x":1}', ["unknown:x"]), (None, "{}", ["tool"])]
    df = spark.createDataFrame([(1, f"c{i}", i, n, a) for i, (n, a, _) in enumerate(calls)], "conv_id long, call_id string, turn long, name string, arguments string")
    got = {r.call_id: r.problems for r in chat.problems(df, schemas).collect()}
    assert got == {f"c{i}": want for i, (_, _, want) in enumerate(calls)}


def test_far_turns_make_no_row_each(spark):
    far, top = 3_000_000_000, (1 << 63) - 1
    calls = [(1, "a", 1, ["b"]), (1, "b", far, ["a"]), (1, "c", 7, ["b"]), (2, "x", -far, ["y"]), (2, "y", far, None), (3, "m", top, ["n"]), (3, "n", top, ["m"])]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, needs array<string>")
    got = {(r.conv_id, r.call_id): (r["at"], r.depth, r.cyclic) for r in chat.ordered(df).collect()}
    assert got == {
        (1, "a"): (1, 0, True), (1, "b"): (far, 0, True), (1, "c"): (far, 1, False), (2, "x"): (far, 1, False), (2, "y"): (far, 0, False),
        (3, "m"): (top, 0, True), (3, "n"): (top, 0, True),
    }


def test_spanned_turns_equal_all_comparisons(spark):
    import random

    rnd = random.Random(4)
    spans = [(c, low, low + rnd.choice([0, 0, 1, 3, 17, 1000])) for c in range(3) for low in (rnd.randrange(-300, 300) for _ in range(12))]
    turns = [(c, t) for c in range(4) for t in range(-320, 700, 3)]
    got = chat.spanned(spark.createDataFrame(turns, "conv_id long, turn long"), spark.createDataFrame(spans, "conv_id long, low long, high long"))
    want = {(c, t) for c, t in turns if any(s == c and low <= t <= high for s, low, high in spans)}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_a_long_conversation_of_far_needs(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1L as conv_id", "cast(id as string) as call_id", "id as turn", f"array('{n - 1}') as needs")
    rows = chat.ordered(df)
    assert rows.where(F.col("call_id") != str(n - 1)).where(F.col("at") == n - 1).where("depth = 1 and not cyclic").count() == n - 1
