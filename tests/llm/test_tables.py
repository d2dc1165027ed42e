"""Each operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing extra columns."""

import datetime as dt

import pytest

from corvane.llm import abuse, conversations, leakage, mixing, origin, parsing, percentiles, secrets

CALLS = "call_id bigint, project string, ts string, received_at timestamp, feature string, compression_ratio double, latency_ms bigint, n bigint, metric string"
TURNS = "turn_id bigint, session_id string, uuid string, parent_uuid string, block_idx int, entry_type string, role string, content_preview string, tool string, ts string, sid string, id bigint"
FILES = "file_id bigint, repo string, rel_path string, role string, size bigint, content binary, reason string, score double"
DOCS = "doc_id bigint, text string, source string, tokens bigint, item_id bigint"


def test_percentiles(spark):
    at = dt.datetime(2024, 5, 2, 12)
    rows = [(k, "p", "2024-05-01T00:00:00Z", at, "Context" if k % 2 else "context", 0.5, k, 1, "x") for k in range(1, 101)]
    rows += [(1, "p", "2024-05-01T00:00:00Z", at + dt.timedelta(hours=1), "Context", 0.5, 1, 1, "x")]  # delivered again
    rows += [(500, None, None, at, None, float("nan"), None, None, None), (501, "p", "bad", None, "context", 0.0, -5, None, None)]
    calls = spark.createDataFrame(rows, CALLS)
    got = {(r["feature"], r["metric"], r["q"]): r for r in percentiles.percentiles(calls, qs=(0.5, 0.99)).collect()}
    row = got["context", "latency_ms", 0.5]
    assert (row["n"], row["n_missing"], row["value"]) == (100, 1, 50.0)
    assert got["context", "latency_ms", 0.99]["value"] == 99.0
    assert got[None, "latency_ms", 0.5]["value"] is None and got[None, "compression_ratio", 0.5]["n_missing"] == 1
    assert percentiles.percentiles(calls.where("false")).count() == 0
    assert all(r["within_bound"] for r in percentiles.certified(calls).collect())
    days = {r["day"] for r in percentiles.percentiles(calls, ("day",), ("feature", "project", "day")).collect()}
    assert days == {dt.date(2024, 5, 1), dt.date(2024, 5, 2), None}


def turn(n, session, uuid, parent, role, text="hi", ts=None, tool=None, block=0, kind=None):
    return (n, session, uuid, parent, block, kind or role, role, text, tool, ts, "x", 7)


def test_conversations(spark):
    good = [turn(1, "A ", "u1", None, "user", ts="2024-01-01T00:00:01Z"), turn(2, "a", "a1", "u1", "assistant", ts="2024-01-01T00:00:01Z"), turn(3, "a", "a1", "u1", "assistant", "more", block=1, tool="Read"), turn(9, "a", "a1", "u1", "assistant", "more", block=1, tool="Read")]
    rows = good + [turn(4, "open", "u1", None, "user"), turn(5, "open", "a1", "u1", "assistant"), turn(6, "open", "u2", "a1", "user")]
    rows += [turn(10, "two", "u1", None, "user"), turn(11, "two", "a1", None, "assistant")]
    rows += [turn(12, "gone", "u1", None, "user"), turn(13, "gone", "a1", "nowhere", "assistant")]
    rows += [turn(14, "loop", "u1", "a1", "user"), turn(15, "loop", "a1", "u1", "assistant")]
    rows += [turn(16, "blank", "u1", None, "user", " \u200b\u00a0"), turn(17, "blank", "a1", "u1", "assistant")]
    rows += [turn(18, "what", "u1", None, None, kind="mystery"), turn(19, "what", "a1", "u1", "assistant")]
    rows += [turn(20, None, None, None, "user"), turn(21, "tool", "u1", None, "HUMAN"), turn(22, "tool", "a1", "u1", "ai", None, tool="Bash")]
    table = spark.createDataFrame(rows, TURNS)
    got = {r["sid"]: r["reason"] for r in conversations.dropped_sessions(table).collect()}
    lone = [got.pop(s) for s in list(got) if s.startswith("thread:")]
    assert got == {"open": "unanswered", "two": "broken", "gone": "broken", "loop": "broken", "blank": "empty", "what": "broken"} and lone == ["empty"]
    kept = [r for r in conversations.conversations(table).collect() if r["session_id"] == "a"]
    assert sorted((r["position"], r["role"], r["preview"], tuple(r["tools"])) for r in kept) == [(1, "user", "hi", ()), (2, "assistant", "hi\nmore", ("Read",))]
    assert conversations.dropped_sessions(table.where("false")).count() == 0


def test_conversations_without_session_ids(spark):
    rows = [turn(1, None, "q1", None, "user", "one"), turn(2, " ", "r1", "q1", "assistant"), turn(3, None, "q2", None, "user", "two"), turn(4, None, "r2", "q2", "assistant"), turn(5, None, "q3", "r2", "user", "more"), turn(6, "s", "q1", None, "user"), turn(7, "s", "r9", "q1", "assistant")]
    table = spark.createDataFrame(rows, TURNS)
    assert sorted(r["reason"] for r in conversations.dropped_sessions(table).collect()) == ["unanswered"]
    kept = {}
    for r in conversations.conversations(table).collect():
        kept.setdefault(r["session_id"], []).append((r["position"], r["role"], r["preview"]))
    assert len(kept) == 2 and {tuple(sorted(v)) for k, v in kept.items() if k != "s"} == {((1, "user", "one"), (2, "assistant", "hi"))}


def test_an_outlier_in_time_leaves_blocks_small(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 16)
    placed = spark.range(4000).selectExpr("1L AS s", "id", "CASE WHEN id = 0 THEN -1000000000L ELSE id END AS pos")
    sizes = [r["count"] for r in conversations.blocked(placed).groupBy("block").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 100 and len(sizes) > 100


def test_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    rows = [turn(k, "long", f"e{k}", f"e{k - 1}" if k else None, "user" if k % 2 == 0 else "assistant", ts="2024-01-01T00:00:00Z") for k in range(24)]
    rows += [turn(100 + k, "tail", f"e{k}", f"e{k - 1}" if k else None, "assistant" if k % 2 else "user", ts=f"2024-01-01T00:00:{k:02d}Z") for k in range(23)]
    table = spark.createDataFrame(rows, TURNS)
    assert {r["sid"] for r in conversations.dropped_sessions(table).collect()} == {"tail"}
    order = [r["position"] for r in conversations.conversations(table).orderBy("position").collect()]
    assert order == list(range(1, 25))


def test_secrets_tables(spark):
    rows = [(1, "r", "a.py", None, None, b'password = "Copper-Orchard!4171"\nx = 1\n', None, None), (2, None, None, None, None, None, None, None), (3, "r", "b", None, 0, b"", None, None), (4, "r", "c", None, 0, b"\xff\xfe token = 'ghp_X1PzZ8nSpgbdqfROXpqGDJBxPubNdLvGTWNg'", None, None)]
    files = spark.createDataFrame(rows, FILES)
    facts = spark.createDataFrame([(7, 'line\napi_key: "your-key-here"\nDB_PWD=l4nt3rn#81Cob')], "fact_id bigint, content string")
    got = {tuple(r) for r in secrets.found(files, facts).collect()}
    assert got == {("files", 1, 1), ("files", 4, 1), ("context_facts", 7, 3)}
    masked = {r["row_id"]: bytes(r["content"]) for r in secrets.redacted(files, "file_id").collect()}
    assert masked[1] == b'password = "' + b"*" * 19 + b'"\nx = 1\n'
    assert len(masked[4]) == len(rows[3][5]) and masked[4].startswith(b"\xff\xfe token = '***")
    assert secrets.found(files.where("false"), facts.where("false")).count() == 0


def test_parsing_tables(spark):
    rows = [(1, "r", "a.py", None, None, b"\xef\xbb\xbfx = 1\r\n", None, None), (2, "r", "b.py", None, None, b"def f(:\n", None, None), (3, "r", "tsconfig.json", None, None, b'{ // c\n "a": 1 }', None, None), (4, "r", "c.json", None, None, b'{ // c\n "a": 1 }', None, None), (5, "r", "d.txt", None, None, b"(", None, None), (6, "r", "e.go", None, None, None, None, None), (7, "r", None, None, None, b"(", None, None), (8, "r", "z.py", None, None, b"", None, None), (9, "r", "y.XML", None, None, b"", None, None), (10, "s", "k.cs", None, None, b"\x00\xff\xfe", None, None)]
    files = spark.createDataFrame(rows, FILES)
    assert {r["file_id"] for r in parsing.found(files).collect()} == {2, 4, 9, 10}
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"]) for r in parsing.rates(files).collect()}
    assert rates["r", "Python"] == (3, 1) and rates["s", "C#"] == (1, 1)
    assert parsing.found(files.where("false")).count() == 0


def test_origin_tables(spark):
    plain = "import os\n\n\ndef measure_{0}(value, other):\n    # keep the order of values\n    result_{0} = value + other\n    return result_{0}\n"
    rows = [(k, "own", f"src/mod_{k}.py", "source", 10, plain.format(k).encode(), None, None) for k in range(30)]
    packed = "".join(f"function a{k}(b){{return b.c({k})||[]}};var d{k}=[{k},!0];" for k in range(80))
    rows += [(100 + k, "own", f"web/x{k}.js", None, None, (f"/*! lib{k} 1.{k} */\n" if k < 12 else "").encode() + packed.encode(), None, None) for k in range(15)]
    rows += [(200, "own", "a/b.go", None, None, b"// Code generated by tool. DO NOT EDIT.\npackage a\n", None, None), (201, "own", "third_party/lib/x.py", None, None, b"import os\n", None, None), (202, "own", "vendor/own/x.py", None, None, b"import os\n", None, None), (203, "own", "src/generated_report.py", None, None, b'TEXT = "Code generated by %s. DO NOT EDIT."\n', None, None), (204, None, None, None, None, None, None, None), (205, "own", "e.py", None, None, b"", None, None), (206, "own", "p.py", None, None, b"# Copyright (c) 2020 the own authors. All rights reserved.\nimport os\n", None, None)]
    files = spark.createDataFrame(rows, FILES)
    got = {r["file_id"] for r in origin.found(files).collect()}
    assert got == {200, 201, *range(100, 115)}
    assert origin.found(files.where("false")).count() == 0
    held = {(r["kind"], r["tool_name"]): (r["files"], r["reported"]) for r in origin.held_out(files).collect()}
    assert held["minified", False] == (12, 12)  # fitted without them


def test_origin_without_labels(spark):
    rows = [(1, "own", "a.py", None, None, b"x = 1\n", None, None), (2, "own", "b.py", None, None, ("X = [\n" + '    "abcdefgh", "ijklmnop",\n' * 100 + "]\n").encode(), None, None), (3, "own", "c.js", None, None, b"// Vendored copy of quill, pinned at 3\nf()\n", None, None)]
    files = spark.createDataFrame(rows, FILES)
    assert {r["file_id"]: r["reason"] for r in origin.classified(files).collect()} == {1: None, 2: "data", 3: "third_party"}
    assert {r["file_id"]: r["reason"] for r in origin.classified(files.where("file_id < 3")).collect()} == {1: None, 2: "data"}


def test_leakage_tables(spark):
    base = [f"word{k}" for k in range(60)]
    item = " ".join(base)
    other = " ".join(f"other{k}" for k in range(40))
    items = spark.createDataFrame([(1, "s", "Read it all first. " + item), (2, "s", "Read it all first. " + other), (3, "s", "Read it all first. " + other.replace("other", "third")), (4, "s", None), (5, "s", "too short")], "item_id bigint, suite string, text string")
    near = base[:26]
    near[5], near[12] = "changed", "altered"
    far = [w if k % 6 else "x" for k, w in enumerate(base)]
    docs = [(1, "before " + " ".join(base[10:34]) + " after", None), (2, " ".join(base[10:31]), None), (3, "> " + "\n> ".join(" ".join(near[k : k + 5]).upper() for k in range(0, 26, 5)), None), (4, "Read it all first.", None), (5, None, None), (6, "", None), (7, "<p>" + "&nbsp;".join(f"<b>{w}</b>" for w in base[:30]) + "</p>", None), (8, " ".join(far), None), (9, "pad " * 3000 + other + " pad" * 3000, None), (10, '{"a": "' + "\\n".join(base[20:50]) + '"}', None), (1, "before " + " ".join(base[10:34]) + " after", None)]
    documents = spark.createDataFrame([(i, t, s, 1, 99) for i, t, s in docs], DOCS)
    got = {tuple(r) for r in leakage.found(documents, items).distinct().collect()}
    assert got == {(1, 1), (3, 1), (7, 1), (9, 2), (10, 1)}
    assert leakage.found(documents.where("false"), items).count() == 0 and leakage.found(documents, items.where("false")).count() == 0


def test_apportion():
    assert mixing.apportion({"a": 53, "b": 24, "c": 23}, 7, {"a": 9, "b": 9, "c": 9}) == {"a": 3, "b": 2, "c": 2}
    assert mixing.apportion({"a": 1, "b": 1, "c": 1}, 4, {"a": 9, "b": 9, "c": 9}) == {"a": 2, "b": 1, "c": 1}
    assert mixing.apportion({"a": 0.9, "b": 0.1}, 10, {"a": 3, "b": 99}) == {"a": 3, "b": 7}
    assert mixing.apportion({"a": 1.0}, 5, {"a": 2}) == {"a": 2} and mixing.apportion({}, 3, {}) == {}


def brute_apportion(weights, seats, caps):
    given = dict.fromkeys(weights, 0)
    for _ in range(seats):
        free = [k for k in weights if weights[k] > 0 and given[k] < caps[k]]
        if not free:
            break
        given[min(free, key=lambda k: (-weights[k] / (2 * given[k] + 1), -weights[k], k))] += 1
    return given


@pytest.mark.parametrize("seed", range(8))
def test_apportion_is_highest_quotients(seed):
    import random

    r = random.Random(seed)
    weights = {f"s{k}": r.choice([0.0, 1.0, 2.0, r.random() * 5]) for k in range(6)}
    caps = {k: r.randrange(0, 30) for k in weights}
    assert mixing.apportion(weights, 40, caps) == brute_apportion(weights, 40, caps)


def test_mixing_tables(spark):
    docs = [(k, "alpha beta gamma delta " * 20, "Big Source" if k % 4 else "small", 1, 1) for k in range(80)] + [(900, None, "small", 1, 1), (901, "x", None, 1, 1), (902, "", "small", 1, 1)]
    documents = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([(1, "big_source", 60.0, None), (1, "small", 60.0, 3), (1, "none", 10.0, 2), (1, None, 5.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    mix = mixing.Mix(documents, targets, block_tokens=200)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert abs(shares["big_source"]["actual_share"] - 0.5) < 0.05 and shares["none"]["tokens"] == 0
    assert max(r["repeats"] for r in mix.selection().collect()) <= 3
    assert mixing.Mix(documents.where("false"), targets).selection().count() == 0
    assert mixing.Mix(documents, targets.where("false")).selection().count() == 0


CALM = ("Please rotate the cache before the release.", "Kill the child process and abort the worker.", "The women page of the locale pack is cached.", "We moved the migrants sample into the archive.", "The index knows four files and no decoder.", "My guess is that the worker holds a stale copy.")
HARSH = ("You are a worthless moron, {}.", "Shut up, you stupid bastard {}.", "The {} are vermin and should be driven out.", "{} gave me a blowjob.")


def abuse_corpus():
    """Documents 100 and up, with two raters each; a rater errs once."""
    names = ("ebbe", "tolva", "women", "migrants", "refugees", "foreigners")
    docs, votes = [], []
    for k in range(120):
        parts = [CALM[(k + j) % len(CALM)] for j in range(3)]
        if bad := k % 4 == 0:
            parts[k // 4 % 3] = HARSH[k // 4 % len(HARSH)].format(names[k // 4 % len(names)])
        docs.append((100 + k, " ".join(parts), "c", 1, 1))
        votes += [(100 + k, 1, " Abusive " if bad else "ok"), (100 + k, 2, "abusive" if bad != (k == 50) else "OK")]
    return docs, votes


def test_abuse_tables(spark):
    docs = [(1, "You are a w0rthless m0r0n.", "a", 1, 1), (2, "Please rotate the cache before the release.", "a", 1, 1), (3, None, None, 1, 1), (4, "", "b", 1, 1), (5, "Kill the child process and abort the worker.", "b", 1, 1), (6, "fine words only. " * 400 + "Shut up, you stupid b a s t a r d.", "b", 1, 1), (7, "You are a w\u200borthless m***n, ebbe.", "b", 1, 1), (8, "The women of the index are cached.", "b", 1, 1)]
    more, votes = abuse_corpus()
    documents = spark.createDataFrame(docs + more, DOCS)
    labels = spark.createDataFrame([(2, 1, "ok"), (2, 1, "ok"), (5, 2, None), (5, 3, "unsure"), *votes], "doc_id bigint, rater_id int, label string")
    got = {r["doc_id"]: r["flagged"] for r in abuse.scores(documents, labels).where("doc_id < 100").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True, 7: True, 8: False}
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in abuse.rates(abuse.scores(documents, labels.where("false"))).collect()}
    assert rates["a"] == (2, 0) and rates[None] == (1, 0)
    assert abuse.scores(documents.where("false"), labels).count() == 0


def test_counterfactual_swaps_level_groups(monkeypatch):
    bags = [abuse.Bag(f"{g} should be slaves", 2, 0) for g in ("women", "migrants")] * 3 + [abuse.Bag("the women page is cached", 0, 2), abuse.Bag("the index is cached", 0, 2)] * 3
    groups = ("women", "migrants")

    def spread():
        model = abuse.fit(bags)
        z = abuse.logits(abuse.encode([(g,) for g in groups]), model.weights, 0.0)
        return z.max() - z.min()

    level = spread()
    monkeypatch.setattr(abuse, "SWAP", 0.0)
    assert level < spread() / 2


def test_identity_terms_are_found_in_frames():
    found = abuse.identity_terms([tuple(s.split()) for s in ("the migrants are vermin and", "the women are vermin and", "the zorbs are vermin and", "all migrants should be slaves", "all women should be slaves", "all zorbs should be slaves", "the cache is cold and")])
    assert found == ["migrants", "women", "zorbs"]


def test_fit_on_no_labels_scores_zero():
    assert abuse.fit([]).scores(["x", None]).tolist() == [0, 0] and abuse.fit([abuse.Bag("a b", 1, 0)]).scores(["a b"]).tolist() == [0]
