import json

import pytest
from pyspark.sql import functions as F

from effectsmith.llm import decontaminate, tool_calls, url_rules

CALLS = "conv_id long, call_id string, name string, arguments string, after string, pos long"
RESULTS = "conv_id long, call_id string, content string, pos long"


def schemas(spark):
    return spark.createDataFrame([("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False)], "name string, field string, type string, required boolean")


def linked(spark, calls, results=()):
    rows = tool_calls.linked(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), schemas(spark))
    return {(r["conv_id"], r["call_id"]): r for r in rows.collect()}


def test_calls_link_order_and_validate(spark):
    got = linked(
        spark,
        [
            (1, "c", "add", '{"b": 2.5, "a": 1}', "b", 3),
            (1, "b", "add", '{"a": "x", "c": 1}', "a", 2),
            (1, "a", "add", '{"a":1,"b":2}', None, 1),
            (1, "d", "mul", "{}", "nowhere", 4),
            (1, "e", "add", "not json", None, 5),
            (2, "x", "add", '{"a":1,"b":2}', "y", 1),
            (2, "y", "add", '{"a":1,"b":2}', "x", 2),
            (3, None, "add", "{}", None, 1),
        ],
        [(1, "a", "3", 2), (1, "a", "later", 9), (1, "zz", "lost", 3)],
    )
    assert [got[1, k]["level"] for k in "abc"] == [0, 1, 2]
    assert got[1, "a"]["status"] == "linked" and got[1, "a"]["n_results"] == 2 and got[1, "b"]["status"] == "unanswered"
    assert got[1, "c"]["valid"] and json.loads(got[1, "c"]["json"])["arguments"] == {"a": 1, "b": 2.5}
    assert '"arguments":{"a":1,"b":2.5}' in got[1, "c"]["json"]
    assert got[1, "b"]["errors"] == "missing b; type a; unknown c"
    assert got[1, "d"]["dangling"] and got[1, "d"]["errors"] == "no schema" and got[1, "d"]["level"] == 0
    assert got[1, "e"]["errors"] == "not an object" and json.loads(got[1, "e"]["json"])["arguments"] == "not json"
    assert got[2, "x"]["level"] is None and got[2, "y"]["level"] is None
    assert got[1, "zz"]["status"] == "orphan" and (3, None) not in got


def test_canonical_numbers_and_integers(spark):
    def text(a, b):
        row = linked(spark, [(1, "a", "add", '{"b": %s, "a": %s}' % (b, a), None, 1)])[1, "a"]
        return row["json"].split('"arguments":')[1].split(',"call_id"')[0], row["errors"]

    big = "123456789012345678901234567890"
    wanted = {"1e3": "1000", "1000.0": "1000", "1.50": "1.5", "-0.0": "0", "1E-7": "1e-7", "0.0001": "0.0001", "1e21": "1e+21", "12345678.5": "12345678.5", "1.5e10": "15000000000", "-2.5e-4": "-0.00025", big: big}
    for given, want in wanted.items():
        assert text("1", given) == ('{"a":1,"b":%s}' % want, ""), given
        assert json.loads(want) == json.loads(given)
    assert text("1.0", "1") == ('{"a":1,"b":1}', "") and text(big, "1")[1] == "" and text("1.5", "1")[1] == "type a"
    # numbers in strings and after escapes stay, in nested values they do not
    got, errors = text("[1.0,{\"x\":2e2}]", '"' + r"1.0 \\ \" 2.0" + '"')
    assert got == r'{"a":[1,{"x":200}],"b":"1.0 \\ \" 2.0"}' and errors == "type a; type b"
    long = '"' + r"\n1.0" * 200_000 + '"'
    assert text("1", long)[0] == '{"a":1,"b":' + long + "}"
    assert text("1", '1,"b":2')[1] == "not an object"


def test_repeated_calls_long_chains_and_extra_columns(spark):
    n = 300
    chain = [(1, str(i), "add", '{"a":1,"b":2}', str(i - 1) if i else None, i) for i in range(n)]
    got = linked(spark, chain + chain[:3])
    assert [got[1, str(i)]["level"] for i in range(n)] == list(range(n))
    assert got[1, "0"]["n_calls"] == 2
    extra = spark.createDataFrame(chain[:2], CALLS).withColumn("content", F.lit("x")).withColumn("level", F.lit(7))
    assert tool_calls.linked(extra, spark.createDataFrame([], RESULTS), schemas(spark)).count() == 2
    assert tool_calls.linked(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), schemas(spark)).count() == 0


def test_turns_become_calls(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c"), (1, 2, "user", None), (1, None, "user", "x"), (None, 1, "user", "y")], "conv_id long, turn long, role string, text string")
    calls, results = tool_calls.from_turns(turns)
    rows = {r["call_id"]: r for r in tool_calls.linked(calls, results, tool_calls.chat_schemas(spark)).collect()}
    assert rows[0]["status"] == "linked" and rows[0]["valid"] and rows[2]["level"] == 1 and not rows[2]["valid"]
    assert set(rows) == {0, 2}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://a.example.net/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
        ("HTTPS://B.Example.COM/de/#x", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://example.org/fr/", "example.org", "/fr/", "org/fr/", "allow"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("http://x.net", "x.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://a.b/c://d.net/e", "a.b", "/c://d.net/e", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    frame = spark.createDataFrame([(1, url)], "page_id long, url string")
    parts = frame.withColumns({"host": url_rules.host_of(F.col("url")), "path": url_rules.path_of(F.col("url"))})
    row = parts.withColumn("fit", url_rules.explicit_rule(F.col("host"), F.col("path"))).first()
    assert (row["host"], row["path"]) == (host, path)
    assert (row["fit"]["rule"] if row["fit"] else None, row["fit"]["verdict"] if row["fit"] else None) == (rule, verdict)


def test_mined_rules_judge_the_rest(spark):
    rows = [(i, f"http://a.example.net/es/{i}") for i in range(20)] + [(i + 50, f"http://b.example.net/en/{i}") for i in range(20)]
    rows += [(100, "http://c.example.org/es/1"), (101, "http://c.example.org/en/1"), (102, None), (103, "junk"), (100, "http://c.example.org/es/1")]
    got = url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(3)), min_support=0.05).collect()
    assert len(got) == len(rows)
    verdict = {r["page_id"]: r["verdict"] for r in got}
    assert (verdict[100], verdict[101], verdict[102], verdict[103]) == ("block", "allow", "allow", "allow")
    assert url_rules.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_verdicts_equal_brute_force_mining(spark):
    """Every subset of every labelled URL's tokens is counted; the best rule inside a URL judges it."""
    from itertools import combinations

    from effectsmith.llm.tables import table

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    pages = pages.unionByName(pages.filter("page_id % 3 = 0"))  # repeated rows
    parts = pages.withColumns({"host": url_rules.host_of(F.col("url")), "path": url_rules.path_of(F.col("url"))})
    rows = parts.select("page_id", url_rules.explicit_rule(F.col("host"), F.col("path")).alias("fit"), url_rules.tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("t")).collect()
    labelled = [(frozenset(r["t"]), r["fit"]["verdict"]) for r in rows if r["fit"] and r["t"]]
    sets = {frozenset(c) for t, _ in labelled for k in range(1, len(t) + 1) for c in combinations(sorted(t), k)}
    rules = []
    for a in sets:
        held = [v for t, v in labelled if a <= t]
        for v in ("allow", "block"):
            n = held.count(v)
            if n >= url_rules.MIN_SUPPORT * len(labelled) and n and n / len(held) >= url_rules.MIN_CONFIDENCE:
                rules.append((n / len(held), n / len(labelled), len(a), v, a))
    expected = []
    for r in rows:
        fits = [x[:4] for x in rules if x[4] <= set(r["t"])]
        expected.append((r["page_id"], r["fit"]["verdict"] if r["fit"] else max(fits)[3] if fits else "allow"))
    got = [(r["page_id"], r["verdict"]) for r in url_rules.filter_urls(pages).collect()]
    assert sorted(got) == sorted(expected) and {v for _, v in got} == {"allow", "block"}


def test_long_urls_keep_all_tokens(spark):
    url = "http://" + ".".join("abcdefgh") + "/" + "/".join("s" * i for i in range(1, 300)) + "?" + "&".join(f"k{i}=1" for i in range(90))
    got = url_rules.filter_urls(spark.createDataFrame([(1, url), (None, url), (2, "http://a.net/")], "page_id long, url string"))
    # the label a of a.net is the eighth from the end of the long URL's host
    assert {(r["page_id"], r["verdict"]) for r in got.collect()} == {(1, "block"), (None, "block"), (2, "block")}
    frame = spark.createDataFrame([(url,)], "url string").select(url_rules.tokens_of(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("t"))
    assert len(frame.first()["t"]) == 8 + 299 + 90


def test_tokens_far_down_a_url_make_rules(spark):
    deep = lambda i, last: f"http://h{i % 3}.x/" + "/".join(f"d{k}" for k in range(12)) + f"/{last}?a=1&b=2&c=3&d=4&e=5&f=6&g=7&{last}=1"
    label = "a very long label of more than a hundred characters " * 3
    rows = [(i, deep(i, "bad"), label) for i in range(40)] + [(i + 40, deep(i, "good"), "fine") for i in range(40)]
    rows += [(100, "http://new.y/p?bad=2", None), (101, "http://new.y/p/good", None), (102, "http://new.y/d0", None)]
    got = {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string, l string"), label_col="l", rules=(("x", "none/"),), default="?").collect()}
    assert (got[100], got[101], got[102]) == (label, "fine", "?")


def test_a_shared_long_url_is_one_item(spark):
    """A third of all labelled pages have one URL of hundreds of tokens: their combinations are never listed."""
    long = "http://a.net/" + "/".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    rows = [(i, long) for i in range(60)] + [(i + 60, f"http://b.net/p{chr(97 + i % 20)}/x") for i in range(120)] + [(200, "http://q.com/tbb"), (201, "http://q.com/zz")]
    got = {r["page_id"]: r for r in url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), default="none").collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "none"


def brute(docs, items, threshold=0.8):
    import re

    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = set()
    for i, text in items:
        w = words(text)
        k = min(5, len(w))
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for d, body in docs:
            b = words(body)
            if want and len(want & {tuple(b[j : j + k]) for j in range(len(b) - k + 1)}) >= threshold * len(want) - 1e-9:
                out.add((d, i))
    return out


def test_contamination_equals_brute_force(spark):
    base = [f"w{j}" for j in range(40)]
    item = " ".join(base)
    changed = base.copy()
    changed[20] = "other"
    docs = [
        (1, "start " + item + " end"), (2, " ".join(changed)), (3, " ".join(base[:30])), (4, None), (5, ""), (6, ("pad " * 5000) + item.upper().replace(" ", ", ")),
        (7, "tiny text here"), (8, "not it"), (1, "start " + item + " end"), (9, " ".join(base[:34])),
    ]
    items = [(10, item), (11, "Tiny text"), (12, None), (13, "..."), (14, "one two three four five six")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert pairs == brute(docs, items) and (6, 10) in pairs and (7, 11) in pairs and (2, 10) in pairs
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in brute(docs, items)}


def test_schemas_with_several_null_and_unknown_types(spark):
    rows = [("f", "x", "integer", False), ("f", "x", "string", True), ("f", None, "string", True), ("f", "y", None, False), ("f", "z", "date", False), ("g", None, None, None), (None, "x", "string", True)]
    own = spark.createDataFrame(rows, "name string, field string, type string, required boolean")
    calls = [(1, i, name, text, None, 0) for i, (name, text) in enumerate([("f", '{"x":1}'), ("f", '{"x":"a"}'), ("f", '{"x":true}'), ("f", "{}"), ("f", '{"x":1,"y":1}'), ("f", '{"x":1,"z":"2020"}'), ("g", "{}"), ("g", '{"a":1}'), (None, "{}")])]
    frame = spark.createDataFrame(calls, "conv_id long, call_id long, name string, arguments string, after long, pos long")
    got = tool_calls.validated(frame.withColumn("n_calls", F.lit(1)), own)
    assert {r["call_id"]: r["errors"] for r in got.collect()} == {
        0: [], 1: [], 2: ["type x"], 3: ["missing x"], 4: ["type y"], 5: ["type z"], 6: [], 7: ["unknown a"], 8: ["no schema"],
    }
