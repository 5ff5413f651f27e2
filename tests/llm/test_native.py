"""Chat formatting and URL filters against plain versions and DuckDB."""

import re

import duckdb
import numpy as np
import pytest

from tallyhound.llm import chat, urlfilter
from tallyhound.llm.asof import as_of


def same(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from '{path}/*.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(spark_rows.columns)
    assert sorted(map(repr, map(tuple, spark_rows.select(*names).collect()))) == sorted(map(repr, got.fetchall()))


CHAT = [
    (1, 0, "user", "Hello there\nHow are  you?"),
    (1, 1, "assistant", "> how are you?\nFine.\nAnd you?"),
    (1, 2, "user", "Anna wrote:\n> And you?\n>> How are you?\nGood, thanks"),
    (1, 3, "user", "> Hello THERE\nLate answer to the first"),
    (1, 4, "assistant", "on it"),
    (1, 5, "user", ">> hello there\nonly a deep quote"),
    (1, 5, "assistant", "same turn"),
    (1, 6, "user", "> never said\n> Good, thanks\n> on it"),
    (2, 0, "user", None),
    (2, 0, "user", None),
    (2, None, None, "no turn\n"),
    (None, 3, "user", "x wrote:\nnot above a quote"),
    (None, 4, "user", ">x wrote:\n"),
    (3, 7, "user", "> future line"),
    (3, 9, "user", "future line"),
    (4, 0, "user", ""),
    (6, 0, "user", "The quick brown fox jumps over the lazy dog in the morning\nthen it sleeps until noon comes around again"),
    (6, 1, "assistant", "something else altogether is said in this one here"),
    (6, 2, "user", "> The quick brown fox jumps\n> over the lazy dog in the morning\nre-wrapped"),
    (6, 3, "user", "> lazy dog in the morning then it sleeps\n>> something else altogether is\n> until noon\ncut and over the line break"),
    (6, 4, "user", ">>something else altogether\n>> is said in this\n> re-wrapped\ntwo levels"),
    (6, 5, "user", "> the  QUICK brown fox jumps over\n\n> quite another thing\nparagraphs"),
] + [(5, i, "user", f"line {i % 7}\nagain" if i % 5 else f"> line {i % 7}\n> again\nyes {i}") for i in range(3000)]


def test_chat(spark, tmp_path):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    df = df.selectExpr("*", "1 AS conv", "'x' AS own", "2 AS position").repartition(4)
    got = chat.format_chat(df).cache()
    by = {(r.conv_id, r.turn, r.role): r for r in got.collect()}
    assert by[1, 1, "assistant"].text == "Fine.\nAnd you?" and by[1, 1, "assistant"].reply_to == 0
    third = by[1, 2, "user"]
    assert (third.text, third.n_quoted, third.max_level, third.reply_to) == ("Good, thanks", 2, 2, 1)
    late = by[1, 3, "user"]
    assert (late.reply_to, late.thread) == (0, 0)
    assert by[1, 5, "user"].reply_to == 0 and by[1, 6, "user"].reply_to == 2
    assert by[6, 2, "user"].reply_to == 0 and by[6, 3, "user"].reply_to == 0 and by[6, 4, "user"].reply_to == 2 and by[6, 5, "user"].reply_to == 0
    assert by[2, None, "user"].position == 1 and by[2, 0, "user"].text == ""
    assert by[None, 3, "user"].text == "x wrote:\nnot above a quote"
    assert by[3, 7, "user"].reply_to is None
    same(got, chat.OP3_SQL, conversations=tmp_path / "conversations.parquet")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_reply_trees(spark):
    """Branches, nested quotes over two levels, a text id `null` beside a null id: order by replies, read off by hand."""
    said = ["one alpha", "two beta", "three gamma", "four delta", "five epsilon", "six zeta", "seven eta", "eight theta"]
    quotes = {3: [1], 4: [2], 5: [3], 6: [1], 8: [4]}  # the others reply to the one before
    rows = [("null", t, "user", "\n".join([f"> {said[q - 1]}" for q in quotes.get(t, [])] + [said[t - 1]])) for t in range(1, 9)]
    rows += [(None, 2, "user", "> two beta\nof another"), (None, 1, "user", "first")]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    # 1 -> 2, 3, 6; 2 -> 4; 3 -> 5; 6 -> 7; 4 -> 8
    assert [t for _, t in sorted((by["null", t].position, t) for t in range(1, 9))] == [1, 2, 4, 8, 3, 5, 6, 7]
    assert {by["null", t].thread for t in range(1, 9)} == {1} and by["null", 5].reply_to == 3 and by["null", 7].reply_to == 6
    assert by[None, 2].reply_to == 1 and by[None, 2].position == 2 and by[None, 1].thread == 1


def test_reply_order_of_random_trees(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for conv in range(12):
        n = int(rng.integers(1, 120))
        turns = np.sort(rng.choice(5000, n, replace=False)).tolist()
        sizes = rng.integers(1, 4, n).tolist()
        wild = conv % 3
        up = [None] + [turns[i - 1] if rng.random() < (0.7, 0.0, 0.95)[wild] else turns[int(rng.integers(0, i))] if wild != 1 or rng.random() < 0.5 else turns[max(0, i - 2)] for i in range(1, n)]
        rows += [(str(conv), t, u, turns[i - 1] if i else None, s) for i, (t, u, s) in enumerate(zip(turns, up, sizes, strict=True))]
        size, at, todo = dict(zip(turns, sizes, strict=True)), 0, [turns[0]]
        while todo:
            t = todo.pop()
            want[str(conv), t] = (turns[0], at)
            at += size[t]
            todo += [c for c, u in reversed(list(zip(turns, up, strict=True))) if u == t]
    got = chat.reply_order(spark.createDataFrame(rows, "conv string, turn long, reply_to long, before long, n long")).collect()
    assert {(r.conv, r.turn): (r.thread, r.ahead) for r in got} == want and len(got) == len(want)


def test_as_of(spark):
    rng = np.random.default_rng(0)
    left = [(f"k{rng.integers(4)}", int(t), i) for i, t in enumerate(rng.integers(-50, 500, 400))] + [("k0", None, 1000), ("none", 3, 1001)]
    right = sorted({(f"k{rng.integers(4)}", int(t)) for t in rng.integers(-50, 500, 60)})
    right = [(k, t, f"{k}@{t}") for k, t in right]
    got = as_of(spark.createDataFrame(left, "key string, time long, id int"), spark.createDataFrame(right, "key string, time long, value string"), 16).collect()
    want = {}
    for k, t, i in left:
        fine = [(u, v) for q, u, v in right if q == k and t is not None and u <= t]
        want[i] = max(fine)[1] if fine else None
    assert {r.id: r.value for r in got} == want and len(got) == len(left)


def plain_host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url)
    return m[1].rstrip(".").lower() if m else ""


def plain_patterns(url):
    host = plain_host(url)
    if not host:
        return set()
    labels = host.split(".")
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", url)
    parts = [x for x in (m[1] if m else "").split("/") if x]
    return {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[:i]) + "/" for i in range(1, len(parts) + 1)}


def test_filter_urls(spark):
    rng = np.random.default_rng(3)
    hosts = ["a.example.org", "b.a.example.org", "example.com", "x.net", "localhost"]
    urls = [f"http{'s' * int(rng.integers(2))}://{rng.choice(hosts)}/{rng.choice(['', 'p/q/r', 'p', 'q/z?x=1', '//p#f'])}" for _ in range(200)]
    urls += [None, "", "no url", "https://user@EXAMPLE.com.:80/p/q", "mailto:x@y.z", "http:///path"]
    captures = [(i, u, int(rng.integers(0, 10**12)) if i % 9 else None) for i, u in enumerate(urls * 2)]
    names = sorted({p for u in urls if u for p in plain_patterns(u)})
    entries = [(str(rng.choice(names)), str(rng.choice(["block", "allow", "drop"])), int(rng.integers(0, 10**12))) for _ in range(150)]
    entries += [entries[0], (entries[1][0], "allow", entries[1][2]), (None, "block", 1), ("x.net", None, 1), ("x.net", "block", None)]
    got = urlfilter.filter_urls(spark.createDataFrame(captures, "id int, url string, fetched_at long").selectExpr("*", "7 AS key", "'old' AS rule"), spark.createDataFrame(entries, "pattern string, action string, listed_at long")).collect()
    assert len(got) == len(captures)
    for r in got:
        best = None
        for p in plain_patterns(r.url) if r.url and r.fetched_at is not None else ():
            log = [(t, a) for q, a, t in entries if q == p and a and t is not None and t <= r.fetched_at]
            if log and max(log)[1] != "drop":
                best = max(best or (0, "", ""), (len(p), p, max(log)[1]))
        assert (r.rule, r.action) == (best[1:] if best else (None, None)) and r.blocked == bool(best and best[2] == "block")


def test_deep_and_capital_paths(spark):
    captures = [(0, "https://example.com/Casino/x"), (1, "https://example.com/casino/x"), (2, "https://x.net/a/b/c/d/page"), (3, "https://x.net/a/b/c/e"), (4, "https://X.net//a/b//c/d")]
    entries = [("Example.com/Casino/", "block", 1), ("x.net/a/b/c/d/", "block", 1), ("x.net/a/", "allow", 1)]
    got = urlfilter.filter_urls(spark.createDataFrame([(*c, 5) for c in captures], "id int, url string, fetched_at long"), spark.createDataFrame(entries, "pattern string, action string, listed_at long"))
    assert sorted(got.select("id", "rule", "blocked").collect()) == [(0, "example.com/Casino/", True), (1, None, False), (2, "x.net/a/b/c/d/", True), (3, "x.net/a/", False), (4, "x.net/a/b/c/d/", True)]


def test_intervals(spark):
    log = [("x", "block", 5), ("x", "drop", 9), ("x", "allow", 12), ("y", "block", 1)]
    got = urlfilter.intervals(spark.createDataFrame(log, "pattern string, action string, listed_at long"))
    assert sorted(map(tuple, got.collect())) == [("x", "allow", 12, None), ("x", "block", 5, 9), ("y", "block", 1, None)]


@pytest.mark.parametrize("name", ["op3_chat_format", "op6_url_filter"])
def test_queries_against_sql(spark, name):
    from tallyhound.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("conversations", "pages", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries()[name](spark, sf), con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
