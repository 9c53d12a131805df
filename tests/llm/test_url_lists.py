import datetime
import random

from larder.llm.url_lists import host_of, judge_captures, path_of, rule_keys, validity
from pyspark.sql import functions as F

EVENT = "list_id string, key string, action string, verdict string, day date"


def _day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def test_parts_of_a_url(spark):
    urls = ["https://User@WWW.Example.com:80/A/b/c.html?q#f", "http://h.", "ftp://a.b.c", "no url", "", None, "http:///x", "HTTP://X.org/a//b/"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")), path_of(F.col("u")), rule_keys(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["www.example.com", "h", "a.b.c", "", "", "", "", "x.org"]
    assert rows[0][1] == "/A/b/c.html" and rows[0][2] == ["www.example.com/A/b/c.html", "www.example.com/A/b/", "www.example.com/A/", "www.example.com", "example.com"]
    assert rows[2][2] == ["a.b.c", "b.c"] and rows[3][2] == [] and rows[7][2][1:] == ["x.org/a/", "x.org"]


def test_intervals(spark):
    events = [("l", "k", "add", "block", _day(1)), ("l", "k", "add", "block", _day(1)), ("l", "k", "remove", "block", _day(5)), ("l", "k", "add", "allow", _day(7)),
              ("l", "k", "remove", "allow", _day(7)), (None, "k", "add", "block", _day(1)), ("l", None, "add", "block", _day(1)), ("l", "k", "odd", "block", _day(2)),
              ("l", "k", "add", "block", None), ("m", "k", "add", "block", _day(3)), ("m", "k", "add", "allow", _day(3))]
    got = sorted((r.verdict, r.valid_from, str(r.valid_to)) for r in validity(spark.createDataFrame(events, EVENT)).collect())
    assert got == [("allow", _day(7), "9999-12-31"), ("block", _day(1), str(_day(5))), ("block", _day(3), "9999-12-31")]


def test_against_brute_force(spark):
    draw = random.Random(6)
    hosts = ["a.x.org", "b.x.org", "x.org", "y.net"]
    keys = hosts + ["a.x.org/p/", "a.x.org/p/q/", "a.x.org/p/q/f", "y.net/p/"]
    events = [(f"l{draw.randrange(2)}", draw.choice(keys), draw.choice(["add", "add", "remove"]), draw.choice(["block", "allow"]), _day(draw.randrange(40))) for _ in range(60)]
    captures = [(i, f"https://{draw.choice(hosts[:1] * 5 + hosts)}{draw.choice(['', '/', '/p', '/p/q', '/p/q/f', '/p/q/g?x'])}", _day(draw.randrange(45))) for i in range(400)]
    state = {}
    for lst, key, action, verdict, day in events:
        rank = 0 if action == "remove" else 2 if verdict == "block" else 1
        state[lst, key, day] = max(state.get((lst, key, day), 0), rank)
    want = {}
    for i, url, day in captures:
        host, _, path = url[8:].split("?")[0].partition("/")
        steps = [s for s in path.split("/") if s]
        mine = [host + ("/" + path if "/" in url[8:] else "")] + [f"{host}/{'/'.join(steps[:n])}/" for n in (2, 1) if len(steps) > n]
        labels = host.split(".")
        mine += [".".join(labels[k:]) for k in range(len(labels) - 1)]
        want[i] = (None, True)
        for key in mine:
            now = []
            for lst in ("l0", "l1"):
                past = [d for (ls, k, d) in state if ls == lst and k == key and d <= day]
                if past and state[lst, key, max(past)]:
                    now.append(state[lst, key, max(past)])
            if now:
                want[i] = (key, max(now) != 2)
                break
    got = judge_captures(spark.createDataFrame(captures, "page_id long, url string, day date").repartition(4), spark.createDataFrame(events, EVENT))
    assert {r.page_id: (r.rule, r.allowed) for r in got.collect()} == want


def test_folders_of_every_level(spark):
    events = [("l", "h.org/a/b/c/", "add", "block", _day(0)), ("l", "h.org/a/b/c/d/e/f/", "add", "allow", _day(0)), ("l", "h.org/a/", "add", "allow", _day(0))]
    urls = ["/a/b/c/x", "/a/b/c/d/x", "/a/b/c/d/e/f/g/x", "/a/b/x", "/b/c/x"]
    captures = spark.createDataFrame([(i, f"http://h.org{u}", _day(1)) for i, u in enumerate(urls)], "page_id long, url string, day date")
    got = {r.page_id: (r.rule, r.allowed) for r in judge_captures(captures, spark.createDataFrame(events, EVENT)).collect()}
    assert got == {0: ("h.org/a/b/c/", False), 1: ("h.org/a/b/c/", False), 2: ("h.org/a/b/c/d/e/f/", True), 3: ("h.org/a/", True), 4: (None, True)}


def test_rows_of_every_kind(spark):
    rows = [(1, "http://bad.org/", _day(3), "z", 1), (1, "http://bad.org/", _day(3), "z", 1), (2, None, _day(3), "z", 1), (3, "", _day(3), "z", 1), (4, "http://bad.org", None, "z", 1),
            (None, "http://bad.org/" + "p" * 100_000, _day(3), None, None), (5, "http://bad.org", _day(0), "z", 1)]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date, rule string, seen int")
    events = spark.createDataFrame([("l", "bad.org", "add", "block", _day(2))], EVENT)
    got = judge_captures(captures, events)
    assert got.columns == ["page_id", "url", "day", "seen", "rule", "allowed"]
    assert sorted((str(r.page_id), r.allowed) for r in got.collect()) == [("1", False), ("1", False), ("2", True), ("3", True), ("4", True), ("5", True), ("None", False)]
    assert judge_captures(captures, events.limit(0)).where("allowed").count() == len(rows)
    assert judge_captures(captures.limit(0), events).count() == 0
