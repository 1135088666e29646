import re

from helpers import UPPER

from tillroll.llm.catalog import URL_RULES
from tillroll.llm.url_filter import FEATURES, SMOOTHING, _with_features, judge, matching_rule, parse

URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y=1", "http://example.net/en", "http://example.net/en/",
        "http://badexample.net/en/", "http://x.net", "http://x.net/", "http://net/", "http://net", "https://example.com/de/?a://b/c",
        "https://www.example.com/de/5#top", "https://example.com/fr/5", "https://a.org/fr/", "https://org/fr/1", "https://forg/fr/1",
        "http://x.net:80/", "http://h.com?x=/de/", "http://h.com#/de/", "a://b://c.net/", "http://exämple.NET/ü/", "http://a\n.net/\nen/", "x" * 3000,
        "http://" + "a." * 2000 + "net/", "http://example.com/en/1", "http://example.com/en/1"]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0].translate(UPPER)
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    fits = []
    for rule, verdict in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules_equal_brute_force(spark):
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, "http://a.net/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, suffix string")
    got = judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute("http://a.net/" if r["page_id"] is None else URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        assert (r["score"] is None) == (rule is not None)
    scores = {r["page_id"]: r["score"] for r in got}
    assert scores[27] == scores[28]


def test_one_verdict_none_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in judge(pages, URL_RULES).collect()} == {1: "block", 2: "block"}
    assert judge(pages.where("page_id = 2"), URL_RULES).first()["verdict"] == "allow"
    assert judge(pages.where("false"), URL_RULES).count() == 0


def test_trees_learn_the_lexical_features(spark):
    import random
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    good = lambda h: f"https://{word(letters, 6)}.{h}/fr/{word(letters, 5)}"
    bad = lambda h: f"http://{word('0123456789', 12)}-{word('0123456789', 9)}.{h}/x?a=1&b={word('0123456789', 8)}&c=3"
    rows = [(i, good("org")) for i in range(150)] + [(200 + i, bad("net")) for i in range(150)]
    rows += [(1000 + i, good("info")) for i in range(40)] + [(2000 + i, bad("info")) for i in range(40)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("rule is null").collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] >= 2000) for r in got)
    assert len(got) == 80 and right >= 76


def test_features_equal_brute_force(spark):
    import math
    from collections import Counter

    from pyspark.sql import functions as F
    urls = [u for u in URLS if u is not None and len(u) < 4000] + ["http://a.b.net/x-y/z?p=1&q=2#f", "https://sub.example.com/de/12-3", "http://k.net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    base = parse(pages).withColumn("_m", matching_rule(URL_RULES)).select(
        "id", "url", "host", "path", F.col("_m.verdict").alias("ruled"), F.substring_index("host", ".", -1).alias("suffix"),
        F.substring_index("host", ".", -2).alias("domain"))
    blocked = F.col("ruled") == "block"
    suffixes = base.groupBy("suffix").agg(F.log1p(F.count("*")).alias("suffix_pages"), F.count(F.when(blocked, 1)).alias("suffix_blocked"),
                                          F.count("ruled").alias("suffix_ruled"))
    domains = base.groupBy("domain").agg(F.log1p(F.count("*")).alias("domain_pages"))
    got = {r["id"]: r for r in _with_features(base, suffixes, 99, domains, 99, 0.4).collect()}
    hosts = [brute(u) for u in urls]
    last = [h[0].rsplit(".", 1)[-1] for h in hosts]
    two = [".".join(h[0].split(".")[-2:]) for h in hosts]
    for i, u in enumerate(urls):
        host, path, _, verdict = hosts[i]
        query = u.split("#", 1)[0].rsplit("?", 1)[1] if "?" in u.split("#", 1)[0] else ""
        others = [h[3] for j, h in enumerate(hosts) if last[j] == last[i] and j != i and h[3]]
        want = {"url_chars": len(u), "host_chars": len(host), "path_chars": len(path), "host_labels": len(host.split(".")),
                "path_depth": len(re.findall("/+", path)), "params": query.count("&") + 1 if query else 0,
                "digit_ratio": sum(c in "0123456789" for c in u) / len(u) if u else 0.0, "hyphens": u.count("-"),
                "entropy": -sum(n / len(u) * math.log2(n / len(u)) for n in Counter(u).values()) if u else 0.0,
                "suffix_pages": math.log1p(last.count(last[i])), "domain_pages": math.log1p(two.count(two[i])),
                "suffix_block_rate": (others.count("block") + SMOOTHING * 0.4) / (len(others) + SMOOTHING)}
        assert set(want) == set(FEATURES)
        for name, value in want.items():
            if name == "params" and "?" in u and "#" in u and u.index("#") < u.index("?"):
                continue  # a mark after the fragment's begin is no query
            assert abs(got[i][name] - value) < 1e-9, (u, name, got[i][name], value)


def test_no_python_in_the_plan(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.org/fr/"), (3, "http://b.com/")] * 5, "page_id long, url string")
    plan = judge(pages, URL_RULES)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan
