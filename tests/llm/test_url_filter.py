import random
import re

import pytest
from pyspark.sql import functions as F

from parquill.llm import url_filter
from parquill.llm.url_filter import cascade, filter_urls

ALLOW, BLOCK, HOSTS = ["com/", "www.example.com/en/", "exact.net/a/b"], ["example.com/en/", "net/es/", "net/fr/"], ["bad.org", "spam.example.net"]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(r), len(r.split("/")[0]), r, v) for v, rules in (("allow", ALLOW), ("block", BLOCK)) for r in rules if (host == (h := r[: r.index("/")]) or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
    if fits:
        _, _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in HOSTS) else "allow"


def test_urls_equal_brute_force(spark):
    draw = random.Random(6)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.net", "exact.net", "xexact.net", "bad.org", "x.bad.org", "notbad.org", "spam.example.net", "com", "", "ÉCOLE.com", "a..net"]
    paths = ["", "/", "/en/", "/en", "/en/5", "/es/1", "/fr/", "/a/b", "/a/bc", "/EN/", "//en/"]
    urls = [f"{draw.choice(['http', 'https', ''])}://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '?q=/en/', '#x', '?a://b/c'])}" for _ in range(600)] + [None, "", "no scheme", "://", "a\nb://x.net/es/\nz"]
    frame = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "http://a.net/es/", "h", "r")] * 2, "page_id long, url string, host string, rule string")
    got = filter_urls(frame, allow=ALLOW, block=BLOCK, block_hosts=HOSTS).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = "http://a.net/es/" if r["page_id"] is None else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(url), url


def test_empty_tables_and_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, allow=ALLOW, block=BLOCK, block_hosts=HOSTS).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert filter_urls(one, allow=[], block=[]).first()["verdict"] == "allow"
    with pytest.raises(ValueError):
        filter_urls(one, allow=["a.com/"], block=["a.com/"])


@pytest.mark.parametrize("levels", [40, 2])
def test_cascades_are_exact_over_the_universe(spark, levels, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LEVELS", levels)
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 20_000, 61)] + ["outside"]
    made = cascade(spark.createDataFrame([(k,) for k in listed], "key string"), len(listed), universe, 20_000)
    got = {r["key"] for r in universe.filter(made.has(F.col("key"))).collect()}
    assert got == set(listed) - {"outside"}
    assert len(made.levels) > 1 and bool(made.rest) == (levels == 2)


def test_a_table_of_hosts_in_several_cascades(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LISTED", 300)
    pages = spark.range(4000).select("id", F.concat(F.lit("http://h"), F.col("id") % 2000, F.when(F.col("id") % 3 == 0, ".Sub").otherwise(""), F.lit(".org/x")).alias("url"))
    hosts = spark.range(0, 2000, 2).select(F.concat(F.lit("H"), "id", F.lit(".org")).alias("host")).union(spark.createDataFrame([("h0.org",), (None,)], "host string"))
    got = filter_urls(pages, allow=[], block=[], block_hosts=hosts, id_col="id").filter("verdict = 'block'")
    assert {r["page_id"] for r in got.collect()} == {i for i in range(4000) if i % 3 and i % 2000 % 2 == 0}


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 3000 + "bad.org/" + "x" * 200_000, "http://" + "é" * 100_000 + ".com/en/", "x" * 300_000]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), allow=ALLOW, block=BLOCK, block_hosts=HOSTS).collect()}
    assert got == {0: "block", 1: "allow", 2: "allow"}


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    plan = filter_urls(frame, allow=ALLOW, block=BLOCK)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)
