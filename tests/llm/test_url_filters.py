import random

import duckdb
import pytest

from quarry.llm import url_filters as U

HOSTS = ["net", "example.net", "a.example.net", "b.a.example.net", "examplenet", "org", "x.org", "example.com", "EXAMPLE.com", "notexample.com", "", "é.net", "a..net", "net."]
PATHS = ["", "/", "/en", "/en/", "/en/x", "/de/1", "/fr/", "/fr/y?z=/en/", "?q=/en/", "#/en/"]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for v, r in rules:
        rh, _, rp = r.partition("/")
        if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp):
            fits.append((len(r), len(rh), v == "block", r, v))
    best = max(fits, default=(0, 0, 0, None, default))
    return host, path, best[3], best[4]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(3)


def test_query_and_sql(spark, tmp_path):
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "", "://") for h in HOSTS for p in PATHS] + [None, "", "no scheme", "a://b://net/"] * 2
    df = pages(spark, urls)
    got = sorted(tuple(r) for r in U.query(df).collect())
    assert got == [(i, *brute(u, U.RULES)) for i, u in enumerate(urls)]
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    duckdb.sql(f"create or replace view pages as select page_id, url from '{tmp_path}/p/*.parquet'")
    sql = {r[0]: r for r in duckdb.sql(U.SQL).fetchall()}
    assert all(sql[r[0]] == r for r in got if urls[r[0]] is not None)


@pytest.mark.parametrize("most", [4096, 3])  # ranges as many as it takes, and few, each in parts
def test_many_nested_rules_over_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(U, "ROWS", 100)
    monkeypatch.setattr(U, "CUTS", most)
    rng = random.Random(4)
    label = lambda: rng.choice("abc")
    rules = [(rng.choice(["block", "allow"]), ".".join(label() for _ in range(rng.randint(1, 4))) + rng.choice(["/", "/x", "/x/", "/xy/", "/x/y/"])) for _ in range(150)]
    rules = list({r: v for v, r in rules}.items())
    rules = [(v, r) for r, v in rules]
    urls = [f"http://{'.'.join(label() for _ in range(rng.randint(1, 5)))}{rng.choice(['', '/', '/x', '/x/y/z', '/xy/', '/q'])}" for _ in range(600)] + ["http://hot.a/x/1"] * 600 + ["http://" + "a." * 3000 + "b/" + "x/y" * 50_000]
    got = sorted(tuple(r) for r in U.judge(pages(spark, urls), spark.createDataFrame(rules, "verdict string, rule string")).collect())
    assert got == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


def test_empty(spark):
    assert U.query(pages(spark, ["http://a"]).filter("false")).count() == 0
    none = spark.createDataFrame([], "verdict string, rule string")
    assert [r.verdict for r in U.judge(pages(spark, ["http://a.net/"]), none).collect()] == ["allow"]
