"""URL filters by a sort-merge range join.

Hosts are written backwards, label by label, each followed by a dot (``net.example.``): a rule's host is then a prefix, and its subdomains fill
the interval of keys that begin with it. Such intervals nest or lie apart. URLs are sorted by key within ranges; a sweep in key order keeps
a stack of the rules whose intervals are open, and asks those from the longest rule down whether the URL's path begins with theirs.

Ranges are cut at quantiles of the keys with a salt of the row behind them, so one host may span many ranges (a hot host doesn't gather
in one task). At most CUTS cuts are broadcast; where that makes ranges of more than ROWS rows, each is dealt into as many parts as it takes, by
the salt, and every part is swept by itself, so parts hold about ROWS rows at any size. Rules go to every part of every range that their
interval touches, by a join on the part's number.

Defined cases: a null url, or one without ``://``, has host and path empty and gets the default verdict. Dots at a host's end and empty labels
count as labels; ports and user names belong to the host as the contract cuts it. The longest rule (host and path together) wins; a tie
goes to the longer host, then to block. A rule given twice counts once. Null ids and repeated rows keep their rows, and are spread like others.
Very long urls are compared whole. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
ROWS, CUTS = 50_000, 4096


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path; empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def sweep(urls: list[tuple[str, str]], rules: list[tuple[str, str, str, str]]) -> list[tuple[str | None, str | None]]:
    """urls: (key, path), sorted by key. rules: (key, path, rule, verdict). Of each url the rule that holds, and its verdict."""
    rules = sorted(set(rules), key=lambda r: r[0])
    out, stack, k = [], [], 0
    for key, path in urls:
        while k < len(rules) and rules[k][0] <= key:
            while stack and not rules[k][0].startswith(stack[-1][0]):
                stack.pop()
            if not stack or stack[-1][0] != rules[k][0]:
                stack.append((rules[k][0], {}, []))
            _, paths, sizes = stack[-1]
            p = rules[k][1]
            if p not in paths or rules[k][3] == "block":
                paths[p] = rules[k]
            if len(p) not in sizes:
                sizes.insert(bisect_left(sizes, len(p)), len(p))
            k += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for _, paths, sizes in stack:
            for n in reversed(sizes[: bisect_right(sizes, len(path))]):
                if r := paths.get(path[:n]):
                    if best is None or len(r[2]) >= len(best[2]):
                        best = r
                    break
        out.append((best[2], best[3]) if best else (None, None))
    return out


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """rules: (verdict, rule), a rule being host/path. (page_id, host, path, rule, verdict) for each row of pages."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    reverse = lambda h: F.when(h == "", "").otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(h, r"\."))), F.lit(".")))
    # the salt sorts after the key's last dot: a key's rows stay together, spread by id and place, so that repeated rows are spread too
    rows = rows.withColumn("key", reverse(F.col("host"))).withColumn("salt", F.xxhash64("page_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("salted", F.concat("key", F.lit("\x00"), F.lower(F.lpad(F.hex("salt"), 16, "0"))))
    n = rows.count()
    # a range for each ROWS rows, and no fewer than the session deals out, if they get a few dozen rows each
    wanted = min(CUTS, max(n // ROWS + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50 + 1)))
    parts_ = max(1, -(-n // (wanted * ROWS)))
    cuts: list[str] = []
    if wanted > 1:
        sample = rows.filter(F.pmod(F.xxhash64("salt"), F.lit(1 << 20)) < min(1.0, 64 * wanted / n) * float(1 << 20))
        keys = sorted(r.salted for r in sample.select("salted").limit(256 * CUTS).collect())
        cuts = sorted({keys[i * len(keys) // wanted] for i in range(1, wanted)}) if keys else []
    shared = spark.sparkContext.broadcast(cuts)

    def place(batches):
        for b in batches:
            at = [bisect_right(shared.value, s) * parts_ + i % parts_ for s, i in zip(b.column("salted").to_pylist(), b.column("salt").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "key")), pa.array(at, pa.int64())], ["page_id", "host", "path", "key", "range"])

    def spread(batches):
        for b in batches:
            got = []
            for verdict, rule in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host, _, path = rule.partition("/")
                k = key_of(host)
                # the interval of keys that begin with k; code points above the salt's end it
                lo, hi = bisect_right(shared.value, k), bisect_right(shared.value, k + "\U0010ffff")
                got += [(i, k, "/" + path, rule, verdict) for i in range(lo * parts_, (hi + 1) * parts_)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64() if i == 0 else pa.string()) for i in range(5)], ["range", "key", "path", "rule", "verdict"])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a = a.sort_by("key")  # by code points, as Python compares
        got = sweep(list(zip(a.column("key").to_pylist(), a.column("path").to_pylist())), list(zip(*(b.column(c).to_pylist() for c in ("key", "path", "rule", "verdict")))))
        return pa.table({"page_id": a.column("page_id"), "host": a.column("host"), "path": a.column("path"), "rule": pa.array([g[0] for g in got], pa.string()), "verdict": pa.array([g[1] or default for g in got], pa.string())})

    left = rows.mapInArrow(place, "page_id long, host string, path string, key string, range long")
    right = rules.select("verdict", "rule").filter("rule is not null").mapInArrow(spread, "range long, key string, path string, rule string, verdict string")
    return left.groupBy("range").cogroup(right.groupBy("range")).applyInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def query(pages: DataFrame) -> DataFrame:
    return judge(pages, pages.sparkSession.createDataFrame(RULES, "verdict string, rule string"))


SQL = r"""
with p as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p
), r(verdict, rule, rh, rp) as (
  values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
)
select page_id, host, path,
  (select r.rule from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(r.rule) desc limit 1) "rule",
  coalesce((select r.verdict from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(r.rule) desc limit 1), 'allow') verdict
from h
"""
