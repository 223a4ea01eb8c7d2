"""Every operator and stage on empty tables, and on tables whose extra columns bear the names that the operators use inside."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quarry import llm
from quarry.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMAS = {
    "documents": DOCS,
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int",
}
LINES = "one two three four\nfive six seven eight\nnine ten eleven twelve\nthirteen fourteen fifteen sixteen\n" * 3
ROWS = {
    "documents": [(i, f"{LINES}line of {i} and {i * i}\nwhat a pathetic idiot" if i % 3 else f"plain words {i}", "en", f"s{i % 2}", 9) for i in range(12)]
    + [(None, None, None, None, None), (3, None, "en", None, 0), (40, "", None, "s0", 0), (41, " \n ", "en", "s1", 3)]
    + [(42, "same text", "de", "s1", 9)] * 2,
    "embeddings": [(i, [float(i % 5), 1.0, -float(i)], 0) for i in range(0, 300, 10)] + [(None, [1.0, 1.0, 1.0], 0), (7, None, 0), (8, [0.0, 0.0, 0.0], 0)],
    "pages": [(i, u, "") for i, u in enumerate(["http://a.example.net/en/x", "https://example.com/de/?q", "HTTP://B.ORG", None, "", "none", "http://fr.org/fr/1#x"])] + [(1, "http://x.net/", None)] * 2,
    "labels": [(i, 1, int(i % 3 > 0)) for i in range(12)] + [(None, 1, 1), (2, None, None), (2, 1, 1)],
}


def names():
    """What the operators call their columns: every short lower-case string literal of theirs that could be one."""
    found = set()
    for f in Path(llm.__file__).parent.glob("*.py"):
        found |= set(re.findall(r'"([a-z][a-z_0-9]{0,15})"', f.read_text()))
    own = {c.split()[0] for s in SCHEMAS.values() for c in s.split(", ")}
    return sorted(found - own - {"array", "double", "long", "int", "string"})


def write(spark, top, rows, extra):
    for t, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(t, []), schema).coalesce(1)
        if extra:
            df = df.select("*", *[F.lit(f"clash {n}").alias(n) for n in names()])
        df.write.parquet(f"{top}/{t}.parquet")
    return str(top)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    make = lambda what, *a: write(spark, tmp_path_factory.mktemp(what), *a)
    return {"plain": make("plain", ROWS, False), "extra": make("extra", ROWS, True), "empty": make("empty", {}, False)}


def told(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_operator(spark, tables, name):
    q = registry.queries()[name]
    assert told(q(spark, tables["empty"])) == []
    plain = q(spark, tables["plain"])
    want = told(plain)
    assert want and told(q(spark, tables["extra"])) == want


@pytest.mark.parametrize("k", range(len(C.STAGES)))
def test_stage(spark, tables, k):
    _, stage = C.STAGES[k]
    run = lambda what: stage(spark, spark.read.parquet(f"{tables[what]}/documents.parquet"), tables[what])
    assert told(run("empty")) == []
    plain = run("plain")
    assert k == len(C.STAGES) - 1 or plain.columns == [c.split()[0] for c in DOCS.split(", ")]
    want = told(plain)
    assert want and told(run("extra")) == want
