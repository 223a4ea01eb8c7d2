import random

import corpus_pipeline as C
from quarry.llm import mixing, packing, simhash


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(6)
    words = [a + b for a in ("mon", "tar", "bel", "kun", "vor", "lim") for b in ("a", "eth", "ilo", "ust", "ing", "or")]
    line = lambda: " ".join(rng.choice(words) for _ in range(9))
    shared = [line() for _ in range(14)]
    rows, labels = [], []
    for i in range(400):
        lines = [line() for _ in range(rng.randint(2, 12))]
        if i % 8 == 0:
            lines.append("what a pathetic idiot scum")
        if i % 9 == 0:
            lines[1:1] = shared
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    rows += [(500 + i, rows[i][1], "en", "s1", 0) for i in range(1, 40)] + [(900, None, None, None, None), (901, "", "en", None, 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    was = docs
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, was, d).write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
        if name == "toxicity":
            assert now.columns == docs.columns
            ids = {r.doc_id for r in now.collect()}
            assert {i for i in range(400) if i % 8 == 0}.isdisjoint(ids) and len(ids) >= 0.97 * (len(rows) - 50 - 5)
        if name == "line_dedup":
            assert now.columns == docs.columns and now.count() == was.count()
        if name == "simhash":
            left = {r.doc_id for r in now.collect()}
            assert left == {r.doc_id for r in simhash.near_duplicates(was).collect() if r.doc_id == r.component_id} and len(left) < was.count()
        if name == "mixing":
            assert sorted(map(str, now.collect())) == sorted(map(str, mixing.mixed(was).collect()))
        was = now
    run = C.run(spark, d)
    assert run.columns == packing.query(docs).columns
    assert sum(r.length for r in run.collect()) == sum(r.length for r in was.collect())
