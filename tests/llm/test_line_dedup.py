import random

from quarry.llm import line_dedup as L


def seams(text):
    """(first line, last line, text) of each two lines with words that have at most blank lines between them."""
    lines = text.split("\n")
    words = [k for k, x in enumerate(lines) if x.strip()]
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(words, words[1:])]


def brute(rows):
    """Lines with words that are left, by (id, text), without the operator's own cutting: a line goes if two lines with it in them came before."""
    first = {}
    order = lambda i, t: (i is None, i or 0, t)
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: order(*r)):
        for a, _, s in seams(t):
            first.setdefault(s, (i, t, a))
    out = {}
    for i, t in set(rows):
        if t is None:
            out[i, t] = None
            continue
        gone = {k for a, b, s in seams(t) if first[s] != (i, t, a) for k in range(a, b + 1)}
        out[i, t] = [x for k, x in enumerate(t.split("\n")) if x.strip() and k not in gone]
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(6))
    passage = [line() for _ in range(12)]
    rows = []
    for i in range(200):
        lines = [line() for _ in range(rng.randint(0, 15))]
        if i % 3 == 0:
            k = rng.randint(0, len(lines))
            lines[k:k] = passage
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n"])))
    rows += [(500, None), (501, ""), (502, "\n\n\n\n\n\n\n\n"), (503, "one line"), (None, "\n".join(passage)), (504, "\n".join(passage * 2)), (505, "é\n" * 500), (7, rows[7][1])]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, line_key string, n_lines int").repartition(3)
    got = L.cleaned(df).collect()
    want = brute(rows)
    left = lambda t: None if t is None else [x for x in t.split("\n") if x.strip()]
    assert sorted(str((r.doc_id, left(r.text))) for r in got) == sorted(str((k[0], want[k])) for k in rows)
    lost = sum(r.line_removed for r in got)
    assert lost > 300
    for r in got:
        if r.doc_id is not None and r.doc_id < 200 and r.line_removed:
            assert len(r.text.split("\n")) in (r.line_total - r.line_removed, r.line_total - r.line_removed + 1)
    assert {r.n_removed for r in L.query(df).filter("doc_id in (500, 501, 502, 503)").collect()} == {0}


def test_boundaries_shift_with_content():
    text = "\n".join(f"line number {i * i}" for i in range(80)).encode()
    a = L.chunks(text)[2]
    b = L.chunks(b"new first line\nanother\n" + text)[2]
    assert len(set(a) & set(b)) >= len(a) - 2 and len(a) > 8


def test_empty(spark):
    assert L.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_passages_go(spark):
    """Passages of any length from two lines on, at any place, blank lines within: all but the first goes, and what is around them stays."""
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(9))
    rows, want = [], {}
    for n in range(2, 14):
        passage = [line() for _ in range(n)]
        if n % 3 == 0:
            passage[1:1] = ["", " "]
        for k in range(8):
            before, after = [line() for _ in range(rng.randint(0, 5))], [line() for _ in range(rng.randint(1, 5))]
            rows.append((100 * n + k, "\n".join(before + passage + after)))
            want[100 * n + k] = "\n".join(before + (after if k else passage + after)), len(passage) if k else 0
    got = {r.doc_id: (r.text, r.line_removed) for r in L.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_one_line_repeats_stay(spark):
    rows = [(i, f"own line {i}\nshared line\nother line {i}") for i in range(9)]
    assert {r.line_removed for r in L.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_blank_lines_of_its_own_stay(spark):
    rows = [(1, "w1 x\nw2 y"), (2, "w1 x\nw2 y\n\n\n\n"), (3, "w1 x\nw2 y\n"), (4, "\n\nw1 x\nw2 y\nz")]
    got = {r.doc_id: (r.text, r.line_removed) for r in L.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n\n\n", 2), 3: ("", 2), 4: ("\n\nz", 2)}


def test_very_long_text(spark):
    lines = [f"line {i} of {i * i}" for i in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "own line\n" + "\n".join(lines[100:40_000]) + "\nits last"), (3, "x " * 2_000_000)]
    got = {r.doc_id: (r.text, r.line_removed) for r in L.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("own line\nits last", 39_900), 3: (rows[2][1], 0)}
