import hashlib
import random

import numpy as np

from quarry.llm import suffix_dedup as S


def brute(rows):
    least = {}
    raws = [(S.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, r in raws:
        for k in range(len(r) - 49):
            w = r[k : k + 50]
            least[w] = min(i, least.get(w, S.LAST))
    out = []
    for (i, r), (doc, _) in zip(raws, rows):
        over = bytearray(len(r))
        for k in range(len(r) - 49):
            if least[r[k : k + 50]] < i:
                over[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, o in zip(r, over) if not o)
        out.append((doc, len(r), sum(over), sum(1 for k in range(len(r)) if over[k] and not (k and over[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, letters="abcdefgh "):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(rng.randint(40, 200)) for _ in range(6)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 30)
            t += p[a : len(p) - rng.randint(0, 30)] + text(rng.randint(0, 8))
        rows.append((i, t))
    rows += [(500, None), (501, ""), (502, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (4, rows[4][1]), (503, "ä" * 60), (504, "ä" * 61), (505, "z" * 400), (-1, "z" * 120), (506, "ab" * 100), (507, "ba" * 90)]
    rng.shuffle(rows)
    return rows


def test_merge_equals_sorting():
    rng = np.random.default_rng(0)
    for letters in (2, 3, 30):
        strings = [rng.integers(1, letters, rng.integers(25, 60)).astype(np.uint16) for _ in range(50)]
        strings += [strings[0], strings[1][3:40], np.ones(49, np.uint16)]
        start, place, interval = S.repeats(strings, shard=9)
        text = np.concatenate([np.append(s, 0) for s in strings])
        groups = {}
        for p, v in zip(place.tolist(), interval.tolist()):
            groups.setdefault(v, set()).add(p)
        want = {}
        for p in range(len(text)):
            w = text[p : p + S.WIDE]
            key = tuple(w) if len(w) == S.WIDE and 0 not in w else p
            want.setdefault(key, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
        assert sorted(place.tolist()) == list(range(len(text)))


def test_against_brute_force(spark):
    for seed, letters in ((1, "abcdefgh "), (2, "ab"), (3, "aé字")):
        rows = corpus(seed, letters=letters)
        df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, d int, kind string").repartition(3)
        got = sorted((tuple(r) for r in S.query(df).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_long_texts(spark):
    """Documents longer than a row of a group holds, among short ones, with passages in common at both ends and across them."""
    rng = random.Random(7)
    text = lambda k: "".join(rng.choices("abcdefghij ", k=k))
    common = [text(rng.randint(60, 300)) for _ in range(5)]
    long = text(S.PIECE_BYTES + 50_000)
    rows = [(9, common[0] + long), (3, text(S.PIECE_BYTES + 9) + common[0]), (70, long[1000:90_000] + "!" + long[90_000:150_000])]
    rows += [(100 + i, rng.choice(common)[rng.randint(0, 9) :] + text(rng.randint(0, 900)) + rng.choice(common)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in S.query(df).collect()) == sorted(brute(rows))


def test_turn_equals_comparing_windows():
    """Contexts that share an anchor: the least id of each window, with anchors at both ends and contexts that only differ far from it."""
    rng = random.Random(11)
    found = {}
    for _ in range(4):
        anchor = bytes(rng.choices(b"ab", k=S.GRAM))
        for _ in range(30):
            left, right = bytes(rng.choices(b"aab", k=S.WIDE - 1)), bytes(rng.choices(b"aab", k=S.WIDE - 1))
            a, b = rng.choice([(31, 0), (0, 31), (31, 31), (20, 25)])
            found[bytes((a,)) + left[len(left) - a :] + anchor + right[:b]] = rng.randint(-5, 99)
    # a window is known by its bytes and its anchor's place, as equal windows have equal anchors at equal places
    least = {}
    for c, i in found.items():
        for k in range(len(c) - S.LENGTH):
            w = (c[0] - k, c[1 + k : 1 + k + S.LENGTH])
            least[w] = min(i, least.get(w, S.LAST))
    got = S.first_documents(found)
    assert got.keys() == found.keys()
    for c in found:
        want = [least[c[0] - k, c[1 + k : 1 + k + S.LENGTH]] for k in range(len(c) - S.LENGTH)]
        assert want == ([got[c]] * len(want) if isinstance(got[c], int) else got[c].tolist())


def test_kept_bytes_and_empty(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in S.spans(df, with_kept=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
        assert sum(e - s for s, e in zip(r.starts, r.ends)) == r.n_removed and len(r.starts) == r.n_spans
    assert S.query(df.filter("false")).count() == 0


def test_an_anchor_of_all_is_sent_once_a_batch(spark):
    """A passage of all documents, ids that repeat among them: by batches of one document, of few, and of all."""
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefghijkl ", k=90))
    rows = [(i // 2, "".join(rng.choices("abcdefghij ", k=rng.randint(0, 40))) + passage) for i in range(80)] + [(900, passage * 2 + "end"), (None, passage)]
    want = sorted(brute(rows), key=str)
    for parts in (82, 5, 1):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((tuple(r) for r in S.query(df).collect()), key=str) == want
    same = [(7, passage), (7, "x" + passage), (7, passage)]
    assert all(r.n_removed == 0 for r in S.query(spark.createDataFrame(same, "doc_id long, text string")).collect())
