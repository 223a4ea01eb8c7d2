import random

from quarry.llm import toxicity as T
from quarry.llm.common import is_held_out

WORDS = [a + b for a in ("mon", "tar", "bel", "kun", "vor") for b in ("a", "eth", "ilo", "ust", "ing")]


def tables(spark, n=1500):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        y = i % 10 == 0
        if y:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(["Idiot", "1d1ot", "іdiоt", "scum,", "ídiot!"]))
        elif i % 7 == 0:
            words[2:2] = ["scum", "pond"]
        rows.append((i, " ".join(words), "en", 0.1))
        if i % 2 == 0 or y:
            labels.append((i, 1, int(y)))
    rows += [(9000, None, "en", 0.1), (9001, "", "en", 0.1), (9002, "idiot", None, 0.1), (None, "you idiot", None, 0.1), (9003, "mona " * 100000 + "idiot " * 20000, None, 0.1)]
    labels += [(9000, 0, 0), (9000, 0, None), (None, 0, 1), (77777, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folding():
    assert T.fold("Ünïcödé 1d10T x") == " unicode idiot x "
    assert T.fold("іdіоt") == " idiot " and T.fold("íd​iot") == " idiot " and T.fold("𝐢𝐝𝐢𝐨𝐭!") == " idiot "
    assert T.fold(None) == T.fold("") == T.fold("... !?") == " "


def test_a_word_folds_alone():
    """What a word folds to doesn't depend on the rest of the text."""
    words = ["id\u00adiot", "i\u200bdiot", "\u0456diot", "1d10t", "i\u0308diot", "\U0001d422diot", "plain", "\u03a9", "\ufeffidiot", "\xe4b"]
    for a in words:
        for b in words:
            assert T.fold(f"{a} {b}").split() == T.fold(a).split() + T.fold(b).split()
    assert T.fold("id\u00adiot") == " idiot "


def naive(lex, text):
    """Sum of weights by looking at every word by itself: its longest entry, unless a neighbour makes it an exception."""
    words = T.fold(text).split()
    total = 0.0
    for k, w in enumerate(words):
        fits = [e for e in lex.entries if (e == f" {w} " if e.endswith(" ") else w.startswith(e[1:]))]
        around = {" ".join([words[k - 1] if k else "", w]), " ".join([w, words[k + 1] if k + 1 < len(words) else ""])}
        if fits and not around & lex.exceptions:
            total += lex.entries[max(fits, key=len)]
    return round(total, 9), len(words)


def test_matching_against_single_words():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abi") for _ in range(rng.randint(1, 6)))
    for _ in range(300):
        lex = T.Lexicon({rng.choice([f" {word()} ", f" {word()}"]): float(rng.randint(1, 9)) for _ in range(rng.randint(0, 8))}, {f"{word()} {word()}" for _ in range(30)})
        text = rng.choice(["", " ", "! "]).join(["", *(word() + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randint(0, 30)))])
        total, n = lex.measure(text)
        assert (round(total, 9), n) == naive(lex, text)


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"you idiot {i}") for i in range(3000)] + [(2, "same text")] * 3000, "doc_id long, text string")
    from quarry.llm.common import Scratch

    rows, n = T.sample(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, y int"), 50, 80, Scratch(spark, "test"))
    assert n == {0: 1, 1: 1} and rows.filter("y = 1").count() == 50 and rows.filter("y = 0").count() == 1


def test_exception_phrases_and_longest_entry():
    lex = T.Lexicon({" scum ": 2.0, " idio": 3.0, " idiot ": 5.0}, {"scum pond"}, (-1.0, 1.0, 1.0))
    assert lex.measure("Scum pond, scum!") == (2.0, 3)
    assert lex.measure("idiot idiotic") == (8.0, 2)
    assert lex.measure(None) == (0.0, 0)
    assert lex.score(5.0, 10) > lex.score(5.0, 1000) > lex.score(0.0, 10)


def test_held_out_quality(spark):
    docs, labels = tables(spark)
    got = T.query(docs, labels).collect()
    assert len(got) == docs.count() and all(r.held_out == is_held_out(r.doc_id) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    wrong = [r for r in test if r.predicted != (r.doc_id % 10 == 0)]
    assert len(wrong) <= 0.01 * len(test)
    by = {r.doc_id: r for r in got}
    assert by[9002].predicted == by[9003].predicted == by[None].predicted == 1 and by[9000].predicted == by[9001].predicted == 0
    lex = T.train(docs, labels, entries_most=None)  # without its bound, which these data don't reach
    kept = T.filtered(docs, lex)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_without_labels(spark):
    docs, labels = tables(spark, 50)
    assert {r.predicted for r in T.query(docs, labels.filter("false")).collect()} == {0}
    assert {r.predicted for r in T.query(docs, labels.filter("toxic = 1")).collect()} == {1}
    assert T.query(docs.filter("false"), labels).count() == 0
