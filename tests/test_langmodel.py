"""Modified Kneser-Ney models and decoding with them against plain versions."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalis.operators import langmodel as L
from vocalis.operators.decoding import arpa_lines


def plain_model(sentences, order, limits):
    """Probabilities by recursion, from dictionaries."""
    raw = [collections.Counter() for _ in range(order + 1)]
    for s in sentences:
        t = ["<s>", *s, "</s>"]
        for n in range(1, order + 1):
            raw[n].update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    del raw[1]["<s>",]
    adjusted = [None] * (order + 1)
    for n in range(1, order + 1):
        if n == order:
            adjusted[n] = dict(raw[n])
        else:
            kinds = collections.Counter(g[1:] for g in raw[n + 1])
            adjusted[n] = {g: c if g[0] == "<s>" else kinds[g] for g, c in raw[n].items()}
    cuts = [None, *(L.discounts([sum(a == k for a in adjusted[n].values()) for k in range(1, 5)]) for n in range(1, order + 1))]
    words = [g[0] for g in raw[1]]
    kept = [None, *({g for g in raw[n] if raw[n][g] > limits[n - 1]} for n in range(1, order + 1))]

    def gamma(n, context):
        some = {g: a for g, a in adjusted[n].items() if g[:-1] == context}
        total = sum(some.values())
        return sum((cuts[n][min(a, 3) - 1] if a else 0) if g in kept[n] else a for g, a in some.items()) / total if total else 1.0

    def p(n, gram):
        if n == 0:
            return 1 / (len(words) + 1)
        context = gram[:-1]
        total = sum(a for g, a in adjusted[n].items() if g[:-1] == context)
        a = adjusted[n].get(gram, 0) if gram in kept[n] else 0
        own = (a - cuts[n][min(a, 3) - 1]) / total if a else 0.0
        return own + gamma(n, context) * p(n - 1, gram[1:])

    out = {("<s>",): 1.0, ("<unk>",): gamma(1, ()) / (len(words) + 1)}
    for n in range(1, order + 1):
        out |= {g: p(n, g) for g in kept[n]}
    return out, gamma, [*words, "<unk>"]


def sentences_of(seed, n=60):
    rng = random.Random(seed)
    words = "a b c d e f g".split()
    return [[rng.choices(words, [9, 6, 4, 3, 2, 1, 1])[0] for _ in range(rng.randrange(7))] for _ in range(n)]


@pytest.mark.parametrize(("order", "prune"), [(1, "0"), (2, "0|1"), (3, "0|1|2"), (5, "0|0|1")])
def test_model_equals_plain_version(spark, order, prune):
    sentences = sentences_of(order)
    df = spark.createDataFrame([(s,) for s in sentences], "t array<string>")
    rows = L.modified_kneser_ney(L.sentence_grams(df, F.col("t"), order), order, prune).collect()
    limits = [int(x) for x in prune.split("|")]
    limits += limits[-1:] * (order - len(limits))
    want, gamma, words = plain_model(sentences, order, limits)
    got = {tuple(r.gram.split(" ")): r for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys()
    for g, p in want.items():
        assert math.isclose(10 ** got[g].log10p, p, rel_tol=1e-9)
        if len(g) == order:
            assert got[g].backoff is None
        else:
            assert math.isclose(10 ** got[g].backoff, gamma(len(g) + 1, g), rel_tol=1e-9)
    # probabilities of all words sum to one after any history
    model = L.hashed_model(spark.createDataFrame(rows, "ngram_order int, gram string, log10p double, backoff double"))
    for history in [("<s>",), (), ("a",), ("a", "b"), ("g", "g", "a"), ("<s>", "a", "b", "c"), ("zzz",)]:
        assert math.isclose(sum(10 ** model.score(history, w) for w in words), 1.0, rel_tol=1e-9)
    assert {L.gram_hash(r.gram) for r in rows} == set(model.keys.tolist())


def test_section_sizes_words_and_limits(spark):
    df = spark.createDataFrame([("a b a b a b a b a b c d",)] * 9 + [("x y",)], "text string")
    model = L.modified_kneser_ney(L.sentence_grams(df, F.split("text", " "), 5), 5, "0|8|16").cache()
    sizes = {r.ngram_order: r["count"] for r in model.groupBy("ngram_order").count().collect()}
    assert sizes[1] == 6 + 3 and sizes[2] == 6 and sizes[5] == 2  # ababa and babab, three times in each sentence
    lines = {r.line for r in arpa_lines(model).collect()}
    assert {"\\data\\", "\\end\\", "ngram 1=9", "ngram 2=6", "\\5-grams:"} <= lines
    few = L.only_words(model, spark.createDataFrame([("a",), ("b",)], "word string"))
    assert {r.gram for r in few.filter("ngram_order = 1").collect()} == {"a", "b", "<s>", "</s>", "<unk>"}
    assert not [r for r in few.collect() if "c" in r.gram.split(" ")]
    with pytest.raises(ValueError, match="n-grams"):
        L.hashed_model(model, 5)
    with pytest.raises(ValueError, match="thresholds"):
        L.modified_kneser_ney(L.sentence_grams(df, F.split("text", " "), 2), 2, "1|0")
    empty = L.modified_kneser_ney(L.sentence_grams(df.limit(0), F.split("text", " "), 3), 3)
    assert {r.gram for r in empty.collect()} == {"<s>", "<unk>"}


def full_search(logp, letters, blank, model, how):
    """Every path through the frames, summed by text."""
    total = collections.defaultdict(lambda: -math.inf)
    for path in itertools.product(range(len(letters)), repeat=len(logp)):
        text = "".join(letters[c] for i, c in enumerate(path) if c != blank and (i == 0 or path[i - 1] != c))
        total[text] = np.logaddexp(total[text], sum(logp[i][c] for i, c in enumerate(path)))
    out = {}
    for text, p in total.items():
        score, history = p, ("<s>",)
        if model:
            for w in text.split():
                score += how.alpha * math.log(10) * model.score(history, w) + how.beta + (0 if w in model.words else how.unknown)
                history = (*history, w)
            score += how.alpha * math.log(10) * model.score(history, "</s>") if how.boundary else 0
        out[text] = score, p
    return out


@pytest.mark.parametrize("order", [1, 3])
def test_beams_equal_full_search(spark, order):
    df = spark.createDataFrame([("ab a b ab",), ("a ab",), ("ab ab a",)], "text string")
    model = L.hashed_model(L.modified_kneser_ney(L.sentence_grams(df, F.split("text", " "), order), order))
    letters, rng = ["", " ", "a", "b"], np.random.default_rng(order)
    for _ in range(3):
        logp = np.log(rng.dirichlet(np.ones(4), 6))
        for lm, how in ((None, L.Scoring()), (model, L.Scoring()), (model, L.Scoring(0.7, 1.5, -3.0, False))):
            want = full_search(logp, letters, 0, lm, how)
            got = L.beam_search(logp, letters, 0, 10_000, lm, L.Lexicon(lm.words, letters) if lm else None, how)
            assert {t: (round(s, 9), round(a, 9)) for t, s, a in got} == {t: (round(s, 9), round(a, 9)) for t, (s, a) in want.items()}
            assert got[0][0] == max(want, key=lambda t: want[t][0])
            few = L.beam_search(logp, letters, 0, 20, lm, L.Lexicon(lm.words, letters) if lm else None, how)
            assert few[0][1] <= got[0][1] + 1e-9 and few[0][0] in want


def test_model_decides_between_alike_sounds(spark):
    vocab = ["<pad>", "|", "a", "b", "c"]
    # the second letter of the second word is as likely b as c
    said = "ab|ab"
    rows = []
    for i, c in enumerate("_".join(said)):
        x = [0.0] * 5
        x[0 if c == "_" else vocab.index(c)] = 9.0
        if i == len("_".join(said)) - 1:
            x[vocab.index("c")] = 9.1
        rows.append(("m", i, x))
    frames = spark.createDataFrame([*rows, *(("n", i, x) for _, i, x in rows[:3]), (None, 0, [9.0, 0.0, 0.0, 0.0, 0.0])], "msg string, frame int, x array<double>")
    corpus = spark.createDataFrame([("ab ab",)] * 3 + [("ab",), ("ac",)], "text string")
    model = L.hashed_model(L.modified_kneser_ney(L.sentence_grams(corpus, F.split("text", " "), 2), 2))
    heard = {r.msg: r.text for r in L.decode_beams(frames, ["msg"], "frame", "x", vocab).collect()}
    known = {r.msg: r.text for r in L.decode_beams(frames, ["msg"], "frame", "x", vocab, model).collect()}
    assert heard == {"m": "ab ac", "n": "ab", None: ""} and known == {"m": "ab ab", "n": "ab", None: ""}
    ranked = L.decode_beams(frames, ["msg"], "frame", "x", vocab, model, n_best=3).filter("msg = 'm'").orderBy("rank").collect()
    assert [r.rank for r in ranked] == [0, 1, 2] and ranked[0].score > ranked[1].score
    with pytest.raises(ValueError, match="single"):
        L.decode_beams(frames, ["msg"], "frame", "x", ["<pad>", "ab"])


def test_runs_of_words_are_counted_as_by_hand(spark):
    from vocalis.operators.corpus import ngram_counts

    texts = ["a b a b", "", "a", None, " a  b", "a b"] + [f"w{i % 7} x y" for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for orders in ((1, 2, 3), (2,), (3, 1)):
        want = collections.Counter((n, " ".join(w[i : i + n])) for t in texts if t is not None for w in [t.split(" ")] for n in orders for i in range(len(w) - n + 1))
        assert {(r.ngram_order, r.gram): r.n for r in ngram_counts(df, F.col("t"), orders).collect()} == want


def test_kneser_ney_counts_its_texts_once(spark, tmp_path):
    from vocalis.operators.corpus import ngram_counts
    from vocalis.operators.decoding import kneser_ney

    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcde", k=9)) for _ in range(200)]
    spark.createDataFrame([(t,) for t in texts], "t string").write.parquet(str(tmp_path / "t"))
    model = kneser_ney(ngram_counts(spark.read.parquet(str(tmp_path / "t")), F.col("t"), (1, 2)))
    two = collections.Counter(g for t in texts for w in [t.split()] for g in zip(w, w[1:], strict=False))
    kinds = {w: sum(b == w for _, b in two) / len(two) for w in "abcde"}
    for r in model.collect():
        words = tuple(r.gram.split())
        total, right = (sum(f(n) for (a, _), n in two.items() if a == words[0]) for f in (lambda n: n, lambda n: 1))
        p = kinds[words[0]] if len(words) == 1 else (two[words] - 0.75) / total + 0.75 * right / total * kinds[words[1]]
        assert math.isclose(r.log10p, math.log10(p)) and (len(words) == 2 or math.isclose(r.backoff, math.log10(0.75 * right / total)))
    lines = arpa_lines(model)
    assert {"\\data\\", "\\end\\", "ngram 1=5", f"ngram 2={len(two)}", "\\1-grams:", "\\2-grams:"} <= {r.line for r in lines.collect()}
    # nothing that is left to do reads the texts
    assert "parquet" not in lines._jdf.queryExecution().executedPlan().toString()


def test_modified_kneser_ney_counts_its_texts_once_and_null_texts_as_empty(spark, tmp_path):
    import duckdb

    from vocalis.plans import registry

    rng = random.Random(6)
    texts = [" ".join(rng.choices("abcdefg", [9, 6, 4, 3, 2, 1, 1], k=rng.randrange(8))) for _ in range(90)] + [None, "", None, " a  b "]
    spark.createDataFrame(list(enumerate(texts)), "conv_id long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    model = registry.queries()["modified_kneser_ney"](spark, str(tmp_path))
    got = {r.gram: (r.ngram_order, r.log10p, r.backoff) for r in model.collect()}
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = {gram: (order, p, backoff) for order, gram, p, backoff in con.execute(registry.oracle_sql()["modified_kneser_ney"]).fetchall()}
    assert got.keys() == want.keys()
    for gram, (order, p, backoff) in want.items():
        assert got[gram][0] == order and math.isclose(got[gram][1], p, abs_tol=1.1e-5)
        assert (got[gram][2] is None) == (backoff is None) and (backoff is None or math.isclose(got[gram][2], backoff, abs_tol=1.1e-5))
    assert "parquet" not in model._jdf.queryExecution().executedPlan().toString()
