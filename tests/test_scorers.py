"""Overlap scores: clipped matches against plain counts, and how much work they take."""

from collections import Counter

from runlens.operators import scorers as SC

from .test_plans import _plan

ROWS = [
    (1, "a b a b a c", "a b a b"),
    (2, "x y z", "a b c"),
    (3, "The cat, the CAT; the mat", "the cat sat on the mat"),
    (4, "a " * 3000 + "b", "a a a b"),
    (5, None, "a b"),
    (6, "a b", None),
    (7, "", "a b"),
    (8, "a b", "--"),
    (9, "a", "a b c d e"),
]


def _rows(spark, max_n):
    pairs = spark.createDataFrame(ROWS, "id int, pred string, ref string")
    table = SC.gram_table(pairs.select("id", "ref"), ["id"], "ref", max_n)
    return pairs.select("id", SC.tokens("pred").alias("toks"), SC.tokens("ref").alias("ref_toks")).join(table, "id")


def _plain(text, ref, n):
    grams = [Counter(zip(*(t[k:] for k in range(n)))) for t in (text or [], ref or [])]
    return sum((grams[0] & grams[1]).values())


def test_clipped_matches_against_plain_counts(spark):
    got = SC.clipped_matches(_rows(spark, 4), "toks", 4).collect()
    assert sorted(r.id for r in got) == [r[0] for r in ROWS]
    for r in got:
        assert [r.m1, r.m2, r.m3, r.m4] == [_plain(r.toks, r.ref_toks, n) for n in (1, 2, 3, 4)], r.id


def test_scores_without_a_text_or_reference_are_zero(spark):
    bleu = {r.id: r.bleu for r in SC.bleu_rows(_rows(spark, 4)).collect()}
    assert {i for i, v in bleu.items() if v == 0} == {2, 5, 6, 7, 8} and None not in bleu.values()
    rouge = {r.id: r.rouge1 for r in SC.rouge1_rows(_rows(spark, 1)).collect()}
    assert {i for i, v in rouge.items() if v == 0} == {2, 5, 6, 7, 8} and None not in rouge.values()


def test_no_pass_over_the_text_per_gram(spark):
    rows = spark.createDataFrame([], "toks array<string>, " + ", ".join(f"g{n} array<string>, c{n} array<int>" for n in range(1, 5)))
    plan = _plan(SC.clipped_matches(rows, "toks", 4))
    assert "lambdafunction" not in plan and plan.count("ArrowEvalPython") == 1
    # the reference's side builds grams with lambdas, but looks for none of them by a pass each
    assert "filter(" not in _plan(SC.gram_table(spark.createDataFrame([], "id int, ref string"), ["id"], "ref", 4))


def test_gram_table_counts_each_reference(spark):
    long = [f"w{i % 300}" for i in range(3000)]
    refs = spark.createDataFrame([(1, "a b a b"), (2, None), (3, ""), (4, " ".join(long))], "id int, ref string")
    got = {r.id: r for r in SC.gram_table(refs, ["id"], "ref", 4).collect()}
    assert (dict(zip(got[1].g2, got[1].c2, strict=True)), got[1].r_len) == ({"a b": 2, "b a": 1}, 4)
    assert [got[2][f] for f in ("r_len", "g1", "c1", "c4")] == [None] * 4
    assert [got[3][f] for f in ("r_len", "g1", "c1", "c4")] == [0, [], [], []]
    for n in range(1, 5):
        want = Counter(" ".join(long[i : i + n]) for i in range(len(long) - n + 1))
        assert dict(zip(got[4][f"g{n}"], got[4][f"c{n}"], strict=True)) == want


class _Looked(dict):
    asked = 0

    def __contains__(self, key):
        self.asked += 1
        return super().__contains__(key)


def test_each_order_looks_only_where_the_shorter_gram_matched():
    words = ["a", "b", *["x"] * 1000, "a"]
    tables = [_Looked({"a": 1, "b": 1}), _Looked({"a b": 1}), _Looked(), _Looked()]
    assert SC._clipped(words, tables) == [2, 1, 0, 0]
    assert [t.asked for t in tables] == [1003, 2, 1, 0]
