"""Operators 1 to 10 against brute force, and on odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import (
    additive_quality,
    crf_language,
    license_join,
    merkle_manifest,
    overlap_resampling,
    perspective_chat,
    pruned_graph,
    robust_outliers,
    simhash_pigeonhole,
    style_tree,
    toxicity_rnn,
    viterbi_pieces,
    water_filling,
)
from tests.conftest import SF_CHECK

DOCS = "doc_id long, text string, lang string, source string, score string, size string"
ODD = [
    (None, "a b c", "en", "s1", "x", "y"),
    (1, None, "en", "s1", None, None),
    (2, "", None, None, None, None),
    (3, " \n\t ", "en", None, None, None),
    (4, "the same words here again", "en", "s1", "x", "y"),
    (4, "the same words here again", "en", "s1", "x", "y"),
    (5, "12 34 !?", "de", "s2", None, None),
    (6, "word " * 30_000, "en", "s2", None, None),
    (7, "İKx ünd 日本語 \u0000 ▁ 😀", "fr", "s3", None, None),
]


def docs(spark, rows=None, schema=DOCS):
    return spark.createDataFrame(ODD if rows is None else rows, schema)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ------------------------------------------------------------------ 1 chat


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")


def test_chat_views_and_spans(spark):
    rows = [(1, 0, "system", "Be kind.", None), (1, 1, "ann", "Hi", None), (1, 2, "bob", "<|end|>\n", None), (1, 3, "ann", None, None)]
    got = {r.perspective: r for r in perspective_chat.perspectives(chat(spark, rows)).collect()}
    assert set(got) == {"ann", "bob"}
    assert got["ann"].rendered == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi<|end|>\n<|user name=bob|>\n<|end|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert [got["ann"].rendered[a:b] for a, b in got["ann"].spans] == ["Hi<|end|>\n", "<|end|>\n"]
    assert [got["bob"].rendered[a:b] for a, b in got["bob"].spans] == ["<|end|>\n<|end|>\n"]


def test_chat_long_and_tied_turns_are_split_without_loss(spark):
    rows = [(1, t, "ab"[t % 2], f"t{t}", None) for t in range(200)] + [(2, 5, "a", f"x{i}", None) for i in range(300)] + [(None, None, None, "z", None)]
    got = perspective_chat.perspectives(chat(spark, rows)).collect()
    long = sorted((r.segment, r.rendered) for r in got if r.conv_id == 1 and r.perspective == "a")
    assert re.findall(r"\nt(\d+)<", "".join(t for _, t in long)) == [str(t) for t in range(200)]
    tied = sorted((r.segment, r.n_turns, r.rendered) for r in got if r.conv_id == 2)
    assert [(s, n) for s, n, _ in tied] == [(0, 64), (1, 64), (2, 64), (3, 64), (4, 44)]
    assert re.findall(r"\n(x\d+)<", "".join(t for *_, t in tied)) == sorted(f"x{i}" for i in range(300))
    assert [r.perspective for r in got if r.conv_id is None] == ["unknown"]


def test_chat_repeated_and_null_turns_are_kept(spark):
    rows = [(1, 4, "a", None, None)] * 70 + [(1, 4, "a", "", "x")] * 2 + [(1, None, "a", "end", None), (1, 4, "a", "z", None)]
    got = sorted((r.segment, r.n_turns, r.rendered) for r in perspective_chat.perspectives(chat(spark, rows)).collect())
    assert [n for _, n, _ in got] == [64, 10]
    assert got[1][2].endswith("z<|end|>\n<|assistant|>\nend<|end|>\n") and "".join(t for *_, t in got).count("<|end|>") == 74


def test_ids_beside_nulls_stay_exact(spark):
    """Ids over 2**53 next to a null id, through every operator that runs in Python workers."""
    big = 2**60
    ids = [big + 1, None, big + 3]
    rows = [(i, 1, "ab"[k % 2], f"t{k}", None) for k, i in enumerate(ids)]
    assert {r.conv_id for r in perspective_chat.perspectives(chat(spark, rows)).collect()} == set(ids)
    d = docs(spark, [(i, f"some words {k}", "en", "s", None, None) for k, i in enumerate(ids)])
    labels = spark.createDataFrame([(big + 1, 1, 0), (big + 3, 0, 1)], "doc_id long, quality int, toxic int")
    results = [viterbi_pieces.encoded(d), simhash_pigeonhole.simhash_groups(d), crf_language.identify(d), toxicity_rnn.toxicity(d, labels), water_filling.mixture(d)]
    results += [additive_quality.quality(d, labels), merkle_manifest.manifest(d.withColumn("n_chars", F.lit(1))), overlap_resampling.resample(d, d)]
    for got in results:
        assert sorted(map(str, {r.doc_id for r in got.collect()})) == sorted(map(str, ids))
    pages = spark.createDataFrame([(i, "http://h/", f"<p>{k}</p>") for k, i in enumerate(ids)], "page_id long, url string, html string")
    assert {r.page_id for r in style_tree.extracted(pages).collect()} == set(ids)


def test_chat_empty_and_context_only(spark):
    assert perspective_chat.views(chat(spark, [])).count() == 0
    assert perspective_chat.views(chat(spark, [(1, 0, "system", "x", None)])).count() == 0


# ------------------------------------------------------------------ 2 toxicity


def toxic_rows(n=240):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    out = []
    for i in range(n):
        text = [rng.choice(vocab) for _ in range(rng.randint(10, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                text[rng.randrange(len(text))] = rng.choice(["scumbag", "moron"])
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxicity_learns_and_scores_every_window(spark):
    rows = toxic_rows()
    d = docs(spark, [(i, t, None, None, "x", "y") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y, 0.5) for i, _, y in rows], "doc_id long, toxic int, score double")
    got = {r.doc_id: r for r in toxicity_rnn.toxicity(d, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) / len(held) >= 0.9
    assert sum(p for p, y in held if y) / sum(y for _, y in held) >= 0.7
    model = toxicity_rnn.fit(d.select("doc_id", "text"), labels, F.lit(True))
    long = " ".join(rows[1][1].split() * 300)
    s = model.score([long, long + " moron", None, "", "1 2"])
    assert s[1] > 0.7 > s[0] and list(s[2:]) == [0, 0, 0]


def test_toxicity_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_rnn.toxicity(docs(spark), none).collect()
    assert len(got) == len(ODD) and all(r.score == 0 and r.predicted == 0 for r in got)
    assert toxicity_rnn.toxicity(docs(spark, []), none).count() == 0


def test_toxicity_windows_cover_every_word():
    for n in (0, 1, 24, 25, 40, 41, 1000):
        doc, lo, size = toxicity_rnn.windows(np.array([n]))
        assert set().union(*(range(a, a + s) for a, s in zip(lo, size, strict=True))) == set(range(n)) and (size <= 24).all()


def test_toxicity_score_is_the_largest_of_all_windows():
    """Every window scored on its own, word by word in plain loops."""
    rng = random.Random(6)
    m = toxicity_rnn.GRU.fresh(2)
    m.p["word"] = np.random.default_rng(2).normal(size=m.p["word"].shape).astype(np.float32)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def window(words):
        c = toxicity_rnn.Corpus([" ".join(words)])
        x = m.word_inputs(c.word, c.gram, c.first, c.size)[c.token].astype(float)
        states, h = [], toxicity_rnn.HIDDEN
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            cur, got = np.zeros(h), [None] * len(x)
            for t in order:
                g, u = x[t] @ m.p[f"W{side}"] + m.p[f"c{side}"], cur @ m.p[f"U{side}"]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                new = np.tanh(g[2 * h :] + r * u[2 * h :])
                cur = (1 - z) * new + z * cur
                got[t] = cur
            states.append(got)
        hs = np.array([np.concatenate(p) for p in zip(*states, strict=True)])
        weight = np.exp(np.tanh(hs @ m.p["A"]) @ m.p["a"])
        return sig((weight / weight.sum()) @ hs @ m.p["v"] + m.p["o"][0])

    for n in (1, 5, 24, 25, 27, 40, 70):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(n)]
        starts = range(0, max(n - toxicity_rnn.WINDOW, 0) + toxicity_rnn.STEP, toxicity_rnn.STEP)
        want = max(window(words[a : a + toxicity_rnn.WINDOW]) for a in starts if a == 0 or a - toxicity_rnn.STEP + toxicity_rnn.WINDOW < n)
        assert m.score([" ".join(words)])[0] == pytest.approx(want, abs=1e-5)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    m = toxicity_rnn.GRU.fresh(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    args = (rng.integers(0, 50, (3, 5)), (rng.integers(0, 40, 30), np.repeat(np.arange(15), 2), np.full(15, 2.0)), np.array([5, 3, 4]), np.array([1.0, 0, 1]))
    _, g = m.loss_grads(*args)
    for k in ("Wf", "Ub", "A", "v", "gram"):
        full = np.zeros_like(m.p[k])
        np.add.at(full, *g[k]) if isinstance(g[k], tuple) else np.add(full, g[k], out=full)
        at = np.unravel_index(np.abs(full).argmax(), full.shape)
        old, losses = m.p[k][at], []
        for step in (1e-3, -1e-3):
            m.p[k][at] = old + step
            losses.append(m.loss_grads(*args)[0])
        m.p[k][at] = old
        assert full[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=1e-3)


# ------------------------------------------------------------------ 3 quality


def base(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_odd_inputs(spark):
    rng = random.Random(1)
    rows = list(ODD) + [(100 + i, " ".join(rng.choice("ab|\n") for _ in range(60)), "en", "s", None, None) for i in range(20)]
    got = robust_outliers.quality(docs(spark, rows)).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert robust_outliers.quality(docs(spark, [])).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 300))), "en", "s", None, None) for i in range(400)]
    junk = [(1000 + i, " ".join(rng.choice(vocab) + "###" for _ in range(100)), "en", "s", None, None) for i in range(60)]
    got = {r.doc_id: r.kept for r in robust_outliers.quality(docs(spark, rows + junk)).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(60))


# ------------------------------------------------------------------ 4 neighbours


def test_neighbours_recall_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16)).astype("float32")
    v[::3] = v[0]  # a third of all rows are one vector
    rows = [(i, v[i].tolist(), 0) for i in range(1500)]
    odd = [(3000, None, 0), (3050, [], 0), (3100, [0.0] * 16, 0), (3150, [float("nan")] * 16, 0), (3200, [None] * 16, 0), (3250, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + rows[:2] + odd, "vec_id long, embedding array<float>, rank int")
    got = pruned_graph.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    x = v.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(s, 9)))[:5]
        g = g.sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
        np.testing.assert_allclose(g.score, s[g.vec_id], atol=1e-9)
        hits, total = hits + len(set(g.vec_id) & set(best)), total + 5
    assert total == 150 and hits / total >= 0.9
    assert pruned_graph.nearest(df.limit(0), F.lit(True)).count() == 0


# ------------------------------------------------------------------ 5 language


def lang_rows(n=160):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "tion", "sh", "ou"], "de": ["sch", "ung", "keit", "ü", "ich"], "es": ["ción", "ado", "que", "ñ", "los"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40))
    return [(i, make(lang), lang) for i in range(n) for lang in [sorted(parts)[i % 3]]]


def test_language_held_out_and_code_switching(spark):
    rows = lang_rows()
    got = {r.doc_id: r for r in crf_language.identify(docs(spark, [(i, t, x, None, "a", "b") for i, t, x in rows] + [(900, None, "en", None, None, None), (901, "1 !", "en", None, None, None)])).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows if got[i].held_out)
    assert {(got[i].lang_pred, got[i].score) for i in (900, 901)} == {("und", 0.0)}
    model = crf_language.train([t for _, t, _ in rows], [x for _, _, x in rows])
    w, p = model.label_words([rows[0][1] + " " + rows[1][1]])
    found = [model.langs[k] for k in p.argmax(1)]
    assert found[:35] == [rows[0][2]] * 35 and found[-35:] == [rows[1][2]] * 35


def test_language_marginals_equal_the_uncut_chain():
    rng = np.random.default_rng(0)
    em, doc = rng.normal(size=(150, 3)), np.repeat([0, 1, 3], [70, 33, 47])
    trans, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    p = crf_language.marginals(em, doc, 4, trans, start)
    for d in (0, 1, 3):
        want, _ = crf_language._posteriors(em[doc == d][None], trans, start)
        np.testing.assert_allclose(p[doc == d], want[0], atol=1e-12)


def test_language_sample_is_the_smallest_hashes_of_each_language(spark):
    rows = [(i, "a word", "en" if i % 40 else "de") for i in range(4000)] + [(9000, "a word", "es")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = {(r.lang, r.h, r.doc_id) for r in df.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()}
    want = {x[2] for lang in ("en", "de", "es") for x in sorted(x for x in hashed if x[0] == lang)[:20]}
    got = {r.doc_id for r in crf_language.training_rows(df, F.lit(True), rows_per_lang=20).collect()}
    assert got == want and len(got) == 41


def test_language_odd_inputs(spark):
    got = crf_language.identify(docs(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert crf_language.identify(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ 6 licenses


def test_license_places_labels_and_windows(spark):
    filler = "lorem ipsum dolor " * 40
    long = filler + "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files " + filler
    rows = [
        (11, "MIT License, mit-license and Apache (License)\nGNU General Public License", "", "", "", ""),
        (12, long, "", "", "", ""),
        (13, "permission is granted to any person", "", "", "", ""),
        (14, "the smit license", "", "", "", ""),
    ]
    got = {r.doc_id: r for r in license_join.scan(docs(spark, rows)).collect()}
    assert (got[11].n_base, got[11].first_word, got[11].last_word, got[11].base_labels) == (4, 0, 7, "apache,gpl,mit")
    assert (got[12].n_base, got[12].first_word, got[12].base_labels, got[12].labels) == (0, None, "", "mit") and got[12].score == 1.0
    assert (got[13].labels, got[13].score) == ("", 0.0) and got[14].n_base == 0
    assert license_join.scan(docs(spark)).count() == len(ODD) and license_join.scan(docs(spark, [])).count() == 0


def test_license_notice_wrapped_over_lines(spark):
    notice = "Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this\n#\n# software and associated documentation files (the"
    filler = "lorem ipsum dolor\n" * 40
    rows = [(1, notice, "", "", "", ""), (2, filler + notice + "\n" + filler, "", "", "", ""), (3, filler, "", "", "", "")]
    got = {r.doc_id: (r.labels, r.score) for r in license_join.scan(docs(spark, rows)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}


def test_license_scan_equals_its_oracle_on_wrapped_notices(spark):
    import duckdb
    import pyarrow as pa

    rng, rows = random.Random(8), []
    vocab = ["lorem", "the", "of", "and", "license", "software", "permission", "to", "12"]
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        for _ in range(i % 3):
            notice = rng.choice(license_join.TEMPLATES)[1].split()
            if rng.random() < 0.5:
                notice.pop(rng.randrange(len(notice)))
            at = rng.randint(0, len(words))
            words[at:at] = notice
        gaps = [rng.choice([" ", " ", "\n", "\n\n# ", ", "]) for _ in words]
        rows.append((i, "".join(w + g for w, g in zip(words, gaps, strict=True))))
    rows += [(200, None), (201, ""), (201, ""), (202, "\n \n")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())}))
    want = con.sql(license_join.oracle())
    got = license_join.scan(spark.createDataFrame(rows, "doc_id long, text string")).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_license_windows_hold_the_longest_template(spark):
    copy = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(80))
    rows = [(at, "x " * at + copy + " x" * 300, "", "", "", "") for at in (0, 16, 31, 79, 200)]
    assert {r.labels for r in license_join.scan(docs(spark, rows), [("long", copy)], 1.0).collect()} == {"long"}
    assert license_join.window_words() == license_join.BLOCK and license_join.window_words([("long", copy)]) == 160
    with pytest.raises(ValueError):
        license_join.matches(docs(spark, rows), [("long", copy)], 1.0, 64)


def test_license_join_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = sorted({w for _, _, ws in license_join.template_words() for w in ws}) + ["foo", "bar"]
    rows = [(i, " ".join(rng.sample(vocab, 60)), "", "", "", "") for i in range(60)]
    templates = [(f"t{k}", " ".join(rng.sample(vocab, rng.randint(1, 12)))) for k in range(40)]
    want = {(i, x) for i, t, *_ in rows for _, x, ws in license_join.template_words(templates) if len(set(ws) & set(t.split())) >= license_join.need(len(ws), 0.7)}
    found = license_join.scan(docs(spark, rows), templates, 0.7).collect()
    base_labels = {"gpl", "apache", "cc-by", "mit"}
    assert {(r.doc_id, x) for r in found for x in r.labels.split(",") if x and x not in base_labels} == want and want


# ------------------------------------------------------------------ 7 pieces


def test_pieces_equal_full_viterbi_and_restore():
    p = viterbi_pieces.Pieces.load()

    def brute(t):
        s = [viterbi_pieces.MARK if c == " " else None if c == viterbi_pieces.MARK else c for c in " " + t]
        best, back = [0.0] + [float("-inf")] * len(s), [None] * (len(s) + 1)
        for i in range(1, len(s) + 1):
            for n in range(min(p.longest, i), 0, -1):
                seg = s[i - n : i]
                got = None if None in seg else p.pieces.get("".join(seg))
                if got and best[i - n] + got[1] > best[i]:
                    best[i], back[i] = best[i - n] + got[1], (i - n, [got[0]])
            if best[i - 1] + p.unknown > best[i]:
                raw = viterbi_pieces.MARK if s[i - 1] is None else s[i - 1]
                best[i], back[i] = best[i - 1] + p.unknown, (i - 1, [p.byte_ids[b] for b in raw.encode()])
        out, i = [], len(s)
        while i:
            out, i = back[i][1] + out, back[i][0]
        return out

    rng = random.Random(1)
    texts = [" ", "  a", "a  b\n\n c\t", "▁x ▁", "日本語 😀 \u0000", "a" * 100, "the" * 200, "    \n  "]
    texts += ["".join(rng.choice("abe t \n▁é1.") for _ in range(150)) for _ in range(40)]
    for t in texts:
        ids = p.encode(t)
        assert ids == brute(t) and p.decode(ids) == t
        assert list(p.stream(viterbi_pieces.MARK if c == " " else None if c == viterbi_pieces.MARK else c for c in " " + t)) == ids
    assert p.encode("") == p.encode(None) == []


def test_pieces_stream_commits_early():
    p = viterbi_pieces.Pieces.load()
    read = 0

    def source():
        nonlocal read
        for c in "▁the▁house" * 2000:
            read += 1
            yield c

    next(p.stream(source()))
    assert read < 200  # the first ids are out long before the end of the text


def test_pieces_odd_inputs(spark):
    got = viterbi_pieces.encoded(docs(spark)).collect()
    assert len(got) == len(ODD) and all(r.restored and r.n_ids == len(r.ids) for r in got)
    back = viterbi_pieces.encoded(docs(spark)).select("doc_id", viterbi_pieces.decoder(viterbi_pieces.Pieces.load())("ids").alias("t"))
    assert sorted((str(r.doc_id), r.t) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in ODD)
    assert viterbi_pieces.encoded(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ 8 mixing


def test_mixing_targets_and_sums(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), None, s, None, None) for s, n in (("a", 30), ("b", 300), ("c", 100), (None, 50)) for i in range(n)]
    got = water_filling.mixture(docs(spark, rows)).toPandas()
    text_source = Counter()
    size = Counter()
    for _, t, _, s, *_ in rows:
        size[s] += len(words(t))
    left, budget, target = dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True)), 1.5 * sum(size.values()), {}
    while left:
        share = {s: budget * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] >= 2 * size[s]]
        for s in over or list(left):
            target[s] = min(share[s], 2 * size[s])
            budget -= target[s] if over else 0
            del left[s]
    by_size = {size[s]: s for s in size}
    for n, g in got.groupby("source_size"):
        assert g.target.iloc[0] == pytest.approx(target[by_size[n]]) and abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert (got.taken <= 2 * got["size"]).all() and not text_source
    again = water_filling.mixture(docs(spark, rows).repartition(7)).toPandas()
    assert sorted(map(tuple, got.values)) == sorted(map(tuple, again.values))


def test_mixing_odd_inputs(spark):
    got = water_filling.mixture(docs(spark)).collect()
    assert len(got) == len(ODD)
    assert water_filling.mixture(docs(spark, [])).count() == 0
    same = [(1, "a b c d", "en", "s", None, None)] * 50 + [(2, "x " * 100, "en", "t", None, None)]
    got = water_filling.mixture(docs(spark, same)).toPandas()
    assert got.taken.sum() == pytest.approx(got.drop_duplicates("source_size").target.sum(), abs=50)
    mixed = water_filling.mixed_documents(docs(spark))
    assert mixed.columns == docs(spark).columns


# ------------------------------------------------------------------ 9 pages


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav>m</nav><article><h1>A &amp;amp; B</h1><p><b>one<br>two<p>three\n  four</article><footer>f</footer>", "A &amp; B\none two\nthree four"),
        ("<div class='side-bar sidebar'>s</div><main><p>x<script>if (a<b) {}</script> y</p><form>f</form><ul><li>a<li>b</ul></main>", "x y\na\nb"),
        ("<header><h1>site</h1></header><div><p>body &#233;&nbsp;text</p></div><div id=comments><p>c</p></div>", "body é text"),
        ("<article><header><h1>T</h1></header><p>a<div class='ad'>buy</div>b<section class=comments><article>no</article></section></article>", "T\na\nb"),
        ("<p>broken <b>tags <p>next &lt;p&gt; <a href='>'>link", "broken tags\nnext <p> link"),
        ("plain & simple", "plain & simple"),
        ("<!-- x --><article></article>", ""),
        ("", ""),
    ],
)
def test_page_text(page, text):
    assert style_tree.main_text(page) == text


def test_style_tree_removes_what_all_pages_of_a_host_share(spark):
    page = "<body><div class=top><p>Welcome to our site</p></div><div class=text><p>{}</p><p>{}</p></div></body>"
    rows = [(i, "http://h/%d" % i, page.format(f"first {i}", f"second {i}"), 1) for i in range(20)]
    rows += [(100, "http://other/", page.format("a", "b"), 1), (101, None, None, 1), (102, "::bad[", "", 1)]
    rows += [(200 + i, "http://copies/%d" % i, "<body><article><p>same text</p></article></body>", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in style_tree.extracted(df).collect()}
    assert got[3].text == "first 3\nsecond 3" and got[3].n_chars == 16
    assert got[100].text == "Welcome to our site\na\nb"
    assert (got[101].text, got[102].text, got[205].text) == ("", "", "same text")
    assert style_tree.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><svg class='i'/><p>first para</p></article>", "T\nfirst para"),
        ("<article><h1>T</h1><svg class='i'><path d='x'/><p>first para</p></article>", "T\nfirst para"),
        ("<article><svg><title>icon</title><g><circle/></g><text>no</text></svg><p>a</p></article>", "a"),
        ("<article><h1>T</h1><iframe src='x'><p>first para</p></article>", "T\nfirst para"),
        ("<article><p>a</p><script src='x'/><p>b</p></article>", "a\nb"),
        ("<p>a</p><script>if (a<b) {", "a"),
        ("<body><div><p>" + "main text " * 20 + "</p></div><article><a>teaser card</a></article></body>", ("main text " * 20).strip()),
        ("<body><article><a>card 1</a></article><article><a>card 2</a></article></body>", "card 1\ncard 2"),
        ("<div class='login-guide'><p>a</p></div><div id='social-policy'><p>b</p></div><div class='menu'>c</div>", "a\nb"),
        ("<div class='reader-comments'>a</div><ol class='commentlist'><li>b</ol><div class='cookie-notice'>c</div><p>d</p>", "d"),
        ("<article><p>x</p><div class='reader-comments'>a</div><ol class='commentlist'><li>b</ol><i class='post-share-bar'>c</i><b id='cookie-notice'>d</b></article>", "x"),
    ],
)
def test_page_edges(page, text):
    assert style_tree.main_text(page) == text


def test_deep_branches_keep_their_own_paths():
    deep = "<div>" * 60 + "a<p>b</p><ul><li>c</li></ul>"
    assert len({b[0] for b in style_tree.blocks(deep)[0]}) == 3


@pytest.mark.parametrize("mark", ["article", "main"])
def test_article_sections_with_ambiguous_names_stay(mark):
    names = ["id='related-work'", "class='social-policy'", "id='search-methods'", "class='menu-item'", "class='skip-list'", "id='comment-on-results'", "class='notice'"]
    page = "".join(f"<section {n}><p>s{i}</p></section>" for i, n in enumerate(names))
    noise = ["class='ad'", "class='x share-buttons'", "id=comments", "class=related-posts", "role=navigation", "class='ad-slot'"]
    page += "".join(f"<div {n}><p>no</p></div>" for n in noise)
    assert style_tree.main_text(f"<{mark}>{page}</{mark}>") == "\n".join(f"s{i}" for i in range(len(names)))
    assert style_tree.main_text("<article class='related-work'><p>a</p></article>") == "a"


def removed_blocks(spark, pages):
    """Blocks that the style tree alone removes, over all pages."""
    df = pages.select(F.xxhash64("page_id", "url", "html").cast("string").alias("page"), "url", "html")
    low = style_tree.low_branches(style_tree.importance(style_tree.style_counts(df)))
    cut = {}
    for r in style_tree.open_paths(df).join(low, ["host", "path"]).collect():
        cut.setdefault(r.page, set()).add(r.path)
    return sum(len(style_tree.kept_blocks(r.html)) - len(style_tree.kept_blocks(r.html, cut.get(r.page, set()))) for r in df.collect())


def test_style_tree_acts_inside_marked_articles(spark):
    page = "<body><main><article><h1>T{0}</h1><p>one {0}</p><div class=x><p>Tell your friends</p></div><p>two {0}</p></article></main></body>"
    copy = "<body><article><h1>Same</h1><p>text</p><div class=x><p>more</p></div></article></body>"
    rows = [(i, "http://h/%d" % i, page.format(i)) for i in range(20)] + [(100 + i, "http://copies/%d" % i, copy) for i in range(20)]
    rows += [(200 + i, "http://few/%d" % i, page.format(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extracted(df).collect()}
    assert got[3] == "T3\none 3\ntwo 3"
    assert got[105] == "Same\ntext\nmore" and got[201] == "T1\none 1\nTell your friends\ntwo 1"
    assert removed_blocks(spark, df) == 20
    assert removed_blocks(spark, spark.read.parquet(f"{SF_CHECK}/pages.parquet")) == 0


# ------------------------------------------------------------------ 10 SimHash


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, fps, bits=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = x if low.get(r) is None else low[r] if x is None else min(low[r], x)
    return [low[find(i)] for i in range(len(fps))]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    rows = list(ODD)
    for k in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        for j in range(6):
            if j:
                w = list(w)
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + 10 * k + j, " ".join(w), None, None, None, None))
    got = simhash_pigeonhole.simhash_groups(docs(spark, rows)).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = Counter((r[0], f"{f:016x}", g) for r, f, g in zip(rows, fps, groups([r[0] for r in rows], fps), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash_pigeonhole.simhash_groups(docs(spark, [])).count() == 0


def test_simhash_links_in_dense_split_buckets(spark):
    rng = random.Random(9)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 400:
        x = rng.choice(sorted(fps))
        fps.add(x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 5))}))
    fps = sorted(fps)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    edges = simhash_pigeonhole.links(nodes, block=32)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    root = {r.node: r.root for r in simhash_pigeonhole.components(edges).collect()}
    got = [root.get(s, s) for s in signed]
    want = groups(signed, fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_thresholds_meet_the_pigeonhole_sum():
    cost = [[0, 5, 9, 20], [0, 1, 2, 30], [0, 7, 8, 9]]
    total, ts = simhash_pigeonhole.allocate(cost, 3 - 3 + 1)
    every = [(cost[0][a + 1] + cost[1][b + 1] + cost[2][c + 1]) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 1]
    assert sum(ts) == 1 and total == min(every)


def test_keep_one_leaves_one_whole_row_of_each_group(spark):
    got = simhash_pigeonhole.keep_one(docs(spark))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == docs(spark).columns
    assert sum(r[0] == 4 for r in rows) == 1 and sum(not words(r[1]) for r in rows) == 1
    assert all(r in ODD for r in rows)


def test_keep_one_does_not_depend_on_partitions(spark):
    """Of rows alike in id and text the same one stays, whatever the partitions; rows that
    differ in any column are told apart, and a table's own columns keep their names."""
    rows = [(1, "a b c d", s, i) for i, s in enumerate(["s1", "s2", "s3", "s1"])] + [(1, "a b c d", "s1", 0), (None, "x y z w", "q", 1), (3, "x y z w", "q", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __h1 int")
    got = simhash_pigeonhole.keep_one(df)
    first = sorted(map(str, got.collect()))
    assert got.columns == df.columns and [r.split(",")[0] for r in first] == ["Row(doc_id=1", "Row(doc_id=3"]
    for parts in (1, 4):
        assert sorted(map(str, simhash_pigeonhole.keep_one(df.orderBy(F.rand(parts)).repartition(parts)).collect())) == first


def test_mixing_rows_without_ids_are_spread(spark):
    rows = [(None, f"text number {i} of some words", "s") for i in range(200)] + [(7, f"other {i}", "t") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = df.select(water_filling._place(1, "doc_id").alias("p")).select(F.substring("p.key", 1, water_filling.BUCKET_DIGITS)).distinct().count()
    assert places > 200
    got = water_filling.mixture(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in got)


def test_neighbours_with_extreme_components(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [0.0, 1e-200]), (3, [1.0, 1.0]), (50, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in pruned_graph.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    assert got[0, 1] == (1, pytest.approx(1.0)) and got[0, 2] == (50, pytest.approx(1.0))
    assert got[50, 1][1] == pytest.approx(1.0) and {got[50, 1][0], got[50, 2][0]} == {0, 1}
    assert all(abs(s) <= 1 + 1e-12 for _, s in got.values())


def test_sampled_texts_are_cut_where_they_lie(spark):
    from runlens.llm.common import SAMPLE_CHARS, bounded_rows, shortened, unused

    long = "x" * 5_000_000
    assert len(shortened(long)) <= SAMPLE_CHARS and shortened("short") == "short"
    d = spark.createDataFrame([(1, long), (2, "a b")], "doc_id long, text string")
    got = {r.doc_id: len(r.text) for r in bounded_rows(d.select("doc_id"), d, 10, ["doc_id", "text"], toxicity_rnn._spread_windows).collect()}
    assert got[1] <= SAMPLE_CHARS and got[2] == 3
    assert unused(d, "TEXT", "x", "x") == ["_TEXT", "x", "_x"]


def test_toxicity_with_one_label_only(spark):
    labels = spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity_rnn.toxicity(docs(spark), labels).collect()} == {0.0}
