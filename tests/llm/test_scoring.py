"""Toxicity, language model, quality, mixing, search and licenses against brute force or held-out rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import licenses, lm, mixing, pairing, quality, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, label int, rate int, stratum string, `row` int"


def documents(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "s", 9, 9, "z", 9) for i, t in texts], SCHEMA)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


# --- toxicity ---------------------------------------------------------------------------

def labelled_texts(n=400, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, rng.randrange(5, 80)), i % 4 == 0
        if toxic:
            text += " " + rng.choice(["nastyword", "Foulness,", "vileness."]) + " " + prose(rng, 5)
        texts.append((i, text))
        labels.append((i, int(rng.random() < 0.9), int(toxic)))
    return texts, labels


def test_toxicity_finds_held_out_rows(spark):
    texts, labels = labelled_texts()
    texts += [(1000, None), (1001, ""), (1002, "nastyword " + "é" * 30_000), (None, "vileness here")]
    docs = documents(spark, texts)
    marks = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(marks))
    scored = docs.select("doc_id", toxicity.score_column(model).alias("score")).collect()
    score = {r.doc_id: r.score for r in scored}
    assert all(0 <= s <= 1 for s in score.values()) and len(scored) == len(texts)
    held = [i for i, _ in texts if i is not None and i < 400 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((score[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert score[1000] == score[1001] < 0.3 and score[1002] >= 0.3 and score[None] >= 0.3
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s < 0.3}


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    for rows in ([], [(1, 1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        scores = {r[0] for r in docs.select(toxicity.score_column(model)).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 0.5


def test_grams_of_characters():
    found, counts = toxicity.word_features([b"abc", "é".encode(), b""])
    assert counts.tolist() == [3 + 2 + 1, 1, 0]
    assert len(set(found[:6])) == 6


# --- language model ---------------------------------------------------------------------

def test_model_scores(spark):
    rng = random.Random(3)
    texts = []
    for i in range(300):
        kind = ["the cat sat on a mat", "le chien dort dans la rue"][i % 2].split()
        texts.append((i, " ".join(rng.choice(kind) for _ in range(40))))
    texts += [(500, None), (501, ""), (502, "Unseen THE words"), (None, "the cat"), (7, texts[7][1])]
    rows = lm.score_texts(documents(spark, texts), lm.in_training()).collect()
    assert len(rows) == len(texts)
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in texts]
    cut = [[*(t or "").lower().split(), None] for _, t in texts]
    counts = Counter(w for ws, use in zip(cut, learn, strict=True) if use for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (i, _), ws, use in zip(texts, cut, learn, strict=True):
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[i, use, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in rows) == want
    assert all(r.score < 0 for r in rows)
    held = [r for r in rows if not r.train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_classes_share_out_all_probability():
    rng = np.random.default_rng(1)
    model = lm.Softmax(rng.normal(size=(lm.FEATURES, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32))
    logs = model.logs(rng.integers(0, lm.FEATURES, (50, 4)))
    assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-5)


def test_rows_are_summed_by_group():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 5))
    keys = np.sort(rng.choice([0, 1, 2, 3, 4], 900, p=[0.9, 0.06, 0.02, 0.015, 0.005]))
    keys = np.concatenate([keys, [7, 8, 8]])  # groups of one, two and very many
    members = rng.integers(0, 300, len(keys))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    by, total = lm._sum_groups(rows, members, first)
    for place, found in zip(by, total, strict=True):
        assert np.allclose(found, rows[members[keys == keys[first[place]]]].sum(axis=0))
    assert sorted(by) == list(range(len(first)))


def test_log_of_one_class_and_words_with_a_class_of_their_own():
    rng = np.random.default_rng(3)
    model = lm.Softmax(rng.normal(size=(lm.FEATURES, lm.CLASSES)).astype(np.float32), np.zeros(lm.CLASSES, np.float32))
    features, classes = rng.integers(0, lm.FEATURES, (50, 4)), rng.integers(0, lm.CLASSES, 50)
    every = model.logs(features)
    assert np.allclose(model.logs(features, classes), every[np.arange(50), classes], atol=1e-5)
    assert np.allclose(np.log(model.odds(features)), every, atol=1e-4)
    groups = bytes(map(lm.word_group, [b"a", b"bb", b"the"]))
    found = lm.Positions(bytes(12), groups, [3, 0, 1]).classes
    assert found.tolist() == [lm.END, 0, 3, groups[1], 1]


def test_model_without_rows(spark):
    assert lm.score_texts(documents(spark, []), lm.in_training()).collect() == []
    rows = lm.score_texts(documents(spark, [(1, "a b")]), F.lit(False)).collect()
    assert rows[0].n_known == 0 and rows[0].train_tokens == 0 and np.isfinite(rows[0].score)


# --- quality ----------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    w = text.encode().split()
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    hit = {j for i, x in enumerate(windows) if many[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit))


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [(i, prose(rng, rng.randrange(0, 90))) for i in range(30)]
    texts += [(40, None), (41, ""), (42, "a b c a b c"), (43, "a a a a a"), (44, "x\ny\nx\n \n \nx"), (45, "é#ü <a|b>"),
              (46, "one"), (47, " \x0b lead  trail \r\n"), (48, "w " * 20_000), (None, "a b"), (42, "a b c a b c")]
    marks = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.judge(documents(spark, texts), marks).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == Counter((i, *plain_counts(t)) for i, t in texts)
    for r in rows:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert (r.base_failed, r.kept) == (failed, not failed)


def test_exact_tail(spark):
    cases = [(10, 0), (10, 1), (100, 0), (100, 3), (1000, 5), (1000, 20), (5000, 30), (0, 0), (100, 90)]
    df = spark.createDataFrame(cases, "n long, k long")
    for n, k, tail in df.select("n", "k", quality.lower_tail(F.col("n"), F.col("k"), 0.01)).collect():
        want = sum(comb(n, i) * 0.01**i * 0.99**(n - i) for i in range(k + 1)) if k < n * 0.01 else 1
        assert tail == pytest.approx(want, rel=1e-9)


def test_cutoffs_reject_bad_documents_and_spare_good_ones(spark):
    rng = random.Random(6)
    texts, marks, langs = [], [], {}
    for i in range(4000):
        good = i % 4 != 0
        words = [f"w{rng.randrange(9999)}" for _ in range(60)]
        if not good:
            words = [w + "###" for w in words]
        elif rng.random() < 0.05:
            words[0] = "#1"
        texts.append((i, " ".join(words)))
        marks.append((i, int(good)))
        langs[i] = "de" if i % 100 == 1 else None if i == 2 else "en"
    docs = documents(spark, texts, langs)
    rows = quality.judge(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    by = {r.doc_id: r.kept for r in rows}
    good = [by[i] for i in range(4000) if i % 4]
    bad = [by[i] for i in range(4000) if i % 4 == 0 and langs[i] == "en"]
    assert np.mean(good) > 0.96 and not any(bad)
    assert all(by[i] for i in range(4000) if langs[i] == "de")  # too few to certify anything


# --- mixing -----------------------------------------------------------------------------

def test_mix_meets_targets(spark):
    rng = random.Random(8)
    texts, known = [], []
    for i in range(600):
        kind = "poor" if i % 3 == 0 else "en"
        body = "of the cat and the dog " if kind == "en" else "x### y*** | "
        texts.append((i, " " + body * rng.randrange(5, 30)))
        if i % 2:
            known.append((i, kind))
    texts += [(900, None), (901, ""), (None, " of the "), (1, texts[1][1])]
    labelled = spark.createDataFrame(known, "doc_id long, domain string")
    mix = mixing.soft_mix(documents(spark, texts), labelled, {"en": 0.8, "poor": 0.2}).collect()
    assert len(mix) == len(texts)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in mix)
    assert all(sum(r.posteriors) == pytest.approx(1) for r in mix)
    assert Counter(r.tokens for r in mix) == Counter(len((t or "").split()) for _, t in texts)
    total = sum(r.tokens for r in mix)
    for k, share in enumerate((0.8, 0.2)):
        assert sum(r.tokens * r.rate * r.posteriors[k] for r in mix) / total == pytest.approx(share, abs=0.03)


def test_mix_meets_targets_of_small_domains(spark):
    rng = random.Random(18)
    bodies = {"en": " of the cat and the dog", "de": " der hund und die katze", "fr": " le chat et les chiens",
              "es": " el gato que un perro", "poor": " x### y*** a&&& b### c*** d&&&"}
    kinds = ["en"] * 900 + ["de", "fr", "es"] * 30 + ["poor"] * 10
    texts = [(i, bodies[k] * rng.randrange(20, 24)) for i, k in enumerate(kinds)]
    labelled = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 2], "doc_id long, domain string")
    mix = mixing.soft_mix(documents(spark, texts), labelled, mixing.TARGETS)
    for share, target in mixing.reached_shares(mix, mixing.TARGETS).values():
        assert share == pytest.approx(target, abs=1e-4)
    assert all(0 <= r.rate <= 8 for r in mix.collect())


@pytest.mark.parametrize("seed", range(6))
def test_solved_mix_is_the_least_squares_optimum(seed):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.1, 0.02, 0.02, 0.01], 500)
    t = rng.integers(1, 90, 500) / 1e4
    t /= t.sum()
    low, high = np.where(rng.random(500) < 0.2 * seed, 1.0, 0.0), 1.0 if seed % 2 else 4.0
    goal = rng.dirichlet([1, 1, 1, 1])
    rate = previous = np.clip(np.ones(500), low, high)

    def step(pull, momentum):
        nonlocal rate, previous
        y, slope = rate + momentum * (rate - previous), p @ pull
        previous, rate = rate, np.clip(y - slope, low, high)
        return (t * rate) @ p, float((t * slope * (np.where(slope > 0, low, high) - y)).sum())

    share = t @ p
    over, left = mixing.solve(step, share, (t * rate) @ p, goal, 5000, 1e-9, 1e-7)
    assert np.abs(over).max() <= 1e-9 or left <= 1e-7
    assert over == pytest.approx((t * rate) @ p - goal)
    assert (rate >= low).all() and (rate <= high).all()
    # Not worse than many plain steps.
    value = lambda r: ((((t * r) @ p - goal) ** 2) / share).sum() / 2
    plain = np.clip(np.ones(500), low, high)
    for _ in range(20000):
        plain = np.clip(plain - p @ (((t * plain) @ p - goal) / share), low, high)
    assert value(rate) <= value(plain) + 1e-7


def test_mix_beyond_the_written_steps_and_out_of_reach(spark):
    rng = random.Random(28)
    texts = [(i, (" the cat of a dog" if i % 4 else " the a### b&&& of | ") * rng.randrange(3, 9)) for i in range(300)]
    labelled = spark.createDataFrame([(i, "en" if i % 4 else "poor") for i in range(150)], "doc_id long, domain string")
    mix = mixing.soft_mix(documents(spark, texts), labelled, {"en": 0.1, "poor": 0.9}, low=0.5, high=1.5, rounds=40,
                          tolerance=0.0, gap=0.0).collect()
    p, t = np.array([r.posteriors for r in mix]), np.array([r.tokens for r in mix], float) / sum(r.tokens for r in mix)
    plain = np.ones(len(mix))
    for _ in range(5000):
        plain = np.clip(plain - p @ (((t * plain) @ p - [0.1, 0.9]) / (t @ p)), 0.5, 1.5)
    rates = np.array([r.rate for r in mix])
    assert (t * rates) @ p == pytest.approx((t * plain) @ p, abs=1e-4)


def test_trimming_keeps_good_documents(spark):
    rng = random.Random(9)
    texts = [(i, (" the cat of a dog and " if i % 2 else " a### b&&& c$$$ | ") * rng.randrange(5, 20)) for i in range(200)]
    docs = documents(spark, texts)
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    left = mixing.trim_to_mix(docs, marks)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert {i for i, _ in texts if i % 2} <= ids and len(ids) < 130


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.soft_mix(documents(spark, []), none, {"a": 1.0}).collect() == []
    rows = mixing.soft_mix(documents(spark, [(1, "a b"), (2, "c")]), none, {"a": 1.0, "b": 1.0}).collect()
    assert [r.posteriors for r in rows] == [[0.5, 0.5]] * 2


# --- search -----------------------------------------------------------------------------

def brute_force(rows, k):
    valid = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            valid.setdefault(key, []).append(np.floor(64 * np.array(v, float)))
    out = set()
    for q in valid:
        if q % 20 == 0:
            scored = sorted((-int(valid[q][0] @ v), c) for c in valid for v in valid[c]
                            if c != q and len(v) == len(valid[q][0]))[:k]
            out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)}
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK_ROWS", 7)
    monkeypatch.setattr(pairing, "SHARD_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=40).round(2).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 440)]  # ties
    rows += [(460, None), (480, [None] * 40), (500, [float("nan")] * 40), (None, rows[1][1]), (520, [1.0, 2.0]),
             (521, [0.5, -1.0]), (540, [float("inf")] * 40), (-20, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, key int, v int")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert {tuple(r) for r in found} == brute_force(rows, 20) and len(found) == len({tuple(r) for r in found})


def test_repeated_own_rows_take_no_places():
    best = topk.Best(np.array([50]), np.array([[1.0]]), 3)
    best.add(np.array([1, 2, 3, 4, 50, 50, 50]), np.array([[5.0, 4.0, 3.0, 2.0, 9.0, 9.0, 9.0]]))
    scores, keys = best.found[0]
    assert (keys.tolist(), scores.tolist()) == ([1, 2, 3], [5.0, 4.0, 3.0])


def test_pruning_changes_nothing(monkeypatch):
    monkeypatch.setattr(topk, "DENSE", 1.01)
    rng = np.random.default_rng(5)
    data = np.floor(rng.normal(size=(64, 3000)) * np.linspace(40, 1, 64)[:, None])
    best = topk.Best(np.arange(30) + 10_000, data[:, :30].copy(), 10)
    for at in range(0, 3000, 500):
        best.add(np.arange(at, at + 500), data[:, at:at + 500])
    scores = data[:, :30].T @ data
    for q in range(30):
        order = np.lexsort((np.arange(3000), -scores[q]))[:10]
        assert best.found[q][1].tolist() == order.tolist()


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 20 == 0).collect() == []


# --- licenses ---------------------------------------------------------------------------

def by_hand(text):
    import re

    text = text or ""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s)
    w = cut(low)
    places, base, more, share = set(), set(), set(), 0.0
    for label, phrase in licenses.PHRASES.items():
        for i in range(len(w)):
            if w[i:i + len(phrase)] == phrase:
                places.add(i)
                base.add(label)
    for template in licenses.TEMPLATES:
        n, t = len(template.notice.split()), set(template.notice.split())
        for i in range(len(w)):
            have = set(w[i:i + n])
            if (w[i] in t and len(t & have) >= 0.8 * len(t) - 1e-9 and set(template.telling.split()) <= have
                    and not set(template.foreign.split()) & have):
                more.add(template.label)
                share = max(share, len(t & have) / len(t))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), 1.0 if places else share)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in (t.notice + " sa nd").split()}) + ["zebra", "Ünit", "x1"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    for _, t, *_ in licenses.TEMPLATES:
        w = t.split()
        texts += ["\n".join(w), "zebra " * rng.randrange(480, 540) + t + " zebra" * 600, t.replace(" license", " sa license")]
        texts += [t.upper() + ".", " ".join(w[:-1]), " ".join(rng.sample(w, len(w) - len(w) // 4)), t + "\n" + t]
    texts += [None, "", "MIT License mit-license, MIT\nLicense", "apache_license2 Apache (License)", "mit licenſe",
              "mıt license", "mit Kicense", "general public license " * 3000, " --- "]
    rows = licenses.scan(documents(spark, [*enumerate(texts), (None, "mit license"), (1, texts[1])])).collect()
    want = Counter((i, *by_hand(t)) for i, t in [*enumerate(texts), (None, "mit license"), (1, texts[1])])
    assert Counter(tuple(r) for r in rows) == want


def test_licenses_are_told_apart(spark):
    cases = {
        "released under the bsd license": "bsd",
        "released under the apache license": "apache",
        "licensed under the gnu general public license version 3": "gpl",
        "licensed under the gnu lesser general public license version 3": "gpl,lgpl",  # gpl by its phrase
        "licensed under the apache license, version 2.0": "apache",
        "licensed under cc by nc 4.0": "cc-by-nc",
        "licensed under CC BY 4.0": "cc-by",
        "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\n"
        "associated documentation files": "mit",
    }
    rows = licenses.scan(documents(spark, [*enumerate(cases)])).collect()
    assert [r.labels for r in sorted(rows)] == list(cases.values())


def test_licenses_of_nothing(spark):
    assert licenses.scan(documents(spark, [])).collect() == []
    assert licenses.scan(documents(spark, [(1, "mit license")]), templates=[]).collect()[0].labels == "mit"
