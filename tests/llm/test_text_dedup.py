"""Near-duplicates, repeated passages and components against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from timeloom.llm import near_dup, repeats
from timeloom.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, n int"


def documents(spark, texts, first=0):
    rows = [(i + first if i is not None else None, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(seed=3):
    """Copies, near copies, shared passages, short, empty, missing, very long and periodic texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    texts, base = [], words(rng, 150)
    for i in range(40):  # near copies of one text, by one to three words
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(150)] = "changed%d" % i
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, rng.randrange(20, 200))) for _ in range(40)]
    texts += [" ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 20)) for _ in range(25)]
    texts += [texts[50]] * 6 + ["", None, "  \n\t", "one two", "One  TWO", "one two three four", "a" * 700, "ab" * 400,
                                " ".join(words(rng, 20_000)), "é" * 350, passage, passage.upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts, percent):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, percent):
    texts = corpus()
    found = near_dup.near_duplicates(documents(spark, texts), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(texts, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_a_chain_and_a_star(spark):
    """Members that are not alike themselves are linked over others, also when no one is like all."""
    rng = random.Random(5)
    now = words(rng, 120)
    texts = []
    for i in range(30):
        now = [*now[2:], *words(rng, 2)]
        texts.append((i, " ".join(now)))
    found = near_dup.near_duplicates(documents(spark, texts), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(texts, 85)


def test_near_duplicate_rows_without_id_and_repeated(spark):
    text = "a b c d e f g h i j"
    docs = documents(spark, [(None, text), (4, text), (4, text), (9, text), (None, None), (2, "")])
    rows = sorted(near_dup.near_duplicates(docs).collect(), key=str)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter({
        (None, None, True): 2, (4, 4, True): 2, (9, 4, False): 1, (2, 2, True): 1})
    left = near_dup.keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({None: 2, 4: 1, 2: 1})


@pytest.mark.parametrize(("percent", "shared", "others"), [(85, 300, 12), (80, 290, 22)])
def test_missing_probability_of_banding(percent, shared, others):
    """The share of table collisions follows the similarity."""
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(200):
        x = rng.integers(0, 2**63, 340, dtype=np.uint64)
        y = np.concatenate([x[:shared], rng.integers(0, 2**63, others, dtype=np.uint64)])  # 0.852, 0.801
        keys = [near_dup.table_keys(np.sort(v), *near_dup.shape(percent)) for v in (x, y)]
        hits += bool((keys[0] == keys[1]).any())
    assert hits >= 198


def test_banding_follows_the_threshold():
    assert near_dup.shape(85) == near_dup.shape(90) == near_dup.shape(100) == (3, 10)
    assert near_dup.shape(80) == (2, 10)
    for percent in (30, 50, 70, 80, 85, 95):
        t, size = near_dup.shape(percent)
        assert 2 * (1 - (percent / 100) ** t) ** size <= near_dup.MISS
    x = np.arange(1, 200, dtype=np.uint64)
    assert len(set(near_dup.table_keys(x, *near_dup.shape(80)).tolist())) == 10 ** 2


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, b) for b in range(101, 140)] + [
        (rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent}


def jobs_of(spark, group, run):
    """What ``run`` returns, and how many jobs it takes."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_near_duplicates_find_components_once(spark):
    # The driver holds the plans, stages and tasks of all rounds; 194 jobs when the last components were found again.
    docs = documents(spark, corpus())
    _, jobs = jobs_of(spark, "near_duplicates", lambda: near_dup.near_duplicates(docs, 85).collect())
    assert jobs <= 180


def covered(texts, window=repeats.WINDOW, keep_first=False):
    places = defaultdict(list)
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0])):
        raw = (t or "").encode()
        for p in range(len(raw) - window + 1):
            places[raw[p:p + window]].append((i, p))
    out = {i: np.zeros(len((t or "").encode()), bool) for i, t in texts}
    for where in places.values():
        for i, p in where[1:] if keep_first else where if len(where) > 1 else []:
            out[i][p:p + window] = True
    return out


def check_repeats(spark, texts):
    docs = documents(spark, texts)
    raw = {i: (t or "").encode() for i, t in texts}
    found = {r.doc_id: r for r in repeats.digest_without(docs, repeats.repeated_spans(docs)).collect()}
    assert len(found) == len(texts)
    for i, hit in covered(texts).items():
        row = found[i]
        kept = np.frombuffer(raw[i], np.uint8)[~hit].tobytes()
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (
            len(raw[i]), int(hit.sum()), runs, sha256(kept).hexdigest()), i
    later = {(r.doc_id): repeats.merge_spans([(s.start, s.end) for s in r.spans])
             for r in repeats.repeated_spans(docs, keep_first=True).collect()}
    for i, hit in covered(texts, keep_first=True).items():
        mask = np.zeros(len(raw[i]), bool)
        for start, end in later.get(i, ()):
            mask[start:end] = True
        assert (mask == hit).all(), i


def test_repeats_equal_brute_force(spark):
    check_repeats(spark, corpus(7))


def test_repeats_of_crowded_anchors(spark, monkeypatch):
    """Groups beyond the limit take the way that splits windows by offset."""
    monkeypatch.setattr(repeats, "GROUP", 5)
    check_repeats(spark, corpus(8))


def test_later_copies_are_cut_and_characters_stay_whole(spark):
    rng = random.Random(1)
    passage = " ".join(words(rng, 60))
    texts = [(1, "start " + passage + " end"), (2, "é" + passage + "è"), (None, passage), (5, None), (3, "x" * 10),
             (6, "ü" * 300), (7, "ü" * 300)]
    docs = documents(spark, texts)
    out = repeats.drop_later_copies(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    left = {r.doc_id: r for r in out.collect()}
    assert left[1].text == texts[0][1] and left[5].text is None and left[3].text == "x" * 10
    assert left[2].text == "éè" and left[2].n_chars == 2
    assert left[None].text == "" and left[7].text == ""
    assert set(left[6].text) <= {"ü"}


def test_repeated_rows_keep_what_they_share_with_others(spark):
    """Rows of one id (or none) and one text are one text: the first copy of a passage stays, once."""
    rng = random.Random(31)
    passage, own = " ".join(words(rng, 70)), [" ".join(words(rng, 60)) for _ in range(5)]
    first = own[0] + " " + passage + " " + own[1]
    missing = own[3] + " " + own[4] + " " + own[3]
    for texts in ([(1, first), (1, first), (2, own[2] + passage)], [(None, missing), (None, missing)]):
        docs = documents(spark, texts)
        once = dict(texts)
        left = Counter((r.doc_id, r.text) for r in repeats.drop_later_copies(docs).collect())
        want = {}
        for i, hit in covered(list(once.items()), keep_first=True).items():
            want[i] = np.frombuffer(once[i].encode(), np.uint8)[~hit].tobytes().decode()
        assert left == Counter((i, want[i]) for i, _ in texts)


def test_one_id_with_several_texts(spark):
    """Texts are told apart by text: an unlike one neither goes nor links with the other of its id."""
    rng = random.Random(32)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    texts = [(4, a), (4, b), (5, b + " more"), (9, a + " more"), (9, c), (9, c + " more"), (11, d), (12, d),
             (None, a), (None, a)]
    docs = documents(spark, texts)
    rows = near_dup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter({
        (4, 4, True): 2, (5, 4, False): 1, (9, 4, False): 1, (9, 9, True): 2, (11, 11, True): 1, (12, 11, False): 1,
        (None, None, True): 2})
    left = near_dup.keep_one_of_each(docs)
    assert left.columns == docs.columns
    found = Counter((r.doc_id, r.text.removesuffix(" more")) for r in left.collect())
    assert found == Counter({(4, a): 1, (4, b): 1, (9, c): 1, (11, d): 1, (None, a): 2})


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert near_dup.near_duplicates(docs).collect() == []
    assert repeats.digest_without(docs, repeats.repeated_spans(docs)).collect() == []
    assert repeats.drop_later_copies(docs).collect() == []
    assert near_dup.keep_one_of_each(docs).collect() == []


def test_near_duplicates_left_to_the_exact_join(spark, monkeypatch):
    """After one step over heads the other links come from the exact join."""
    monkeypatch.setattr(near_dup, "STAR_STEPS", 1)
    rng = random.Random(12)
    base = words(rng, 160)
    texts = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(160)] = f"edit{i}"
        texts.append((i, " ".join(copy)))
    for percent in (80, 90):
        found = near_dup.near_duplicates(documents(spark, texts), percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(texts, percent)


def test_batches_of_whole_texts_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, 1 << 26)
    near_dup.signatures(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 80)
    assert spark.conf.get(name).removesuffix("b") == str(1 << 22)
