"""Fill-in-the-middle, the prefix trie and rotated codes against brute force."""

from __future__ import annotations

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import fim, pairing, prefix_trie, rotated_codes

# --- fill in the middle -----------------------------------------------------------------


def texts_to_cut():
    rng = random.Random(8)
    made = ["".join(rng.choice(["a", "é", "漢", "😀", "\n", " x", "\r", " "]) for _ in range(rng.randrange(1, 400)))
            for _ in range(120)]
    made += ["", None, "\n", "\n\n\n", "one line", "ends\n", "has <P> in it\nx", "a\n<S>", "<M>", "<P", "S>\n<M", "<\nP>",
             "line\n" * 5000, "é" * 20_000, "x" * 100_000 + "\n" + "ä\n" * 70_000]
    return [*enumerate(made), (None, "a\nb\nc"), (3, "another\ntext\nof the id 3"), (-4, "below\nzero\n")]


def cut_by_hand(key, text, rate=100, spm_rate=50):
    text = text or ""
    digest = sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if h[3] % 100 < spm_rate:
        return key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (60, 100)])
def test_fill_in_middle_equals_brute_force(spark, monkeypatch, rate, spm_rate):
    monkeypatch.setattr(fim, "BATCH_BYTES", 50_000)
    rows = texts_to_cut()
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows],
                                 "doc_id long, text string, form string, output string, n int").repartition(3)
    made = fim.fill_in_middle(docs, rate=rate, spm_rate=spm_rate)
    back = fim.restored(F.col("output"), F.col("form")).alias("back")
    found = made.select("*", back).collect()
    wanted = [cut_by_hand(*r, rate=rate, spm_rate=spm_rate) for r in rows]
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[:6]) for r in found), key=order) == sorted(wanted, key=order)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == ({"plain", "spm", "psm"} if rate == 100 else {"plain", "spm"})


def test_skip_list_reaches_every_rank():
    text = "".join("é" * (i % 7) + "\n" * (i % 3 > 0) + "z" for i in range(3000)).encode()
    widths = fim.line_widths(text)
    lanes = fim.SkipList(widths)
    assert len(lanes.lanes) > 2 and len(lanes.lanes[-1]) <= fim.FAN
    sums = np.vstack([np.zeros(3, np.int64), widths.cumsum(axis=0)])
    assert [lanes.before(r) for r in range(len(widths) + 1)] == [tuple(s) for s in sums[:, 1:].tolist()]
    assert sums[-1, 1] == len(text.decode()) and sums[-1, 2] == len(text)


def test_nothing_to_cut(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, n int")
    assert fim.fill_in_middle(docs).collect() == []


# --- prefix trie ------------------------------------------------------------------------


def talks():
    """Repeated, nested, long, turnless, tied and incomplete conversations; one opening is in most of them."""
    rng = random.Random(4)
    rows = []

    def add(conv_id, turns):
        rows.extend((conv_id, i, role, text) for i, (role, text) in enumerate(turns))

    opening = [("system", "be kind")]
    base = opening + [("user" if i % 2 else "assistant", f"turn {i} é") for i in range(30)]
    for c in range(200):
        if c % 3 == 0:
            add(c, opening + [(rng.choice("ua"), rng.choice(["x", "yy", ""])) for _ in range(rng.randrange(0, 7))])
        elif c % 7 == 0:
            add(c, base[:rng.randrange(1, 31)])
        elif c % 11 == 0:
            add(c, base[:20] + [("user", f"own {c}")] * rng.randrange(1, 60))
        elif c % 5:  # some heads of groups are absent
            add(c, [("user", str(c % 4))] * rng.randrange(1, 3))
    add(1000, [("user", f"long {i}") for i in range(300)])
    add(1001, [("user", f"long {i}") for i in range(300)])
    add(-7, [("user", "0")])
    rows += [(1002, None, None, "no number"), (1002, 5, "user", None), (1002, 5, "user", "same number"),
             (None, 0, "user", "of no conversation"), (1003, 0, None, None)]
    rng.shuffle(rows)
    return rows


def digest_of(role, text):
    from hashlib import md5

    return md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def own_turns(rows):
    grouped = {}
    for c, turn, role, text in rows:
        if c is not None:
            grouped.setdefault(c, []).append((-1 if turn is None else turn, digest_of(role, text), role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in grouped.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h, head = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(head, [])[:h] + turns[h:]
    return out


def trie_by_hand(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves[path] or 1
        if path:
            saved[path] += (len(members[path]) - 1) * len(path[-1][1].encode())
            children[path[:-1]] += 1
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    rows = []
    for path, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in found if len(paths[c]) == len(path)))
        rows.append((min(found), len(path), min(members[path[:-1]]) if path else None, len(found), children[path],
                     leaves[path], saved[path], sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


@pytest.mark.parametrize("built", [False, True])
def test_prefix_trie_equals_brute_force(spark, monkeypatch, built):
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = talks()
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows],
                                  "conv_id long, turn long, role string, text string, depth int, key string")
    lists, own = prefix_trie.turn_lists(turns.repartition(5)), own_turns(rows)
    if built:
        lists, own = prefix_trie.with_shared_openings(lists), rebuilt(own)
    found = prefix_trie.prefix_trie(lists)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                             "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == trie_by_hand(own)


def test_trie_of_nothing_and_of_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = prefix_trie.turn_lists(spark.createDataFrame([(None, 1, "a", "b")], schema))
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_openings(none)).collect() == []
    lists = prefix_trie.turn_lists(spark.createDataFrame([(2, 0, "a", "b"), (1, 0, "a", "b")], schema))
    bare = lists.withColumn("turns", F.slice("turns", 1, 0))
    root = (1, 0, None, 2, 0, 1, 0, sha256(b"1,2").hexdigest())
    assert [tuple(r) for r in prefix_trie.prefix_trie(bare).collect()] == [root]


# --- rotated codes ----------------------------------------------------------------------


def vectors(n=1500, length=48, seed=6):
    rng = np.random.default_rng(seed)
    groups = rng.normal(size=(12, length))
    found = groups[rng.integers(0, 12, n)] * rng.uniform(0.2, 2, n)[:, None] + rng.normal(size=(n, length))
    return [(i, v.tolist()) for i, v in enumerate(found)]


def best_by_hand(rows, k):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v
            and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q in {i for i, _ in good if i % 20 == 0}:
        own = min((list(v) for i, v in good if i == q))
        scored = sorted((-float(np.dot(own, v)), i) for i, v in good if i != q and len(v) == len(own))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_codes_find_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(pairing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(pairing, "SHARD_ROWS", 200)
    rows = vectors()
    rows += [(2000 + i, rows[40][1]) for i in range(30)]  # ties, among them queries
    rows += [(3000, None), (3020, [None] * 48), (3040, [float("nan")] * 48), (3060, [0.0] * 48), (3080, []),
             (3100, [1.0, 2.0]), (3101, [0.5, -1.0]), (3120, [float("inf")] * 48), (None, rows[1][1]),
             (-20, rows[3][1]), (60, rows[5][1]), (7, rows[8][1])]
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows],
                               "vec_id long, embedding array<double>, key int, code string, error double")
    found = rotated_codes.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()
    wanted = best_by_hand(rows, 10)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == {q for q, best in wanted.items() if best}
    assert all([r.rank for r in found if r.query_id == q] and len(got[q]) == min(10, len(wanted[q])) for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in got)
    assert hits >= 0.95 * sum(map(len, wanted.values()))
    by_id = {}
    for i, v in rows:
        by_id.setdefault(i, []).append(v)
    for q, best in got.items():
        assert best == sorted(best, key=lambda b: (-b[1], b[0])) and q not in {i for i, _ in best}
        for i, score in best:
            assert any(abs(np.dot(min(by_id[q]), v) - score) < 1e-9 for v in by_id[i])


def test_codes_spare_most_candidates_and_bounds_hold():
    rows = vectors(6000)
    data = np.array([v for _, v in rows])
    keys, centre = np.arange(len(data)), data[:500].mean(axis=0)
    codes, factor, error = rotated_codes.encode(data, centre, 8)
    state = rotated_codes.Reranked(keys[::20], data[::20], centre, 8, 10)
    for at in range(0, len(data), 500):
        part = slice(at, at + 500)
        state.add(keys[part], data[part], codes[part], factor[part], error[part])
    assert state.reranked < 0.2 * len(data) * len(data[::20])
    signs = np.unpackbits(codes, axis=1).astype(float) * 2 - 1
    guess = (state.turned @ signs.T) * factor + state.base[:, None]
    off = np.abs(guess - data[::20] @ data.T) <= state.length[:, None] * error
    assert off.mean() > 0.9


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert rotated_codes.nearest(df, F.col("vec_id") % 20 == 0).collect() == []
