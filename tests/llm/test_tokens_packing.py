"""Token ids, files and packing: exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from tokenizers import Tokenizer

from timeloom.llm import packing, pfor, token_files
from timeloom.llm.tokens import WordEncoder, default_vocabulary

TEXTS = ["", None, "The cat's 12 hats, don't!", "<|endoftext|> x<|startoftext|>y", "«Hé»… ½x", "İstanbul ΣΑΣ", "éa é",
         "a.b 12.5,3  x\ty z \x1cq", "!!!.. ?.,", "日本語 and ẞß ſ.K", "word " * 3000, "The the THE, the.",
         "The the THE, the.", "é́", "x" * 5000]


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def documents(spark, texts):
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, start int, part int")


def test_runs_give_the_ids_of_the_text(reference):
    encoder = WordEncoder(default_vocabulary(), most=3)
    for _ in range(2):
        found = encoder.encode_many([(t or "").encode() for t in TEXTS])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [reference(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_runs_of_any_text(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    found = WordEncoder.encode_many(_encoder(), [text.encode()])[0]
    assert np.frombuffer(found, "<u4").tolist() == reference(text)


_kept = []


def _encoder():
    if not _kept:
        _kept.append(WordEncoder(default_vocabulary()))
    return _kept[0]


@settings(max_examples=100, deadline=None)
@given(hnp.arrays(np.uint32, st.integers(0, 1200)), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, percentile):
    raw = pfor.encode(values, percentile)
    assert (pfor.decode(raw) == values).all()
    chunk = pfor.Chunk(raw)
    for i in range(-(-len(values) // pfor.BLOCK)):
        assert (chunk.block(i) == values[i * pfor.BLOCK:(i + 1) * pfor.BLOCK]).all()


def test_outliers_go_to_the_exception_list():
    values = np.arange(2560, dtype=np.uint32) % 16
    values[::100] = 2**32 - 1
    assert len(pfor.encode(values)) < 2560 * 2
    assert (pfor.decode(pfor.encode(values)) == values).all()


def test_token_files_round_trip(spark, reference):
    docs = documents(spark, TEXTS).union(documents(spark, ["a b"]).selectExpr(
        "cast(null as bigint)", "text", "ids", "start", "part"))
    rows = token_files.read_token_files(token_files.write_token_files(docs)).orderBy("start").collect()
    want = [(None, "a b"), *enumerate(TEXTS)]
    at = 0
    for row, (doc_id, text) in zip(rows, want, strict=True):
        ids = [*reference(text), 1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        at += len(ids)


def test_files_that_were_not_reported_are_not_read(spark, tmp_path):
    target = f"file://{tmp_path}/files"
    docs = documents(spark, ["a", "b"])
    first = token_files.write_token_files(docs, target)
    second = token_files.write_token_files(docs, target)
    assert token_files.read_token_files(first).count() == token_files.read_token_files(second).count() == 2


@pytest.mark.parametrize("length", [64, 100, 4096])
def test_every_id_is_in_one_piece(spark, reference, length):
    pieces = packing.pack(documents(spark, TEXTS), length=length).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in enumerate(TEXTS):
        found = sorted(by_doc[i], key=lambda p: p.start)
        ids = b"".join(p.ids for p in found)
        assert np.frombuffer(ids, "<u4").tolist() == [*reference(text), 2]
        assert [p.start for p in found] == np.cumsum([0, *(p.length for p in found)])[:-1].tolist()
        assert all(p.doc_tokens == len(ids) // 4 and zlib.crc32(p.ids) for p in found)
    for found in by_sequence.values():
        found.sort(key=lambda p: p.offset)
        ends = np.cumsum([0, *(p.length for p in found)])
        assert [p.offset for p in found] == ends[:-1].tolist()
        assert ends[-1] == length or (ends[-1] < length and ends[-1] & (ends[-1] - 1) == 0)


def test_the_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(1 << bits * dims))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_words(spark):
    texts = [("le chat de la maison et la rue " if i % 2 else "the dog of a house and one street ") * 5
             for i in range(40)]
    pieces = packing.pack(documents(spark, texts), length=10_000).orderBy("sequence_id", "offset").collect()
    kinds = [p.doc_id % 2 for p in pieces]
    assert sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) <= 14


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert packing.pack(docs).collect() == []
    assert token_files.read_token_files(token_files.write_token_files(docs)).collect() == []
