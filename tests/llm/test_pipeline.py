"""The corpus pipeline from files to packed sequences."""

from __future__ import annotations

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from timeloom.llm.tokens import default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"


def corpus():
    """(rows, labels, ids that must stay, ids that must go)."""
    rng = random.Random(11)

    def prose(n):
        return " ".join(rng.choice(["alder", "birch", "cedar", "elm", "fir", "oak"]) + str(rng.randrange(900))
                        for _ in range(n))

    rows, labels = [], []
    for i in range(320):
        toxic = i % 8 == 0
        rows.append((i, prose(60) + (" vileness and foulness, nastyword " if toxic else "") + prose(8)))
        if i < 240:
            labels.append((i, 1, int(toxic)))
    base = prose(200).split()
    for i in range(400, 430):  # near copies: one word of 200 differs, so 5 of 196 shingles
        rows.append((i, " ".join([*base[:100], f"w{i}", *base[101:]])))
    passage = prose(60)
    for i in range(500, 520):
        rows.append((i, prose(40) + " " + passage + " " + prose(40)))
    rows += [(600, None), (601, ""), (None, prose(30)), (602, rows[1][1]), (1, rows[1][1]), (700, prose(9000))]
    gone = {i for i in range(0, 320, 8)} | set(range(401, 430)) | {602}
    stay = ({i for i, _ in rows if i is not None} - gone) | {None}
    return rows, labels, stay, gone, passage


def write(spark, folder, rows, labels):
    spark.createDataFrame([(*r, "en", "s", 0, "k") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    rows, labels, stay, gone, passage = corpus()
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = docs.collect()
    ids = [r.doc_id for r in left]
    assert set(ids) == stay and not gone & set(ids) and len(ids) == len(stay)
    texts = {r.doc_id: r.text for r in left}
    original = dict(rows)
    assert sum(passage in (t or "") for t in texts.values()) == 1
    assert passage in texts[500] and all(len(texts[i]) < len(original[i]) - 200 for i in range(501, 520))
    assert all(texts[i] == original[i] for i in (2, 3, 600, 601, 700, None))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    for doc_id in stay:
        mine = sorted((p.start, p.ids) for p in pieces if p.doc_id == doc_id)
        found = np.frombuffer(b"".join(i for _, i in mine), "<u4").tolist()
        assert found == [*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
    fills = {}
    for p in pieces:
        fills.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in fills.values():
        ends = 0
        for offset, length in sorted(found):
            assert offset == ends
            ends += length
        assert ends <= 4096


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0), (2, 0, 1)]])
def test_pipeline_of_nothing(spark, tmp_path, labelled):
    write(spark, tmp_path, [], labelled)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
