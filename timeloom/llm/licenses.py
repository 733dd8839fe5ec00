"""License notices by an exact set-similarity join; DataFrame functions only.

A block is as many consecutive words as a notice has (fewer at the end of a text), from a word of the notice on,
whatever lines it runs over.  It matches a template when it holds at least ``threshold`` of the template's
distinct words, all its telling words, and none of its foreign words, which tell of a sister license.
Words are ordered by how many documents of the table have them, rare ones first.  A matching block must share a
word with the template's prefix, the |T| - need + 1 rarest words (prefix filter), have at least ``need``
words of templates (length filter), and have that many from the first shared word on (positional filter).
Only blocks that pass are compared whole.  All bounds are necessary conditions, so no match is lost.

The prefix filter runs inside the scan: texts without such a word are not looked at again, others are cut
into overlapping chunks, and chunks without one are dropped.  A word of a prefix then meets the templates that
have it in theirs, with the words around it, so no row grows with its text after the scan.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import if_small
from timeloom.plans.session import stage

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Label -> phrase of words that names the license by itself.
PHRASES = {
    "mit": ["mit", "license"],
    "apache": ["apache", "license"],
    "gpl": ["general", "public", "license"],
}
#: Words of a chunk, besides those that blocks may need of its neighbours.
CHUNK = 512


class Template(NamedTuple):
    """A notice: its label, its words, the words that tell it from others, and words that tell of another."""

    label: str
    notice: str
    telling: str
    foreign: str = ""


TEMPLATES = [
    Template("mit", "released under the mit license", "mit"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission granted"),
    Template("apache", "licensed under the apache license version 2 0", "apache"),
    Template("gpl", "licensed under the gnu general public license version 3", "general public",
             "lesser affero library"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                    "general public license", "general public", "lesser affero library"),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", "lesser", "affero"),
    Template("agpl", "licensed under the gnu affero general public license version 3", "affero", "lesser"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution permitted"),
    Template("bsd", "released under the bsd license", "bsd"),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla"),
    Template("cc-by", "licensed under cc by 4 0", "cc by", "sa nc nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", "nc nd"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "sa nd"),
    Template("cc0", "dedicated to the public domain under cc0 1 0", "cc0"),
]


def words(text: Column) -> Column:
    """Words of a text; ASCII letters lower-cased, other ASCII signs between words."""
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def lowered(word: Column) -> Column:
    """A word with ASCII letters lower-cased; one that would change its length is no ASCII word."""
    low = F.lower(word)
    return F.when(F.octet_length(low) == F.octet_length(word), low).otherwise(word)


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _text_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents with the word, rare ones first."""
    found = docs.select(F.explode(F.array_intersect(
        words(F.lower(F.coalesce("text", F.lit("")))), _text_array(vocabulary))).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}  # one per word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _places(found: str) -> Column:
    """Places where a phrase's words stand one after the other."""
    at = F.sequence(F.lit(0), F.size(found) - 1)

    def here(i: Column) -> Column:
        hits = F.lit(False)
        for phrase in PHRASES.values():
            same = F.lit(True)
            for step, word in enumerate(phrase):
                same = same & F.coalesce(F.get(found, i + step) == word, F.lit(False))
            hits = hits | same
        return hits

    return F.when(F.size(found) > 0, F.filter(at, here))


def _labels_at(found: str, places: str) -> Column:
    """The labels of the phrases at the given places."""

    def has(phrase: list[str]) -> Column:
        return F.exists(places, lambda i: F.slice(found, i + 1, len(phrase)) == _text_array(phrase))

    return F.array_compact(F.array(*[F.when(has(p), F.lit(label)) for label, p in PHRASES.items()]))


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Base figures are places of the phrases; ``labels`` adds those of templates that a block matches;
    ``score`` is the largest share of a template's words that a matching block holds, 1 with a phrase, 0 with
    neither.  A missing or empty text has no words and no labels; rows are taken one by one, so repeated
    rows and missing ids come back as they are; further columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    vocabulary = sorted({w for t in templates for part in t[1:] for w in part.split()})
    by_rank = word_order(docs, vocabulary)
    rank = {w: i for i, w in enumerate(by_rank)}
    ranked = [(t.label, sorted({rank[w] for w in t.notice.split()})) for t in templates]
    prefixes = [t[:len(t) - _need(len(t), threshold) + 1] for _, t in ranked]
    prefix_words = _text_array([by_rank[r] for r in sorted({r for p in prefixes for r in p})])
    reach = max((len(t.notice.split()) for t in templates), default=1) - 1

    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"),
                       words(F.lower(text)).alias("rough"))
    # Rough words can only add matches; both filters leave nothing out.
    phrased = F.arrays_overlap("rough", _text_array(sorted({p[-1] for p in PHRASES.values()})))
    likely = F.arrays_overlap("rough", prefix_words)
    exact = F.transform(words(F.col("text")), lowered)
    order = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))]) if rank else None
    none = F.array().cast("array<struct<lead:int,ranks:array<int>>>")

    def chunks(found: str) -> Column:
        cuts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(CHUNK))
        cut = F.transform(cuts, lambda at: F.struct(
            F.least(at, F.lit(reach)).alias("lead"),
            F.slice(found, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)) + CHUNK + reach).alias("w")))
        near = F.filter(cut, lambda c: F.arrays_overlap(c["w"], prefix_words))
        return F.transform(near, lambda c: F.struct(
            c["lead"].alias("lead"), F.transform(c["w"], lambda w: order[w]).alias("ranks")))

    made = base.select(
        "doc_id", F.size("rough").cast("long").alias("n_words"), phrased.alias("phrased"), likely.alias("likely"),
        F.when(phrased | likely, exact).otherwise(F.array().cast("array<string>")).alias("found"),
    ).withColumn("places", F.coalesce(F.when(F.col("phrased"), _places("found")), F.array().cast("array<int>")))
    facts = stage(made.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.when(F.size("places") > 0, _labels_at("found", "places")).otherwise(
            F.array().cast("array<string>")).alias("base"),
        none.alias("chunks") if order is None else F.when(
            F.col("likely") & (F.size("found") > 0), chunks("found")).otherwise(none).alias("chunks")),
        "license_facts")

    side = [(i, label, t, _need(len(t), threshold), len(template.notice.split()),
             [rank[w] for w in template.telling.split()], [rank[w] for w in template.foreign.split()], word)
            for i, ((label, t), prefix, template) in enumerate(zip(ranked, prefixes, templates, strict=True))
            for word in prefix]
    matches = stage(_join(facts, side, reach), "license_matches")
    out = facts.drop("chunks").join(if_small(matches), "row", "left")
    every = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    joined = lambda c: F.concat_ws(",", F.sort_array(F.array_distinct(c)))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"), joined(every).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def _join(facts: DataFrame, side: list[tuple], reach: int) -> DataFrame:
    """row, more (labels), share: documents with a block that matches a template."""
    templates = facts.sparkSession.createDataFrame(
        side, "template int, label string, t array<int>, need int, n int, telling array<int>, foreign array<int>, word int")
    chunks = facts.select("row", F.explode("chunks").alias("c")).select("row", "c.lead", "c.ranks")
    prefix = sorted({r[-1] for r in side})
    posted = chunks.select("row", "lead", "ranks", F.posexplode("ranks").alias("at", "word")).where(
        F.col("word").isin(prefix) & (F.col("at") >= F.col("lead")) & (F.col("at") < F.col("lead") + CHUNK))
    mid = F.least("at", F.lit(reach))
    around = posted.select("row", "word", mid.alias("mid"), F.slice(
        "ranks", F.greatest(F.col("at") - reach, F.lit(0)) + 1, mid + reach + 1).alias("near"))
    # One row per template and prefix word: as many as the templates given by the caller have.
    pairs = around.join(F.broadcast(templates), "word")
    starts = F.filter(F.sequence(F.greatest(F.col("mid") - F.col("n") + 1, F.lit(0)), "mid"),
                      lambda s: F.coalesce(F.array_contains("t", F.get("near", s)), F.lit(False)))
    blocks = F.transform(starts, lambda s: F.array_distinct(F.array_compact(F.slice("near", s + 1, F.col("n")))))

    def passes(b: Column) -> Column:
        later = F.filter(b, lambda r: r >= F.col("word"))
        telling = (F.size(F.array_except("telling", b)) == 0) & ~F.arrays_overlap(b, "foreign")
        return (F.size(b) >= F.col("need")) & (F.size(later) >= F.col("need")) & telling

    left = pairs.select("row", "label", "t", "need", F.filter(blocks, passes).alias("left")).where(F.size("left") > 0)
    most = F.array_max(F.transform("left", lambda b: F.size(F.array_intersect(b, "t"))))
    hits = left.select("row", "label", "need", F.size("t").alias("size"), most.alias("both")).where("both >= need")
    return hits.groupBy("row").agg(F.collect_set("label").alias("more"),
                                   F.max(F.col("both") / F.col("size")).alias("share"))
