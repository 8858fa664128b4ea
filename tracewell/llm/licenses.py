"""License scans: places of fixed phrases, and an exact containment join of text blocks (lines, and windows of words across them) with license templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices whose words a block must contain.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-long": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License",
    "mit-long": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "rights-reserved": "All rights reserved",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words, A-Z lower-cased, each after one space and with one space at the end; no words: one space."""
    return F.regexp_replace(F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(" ")), SEPARATORS, " ")


def n_words(spaced_text: Column) -> Column:
    return (F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))).cast("long") - 1


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def phrase_places(s: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How many places the phrase has in spaced text, and the word numbers of the first and the last (null where none).

    Each is one or two passes over the text, however many places there are.
    """
    words_before = lambda at: at - F.length(F.replace(s.substr(F.lit(1), at), F.lit(" "), F.lit(""))) - 1
    n = F.length(s) - F.length(F.regexp_replace(s, f" (?={phrase} )", ""))
    spaced_phrase = f" {phrase} "
    first, back = F.locate(spaced_phrase, s), F.locate(spaced_phrase[::-1], F.reverse(s))
    last = F.length(s) - back - len(spaced_phrase) + 2
    return n, F.when(first > 0, words_before(first)), F.when(back > 0, words_before(last))


class _Plan:
    """Templates as words, ordered by how many documents hold them, rarest first, and the texts that can meet the threshold."""

    def __init__(self, docs: DataFrame, templates: dict[str, str], threshold: float) -> None:
        words = {label: list(dict.fromkeys(_words(t))) for label, t in templates.items()}
        self.vocabulary = sorted({w for ws in words.values() for w in ws})
        self.least = {label: max(1, -int(-threshold * len(ws) // 1)) for label, ws in words.items()}
        self.width = {label: -(-5 * len(_words(t)) // 4) for label, t in templates.items()}
        texts = docs.filter("doc_id is not null").select("doc_id", F.translate("text", _UPPER, _LOWER).alias("low"))
        common = F.array_intersect(F.split("low", SEPARATORS), self.these(self.vocabulary))
        held = cut(texts.select("doc_id", common.alias("words")).filter(F.size("words") >= min(self.least.values())))
        # At most one row for each word of the templates comes to the driver.
        counts = {r.w: r["count"] for r in held.select(F.explode("words").alias("w")).groupBy("w").count().collect()}
        self.order = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.ranked = {label: sorted(ws, key=self.order.__getitem__) for label, ws in words.items()}
        self.first = {label: ws[: len(ws) - self.least[label] + 1] for label, ws in self.ranked.items()}
        self.search = rf"(?<![a-z0-9])(?:{'|'.join(sorted({w for ws in self.first.values() for w in ws}))})(?![a-z0-9])"
        # What a block must hold its text must: one of a template's first words, and enough of all.
        can = [F.arrays_overlap("words", self.these(self.first[x])) & (F.size(F.array_intersect("words", self.these(ws))) >= self.least[x]) for x, ws in self.ranked.items()]
        able = cut(held.filter(reduce(Column.__or__, can)).select("doc_id").distinct())
        self.passed = cut(texts.join(F.broadcast(able) if small(able, BROADCAST_ROWS) else able, "doc_id", "left_semi"))

    @staticmethod
    def these(words: list[str]) -> Column:
        return F.array(*map(F.lit, words))


def template_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.9, plan: _Plan | None = None) -> DataFrame:
    """doc_id, block, label, containment for every line of a text that holds at least `threshold` of a template's distinct words.

    The join is exact. Template words are put in the order of their frequency over all documents, rarest first; a line
    that meets the threshold holds one of a template's first words (prefix; other texts and lines leave after one
    search), has enough words of any template (length), and at its first common word has enough of them left
    (position); what passes is compared in full. Rows without a doc_id or text have no blocks.
    """
    plan = plan or _Plan(docs, templates, threshold)
    blocks = plan.passed.select("doc_id", F.posexplode(F.split("low", "\n")).alias("block", "line")).filter(F.col("line").rlike(plan.search))
    held = blocks.select("doc_id", "block", F.array_intersect(F.split("line", SEPARATORS), plan.these(plan.vocabulary)).alias("words"))
    held = held.filter(F.size("words") >= min(plan.least.values()))
    index = [(w, label, i, len(ws), plan.least[label], ws) for label, ws in plan.ranked.items() for i, w in enumerate(plan.first[label])]
    rows = docs.sparkSession.createDataFrame(index, "w string, label string, i int, n int, least int, template array<string>")
    ranks = F.create_map(*[F.lit(x) for w, i in plan.order.items() for x in (w, i)])
    ranked = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"])
    posted = held.select("doc_id", "block", ranked.alias("words")).select("doc_id", "block", "words", F.posexplode("words").alias("j", "w"))
    # The index holds a few words of each template: its size is that of the templates given, whatever the corpus.
    pairs = posted.join(F.broadcast(rows), "w").filter((F.size("words") >= F.col("least")))
    pairs = pairs.withColumn("rest", F.least(F.col("n") - F.col("i"), F.size("words") - F.col("j")))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("words", "template")))
    first = F.col("i") == F.array_position("template", F.element_at(F.array_intersect("template", "words"), 1)).cast("int") - 1
    pairs = pairs.filter(first & (F.col("rest") >= F.col("least")) & (F.col("common") >= F.col("least")))
    return pairs.select("doc_id", "block", "label", (F.col("common") / F.col("n")).alias("containment"))


def wrapped_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.9, plan: _Plan | None = None) -> DataFrame:
    """doc_id, label, containment (the largest) where a window of a text's words, whatever its lines, holds at least `threshold` of a template's distinct words.

    A window has a quarter more words than its template, so that the leaders of comment lines have room. One that meets
    the threshold holds one of the template's first words, so only what lies around those is looked at, and first
    whether it has enough of the template's words at all.
    """
    plan = plan or _Plan(docs, templates, threshold)
    span = max(plan.width.values())
    index = [(w, label, plan.least[label], plan.width[label], ws) for label, ws in plan.ranked.items() for w in plan.first[label]]
    rows = docs.sparkSession.createDataFrame(index, "w string, label string, least int, width int, template array<string>")
    words = plan.passed.filter(F.col("low").contains("\n")).select("doc_id", F.split("low", SEPARATORS).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: x["w"].isin(sorted({x[0] for x in index})))
    around = F.transform(places, lambda x: F.struct(x["w"].alias("w"), F.slice("words", F.greatest(x["at"] - (span - 2), F.lit(1)), F.lit(2 * span - 1)).alias("near")))
    found = words.select("doc_id", F.explode(around).alias("x")).select("doc_id", "x.*").join(F.broadcast(rows), "w")
    held = lambda part: F.size(F.array_intersect("template", part))
    found = found.filter(held(F.col("near")) >= F.col("least"))
    most = F.array_max(F.transform(F.sequence(F.lit(1), F.size("near")), lambda j: held(F.slice("near", j, F.col("width")))))
    best = found.select("doc_id", "label", most.alias("most"), "least", F.size("template").alias("n")).filter("most >= least")
    return best.groupBy("doc_id", "label").agg(F.max(F.col("most") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of `docs` (doc_id, text).

    score: the largest containment of a template, 1 where a base phrase stands, else 0. Null and empty texts have no
    words, no labels and score 0. Blocks are lines and windows of words across lines, of whole texts of any length. Rows
    that share a doc_id or have none each get the values of their own text; an empty table gives an empty result, and
    other columns are left out.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Rows of one id and text have the same values; the id spreads copies of one text.
    docs = docs.withColumn("_key", F.md5(F.concat_ws(":", F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string"))))
    s = F.col("s")
    hit = s.rlike(" (?:" + "|".join(PHRASES) + ") ")
    places = [phrase_places(s, p) for p in PHRASES]
    found = F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for (n, _, _), label in zip(places, PHRASES.values(), strict=True)]))
    best = F.when(hit, F.struct(sum((n for n, _, _ in places), F.lit(0)).alias("n"), F.least(*[a for _, a, _ in places]).alias("first"), F.greatest(*[b for _, _, b in places]).alias("last"), found.alias("labels")))
    base = docs.select("_key", "doc_id", spaced(F.col("text")).alias("s")).select("_key", "doc_id", n_words(s).alias("n_words"), best.alias("b"))
    none = F.array().cast("array<string>")
    base = base.select("_key", "doc_id", "n_words", F.coalesce("b.n", F.lit(0)).cast("long").alias("n_base"), F.col("b.first").cast("long").alias("first_word"), F.col("b.last").cast("long").alias("last_word"), F.coalesce("b.labels", none).alias("base"))
    keyed = docs.select(F.col("_key").alias("doc_id"), "text")
    plan = _Plan(keyed, templates, threshold)
    blocks = template_blocks(keyed, templates, threshold, plan).select("doc_id", "label", "containment").unionByName(wrapped_blocks(keyed, templates, threshold, plan))
    more = cut(blocks.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("most")))
    out = base.join(F.broadcast(more) if small(more, BROADCAST_ROWS) else more, "_key", "left")
    both = F.array_union("base", F.coalesce("more", none))
    score = F.greatest(F.coalesce("most", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(both).alias("labels"), score.alias("score"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Written from the contract: words by splitting, places by position, containment by counting common words."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    arr = lambda ws: "[" + ", ".join(map(q, ws)) + "]"
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    phrases = " union all ".join(f"select {arr(p.split())} as p, {q(label)} as label" for p, label in PHRASES.items())
    templates = " union all ".join(f"select {arr(list(dict.fromkeys(_words(t))))} as t, {q(label)} as label" for label, t in TEMPLATES.items())
    return f"""
with w as (
  select doc_id, list_filter(regexp_split_to_array({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents
), p as ({phrases}), t as ({templates}), k as (
  select doc_id, w, unnest(range(0, len(w))) as i from w where array_to_string(w, ' ') similar to '.*(cc by|general public license|all rights reserved).*'
), hits as (
  select k.doc_id, k.i, p.label from k join p on k.w[k.i + 1:k.i + len(p.p)] = p.p
), base as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hits group by 1
), lines as (
  select doc_id, list_distinct(list_filter(regexp_split_to_array(line, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) as lw
  from (select doc_id, unnest(string_split({low}, chr(10))) as line from documents)
), held as (
  select l.doc_id, t.label, len(list_intersect(l.lw, t.t)) / len(t.t)::double as containment, len(list_intersect(l.lw, t.t)) as c, len(t.t) as n
  from lines l join t on list_has_any(l.lw, t.t)
), more as (select doc_id, label, max(containment) as containment from held where c >= ceil(0.9 * n) group by 1, 2),
labels as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from hits union select doc_id, label from more) group by 1
), best as (select doc_id, max(containment) as s from more group by 1)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(b.n_base, 0) as n_base, b.first_word, b.last_word, coalesce(b.base_labels, '') as base_labels,
  coalesce(labels.labels, '') as labels, greatest(coalesce(best.s, 0.0), case when b.n_base > 0 then 1.0 else 0.0 end)::double as score
from w left join base b using (doc_id) left join labels using (doc_id) left join best using (doc_id)
"""


OP8_SQL = _oracle()
