"""Operator 5: license scans as an exact set-similarity join.

The words of every text are counted for the template vocabulary over all
documents, and the tokens of templates and blocks are put in that global order,
rarest first. A template of T tokens must share ceil(threshold * T) with a
block, so one of its first T - ceil(threshold * T) + 1 tokens is in the block
(prefix filter), the block has at least ceil(threshold * T) template tokens
(length filter), and behind a match at positions i and j enough tokens must be
left on both sides (positional filter). What passes is verified on the sets and,
where a label has ``evidence``, on the words that tell it from similar licenses.

Blocks are runs of ``block_words`` words that overlap by half, so a notice of up
to half a block lies whole in one of them, wherever lines break. A longer template
has blocks of its own, at least twice its words.

Defined cases: a null or empty text has no words, no places, empty labels and
score 0; null ids and repeated rows give a row each; words are compared after
A-Z are folded, other letters as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tremorframe.llm.common import whole

# The phrases of the contract and their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Short notices by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl-3", "this library is licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this file is subject to the terms of the mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
]
# What tells a label from its neighbours. A block must match every pattern of a label, or words that
# licenses share would carry it alone: at 0.8, gpl-3 lies in any LGPL or AGPL notice, mit in any license "released under the".
_VERSION = r"(?:versions?|ver|v|licen[cs]es?|or|and|apache|mpl|[al]?gpl)"
_2 = rf" (?:v2|apache2|mpl2|2 0|{_VERSION} 2) "
_3 = rf" (?:v3|[al]?gplv?3|{_VERSION} (?:3|three)) "
EVIDENCE = {
    "mit": [r" (?:(?:the|an|under|of) mit|mit (?:licen[cs]e[ds]?|style|x11|expat|terms)|permission is hereby granted free of charge) "],
    "apache-2": [" apache2? ", _2],
    "cc-by-nc": [" (?:cc|by|attribution) (?:nc|non ?commercial) "],
    "cc-by-sa": [" (?:cc|by|attribution) (?:sa|share ?alike) "],
    "gpl-3": [r"(?<! (?:lesser|library|affero)) (?:general public|gplv?3?) ", _3],
    "lgpl-3": [r" (?:lesser (?:general|gnu|gpl)|lgplv?3?) ", _3],
    "agpl-3": [r" (?:affero|agplv?3?) ", _3],
    "mpl-2": [" (?:mozilla|mpl2?) ", _2],
}
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the gnu {}general public license"
    " as published by the free software foundation either version 3 of the license or at your option any later version"
    " this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose see the gnu {}general public license for more details"
)
# The texts that stand in files instead of a short notice.
FULL_TEXTS = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation the"
        " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"
        " and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by"
        " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language"
        " governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met redistributions of source code must retain the above copyright notice this list of"
        " conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with"
        " the distribution",
    ),
    ("gpl-3", _GNU.format("", "")),
    ("lgpl-3", _GNU.format("lesser ", "lesser ")),
    ("agpl-3", _GNU.format("affero ", "affero ")),
]
MOST_TEMPLATES = 1_000
BLOCK_WORDS = 64
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Words of a text with A-Z folded. ``lower`` would also change other letters, so it serves ASCII only."""
    ascii_only = F.octet_length(text) == F.length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, BETWEEN), "")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the words of ``phrase`` stand one after another."""
    tokens = phrase.split()
    first = F.filter(
        F.transform(words, lambda w, i: F.when(w == tokens[0], i)), lambda i: i.isNotNull()
    )
    wanted = F.array(*[F.lit(t) for t in tokens])
    return F.filter(first, lambda i: F.slice(words, i + 1, len(tokens)) == wanted)


def token_ranks(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Global order of the template vocabulary: rarest in the corpus first, then by name.

    ``words`` has an array ``_words`` per row. One row per template token comes
    to the driver, at most the vocabulary.
    """
    counts = dict(
        words.select(F.explode("_words").alias("token"))
        .filter(F.col("token").isin(vocabulary))
        .groupBy("token")
        .count()
        .collect()
    )
    order = sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))
    return {t: i for i, t in enumerate(order)}


def block_starts(words: Column, block_words: int) -> Column:
    """Places before runs of ``block_words`` words, each half a block after the one before."""
    half = block_words // 2
    last = F.greatest(F.size(words) - half - 1, F.lit(0))
    return F.sequence(F.lit(0), last, F.lit(half))


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
    evidence: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per document: words, phrase places, labels of phrases and templates, best containment.

    ``evidence`` has patterns by label, all of which a block must match for a template of that label to count. They
    are held against the block's words, and the word before them, with a space around each. Without it
    containment alone decides.
    """
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates: they are broadcast")
    sets = [(label, set(text.split())) for label, text in templates]
    vocabulary = sorted(set().union(*[s for _, s in sets]))
    worded = docs.select("doc_id", license_words(whole()).alias("_words"))
    rank = token_ranks(worded, vocabulary)

    needs = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    # a block holds twice the words of a template; few lengths, since each is a pass over the words
    lengths = [block_words << max(0, math.ceil(math.log2(2 * max(1, len(text.split())) / block_words))) for _, text in templates]
    index = [
        (tid, label, token, place, len(s), need, [rank[t] for t in s], length)
        for tid, ((label, s), need, length) in enumerate(zip(sets, needs, lengths))
        for place, token in enumerate(sorted(s, key=rank.get)[: len(s) - need + 1])
    ]
    prefixes = docs.sparkSession.createDataFrame(
        index, "_tid int, _label string, _token string, _i int, _size int, _need int, _tokens array<int>, _length int"
    ).withColumn("_token", F.element_at(F.create_map(*[x for t, r in rank.items() for x in (F.lit(t), F.lit(r))]), F.col("_token")))
    heads = F.array(*[F.lit(t) for t in sorted({row[2] for row in index})])
    order = F.create_map(*[x for t, r in rank.items() for x in (F.lit(t), F.lit(r))])

    words = F.col("_words")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    placed = worded.withColumns(
        {"_row": F.monotonically_increasing_id(), "_joined": joined, "_head": F.arrays_overlap(words, heads)}
    )
    empty = F.array().cast("array<int>")
    for label, phrase in phrases.items():
        places = F.when(F.col("_joined").contains(f" {phrase} "), phrase_places(words, phrase)).otherwise(empty)
        placed = placed.withColumn(f"_at_{label}", places)
    starts = F.concat(*[F.col(f"_at_{label}") for label in phrases])
    base = F.array_compact(F.array(*[F.when(F.size(f"_at_{x}") > 0, F.lit(x)) for x in phrases]))

    def pieces(length: int) -> Column:
        """Blocks of a length: ranks of the template tokens in order, and the words with the one before."""
        own = sorted(set().union(*[s for (_, s), n in zip(sets, lengths) if n == length]))
        tokens = F.array(*[F.lit(t) for t in own])

        def block(i: Column) -> Column:
            ranks = F.transform(F.array_intersect(F.slice(words, i + 1, length), tokens), lambda t: order[t])
            text = F.array_join(F.slice(words, F.greatest(i, F.lit(1)), length + F.least(i, F.lit(1))), " ")
            spaced = F.concat(F.lit(" "), text, F.lit(" ")) if evidence else F.lit(None).cast("string")
            return F.struct(F.sort_array(ranks).alias("ranks"), spaced.alias("text"), F.lit(length).alias("length"))

        least = min(need for need, n in zip(needs, lengths) if n == length)
        return F.filter(F.transform(block_starts(words, length), block), lambda b: F.size(b["ranks"]) >= least)

    none = F.array().cast("array<struct<ranks:array<int>,text:string,length:int>>")
    tokens = F.concat(none, *[pieces(n) for n in sorted(set(lengths))])
    # a document without any prefix token goes on with a single row
    exploded = (
        placed.select(
            "_row", "doc_id",
            F.size(words).cast("long").alias("n_words"),
            F.size(starts).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            base.alias("_base"),
            F.when(F.col("_head"), tokens).alias("_blocks"),
        )
        .select("*", F.explode_outer("_blocks").alias("_piece"))
        .withColumns({"_block": F.col("_piece.ranks"), "_text": F.col("_piece.text"), "_length": F.col("_piece.length")})
        .drop("_blocks", "_piece")
        .select("*", F.posexplode_outer("_block").alias("_j", "_token"))
    )
    left = F.least(F.col("_size") - F.col("_i"), F.size("_block") - F.col("_j"))
    pairs = exploded.join(F.broadcast(prefixes), ["_token", "_length"], "left").withColumn(
        "_share",
        F.when(
            (F.size("_block") >= F.col("_need")) & (left + F.least(F.col("_i"), F.col("_j")) >= F.col("_need")),
            F.size(F.array_intersect("_block", "_tokens")),
        ),
    )
    told = F.lit(True)
    for label, patterns in (evidence or {}).items():
        matched = reduce(Column.__and__, [F.col("_text").rlike(p) for p in patterns])
        told = F.when(F.col("_label") == label, matched).otherwise(told)
    # patterns are tried where the sets agree, and nowhere else
    pairs = pairs.withColumn("_hit", F.when(F.col("_share") >= F.col("_need"), told).otherwise(F.lit(False)))
    hit = F.col("_hit")
    per_row = pairs.groupBy("_row", "doc_id", "n_words", "n_base", "first_word", "last_word", "_base").agg(
        F.collect_set(F.when(hit, F.col("_label"))).alias("_found"),
        F.max(F.when(hit, F.col("_share") / F.col("_size"))).alias("_best"),
    )

    def text(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return per_row.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text(F.col("_base")).alias("base_labels"),
        text(F.concat("_base", "_found")).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
