"""License scan as an exact set-similarity join of text blocks and license templates, in DataFrame
operations only.

Blocks are overlapping windows of words, so that every run of up to half a window lies whole in one.
Templates are notices of a line or whole license texts, so windows come in several widths (strides of 32,
64, 128, ... words), and a template is sought in those that its length fits. The templates' words are
ordered by their counts over the whole corpus, rarest first. A block whose containment of a template
reaches the threshold holds one of the template's first words in that order (prefix filter), has enough
words (length filter), and enough of them from there on in the order (positional filter); what passes is
verified on the sets. Of phrases, the places where the words stand in a row are then found within the
matched blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reefline.llm.common import kept, workspace, written

#: What parts words, after A-Z are lower-cased: ASCII but for digits and letters.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The least stride of windows, in words; a window has two strides.
STRIDE = 32


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # the words must stand in a row
    family: str = ""  # of the variants of one notice, only the best match in a block names it

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(self.text.split())

    @property
    def stride(self) -> int:
        """That of the windows it is sought in."""
        return max(STRIDE, 1 << (len(self.words) - 1).bit_length())


#: The phrases of the base labels.
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: Usual notices of public licenses.
NOTICES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", family="gpl"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", family="gpl"),
    Template("lgpl", "licensed under the gnu lesser general public license", family="gpl"),
    Template("agpl", "licensed under the gnu affero general public license", family="gpl"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("cc-by-4.0", "licensed under cc by 4 0", family="cc"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", family="cc"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", family="cc"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    # Whole texts.
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
)


def split_words(text: Column) -> Column:
    """The words, with an empty string before or after them where the text begins or ends with a gap.
    ``lower`` does for words that are compared with ASCII ones, but for the Kelvin sign, which it makes a k."""
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("ķ"))), GAP, -1)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    phrases: tuple[Template, ...] = PHRASES,
    notices: tuple[Template, ...] = NOTICES,
    threshold: float = 0.8,
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    ``labels`` has the base labels and, of each block, those of all matching notices; of a
    notice's variants, the best matching.

    A null or empty text has no words and no labels (empty strings, score 0). first_word and last_word
    are null without a base place. score: the best containment of a template (1 for a base place). Rows
    that repeat an id, or have none, are scanned each for itself. Other columns are ignored; an empty table
    gives no rows.
    """
    with workspace(docs.sparkSession, "licenses"):
        return kept(_scanned(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), phrases, notices, threshold).withColumnRenamed("_id", id_col), "licenses-result")


def needed(t: Template, threshold: float) -> int:
    """How many of a template's distinct words a block must hold."""
    n = len(set(t.words))
    return n if t.phrase else math.ceil(threshold * n - 1e-9)


def _scanned(docs: DataFrame, phrases: tuple[Template, ...], notices: tuple[Template, ...], threshold: float) -> DataFrame:
    templates = [*phrases, *notices]
    vocabulary = sorted({w for t in templates for w in t.words})
    # One pass over the texts: their words of the vocabulary with their places. The array of one array is a
    # step of its own, so that a text is split once.
    split = docs.select("_id", F.explode(F.array(split_words(F.col("_text")))).alias("_words"))
    led = (F.get("_words", F.lit(0)) == "").cast("int")
    ended = ((F.element_at("_words", -1) == "") & (F.size("_words") > 1)).cast("int")
    spoken = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    read = split.select(F.monotonically_increasing_id().alias("_row"), "_id", (F.size("_words") - led - ended).cast("long").alias("n_words"), led.alias("_led"), spoken.alias("_spoken"))
    read = written(read, "license-words")

    # Counts of the vocabulary over the whole corpus: as many rows as it has words.
    counts = {r[0]: r[1] for r in read.select(F.explode("_spoken.w").alias("w")).groupBy("w").count().collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    spark = docs.sparkSession
    index, facts = [], []
    for k, t in enumerate(templates):
        ranks = sorted(order[w] for w in set(t.words))
        need = needed(t, threshold)
        facts.append((k, t.label, t.phrase, t.family or f"{k}", ranks, need))
        index += [(rank, t.stride, k) for rank in ranks[: len(ranks) - need + 1]]
    index_df = spark.createDataFrame(index, "_rank int, _stride int, _t int")
    facts_df = spark.createDataFrame(facts, "_t int, _label string, _phrase boolean, _family string, _ranks array<int>, _need int")
    rare = {rank for rank, *_ in index}
    rare_words = F.array(*[F.lit(w) for w in vocabulary if order[w] in rare])

    # Texts without any prefix word are done with.
    ranks = F.create_map(*[F.lit(v) for w in vocabulary for v in (w, order[w])])
    open_rows = read.where(F.arrays_overlap(F.col("_spoken.w"), rare_words)).select("_row", "n_words", "_led", F.explode("_spoken").alias("_s"))
    hits = written(open_rows.select("_row", "n_words", (F.col("_s.at") - F.col("_led")).cast("long").alias("_pos"), F.element_at(ranks, F.col("_s.w")).alias("_rank")), "license-hits")
    windows = []
    for stride in sorted({t.stride for t in templates}):
        last = F.floor(F.col("_pos") / stride).cast("long")
        windows += [F.struct(F.lit(stride).alias("stride"), b.alias("block")) for b in (last, F.greatest(last - 1, F.lit(0)))]
    blocks = (
        hits.withColumn("_w", F.explode(F.array_distinct(F.array(*windows))))
        .groupBy("_row", F.col("_w.stride").alias("_stride"), F.col("_w.block").alias("_block"))
        .agg(F.array_sort(F.collect_set("_rank")).alias("_set"), F.first("n_words").alias("n_words"))
    )
    size = F.least(F.col("n_words") - F.col("_block") * F.col("_stride"), F.lit(2) * F.col("_stride"))
    candidates = (
        blocks.select("*", F.explode(F.array_intersect("_set", F.array(*[F.lit(r) for r in sorted(rare)]))).alias("_rank"))
        .join(F.broadcast(index_df), ["_rank", "_stride"])
        .join(F.broadcast(facts_df), "_t")
        .where(size >= F.col("_need"))  # length
        .withColumn("_after", F.size("_set") - F.array_position("_set", F.col("_rank")) + 1)
        .where((F.col("_after") + F.size(F.filter("_ranks", lambda r: r < F.col("_rank")))) >= F.col("_need"))  # position
    )
    matched = (
        candidates.withColumn("_share", F.size(F.array_intersect("_set", "_ranks")) / F.size("_ranks"))
        .where(F.size(F.array_intersect("_set", "_ranks")) >= F.col("_need"))
        .select("_row", "_stride", "_block", "_t", "_label", "_phrase", "_family", "_share")
        .distinct()
    )
    # Versions of one notice differ in a word or two: of a block's variants, the best matches name it.
    best = F.max(F.when(~F.col("_phrase"), F.col("_share"))).over(Window.partitionBy("_row", "_stride", "_block", "_family"))
    named = matched.withColumn("_best", best).where("not _phrase and _share >= _best").drop("_best")
    by_doc = Window.partitionBy("_row").orderBy("_pos")
    longest = max((len(t.words) for t in phrases), default=1)
    ahead = hits.select("_row", "_pos", "_rank")
    for j in range(1, longest):
        ahead = ahead.withColumns({f"_r{j}": F.lead("_rank", j).over(by_doc), f"_p{j}": F.lead("_pos", j).over(by_doc)})
    stands = []
    for k, t in enumerate(phrases):
        here = F.col("_rank") == order[t.words[0]]
        for j, w in enumerate(t.words[1:], 1):
            here &= (F.col(f"_r{j}") == order[w]) & (F.col(f"_p{j}") == F.col("_pos") + j)
        stands.append(F.when(here, F.struct(F.lit(k).alias("t"), F.lit(t.stride).alias("stride"))))
    none = F.array().cast("array<struct<t:int,stride:int>>")
    places = (
        ahead.select("_row", "_pos", F.explode(F.array_compact(F.array(*stands)) if stands else none).alias("_f"))
        .select("_row", "_pos", F.col("_f.t").alias("_t"), F.col("_f.stride").alias("_stride"), F.floor(F.col("_pos") / F.col("_f.stride")).cast("long").alias("_block"))
        .join(matched.where("_phrase").select("_row", "_stride", "_block", "_t", "_label"), ["_row", "_stride", "_block", "_t"])
    )
    found_rows = places.select("_row", "_label", F.col("_pos"), F.lit(1.0).alias("_share")).unionByName(
        named.select("_row", "_label", F.lit(None).cast("long").alias("_pos"), "_share")
    )
    base = F.col("_pos").isNotNull()
    labels = found_rows.groupBy("_row").agg(
        F.count("_pos").alias("n_base"),
        F.min("_pos").alias("first_word"),
        F.max("_pos").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("_label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("_label")), ",").alias("labels"),
        F.max("_share").alias("score"),
    )
    return read.select("_row", "_id", "n_words").join(labels, "_row", "left").select(
        "_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
