"""Licence scan: a trained paragraph classifier, calibrated, and confirmed against templates.

Paragraphs (lines) become sets of word bigrams and trigrams.  A multinomial logistic regression over the n-grams of
the licence templates and of notices of other licences is fitted to template spans, those notices, hard negatives and a bounded sample of the corpus' own
paragraphs.  Its probabilities are calibrated by a temperature chosen on held-out examples; a paragraph whose best family
stays under ``min_probability`` is unknown, as is one that the class of other text wins.  What remains is compared
with the templates of its family: ``similarity`` is the share of the closest template's n-grams that the paragraph
holds, and a prediction counts as confirmed from ``min_similarity`` on.

Scoring is one pass of DataFrame functions without a shuffle: n-grams are looked up in constant arrays addressed by
their hash, weights in constant arrays addressed by feature.  All constants are bounded by the templates.

Defined results: null and empty texts and paragraphs without a template n-gram give no row; repeated rows give repeated
rows; other columns are ignored; an empty table gives an empty result (the model is then fitted without its sample).
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.shared import plain, written

#: Notices by which a text states its licence, by family.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "This project is released under the Apache 2.0 license.",
               "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.",
            "This software is licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "The MIT License (MIT)"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Released under the GNU GPL version 2 or later.",
            "SPDX-License-Identifier: GPL-3.0-or-later"],
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "Released under the GNU AGPL version 3 or later.",
             "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "SPDX-License-Identifier: LGPL-2.1-only"],
    "bsd": ["Released under the BSD License.",
            "Licensed under the 3-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "SPDX-License-Identifier: ISC"],
    "epl": ["Licensed under the Eclipse Public License, version 2.0.",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
            "SPDX-License-Identifier: EPL-2.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.",
                      "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."],
}
#: Paragraphs that speak of licences without stating one.
HARD_NEGATIVES = [
    "He was licensed to drive a bus under the terms of the contract.", "The license of this shop was released to the public in version three of the file.",
    "You may not use this file in the office.", "This work is done under the bridge, free of charge, by any person of the public.",
    "She has a license to sell source code books.", "A copy of the letter was granted to the general public.", "The terms of the general agreement are public.",
    "Released under the tree at noon.", "Licensed under the counter for years.", "The software version 2.0 is out and the documentation files are not.",
]
#: Notices of licences that are no family: other text to the classifier, with their own n-grams among its features.
NEAR_MISSES = [
    "Released under the zlib License.", "This software is licensed under the Artistic License 2.0.", "Released under the WTFPL version 2.",
    "Licensed under the Common Development and Distribution License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public License, version 1.2.", "This work is licensed under the Server Side Public License, version 1.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Business Source License, version 1.1.", "This library is licensed under the Microsoft Public License, version 1.0.",
    "Licensed under the Common Public License, version 1.0.", "Licensed under the terms of the Open Software License, version 3.0.", "Licensed under CC BY-NC-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: OFL-1.1",
    "This software is proprietary and confidential; no license is granted to any person to use, copy or modify it without written permission.",
]
OTHER = "other"
SAMPLE_DOCS = 300
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
TEMPERATURES = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0]
SLOTS = 1 << 14
_WORDS = r"regexp_extract_all(lower({line}), '[a-z0-9]+(?:[.-][a-z0-9]+)*', 0)"
_GRAMS = """transform(array({words}), w -> array_distinct(concat(
  case when size(w) < 2 then cast(array() as array<string>) else transform(sequence(0, size(w) - 2), i -> concat(get(w, i), ' ', get(w, i + 1))) end,
  case when size(w) < 3 then cast(array() as array<string>) else transform(sequence(0, size(w) - 3), i -> concat(get(w, i), ' ', get(w, i + 1), ' ', get(w, i + 2))) end)))[0]"""


def grams_sql(line: str) -> str:
    """SQL of the distinct word bigrams and trigrams of a line."""
    return _GRAMS.format(words=_WORDS.format(line=line))


def constant(values, kind: str) -> str:
    """SQL of a constant array (folded to one literal when the query is planned)."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)"


class Model:
    """Feature places and weights of a fitted classifier, as SQL over constant arrays."""

    def __init__(self, features: list[str], hashes: list[int], classes: list[str], weights, intercepts, templates):
        self.features, self.hashes, self.classes = features, hashes, classes
        self.weights, self.intercepts, self.templates = weights, intercepts, templates
        self.temperature = 1.0

    def places_sql(self, grams: str) -> str:
        """SQL of the feature numbers of the n-grams that are features."""
        chains = {}
        for i, h in enumerate(self.hashes):
            chains.setdefault(h % SLOTS, []).append((h, i))
        deep = max(map(len, chains.values()))
        cases = []
        for level in range(deep):
            keys, values = [0] * SLOTS, [-1] * SLOTS
            for slot, chain in chains.items():
                if level < len(chain):
                    keys[slot], values[slot] = chain[level]
            key = f"get({constant(keys, 'bigint')}, s)"
            empty = f"when {key} = 0 then -1 " if level == 0 else ""
            cases.append(f"{empty}when {key} = h then get({constant(values, 'int')}, s)")
        found = f"transform(array(xxhash64(g)), h -> transform(array(cast(pmod(h, {SLOTS}) as int)), s -> case {' '.join(cases)} else -1 end)[0])[0]"
        return f"filter(transform({grams}, g -> {found}), i -> i >= 0)"

    def logits_sql(self, places: str) -> str:
        sums = [f"aggregate({places}, {b!r}D, (a, i) -> a + get({constant(w, 'double')}, i))" for w, b in zip(self.weights, self.intercepts)]
        return f"array({', '.join(sums)})"

    def similarity_sql(self, places: str) -> str:
        """SQL of the best share of a template's n-grams held, by class (0 for the class of other text)."""
        rows = []
        for name in self.classes:
            shares = []
            for own in self.templates.get(name, []):
                inside = [1 if i in own else 0 for i in range(len(self.features))]
                shares.append(f"size(filter({places}, i -> get({constant(inside, 'int')}, i) = 1)) / {float(len(own))!r}D")
            rows.append(f"greatest(0D, {', '.join(shares)})" if shares else "0D")
        return f"array({', '.join(rows)})"


def rows_of(spark: SparkSession, rows, *names: str) -> DataFrame:
    """A small fixed table as constants of the plan."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def examples() -> list[tuple[str, str]]:
    """(class, text): templates, their spans of three words in five and more, the hard negatives and the near misses."""
    out = []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            for size in sorted({len(words), math.ceil(0.8 * len(words)), math.ceil(0.6 * len(words))}):
                for at in range(0, len(words) - size + 1, max(1, (len(words) - size) // 3)):
                    out.append((family, " ".join(words[at:at + size])))
    return sorted(set(out)) + [(OTHER, t) for t in HARD_NEGATIVES + NEAR_MISSES]


def fit(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit and calibrate; ``sample_docs`` documents of the corpus (smallest id hash) give paragraphs of other text."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    notices = rows_of(spark, [(f, t) for f, ts in {**TEMPLATES, OTHER: NEAR_MISSES}.items() for t in ts], "family", "line")
    own = notices.selectExpr("family", f"{grams_sql('line')} as grams", "line").collect()
    features = sorted({g for r in own for g in r.grams})
    templates = {f: [frozenset(features.index(g) for g in r.grams) for r in own if r.family == f] for f in TEMPLATES}
    hashes = [r.h for r in rows_of(spark, enumerate(features), "i", "g").selectExpr("i", "xxhash64(g) as h").orderBy("i").collect()]
    classes = [OTHER, *TEMPLATES]
    model = Model(features, hashes, classes, None, None, templates)

    number = {c: i for i, c in enumerate(classes)}
    given = rows_of(spark, [(number[c], t) for c, t in examples()], "label", "line")
    # thin by hash to about twice the sample first, so that what meets for the exact choice does not grow with the table
    own_docs = plain(docs, "doc_id", "text").filter("text is not null")
    share = min(1.0, (2 * sample_docs + 50) / max(1, own_docs.count()))
    thin = own_docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    first = thin.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    lines = first.select(F.explode(F.split("text", "\n", -1)).alias("line")).filter("not lower(line) rlike 'licen[cs]e|copyright|public domain|spdx'").distinct()
    both = given.unionByName(lines.selectExpr("0 as label", "line"))
    both = both.selectExpr("label", "line", f"{model.places_sql(grams_sql('line'))} as places")
    both = written(both.filter("label > 0 or size(places) > 0").withColumn("held", F.expr("pmod(xxhash64(line), 5) = 0 and label = 0 or pmod(xxhash64(line), 5) = 1 and label > 0")), "licence-examples")
    vector = F.expr(f"transform(sequence(0, {len(features) - 1}), i -> case when array_contains(places, i) then 1D else 0D end)")
    trained = both.filter("not held").select(F.col("label").cast("double").alias("label"), array_to_vector(vector).alias("features"))
    # rows of one partition in one order, so that every fit of the same rows gives the same weights (the rows are bounded)
    trained = trained.coalesce(1).sortWithinPartitions("label", F.xxhash64(F.col("features").cast("string")))
    fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, standardization=False).fit(trained)
    rows = fitted.coefficientMatrix.toArray()
    model.weights = [[round(float(x), 9) for x in row] for row in rows]
    model.intercepts = [round(float(x), 9) for x in fitted.interceptVector]

    judged = both.filter("held").selectExpr("label", f"{model.logits_sql('places')} as z")
    losses = [F.avg(F.expr(f"log(aggregate(z, 0D, (a, x) -> a + exp((x - array_max(z)) / {t}D))) - (get(z, label) - array_max(z)) / {t}D")).alias(str(i))
              for i, t in enumerate(TEMPERATURES)]
    row = judged.agg(*losses).first()
    if row[0] is not None:
        model.temperature = min(zip(row, TEMPERATURES))[1]
    return model


def scan(docs: DataFrame, model: Model, min_probability: float = MIN_PROBABILITY, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """One row per paragraph predicted to state a licence: ``doc_id, line_no, family, probability, similarity, confirmed``."""
    found = f"""filter(transform(split(text, '\\n', -1), (line, no) -> named_struct('no', no, 'places', {model.places_sql(grams_sql('line'))})), x -> size(x.places) > 0)"""
    lines = plain(docs, "doc_id", "text").select("doc_id", F.explode(F.expr(found)).alias("x")).select("doc_id", F.col("x.no").alias("line_no"), F.col("x.places").alias("places"))
    # explode over one computed struct again, so that the filter on it does not compute the scores twice
    judged = f"""transform(array({model.logits_sql('places')}), z -> transform(array(array_max(z)), top -> named_struct(
        'best', array_position(z, top) - 1,
        'probability', 1 / aggregate(z, 0D, (a, x) -> a + exp((x - top) / {model.temperature}D))))[0])"""
    scored = lines.select("*", F.explode(F.expr(judged)).alias("y")).filter(f"y.best > 0 and y.probability >= {min_probability}")
    names = F.array(*[F.lit(c) for c in model.classes])
    place = F.col("y.best").cast("int")
    out = scored.select("doc_id", "line_no", F.get(names, place).alias("family"), F.round("y.probability", 6).alias("probability"),
                        F.round(F.get(F.expr(model.similarity_sql("places")), place), 6).alias("similarity"))
    return out.withColumn("confirmed", F.col("similarity") >= min_similarity)


def scan_documents(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return scan(docs, fit(docs.sparkSession, docs, sample_docs))
