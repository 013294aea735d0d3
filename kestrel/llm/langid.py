"""Language ID: words first, then progressively shorter character n-grams.

The model is fitted by DataFrame operations on a bounded sample of labelled rows (``sample`` documents of each
language, smallest id hash first) and kept bounded (``vocabulary`` words and ``grams`` n-grams of each order and
language).  A known word scores its log frequency in each language.  For an unseen word, each place scores
the longest known n-gram that starts there (four characters down to one, word edges included), each divided
by its length so that a character counts about once.  A document's score is the posterior of the best
language under a uniform prior.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if no labelled
row was learned from; ties go to the language first in alphabetical order; a null id counts as the empty
text in the split; other columns are ignored; repeated rows give repeated results; an empty table gives no rows; a very long text
is a slice of its own, at some tens of bytes a character.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kestrel.llm.shared import plain, ship, shipped, written
from kestrel.llm.text import LETTER, HashTable, Powers, class_table, code_points, lower_table, mix, prefix, slices, span_hash

SAMPLE = 2000
VOCABULARY = 20000
GRAMS = 20000
LONGEST = 4
LANGUAGES = 1000  # more labels than this are an error, not a larger model
SMOOTH = 0.5
UNKNOWN = "und"


def remainder(doc_id):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def top(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent terms of each key; counts of the sample only, so the groups are bounded."""
    order = Window.partitionBy(*keys).orderBy(F.desc("c"), "term")
    return counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).drop("r")


def fit(labelled: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, grams: int = GRAMS) -> Model:
    """Learn from ``doc_id, text, lang`` rows (null text or lang: ignored)."""
    rows = plain(labelled, "doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return Model([], [], [])
    # thin by hash to about twice the sample first, so that no group of the exact choice below grows with the table
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2 * sample + 50) / n))]), F.col("lang"))
    rank = F.xxhash64("doc_id")
    thin = rows.withColumn("h", rank).filter(F.pmod(F.col("h"), F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    chosen = thin.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample)
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    words = written(words.groupBy("lang", "term").agg(F.count("*").alias("c")), "language-words")
    padded = F.concat(F.lit(" "), "term", F.lit(" "))
    parts = []
    for n in range(1, LONGEST + 1):
        places = F.when(F.length("padded") >= n, F.sequence(F.lit(1), F.length("padded") - n + 1))
        parts.append(words.withColumn("padded", padded).select("lang", "c", "padded", F.explode(places).alias("at")).select(
            "lang", F.lit(n).alias("n"), F.col("padded").substr(F.col("at"), F.lit(n)).alias("term"), "c"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pieces = every.groupBy("lang", "n", "term").agg(F.sum("c").alias("c"))
    word_rows = [(r.lang, r.term, r.c) for r in top(words, ["lang"], vocabulary).collect()]
    gram_rows = [(r.lang, r.n, r.term, r.c) for r in top(pieces, ["lang", "n"], grams).collect()]
    return Model(sorted(sizes), word_rows, gram_rows)


class Model:
    """Log frequencies by language, as arrays behind hash tables."""

    def __init__(self, languages, word_rows, gram_rows):
        self.languages, self.powers = languages, Powers()
        place = {lang: i for i, lang in enumerate(languages)}
        self.words = self._table([(place[lang], t, c) for lang, t, c in word_rows])
        self.grams = [self._table([(place[lang], t, c) for lang, n, t, c in gram_rows if n == k]) for k in range(1, LONGEST + 1)]
        self.classes, self.lower = class_table(), lower_table()
        self.kept = None
        self.powers = Powers()

    def _table(self, rows):
        terms = sorted({t for _, t, _ in rows})
        at = {t: i for i, t in enumerate(terms)}
        counts = np.zeros((len(terms), len(self.languages)))
        for lang, t, c in rows:
            counts[at[t], lang] = c
        table = HashTable()
        if terms:
            cps, offs = code_points(terms)
            table.insert(self.hashes(self.prefix(cps), offs[:-1], offs[1:] - 1), np.arange(len(terms)))
        total = counts.sum(axis=0) + SMOOTH * len(terms)
        return table, np.log((counts + SMOOTH) / np.maximum(total, 1e-300)) if terms else counts

    def prefix(self, cps):
        return prefix(mix(cps.astype(np.uint64) + np.uint64(11)), self.powers)

    def hashes(self, pre, starts, ends):
        return mix(span_hash(pre, starts, ends, self.powers) + (ends - starts).astype(np.uint64))

    def scores(self, words: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
        """Score of each (lower-case) word by language: log frequency, or n-grams where it is unseen.  ``known`` takes the
        share of each word that is evidence: 1 for a known word, else of its places with a known n-gram of two characters or more."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        padded = np.full(int(lens.sum() + 2 * len(words)), 0x20, np.uint32)
        first = np.cumsum(lens + 2) - lens - 2
        body = np.ones(len(padded), bool)
        body[first] = body[first + lens + 1] = False
        padded[body] = np.concatenate(words)
        pre = self.prefix(padded)
        out = np.zeros((len(words), len(self.languages)))
        table, logs = self.words
        row = table.find(self.hashes(pre, first + 1, first + 1 + lens))
        out[row >= 0] = logs[row[row >= 0]]
        if known is not None:
            known[:] = row >= 0
        unseen = np.flatnonzero(row < 0)
        if not len(unseen):
            return out
        size = lens[unseen] + 2
        owner = np.repeat(unseen, size)
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(first[unseen], size)
        end = np.repeat((first + lens + 2)[unseen], size)
        for n in range(LONGEST, 0, -1):
            fits = at + n <= end
            table, logs = self.grams[n - 1]
            row = np.full(len(at), -1, np.int64)
            row[fits] = table.find(self.hashes(pre, at[fits], at[fits] + n))
            hit = row >= 0
            if known is not None and n > 1:
                known += np.bincount(owner[hit], minlength=len(words)) / (lens + 1)
            for lang in range(len(self.languages)):
                out[:, lang] += np.bincount(owner[hit], weights=logs[row[hit], lang] / n, minlength=len(words))
            owner, at, end = owner[~hit], at[~hit], end[~hit]
        return out

    def reader(self) -> Reader:
        if self.kept is None:
            self.kept = Reader(self)
        return self.kept


class Reader:
    """Predicts lists of texts; the scores of words met before in the worker are cached."""

    CACHE = 1 << 18

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self):
        self.table, self.n = HashTable(16), 0
        self.rows = np.zeros((1 << 14, len(self.model.languages) + 1))  # the last column: how much of the word is known

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, its posterior, and the share of the text's letters that known words and n-grams cover."""
        model = self.model
        cps, offs = code_points(texts)
        letter = model.classes[cps] == LETTER
        letter[offs[1:] - 1] = False
        low = model.lower[cps]
        edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        names, best, share = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not len(starts) or not model.languages:
            return names, best, share
        if self.n > self.CACHE:
            self._empty()
        keys = model.hashes(model.prefix(low), starts, ends)
        word = self.table.find(keys)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            known = np.zeros(len(at))
            rows = np.concatenate([model.scores([low[s:e] for s, e in zip(starts[at], ends[at])], known), known[:, None]], axis=1)
            while self.n + len(rows) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n:self.n + len(rows)] = rows
            self.table.insert(fresh, np.arange(self.n, self.n + len(rows)))
            self.n += len(rows)
            word[new] = self.table.find(keys[new])
        owner = np.searchsorted(offs, starts, side="right") - 1
        total = np.stack([np.bincount(owner, weights=self.rows[word, i], minlength=len(texts)) for i in range(len(model.languages))], axis=1)
        post = np.exp(total - total.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        first = post.argmax(axis=1)
        letters = np.bincount(owner, weights=ends - starts, minlength=len(texts))
        covered = np.bincount(owner, weights=self.rows[word, -1] * (ends - starts), minlength=len(texts))
        for i in np.unique(owner):
            names[i], best[i], share[i] = model.languages[first[i]], float(post[i, first[i]]), float(covered[i] / letters[i])
        return names, best, share


def _predicted(batches, broadcast):
    reader = shipped(broadcast).reader()
    for part in slices(batches, "text"):
        found = reader.predict([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
        own = [part.column(i) for i in range(part.num_columns)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(found[0]), *[pa.array(x, pa.float64()) for x in found[1:]]], names=[*part.schema.names, "lang_pred", "score", "known"])


def predict(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns`` (``text`` among them, none of the new names) of every row, with ``lang_pred``, ``score`` and ``known``; nothing is
    shuffled."""
    broadcast = ship(docs.sparkSession, model)
    rows = plain(docs, *columns)
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known", DoubleType())]
    return rows.mapInArrow(lambda it: _predicted(it, broadcast), StructType([*rows.schema.fields, *new]))


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """Learn from the rows that are not held out and predict all: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs.filter(remainder(F.col("doc_id")) != 1), **bounds)
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
