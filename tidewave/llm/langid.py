"""Language identification of mixed text.

Each word (a run of letters) has a score for each language, the log probability of its letter
trigrams; its script leaves only the languages that use that script. Viterbi with a penalty for
switching labels the words, and runs of one label are the text's spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .textkit import Bytes, Letters, LetterWords, byte_view, letter_words, mix, portions

FEATURES = 1 << 15
UNKNOWN = "und"
#: What a switch of language within a text costs, in nats, and what a word costs in a language that does not use its script.
SWITCH, WRONG_SCRIPT = 15.0, 50.0
#: Words whose best ways are kept as values before they become steps back.
STEPS = 4096
#: A language uses a script that has this share of its letters' words.
SCRIPT_SHARE = 0.005
#: About so many training documents are taken of each language (by a hash of the key), as a bound.
PER_LANGUAGE = 5000


def features(w: LetterWords) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams (word ends count as a sign) of all words' letters, and where each word's begin."""
    lengths = w.ends - w.starts
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = np.repeat(w.starts - first, lengths) + np.arange(int(lengths.sum()))
    now = w.points[at].astype(np.uint64)
    before, after = np.empty_like(now), np.empty_like(now)
    before[1:], after[:-1] = now[:-1], now[1:]
    before[first], after[first + lengths - 1] = 0, 0
    return (mix((before << np.uint64(42)) | (now << np.uint64(21)) | after) & np.uint64(FEATURES - 1)).astype(np.int64), first


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # [language, feature] log probabilities
    allowed: np.ndarray  # [script, language]

    def scores(self, w: LetterWords) -> np.ndarray:
        """[word, language] log probabilities of the words."""
        out = np.zeros((len(w.starts), len(self.languages)))
        if len(w.starts):
            found, first = features(w)
            for k, row in enumerate(self.table):
                out[:, k] = np.add.reduceat(row[found], first)
            out -= WRONG_SCRIPT * ~self.allowed[w.scripts()]
        return out

    def labels(self, w: LetterWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language of each word, and the texts' first words and sums of scores."""
        scores = self.scores(w)
        first = np.searchsorted(w.rows, np.arange(w.n + 1))
        sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)])
        totals = sums[first[1:]] - sums[first[:-1]]
        best = totals.argmax(axis=1) if len(self.languages) else np.zeros(w.n, int)
        out = best[w.rows] if len(w.rows) else np.zeros(0, int)
        searched = np.flatnonzero(self.may_switch(scores, out, w.rows, first))
        viterbi(scores, first[searched], first[searched + 1], out)
        return out, first, totals

    def may_switch(self, scores: np.ndarray, label: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Texts where one label may not be the best path: some stretch gains more than half a switch in
        another language. Elsewhere r stretches in other languages gain at most r / 2 switches and cost r of
        them, or r - 1 (at least r / 2, from two on) if the label does not occur, so that it is best."""
        out = np.zeros(len(first) - 1, bool)
        if len(label):
            own = scores[np.arange(len(label)), label]
            for k in range(scores.shape[1]):
                gain = np.cumsum(scores[:, k] - own)
                before = np.concatenate([[0.0], gain[:-1]])
                far = 2 * (np.abs(gain).max() + 1) * rows  # a later text's values lie below all earlier ones
                rise = gain - far - np.minimum.accumulate(before - far)
                out[rows[rise > SWITCH / 2]] = True
        return out


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray, penalty: float = SWITCH) -> None:
    """Writes to ``out`` the labels with the greatest sum of scores less ``penalty`` a switch (ties: stay, then
    lowest) of each text, which has the rows from its start to its end of ``scores``.

    All texts go in step, the longest first, so that the texts with a word t are the first ones of them.
    """
    order = np.argsort(starts - ends, kind="stable")
    starts, lengths = starts[order], (ends - starts)[order]
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    if not len(starts):
        return
    shared = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts that have a word t
    steps = np.repeat(np.arange(lengths[0]), shared)
    places = [0, *np.cumsum(shared).tolist()]
    at = starts[np.arange(places[-1]) - np.repeat(places[:-1], shared)] + steps  # word by word, each text's row of scores
    back = np.empty((places[-1], scores.shape[1]), np.int16 if scores.shape[1] < 32768 else np.int32)
    value = scores[starts].copy()
    for a in range(1, lengths[0], STEPS):
        b = min(lengths[0], a + STEPS)
        first, part = places[a], scores[at[places[a] : places[b]]]
        seen = np.empty_like(part)
        for t in range(a, b):
            i, j = places[t] - first, places[t + 1] - first
            now = value[: j - i]
            seen[i:j] = now
            moved = now.max(axis=1, keepdims=True)
            moved -= penalty
            np.maximum(now, moved, out=now)
            now += part[i:j]
        top = seen.argmax(axis=1)[:, None]
        back[first : places[b]] = np.where(np.take_along_axis(seen, top, 1) - penalty > seen, top, np.arange(seen.shape[1]))
    label, rank = value.argmax(axis=1), np.arange(len(starts))
    path = np.empty(places[-1], back.dtype)
    for t in range(lengths[0] - 1, -1, -1):
        i, j = places[t], places[t + 1]
        path[i:j] = label[: j - i]
        if t:
            label[: j - i] = back[i:j][rank[: j - i], label[: j - i]]
    out[at] = path


def train(docs: DataFrame, chosen: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Counts of trigrams and scripts over a bounded sample of the labelled rows for which ``chosen`` holds.

    The sample takes about ``per_language`` texts of each language, those with the smallest hashes of
    the key; the counts come to the driver as one row for each language and feature (at most 2**15).
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(chosen) if chosen is not None else rows
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang).cast("string")).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, FEATURES)), np.zeros((len(Letters.NAMES), 0), bool))
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col(lang) == name, F.lit(min(1.0, per_language / sizes[name]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        grams = np.zeros((len(languages), FEATURES), np.int64)
        scripts = np.zeros((len(languages), len(Letters.NAMES)), np.int64)
        for whole in batches:
            for batch in portions(whole, "text"):
                w = letter_words(byte_view(batch.column(1)))
                if not len(w.starts):
                    continue
                label = np.array([number[x] for x in batch.column(0).to_pylist()])[w.rows]
                found, _ = features(w)
                np.add.at(scripts, (label, w.scripts()), 1)
                grams += np.bincount(np.repeat(label, w.ends - w.starts) * FEATURES + found, minlength=grams.size).reshape(grams.shape)
        for kind, table in ((0, grams), (1, scripts)):
            i, f = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), kind), pa.int32()), pa.array(i, pa.int32()), pa.array(f, pa.int32()), pa.array(table[i, f])], names=["kind", "lang", "feature", "n"])

    got = sample.mapInArrow(counted, "kind int, lang int, feature int, n long").groupBy("kind", "lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    grams, scripts = np.zeros((len(languages), FEATURES)), np.zeros((len(languages), len(Letters.NAMES)))
    for kind, table in ((0, grams), (1, scripts)):
        part = got[got.kind == kind]
        table[part.lang, part.feature] = part.n
    table = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * FEATURES))
    allowed = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T & (scripts.T > 0)
    allowed[~allowed.any(axis=1)] = True  # a script that no language uses tells nothing
    return Model(languages, table, allowed)


def judged(model: Model, view: Bytes, spans: bool = False, gain: bool = False) -> pd.DataFrame:
    """lang_pred, score and, if asked for, spans [(first letter, end, language)] of each text, and by how much
    the mean log probability of its trigrams in their words' languages is above that of chance."""
    w = letter_words(view)
    n, k = len(view), len(model.languages)
    pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
    out = pd.DataFrame({"lang_pred": pred, "score": score})
    if spans:
        out["spans"] = [[] for _ in range(n)]
    if gain:
        out["gain"] = 0.0
    if not k or not len(w.starts):
        return out
    label, first, totals = model.labels(w)
    letters = np.bincount(w.rows * k + label, w.ends - w.starts, n * k).reshape(n, k)
    some = letters.sum(axis=1) > 0
    best = letters.argmax(axis=1)
    shares = letters.max(axis=1) / np.maximum(1, letters.sum(axis=1))
    behind = (totals - totals[np.arange(n), best][:, None]) / np.sqrt(np.maximum(1, np.diff(first)))[:, None]
    sure = 1 / np.maximum(1, np.exp(np.minimum(0, behind)).sum(axis=1))
    out["lang_pred"] = np.where(some, np.array(model.languages, object)[best], UNKNOWN)
    out["score"] = np.where(some, shares * sure, 0.0)
    if gain:
        lengths = w.ends - w.starts
        found, _ = features(w)
        above = model.table[np.repeat(label, lengths), found] + np.log(FEATURES)
        out["gain"] = np.bincount(np.repeat(w.rows, lengths), above, n) / np.maximum(1, letters.sum(axis=1))
    if spans:
        heads = np.concatenate([[0], np.cumsum((view.data & 0xC0) != 0x80)])[view.offsets]
        new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (w.rows[1:] != w.rows[:-1])])
        last = np.r_[new[1:], len(label)] - 1
        for a, b in zip(new, last, strict=True):
            row = w.rows[a]
            out.at[row, "spans"].append({"start": int(w.starts[a] - heads[row]), "end": int(w.ends[b] - heads[row]), "lang": model.languages[label[a]]})
    return out


def language_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """The language of every text, a score from 0 to 1 and the spans of one language, in code points.

    lang_pred is the language with the most letters; score is its share of the letters times how far
    its likelihood leads. A text without letters (null, empty) is ``und`` with score 0 and no spans, as
    is every text where nothing was learned. Rows are judged alone; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "key long, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, "text"):
                got = judged(sent.value, byte_view(batch.column(1)), spans)
                kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[c].tolist(), t) for c, t in zip(got.columns, kinds, strict=False))], names=["key", *got.columns])

    out = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(labelled, schema)
    return out.withColumnRenamed("key", key)


def held_out(key: str = "doc_id", parts: int = 3) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == 1, F.lit(False))


def keep_known(docs: DataFrame, model: Model, least: float = 0.2, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least`` or more and
    is explained better than by chance: the letter trigrams are on average likelier in the languages of
    their words than one of ``FEATURES`` equally likely ones. Noise and unknown languages or scripts are not.
    Null texts and texts without letters go; an empty table stays empty. A model that learned no language
    is an error: it cannot tell what to keep."""
    if not model.languages:
        if docs.isEmpty():
            return docs
        raise ValueError("no language was learned: the corpus has no labelled text")
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, text):
                got = judged(sent.value, byte_view(batch.column(batch.schema.names.index(text))), gain=True)
                yield batch.filter(pa.array(((got.lang_pred != UNKNOWN) & (got.score >= least) & (got.gain > 0)).to_numpy()))

    return docs.mapInArrow(kept, docs.schema)
