"""Language of whole texts, and of the spans of a mixed one.

A word's first letter names its script, and the script narrows the languages that the word may have to those that were seen
to use it.  Byte trigrams score each word in each language.  Viterbi's path over the words of a text pays a penalty for each switch, so that
a span changes its language only where enough words speak for it.

Trigram counts are learned from a bounded number of labelled texts; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasebeat.llm.common import text_of
from phasebeat.workspace import store

# Bound of the fit: labelled texts.
LABELLED = 6000
SLOTS = 1 << 16
PENALTY = 12.0
# A language uses a script if so large a part of its words begins in it.
LEAST_SHARE = 0.01
FOREIGN = -30.0
PIECE = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
# Marks beyond ASCII that stand next to words and are no part of them.
_MARKS = re.compile("[\u00a0-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3003\u3008-\u3020]")
_INSIDE = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def _scripts() -> np.ndarray:
    """Script of a character by its first byte in UTF-8; ranges of the Unicode blocks."""
    table = np.zeros(256, np.int8)
    for number, (low, high) in enumerate(
        # Latin extensions, Greek, Cyrillic, Armenian and Hebrew, Arabic and Syriac, Indic and Thai, Georgian to Ethiopic, kana, Han, Hangul
        [(0xC3, 0xCD), (0xCE, 0xCF), (0xD0, 0xD3), (0xD4, 0xD7), (0xD8, 0xDF), (0xE0, 0xE0), (0xE1, 0xE2), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED)]
    ):
        table[low : high + 1] = number
    return table


SCRIPT = _scripts()
N_SCRIPTS = int(SCRIPT.max()) + 1


@dataclass(frozen=True)
class Model:
    """Languages, log probabilities of trigrams per language, and which scripts each language uses."""

    languages: list[str]
    trigrams: np.ndarray
    uses: np.ndarray


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram that ends at each byte but the first two."""
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _cleaned(text: str) -> np.ndarray:
    """Lower-case bytes, all that is no letter as one kind of blank, blanks at both ends."""
    data = np.frombuffer((" " + _MARKS.sub(" ", text.lower()) + "  ").encode("utf-8", "replace"), np.uint8)
    return np.where(_INSIDE[data], data, np.uint8(32))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff((data != 32).astype(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def word_scores(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word in each language, and the words' lengths in bytes."""
    data = _cleaned(text)
    starts, ends = _words(data)
    scores = np.zeros((len(starts), len(model.languages)))
    at = 0
    while at < len(starts):  # long texts in pieces of whole words
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        low = starts[at] - 1
        codes = _trigrams(data[low : ends[stop - 1] + 1])
        sums = np.zeros((len(codes) + 1, scores.shape[1]))
        np.cumsum(model.trigrams[codes], axis=0, out=sums[1:])
        # Trigrams of a word: from the blank before it to the blank after it.
        scores[at:stop] = sums[ends[at:stop] - low - 1] - sums[starts[at:stop] - low - 1]
        at = stop
    fits = model.uses[SCRIPT[data[starts]]]
    known = fits.any(axis=1)
    scores[~known] = 0
    scores += np.where(fits | ~known[:, None], 0, FOREIGN)
    return scores, ends - starts


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path: word scores less the penalty of each switch."""
    n, n_languages = scores.shape
    if n == 0 or n_languages == 1:
        return np.zeros(n, np.int64)
    main = int(scores.sum(axis=0).argmax())
    # A run of other languages costs a switch or more.  If no run can gain that much, the path stays in one language.
    gain = np.cumsum((scores - scores[:, [main]]).max(axis=1, where=np.arange(n_languages) != main, initial=-np.inf))
    floor = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
    if (gain - floor).max() <= penalty:
        return np.full(n, main)
    back = np.empty((n, n_languages), np.int32)
    same = np.arange(n_languages)
    value = scores[0].copy()
    for t in range(1, n):
        top = int(value.argmax())
        switch = value[top] - penalty
        stay = value >= switch
        back[t] = np.where(stay, same, top)
        value = np.where(stay, value, switch) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = int(value.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def identify(text: str | None, model: Model | None) -> tuple[str, float, int]:
    """Language of most letters, its score, and the number of spans; ``und`` for a text without letters."""
    if not text or model is None or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
        return "und", 0.0, 0
    scores, sizes = word_scores(text, model)
    if not len(scores):
        return "und", 0.0, 0
    path = best_path(scores)
    by_language = np.bincount(path, weights=sizes, minlength=len(model.languages))
    top = int(by_language.argmax())
    inside = scores[path == top].sum(axis=0)
    certain = 1 / np.exp(np.clip(inside - inside[top], -500, 50)).sum()
    spans = 1 + int((path[1:] != path[:-1]).sum())
    return model.languages[top], float(by_language[top] / by_language.sum() * min(certain, 1.0)), spans


def id_remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = batch["lang"].to_pylist()
        for language in sorted(set(languages)):
            slots, scripts = np.zeros(SLOTS, np.int64), np.zeros(N_SCRIPTS, np.int64)
            for text, of in zip(batch["text"], languages, strict=True):
                if of == language:
                    data = _cleaned(text.as_py())
                    starts, _ = _words(data)
                    blank = data == 32
                    codes = _trigrams(data)[~blank[1:-1]]
                    slots += np.bincount(codes, minlength=SLOTS)
                    scripts += np.bincount(SCRIPT[data[starts]], minlength=N_SCRIPTS)
            both = np.concatenate([slots, scripts])
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(both[at])], ["lang", "slot", "n"])


def fit(labelled: DataFrame, limit: int = LABELLED) -> Model | None:
    """Model of ``doc_id, text, lang`` rows, at most ``limit`` ids of them; ``None`` if no row has a language."""
    known = labelled.where("lang is not null and text is not null")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded, so it may be broadcast
    same = known["doc_id"].eqNullSafe(F.broadcast(ids)["doc_id"])
    sample = store(known.join(F.broadcast(ids), same, "left_semi").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), "labelled")
    counts = sample.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counts.orderBy("lang", "slot").collect()  # at most the slots of each language
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    table = np.zeros((SLOTS + N_SCRIPTS, len(languages)))
    number = {name: k for k, name in enumerate(languages)}
    for r in rows:
        table[r["slot"], number[r["lang"]]] = r["n"]
    slots, scripts = table[:SLOTS], table[SLOTS:]
    smooth = slots + 0.1
    uses = scripts / np.maximum(scripts.sum(axis=0), 1) >= LEAST_SHARE
    return Model(languages, np.log(smooth / smooth.sum(axis=0)), uses)


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans`` of every row; null and letterless texts are ``und`` with score 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identify(t.as_py(), model) for t in batch["text"]]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.int32()), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "lang_pred", "score", "n_spans"])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {kind}, lang_pred string, score double, n_spans int")
