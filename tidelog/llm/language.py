"""Language identification: scripts narrow the candidates, Viterbi labels the words, spans make the document."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_SLICE_BYTES, held_out, slices, word_table

UNDETERMINED = "und"
# Labelled documents learned from (at most, in expectation), hashed letter sequences, their lengths.
TRAINING_ROWS, BUCKETS, ORDERS = 20_000, 1 << 15, (1, 2, 3, 4)
# Price of a change of language between two words, in units of log-likelihood.
SWITCH = 12.0
# A language is a candidate for a script if it has at least this share of its learned letters in it.
SCRIPT_SHARE = 0.01
FOREIGN = -50.0
# Distinct words a model remembers the scores of.
WORDS_KEPT = 200_000
# Viterbi runs over so many texts side by side.
SIDE_BY_SIDE = 256

# First code points of the ranges in which letters belong to one script (fixed values, from the Unicode blocks).
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = [start for start, _ in SCRIPT_STARTS]
_NUMBERS = [SCRIPTS.index(name) for _, name in SCRIPT_STARTS]


def _letters(word: str) -> str:
    return "".join(filter(str.isalpha, word.lower()))


def _script(word: str) -> int:
    return _NUMBERS[bisect_right(_STARTS, ord(word[0])) - 1]


def _grams(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed letter sequences of words with their ends marked: ``(buckets, words)`` for each length, words ascending."""
    points = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    found, value = [], np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            break
        value = value[:n] * np.uint64(0x100000001B3) + points[order - 1 :] + np.uint64(order)
        inside = word[:n] == word[order - 1 :]
        if order in ORDERS:
            mixed = value[inside] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 15)
            found.append((mixed.astype(np.int64), word[:n][inside]))
    return found


class Model:
    """Log-likelihoods of letter sequences by language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, weights: np.ndarray):
        self.langs = langs
        self.table = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).T.copy()
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.spoken = (share >= SCRIPT_SHARE).T  # script x language
        self.spoken[~self.spoken.any(axis=1)] = True
        self.prior = np.log((weights + 1) / (weights + 1).sum())

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For distinct words: a score per language, and the number of letters. Words seen before are remembered."""
        known = self.__dict__.setdefault("known", {})
        if len(known) + len(words) > WORDS_KEPT:
            known.clear()
        if not known:
            self.kept = [np.zeros((0, len(self.langs))), np.zeros(0, np.int64)]
        new = [w for w in words if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self.kept = [np.concatenate(pair) for pair in zip(self.kept, self._scored(new))]
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return self.kept[0][at], self.kept[1][at]

    def forget(self) -> None:
        """Drops the remembered words: a worker lives on after its task."""
        self.__dict__.pop("known", None)
        self.__dict__.pop("kept", None)

    def _scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [_letters(w) for w in words]
        size = np.array([len(p) for p in plain], np.int64)
        scores = np.zeros((len(words), len(self.langs)))
        rows = np.flatnonzero(size)
        if len(rows):
            own = [plain[i] for i in rows]
            found = np.zeros((len(own), len(self.langs)))
            for buckets, owners in _grams(own):
                firsts = np.flatnonzero(np.concatenate(([True], np.diff(owners) != 0)))
                found[owners[firsts]] += np.add.reduceat(self.table[buckets], firsts, axis=0)
            spoken = self.spoken[[_script(w) for w in own]]
            best = np.where(spoken, found, -np.inf).max(axis=1, keepdims=True)
            scores[rows] = np.where(spoken, found - best, FOREIGN)
        return scores, size

    def spans(self, scores: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The language of each word: the best path with ``SWITCH`` off for each change.

        Most texts have one language. Leaving a text's best language for a run
        of words gains at most the run's sum of differences to the best other
        language, and costs one switch or more; a path that begins in another
        language also gains what its prior is higher. If no run gains that
        much, the best path is the constant one. Only the other texts are searched.
        """
        n_texts, lengths = len(offsets) - 1, np.diff(offsets)
        if not len(scores):
            return np.zeros(0, np.int64)
        total = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)))
        best = (total[offsets[1:]] - total[offsets[:-1]] + self.prior).argmax(axis=1)
        labels = np.repeat(best, lengths)
        if scores.shape[1] == 1:
            return labels
        own = scores[np.arange(len(scores)), labels]
        others = scores.copy()
        others[np.arange(len(scores)), labels] = -np.inf
        gain = np.concatenate(([0.0], np.cumsum(others.max(axis=1) - own)))
        text = np.repeat(np.arange(n_texts), lengths)
        # The least sum before each word within its text: texts lie on falling steps, so a running minimum starts anew in each.
        step = np.abs(gain).max() * 2 + 1
        least = np.minimum.accumulate(gain[:-1] - step * text) + step * text
        runs = np.full(n_texts, -np.inf)
        np.maximum.at(runs, text, gain[1:] - least)
        mixed = np.flatnonzero(runs > SWITCH - (self.prior.max() - self.prior[best]))
        mixed = mixed[np.argsort(lengths[mixed], kind="stable")]
        for at in range(0, len(mixed), SIDE_BY_SIDE):
            self._viterbi(scores, offsets, mixed[at : at + SIDE_BY_SIDE], labels)
        return labels

    def _viterbi(self, scores: np.ndarray, offsets: np.ndarray, texts: np.ndarray, labels: np.ndarray) -> None:
        """Best paths of texts sorted by length, step by step over those that are long enough."""
        starts, lengths = offsets[texts], offsets[texts + 1] - offsets[texts]
        longest, n = int(lengths[-1]), len(self.langs)
        value = self.prior + scores[starts]
        came = np.zeros((longest, len(texts), n), np.int8)
        for t in range(1, longest):
            on = slice(int(np.searchsorted(lengths, t, side="right")), None)
            before = value[on]
            top = before.argmax(axis=1)
            jump = before[np.arange(len(top)), top] - SWITCH
            switched = jump[:, None] > before
            came[t, on] = np.where(switched, top[:, None], np.arange(n))
            value[on] = np.where(switched, jump[:, None], before) + scores[starts[on] + t]
        state = value.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            on = np.arange(int(np.searchsorted(lengths, t, side="right")), len(texts))
            labels[starts[on] + t] = state[on]
            state[on] = came[t, on, state[on]]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[tuple[str, int, int]]]]:
        """Per text: language, score, and spans ``(language, first word, words)``."""
        codes, offsets, words = word_table(texts)
        scores, size = self.words(words)
        labels = self.spans(scores[codes], offsets)
        letters, n = size[codes], len(self.langs)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        held = np.bincount(text * n + labels, letters, (len(offsets) - 1) * n).reshape(-1, n)
        total, best = held.sum(axis=1), held.argmax(axis=1)
        mine = labels == best[text]
        others = scores[codes].copy()
        others[np.arange(len(codes)), labels] = -np.inf
        margin = scores[codes][np.arange(len(codes)), labels] - others.max(axis=1) if n > 1 else np.full(len(codes), 50.0)
        sure = np.bincount(text[mine], margin[mine], len(total)) / np.maximum(1, np.bincount(text[mine], None, len(total)))
        score = held[np.arange(len(total)), best] / np.maximum(1, total) / (1 + np.exp(-np.clip(sure, -50, 50)))
        langs = [self.langs[b] if t else UNDETERMINED for b, t in zip(best, total)]
        turns = np.flatnonzero(np.concatenate(([True], (np.diff(labels) != 0) | (np.diff(text) != 0)))) if len(labels) else np.zeros(0, np.int64)
        spans: list[list[tuple[str, int, int]]] = [[] for _ in langs]
        for start, stop in zip(turns.tolist(), [*turns[1:].tolist(), len(labels)]):
            spans[text[start]].append((self.langs[labels[start]], start - int(offsets[text[start]]), stop - start))
        return langs, np.where(total > 0, score, 0.0), spans


def learn(docs: DataFrame, usable: Column, most: int = TRAINING_ROWS) -> Model:
    """A model from the rows of ``docs`` (``doc_id``, ``text``, ``lang``) that are usable and have a language.

    Learns from a sample of about ``most`` documents, chosen by a hash of the
    id. The driver receives counts only: one number per language and bucket.
    Without a usable row the model knows no language and everything is ``und``.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    parts = 1 << 20
    there = rows.count()
    if there > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(parts)) < parts * most // there)

    def count(batches):
        grams, scripts, docs_of = {}, {}, {}
        for part in slices(batches, "text", WORD_SLICE_BYTES):
            codes, offsets, words = word_table(part.column("text"))
            plain = [_letters(w) for w in words]
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i, x in enumerate(langs) if x == lang])
                docs_of[lang] = docs_of.get(lang, 0) + langs.count(lang)
                used = [(plain[c], n) for c, n in zip(*np.unique(mine, return_counts=True)) if plain[c]]
                if used:
                    times = np.array([n for _, n in used], float)
                    for buckets, owners in _grams([w for w, _ in used]):
                        grams[lang] = grams.get(lang, 0) + np.bincount(buckets, times[owners], BUCKETS)
                    letters = np.array([len(w) for w, _ in used]) * times
                    scripts[lang] = scripts.get(lang, 0) + np.bincount([_script(w) for w, _ in used], letters, len(SCRIPTS))
        for kind, counts in ((0, grams), (1, scripts), (2, {k: np.array([n]) for k, n in docs_of.items()})):
            for lang, values in counts.items():
                at = np.flatnonzero(values)
                arrays = [pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at.astype(np.int64)), pa.array(values[at].astype(float))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "kind", "at", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, kind int, at long, n double")
    found = counted.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(found["lang"].unique())
    shape = {0: BUCKETS, 1: len(SCRIPTS), 2: 1}
    tables = {kind: np.zeros((len(langs), width)) for kind, width in shape.items()}
    for kind, part in found.groupby("kind"):
        tables[kind][part["lang"].map(langs.index), part["at"]] = part["n"]
    return Model(langs, tables[0], tables[1], tables[2][:, 0])


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """``row`` (a struct with a ``text``) of every row, with ``lang_pred, score, spans``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    spans_kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = batch.column("row").field("text")
            plain = pa.RecordBatch.from_arrays([batch.column("row"), texts], ["row", "text"])
            for part in slices([plain], "text", WORD_SLICE_BYTES):
                if shared.value.langs:
                    langs, score, spans = shared.value.predict(part.column("text"))
                else:
                    langs, score, spans = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows), [[]] * part.num_rows
                named = [[{"lang": x, "first": a, "words": n} for x, a, n in s] for s in spans]
                arrays = [part.column("row"), pa.array(langs, pa.string()), pa.array(score), pa.array(named, spans_kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "lang_pred", "score", "spans"])
        shared.value.forget()

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double, spans array<struct<lang:string,first:long,words:long>>")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Words without letters take the language around them. ``lang_pred`` is the
    language with most letters, ``score`` its share of the letters times the
    mean certainty of its words. A null text and a text without a letter are
    ``und`` with score 0 (and so is every text if no language was learned).
    ``spans`` are ``(lang, first word, words)`` over the white-space separated
    words. Repeated rows and null ids are kept as they come.
    """
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _predicted(docs.select(row.alias("row")), model).select("row.doc_id", "lang_pred", "score", "spans")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` (whose ``text`` is a string) with ``lang_pred, score, spans``, which replace columns of these names."""
    added = ["lang_pred", "score", "spans"]
    row = F.struct(*(c for c in docs.columns if c not in added))
    return _predicted(docs.select(row.alias("row")), model).select("row.*", *added)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows that are not held out, applied to all."""
    found = identify(docs, learn(docs, ~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
