"""Language identification: known words first, shorter and shorter character n-grams for the others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Letters, and numbers other than decimal digits, such as fractions and Roman numerals.
LETTERS = re.compile(r"[^\W\d_]+")
UND = "und"


def words_of(text: str) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [p for w in found for p in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


@dataclass
class LanguageModel:
    """``words`` and ``parts`` (n-grams by length) give rows of ``logs``, the log frequency by language."""

    languages: list[str]
    words: dict[str, int]
    parts: dict[int, dict[str, int]]
    logs: np.ndarray
    prior: np.ndarray

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: the mean over the longest n-grams of which any is known, else no preference."""
        rows, ends = [], []
        for word in words:
            word = f"<{word}>"
            for n, known in self.parts.items():
                if found := [r for i in range(len(word) - n + 1) if (r := known.get(word[i : i + n])) is not None]:
                    rows += found
                    break
            ends.append(len(rows))
        sizes = np.diff([0, *ends])
        out = np.zeros((len(words), len(self.languages)), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = np.array(ends)[some] - sizes[some]
            out[some] = np.add.reduceat(self.logs[rows], starts, axis=0) / sizes[some, None]
        return out


class Predictor:
    """Scores batches of texts; remembers up to ``memory`` words with their scores."""

    def __init__(self, model: LanguageModel, memory: int = 150_000):
        self.model, self.memory = model, memory
        self.forget()

    def forget(self) -> None:
        self.rows, self.scores = dict(self.model.words), self.model.logs[: len(self.model.words)]

    def predict(self, texts: list[str | None], step: int = 1 << 20) -> Iterator[tuple[str, float]]:
        i = 0
        while i < len(texts):
            part, size = [], 0
            while i < len(texts) and size < step:
                part.append(words_of(texts[i]) if texts[i] else [])
                size += len(texts[i] or "")
                i += 1
            yield from self.part(part)

    def part(self, texts: list[list[str]]) -> Iterator[tuple[str, float]]:
        m = self.model
        if not m.languages:
            yield from ((UND, 0.0) for _ in texts)
            return
        every = set().union(*texts)
        if len(self.rows) + len(every) > self.memory + len(m.words):
            self.forget()
        if new := [w for w in every if w not in self.rows]:
            self.rows.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, m.backed_off(new)))
        row = self.rows.__getitem__
        for words in texts:
            if not words:
                yield UND, 0.0
                continue
            total = m.prior + self.scores[np.fromiter(map(row, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            p = np.exp(total - total.max())
            best = int(p.argmax())
            yield m.languages[best], float(p[best] / p.sum())


def train(labelled: DataFrame, sample: int = 6_000, words: int | None = 50_000, per_order: int | None = 20_000, orders: tuple[int, ...] = (4, 3, 2, 1), smoothing: float = 0.5) -> LanguageModel:
    """A model from ``text`` and ``lang`` of the rows that have both.

    It is fitted on a sample of about ``sample`` documents, spread evenly over the languages (all rows of a
    language that has fewer), chosen by a hash of the text; each text is used whole. The model, which is broadcast, keeps up to
    ``words`` words and ``per_order`` n-grams of each order, the most frequent ones (None: all); what occurs once in the sample is not
    learned. A word beyond these is scored by its n-grams.
    """
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], {}, {}, np.zeros((0, 0), np.float32), np.zeros(0))
    share = {x: min(1.0, sample / len(languages) / sizes[x]) for x in languages}
    cut = F.coalesce(*[F.when(F.col("lang") == x, F.lit(int(share[x] * 2**31))) for x in languages])
    chosen = labelled.where(F.shiftrightunsigned(F.xxhash64("text"), 33) < cut)

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for lang, texts in x.groupby("lang").text:
                found: Counter = Counter()
                for t in texts:
                    found.update(words_of(t))
                parts: Counter = Counter()
                for word, n in found.items():
                    for k in orders:
                        for g in grams(word, k):
                            parts[k, g] += n
                yield pd.DataFrame({"lang": lang, "kind": 0, "part": list(found), "n": list(found.values())})
                yield pd.DataFrame({"lang": lang, "kind": [k for k, _ in parts], "part": [g for _, g in parts], "n": list(parts.values())})

    table = chosen.mapInPandas(counts, "lang string, kind int, part string, n long").groupBy("kind", "part", "lang").agg(F.sum("n").alias("n"))
    table = table.groupBy("kind", "part").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where("all > 1")
    table = written(table, "counts")
    rows, parts, logs = 0, {}, []
    for kind, most in [(0, words), *((k, per_order) for k in orders)]:
        top = table.where(F.col("kind") == kind).orderBy(F.desc("all"), "part")
        top = (top if most is None else top.limit(most)).select("part", *[F.coalesce(F.try_element_at("by", F.lit(x)), F.lit(0)).alias(f"n{i}") for i, x in enumerate(languages)]).toPandas()
        n = top.drop(columns="part").to_numpy(np.float64) + smoothing
        parts[kind] = {p: rows + i for i, p in enumerate(top.part)}
        rows += len(top)
        logs.append(np.log(n / n.sum(axis=0)) if len(n) else n)
    n = np.array([sizes[x] for x in languages], np.float64)
    return LanguageModel(languages, parts.pop(0), parts, np.concatenate(logs).astype(np.float32), np.log(n / n.sum()))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str | Column]) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``, the share of the likelihood that the language takes.

    Only the text is read. ``und`` with score 0: a null text, one without any letter, or a model without languages.
    Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Predictor(shared.value)
        for x in texts:
            yield pd.DataFrame(list(p.predict(x.tolist())), columns=["lang_pred", "score"])

    return docs.select(*keep, predict("text").alias("_tm_said")).select("*", "_tm_said.lang_pred", "_tm_said.score").drop("_tm_said")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def language_predictions(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; learned from the rows that are not held out."""
    model = train(docs.where(~held_out()), **options)
    return identify(docs, model, ["doc_id", held_out().alias("held_out")])


def keep_languages(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more, with all columns."""
    model = train(docs.where(~held_out()), **options)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_tm_doc")
    out = identify(docs, model, [whole]).where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return out.select("_tm_doc.*")

