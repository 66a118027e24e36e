"""Groups of spelling variants: words one edit apart, found by composing the vocabulary's acceptor with a one-edit transducer and itself."""

from __future__ import annotations

import os.path
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"[A-Za-zÀ-ÿ]"


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct words; each state knows how many words it accepts, so a word is its place
    among them (from 0). A state's number is larger than those of all states after it."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, dict]] = [(False, {})]  # open states along the last word

        def close(depth: int, word: str) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                    self.size.append(final + sum(self.size[t] for t in arcs.values()))
                path[-1][1][word[len(path) - 1]] = state

        last = ""
        for w in words:
            shared, most = 0, min(len(w), len(last))
            while shared < most and w[shared] == last[shared]:
                shared += 1
            close(shared, last)
            path.extend((False, {}) for _ in range(len(w) - shared))
            path[-1] = (True, path[-1][1])
            last = w
        close(0, last)
        final, arcs = path[0]
        self.arcs.append(arcs)
        self.final.append(final)
        self.size.append(final + sum(self.size[t] for t in arcs.values()))

    def offsets(self, state: int) -> dict[str, tuple[int, int]]:
        """For each symbol the next state, and how many of the state's words come before those that go there."""
        out, before = {}, int(self.final[state])
        for c, t in self.arcs[state].items():
            out[c] = (t, before)
            before += self.size[t]
        return out


class Composition:
    """Acceptor, one-edit transducer, acceptor: a state is a pair of the acceptor's, equal before the edit, any two after it."""

    def __init__(self, words: list[str]):
        self.a = Acceptor(words)
        self.next = [self.a.offsets(s) for s in range(len(self.a.arcs))]
        self.met: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def both(self, p: int, q: int) -> list[tuple[int, int]]:
        """The words that two states both accept, as their places in each."""
        met, nexts, final = self.met, self.next, self.a.final
        if (p, q) in met:
            return met[p, q]
        todo, seen = [(p, q)], []
        while todo:
            pair = todo.pop()
            if pair in met:
                continue
            met[pair] = []
            if pair[0] == pair[1]:
                met[pair] = [(i, i) for i in range(self.a.size[pair[0]])]
                continue
            seen.append(pair)
            x, y = nexts[pair[0]], nexts[pair[1]]
            todo.extend((x[c][0], y[c][0]) for c in x if c in y)
        for s, t in sorted(seen, key=sum):  # what comes after a pair has smaller numbers
            x, y = nexts[s], nexts[t]
            out = [(0, 0)] if final[s] and final[t] else []
            for c, (to, i) in x.items():
                if c in y:
                    other, j = y[c]
                    found = met[to, other]
                    out = out + [(a + i, b + j) for a, b in found] if i or j or out else found
            met[s, t] = out
        return met[p, q]

    def pairs(self) -> list[tuple[int, int]]:
        """All accepted pairs: the places of words exactly one inserted, deleted or replaced symbol apart, each pair once."""
        one: list[list[tuple[int, int]]] = []
        final = self.a.final
        for s, arcs in enumerate(self.next):
            out: list[tuple[int, int]] = []
            for c, (t, i) in arcs.items():  # no edit yet
                later = one[t]
                out = out + [(a + i, b + i) for a, b in later] if i or out else later
            out, items = list(out) if len(arcs) == 1 else out, list(arcs.items())
            for n, (c, (t, i)) in enumerate(items):
                for d, (u, j) in items[n + 1 :]:  # c replaced by d
                    out += [(a + i, b + j) for a, b in self.both(t, u)]
                # c inserted: before another symbol or at the end, so that of a run of equal symbols the last is the new one
                if final[s] and final[t]:
                    out.append((0, i))
                after = self.next[t]
                for d, (u, j) in items:
                    if d != c and d in after:
                        v, k = after[d]
                        out += [(a + j, b + i + k) for a, b in self.both(u, v)]
            one.append(out if out else _NONE)
        return one[-1]


_NONE: list[tuple[int, int]] = []


def near_pairs(words: Iterable[str]) -> list[tuple[str, str]]:
    """All pairs of distinct words that differ by exactly one edit, each once."""
    ordered = sorted(set(words))
    if len(ordered) < 2:
        return []
    cut = len(os.path.commonprefix([ordered[0], ordered[-1]]))
    return [(ordered[a], ordered[b]) for a, b in Composition([w[cut:] for w in ordered]).pairs()]


def vocabulary(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased, of ``least`` code points and ``often`` occurrences or more, with their number.

    Where ``every`` divides the CRC-32 of ``<doc_id>:<run>``, the run's code point at that number modulo its length is left out first. A null text
    has no runs; a null ``doc_id`` is an empty one.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= often) & (F.char_length("word") >= least))


def _enumerated(rows: DataFrame, bound: bool) -> DataFrame:
    """``a, m, b, n``: the pairs that the composition of each bucket ``at`` accepts (``m``, ``n``: how often ``a`` and ``b`` occur).

    Rows come sorted by bucket, and one bucket at a time is in memory. With ``bound`` only pairs that have a word of ``tail`` 0 and no common beginning
    of ``reach`` code points.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def close(held: list[tuple]) -> None:
            if len(held) < 2:
                return
            n_of = {w: (n, tail, reach) for w, n, tail, reach in held}
            if bound and all(tail for _, tail, _ in n_of.values()):
                return
            for a, b in near_pairs(n_of):
                (m, s, reach), (n, t, _) = n_of[a], n_of[b]
                if not bound or not (s and t) and a[:reach] != b[:reach]:
                    out.append((a, m, b, n))

        now, held = None, []
        for x in frames:
            for at, *row in zip(x["at"], x.word, x.n, x["tail"], x.reach, strict=True):
                if at != now:
                    close(held)
                    now, held = at, []
                held.append(tuple(row))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["a", "m", "b", "n"])
                    out.clear()
        close(held)
        if out:
            yield pd.DataFrame(out, columns=["a", "m", "b", "n"])

    dealt = rows.select("at", "word", "n", "tail", "reach").repartition("at").sortWithinPartitions("at")
    return dealt.mapInPandas(batches, "a string, m long, b string, n long")


def near_words(words: DataFrame, first: int = 3, step: int = 2, room: int = 8_000) -> DataFrame:
    """``a, m, b, n``: all pairs of words (``word, n``, no word twice, of more than ``first`` code points) one edit apart, each once.

    The composition is enumerated by its first states: words that begin with the same ``first`` code points meet in one bucket, which holds every pair
    whose edit comes later. A pair whose edit comes within them goes on alike behind the edit: it meets in a bucket of that ending, of words
    that differ in their first ``first`` code points (one more for the longer word). A bucket of over ``room`` words with one
    beginning is cut in the same way by its next ``step`` code points, so none grows with the vocabulary; one ending holds as many words as
    there are beginnings of ``first`` + 1 letters at most. Levels are added while a beginning has too many words.
    """
    rows, out, from_, to = words.select("word", "n"), None, 0, first
    while True:
        size, begin = F.char_length("word"), F.substring("word", 1, to)
        rest = lambda i: F.substring("word", F.lit(i + 1), F.greatest(size - i, F.lit(0)))
        key = lambda i: F.xxhash64(F.lit(from_), F.substring("word", 1, from_), rest(i))
        hole = F.array(F.struct(key(to).alias("at"), F.lit(0).alias("tail")), F.struct(key(to + 1).alias("at"), F.lit(1).alias("tail")))
        ends = rows.select("word", "n", F.explode(hole).alias("x")).select("word", "n", "x.at", "x.tail", F.lit(to).alias("reach")).where((F.col("tail") == 0) | (size > to))
        begun = written(rows.select("word", "n", F.xxhash64(F.lit(-to), begin).alias("at"), F.lit(0).alias("tail"), F.lit(to).alias("reach")), "begun")
        full = begun.groupBy("at").agg(F.count("*").alias("_n")).where(F.col("_n") > room).select("at")  # one for each ``room`` words at most
        found = _enumerated(ends, True).unionByName(_enumerated(begun.join(F.broadcast(full), "at", "left_anti"), False))
        out = found if out is None else out.unionByName(found)
        rows = begun.join(F.broadcast(full), "at", "left_semi").select("word", "n")
        if rows.isEmpty():
            return written(out, "near")
        from_, to = to, to + step


def spelling_forms(docs: DataFrame, times: int = 5, room: int = 8_000, **vocabulary_options) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of :func:`vocabulary`.

    ``n_near``: number of words one edit away. ``form``: that of them that occurs most (of equals the first in code-point order), if it occurs
    ``times`` times as often or more; ``root``: where the forms lead to. Every step multiplies the number, so forms make no circles and chains
    are short. Repeated rows count each time; other columns are ignored; an empty table has no words.
    """
    words = written(vocabulary(docs, **vocabulary_options), "words")
    near = near_words(words, room=room)
    sides = near.unionByName(near.select(F.col("b").alias("a"), F.col("n").alias("m"), F.col("a").alias("b"), F.col("m").alias("n")))
    best = sides.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("best"))
    known = words.join(best, words.word == best.a, "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= times * F.col("n"), F.col("best")).alias("best"))
    known = written(known.select("word", F.col("best.b").alias("form"), "n", "n_near", (-F.col("best.n")).alias("form_n")), "forms")
    steps = known.where("form is not null").select(F.col("word").alias("root"), F.col("form").alias("next"))
    led, done = known.where("form is not null").select("word", F.col("form").alias("root")), None
    while not led.isEmpty():
        now = written(led.join(steps, "root", "left"), "led")
        ended = now.where("next is null").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        led = now.where("next is not null").select("word", F.col("next").alias("root"))
    out = known if done is None else known.join(done, "word", "left")
    return out.select("word", "form", (F.coalesce("root", "word") if done is not None else F.col("word")).alias("root"), "n", "n_near", "form_n")
