"""Removal of passages of a bounded reference, by matching statistics against broadcast suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text


class SuffixAutomaton:
    """The smallest automaton of all word sequences of some texts; ``step`` follows a document word by word."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def _state(self, size: int, link: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def add(self, words: list[bytes]) -> None:
        """Adds a text; sequences do not run on from one text into another."""
        self.last = 0
        for w in words:
            self.last = self._extend(self.last, w)

    def _extend(self, p: int, w: bytes) -> int:
        if (q := self.next[p].get(w)) is not None:
            return q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w)
        new = self._state(self.size[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: bytes) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list[bytes]) -> list[int]:
        """For each place the length of the longest sequence of the reference that ends there."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if (to := self.next[state].get(w)) is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def remove_reference(docs: DataFrame, reference: DataFrame, length: int = 20, shard_words: int = 200_000, most_words: int = 2_000_000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: words in maximal spans of ``length`` or more consecutive words that a text of ``reference``
    (column ``text``) has too are removed.

    The reference is cut into shards of whole texts of about ``shard_words`` words; a task builds the automaton of each, and all are
    broadcast, so a reference of over ``most_words`` words is refused. Documents stream through them and are never shuffled. Null texts have no words.
    """
    from pyspark.sql.functions import regexp_count

    words = reference.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("n", regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total > most_words:
        raise ValueError(f"a reference of {total} words is over {most_words}; use substring_dedup for a corpus")
    shards = -(-total // shard_words) or 1

    def build(x: pd.DataFrame) -> pd.DataFrame:
        import pickle

        a = SuffixAutomaton()
        for t in x.text:
            a.add(t.encode().split())
        return pd.DataFrame({"automaton": [pickle.dumps((a.next, a.link, a.size))]})

    built = words.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards))).groupBy("shard").applyInPandas(build, "automaton binary").collect()
    shared = docs.sparkSession.sparkContext.broadcast([bytes(r.automaton) for r in built])

    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        automata = []
        for b in shared.value:
            a = SuffixAutomaton()
            a.next, a.link, a.size = pickle.loads(b)
            automata.append(a)
        for x in frames:
            out = []
            for text in x.text:
                w = (text or "").encode().split()
                gone = bytearray(len(w))
                for a in automata:
                    for end, n in enumerate(a.statistics(w)):
                        if n >= length:
                            gone[end + 1 - n : end + 1] = b"\1" * n
                out.append((len(w), sum(gone), b" ".join([x for x, g in zip(w, gone, strict=True) if not g]).decode()))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept"]).assign(doc_id=x.doc_id.to_numpy(object))[["doc_id", "n_words", "n_removed", "kept"]]

    return id_back(id_text(docs, "text").mapInPandas(strip, "doc_id string, n_words long, n_removed long, kept string"))
