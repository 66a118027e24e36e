"""SentencePiece encoding and decoding: the pieces that merging would leave, found by backtracking instead of merging.

A text's pieces are the one sequence in which every two neighbours would come out of merging as they are. So each place takes the
longest piece that an Aho-Corasick automaton found there and that agrees with the piece before it; where none does, the search goes
one piece back and marks the place as failed in a bit field, so that no place is tried twice.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .common import id_back, id_text

MODEL = "piece_bpe_32k.model"


class PieceCodec:
    """Encodes and decodes by a SentencePiece BPE model with byte fallback; ``memory``: how many runs of a text, twice at the most, and how
    many pairs of pieces are remembered."""

    def __init__(self, path: str | None = None, memory: int = 600_000):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        n = sp.get_piece_size()
        odd = [i for i in range(n) if sp.is_unused(i) or not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.id_to_piece(i))]
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if odd or len(self.bytes) != 256:
            raise ValueError("a BPE model without unused pieces and with all 256 byte pieces is needed")
        self.text_of = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        own, self.start = set(self.text_of.values()), n
        self.score = {p: sp.get_score(i) for i, p in self.text_of.items()}
        self.find = ahocorasick.Automaton()
        for i, p in self.text_of.items():
            self.find.add_word(p, (len(p), i))
        self.find.make_automaton()
        self.runs = re.compile(self.run_pattern(own)).findall
        self.memory, self.known, self.earlier, self.agree, self.agreed = memory, {}, {}, defaultdict(dict), 0
        self.ends = [pack("<I", i) for i in (sp.bos_id(), sp.eos_id())]

    @staticmethod
    def run_pattern(own: set[str]) -> str:
        """What a text is cut into before it is encoded: words, each with the marks before it, wherever no piece goes on over the end of a word; a
        control character that no piece has is cut out alone."""
        inside = {x for p in own for x in zip(p, p[1:])}
        word, marks = re.compile(r"[^\W_]").match, set()
        while more := {a for a, b in inside if word(a) and a not in marks and (b in marks or not word(b))}:
            marks |= more
        alone = "".join(re.escape(chr(i)) for i in range(1, 32) if not any(chr(i) in p for p in own))
        odd = re.escape("".join(sorted(marks)))
        mark, letter = f"(?:[^\\w{alone}]|[_{odd}])", f"[^\\W_{odd}]"
        return f"{mark}*{letter}+|{mark}+" + (f"|[{alone}]" if alone else "")

    def merged(self, text: str) -> list[str]:
        """``text`` by merging: of all neighbours the pair that makes the piece of the best score joins, the first of equals, until none does."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces ``left`` and ``right`` as they are, side by side; ``left`` is ``start`` at the start. A
        character without a piece (its code point follows ``start``) joins nothing."""
        if right > self.start:
            ok = True
        else:
            alone = [self.text_of[right]]
            pair = [self.text_of[left], *alone] if left < self.start else alone
            ok = self.merged("".join(pair)) == pair
        if self.agreed > self.memory:
            self.agree.clear()
            self.agreed = 0
        self.agree[left][right] = ok
        self.agreed += 1
        return ok

    def pieces(self, text: str) -> list[int]:
        """The ids of a normalised text's pieces; ``start`` and its code point for each character that no piece has."""
        n = len(text)
        fits = [None] * n  # the pieces that begin at a place, by length
        for end, fit in self.find.iter(text):
            start = end - fit[0] + 1
            if fits[start] is None:
                fits[start] = [fit]
            else:
                fits[start].append(fit)
        failed, failures = bytearray((n >> 3) + 1), False
        out, sizes, at, last = [], [], 0, self.start
        while at < n:
            todo, known = fits[at], self.agree[last]
            if todo is None:
                todo = fits[at] = [(1, self.start + 1 + ord(text[at]))]
            while todo:
                size, piece = todo.pop()
                to = at + size
                if failures and failed[to >> 3] >> (to & 7) & 1:
                    continue
                ok = known.get(piece)
                if self.compatible(last, piece) if ok is None else ok:
                    out.append(piece)
                    sizes.append(size)
                    at, last = to, piece
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                failures = True
                at -= sizes.pop()
                out.pop()
                last = out[-1] if out else self.start
        return out

    def ids_of(self, run: str) -> bytes:
        """The ids of a run, as little-endian 32-bit integers; a character without a piece gives the ids of its bytes."""
        ids = self.pieces(run)
        if max(ids) > self.start:
            ids = [j for i in ids for j in ([i] if i < self.start else map(self.bytes.__getitem__, chr(i - self.start - 1).encode()))]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` between begin and end ids, as little-endian 32-bit integers."""
        whole = self.library.normalize(text)
        known, earlier = self.known, self.earlier
        if len(known) > self.memory:
            self.known, self.earlier = known, earlier = {}, known
        out = [self.ends[0]]
        for r in self.runs(whole):
            ids = known.get(r)
            if ids is None:
                ids = earlier.get(r) or self.ids_of(r)
                if len(r) <= 64:
                    known[r] = ids
            out.append(ids)
        out.append(self.ends[1])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> PieceCodec:
    """One codec for each Python worker and file."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` for each row, with begin and end ids; a null text counts as empty and has just these two."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for x in frames:
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "ids": [np.frombuffer(c.encode(t or ""), "<i4") for t in x.text]})

    return id_back(id_text(docs, "text").mapInPandas(batches, "doc_id string, ids array<int>"))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for x in frames:
            texts = [None if i is None else c.decode(np.asarray(i, "<u4").tobytes()) for i in x.ids]
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "text": texts})

    return id_back(id_text(encoded, "ids").mapInPandas(batches, "doc_id string, text string"))


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row: encoded with begin and end ids, decoded again and digested in one pass.

    A null text counts as empty: two ids, and the digest of no text. Rows are independent of each other, so repeated rows and null or
    repeated ids are no special case; other columns are ignored.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for x in frames:
            ids = map(c.encode, (t or "" for t in x.text))
            out = [(len(i) // 4, sha(i), sha(c.decode(i).encode())) for i in ids]
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=x.doc_id.to_numpy(object))[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]]

    return id_back(id_text(docs, "text").mapInPandas(batches, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
