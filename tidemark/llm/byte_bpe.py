"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import id_back, id_text

RANKS = "byte_bpe_multi_50k.tiktoken"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next of those from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that make a token, by the rank of what they make: whichever of them meets first in a text, it joins."""
    return [(t[:i], t[i:]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


class ByteCodec:
    """Encodes and decodes by the ranks of a file in tiktoken's form; pieces are the matches of ``pattern``."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN, memory: int = 200_000):
        with open(path or public_tokenizers.path(RANKS), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        chars = byte_characters()
        text = lambda t: "".join(map(chars.__getitem__, t))
        self.text_of = {r: text(t) for t, r in ranks.items()}
        self.map, self.back = {i: c for i, c in enumerate(chars)}, {ord(c): i for i, c in enumerate(chars)}
        self.model = Tokenizer(BPE(vocab={text(t): r for t, r in ranks.items()}, merges=[(text(a), text(b)) for a, b in merges_of(ranks)], ignore_merges=True))
        self.find = regex.compile(pattern).findall
        self.finditer = regex.compile(pattern).finditer
        self.memory, self.known = memory, {}

    def said(self, pieces: list[str]):
        """The library's encoding of pieces: each byte is a character, so its offsets count bytes inside a piece."""
        mapped = [p.encode().decode("latin-1").translate(self.map) for p in pieces]
        return self.model.encode(mapped, is_pretokenized=True, add_special_tokens=False)

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, as little-endian 32-bit integers: their bytes, as characters, go through the library in one call."""
        said = self.said(pieces)
        ids, ends = np.array(said.ids, "<u4").tobytes(), np.searchsorted(np.array(said.word_ids, np.int64), np.arange(1, len(pieces) + 1)) * 4
        start = 0
        for p, end in zip(pieces, ends.tolist(), strict=True):
            self.known[p] = ids[start:end]
            start = end

    def encode_batch(self, texts: list[str], step: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text; new pieces are gathered over about ``step`` characters of texts at a time."""
        i = 0
        while i < len(texts):
            found, size = [], 0
            while i < len(texts) and size < step:
                found.append(self.find(texts[i]))
                size += len(texts[i])
                i += 1
            every = set().union(*found)
            if len(self.known) + len(every) > self.memory:
                self.known.clear()
            if new := [p for p in every if p not in self.known]:
                self.learn(new)
            known = self.known.__getitem__
            for pieces in found:
                yield b"".join(map(known, pieces))

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """``(id, start, end)`` of each token, in code points; a token that holds a part of a character spans all of it."""
        found = list(self.finditer(text))
        said = self.said([m[0] for m in found])
        at = [[m.start() + i for i, c in enumerate(m[0]) for _ in c.encode()] for m in found]
        return [(t, at[w][a], at[w][b - 1] + 1) for t, w, (a, b) in zip(said.ids, said.word_ids, said.offsets, strict=True)]

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes of ``ids``: the tokens' characters through the byte table in reverse."""
        return "".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).translate(self.back).encode("latin-1")

    def decode(self, ids) -> str:
        """The text of ``ids``; parts of characters that miss the rest become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, "<u4").tobytes()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> ByteCodec:
    """One codec for each Python worker and file, on one thread: the cores belong to other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteCodec(path)


def encode_documents(docs: DataFrame, path: str | None = None, with_offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` for each row; a null text has no ids. ``with_offsets`` adds ``starts, ends``, the place of each token in code points."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for x in frames:
            texts = [t or "" for t in x.text]
            if with_offsets:
                parts = [np.array(c.offsets(t), np.int32).reshape(-1, 3).T for t in texts]
                out = {"ids": [p[0] for p in parts], "starts": [p[1] for p in parts], "ends": [p[2] for p in parts]}
            else:
                out = {"ids": [np.frombuffer(i, "<u4").astype(np.int32) for i in c.encode_batch(texts)]}
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object)} | out)

    return id_back(id_text(docs, "text").mapInPandas(batches, "doc_id string, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets))


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for x in frames:
            yield pd.DataFrame({"doc_id": x.doc_id.to_numpy(object), "text": [None if i is None else c.decode(i) for i in x.ids]})

    return id_back(id_text(encoded, "ids").mapInPandas(batches, "doc_id string, text string"))


def token_digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row: encoded, decoded again, digested in one pass.

    A null text counts as empty: no tokens, and the digest of no bytes twice. Rows are independent of each other. ``with_ids`` adds the ids themselves.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for x in frames:
            out = [(len(i) // 4, sha(i), sha(c.decode_bytes(i)), np.frombuffer(i, "<i4") if with_ids else None) for i in c.encode_batch([t or "" for t in x.text])]
            yield pd.DataFrame(out, columns=names).assign(doc_id=x.doc_id.to_numpy(object))[["doc_id", *names[: 3 + with_ids]]]

    return id_back(id_text(docs, "text").mapInPandas(batches, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids))
