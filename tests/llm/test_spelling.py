import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling as sp


def apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least=6, often=5, times=5):
    words = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in words.items() if n >= often and len(w) >= least}
    near = {w: [x for x in words if apart(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= times * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()), key=str)


def variants(rng, words, letters="abcdeé"):
    out = list(words)
    for w in words:
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            out.append(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]))
    return out


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 10))) for _ in range(60)]
    words += ["running", "runing", "runnning", "ruNning", "Éclair", "éclair", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcdefghijk", "bcdefghijk", "zbcdefghijk"]
    return variants(rng, words) + ["prefixed" + w for w in variants(rng, words[:40])]


def test_pairs_of_the_composition_are_all_pairs(vocabulary):
    words = sorted(set(vocabulary))
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if apart(a, b)}
    got = [tuple(sorted(p)) for p in sp.near_pairs(words)]
    assert len(got) == len(set(got)) and set(got) == want
    assert sp.near_pairs([]) == sp.near_pairs(["one"]) == []


def test_acceptor_is_minimal_and_numbers_words(vocabulary):
    words = sorted(set(vocabulary))
    a = sp.Acceptor(words)
    states = {(f, *arcs.items()) for f, arcs in zip(a.final, a.arcs, strict=True)}
    assert len(states) == len(a.arcs) and a.size[-1] == len(words)


@pytest.mark.parametrize("room", [4, 8_000])
def test_near_words_meet_once_whatever_the_buckets(spark, vocabulary, room):
    words = sorted({w for w in vocabulary if len(w) >= 6})
    near = sp.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), room=room).collect()
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if apart(a, b)}
    got = [tuple(sorted((r.a, r.b))) for r in near]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(words[r.m] == r.a and words[r.n] == r.b for r in near)


def test_forms_and_roots_equal_plain(spark, vocabulary):
    rng = random.Random(4)
    rows = [(None, "nothing nothing Nothing nothing nothing", "x", 1), (1, None, "x", 1), (2, "", "x", 1)]
    pool = [w for w in vocabulary for _ in range(rng.choice([1, 1, 2, 5, 30, 200]))]
    rng.shuffle(pool)
    for i in range(0, len(pool), 300):
        rows.append((i if i % 7 else None, rng.choice([" ", "-", "1 ", "\n"]).join(w if rng.random() < 0.8 else w.upper() for w in pool[i : i + 300]), "x", 1))
    rows += [(9, "longish" * 3000, "x", 1)] * 6 + [(10, "longish" * 3000 + "x", "x", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(map(tuple, sp.spelling_forms(docs, room=20).collect()), key=str)
    assert got == plain(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain


def test_ties_go_to_the_first_word(spark):
    rows = [(1, "abcdefg " * 5 + "abcdefx " * 30 + "abcdefa " * 30, "x", 1)]
    got = {r.word: r.form for r in sp.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string, word string, n int")).collect()}
    assert got == {r[0]: r[1] for r in plain(rows)}


def test_empty_table(spark):
    assert sp.spelling_forms(spark.createDataFrame([], "doc_id long, text string")).count() == 0
