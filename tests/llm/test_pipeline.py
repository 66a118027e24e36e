"""The pipeline and the language model against plain programs, on a small table with nulls, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, language_id, queries

EN = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass".split()


def text(seed, words, n):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "er", "s", "ing"]) for _ in range(n))


def letters(t):
    return re.findall("[^ ]+", "".join(c if c.isalpha() else " " for c in (t or "").lower()))


def brute_model(rows, orders=(4, 3, 2, 1)):
    """``predict(text)`` learned from ``(text, lang)``: words first, then the longest n-grams of which any is known."""
    languages = sorted({g for t, g in rows if t is not None and g is not None})
    counts = {k: {} for k in (0, *orders)}
    sizes = Counter()
    for t, g in rows:
        if t is None or g is None:
            continue
        sizes[g] += 1
        for w in letters(t):
            for k, parts in [(0, [w]), *((k, [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]) for k in orders)]:
                for p in parts:
                    counts[k].setdefault(p, Counter())[g] += 1
    logs = {}
    for k, table in counts.items():
        table = {p: c for p, c in table.items() if sum(c.values()) > 1}
        sums = {g: sum(c[g] + 0.5 for c in table.values()) for g in languages}
        logs[k] = {p: np.array([math.log((c[g] + 0.5) / sums[g]) for g in languages]) for p, c in table.items()}
    prior = np.log(np.array([sizes[g] for g in languages]) / sum(sizes.values()))

    def word(w):
        if w in logs[0]:
            return logs[0][w]
        for k in orders:
            if known := [logs[k][p] for i in range(len(w) + 3 - k) if (p := f"<{w}>"[i : i + k]) in logs[k]]:
                return np.mean(known, axis=0)
        return np.zeros(len(languages))

    def predict(t):
        w = letters(t)
        if not w or not languages:
            return "und", 0.0
        total = prior + sum(map(word, w))
        p = np.exp(total - total.max())
        return languages[int(p.argmax())], float(p.max() / p.sum())

    return predict


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(i, DE if i % 3 == 0 else EN, 40 + i), "de" if i % 3 == 0 else "en", f"s{i % 3}") for i in range(60)]
    out += [(100, out[4][1] + "  ", "en", "s1"), (101, out[4][1].replace(" ", "\n", 3), None, "s2"), (102, out[5][1] + " more", "en", "s0")]
    for n in range(6):
        w = out[6 + n][1].split()
        w[n] = "changed"
        out.append((110 + n, " ".join(w), "en", None))
    out += [(None, text(900, EN, 30), "en", "s0"), (None, text(901, DE, 30), None, "s0"), (7, text(902, EN, 55), "en", "s1"), (7, text(902, EN, 55), "en", "s1")]
    return out + [(200, None, "en", "s0"), (201, "", None, None), (202, " \t", "en", "s1"), (203, "12 ½ ② Ⅷ --", "en", "s1"), (204, text(903, EN, 6000), "en", "s2"), (205, "naïve½straße 日本", "de", "s2")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    return t.withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit(1), "row": F.lit("x"), "key": F.lit(2.0), "n": F.lit(3)})


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_scores(docs, rows):
    predict = brute_model([(t, g) for i, t, g, _ in rows if not held(i)])
    got = sorted(language_id.language_predictions(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.lang_pred, r.score))
    want = sorted(((i, held(i), *predict(t)) for i, t, _, _ in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[3]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.held_out, g.lang_pred) == w[:3] and g.score == pytest.approx(w[3], abs=1e-3)
    none = language_id.language_predictions(docs, words=None, per_order=None).collect()
    assert sorted(map(str, none)) == sorted(map(str, got))


def test_pipeline_equals_plain_programs(spark, docs, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        now = steps[name] = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert name == "byte_bpe" or now.columns == docs.columns
    rest = lambda name: Counter((r.doc_id, r.text, r.source) for r in steps[name].collect())

    predict = brute_model([(t, g) for i, t, g, _ in rows if not held(i)])
    left = [(i, t, s) for i, t, _, s in rows if (p := predict(t))[0] != "und" and p[1] >= 0.5]
    assert rest("language_id") == Counter(left)

    groups = {}
    for r in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    left = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0])) for g in groups.values()]
    assert rest("exact_dedup") == Counter(left)

    grams = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (r[1].lower().split() for r in left)]
    parent = list(range(len(left)))
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in range(len(left)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(left):
        groups.setdefault(find(i), []).append(r)
    left = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert rest("near_dedup") == Counter(left) and len(left) < len(grams)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/near_dedup.parquet/*.parquet')")
    taken = con.execute(queries.ORACLES["op6_mixing"]).fetchall()
    copies = Counter()
    for i, t, s in rest("mixing").elements():
        copies[i] += len(t.split())
    want = Counter()
    for r in taken:
        want[r[0]] += r[4]
    assert {k: v for k, v in copies.items() if v} == {k: v for k, v in want.items() if v}

    codec = byte_bpe.codec()
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in steps["byte_bpe"].collect())
    encode = lambda t: tuple(np.frombuffer(codec.encode(t), "<u4").tolist())
    assert got == Counter((i, encode(t), len(encode(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in rest("mixing").elements())


def test_pipeline_of_nothing(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
