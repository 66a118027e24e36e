"""The numbered operators against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, byte_bpe, exact_dedup, language_id, licenses, mixing, quality, secrets, simhash, substring_dedup
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(seed, n, words="the of and to in a is that it for on was be with as by this cat dog house tree river stone".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [sentences(i, 60) for i in range(12)]
    out = [(i, t, "en", f"s{i % 3}", len(t), 1, 0.5) for i, t in enumerate(base)]
    out += [(20, base[0], "en", "s1", 1, 1, 0.5), (21, " ".join(base[0].split()) + " \n", "en", "s1", 1, 1, None), (22, base[1] + " extra", "en", None, 1, 1, 0.5)]
    out += [(30, None, None, "s2", None, 1, 0.5), (31, "", "en", "s2", 0, None, 0.5), (32, " \t\n", "en", "", 3, 1, 0.5), (33, "日本 é\x1c x", "fr", "s0", 1, 1, 0.5)]
    out += [(40, " ".join(base[2:6]) + "\n" + " ".join([base[7]] * 3), "en", "s0", 9, 1, 0.5), (None, base[8], "en", "s0", 1, 1, 0.5), (41, sentences(99, 8000), "en", "s1", 1, 1, 0.5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_dedup(docs, rows, empty):
    got, norm = table(exact_dedup.exact_dedup(docs)), {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    size, text = Counter(norm.values()), {r[0]: r[1] or "" for r in rows}
    for i, n in norm.items():
        keep = min((j for j in norm if norm[j] == n), key=lambda j: (-len(text[j]), j is None, j or 0))
        assert (got[i].keep_id, got[i].group_size, got[i].text_sha256) == (keep, size[n], hashlib.sha256(n.encode()).hexdigest())
        assert got[i].kept == (keep == i)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs.unionByName(docs))
    assert kept.columns == docs.columns and kept.count() == len(size)


def test_digest_index_of_several_batches(spark, docs, rows, tmp_path):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, buckets=4, path=path)
    index.add(docs, "first")
    later = spark.createDataFrame([(100, rows[0][1] + "  "), (101, "something new")], "doc_id long, text string")
    for _ in range(2):  # the second time is a retry
        got = table(index.add(later, "second"))
        assert (got[100].keep_id, got[100].kept, got[101].kept) == (21, False, True) and got[100].group_size == 4
    other = exact_dedup.DigestIndex(spark, buckets=4, path=path)  # as another session finds it
    got = table(other.add(spark.createDataFrame([(0, rows[0][1]), (1, "something  new"), (2, "")], "doc_id long, text string"), "third"))
    assert [(got[i].keep_id, got[i].kept, got[i].group_size) for i in range(3)] == [(21, False, 5), (101, False, 2), (32, False, 4)]
    got = table(other.add(docs, "first"))
    assert got[21].kept and got[21].group_size == 3
    assert other.groups().agg(F.sum("n")).first()[0] == len(rows) + 5
    index.drop()
    other.drop()


def test_anti_join_does_not_shuffle_the_index(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.add(docs, "first")
    best = docs.select(exact_dedup.digest_of(F.col("text")).alias("digest"))
    plan = best.join(index.groups(9).hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    index.drop()


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = table(simhash.simhash_groups(docs))
    for r in rows:
        assert int(got[r[0]].fingerprint, 16) == brute_print(r[1])
    assert got[30].component_id == got[31].component_id == got[32].component_id == 30
    assert simhash.simhash_groups(empty).count() == 0


def grouped(items, pairs):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


@pytest.mark.parametrize("room,bits", [(48, 1), (48, 2), (16, 2)])
def test_links_are_all_near_fingerprints(spark, room, bits):
    r = random.Random(5)
    f = {r.getrandbits(64) for _ in range(200)}
    for c in list(f)[:8]:
        for _ in range(25):
            c ^= 1 << r.randrange(64)
            f.add(c)
            f.add(c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    center = r.getrandbits(64)
    f |= {center ^ sum(1 << b for b in range(8) if i >> b & 1) << 8 * (i % 8) for i in range(256)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in f)
    df = spark.createDataFrame([(x,) for x in signed], "f long")
    found = simhash.links(df, bits, room)
    near = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    assert {(x.a, x.b) for x in found.collect()} == near
    got = {x.node: x.root for x in components(found).collect()}
    assert {x: got.get(x, x) for x in signed} == grouped(signed, near)


def test_simhash_components_of_documents(spark):
    r, rows = random.Random(9), [(900, None), (901, ""), (902, " \t")]
    for i in range(6):
        w = sentences(300 + i, 400).split()
        for _ in range(12):
            v = list(w)
            for _ in range(r.randrange(3)):
                v[r.randrange(len(v))] = f"w{r.randrange(99)}"
            rows.append((len(rows), " ".join(v)))
    rows += [(-5, rows[3][1]), (rows[3][0], rows[3][1])]
    prints = [(i, brute_print(t)) for i, t in rows]
    distinct = sorted({f for _, f in prints})
    root = grouped(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least = {f: min(i for i, g in prints if root[g] == root[f]) for f in distinct}
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((x.doc_id, int(x.fingerprint, 16), x.component_id) for x in got) == sorted((i, f, least[f]) for i, f in prints)
    assert len(set(least.values())) < len(distinct)


def test_drop_near_copies(docs):
    out = simhash.drop_near_copies(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {0, 1} and out.where("doc_id = 20 or doc_id is null").count() == 0
    other = docs.where("doc_id = 1").withColumn("text", F.lit("quite another text under the same id")).unionByName(docs.where("doc_id is null"))
    assert simhash.drop_near_copies(docs.unionByName(other)).count() == out.count() + 1  # the text without id is that of another document


@pytest.mark.parametrize("room", [48, 3])
def test_near_groups_follow_similarity(spark, room):
    from tidemark.llm.near_copies import near_groups

    r, texts = random.Random(11), {}
    for i in range(8):
        w = sentences(200 + i, 120).split()
        texts[len(texts)] = " ".join(w)
        for n in (1, 2, 3, 5, 9, 20) + ((1,) * 9 + (2,) * 5 if i < 2 else ()):
            v = list(w)
            for j in r.sample(range(len(v)), n):
                v[j] = f"other{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(v)
    texts |= {500: "a b c", 501: "A  b c", 502: "a b d", 503: "", 504: None}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    parent = {i: i for i in sets}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in near_groups(df, room=room).collect()} == {i: find(i) for i in sets}
    assert sorted(x.doc_id for x in simhash.drop_near_copies(df).collect()) == sorted({find(i) for i in sets})


def test_full_bands_of_texts_that_are_not_similar(spark):
    """Texts that share half their shingles fill bands without being similar; the pairs among them are still found."""
    from tidemark.llm.near_copies import near_groups

    common, texts = sentences(400, 150), {}
    for i in range(60):
        own = " ".join(f"x{i}y{j}" for j in range(60))
        texts[2 * i] = f"{common} {own}"
        texts[2 * i + 1] = f"{common} {own} more"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in near_groups(df, room=4, depth=3).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    c = byte_bpe.codec()
    e = tiktoken.Encoding("own", pat_str=byte_bpe.public_tokenizers.PATTERN, mergeable_ranks=(ranks := {c.decode_bytes(np.array([i], "<u4").tobytes()): i for i in c.text_of}), special_tokens={})
    got = table(byte_bpe.token_digests(docs, with_ids=True))
    for r in rows:
        ids = e.encode_ordinary(r[1] or "")
        assert got[r[0]].ids == ids and got[r[0]].n_tokens == len(ids)
        assert got[r[0]].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    back = table(byte_bpe.decode_documents(byte_bpe.encode_documents(docs)))
    assert all(back[r[0]].text == (r[1] or "") for r in rows)
    assert byte_bpe.token_digests(empty).count() == 0
    r = random.Random(2)
    for alphabet in ("ab", "aA1 .", "é日\U0001f600 a\n", "=-_ \t\n"):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(300)]
        assert [np.frombuffer(i, "<u4").tolist() for i in c.encode_batch(texts)] == [e.encode_ordinary(t) for t in texts]
    text = "naïve 日本 \U0001f600!"
    at, i, of = [n for n, x in enumerate(text) for _ in x.encode()], 0, {r: b for b, r in ranks.items()}
    for t, a, b in c.offsets(text):
        n = len(of[t])
        assert (a, b) == (at[i], at[i + n - 1] + 1)
        i += n
    assert i == len(at) and c.offsets("") == []
    placed = table(byte_bpe.encode_documents(docs, with_offsets=True))
    assert all(list(zip(placed[r[0]].ids, placed[r[0]].starts, placed[r[0]].ends, strict=True)) == c.offsets(r[1] or "") for r in rows)
    assert c.decode([i for i, _, _ in c.offsets(text)]) == text
    split = next(np.frombuffer(x, "<u4") for x in c.encode_batch(["\U0001f9ff"]))
    assert "�" in c.decode(split[:1]) and c.decode(split) == "\U0001f9ff"


def test_mixing(docs, rows, empty):
    got = mixing.mix_words(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_words(docs.repartition(3)).collect()))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source, target = {}, {}
    for r in rows:
        source[r[3]] = source.get(r[3], 0) + size[r[0]]
    left, open_, weight = 1.5 * sum(source.values()), set(source), {}
    for i, s in enumerate(sorted(source, key=lambda s: (s is None, s or ""))):
        weight[s] = (3, 1, 2)[i % 3]
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * source[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * source[s]
            left -= target[s]
        open_ -= over
    by = {r[0]: r[3] for r in rows}
    for g in got:
        assert g["size"] == size[g.doc_id] and g.source_size == source[by[g.doc_id]]
        assert g.target == pytest.approx(target[by[g.doc_id]]) and g.taken % max(1, g["size"]) == 0 and g.taken <= 2 * g["size"]
    assert mixing.mix_words(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    shared = docs.withColumn("doc_id", F.when(F.col("doc_id") > 5, F.lit(None)).otherwise(F.lit(1)).cast("long"))
    words = lambda df, n: {r.source: r.n or 0 for r in df.groupBy("source").agg(F.sum(n).alias("n")).collect()}
    many = words(mixing.mixed_documents(shared).withColumn("n", F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))), "n")
    taken = words(mixing.mix(shared).select(F.expr("if(key.z, null, key.s)").alias("source"), (F.col("copies") * F.col("size")).alias("n")), "n")
    assert {k: max(0, v) for k, v in many.items()} == {k: v for k, v in taken.items() if k in many}


def test_language_id(spark, docs, empty):
    de = "der die und ist das nicht ein auf mit sich von haus baum fluss stein katze".split()
    more = [(i, sentences(i, 40, de) if i % 2 else sentences(i, 40), "de" if i % 2 else "en") for i in range(200)]
    df = spark.createDataFrame([*more, (500, None, "en"), (501, "12 34 -- ½ ² Ⅷ ①", "en"), (502, "", None), (503, sentences(7, 9, de), None)], "doc_id long, text string, lang string")
    got = table(language_id.language_predictions(df))
    assert all(got[i].lang_pred == g for i, _, g in more) and got[503].lang_pred == "de"
    assert {got[i].lang_pred for i in (500, 501, 502)} == {"und"} and all(0 <= g.score <= 1 for g in got.values())
    assert {got[i].held_out for i in got if F} == {True, False}
    model = language_id.train(df)
    assert model.languages == ["de", "en"] and language_id.Predictor(model).model.backed_off(["katzeflussx"]).argmax() == 0
    assert {r.lang_pred for r in language_id.language_predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_predictions(empty).count() == 0
    assert language_id.keep_languages(docs).columns == docs.columns


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets(spark, docs, rows, empty):
    texts = ["PassWord: 'abcdefghijkl' and token=secret:abcdefghijklmnop", "é AKIA" + "A" * 14 + " AKIA12 日 " + "0123456789abcdef" * 2, "api_key==x api-key=yyyyyyyyyyyyyyy apikey = \"0f" + "a" * 20 + '"', None, "", "key hG7xQ2mZ9pLw4TvB8nRk3Ys6 in theordinaryidentifiernames_of_functions"]
    extra = [(900 + i, t, "en", "s", 1, 1, 0.1) for i, t in enumerate(texts)]
    df = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = table(secrets.secret_spans(df))
    for r in [*rows, *extra]:
        t = r[1] or ""
        s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
        g = got[r[0]]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == n for _, k, _ in s) for n in range(3))
        assert g.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(g.spans.split(","))
    assert got[905].spans == "markov:4:28"


def planted(seed, n=150):
    """``(text, is random)``: bare random strings, and identifiers of words."""
    r, words = random.Random(seed), "user name count index value parse token list file path open close read write buffer size table row column key order state".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    for alphabet in (letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/", letters + "0123456789", letters.upper() + "0123456789"):
        yield from (("".join(r.choice(alphabet) for _ in range(r.randrange(20, 45))), True) for _ in range(n))
    for form in (lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "_".join(w) + f"_{r.randrange(1000)}", lambda w: "/".join(w) + "/v2", lambda w: "-".join(w) + "-2024"):
        yield from ((form([r.choice(words) for _ in range(r.randrange(4, 6))]), False) for _ in range(n))


def test_markov_models_find_random_strings(spark):
    samples = spark.createDataFrame([(t if s or i % 2 else t.replace("_", "").replace("-", ""), s) for i, (t, s) in enumerate(planted(1))], "text string, secret boolean")
    strings = [(t, s) for t, s in planted(2) if len(t) >= 16]
    got = table(secrets.secret_spans(spark.createDataFrame([(i, f"see {t} here") for i, (t, _) in enumerate(strings)], "doc_id long, text string"), samples=samples))
    said = [got[i].spans == f"markov:4:{4 + len(t)}" for i, (t, _) in enumerate(strings)]
    hits = sum(a and s for a, (_, s) in zip(said, strings, strict=True))
    assert hits / sum(s for _, s in strings) > 0.98 and hits / sum(said) > 0.98


def test_likelihood_is_the_models(spark):
    samples, at = list(planted(3, 40)), {c: i for i, c in enumerate(secrets.ALPHABET)}
    k = len(at)
    counts = {True: np.zeros((k, k)), False: np.zeros((k, k))}
    for t, s in samples:
        for a, b in zip(t, t[1:], strict=False):
            counts[s][at[a], at[b]] += 1
    p = {s: (n + 20 / k) / (n.sum(axis=1, keepdims=True) + 20) for s, n in counts.items()}
    ratios = secrets.log_ratios(spark.createDataFrame(samples, "text string, secret boolean"))
    assert np.allclose(np.array(ratios).reshape(k, k), np.log(p[True] / p[False]))
    df = spark.createDataFrame([(t,) for t, _ in samples], "t string")
    for r in df.select("t", secrets.likelihood(F.col("t"), ratios).alias("l")).collect():
        assert r.l == pytest.approx(np.mean([np.log(p[True] / p[False])[at[a], at[b]] for a, b in zip(r.t, r.t[1:], strict=False)]), abs=1e-4)


def test_secrets_of_long_texts(spark):
    texts = ["a_" * 500_000, " ".join(f"{i:016x}" for i in range(64_000)), "token=abcdefghijklmnop " * 40_000, "x" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = table(secrets.secret_spans(df))
    assert [got[i].n_hex for i in range(4)] == [0, 64_000, 0, 0] and got[2].n_assign == 40_000 and time.time() - began < 60
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(64_000)).encode()).hexdigest()


def test_secrets_of_no_rows(empty):
    assert secrets.secret_spans(empty).count() == 0


def test_substring_dedup(spark, docs, rows, empty):
    more = [(60 + i, sentences(3, 50) + " " + sentences(70 + i, 10), "en", "s", 1, 1, 0.1) for i in range(5)]
    got = table(substring_dedup.repeats_removed(docs.unionByName(spark.createDataFrame(more, SCHEMA))))
    seen, all_rows = set(), sorted([*rows, *more], key=lambda r: (r[0] is None, r[0] or 0))
    for r in all_rows:
        w = WORD.findall(r[1] or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.repeats_removed(empty).count() == 0


def test_rolled_hashes():
    a = np.random.default_rng(1).integers(0, 2**63, 90).astype(np.uint64)
    for n in (1, 2, 5, 8, 20):
        h = substring_dedup.rolled(np.concatenate((a, a)), n)
        assert len(h) == 181 - n and (h[: 91 - n] == h[90:]).all() and len(set(h.tolist())) == 90


def test_ann(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(900, 12)).astype(np.float32)
    x[100:400] = x[100]  # one vector that a third of the rows share
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(1000, None, 1), (1050, [0.0] * 12, 1), (1100, [float("nan")] * 12, 1), (1150, [1.0, None] * 6, 1), (1200, [1.0] * 5, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int")
    got = ann.search(df, F.col("id") % 50 == 0, block=128, room=32).collect()
    d = x.astype(float)
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[q] = -9
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[i] - v) < 1e-12 for _, i, v in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        hits += len({m[1] for m in mine} & set(best.tolist()))
        total += 5
    assert hits / total >= 0.9 and len(got) == 18 * 5
    few = ann.search(df.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert sorted(g.vec_id for g in few) == [1, 2]
    assert ann.search(df.where("vec_id >= 1000 and vec_id < 1200"), F.col("id") % 50 == 0).count() == 0


def test_ann_of_repeated_rows(spark):
    x = np.random.default_rng(6).normal(size=(300, 8))
    one = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(one.unionByName(one), F.col("id") % 50 == 0, recall=1.0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        s = u @ u[q]
        s[q] = -9
        assert [g.vec_id for g in sorted(got, key=lambda g: g.rank) if g.query_id == q] == np.argsort(-s)[:5].tolist()
    assert len(got) == 30


def test_ann_of_ids_on_many_rows_and_hot_leaves(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 6))
    x[:400] = x[0] + r.normal(size=(400, 6)) * 1e-3  # a third and more in one place, asked by all
    df = spark.createDataFrame([(i % 300, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.lit(True), recall=1.0, block=64, group=16, room=32).collect()
    assert {g.query_id for g in got} == set(range(300)) and all(g.query_id != g.vec_id for g in got)
    assert ann.search(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_ann_writes_no_visits_and_takes_rounds(spark, monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(1500, 10))
    x[700:900], x[1200:1300] = x[700], x[1200] + r.normal(size=(100, 10)) * 1e-9  # equal vectors, and such as single precision does not tell apart
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tables, write = {}, ann.written
    monkeypatch.setattr(ann, "written", lambda df, name="part": tables.setdefault(name, []).append(df.count()) or write(df, name))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for options in ({}, {"numbers": 60, "share": 100, "block": 50, "group": 7}):
        got = ann.search(df, F.col("id") % 50 == 0, recall=1.0, room=16, **options).collect()
        assert len(got) == 150 and tables["asked"].pop() == 30  # a row for each query, not for each leaf that it visits
        for q in range(0, 1500, 50):
            s = u @ u[q]
            s[q] = -9
            mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
            assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[i] - v) < 1e-12 for _, i, v in mine)
            assert np.allclose([m[2] for m in mine], np.sort(s)[:-6:-1], rtol=0, atol=1e-12)
            if 700 <= q < 900:
                assert [m[1] for m in mine] == [i for i in range(700, 706) if i != q][:5]


def test_quality(spark, empty):
    good = [(i, sentences(i, 80), "en") for i in range(120)]
    bad = [(500 + i, " ".join(random.Random(i).choice("#$%&*XQZ") * 5 for _ in range(60)), "en") for i in range(5)]
    df = spark.createDataFrame([*good, *bad, (900, None, "en"), (901, " ", None), (902, sentences(3, 70), None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(500, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = table(quality.classify(df, labels))
    assert np.mean([got[i].keep for i in range(120)]) > 0.95 and not any(got[500 + i].keep for i in range(5))
    assert not got[900].keep and got[900].perplexity is None and not got[901].keep and got[902].keep
    assert quality.classify(empty, labels).count() == 0
    assert all(r.keep == (r.perplexity is not None or r.threshold is None) for r in quality.classify(df, labels.where("false")).collect())


def kneser_ney(texts, n):
    """An interpolated modified Kneser-Ney model worked out by dictionaries: the probability of a symbol after those before it."""
    counts = {n: Counter(tuple(a[i - n + 1 : i + 1]) for a in texts for i in range(n - 1, len(a)))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + 2 * of[2] else 0.5
        cuts[k] = [min(max(i - (i + 1) * y * of[i + 1] / of[i] if of[i] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]
    after = {k: {} for k in counts}
    for k, c in counts.items():
        for g, m in c.items():
            total, cut = after[k].get(g[:-1], (0, 0.0))
            after[k][g[:-1]] = (total + m, cut + cuts[k][min(m, 3) - 1])

    def p(context, x):
        k = len(context) + 1
        lower = 1 / (len(counts[1]) + 1) if k == 1 else p(context[1:], x)
        if context not in after[k]:
            return lower
        (total, cut), m = after[k][context], counts[k].get((*context, x), 0)
        return (m - cuts[k][min(m, 3) - 1] if m else 0.0) / total + cut / total * lower

    return p


@pytest.mark.parametrize("most", [3_000_000, 0])
def test_perplexity_is_kneser_neys(spark, most):
    trusted = {"en": [sentences(i, 25) for i in range(12)], "de": [sentences(50 + i, 20, "der die und straße größe weiß 日本".split()) for i in range(9)]}
    asked = [("en", sentences(77, 15)), ("en", "zzz the qq 日"), ("de", "die größe der straße 日本語"), ("de", "x"), ("en", sentences(78, 3000))]
    models = {g: kneser_ney([quality.symbols(t).tolist() for t in x], quality.ORDER) for g, x in trusted.items()}
    rows = quality.model_table(spark.createDataFrame([(g, t) for g, x in trusted.items() for t in x], "lang string, text string"))
    docs = spark.createDataFrame([(i, g, t, 1) for i, (g, t) in enumerate(asked)], "doc_id long, lang string, text string, row int").repartition(3)
    got = table(quality.perplexities(docs, rows, most))
    for i, (g, t) in enumerate(asked):
        a, n = quality.symbols(t).tolist(), quality.ORDER
        want = np.exp(-np.mean([np.log(models[g](tuple(a[j - n + 1 : j]), a[j])) for j in range(n - 1, len(a))]))
        assert got[i].perplexity == pytest.approx(want, rel=2e-6)


def test_quantiles_are_exact(spark):
    x = np.random.default_rng(3).normal(size=997)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)] + [("c", 5.0), ("d", None)], "g string, v double")
    got = {r.g: r["quantile"] for r in quality.quantiles(df, "v", 0.995, "g").collect()}
    assert got["c"] == 5.0 and got["a"] == pytest.approx(np.quantile([v for i, v in enumerate(x) if i % 3], 0.995)) and got["b"] == pytest.approx(np.quantile(x[::3], 0.995)) and len(got) == 3


def test_kneser_ney_sums_to_one(spark):
    model = quality.fitted(spark.createDataFrame([("en", sentences(i, 50)) for i in range(30)], "lang string, text string"))
    a = quality.symbols("the ca")
    known = [int(g) for g in model.tables["en"][1][0]]
    p = sum(float(np.exp(model.log_p(np.append(a, c), "en")[-1])) for c in known)
    assert p == pytest.approx(1 - 0, abs=0.02)


@pytest.mark.parametrize("most", [0, 150])
def test_quality_does_not_depend_on_what_is_broadcast(spark, most):
    good = [(i, sentences(i, 30 + i), "en" if i % 3 else "de") for i in range(30)]
    other = [(100, "Rare qq zz words, the cat", "en"), (101, "ünknown ßß tree", "fr"), (102, sentences(5, 9), None), (103, None, "en"), (104, " ", "de"), (None, "xx yy", "de"), (None, "the dog", "en")]
    df = spark.createDataFrame([*good, *other], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    rows = lambda **x: sorted(((r.doc_id or -1, r.lang, r.keep, r.perplexity, r.threshold) for r in quality.classify(df, labels, **x).collect()), key=str)
    whole, cut = rows(), rows(most=most)
    assert [x[:3] for x in whole] == [x[:3] for x in cut] and len(cut) == 37
    for x, y in zip(whole, cut, strict=True):
        assert x[3:] == pytest.approx(y[3:], rel=1e-9) if x[3] is not None else y[3] is None


def test_licenses(spark, empty):
    data = [
        (1, "r/LICENSE", "\n".join(licenses.TEMPLATES["MIT"][1:])), (2, "r/a/x.py", "code of some kind"), (3, "r/a/NOTICE", "Licensed under the Apache License,\nVersion 2.0."),
        (4, "r/a/b/y.py", "more code"), (5, "r/z.py", "/* This work is licensed under the GNU General Public License, version 3. */\n" + sentences(1, 100)), (6, "s/q.py", "nothing here"), (7, None, "Released under the MIT License.\n" + sentences(2, 50)), (8, "r/n.py", None),
    ]
    got = table(licenses.scan(spark.createDataFrame(data, "doc_id long, path string, text string")))
    assert {i: (g.license, g.kind) for i, g in got.items()} == {
        1: ("MIT", "file"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "file"), 4: ("Apache-2.0", "inherited"), 5: ("GPL-3.0", "header"), 6: (None, None), 7: ("MIT", "header"), 8: ("MIT", "inherited"),
    }
    assert got[4].licensed_by == "r/a/NOTICE" and got[8].licensed_by == "r/LICENSE"
    assert licenses.scan(empty.select("doc_id", "text", F.lit("p/q").alias("path"))).count() == 0


def test_license_scores_are_cosines(spark):
    """Against TF-IDF vectors worked out plainly: whole files, and passages inside a long line or wrapped over many."""
    import math

    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"][1]
    noise = sentences(5, 400)
    texts = [mit[3], mit[3].replace("software", "work"), f"var a={noise} {gpl} {noise}", gpl.replace(" ", "\n * "), f"{noise}", " ".join(gpl.split()[::2]), f"x | {mit[1]} | {noise}", "", "ümlaut 日本"]
    docs = [licenses.tokens(t) for t in texts]
    terms = {t for x in licenses.TEMPLATES.values() for y in x for t in licenses.tokens(y)}
    idf = lambda t: math.log((len(docs) + 1) / ((sum(t in d for d in docs) if t in terms else 0) + 1)) + 1

    def cosine(a, b):
        a, b = ({t: n * idf(t) for t, n in Counter(x).items()} for x in (a, b))
        size = lambda v: math.sqrt(sum(w * w for w in v.values()))
        return sum(w * b.get(t, 0) for t, w in a.items()) / (size(a) * size(b)) if a and b else 0.0

    every = [(name, licenses.tokens(y)) for name, x in licenses.TEMPLATES.items() for y in x]
    got = table(licenses.scan(spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")))
    for i, d in enumerate(docs):
        whole = max((cosine(d, t), -n) for n, (_, t) in enumerate(every))
        if whole[0] >= 0.7:
            assert got[i].kind == "file" and got[i].score == pytest.approx(whole[0]) and got[i].license == every[-whole[1]][0]
            continue
        parts = [(cosine(d[j : j + len(t)], t), name) for name, t in every for j in range(len(d))]
        best = max(parts, default=(0.0, ""))
        assert (got[i].kind == "header") == (best[0] >= 0.7)
        if got[i].kind:
            assert got[i].score <= best[0] + 1e-9 and got[i].score >= 0.7 and got[i].license in {n for c, n in parts if c >= 0.7}
    assert [got[i].license for i in (0, 2, 3, 6)] == ["MIT", "GPL-3.0", "GPL-3.0", "MIT"] and got[4].kind is None


def test_pipeline(spark, tmp_path, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter(r.doc_id for r in out.collect())
    assert got and 20 not in got and 30 not in got and max(got.values()) <= 2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_reference_removal(spark, docs, rows, empty):
    from tidemark.llm.suffix_automata import SuffixAutomaton, remove_reference

    reference = spark.createDataFrame([(sentences(3, 30) + " " + sentences(0, 60),), (sentences(1, 45),), (None,), ("short one",)], "text string")
    texts = [WORD.findall(r.text or "") for r in reference.collect()]
    known = {tuple(t[i : i + 20]) for t in texts for i in range(len(t) - 19)}
    for shard in (10, 200_000):
        got = table(remove_reference(docs, reference, 20, shard))
        for r in rows:
            w = WORD.findall(r[1] or "")
            gone = [False] * len(w)
            for j in range(len(w) - 19):
                if tuple(w[j : j + 20]) in known:
                    gone[j : j + 20] = [True] * 20
            assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert remove_reference(empty, reference).count() == 0 and remove_reference(docs, empty).agg(F.sum("n_removed")).first()[0] == 0
    with pytest.raises(ValueError):
        remove_reference(docs, reference, most_words=5)
    r = random.Random(8)
    a, text = SuffixAutomaton(), [[bytes([r.choice(b"ab")]) for _ in range(40)] for _ in range(3)]
    for t in text:
        a.add(t)
    probe = [bytes([r.choice(b"ab")]) for _ in range(60)]
    inside = lambda s: any(t[i : i + len(s)] == s for t in text for i in range(len(t)))
    assert a.statistics(probe) == [max(n for n in range(e + 2) if inside(probe[e + 1 - n : e + 1])) for e in range(60)]


@pytest.mark.parametrize("ids", [7, None])
def test_substring_dedup_of_many_equal_rows(spark, ids):
    text, late = sentences(11, 200), sentences(12, 30) + " " + sentences(11, 60)
    rows = [(ids, text)] * 20_000 + [(1 << 40, late), (9, text + " " + sentences(13, 40))]
    began = time.time()
    got = substring_dedup.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    took, words = time.time() - began, len(text.split())
    seen = {r.doc_id: (r.n_words, r.n_removed, r["count"]) for r in got}
    first, last = (9, ids) if ids is None else (ids, 9)
    assert len(got) == 3 and seen[first][1] == 0 and seen[last][1] == words
    assert seen[ids][::2] == (words, 20_000) and seen[1 << 40][1] == len(sentences(11, 60).split()) and took < 60


def test_substring_dedup_of_batches_without_a_new_row(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, text = spark.conf.get(name), sentences(11, 40)
    spark.conf.set(name, "10")
    try:
        rows = [(7, text)] * 100 + [(9, text)]
        got = substring_dedup.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    finally:
        spark.conf.set(name, before)
    words = len(text.split())
    assert sorted(tuple(r) for r in got) == [(7, words, 0, 100), (9, words, words, 1)]
