"""The stage's groups: fingerprints first, then rounds in which one set leaves each band."""

import random

from tidemark.llm import components, near_copies, simhash
from tidemark.sources import shared


def test_fingerprints_and_rounds_give_the_groups_of_similarity(spark):
    r, texts, asked = random.Random(4), {}, []
    for i in range(6):
        w = [f"w{r.randrange(10_000)}" for _ in range(100)]
        for n in (0, 0, 1, 1, 1, 2, 3, 5, 12):
            v = list(w)
            for j in r.sample(range(len(v)), n):
                v[j] = f"o{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(v)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(96)} for i, t in texts.items()}
    group = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    linked = lambda prints: (asked.append(prints.count()), simhash.links(prints))[1]
    got = near_copies.near_groups(df, room=3, depth=1, fingerprint=simhash.fingerprint, linked=linked)
    assert {x.doc_id: x.component_id for x in got.collect()} == group and asked[0] > 1


def test_far_variants_do_not_meet_their_crowd(spark):
    """400 variants of one text: 250 of them similar to it, 150 so far that they are similar to none, and one pair of these to each other. Only that
    pair meets, although all share the text's shingles; sizes differ a little."""
    r = random.Random(9)
    base, sets = list(range(400)), {}
    for i in range(400):
        gone = r.sample(base, r.randrange(8, 20) if i < 250 else r.randrange(50, 110))
        new = [1_000 * (i + 1) + j for j in range(len(gone) - r.randrange(4))]
        sets[i] = sorted(set(base) - set(gone)) + new
    sets[400] = sets[399][:-2] + [999_998, 999_999]
    rows = spark.createDataFrame(list(sets.items()), "f long, grams array<long>")
    last = spark.createDataFrame([(1, f, len(g), 0 if f < 250 else f) for f, g in sets.items()], "cell long, f long, size long, root long")
    for room in (3, 48):
        met = {tuple(sorted((x.f, x.y.f))) for x in near_copies._rarest(last, rows, 0.8, room).collect()}
        assert (399, 400) in met and len(met) < 100
        assert met >= {(b, a) for a in range(250, 401) for b in range(a) if _similar(sets[a], sets[b])}


def _similar(a, b):
    a, b = set(a), set(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_few_links_are_followed_at_once_and_tables_go_early(spark, monkeypatch):
    r = random.Random(4)
    edges = [(r.randrange(-60, 60) * 10**16, r.randrange(-60, 60) * 10**16) for _ in range(90)] + [(7, 7), (1, 2), (2, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    few, many = ({x.node: x.root for x in near_copies._linked(df, n).collect()} for n in (100, 10))
    assert few == many and few[2] == 1 and 7 not in few and near_copies._linked(df.where("false")).count() == 0
    write, held = shared.written, []

    def counted(df, name="part"):
        out = write(df, name)
        held.append(sum(map(len, shared._scopes.open)))
        return out

    for module in (near_copies, simhash, components, shared):
        monkeypatch.setattr(module, "written", counted)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, texts[i % 12] + f" x{i // 12}") for i in range(36)], "doc_id long, text string")
    got = near_copies.near_groups(docs, room=3, fingerprint=simhash.fingerprint, linked=simhash.links).collect()
    assert all(x.component_id == x.doc_id % 12 for x in got) and max(held) <= 24, max(held)
