import random
import time

import pytest

from tidemark.llm import licenses


@pytest.fixture(scope="module")
def model():
    templates = {n: [x for x in t if len(licenses.tokens(x)) <= licenses.PASSAGE] for n, t in licenses.with_whole_texts().items()}
    return licenses.Templates(templates, {}, 100, 0.7)


def plain(model, words):
    """The best window at an anchor place, each window by itself."""
    places = {(max(0, at - before), n) for at, w in enumerate(words) if w in model.anchors for before, n in model.anchors[w]}
    found = [b for start, n in sorted(places) if (b := model.best(words[start : start + n]))]
    return max(found, key=lambda b: b[0], default=None)


def test_whole_licences_are_known_and_inherited(spark):
    texts = licenses.with_whole_texts()
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"]
    rows = [(i, f"{n}/LICENSE", f"Copyright 2024 Somebody\n\n{texts[n][-1]}") for i, n in enumerate(names)]
    rows += [(100 + i, f"{n}/src/deep/x.py", "some code") for i, n in enumerate(names)]
    rows += [(200, "half/LICENSE", texts["GPL-3.0"][-1][:18_000]), (201, "LICENSE", None), (202, None, texts["MPL-2.0"][-1]), (202, None, texts["MPL-2.0"][-1])]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(3)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    for i, n in enumerate(names):
        assert (got[i].license, got[i].kind) == (n, "file") and got[i].score > 0.95
        assert (got[100 + i].license, got[100 + i].kind, got[100 + i].licensed_by) == (n, "inherited", f"{n}/LICENSE")
    assert got[200].license == "GPL-3.0" and got[201].license is None and got[202].license == "MPL-2.0"


def test_sliding_windows_equal_each_by_itself(model):
    r = random.Random(4)
    short = [t for x in licenses.TEMPLATES.values() for t in x]
    vocabulary = sorted({w for t in short for w in licenses.tokens(t)})[::3] + ["other", "words", "here"]
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            piece = licenses.tokens(r.choice(short))
            piece = [w for w in piece if r.random() < 0.9]
            at = r.randrange(len(words) + 1)
            words[at:at] = piece * r.choice([1, 1, 3])
        want, got = plain(model, words), model.header(words)
        assert (want is None) == (got is None)
        assert want is None or got[0] == pytest.approx(want[0]) and (got[1] == want[1] or got[0] == pytest.approx(want[0], abs=1e-9))


def test_ties_between_templates_go_to_the_first():
    twice = licenses.Templates({"one": ["Licensed under the Sample License."], "two": ["Licensed under the Sample License."]}, {}, 9, 0.7)
    assert twice.header(licenses.tokens("x y licensed under the sample license z"))[1] == "one"


def test_a_long_text_of_licence_words(model):
    for text in ("the license and software notice " * 32_000, "Licensed under the MIT License. " * 32_000):
        words = licenses.tokens(text)
        began = time.process_time()
        found = model.header(words)
        assert time.process_time() - began < 20 and (found is None or found[1] == "MIT")
