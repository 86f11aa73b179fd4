"""Templates against a plain containment, retrieval by bands, odd rows."""

import re

import numpy as np

from sparksift.llm import licenses

RNG = np.random.default_rng(9)


def plain(text):
    """Best containment of each template in any window as long, where it reaches 0.8."""
    cut = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    own, out = grams(cut(text)), {}
    for name, body in licenses.TEMPLATES:
        t = grams(cut(body))
        wanted = set(t)
        best = max((len(wanted & set(own[i : i + len(t)])) / len(wanted) for i in range(len(own))), default=0)
        if best >= 0.8:
            out[name] = round(best, 9)
    return out


def test_templates_by_force(spark):
    noise = lambda n: " ".join(f"w{x}" for x in RNG.integers(0, 500, n))
    texts = [None, "", "MIT", noise(50)]
    for _, body in licenses.TEMPLATES:
        w = body.split()
        texts.append(f"{noise(int(RNG.integers(0, 60)))} {body.upper()} {noise(int(RNG.integers(0, 60)))}")
        for k in (40, 15):  # words changed now and then
            texts.append(f"{noise(30)} " + " ".join("changed" if len(w) > 20 and i % k == 7 else x for i, x in enumerate(w)) + f" {noise(9)}")
    rows = licenses.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, license string, n int")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {})[r.license] = round(r.containment, 9)
    assert got == {i: found for i, t in enumerate(texts) if (found := plain(t))}
    assert {name for f in got.values() for name in f} == {name for name, _ in licenses.TEMPLATES}


def test_plan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange|Join", plan)
