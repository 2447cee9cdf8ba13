"""The line field: marginals against enumeration, features, held-out accuracy, odd rows."""

import itertools

import numpy as np
import pytest

from propgraph.llm import line_crf, queries


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_marginals_by_enumeration(n):
    rng = np.random.default_rng(n)
    emit, trans = rng.normal(0, 2, (n, 2)), rng.normal(0, 2, (2, 2))
    first = rng.random(n) < 0.3
    first[0] = True
    total, own, pair = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(emit[t, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n) if not first[t]))
        total += w
        for t in range(n):
            own[t, y[t]] += w
            if t:
                pair[t, y[t - 1], y[t]] += w
    found, pairs = line_crf.marginals(emit, trans, first)
    assert np.allclose(found, own / total) and np.allclose(pairs[1:], pair[1:] / total)


def test_long_chain_is_that_of_its_parts():
    """Chains laid end to end do not see each other, however long."""
    rng = np.random.default_rng(5)
    emit, trans, cut = rng.normal(0, 3, (20_000, 2)), rng.normal(0, 2, (2, 2)), 12_345
    first = np.zeros(len(emit), bool)
    first[[0, cut]] = True
    whole = line_crf.marginals(emit, trans, first)[0]
    parts = [line_crf.marginals(e, trans, np.arange(len(e)) == 0)[0] for e in (emit[:cut], emit[cut:])]
    assert np.allclose(whole, np.concatenate(parts)) and np.isfinite(whole).all()


def test_features_are_per_text():
    """A line's features are its own and its neighbours' in the same text, whatever stands beside it in a batch."""
    texts = ["One line.\n\nOne line.\nOne line.", "", "AB CD!! ef ef\n12 | 3\n", "\n\n", "x\ud800 y z \U0001f600"]
    x, sizes, counts = line_crf.features(texts)
    assert counts.tolist() == [4, 1, 3, 3, 1] and sizes.sum() == sum(len(t) + 1 for t in texts) and np.isfinite(x).all()
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        assert np.array_equal(line_crf.features([t])[0], x[at[k] : at[k + 1]])
    w, names = len(line_crf.NAMES), line_crf.NAMES
    assert x[3, names.index("as_before")] == 1 and x[2, names.index("as_before")] == 0
    assert np.array_equal(x[1, w : 2 * w], x[0, :w]) and not x[4, w:].any()
    assert x[5, names.index("upper")] == 0.5 and x[5, names.index("adjacent")] == 0.25 and x[6, names.index("lone_signs")] == 1 / 3


def test_held_out_accuracy(spark):
    """Documents whose labels were not seen: most predictions are right for either label, and labels decide, not ids."""
    sf = "/root/testdata/sf0.1"
    scored = queries.op13_line_quality(spark, sf)
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    for y in (0, 1):
        own = [r for r in rows if r["quality"] == y]
        assert len(own) > 50 and np.mean([r["predicted"] == y for r in own]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


DOCS, LABELS = "doc_id long, text string, score string, body string, label int", "doc_id long, quality int, text string"


def test_odd_rows(spark):
    good, bad = "A plain line of words here.\nAnd another plain line.", "BUY!! NOW!! BUY!! NOW!!\nNOW!! NOW!! NOW!!"
    docs = [(i, good if i % 2 else bad, "s", "b", 1) for i in range(60)] + [(None, good, None, None, None), (7, None, "", "", 0), (7, "", "", "", 0), (7, "\n" * 3000, "", "", 0), (9, bad + "\n" + "word " * 200_000, "", "", 0)] + [(1, good, "s", "b", 1)] * 50
    labels = [(i, i % 2, "t") for i in range(40)] + [(3, 1, None)] * 20 + [(None, 1, ""), (5, None, ""), (6, 7, ""), (999, 0, "")]
    df = spark.createDataFrame(docs, DOCS)
    field = line_crf.learn(df, spark.createDataFrame(labels, LABELS))
    out = line_crf.predict(df, field)
    assert out.columns == ["doc_id", "text", "body", "label", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["text"] == good) for r in rows if r["text"] in (good, bad))
    assert len({r["score"] for r in rows if r["text"] in (None, "")}) == 1
    assert line_crf.predict(df.limit(0), field).count() == 0


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1, "")], 1.0), ([(1, 0, "")] * 2, 0.0)])
def test_one_label_or_none(spark, labels, score):
    df = spark.createDataFrame([(1, "some text", "", "", 0), (2, None, "", "", 0)], DOCS)
    field = line_crf.learn(df, spark.createDataFrame(labels, LABELS))
    assert [r["score"] for r in line_crf.predict(df, field).collect()] == pytest.approx([score, score])


def test_one_hot_id_is_drawn_in_bounds(spark):
    """An id with many rows: copies teach once, different texts are bounded by the sample's size."""
    rows = [(1, f"words of row {i % 500}", "", "", 0) for i in range(5000)] + [(2, "BAD!! BAD!!", "", "", 0)]
    drawn = line_crf._sampled(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1, ""), (2, 0, "")], LABELS), "doc_id", "text", "quality", 20)
    assert drawn.count() <= 40
