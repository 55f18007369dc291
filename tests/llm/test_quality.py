import zlib

import numpy as np
import pytest

from plotscope.llm import quality
from tests.llm.helpers import AWKWARD, docs


@pytest.fixture(scope="module")
def sample(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return rows.select("doc_id", "text", "quality").collect()


def learned(key):
    return zlib.crc32(str(key).encode()) % 5 != 0


def test_held_out_accuracy(spark, sample):
    from plotscope.llm.queries import op6_quality_cnn

    found = {r.doc_id: r for r in op6_quality_cnn(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out != learned(k) and r.predicted == (r.score >= 0.3) for k, r in found.items())
    test = [r for r in sample if not learned(r.doc_id)]
    good = [found[r.doc_id].predicted for r in test if r.quality == 1]
    bad = [found[r.doc_id].predicted for r in test if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.35


def test_gradients_match_differences(sample):
    net = quality.Network.fresh(3)
    lay = quality.Layout([r.text.encode()[:900] for r in sample[:6]])
    wanted = np.array([0, 1, 1, 0, 1, 0], np.float32)
    for name in ("embed", "near", "far", "again", "bias", "mean", "most", "base"):
        setattr(net, name, getattr(net, name).astype(np.float64))

    def loss():
        _, filtered = quality._filtered(net, lay)
        pooled = np.stack([np.maximum(filtered[a:b].max(axis=0), 0) for a, b in zip(lay.first, lay.last, strict=True)])
        chunks = [pooled[lay.doc == d] for d in range(6)]
        logit = np.array([c.mean(0) @ net.mean + c.max(0) @ net.most + net.base[0] for c in chunks])
        return np.mean(np.log1p(np.exp(logit)) - wanted * logit) + 5e-5 * ((net.mean**2).sum() + (net.most**2).sum())

    grads = quality._gradients(net, lay, wanted)
    rng = np.random.default_rng(0)
    for name, grad in grads.items():
        value, way = getattr(net, name), rng.normal(size=getattr(net, name).shape)
        steps = []
        for sign in (1, -1):
            setattr(net, name, value + sign * 1e-5 * way)
            steps.append(loss())
        setattr(net, name, value)
        assert (steps[0] - steps[1]) / 2e-5 == pytest.approx(float((grad * way).sum()), rel=0.05, abs=2e-4), name


def test_scores_do_not_depend_on_the_batch(sample):
    net = quality.Network.fresh(2)
    texts = [r.text for r in sample[:20]] + ["", None, "x", "word " * 40_000]
    together = quality.scores(net, texts)
    assert np.allclose(together, [quality.scores(net, [t])[0] for t in texts], atol=1e-5)


def test_the_end_of_a_long_text_counts(sample):
    net = quality.train([r.text for r in sample if learned(r.doc_id)], [r.quality for r in sample if learned(r.doc_id)])
    clean = next(r.text for r in sample if r.quality == 1 and len(r.text) > 2000)
    tail = "ABC!! DEFG!! HIJ!! KLMNO!! " * 200
    assert quality.scores(net, [clean + tail])[0] < quality.scores(net, [clean])[0]


def test_awkward_rows(spark):
    net = quality.train([], [])
    found = quality.score_documents(docs(spark, AWKWARD), net).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [True, True]
    assert quality.score_documents(docs(spark, []), net).count() == 0
    assert quality.keep_good(docs(spark, AWKWARD), net, least=0.0).columns == docs(spark, AWKWARD).columns
    labels = spark.createDataFrame([(5, None), (None, 1), (6, 1)], "doc_id BIGINT, quality INT")
    quality.train_on_sample(docs(spark, AWKWARD), labels)
    quality.train_on_sample(docs(spark, []), labels.filter("false"))
