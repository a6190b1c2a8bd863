"""What the language model is learned from."""

import numpy as np

from ampline.llm import hmm


def test_every_learning_document_shapes_the_model(spark, monkeypatch):
    rng, taken = np.random.default_rng(5), []
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(0, 30, 8))) for k in range(2000)] + [(2000, None)], "doc_id long, text string")
    gathered = hmm.gathered

    def noted(made, model, classes):
        out = gathered(made, model, classes)
        taken.append(round(out[0].sum()))
        assert abs(out[2].sum() - made.selectExpr("sum(length(seq)) / 4").first()[0]) < 1
        return out

    monkeypatch.setattr(hmm, "gathered", noted)
    counts = hmm.count_words(docs).localCheckpoint()
    vocab = hmm.vocabulary(counts, docs.count())
    model = hmm.train(docs, vocab)
    # each block once, then all at once
    assert sum(taken[: hmm.BLOCKS]) == 2001 and taken[hmm.BLOCKS :] == [2001] * hmm.FULL and min(taken) > 0
    assert np.allclose(model.emit.sum(0), 1, atol=1e-4) and np.isfinite(model.emit).all()
    assert hmm.train(docs.limit(0), hmm.vocabulary(counts.limit(0), 0)).emit.shape[0] == hmm.RARE + 1
