"""The model and a task hold few vectors at once."""

from engram.functions import embedding


def test_models_are_asked_by_slices(spark):
    """A whole Arrow batch (500 texts here) was asked for at once before."""

    def model(batch):
        return [[float(len(batch)), 1.0] if len(t) < 4 else None for t in batch]

    texts = spark.range(2000).selectExpr("CAST(id AS STRING) AS text").coalesce(1)
    got = {r.text: r.embedding for r in embedding.embed_distinct(texts, model, 2).coalesce(1).collect()}
    assert len(got) == 2000 and got["1500"] is None and all(got[str(k)][1] == 1.0 for k in range(1000))
    assert max(v[0] for v in got.values() if v) <= embedding.SLICE
