from lodestone.operators import entities


def test_large_batches_are_searched_in_slices(spark):
    class Bounded(entities.PatternRecognizer):
        """Fails if it is handed more text at once than a worker should hold."""

        def extract_many(self, texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= entities.TEXT_BYTES
            return entities.PatternRecognizer.extract_many(self, texts)

    long = "Aa b " * 100_000  # half a slice
    rows = [(i, long if i % 3 == 0 else None if i % 3 == 1 else "Aa" * (i % 7)) for i in range(20)] + [(40, long * 3), (41, "")]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    found = entities.extract(df, Bounded({"A": "Aa"}), id_col="id")
    counts = {r.row_id: r["count"] for r in found.groupBy("row_id").count().collect()}
    assert counts == {i: t.count("Aa") for i, t in rows if t and "Aa" in t}
