"""Many copies of one text and many texts without words."""

from pyspark.sql import functions as F

from tidemark.llm import minhash_dedup


def test_copies_and_wordless_rows_are_spread(spark, monkeypatch):
    """The join that finds the first copy of a text is dealt over many tasks, also when a third of the rows are alike."""
    copied = " ".join(f"w{i}" for i in range(40))
    rows = [(i, copied if i % 3 == 0 else None if i % 3 == 1 else f"text {i} of its own with number {i * i}") for i in range(6000)]
    largest, store = {}, minhash_dedup.saved

    def measured(df, name, **options):
        stored = store(df, name, **options)
        if name == "nodes":
            per_file = stored.groupBy(F.input_file_name()).count()
            largest[name] = per_file.agg(F.max("count"), F.sum("count")).first()
        return stored

    monkeypatch.setattr(minhash_dedup, "saved", measured)
    changed = {
        "spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
        found = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert found == {i: (0 if i % 3 == 0 else i, i % 3 != 0 or i == 0) for i, _ in rows}
    most, total = largest["nodes"]
    assert total == 6000 and most < 600
