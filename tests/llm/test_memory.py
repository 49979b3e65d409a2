"""What executors and the driver hold at once."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lanewise.llm import chunks, jaccard, quality, shared, suffix_dedup


def test_wide_rows_have_pages_of_their_own(spark, tmp_path):
    rows = spark.range(20).coalesce(1).select("id", F.expr("array_join(transform(sequence(1, 20000), k -> sha2(cast(id * 20000 + k as string), 256)), '')").alias("body"))
    shared.stored(rows, f"{tmp_path}/wide")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    (name,) = (n for n in os.listdir(tmp_path / "wide") if n.startswith("part-"))
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/wide/{name}"), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        pages = reader.readOffsetIndex(reader.getFooter().getBlocks().get(0).getColumns().get(1)).getPageCount()
    finally:
        reader.close()
    assert pages >= 10


def seen_while_storing(spark, monkeypatch, module, run):
    """The setting of bytes to a worker at each write."""
    found = []

    def spy(*args, **more):
        found.append(spark.conf.get(shared.BATCH_BYTES, None))
        return shared.stored(*args, **more)

    for where in (module, chunks):
        monkeypatch.setattr(where, "stored", spy)
    before = {name: spark.conf.get(name, None) for name in shared.WIDE_ROWS}
    run()
    assert {name: spark.conf.get(name, None) for name in shared.WIDE_ROWS} == before
    return found


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "some words that come again and again " * (k % 9)) for k in range(30)], "doc_id long, text string")
    for module, run in ((suffix_dedup, suffix_dedup.repeat_counts), (jaccard, jaccard.jaccard_groups)):
        found = seen_while_storing(spark, monkeypatch, module, lambda run=run: run(docs).collect())
        assert len(found) > 4 and set(found) == {"4m"}


def test_driver_gets_one_state_a_round_of_the_classifier(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text number {k} of many") for k in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    kind, sizes = type(docs), []
    collect = kind.collect

    def spy(self):
        rows = collect(self)
        sizes.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    monkeypatch.setattr(kind, "collect", spy)
    quality.fit(docs, labels)
    assert len(sizes) == quality.ROUNDS and max(sizes) == 16 * quality.SIZE
