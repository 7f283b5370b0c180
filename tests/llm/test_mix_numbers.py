"""The mix when the table is cut into other partitions between two scans of it."""

from collections import Counter

from wavelake.llm import mixing


def test_mix_survives_other_partitions(spark, tmp_path):
    at, cut = str(tmp_path / "docs"), {"spark.sql.files.minPartitionNum": "8", "spark.sql.files.openCostInBytes": "0"}
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3], i * 10) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, other bigint").repartition(8, "doc_id").write.parquet(at)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        docs = spark.read.parquet(at)
        assert docs.rdd.getNumPartitions() == 1
        want = {r.doc_id: r.times for r in mixing.plan(docs).collect() if r.taken}
        out = mixing.mix(docs)
        for k, v in cut.items():
            spark.conf.set(k, v)
        assert spark.read.parquet(at).rdd.getNumPartitions() > 1
        got = out.collect()
    finally:
        for k in cut:
            spark.conf.unset(k)
    assert out.columns == docs.columns and Counter(r.doc_id for r in got) == want
    assert {tuple(r) for r in got} <= set(rows)
