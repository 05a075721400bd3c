from evbench.streaming import quarantine_stream


def test_stream_is_routed(spark, tmp_path):
    schema = "id string, residue string, position string"
    spark.createDataFrame([("a", "K", "2"), ("a", "S", "2")], schema).write.parquet(f"{tmp_path}/in")
    seqs = spark.createDataFrame([("a", "MKT")], "accession string, sequence string")
    q = quarantine_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), seqs, "id", "residue", "position", f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/c")
    q.awaitTermination(120)
    assert [r.residue for r in spark.read.parquet(f"{tmp_path}/good").collect()] == ["K"]
    assert [r.reasons for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["residue_mismatch"]
