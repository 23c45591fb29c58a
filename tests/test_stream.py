from test_detect import FIRST, TRIM

from veilframe.operators.detect import detect, findings
from veilframe.sources.policies import Policy
from veilframe.sources.tables import documents
from veilframe.streaming.stream import scan_stream


def test_a_stream_gives_what_a_batch_gives(spark, tmp_path):
    texts = {"a": FIRST, "b": TRIM, "c": "plain"}
    spark.createDataFrame(list(texts.items()), "id string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, t string").parquet(str(tmp_path / "in"))
    query = (
        scan_stream(documents(stream, "id", "t"), Policy())
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {row["source_id"]: row["blocked"] for row in got.collect()} == {"a": True, "b": False, "c": False}
    batch = findings(detect(documents(spark.read.parquet(str(tmp_path / "in")), "id", "t"), Policy()))
    assert sorted(map(tuple, findings(got).collect())) == sorted(map(tuple, batch.collect()))
