from pyspark.sql import functions as F

from lurescope.functions.url_enriched import FEATURES
from lurescope.streaming.features import redact_stream, url_feature_stream


def run(stream, tmp_path, name):
    query = (
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}")
        .option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    )
    query.awaitTermination(90)
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_stateless_operators_on_a_stream(spark, tmp_path):
    rows = [(1, "see http://a.example/login and www.b.example"), (2, "mail x@y.example please")]
    mail = spark.createDataFrame(rows, "email_id long, body string")
    mail.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(mail.schema).parquet(f"{tmp_path}/in")
    got = run(url_feature_stream(stream), tmp_path, "urls")
    want = url_feature_stream(mail)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 2 and set(FEATURES) <= set(got.columns)
    text = run(redact_stream(stream), tmp_path, "text").where(F.col("email_id") == 2).first()["body"]
    assert text == "mail <EMAIL> please"
