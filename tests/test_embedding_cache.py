from collections import Counter

from pyspark.sql import functions as F

from quern.operators.embedding import ModelEmbedder
from quern.operators.embedding_cache import CachedEmbedder


def model(log, name="m"):
    def load():
        def run(batch):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in batch)
            return [[len(t), 1.0] for t in batch]

        return run

    return ModelEmbedder(name, 2, load)


def embedded(log):
    return Counter(log.read_text().split("\n")[:-1]) if log.exists() else Counter()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("key", F.lit("mine"))


def test_a_text_is_embedded_once_over_all_ingests(spark, tmp_path):
    log, path = tmp_path / "log", f"file://{tmp_path}/cache"
    cache = CachedEmbedder(spark, model(log), path, buckets=4)
    first = [f"t{i % 30}" for i in range(50)] + ["", None, "  "]
    second = [f"t{i}" for i in range(20, 60)] + ["t1"] * 5
    for texts in (first, second, second):
        rows = {r.i: r for r in cache.embed(frame(spark, texts)).collect()}
        assert len(rows) == len(texts) and all(r.key == "mine" for r in rows.values())
        assert all(list(rows[i].embedding) == ([len(t), 1.0] if t and t.strip() else [0.0, 0.0]) for i, t in enumerate(texts))
    assert set(embedded(log).values()) == {1} and len(embedded(log)) == 60
    cache.forget()
    again = CachedEmbedder(spark, model(log), path, buckets=4)  # as another session finds it
    assert again.rows().count() == 60
    again.embed(frame(spark, second))
    assert sum(embedded(log).values()) == 60
    CachedEmbedder(spark, model(log, "other"), path, buckets=4).embed(frame(spark, ["t1"]))
    assert embedded(log)["t1"] == 2  # another model's vectors are its own
    again.forget()


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = CachedEmbedder(spark, model(tmp_path / "log"), f"file://{tmp_path}/cache", buckets=4)
    cache.embed(frame(spark, [f"t{i}" for i in range(40)]))
    asked = spark.range(30).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    for plan in (cache.missing(asked), cache.found(asked)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        below = text[text.index("FileScan") - 400 : text.index("FileScan") + 400]
        assert text.count("Exchange") == 1 and "Bucketed: true" in text, below
    cache.forget()


def test_empty(spark, tmp_path):
    cache = CachedEmbedder(spark, model(tmp_path / "log"), f"file://{tmp_path}/cache", buckets=4)
    assert cache.embed(spark.createDataFrame([], "text string")).collect() == [] and cache.rows().isEmpty()
    cache.forget()


def written(spark):
    """Bytes that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once_and_known_ones_never(spark, tmp_path):
    cache = CachedEmbedder(spark, model(tmp_path / "log"), f"file://{tmp_path}/cache", buckets=4)
    texts = spark.range(2_000, numPartitions=3).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.sha2(F.concat_ws("|", "id", i), 256)), "").alias("text"))
    for most in (1.2, 0.2):  # times the texts' 7.7 MB, which hardly compress: half, at best
        before = written(spark)
        cache.embed(texts).select("id", "embedding").write.format("noop").mode("overwrite").save()
        assert written(spark) - before < most * 2_000 * 60 * 64
    cache.forget()
