import json

from pyspark.sql import functions as F

from tessellum.sources import generations, writers


def test_generations(spark, tmp_path):
    root = str(tmp_path / "table")
    assert generations.live(spark, str(tmp_path)) is None
    generations.write_build(spark.range(3), root, 7)
    assert generations.live(spark, root) is None and not generations.promote(spark, root, 8)
    assert generations.promote(spark, root, 7) and generations.read_live(spark, root).count() == 3
    generations.write_build(spark.range(5), root, 9)
    generations.write_build(spark.range(6), root, 10)
    assert generations.read_live(spark, root).count() == 3
    # somebody else was faster
    assert generations.promote(spark, root, 9, expected=7) and not generations.promote(spark, root, 10, expected=7)
    assert generations.live(spark, root) == 9 and generations.read_live(spark, root).count() == 5
    assert generations.sweep(spark, root, keep=(10,)) == [7] and generations.sweep(spark, root) == [10]
    assert generations.read_live(spark, root).count() == 5


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(k, "good" if k % 2 else "bad", f"a\n{k}") for k in range(20)], "id long, label string, text string")
    writers.write_json_lines(df, f"{tmp_path}/lines", [F.desc("id")])
    lines = [json.loads(x) for part in sorted((tmp_path / "lines").glob("part-*")) for x in part.read_text().splitlines()]
    assert [x["id"] for x in lines] == list(range(19, -1, -1))
    writers.write_labelled(df, f"{tmp_path}/labels")
    assert spark.read.text(f"{tmp_path}/labels").where("label = 'good'").count() == 10
    writers.write_text(df, f"{tmp_path}/text", "label", [F.col("id")])
    parts = sorted((tmp_path / "text").glob("part-*.gz"))
    assert [r.value for p in parts for r in spark.read.text(str(p)).collect()] == ["bad", "good"] * 10


def test_stream(spark):
    assert [r.id for r in writers.stream(spark.range(1000), [F.desc("id")])] == list(range(999, -1, -1))
