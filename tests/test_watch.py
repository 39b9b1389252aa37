from lithic.streaming import watch


def test_new_sources_are_checked(spark, tmp_path):
    folder, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    rows = lambda *r: spark.createDataFrame(list(r), watch.SOURCES).write.mode("append").parquet(folder)
    rows(("a.py", "import os\n"), ("b.py", "x = 1\n"))
    watch.watch(watch.read_stream(spark, folder), target, marks, once=True).awaitTermination()
    rows(("c.py", "import sys\n"))
    watch.watch(watch.read_stream(spark, folder), target, marks, once=True).awaitTermination()
    assert sorted(r.file for r in spark.read.parquet(target).collect()) == ["a.py", "c.py"]
