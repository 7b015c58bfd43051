from pyspark.sql import functions as F

from sentrel.catalogue import Rule
from sentrel.streaming.changes import stream_changes
from sentrel.streaming.scan import drain

RULE = Rule("P1", "Passwords", "secrets", "regex", "password", "low", "low", "A password.", None, patterns=("password",))
SCHEMA = "repo string, path string, text string, arrived timestamp"


def test_findings_appear_and_vanish_with_the_versions_of_a_file(spark, tmp_path):
    def arrive(n, *versions):
        df = spark.createDataFrame(versions, "repo string, path string, text string, at string")
        df = df.select("repo", "path", "text", F.to_timestamp("at").alias("arrived"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    def changes():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        drain(stream_changes(stream, [RULE]), str(tmp_path / "out"))
        rows = spark.read.parquet(str(tmp_path / "out/rows")).collect()
        return sorted((r.file, r.arrived.hour, r.change, r.line) for r in rows)

    one, two = 'password = "admin"\n', 'x = 1\npassword = "admin"\n'
    arrive(1, ("r", "a.py", one, "2024-01-01 01:00:00"), ("r", "b.py", one, "2024-01-01 01:00:00"))
    arrive(2, ("r", "a.py", two, "2024-01-01 05:00:00"))
    arrive(3, ("r", "a.py", one, "2024-01-01 02:00:00"))  # older than the version that is held
    first = [("a.py", 1, "appeared", 1), ("a.py", 5, "appeared", 2), ("a.py", 5, "vanished", 1), ("b.py", 1, "appeared", 1)]
    assert changes() == first
    # A restart goes on from the checkpoint: the held version is known, and a clean file lets its findings vanish.
    arrive(4, ("r", "a.py", "x = 1\n", "2024-01-01 09:00:00"), ("r", "b.py", one, "2024-01-01 09:00:00"))
    assert changes() == sorted([*first, ("a.py", 9, "vanished", 2)])
    # Two versions in one batch are taken in their order.
    arrive(5, ("r", "a.py", "x\n", "2024-01-01 11:00:00"), ("r", "a.py", one, "2024-01-01 10:00:00"))
    assert changes() == sorted([*first, ("a.py", 9, "vanished", 2), ("a.py", 10, "appeared", 1), ("a.py", 11, "vanished", 1)])
