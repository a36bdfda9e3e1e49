import xxhash
from pyspark.sql import functions as F

from opsloom.llm.near_duplicates import one_of_each
from opsloom.llm.store import _file_hash, numbered


def settings(spark, cores, bytes_):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)


def reset(spark):
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_do_not_follow_the_splits(spark, table, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3000).select("id", F.lit("x" * 50).alias("_metadata"), F.lit(1).alias("_row")).repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    found = []
    try:
        for cores, size in ((1, "128m"), (7, "2k"), (3, "5k")):
            settings(spark, cores, size)
            df = numbered(spark.read.parquet(path).where("id >= 0").select("id", "_row"), "n")
            found.append({r.n: r.id for r in df.collect()})
    finally:
        reset(spark)
    assert len(found[0]) == 3000 and found[0] == found[1] == found[2]
    assert min(found[0]) >= 0


def test_rows_that_are_no_scan_are_written(spark):
    df = numbered(spark.range(100).groupBy((F.col("id") % 10).alias("k")).count())
    first, second = ({r.uid: r.k for r in df.collect()} for _ in range(2))
    assert len(first) == 10 and first == second


def test_files_hash_as_the_driver_checks(spark, tmp_path):
    """The collision check sees the very hashes that rows get."""
    path = str(tmp_path / "a b é%c")
    spark.range(40).repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    salt, bits = _file_hash(df.inputFiles())
    paths = [f[f.find(":") + 1:].lstrip("/") for f in df.inputFiles()]
    want = {xxhash.xxh64_intdigest(p + salt, 42) & ((1 << bits) - 1) for p in paths}
    assert {r.uid >> (63 - bits) for r in numbered(df).collect()} == want and len(want) == 4


def test_files_are_told_apart():
    for n in (0, 1, 5, 3000):
        files = [f"file:///a/part-{i}" for i in range(n)]
        salt, bits = _file_hash(files)
        assert bits >= 38 and isinstance(salt, str)


def test_copies_go_when_the_cores_change_between_jobs(spark, tmp_path, monkeypatch):
    """Near-duplicates are found in one job and taken out in another."""
    from opsloom.llm import near_duplicates

    path = str(tmp_path / "docs")
    rows = [(i, " ".join(f"w{(i % 300) * 50 + j}" for j in range(20))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.option("parquet.block.size", 2048).parquet(path)
    plain = near_duplicates.small_side

    def later(*args, **options):
        settings(spark, 5, "1k")
        return plain(*args, **options)

    monkeypatch.setattr(near_duplicates, "small_side", later)
    try:
        kept = sorted(r.doc_id for r in one_of_each(spark.read.parquet(path)).collect())
    finally:
        reset(spark)
    assert len(kept) == 300 and len({i % 300 for i in kept}) == 300
