import gzip

import pytest
from pyspark.sql import functions as F

from twinline.operators import pairing
from twinline.plans import flows
from twinline.schemas import NUMBERED_PAIRS, PAIRS
from twinline.sources import shards as files
from twinline.sources.parallel_text import open_parallel_text, pair_files, read_parallel_text
from twinline.sources.paths import check_folder, name_below


def write(path, lines):
    path.write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")


def expected_pairs(pairs, rule, batch):
    """Plain reading of the files: ``(file_pair, line_no, batch_id, src, tgt)``."""
    out, batch_id = [], 0
    for number, (src, tgt) in enumerate(pairs):
        n = min(len(src), len(tgt))
        if rule == "drop_batch" and len(src) != len(tgt):
            n -= n % batch
        for at in range(0, n, batch):
            out += [(number, i, batch_id, src[i].strip(), tgt[i].strip()) for i in range(at, min(at + batch, n))]
            batch_id += 1
    return out


@pytest.fixture
def corpus(tmp_path):
    sides = {
        "a": ([f"　a{i} 한국\t" for i in range(64)], [f"b{i}\x85" for i in range(70)]),
        "b": ([f"c{i}" if i % 9 else "" for i in range(1000)], [f"d{i}" * (i % 40) for i in range(1000)]),
        "c": ([], ["x", "y"]),
        "d": ([f"e{i}" for i in range(65)], [f"f{i}" for i in range(70)]),
        "e": (["last"], ["one"]),
    }
    for name, (src, tgt) in sides.items():
        write(tmp_path / f"{name}.en", src)
        write(tmp_path / f"{name}.ko", tgt)
    (tmp_path / "notes.txt").write_text("ignored\n")
    return str(tmp_path), list(sides.values())


@pytest.mark.parametrize("rule", ["truncate", "drop_batch"])
@pytest.mark.parametrize("split_bytes", [None, "700"])
def test_scan(spark, corpus, rule, split_bytes):
    root, sides = corpus
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = read_parallel_text(spark, root, "en", "ko", rule, 32).orderBy("row_idx").collect()
        text = open_parallel_text(spark, root, "en", "ko", rule, 32)
        total, weights = text.total_pairs().first()[0], {r.batch: r.weight for r in text.batch_rows().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = expected_pairs(sides, rule, 32)
    assert [(r.file_pair, r.line_no, r.batch_id, r.src, r.tgt) for r in rows] == expected
    assert [r.row_idx for r in rows] == list(range(len(expected)))
    assert total == sum(len(src) for src, _ in sides)
    assert weights == {b: sum(e[2] == b for e in expected) for b in {e[2] for e in expected}}


def test_moved_splits_stop_the_job(spark, corpus):
    root, sides = corpus
    text = open_parallel_text(spark, root, "en", "ko")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        with pytest.raises(Exception, match="file splits moved"):
            text.pairs().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert text.pairs().count() == len(expected_pairs(sides, "drop_batch", 32))


def test_scan_of_folders_and_gzip(spark, tmp_path):
    tmp_path = tmp_path / "with space+and=signs"
    tmp_path.mkdir()
    for side in ("en", "ko"):
        (tmp_path / f"p.{side}").mkdir()
        for part in range(3):
            write(tmp_path / f"p.{side}" / f"part-0000{part}-x.txt", [f"{side} {part} {i}" for i in range(4)])
    with gzip.open(tmp_path / "q.en.gz", "wt") as out:
        out.write("not a pair\n")
    rows = read_parallel_text(spark, str(tmp_path), "en", "ko").orderBy("row_idx").collect()
    assert [(r.src, r.tgt) for r in rows] == [(f"en {p} {i}", f"ko {p} {i}") for p in range(3) for i in range(4)]


def test_gzip_parts(spark, tmp_path):
    for side in ("en", "ko"):
        (tmp_path / f"p.{side}").mkdir()
        with gzip.open(tmp_path / f"p.{side}" / "part-00000.txt.gz", "wt") as out:
            out.writelines(f"{side}{i}\n" for i in range(500))
    rows = read_parallel_text(spark, str(tmp_path), "en", "ko").orderBy("row_idx").collect()
    assert [(r.src, r.tgt) for r in rows] == [(f"en{i}", f"ko{i}") for i in range(500)]


def test_uneven_inputs_raise(spark, corpus, tmp_path):
    root, _ = corpus
    with pytest.raises(ValueError, match="number of lines"):
        read_parallel_text(spark, root, "en", "ko", "error")
    with pytest.raises(ValueError, match="ragged"):
        read_parallel_text(spark, root, "en", "ko", "other")
    with pytest.raises(ValueError, match="no .fr"):
        read_parallel_text(spark, root, "fr", "de")
    write(tmp_path / "z.en", ["alone"])
    with pytest.raises(ValueError, match="differ"):
        read_parallel_text(spark, root, "en", "ko")


def test_pairing_is_by_name_order(spark):
    names = spark.createDataFrame([(n,) for n in ("b.en", "a.en", "z.ko", "y.ko", "readme", "a.en")], "name string")
    rows = pair_files(names, "en", "ko").orderBy("file_pair").collect()
    assert [tuple(r) for r in rows] == [(0, "a.en", "y.ko"), (1, "b.en", "z.ko")]


def test_folder_checks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        check_folder(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="empty"):
        check_folder(spark, str(tmp_path))
    write(tmp_path / "f", ["x"])
    with pytest.raises(NotADirectoryError):
        check_folder(spark, str(tmp_path / "f"))
    check_folder(spark, str(tmp_path))


def test_raw_flow_to_published_splits(spark, corpus, tmp_path):
    root, sides = corpus
    out, target = str(tmp_path / "shards"), str(tmp_path / "published")
    rows = flows.raw_shards(open_parallel_text(spark, root, "en", "ko"), rows=100)
    files.write_shards(rows, out)
    expected = expected_pairs(sides, "drop_batch", 32)
    back = files.read_shards(spark, out, NUMBERED_PAIRS)
    assert back.count() == len(expected)
    per_file = back.groupBy("shard_id", F.col("_metadata.file_path")).count().groupBy("shard_id").count()
    assert {r["count"] for r in per_file.collect()} == {1}
    sizes = {r.shard_id: r["count"] for r in back.groupBy("shard_id").count().collect()}
    assert all(100 <= n < 132 for s, n in sizes.items() if s != max(sizes))
    files.publish(back, target)
    published = spark.read.parquet(target)
    assert sorted(published.columns) == ["id", "row_idx", "split", "translation"]
    assert published.filter("split = 'val'").count() == sizes[0]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.publish(back, target)


def test_corrupt_shard_and_missing_split(spark, tmp_path):
    out = str(tmp_path / "shards")
    rows = spark.range(30).select(
        F.lit("train").alias("split"),
        F.expr("id div 10").alias("shard_id"),
        F.col("id").alias("row_idx"),
        F.col("id").cast("string").alias("id"),
        F.struct(F.lit("a").alias("src"), F.lit("b").alias("tgt")).alias("translation"),
    )
    files.write_shards(rows, out)
    broken = next((tmp_path / "shards" / "split=train" / "shard_id=1").glob("*.parquet"))
    broken.write_bytes(b"this is not a shard")
    crc = broken.parent / f".{broken.name}.crc"
    crc.write_bytes(b"crc\x00")
    verdicts = files.verify_shards(spark, out, NUMBERED_PAIRS)
    back = files.read_shards(spark, out, NUMBERED_PAIRS, verdicts=verdicts)
    assert sorted(r.shard_id for r in back.select("shard_id").distinct().collect()) == [0, 2]
    assert back.count() == 20
    assert [r.path.split("/")[-1] for r in files.unreadable_shards(verdicts, out).collect()] == [broken.name]
    with pytest.raises(ValueError, match="no shards"):
        files.read_shards(spark, out, NUMBERED_PAIRS, ["val"])


def test_a_damaged_column_costs_the_whole_shard_for_every_projection(spark, tmp_path):
    out = str(tmp_path / "shards")
    rows = spark.range(60_000).select(
        F.lit("train").alias("split"),
        F.expr("id div 20000").alias("shard_id"),
        F.col("id").alias("row_idx"),
        F.col("id").cast("string").alias("id"),
        F.struct(F.md5(F.col("id").cast("string")).alias("src"), F.sha1(F.col("id").cast("string")).alias("tgt")).alias("translation"),
    )
    files.write_shards(rows, out)
    broken = next((tmp_path / "shards" / "split=train" / "shard_id=1").glob("*.parquet"))
    content = bytearray(broken.read_bytes())
    at = len(content) * 3 // 4  # inside the target texts
    content[at : at + 64] = bytes(64)
    broken.write_bytes(content)
    (broken.parent / f".{broken.name}.crc").unlink()
    verdicts = files.verify_shards(spark, out, NUMBERED_PAIRS)
    assert sorted((r.rows, r.good) for r in verdicts.collect()) == [(0, False), (20_000, True), (20_000, True)]
    back = files.read_shards(spark, out, NUMBERED_PAIRS)
    assert back.count() == back.select("row_idx").distinct().count() == 40_000
    assert back.filter("translation.tgt is not null").count() == back.toPandas()["id"].nunique() == 40_000


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_pairs_with_language_names(spark, tmp_path, fmt):
    pairs = spark.createDataFrame([("0", ("a", "b")), ("1", ("c", None))], PAIRS)
    files.name_sides(pairs, "en", "ko").write.format(fmt).save(str(tmp_path / "p"))
    assert set(spark.read.format(fmt).load(str(tmp_path / "p")).select("translation.*").columns) == {"en", "ko"}
    back = files.read_pairs(spark, str(tmp_path / "p"), fmt, "en", "ko")
    assert back.schema == pairs.schema
    assert sorted(back.collect()) == sorted(pairs.collect())


def test_publish_needs_rows_and_a_target(spark, tmp_path):
    empty = spark.createDataFrame([], "split string, id string")
    with pytest.raises(ValueError, match="no valid"):
        files.publish(empty, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="name a target"):
        files.publish(empty, "")


@pytest.mark.parametrize(
    "n, m, rule, kept",
    [
        (64, 70, "drop_batch", 64),
        (65, 70, "drop_batch", 64),
        (65, 70, "truncate", 65),
        (70, 70, "drop_batch", 70),
        (0, 5, "drop_batch", 0),
    ],
)
def test_zip_lines(spark, n, m, rule, kept):
    text = lambda p: F.concat(F.lit(p), "id").alias("text")
    src, tgt = (
        spark.range(k).select(F.lit(0).alias("file_pair"), F.col("id").alias("line_no"), text(p))
        for k, p in ((n, "s"), (m, "t"))
    )
    rows = pairing.zip_lines(src, tgt, rule).orderBy("line_no").collect()
    assert [(r.src, r.tgt) for r in rows] == [(f"s{i}", f"t{i}") for i in range(kept)]


def test_zip_lines_error_rule(spark):
    src = spark.range(3).select(F.lit(0).alias("file_pair"), F.col("id").alias("line_no"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        pairing.zip_lines(src, src.limit(2), "error")
    assert pairing.zip_lines(src, src, "error").count() == 3


def test_budgets(spark):
    df = spark.createDataFrame([("H100",), ("4090",)], "p string")
    assert {r.p: (r.batch_size, r.max_length) for r in pairing.budget_lookup(df, "p").collect()} == {
        "H100": (128, 512),
        "4090": (24, 128),
    }
    assert tuple(pairing.with_budget(df, "A100_40").select("batch_size", "max_length").first()) == (48, 256)
    with pytest.raises(ValueError, match="unsupported"):
        pairing.with_budget(df, "other")
    with pytest.raises(Exception, match="unsupported"):
        pairing.budget_lookup(df.withColumn("p", F.lit("other")), "p").collect()


def test_concat_needs_equal_columns(spark):
    with pytest.raises(Exception, match="annot resolve column"):
        pairing.concat([spark.range(1), spark.range(1).withColumnRenamed("id", "x")])


@pytest.mark.parametrize(
    "root, path, name",
    [
        ("s3a://corpus/corpus", "s3a://corpus/corpus/X.en", "X.en"),
        ("s3a://bucket", "s3a://bucket/X.en/part-0", "X.en"),
        ("s3a://bucket/", "s3a://bucket/X.en", "X.en"),
        ("file:/a/data", "file:///a/data/proj/data/X.en", "proj"),
        ("file:/a/b c", "file:///a/b%20c/X.en", "X.en"),
        ("file:/a", "file:/other/a/X.en", None),
    ],
)
def test_names_are_cut_at_the_root_alone(spark, root, path, name):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(name_below("path", root)).first()[0] == name


def test_relative_folder(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    write(folder / "a.en", ["1", "2"])
    write(folder / "a.ko", ["x", "y"])
    import os

    relative = os.path.relpath(folder)
    assert {(r.src, r.tgt) for r in read_parallel_text(spark, relative).collect()} == {("1", "x"), ("2", "y")}
