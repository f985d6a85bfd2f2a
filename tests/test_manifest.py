import pytest

from twinline.schemas import NUMBERED_PAIRS
from twinline.sources import manifest, shards
from twinline.sources.parallel_text import open_parallel_text


def pairs(spark, n=40):
    rows = [("val" if i < 10 else "train", i // 10, i, str(i), (f"s{i}", f"t{i}")) for i in range(n)]
    return spark.createDataFrame(rows, "split string, shard_id long, row_idx long, id string, translation struct<src:string,tgt:string>")


def ids(df):
    return sorted(int(r.id) for r in df.collect())


def test_publish_appears_at_once(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    monkeypatch.setattr(manifest, "write_manifest", lambda *a: (_ for _ in ()).throw(OSError("the store is gone")))
    with pytest.raises(OSError):
        shards.publish(pairs(spark), target, manifest=True)  # fails after the files, before the manifest
    with pytest.raises(ValueError, match="no committed manifest"):
        shards.read_published(spark, target, NUMBERED_PAIRS)
    monkeypatch.undo()
    shards.publish(pairs(spark, 30), target, manifest=True)
    assert ids(shards.read_published(spark, target, NUMBERED_PAIRS)) == list(range(30))
    with pytest.raises(ValueError, match="committed already"):
        shards.publish(pairs(spark), target, manifest=True)
    assert ids(shards.read_published(spark, target, NUMBERED_PAIRS)) == list(range(30))


def test_a_manifest_without_its_marker_is_none(spark, tmp_path):
    target = tmp_path / "t"
    shards.publish(pairs(spark), str(target), manifest=True)
    (target / manifest.MANIFEST / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="no committed manifest"):
        shards.read_published(spark, str(target), NUMBERED_PAIRS)
    with pytest.raises(ValueError, match="not committed"):
        shards.publish(pairs(spark), str(target), manifest=True)


def test_a_changed_table_is_not_read(spark, tmp_path):
    target = tmp_path / "t"
    shards.publish(pairs(spark), str(target), manifest=True)
    file = next(target.glob("data-*/split=train/*.parquet"))
    content = bytearray(file.read_bytes())
    content[10] ^= 1
    file.write_bytes(bytes(content))
    with pytest.raises(ValueError, match="not as committed"):
        shards.read_published(spark, str(target), NUMBERED_PAIRS)
    file.unlink()
    with pytest.raises(ValueError, match="not as committed"):
        shards.read_published(spark, str(target), NUMBERED_PAIRS)


def test_shards_are_verified_by_digest(spark, tmp_path):
    out = tmp_path / "s"
    shards.write_shards(pairs(spark), str(out), manifest=True)
    listed = {r.file.split("/part")[0]: r.rows for r in manifest.read_manifest(spark, str(out)).collect()}
    assert listed == {"split=val/shard_id=0": 10, **{f"split=train/shard_id={i}": 10 for i in (1, 2, 3)}}
    (flipped,), (gone,) = (list(out.glob(f"split=train/shard_id={i}/*.parquet")) for i in (1, 2))
    content = bytearray(flipped.read_bytes())
    content[-30] ^= 1  # in the footer
    flipped.write_bytes(bytes(content))
    gone.unlink()
    (out / "split=train" / "shard_id=3" / "part-extra.parquet").write_bytes(b"not in the manifest")
    verdicts = shards.verify_shards(spark, str(out), NUMBERED_PAIRS)
    assert sorted((r.good, r.rows) for r in verdicts.collect()) == [(False, 0), (False, 0), (True, 10), (True, 10)]
    assert ids(shards.read_shards(spark, str(out), NUMBERED_PAIRS, verdicts=verdicts)) == [*range(10), *range(30, 40)]
    assert {r.path.split("/part")[0] for r in shards.unreadable_shards(verdicts, str(out)).collect()} == {"split=train/shard_id=1", "split=train/shard_id=2"}
    assert ids(shards.read_shards(spark, str(out), NUMBERED_PAIRS, ["val"])) == list(range(10))


def test_damaged_lines_are_kept_apart(spark, tmp_path):
    lines = [
        '{"id": "1", "translation": {"src": "a", "tgt": "b"}}', '{"id": "2", "translation": {"src": "a", "tg', "no json", "[1, 2]", "   ",
        '{"id": "3", "translation": "text"}', '{"translation": {"src": "a", "tgt": "b"}}', '{"id": "4"}', '{"id": "5", "translation": null}',
        '{"id": "6", "translation": {"src": null, "tgt": "b"}, "more": [1]}', '{"id": "7", "translation": {"src": {"x": 1}, "tgt": []}}', "",
        '{"id": "8", "translation": {}}', "null",
    ]
    path = tmp_path / "lines"
    path.write_text("\n".join(lines))
    good, bad = shards.scan_pairs(spark, str(path))
    assert {r.id for r in good.collect()} >= {"1", "6"}
    assert all(r.translation is not None and r.id is not None for r in good.collect())
    found = {r.line: r.reasons for r in bad.collect()}
    assert found[lines[1]] == found[lines[2]] == found[lines[5]] == ["damaged"]
    assert found[lines[6]] == ["no id"] and found[lines[7]] == found[lines[8]] == ["no translation"]
    assert good.count() + bad.count() == 12


def write_sides(folder, n_src=50, n_tgt=50, name="x"):
    for lang, n in (("src", n_src), ("tgt", n_tgt)):
        (folder / f"{name}.{lang}").write_text("".join(f"{lang}{i}\n" for i in range(n)))


def test_a_file_cut_short_after_counting_stops_the_job(spark, tmp_path):
    write_sides(tmp_path)
    write_sides(tmp_path, 9, 9, "y")
    text = open_parallel_text(spark, str(tmp_path), "src", "tgt")
    assert text.verified_pairs().count() == 59
    (tmp_path / "x.src").write_text("".join(f"src{i}\n" for i in range(20)))
    with pytest.raises(Exception, match="gone since"):
        text.pairs().collect()
    write_sides(tmp_path, 20, 20)  # both sides, alike
    with pytest.raises(ValueError, match="gone since"):
        text.verified_pairs()


def test_ragged_files_of_several_splits(spark, tmp_path):
    write_sides(tmp_path, 3_000, 2_990)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        text = open_parallel_text(spark, str(tmp_path), "src", "tgt", batch=32)
        rows = text.verified_pairs().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert text.layout.filter("side = 'src'").count() > 3
    assert sorted((r.row_idx, r.src, r.tgt) for r in rows) == [(i, f"src{i}", f"tgt{i}") for i in range(2_976)]


def test_packed_files_by_their_endings(spark, tmp_path):
    import gzip

    for lang in ("src", "tgt"):
        with gzip.open(tmp_path / f"x.{lang}.gz", "wt") as out:
            out.write("".join(f"{lang}{i}\n" for i in range(70)))
    write_sides(tmp_path, 5, 5, "a")
    rows = open_parallel_text(spark, str(tmp_path), "src", "tgt", packed=True).pairs().collect()
    assert sorted(r.src for r in rows) == sorted([f"src{i}" for i in range(70)] + [f"src{i}" for i in range(5)])
    assert all(r.src[3:] == r.tgt[3:] for r in rows)
