import posixpath

import pytest
from pyspark.sql import functions as F

from tidewell.operators import smallfiles as S

SCHEMA = "generation_id string, ordinal bigint, path string, row_count bigint, size_bytes bigint, place string"


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r["generation_id"], r["ordinal"]) for r in S.split_packing(df, **kw).collect()) if rows and all(r[0] for r in rows) else [(r["generation_id"], r["ordinal"]) for r in S.split_packing(df, **kw).collect()]


def test_canonical_paths_agree_with_posix(spark):
    paths = ["a/b/c", "./a/b", "a/./b", "a/x/../b", "a/x/y/../../b", "a//b", "a\\b\\c", "/a/../b", "../a", "a/..", "s3://k/a/./b", "/../a", "a/b/", "..", "a/../../b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.canonical_path(F.col("p")).alias("c"))
    for r in df.collect():
        if "://" in r["p"]:
            assert r["c"] == "s3://k/a/b"
        else:
            want = posixpath.normpath(r["p"].replace("\\", "/"))
            assert r["c"] == ("" if want == "." else want), r["p"]


def test_cases_and_odd_rows(spark):
    rows = [
        ("g", 0, "d/g/a", 1, 10, "clash"), ("g", 0, "d/g/a", 1, 10, "clash"), ("g", 3, "./d/g/a", 1, 10, None), ("g", 1, "d/g/b", None, 0, None),
        ("g", 2, "d/g/c", 1, 1 << 20, None), ("g", 4, "d/g/e", 1, None, None), ("g", 5, "d/g/f", 1, -1, None),
        ("h", 0, "d/h/a", 1, 10, None), ("h", 1, "d\\h\\a", 1, 10, None), ("i", 0, None, 1, 5, None), ("i", 1, None, 1, 5, None), (None, 0, "x", 1, 1, None), (None, 1, "y", 1, 1, None),
    ]
    assert sorted(found(spark, rows), key=str) == sorted([("g", 0), ("g", 1), ("i", 0), ("i", 1), (None, 0), (None, 1)], key=str)
    assert found(spark, []) == []


def test_packing_agrees_with_a_plain_loop_when_one_generation_is_hot(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    sizes = [(i * 37) % 900 + 1 for i in range(200)]
    rows = [("hot", i, f"d/hot/{i}", 1, s, None) for i, s in enumerate(sizes)] + [(f"g{i % 30}", i, f"d/{i}", 1, 5, None) for i in range(90)]
    got = {r["ordinal"]: r["target_file"] for r in S.split_packing(spark.createDataFrame(rows, SCHEMA), target_bytes=5000, open_cost=100).where("generation_id = 'hot'").collect()}
    total = 0
    for i, s in enumerate(sizes):
        assert got[i] == total // 5000
        total += s + 100


def test_records_are_written_once_and_verified(spark, tmp_path):
    cat = spark.createDataFrame([("g", i, f"d/g/{i}", 3, 10, None) for i in range(5)], SCHEMA)
    rec = spark.createDataFrame([(i * 3 + j, f"d/g/{i}", j, None if j == 1 else float(j)) for i in range(5) for j in range(3)], "row_id bigint, path string, ordinal_in_file bigint, reading double")
    out = S.rewrite_records(rec, cat, str(tmp_path / "o"))
    assert sorted(r["row_id"] for r in out.collect()) == list(range(15))
    assert out.select("generation_id", "target_file").distinct().count() == 1


def test_physical_files_are_compacted_without_loss(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(1000).withColumn("x", F.col("id") % 7).repartition(50).write.parquet(src)
    got = S.compact_folder(spark, src, str(tmp_path / "dst"), target_bytes=1 << 20, open_cost=1 << 16)
    assert got["rows"] == 1000 and got["files_before"] == 50 and got["files_after"] < 10
    assert spark.read.parquet(str(tmp_path / "dst" / "files")).agg(F.sum("id")).first()[0] == 499500
    with pytest.raises(Exception):  # noqa: B017
        S.compact_folder(spark, src, str(tmp_path / "dst"))


def test_files_without_an_ordinal_are_packed_first(spark):
    rows = [("g", 0, "d/g/a", 1, 10, None), ("g", None, "d/g/b", 1, 20, None), ("g", 1, "d/g/c", 1, 30, None), ("g", None, "d/g/d", 1, 40, None)]
    got = S.split_packing(spark.createDataFrame(rows, SCHEMA), target_bytes=20, open_cost=0).collect()
    assert sorted((r["place"], r["target_file"]) for r in got) == [("d/g/a", 3), ("d/g/b", 0), ("d/g/c", 3), ("d/g/d", 1)]


def test_full_splits_are_close_to_the_target_whatever_the_files_are_like(spark):
    sizes = {"tiny": [700 + i % 50 for i in range(4000)], "mid": [40_000 + i % 999 for i in range(3000)], "big": [900_000 + i for i in range(500)]}
    rows = [(g, i, f"d/{g}/{i}", 1, s, None) for g, x in sizes.items() for i, s in enumerate(x)]
    target = 64 << 20
    packed = S.split_packing(spark.createDataFrame(rows, SCHEMA), target_bytes=target)
    splits = packed.groupBy("generation_id", "target_file").agg(F.sum("size_bytes").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    last = {g: max(r["target_file"] for r in splits if r["generation_id"] == g) for g in sizes}
    full = [r for r in splits if r["target_file"] < last[r["generation_id"]]]
    assert len(full) >= 7 and all(0.85 * target < r["b"] <= target + S.SMALL_BYTES for r in full)
    assert all(r["n"] <= target // S.LEAST_OPEN_COST + 1 for r in splits)
