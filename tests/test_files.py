"""Sources and sinks of text: byte ranges, line ends, unterminated lines, commits that leave nothing of what failed."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import files


def names(path):
    return sorted(p for p in os.listdir(path) if not p.startswith("."))


@pytest.mark.parametrize("split", [1, 7, 8, 9, 20, 1 << 20])
def test_kmer_files_by_byte_ranges(spark, tmp_path, split):
    rows = [("AACC", "F", "G"), ("ACCG", "A", "T"), ("CCGT", "A", "F")]
    text = "".join(f"{k} {b}{f}\n" for k, b, f in rows)
    (tmp_path / "kmers.txt").write_text(text + "ACC")  # what follows the last line end is no line
    path = str(tmp_path / "kmers.txt")
    assert files.width(path) == 4 and files.line_count(spark, path, split) == 3
    found = files.read_kmers(spark, path, split=split)
    assert [tuple(r) for r in found.collect()] == rows and found.rdd.getNumPartitions() == (3 if split < 16 else 2 if split == 20 else 1)
    (tmp_path / "kmers.txt").write_text("AACC FG\nACC AF\nCCGTT AF\n")
    with pytest.raises(Exception, match="the line at byte 8 has not 8 bytes"):
        files.read_kmers(spark, path, split=split).collect()


def test_folders_and_empty_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("")
    (tmp_path / "b.dat").write_text("ACGT FA\n")
    (tmp_path / "_SUCCESS").write_text("no line\n")
    (tmp_path / "c.dat").write_text("CGTA AF\n")
    path = "file://" + str(tmp_path)
    assert sorted(r.kmer for r in files.read_kmers(spark, path, 4).collect()) == ["ACGT", "CGTA"]
    assert files.line_count(spark, path) == 2 and files.width("file://" + str(tmp_path / "a.dat")) == 0
    with pytest.raises(FileNotFoundError):
        files.width(str(tmp_path / "none"))


@pytest.mark.parametrize("split", [1, 2, 3, 5, 11, 1000])
def test_numbered_lines(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(files, "READ", 4)
    texts = ["a\n\nbcd\nef\n\n\nghijklmnop\nq\n", "\n", "zz\nüx\ny"]
    for k, t in enumerate(texts):
        (tmp_path / f"{k}.txt").write_text(t)
    want = "".join(texts).split("\n")
    got = files.numbered_lines(spark, str(tmp_path), split).collect()
    assert sorted((r.line_no, r.value) for r in got) == list(enumerate(want))


def test_lines_are_committed_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("value"))
    bad = lines.where("value <> '3'").select(F.when(F.col("value") == "35", F.raise_error(F.lit("broken"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        files.write_lines(bad, path)
    assert not os.path.exists(path) or names(path) == []
    files.write_lines(lines, path, "lines")
    assert names(path) == [f"lines_{k}.dat" for k in range(4)]
    assert "".join((tmp_path / "out" / n).read_text() for n in names(path)) == "".join(f"{k}\n" for k in range(40))
    with pytest.raises(Exception, match="holds"):
        files.write_lines(lines, path)
    files.write_lines(lines.limit(3).coalesce(1), path, "few", overwrite=True)
    assert names(path) == ["few_0.dat"]
    with pytest.raises(Exception, match="one column"):
        spark.range(2).write.format("line_files").option("path", path).mode("append").save()


def test_a_trajectory_as_the_format_has_it(spark, tmp_path):
    rows = [(0, 2, 0.5, 1 / 3), (0, 1, 0.0, 100000.0), (1, 1, 1e-5, 1234567.0), (1, 2, 0.6666666, -2.0)]
    frames = spark.createDataFrame(rows, "frame int, id long, x double, y double").repartition(3)
    path = str(tmp_path / "t")
    files.write_trajectory(frames, path, 2, 0.0316227766)
    text = "".join((tmp_path / "t" / n).read_text() for n in names(path))
    assert text == "2 0.0316228\n0 100000\n0.5 0.333333\n\n1e-05 1.23457e+06\n0.666667 -2\n\n"
    back = sorted(tuple(r) for r in files.read_trajectory(spark, path).collect())
    assert back == [(0, 0, 0.0, 100000.0), (0, 1, 0.5, 0.333333), (1, 0, 1e-05, 1234570.0), (1, 1, 0.666667, -2.0)]
    files.write_frames(frames, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4
