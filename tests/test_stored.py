"""Stored tables under repeated batches, and scans that open only what changed."""

from __future__ import annotations

import os
import pathlib

from conftest import rows
from pyspark.sql import functions as F
from corpuslens.sources import stored


def files_below(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def test_upserts_are_idempotent_and_local(spark, tmp_path):
    path = str(tmp_path / "counts")
    stored.create_stored(spark, path, "k string, n bigint, first bigint")
    merge = {"n": F.sum("n"), "first": F.min("first")}  # a sum would notice a batch that counts twice

    def batch(number, pairs):
        stored.upsert(spark, path, spark.createDataFrame(pairs, "k string, n bigint, first bigint"), ["k"], merge, number)

    batch(0, [(f"k{i}", 1, i) for i in range(50)] + [(None, 1, 7)])
    before = files_below(path)
    batch(1, [("k1", 10, -1), ("new", 5, 5)])
    after = files_below(path)
    folders = {f.split("/")[0] for f in set(before) ^ set(after)}
    assert len(folders) <= 2 and {f for f in before if f.split("/")[0] not in folders} <= set(after)  # the others keep their files
    want = {f"k{i}": (1, i) for i in range(50)} | {None: (1, 7), "k1": (11, -1), "new": (5, 5)}
    read = lambda: {r["k"]: (r["n"], r["first"]) for r in stored.read_stored(spark, path).collect()}
    assert read() == want
    batch(1, [("k1", 10, -1), ("new", 5, 5)])  # again
    batch(0, [("k3", 1, 3)])  # an old one again
    assert read() == want
    batch(2, [])
    batch(3, [(None, 2, 9), ("k1", 1, 0)])
    assert read() == want | {None: (3, 7), "k1": (12, -1)}


def test_users_keep_their_first_sight(spark, tmp_path):
    path = str(tmp_path / "users")
    stored.create_stored(spark, path, "github_id bigint, username string, created_at timestamp, last_login timestamp")
    for number, logins in enumerate(([(1, "new", 50, 2), (2, "b", 60, 3)], [(1, "old", 10, 1)], [(1, "newest", 70, 4)], [(1, "older", 20, 5)])):
        frame = spark.createDataFrame(logins, "github_id bigint, username string, at bigint, login_id bigint").withColumn("ts", F.timestamp_seconds("at"))
        for _ in range(2):
            stored.upsert_users(spark, path, frame, number)
    got = stored.read_stored(spark, path).select("github_id", "username", F.unix_seconds("created_at"), F.unix_seconds("last_login"))
    assert rows(got) == [(1, "newest", 10, 70), (2, "b", 60, 60)]


def test_second_scan_opens_what_changed(spark, tmp_path):
    root = tmp_path / "tree"

    def put(path, data, at):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
        os.utime(target, (at, at))

    for i in range(20):
        put(f"p{i % 2}/src/f{i}.py", b"x = %d\n" % i, 1000)
    put("p0/bin.dat", b"a\x00b", 1000)
    put("p1/big.txt", b"y" * 4000, 1000)
    put("p1/node_modules/skip.js", b"1", 1000)
    put("p0/.env", b"A=1", 1000)
    put("p1/bad.txt", b"caf\xe9", 1000)
    texts, first = stored.changed_files(spark, str(root), max_kb=2)
    assert texts.count() == 24 and texts.filter("skipped IS NOT NULL").count() == 2
    assert rows(texts.filter("path IN ('.env', 'bad.txt')"), "text") == [("A=1",), ("caf\ufffd",)]
    first.write.parquet(str(tmp_path / "first"))
    first = spark.read.parquet(str(tmp_path / "first"))

    put("p0/src/f4.py", b"x = changed\n", 2000)
    put("p1/src/f5.py", b"x = 5\n", 2000)  # touched only
    put("p0/src/f6.py", b"x = ?\n", 1000)  # same size and time: a scan that opened it would tell
    put("p2/new.py", b"new\n", 500)  # an old time, but a new file
    (root / "p1/src/f7.py").unlink()
    texts, second = stored.changed_files(spark, str(root), first, max_kb=2)
    assert rows(texts, "project", "path", "text") == [("p0", "src/f4.py", "x = changed\n"), ("p2", "new.py", "new\n")]
    assert second.count() == 24 and second.filter("path = 'src/f7.py'").count() == 0
    plan = {(r[0], r[1]): r[2] for r in stored.folders_to_scan(first, second).collect()}
    assert plan == {("p0", ""): "scan", ("p0", "src"): "scan", ("p1", ""): "scan", ("p1", "src"): "scan", ("p2", ""): "scan"}
    second.write.parquet(str(tmp_path / "second"))
    texts, third = stored.changed_files(spark, str(root), spark.read.parquet(str(tmp_path / "second")), max_kb=2)
    assert texts.count() == 0 and {r[2] for r in stored.folders_to_scan(second, third).collect()} == {"skip"}
