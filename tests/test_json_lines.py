"""The data source of JSON-line logs: batch and stream read the same lines."""

from __future__ import annotations

import json

import pytest

from conftest import rows
from corpuslens.sources import json_lines
from corpuslens.streaming import jobs


def line(i):
    return json.dumps({"n": i, "text": "ü" * (i % 7)}, ensure_ascii=False)


@pytest.mark.parametrize("part_bytes", [1 << 20, 7])
def test_batch_reads_every_line_once(spark, tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(json_lines, "PART_BYTES", part_bytes)
    logs = tmp_path / "logs"
    (logs / "sub").mkdir(parents=True)
    (logs / "a.jsonl").write_text("\n".join(line(i) for i in range(20)) + "\n")
    (logs / "sub" / "b.jsonl").write_text(line(1) + "\r\nnot json\n\n{broken\n" + line(2))  # no break at the end
    (logs / "_hidden").write_text("x")
    (logs / "empty.jsonl").write_text("")
    got = json_lines.read_lines(spark, str(logs))
    assert rows(got.where("session = 'a'"), "line", "valid") == sorted((line(i), True) for i in range(20))
    assert rows(got.where("session IN ('b', 'c')"), "line", "valid") == sorted([(line(1), True), ("not json", False), ("{broken", False), (line(2), True)], key=repr)
    offsets = [r["pos"] for r in got.where("session = 'a'").orderBy("pos").collect()]
    assert offsets[0] == 0 and len(set(offsets)) == 20
    assert json_lines.read_lines(spark, str(tmp_path / "nowhere")).count() == 0


def test_only_asked_sessions_are_opened(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    for name in "abc":
        (tmp_path / f"{name}.jsonl").write_text(line(1) + "\n")
    reader = json_lines._Reader(str(tmp_path))
    rest = list(reader.pushFilters([EqualTo(("session",), "a"), GreaterThan(("pos",), 3), In(("session",), ("a", "b"))]))
    assert rest == [GreaterThan(("pos",), 3)] and [p.name for p in reader.partitions()] == ["a.jsonl"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"

    def arrivals():
        a.write_text(line(0) + "\n" + line(1) + "\n" + line(2)[:5])  # a line that is being written
        yield
        with a.open("a") as f:
            f.write(line(2)[5:] + "\n")
        b.write_text("bad\n" + line(3) + "\n")
        yield  # the stream is started again with its offsets
        yield  # nothing new
        with a.open("a") as f:
            f.write(line(4) + "\n")
        yield

    out = jobs.run_append(json_lines.stream_lines(spark, str(logs)), "lines-test", arrivals())
    want = [("a", line(i), True) for i in (0, 1, 2, 4)] + [("b", "bad", False), ("b", line(3), True)]
    assert rows(out, "session", "line", "valid") == sorted(want, key=repr)
    batch = json_lines.read_lines(spark, str(logs))
    assert rows(out, "session", "pos", "line") == rows(batch, "session", "pos", "line")
