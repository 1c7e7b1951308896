import json
import random

import pytest

from recollect.sources.line_ranges import json_line_ranges
from recollect.sources.sessions import json_lines, sessions


def listed(df):
    return [(r["path"].rsplit("/", 1)[1], r["line"]) for r in df.orderBy("path", "pos").select("path", "line").collect()]


@pytest.mark.parametrize("size", [7, 1000])
def test_ranges_give_the_lines_of_whole_files(spark, tmp_path, size):
    """Long lines over many ranges, blank ones, letters of several bytes, an empty file, a torn end and an end without a line feed."""
    rng = random.Random(1)
    line = lambda n: json.dumps({"n": n, "t": "é" * rng.randrange(20)}, ensure_ascii=False)
    (tmp_path / "a.jsonl").write_text("\n".join([line(1), "", line(2), "  ", json.dumps({"long": "x" * 300}), line(3)]) + "\n")
    (tmp_path / "b.jsonl").write_text(line(4) + "\n" + line(5))
    (tmp_path / "c.jsonl").write_text(line(6) + '\n{"torn": tr')
    (tmp_path / "d.jsonl").write_text("")
    (tmp_path / "e.txt").write_text("{}\n")
    found = listed(json_line_ranges(spark, str(tmp_path), size=size))
    assert found == listed(json_lines(spark, str(tmp_path))) and len(found) == 7


def test_a_bad_line_raises(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n[1]\n{"b": 2}\n')
    with pytest.raises(Exception, match="at byte 9: not a JSON object"):
        json_line_ranges(spark, str(tmp_path)).collect()


def test_sessions_are_the_same(spark, tmp_path):
    rows = [{"type": "session", "id": "s", "cwd": "/w"}]
    for n in range(6):
        role = {"role": "user", "content": f"ask {n}"} if n % 2 == 0 else {"role": "assistant", "content": f"told {n}", "stopReason": "stop"}
        rows.append({"type": "message", "id": f"m{n}", "parentId": f"m{n - 1}" if n else None, "timestamp": f"2024-01-01T00:00:0{n}Z", "message": role})
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    told = [sorted(map(tuple, sessions(lines, "pi").drop("path").collect())) for lines in (json_line_ranges(spark, str(tmp_path), size=50), json_lines(spark, str(tmp_path)))]
    assert told[0] == told[1] and len(told[0]) == 6


def test_a_stream_tells_each_line_once_it_is_whole(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        lines = json_line_ranges(spark, str(source), size=5, stream=True)
        query = lines.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(str(out)).collect())

    (source / "a.jsonl").write_text('{"a": 1}\n{"a": ')
    assert run() == ['{"a": 1}']
    (source / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (source / "b.jsonl").write_text('{"b": 1}\n')
    assert run() == ['{"a": 1}', '{"a": 2}', '{"b": 1}']
    assert run() == ['{"a": 1}', '{"a": 2}', '{"b": 1}']
