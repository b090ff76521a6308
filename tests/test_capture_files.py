"""Captures from folders, in batch and as a stream; broken lines do not stop the scan."""

import json

import pytest

from sieveline.sources.capture_files import capture_report, captured_lines, captured_nodes, read_captures
from sieveline.sources.html import html_nodes


def page(i):
    return {"capture_id": i, "url": f"http://x/{i}", "html": f"<html><body><h1>Title {i}</h1><p>one<a href='#'>go é</a></p></body></html>"}


def word(text, x, confidence=90.0):
    return {"text": text, "confidence": confidence, "bbox": {"x0": x, "y0": 0, "x1": x + 9, "y1": 5}}


BROKEN = ['{"capture_id": 7, "html": "<p>cut', "no json", "[1, 2]", '{"capture_id": "x", "html": "<p>"}', '{"html": "<p>without id</p>"}', '{"capture_id": 8}', "null", "\x00\x01"]


@pytest.fixture
def folder(tmp_path):
    good = [json.dumps(page(i)) for i in range(40)]
    (tmp_path / "a.jsonl").write_text("\n".join([*good[:20], *BROKEN, "", "   "]))
    (tmp_path / "b.jsonl").write_text("\n".join(good[20:]) + "\n")
    (tmp_path / "c.jsonl").write_bytes(b"\x89PNG\r\xff\xfe\x00 not text at all")
    (tmp_path / "d.jsonl").write_text("")
    return tmp_path


def test_batch_reads_what_is_whole_and_keeps_what_is_not(spark, folder):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # ranges end inside records
    try:
        records = read_captures(spark, f"file://{folder}", "pages")
        assert records.rdd.getNumPartitions() > 5
        rows = records.collect()
        nodes = captured_nodes(records).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.capture_id for r in rows if r.malformed is None) == list(range(40))
    assert {r.malformed for r in rows if r.malformed is not None} >= set(BROKEN) and all(r.html is None and r.capture_id is None for r in rows if r.malformed is not None)
    want = html_nodes(spark.createDataFrame([(i, page(i)["html"]) for i in range(40)], "capture_id long, html string"), "capture_id", "html").collect()
    assert sorted(map(str, nodes)) == sorted(map(str, want)) and nodes
    report = {r.file.rsplit("/", 1)[1]: (r.records, r.malformed) for r in capture_report(read_captures(spark, f"file://{folder}", "pages")).collect()}
    assert report["a.jsonl"] == (20, len(BROKEN)) and report["b.jsonl"] == (20, 0) and report["c.jsonl"][0] == 0 and report["c.jsonl"][1] > 0


def test_stream_gives_what_batch_gives(spark, folder, tmp_path_factory):
    state, seen = tmp_path_factory.mktemp("state"), []
    for name in ("late.jsonl", None):
        stream = captured_nodes(read_captures(spark, f"file://{folder}", "pages", stream=True, maxFilesPerTrigger="1"))
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(state)).option("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false").trigger(availableNow=True).start()
        query.awaitTermination(120)
        if name:
            (folder / name).write_text(json.dumps(page(99)) + "\nbroken")
    want = captured_nodes(read_captures(spark, f"file://{folder}", "pages")).collect()
    assert sorted(map(str, seen)) == sorted(map(str, want)) and any("99" in str(r) for r in seen)


def test_recognised_blocks_become_lines(spark, tmp_path):
    line = lambda *words: {"words": list(words)}
    record = {"capture_id": 1, "image": "i", "blocks": [{"paragraphs": [{"lines": [line(word("PAN", 0), word(" ", 10), word("AAACR5055K", 20)), line(word("smudge", 0, 2.0))]}]}, {"paragraphs": [{"lines": [line(word("second", 0))]}]}]}
    (tmp_path / "x.jsonl").write_text(json.dumps(record) + "\n" + json.dumps({"capture_id": 2, "blocks": []}) + '\n{"capture_id": 3, "blocks": "no"}\n')
    records = read_captures(spark, f"file://{tmp_path}", "blocks")
    rows = [(r.capture_id, r.block_id, r.line_no, r.text, len(r.words), r.x0, r.x1) for r in captured_lines(records).orderBy("capture_id", "block_id", "line_no").collect()]
    assert rows == [(1, 0, 0, "PAN AAACR5055K", 2, 0.0, 29.0), (1, 1, 0, "second", 1, 0.0, 9.0)]
    assert records.where("malformed is not null").count() == 1
