"""Sources and streams: headers of image files, paged exports, files read once, batches of one effect."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.operators import report
from tessella.sources import images, ledger, runs
from tessella.streaming import sinks


def png(width, height, pad=0):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", bytes(pad)) + chunk(b"IEND", b"")


def jpeg(width, height, before=(), code=0xC0):
    segment = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    frame = segment(code, struct.pack(">BHHB", 8, height, width, 3) + bytes(9))
    return b"\xff\xd8" + b"".join(segment(0xE1, b"\xff\xc0" + bytes(n)) for n in before) + b"\xff\xff" + segment(0xDB, bytes(65)) + frame + segment(0xDA, bytes(10)) + b"\xff\xd9"


FILES = {
    "a.png": (png(640, 480, 1000), (640, 480, "png")), "b.jpg": (jpeg(1920, 1080), (1920, 1080, "jpeg")), "c.jpg": (jpeg(33, 17, (60_000, 65_000, 1), 0xC2), (33, 17, "jpeg")),
    "d.txt": (b"no image", None), "e.png": (png(1, 1)[:20], None), "f.jpg": (b"\xff\xd8\xff", None), "g.jpg": (b"\xff\xd8" + b"\xff\xda\x00\x08" + bytes(9), None), "h.png": (b"", None), "i.png": (png(0, 5), (0, 5, "png")),
}


def test_sizes_come_from_headers(spark, tmp_path):
    for name, (body, _) in FILES.items():
        (tmp_path / "sub").mkdir(exist_ok=True)
        (tmp_path / ("sub" if name == "b.jpg" else ".") / name).write_bytes(body)
    found = {r.path.rpartition("/")[2]: r for r in images.sizes(spark, str(tmp_path)).collect()}
    assert set(found) == set(FILES) - {"h.png"}
    for name, (body, want) in FILES.items():
        assert name == "h.png" or ((found[name].width, found[name].height, found[name].kind), found[name].bytes) == (want or (None, None, None), len(body))
    assert images.sizes(spark, str(tmp_path), "*.jpg").count() == 4
    content = spark.createDataFrame([(n, bytearray(b)) for n, (b, _) in FILES.items()] + [("null", None)], "path string, content binary")
    for head in (64, 1 << 16):
        again = {r.path: (r.width, r.height, r.kind) for r in images.header_sizes(content, head).collect()}
        assert again == {n: w or (None, None, None) for n, (_, w) in FILES.items()} | {"null": (None, None, None)}
    scored = {r.path: r.bpp for r in images.bits_per_pixel(images.header_sizes(content)).collect()}
    assert scored["a.png"] == round(8 * len(FILES["a.png"][0]) / (640 * 480), 9) and scored["d.txt"] is None and scored["i.png"] is None
    high = images.choose(images.header_sizes(content), 2).where("selected").orderBy("keep_rank").collect()
    assert [r.path for r in high] == ["c.jpg", "a.png"]
    assert images.choose(images.header_sizes(content), 1, "low").where("selected").first().path == "b.jpg"


def run(n, family="cs_proto", method="proto", seed=0, miou=0.5, state="finished", **more):
    config = {"dataset": {"name": "street"}, "model": {"name": "b0"}, "selection_method": method, "ratio": 1.0 if method == "full" else 0.1, "recipe": {"name": "proxy", "seed_train": seed, "lr": 1e-4, "epochs": 100}}
    return {"id": f"id{n}", "name": f"{family}_r0.1_s{seed}", "url": "", "created_at": f"2024-01-{n + 1:02d}", "state": state, "config": config, "summary": {"final/miou": miou, "_step": 10, "_runtime": 1800}} | more


def test_pages_are_read_in_batch_with_filters_and_as_a_stream(spark, tmp_path):
    runs.register(spark)
    folder, every = tmp_path / "pages", [run(0, method="full"), run(1), run(2, state="crashed"), {"id": "bare"}, run(3, summary={}), run(4, seed=1, config={})]
    folder.mkdir()
    (folder / "page-001.json").write_text(json.dumps(every[:3]))
    (folder / "page-002.json").write_text(json.dumps(every[3:]))
    (folder / "notes.txt").write_text("no page")
    (tmp_path / "all.json").write_text(json.dumps(every))
    whole = sorted(map(tuple, ledger.exported_runs(spark, str(tmp_path / "all.json")).select(*runs.COLUMNS).collect()))
    table = spark.read.format(runs.NAME).load(str(folder))
    assert sorted(map(tuple, table.collect())) == whole and table.rdd.getNumPartitions() == 2
    done = table.where("state = 'finished' AND miou IS NOT NULL AND seed IN (0, 7)")
    assert sorted(r.id for r in done.collect()) == ["id0", "id1"]
    assert table.where("miou > 0.4 AND method = 'full'").count() == 1
    out, point = str(tmp_path / "out"), str(tmp_path / "point")

    def start():
        query = spark.readStream.format(runs.NAME).load(str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    start()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == whole
    (folder / "page-003.json").write_text(json.dumps([run(9)]))
    start()
    start()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted([*(r["id"] for r in every), "id9"])
    with pytest.raises(Exception, match="needs the folder"):
        spark.read.format(runs.NAME).load().count()


def test_three_starts_read_each_file_once(spark, tmp_path):
    source, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    source.mkdir()
    extract = lambda files: images.header_sizes(files.select("path", "content"))
    for names in (["a", "b"], [], ["c"]):
        for n in names:
            (source / f"{n}.png").write_bytes(png(10, len(n)))
        sinks.extract_stream(spark, str(source), extract, out, point, "*.png").awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(r.path.rpartition("/")[2] for r in got.collect()) == ["a.png", "b.png", "c.png"] and got.select("batch").distinct().count() == 2


def test_a_ledger_batch_run_twice_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "book")
    first = spark.createDataFrame([("w1", 0.1), ("", 0.2), (None, 0.3)], "wandb_run_id string, miou double")
    again = spark.createDataFrame([("w1", 0.9)], first.schema)
    for batch, number in ((first, 0), (first, 0), (again, 1), (again, 1), (first, 0)):
        sinks.ledger_batch(batch, path, "point", number)
    sinks.ledger_batch(first.where("false"), path, "point", 2)
    sinks.ledger_batch(again, path, "another", 0)
    rows = spark.read.parquet(path)
    assert rows.count() == 5 and rows.where("timestamp IS NULL").count() == 0
    assert [(r.wandb_run_id, r.miou) for r in report.latest_ledger(rows).collect()] == [("w1", 0.9)]


def reported(spark, *found):
    table = spark.createDataFrame([runs.flat(r) for r in found], runs.SCHEMA)
    return table.select("*", F.regexp_replace("name", "_r0.*", "").alias("family"), F.lit(5).alias("n_images"))


def test_report_rows_follow_all_runs_and_a_batch_has_one_effect(spark, tmp_path):
    every, out = str(tmp_path / "runs"), str(tmp_path / "report")
    one = reported(spark, run(0, "cs_full", "full", 0, 0.8), run(1, miou=0.4), run(2, "cs_other", miou=0.2), run(3, state="crashed"))
    two = reported(spark, run(4, seed=1, miou=0.6), run(1, miou=0.4))
    sinks.report_batch(one, every, out, "point", 0)
    state = lambda: {r.family: (r.n_runs, r.miou_mean, r.retention_pct) for r in sinks.report_rows(spark, out).collect()}
    assert state() == {"cs_full": (1, 0.8, 100.0), "cs_proto": (1, 0.4, 50.0), "cs_other": (1, 0.2, 25.0)}
    for _ in range(2):
        sinks.report_batch(two, every, out, "point", 1)
        assert state()["cs_proto"] == (2, 0.5, 62.5) and state()["cs_other"] == (1, 0.2, 25.0)
    before = sorted(map(str, spark.read.parquet(out).collect()))
    sinks.report_batch(one, every, out, "point", 0)
    assert sorted(map(str, spark.read.parquet(out).collect())) == before
    one.write.parquet(str(tmp_path / "arriving"))
    for _ in range(2):
        sinks.report_stream(spark.readStream.schema(one.schema).parquet(str(tmp_path / "arriving")), str(tmp_path / "r2"), str(tmp_path / "o2"), str(tmp_path / "p2")).awaitTermination()
    assert sinks.report_rows(spark, str(tmp_path / "o2")).count() == 3
