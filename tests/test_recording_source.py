"""The recording data source: splits, archives, broken files, and streams that are run again."""

import io
import random
import zipfile

from contrail.sources import recorder, recordings


def text(n, seed=1):
    r = random.Random(seed)
    lines = [b"FileType=text", b"", b"  padded \r", "Ünï,cödé".encode(), b"bad \xff byte"]
    for i in range(n):
        lines.append(f"#{i * 0.5}".encode() if r.random() < 0.2 else f"{r.randint(1, 5)},T={r.random()}|{r.random()}|{i}|||".encode())
    return b"\n".join(lines)


def read(spark, path, **options):
    spark.dataSource.register(recordings.Recordings)
    rows = spark.read.format("recording").options(path=str(path), **options).load().collect()
    return sorted(tuple(r) for r in rows if r["error"] is None), [r for r in rows if r["error"] is not None]


def whole(path, data):
    out, at = [], 0
    for raw in io.BytesIO(data):
        out.append((str(path), at, raw.decode("utf-8", "ignore").strip(), None))
        at += len(raw)
    return out


def test_any_ranges_give_the_whole(spark, tmp_path):
    """Every range size, down to single bytes, gives each line once; also when chunks are smaller than lines."""
    for data in (text(40), text(40) + b"\n", b"", b"\n\n", b"no end"):
        path = tmp_path / "a.acmi"
        path.write_bytes(data)
        for size in (1, 7, 64, 10_000):
            got = [x for p in recordings.ranges(str(path), 0, len(data), size) for b in recordings.read_part(p, "first") for x in b.to_pylist()]
            assert [tuple(r.values()) for r in got] == whole(path, data), size
    path.write_bytes(text(300))
    assert read(spark, path, splitBytes=500)[0] == whole(path, text(300))


def test_small_chunks(monkeypatch, tmp_path):
    monkeypatch.setattr(recordings, "_CHUNK", 3)
    path = tmp_path / "a.acmi"
    path.write_bytes(text(10))
    got = [x for p in recordings.ranges(str(path), 0, len(text(10)), 50) for b in recordings.read_part(p, "first") for x in b.to_pylist()]
    assert [tuple(r.values()) for r in got] == whole(path, text(10))
    assert recordings.whole_lines(str(path), len(text(10))) == text(10).rfind(b"\n") + 1


def test_archives_and_broken_files(spark, tmp_path):
    for name, members in (("two.zip", {"x.acmi": text(20, 2), "y.acmi": text(30, 3), "readme.txt": b"no"}), ("none.zip", {"readme.txt": b"no"})):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            for m, data in members.items():
                z.writestr(m, data)
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 and nothing more")
    (tmp_path / "_hidden").write_bytes(b"left out")
    (tmp_path / "plain.acmi").write_bytes(text(15, 4))
    two = tmp_path / "two.zip"
    rows, errors = read(spark, tmp_path)
    assert rows == sorted(whole(tmp_path / "plain.acmi", text(15, 4)) + whole(two, text(20, 2)))
    assert sorted(e["file"].rsplit("/", 1)[1] for e in errors) == ["broken.zip", "none.zip"]
    rows, errors = read(spark, tmp_path, members="all")
    assert rows == sorted(whole(tmp_path / "plain.acmi", text(15, 4)) + whole(f"{two}!x.acmi", text(20, 2)) + whole(f"{two}!y.acmi", text(30, 3)))
    cut = two.read_bytes()
    (tmp_path / "cut.zip").write_bytes(cut[:40] + b"\0" * 20 + cut[60:])  # a member that does not inflate
    assert any(e["file"].endswith("cut.zip") for e in read(spark, tmp_path)[1])


def test_splits_feed_telemetry(spark, tmp_path):
    """Frames of a recording read in splits are those of the recording read as one file."""
    path = tmp_path / "a.acmi"
    path.write_bytes(text(400, 5))
    spark.dataSource.register(recordings.Recordings)
    split = spark.read.format("recording").option("path", str(path)).option("splitBytes", 900).load()
    frames = lambda lines: sorted((r["frame_no"], r["frame_t"], r["obj_id"], r["lon"], r["alt"]) for r in recorder.telemetry(lines, block=300).collect())
    assert frames(split) == frames(recorder.read_recordings(spark, str(path))) != []


def test_stream_gives_each_line_once(spark, tmp_path):
    """A growing file: lines come when they are complete, a restart goes on from the checkpoint, and a batch that is read
    again from its offsets gives the same rows."""
    spark.dataSource.register(recordings.Recordings)
    data, path = text(60, 6) + b"\n", tmp_path / "in" / "a.acmi"
    path.parent.mkdir()
    cuts = [0, 37, 500, 501, len(data)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        with path.open("ab") as f:
            f.write(data[a:b])
        stream = spark.readStream.format("recording").option("path", str(path.parent)).option("splitBytes", 100).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(60)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == whole(path, data)
    reader = recordings.StreamReader({"path": str(path.parent), "splitbytes": 100})
    again = [tuple(x.values()) for p in reader.partitions({str(path): got[9][1]}, reader.latestOffset()) for b in reader.read(p) for x in b.to_pylist()]
    assert again == got[9:]
