"""BPE, JPEG, WARC: exact round trips and the public libraries."""

import gzip
import hashlib
import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from contrail.llm import bpe, jpeg, warc
from contrail.llm.queries import op2_warc, op5_bpe, op7_media

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "héllo wörld 日本語 🎉🎉 \u3000 x\n\n", "a" * 3000, "ab" * 500, "don't we'll  \t\n stop", "\x00\x01", "x" * 70_000]


@pytest.fixture(scope="module")
def vocab():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def public(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: i for i, v in enumerate(vocab)}, special_tokens={})


def test_perfect_hash_is_minimal(vocab):
    table = bpe.PerfectHash.build(vocab)
    assert sorted(table.ids.tolist()) == list(range(len(vocab)))
    assert all(table.candidate(v) == i for i, v in enumerate(vocab))


def test_bpe_equals_public_library(vocab, public):
    b = bpe.Bpe(vocab, public_tokenizers.PATTERN)
    for t in TEXTS:
        assert b.encode(t) == public.encode_ordinary(t)
        assert b.decode(b.encode(t)) == t.encode()


def test_bpe_query(spark, public):
    rows = {r["doc_id"]: r for r in op5_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = public.encode_ordinary(d["text"] or "")
        assert rows[d["doc_id"]]["n_tokens"] == len(ids)
        assert rows[d["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[d["doc_id"]]["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_bpe_odd_rows(spark, vocab):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a")], "doc_id long, text string").selectExpr("*", "1 as k", "2 as t", "3 as ids")
    got = bpe.encode(df, vocab, public_tokenizers.PATTERN).collect()
    assert sorted(len(r["ids"]) for r in got) == [0, 0, 0, 1]
    assert bpe.encode(df.limit(0), vocab, public_tokenizers.PATTERN).count() == 0


def test_jpeg_store_is_lossless():
    payloads = [jpeg.padded(os.urandom(n)) for n in (0, 1, 63, 64, 65, 5000, 70_000)] + [jpeg.padded(bytes(range(256)) * 5)]
    files = jpeg.store(payloads)
    assert [jpeg.payload_of(i) for i in jpeg.decode(files)] == payloads
    assert jpeg.payload_of(jpeg.decode(files[3:4])[0]) == payloads[3]
    assert files[5] == jpeg.store([payloads[5]])[0]


def encode_grey(pixels, restart=0, runs=True):
    """A plain baseline encoder of the test's own: DCT by matrix, standard-like tables from code lengths, zero runs and EOB."""
    h, w = pixels.shape
    n = np.arange(8)
    dct = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(1 / 8), 0.5)
    zz = jpeg.zigzag()
    dc = {s: 4 for s in range(12)}
    ac = {(r << 4) | s: 8 for r in range(16) for s in range(1, 11)} | {0: 4, 0xF0: 8}
    tables, out = {}, b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\2" * 64) + jpeg._segment(0xC0, bytes([8, h >> 8, h & 255, w >> 8, w & 255, 1, 1, 0x11, 0]))
    for cls, lengths in ((0, dc), (1, ac)):
        tables[cls] = jpeg._codes(lengths)
        by = [[s for s in sorted(lengths) if lengths[s] == k] for k in range(1, 17)]
        out += jpeg._segment(0xC4, bytes([cls << 4]) + bytes(map(len, by)) + bytes(s for r in by for s in r))
    if restart:
        out += jpeg._segment(0xDD, bytes([0, restart]))
    out += jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    bits, data, pred, k, coefficients = "", b"", 0, 0, []

    def amp(v, s):
        return format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    def flush():
        b = bits + "1" * (-len(bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")

    for y in range(0, h, 8):
        for x in range(0, w, 8):
            if restart and k and k % restart == 0:
                data += flush() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
                bits, pred = "", 0
            q = np.round(dct @ (pixels[y : y + 8, x : x + 8] - 128.0) @ dct.T / 2).astype(int).ravel()[zz]
            coefficients.append(q)
            for i, v in enumerate(q):
                if i == 0:
                    d, pred = int(v) - pred, int(v)
                    s = abs(d).bit_length()
                    bits += format(tables[0][s][0], f"0{tables[0][s][1]}b") + amp(d, s)
                    run = 0
                elif v == 0:
                    run += 1
                else:
                    while run > 15:
                        bits += format(tables[1][0xF0][0], f"0{tables[1][0xF0][1]}b")
                        run -= 16
                    s = abs(int(v)).bit_length()
                    code, m = tables[1][run << 4 | s]
                    bits += format(code, f"0{m}b") + amp(int(v), s)
                    run = 0
            if run:
                bits += format(tables[1][0][0], f"0{tables[1][0][1]}b")
            k += 1
    return out + data + flush() + b"\xff\xd9", np.array(coefficients)


def test_zigzag():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_jpeg_decodes_ordinary_files(restart):
    rng = np.random.default_rng(1)
    pixels = np.clip(np.add.outer(np.arange(32) * 3, np.arange(48) * 2) + rng.normal(0, 9, (32, 48)), 0, 255)
    data, want = encode_grey(pixels, restart)
    image = jpeg.decode([data])[0]
    assert (image.width, image.height) == (48, 32) and (image.components[0].coefficients == want).all()
    means = pixels.reshape(4, 8, 6, 8).mean(axis=(1, 3))
    assert np.abs(jpeg.thumbnail(image).astype(float) - means).max() < 1.5


def encode_colour(blocks, width, height, scans, wide_quants):
    """A file of three components, luminance at twice the resolution; blocks[c][y, x] holds a DC and one AC coefficient.

    ``scans``: the components of each scan."""
    symbols = {0: list(range(12)), 1: [0, 1, 2, 3, 4, 5, 6]}  # DC sizes; end of block and the next coefficient's size
    code = lambda cls, s: format(symbols[cls].index(s), "04b")  # noqa: E731  all codes have four bits
    amp = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    quants = b"\x10" + b"\x01\x2c" * 64 if wide_quants else b"\0" + b"\3" * 64
    out = b"\xff\xd8" + jpeg._segment(0xDB, quants) + jpeg._segment(0xC0, bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    for cls, own in symbols.items():
        out += jpeg._segment(0xC4, bytes([cls << 4, 0, 0, 0, len(own)] + [0] * 12 + own))
    shape = {0: (2, 2), 1: (1, 1), 2: (1, 1)}
    for own in scans:
        out += jpeg._segment(0xDA, bytes([len(own), *[x for c in own for x in (c + 1, 0)], 0, 63, 0]))
        if len(own) == 1:
            v, h = shape[own[0]]
            rows, columns = -(-(-(-height * v // 2)) // 8), -(-(-(-width * h // 2)) // 8)
            order = [(own[0], y, x) for y in range(rows) for x in range(columns)]
        else:
            order = [(c, y * shape[c][0] + j, x * shape[c][1] + i) for y in range(-(-height // 16)) for x in range(-(-width // 16)) for c in own for j in range(shape[c][0]) for i in range(shape[c][1])]
        bits, pred = "", {c: 0 for c in own}
        for c, y, x in order:
            dc, ac = (int(n) for n in blocks[c][y, x])
            d, pred[c] = dc - pred[c], dc
            bits += code(0, abs(d).bit_length()) + amp(d) + (code(1, abs(ac).bit_length()) + amp(ac) if ac else "") + code(1, 0)
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    return out + b"\xff\xd9"


@pytest.mark.parametrize("scans", [[(0, 1, 2)], [(0,), (1,), (2,)], [(0,), (1, 2)]])
@pytest.mark.parametrize("wide_quants", [False, True])
def test_jpeg_colour_subsampling_and_scans(scans, wide_quants):
    rng = np.random.default_rng(3)
    width, height = 40, 24
    blocks = [np.stack([rng.integers(-300, 300, s), rng.integers(-60, 60, s)], axis=-1) for s in ((4, 6), (2, 3), (2, 3))]
    grey = encode_grey(np.full((16, 16), 77.0), 0)[0]
    image, other = jpeg.decode([encode_colour(blocks, width, height, scans, wide_quants), grey])
    for i, c in enumerate(image.components):
        seen = np.zeros(blocks[i].shape[:2], bool)
        seen[: -(-height * c.v // 16), : -(-width * c.h // 16)] = True  # a scan of one component has no blocks beyond the image
        got = c.coefficients.reshape(c.high, c.wide, 64)
        assert (got[seen][:, :2] == blocks[i][seen]).all() and not got[..., 2:].any()
    pixels = np.clip(np.round(blocks[0][..., 0] * (300 if wide_quants else 3) / 8 + 128), 0, 255)
    assert (jpeg.thumbnail(image)[:3, :5] == pixels[:3, :5]).all()
    assert (jpeg.thumbnail(other) == 77).all()


@pytest.mark.parametrize("shape", [(1, 1), (3, 50), (8, 9), (37, 5), (100, 80)])
def test_thumbnail_hashes_against_brute_force(shape):
    pixels = np.random.default_rng(5).integers(0, 256, shape).astype(np.uint8)

    def cells(high, wide):
        cut = lambda i, n, size: (i * size // n, max(-(-(i + 1) * size // n), i * size // n + 1))
        return [[np.mean([float(pixels[y, x]) for y in range(*cut(i, high, shape[0])) for x in range(*cut(j, wide, shape[1]))]) for j in range(wide)] for i in range(high)]

    def hexed(bits):
        return "".join(format(int("".join("1" if b else "0" for b in bits[i : i + 4]), 2), "x") for i in range(0, 64, 4))

    mean, step = cells(8, 8), cells(8, 9)
    total = np.mean(mean)
    average = hexed([v > total for row in mean for v in row])
    difference = hexed([b > a for row in step for a, b in zip(row, row[1:])])
    assert jpeg.thumbnail_hashes(pixels) == (average, difference)


def test_jpeg_rejects_and_mixes(spark):
    good = jpeg.store([b"a" * 64])[0]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None), (4, bytearray(good[:-10])), (None, bytearray(good))], "doc_id long, media binary")
    rows = jpeg.features(df.selectExpr("*", "1 as k", "2 as m")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["payload_sha256"] == by[None]["payload_sha256"] == hashlib.sha256(b"a" * 64).hexdigest()
    assert by[2]["width"] is None and by[3]["media_bytes"] is None and len(rows) == 5


def test_media_query(spark):
    rows = {r["doc_id"]: r for r in op7_media(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert {r["n_bytes"] for r in jpeg.store_column(odd).collect()} == {0}
    assert jpeg.store_column(odd.limit(0)).count() == 0


def test_warc_records_and_index(spark):
    big = "<p>" + "x" * 2000
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "http://c/", "small"), (5, "u", "small"), (None, "n", big), (7, "é", "é" * 600), (7, "é", "é" * 600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'q' as digest", "1 as n", "2 as p", "3 as payload")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    archives, index = warc.archive(df, archive_bytes=3000)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    rows = warc.read(archives).collect()
    assert sorted(map(str, warc.read(archives, index).collect())) == sorted(map(str, rows))
    assert len(rows) == len(pages)
    by = {r["page_id"]: r for r in rows if r["page_id"] is not None}
    assert (by[1]["record_type"], by[1]["refers_to"], by[1]["payload_bytes"]) == ("revisit", 2, len(big))
    assert by[2]["record_type"] == "response" and by[3]["payload_bytes"] == 0 and by[4]["record_type"] == by[5]["record_type"] == "response"
    assert [r["record_type"] for r in rows if r["page_id"] == 7] == ["response"] * 2
    assert [r["record_type"] for r in rows if r["page_id"] is None] == ["revisit"]
    places = index.collect()
    assert len({(p["name"], p["offset"]) for p in places}) == len(pages)
    for a in archives.collect():
        content, own = bytes(a["content"]), sorted((p["offset"], p["length"], p["record_id"]) for p in places if p["name"] == a["name"])
        assert gzip.GzipFile(fileobj=io.BytesIO(content)).read().count(b"WARC/1.1\r\n") == len(own)
        assert [at for at, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) == len(content)
        for at, n, name in own:
            data = gzip.decompress(content[at : at + n])
            assert data.startswith(b"WARC/1.1\r\n") and warc.headers(data)["warc-record-id"] == name
    one = warc.read(archives, index.where("record_id = '<urn:page:3>'")).collect()
    assert [(r["page_id"], r["payload_bytes"], bytes(r["payload"])) for r in one] == [(3, 0, b"")]
    archives, index = warc.archive(df.limit(0))
    assert warc.read(archives, index).count() == warc.read(archives).count() == index.count() == 0


def test_warc_batches_and_large_pages(spark):
    """Pages over the archive size, and readers that run under other batch sizes than the writers."""
    df = spark.createDataFrame([(i, f"http://a/{i}", "<p>" + str(i) * 50_000) for i in range(10)], "page_id long, url string, html string").coalesce(1)
    archives, index = warc.archive(df, archive_bytes=1000)
    assert archives.count() == 10
    got, before = warc.read(archives, index), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        assert sorted((r["page_id"], r["payload_bytes"]) for r in got.collect()) == [(i, 50_003) for i in range(10)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_split_records_over_any_members():
    data = [warc.record(i, None, os.urandom(i * 50), "d", None) for i in range(20)]
    one, each = gzip.compress(b"".join(data)), b"".join(map(gzip.compress, data))
    for piece in (1, 7, 100, 1 << 20):
        assert list(warc.split_records(one, piece)) == data and list(warc.split_records(each, piece)) == data
    with pytest.raises(ValueError):
        list(warc.split_records(gzip.compress(data[5][:-9])))


def test_warc_query(spark):
    assert op2_warc(spark, SF).count() == 50
