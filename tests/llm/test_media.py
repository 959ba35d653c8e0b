import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm import jpeg, media


def decode(data):
    image = jpeg.parse(data)
    return image, jpeg.coefficients([image])[0]


def test_payloads_survive_and_pictures_agree_with_a_plain_transform():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 5, 6, 7, 40)] + [bytes(64 * 3), b"\xff" * 640]
    files = jpeg.encode(payloads)
    images = [jpeg.parse(f) for f in files]
    coefs = jpeg.coefficients(images)
    assert [jpeg.payload_of(i, c) for i, c in zip(images, coefs)] == payloads
    assert [jpeg.encode([p])[0] for p in payloads] == files
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k + 1) * k[:, None] * np.pi / 16)
    image, coef = images[5], coefs[5]
    y = np.zeros((len(coef[0]), 64))
    y[:, jpeg.ZIGZAG] = coef[0]
    want = np.clip(np.round(basis.T @ y.reshape(-1, 8, 8) @ basis) + 128, 0, 255)
    assert np.abs(jpeg.inverse(coef[0], image.quant[0]).astype(int) - want).max() <= 1
    pictures = jpeg.pictures(images, coefs)
    assert all(p.shape == (i.height, i.width, 3) for p, i in zip(pictures, images))
    alone = jpeg.pictures([image], [coef])[0]
    assert (alone == pictures[5]).all()


class Writer:
    """Bits of a scan, most significant first, with stuffing."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def data(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")


TABLE = jpeg._table(0x10, {8: [r << 4 | s for r in range(16) for s in range(5)]})
CODES = {s: k for k, s in enumerate(TABLE[17:])}
DC = jpeg._table(0x00, {4: list(range(10))})


def magnitude(w, v):
    n = abs(v).bit_length()
    w.put(v if v >= 0 else v + (1 << n) - 1, n)


def test_sparse_blocks_with_runs_and_refinement():
    """A file written coefficient by coefficient: zero runs, runs of blocks without values, newly non-zero ones, no restarts."""
    rng = np.random.default_rng(3)
    blocks = np.where(rng.random((24, 64)) < 0.12, rng.integers(-7, 8, (24, 64)), 0)
    blocks[5:9, 1:] = 0
    blocks[10, 1:60] = 0
    blocks[10, 61] = 5
    seg = jpeg._segment
    out = [b"\xff\xd8", seg(0xDB, bytes((0, *[2] * 64))), seg(0xC2, bytes((8, 0, 30, 0, 45, 1, 7, 0x11, 0))), seg(0xC4, DC + TABLE)]
    w, last = Writer(), 0
    for b in blocks:
        d, last = int(b[0] >> 1) - last, int(b[0] >> 1)
        w.put(abs(d).bit_length(), 4)
        magnitude(w, d)
    out += [seg(0xDA, bytes((1, 7, 0, 0, 0, 0x01))), w.data()]
    shifted = np.sign(blocks) * (np.abs(blocks) >> 1)
    w, empty = Writer(), 0

    def flush():
        nonlocal empty
        if empty:
            n = empty.bit_length() - 1
            w.put(CODES[n << 4], 8)
            w.put(empty - (1 << n), n)
            empty = 0

    for b in shifted[:, 1:]:
        place = np.flatnonzero(b)
        if len(place):
            flush()
        at = 0
        for p in place:
            run = p - at
            while run > 15:
                w.put(CODES[0xF0], 8)
                run -= 16
            w.put(CODES[run << 4 | abs(int(b[p])).bit_length()], 8)
            magnitude(w, int(b[p]))
            at = p + 1
        if at < 63:
            empty += 1
    flush()
    out += [seg(0xDA, bytes((1, 7, 0, 1, 63, 0x01))), w.data()]
    w = Writer()
    for full, old in zip(blocks[:, 1:], shifted[:, 1:]):
        fresh = [k for k in range(63) if old[k] == 0 and full[k] != 0]
        at, held = 0, []
        for k in [*fresh, None]:
            if k is None:
                if at < 63:
                    w.put(CODES[0], 8)
                    for j in range(at, 63):
                        if old[j]:
                            w.put(abs(int(full[j])) & 1, 1)
                break
            zeros, held = 0, []
            for j in range(at, k):
                if old[j]:
                    held.append(abs(int(full[j])) & 1)
                else:
                    zeros += 1
                    if zeros == 16:
                        w.put(CODES[0xF0], 8)
                        for x in held:
                            w.put(x, 1)
                        zeros, held = 0, []
            w.put(CODES[zeros << 4 | 1], 8)
            w.put(int(full[k] > 0), 1)
            for x in held:
                w.put(x, 1)
            at = k + 1
    out += [seg(0xDA, bytes((1, 7, 0, 1, 63, 0x10))), w.data()]
    w = Writer()
    for b in blocks:
        w.put(int(b[0]) & 1, 1)
    out += [seg(0xDA, bytes((1, 7, 0, 0, 0, 0x10))), w.data(), b"\xff\xd9"]
    image, coef = decode(b"".join(out))
    assert (image.width, image.height) == (45, 30)
    assert (coef[0] == blocks).all()
    assert jpeg.pictures([image], [coef])[0].shape == (30, 45, 3)


def test_broken_files_are_refused():
    data = jpeg.encode([bytes(range(64))])[0]
    for bad in (b"", b"GIF89a", data[:100], data.replace(b"\xff\xc2", b"\xff\xc0"), data[:-60] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            decode(bad)


def test_round_trip_of_texts(spark):
    texts = [None, "", "a", "é😀" * 31, "x" * 64, "y" * 128, "long \xff text\n" * 60000, "a"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    back = {r["doc_id"]: r for r in media.decoded(media.encoded(df)).collect()}
    short = {r["doc_id"]: r for r in media.digests(df).collect()}
    for i, t in enumerate(texts):
        n, payload = media.padded(t)
        assert len(payload) % 64 == 0 and len(payload) >= max(64, n)
        r, s = back[i], short[i]
        assert bytes(r["payload"]) == payload and r["n_bytes"] == n and len(r["tensors"]) == -(-len(payload) // media.FRAME)
        assert all(len(x["rgb"]) == 3 * x["height"] * x["width"] for x in r["tensors"])
        assert (s["payload_sha256"], s["tail_crc32"], s["feature"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), r["feature"])
        assert s["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    assert [short[2][c] for c in ("media_sha256", "feature")] == [short[7][c] for c in ("media_sha256", "feature")]
    assert media.digests(df.limit(0)).count() == 0


def test_null_ids_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "other", "x"), (None, "a", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string").withColumn("MEDIA", F.lit(1)).withColumn("n_bytes", F.lit("z"))
    out = media.digests(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in out) == [(0, 0), (0, 1), (1, 1), (1, 1), (1, 5)]
    assert len({r["media_sha256"] for r in out if r["n_bytes"] == 1}) == 1
    assert media.decoded(media.encoded(df)).count() == 5 and media.decoded(media.encoded(df.limit(0))).count() == 0
