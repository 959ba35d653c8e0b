"""Texts stored losslessly as media columns: progressive JPEG frames, decoded to full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import jpeg
from .textkit import slices

#: Payload bytes of one frame at most, a multiple of 64; a longer payload is a sequence of frames.
FRAME = 1 << 18


def padded(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and these with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % 64 or 64 * (not data))


def stored(payloads: list[bytes]) -> list[bytes]:
    """Each payload's frames, one JPEG file behind the other."""
    parts = [[p[at : at + FRAME] for at in range(0, len(p), FRAME)] for p in payloads]
    files = iter(jpeg.encode([x for own in parts for x in own]) if payloads else ())
    return [b"".join(next(files) for _ in own) for own in parts]


def frames(media: bytes) -> list[bytes]:
    """The files of a sequence; inside a file an end marker cannot occur."""
    return [x + b"\xff\xd9" for x in media.split(b"\xff\xd9")[:-1]]


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in slices(batches, most=1 << 20):
        sizes, payloads = zip(*map(padded, rows["text"]))
        yield pd.DataFrame({"doc_id": rows["doc_id"], "n_bytes": sizes, "media": stored(payloads)})


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of docs (doc_id, text): the stored form.

    Null texts count as empty, a text of any length is stored whole; null ids and repeated rows stay, each row by itself;
    other columns go, whatever their names; an empty table gives no rows.
    """
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInPandas(_encode, "doc_id bigint, n_bytes bigint, media binary")


def _decoder(tensors: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, ends = 0, np.cumsum(batch["media"].str.len().to_numpy(np.int64))
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), "right")))
                rows, at = batch.iloc[at:end], end
                yield pd.DataFrame([_decoded(*r, tensors) for r in _pictures(rows)], columns=["doc_id", "n_bytes", "media", "payload", "feature", *["tensors"] * tensors])

    return run


def _pictures(rows: pd.DataFrame) -> Iterator[tuple]:
    """doc_id, n_bytes, media and the (payload, picture) of each frame; frames are decoded together, about 1 MB at a time."""
    split, done, held, size = [frames(m) for m in rows["media"]], [], [], 0
    files = [f for x in split for f in x]
    owner = iter([k for k, x in enumerate(split) for _ in x])
    keys, at = list(zip(rows["doc_id"], rows["n_bytes"], rows["media"])), 0
    own: list = []
    for k, f in enumerate(files):
        held.append(jpeg.parse(f))
        size += len(f)
        if size > 1 << 20 or k == len(files) - 1:
            coefs = jpeg.coefficients(held)
            done += zip(map(jpeg.payload_of, held, coefs), jpeg.pictures(held, coefs))
            held, size = [], 0
            for x in done:
                if next(owner) != at:
                    yield *keys[at], own
                    at, own = at + 1, []
                own.append(x)
            done = []
    if own:
        yield *keys[at], own


def _decoded(doc_id, n_bytes, media, parts, tensors: bool) -> tuple:
    sums, pixels, kept = np.zeros(3, np.int64), 0, []
    for _, picture in parts:
        sums += picture.reshape(-1, 3).sum(0, dtype=np.int64)
        pixels += picture.shape[0] * picture.shape[1]
        if tensors:
            kept.append({"height": picture.shape[0], "width": picture.shape[1], "rgb": picture.tobytes()})
    feature = f"{len(parts)}x{parts[0][1].shape[1]}x{parts[0][1].shape[0]}:" + ",".join(str(x * 1000 // pixels) for x in sums.tolist())
    return (doc_id, n_bytes, media, b"".join(p for p, _ in parts), feature, *([kept] if tensors else []))


TENSORS = "tensors array<struct<height:int,width:int,rgb:binary>>"


def decoded(media: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, media, payload, feature and, unless told otherwise, the RGB tensors of all frames.

    Everything is read from the stored bytes: the payload from the coefficients, the feature (number and size of frames,
    mean of R, G and B in thousandths) from the RGB pictures. Rows are read one by one, so null ids and repeated rows stay;
    other columns go; an empty table gives no rows; bytes that are no progressive file raise ValueError or IndexError.
    """
    schema = "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInPandas(_decoder(tensors), f"{schema}, {TENSORS}" if tensors else schema)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encoding = _encode(batches)
    for rows in _decoder(False)(encoding):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        yield pd.DataFrame(
            {
                "doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "payload_bytes": rows["payload"].str.len(), "payload_sha256": rows["payload"].map(sha),
                "tail_crc32": rows["payload"].map(lambda x: zlib.crc32(x[-64:])), "media_bytes": rows["media"].str.len(), "media_sha256": rows["media"].map(sha), "feature": rows["feature"],
            }
        )


def digests(docs: DataFrame) -> DataFrame:
    """Both steps in one pass over docs, with digests instead of payloads, media and tensors; cases as in encoded()."""
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInPandas(_digest, schema)
