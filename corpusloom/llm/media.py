"""Media columns: texts stored as progressive JPEG files, and what is read back from them."""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .shared import add_columns
from .words import text_bytes


def store_texts(documents: DataFrame) -> DataFrame:
    """documents with n_bytes and media: the text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a file.

    A null text is empty, a repeated row is stored each time, a payload too long for one image becomes several, one after
    another, and an empty table gives an empty result. Other columns pass through; columns named like the added ones give way.
    """

    def prepare():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            flat, bounds = text_bytes(part.column("text"))
            raw = flat.tobytes()
            texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            payloads = [t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts]
            return [pa.array([len(t) for t in texts], pa.int64()), pa.array(jpeg.write(payloads) if payloads else [], pa.binary())]

        return work

    return add_columns(documents.withColumn("text", F.col("text").cast("string")), prepare, {"n_bytes": "long", "media": "binary"})


def describe(image: np.ndarray) -> str:
    """Size, mean colour, and mean absolute difference between rows and between columns, in whole thousandths."""
    n = image.shape[0] * image.shape[1]
    means = image.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // n
    green = image[:, :, 1].astype(np.int16)
    down = int(np.abs(np.diff(green, axis=0)).sum(dtype=np.int64)) * 1000 // max(1, n)
    across = int(np.abs(np.diff(green, axis=1)).sum(dtype=np.int64)) * 1000 // max(1, n)
    return ";".join(map(str, (image.shape[0], image.shape[1], *means.tolist(), down, across)))


#: What a broken file makes a decoder raise: its own finding, or a place, table or size that isn't there.
BROKEN = (ValueError, IndexError, KeyError, TypeError, OverflowError, ZeroDivisionError, AttributeError, EOFError, struct.error, MemoryError)


def decoded(files: list[bytes | None]) -> tuple[list[bytes | None], list[np.ndarray | None]]:
    """Payloads and RGB pixels of progressive files: store_texts' all at once, any others scan by scan, without a payload.

    A null, and a file that can't be decoded, has neither.
    """
    try:
        return jpeg.read(files)  # type: ignore[arg-type, return-value]
    except BROKEN:
        pass
    payloads: list[bytes | None] = []
    images: list[np.ndarray | None] = []
    for data in files:
        own, image = None, None
        try:
            read, pixels = jpeg.read([data])  # type: ignore[list-item]
            own, image = read[0], pixels[0]
        except BROKEN:
            with contextlib.suppress(*BROKEN):
                image = jpeg.pixels(jpeg.coefficients(data)) if data else None
        payloads.append(own)
        images.append(image if image is not None and image.size else None)
    return payloads, images


def load_media(stored: DataFrame, with_pixels: bool = True) -> DataFrame:
    """(doc_id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from stored files.

    Each file is decoded scan by scan to coefficients, and these give both the payload and RGB pixels; with_pixels adds
    height, width and rgb (rows of 3 bytes a pixel). Needs doc_id, n_bytes and media; progressive files of other writers are
    read too, with a null payload. An empty file and one that is cut short or broken have media_bytes and media_sha256 only,
    a null has nulls; neither stops the rows beside it. A row of media is a row here, whatever its doc_id, and repeated rows
    are decoded each; other columns of stored are left out, and an empty table gives an empty result.
    """
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    kinds |= {"height": "int", "width": "int", "rgb": "binary"} if with_pixels else {}

    def run(batches):
        for batch in batches:
            files, at = batch.column("media").to_pylist(), 0
            while at < len(files):
                to, held = at, 0
                while to < len(files) and (to == at or held < 2_000_000):
                    held += len(files[to] or b"")
                    to += 1
                some = files[at:to]
                payloads, images = decoded(some)
                rows = [(*((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) if p is not None else (None, None, None)), *((len(f), hashlib.sha256(f).hexdigest()) if f is not None else (None, None)), None if i is None else describe(i)) for p, f, i in zip(payloads, some, images, strict=True)]
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(types)]
                if with_pixels:
                    columns += [*(pa.array([None if i is None else i.shape[k] for i in images], pa.int32()) for k in (0, 1)), pa.array([None if i is None else i.tobytes() for i in images], pa.binary())]
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *([part.column("media")] if with_pixels else []), *columns], ["doc_id", "n_bytes", *(["media"] if with_pixels else []), *kinds])
                at = to

    schema = "doc_id long, n_bytes long, " + "media binary, " * with_pixels + ", ".join(f"{k} {v}" for k, v in kinds.items())
    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInArrow(run, schema)
