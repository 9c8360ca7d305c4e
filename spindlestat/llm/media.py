"""Media columns on DataFrames: texts stored as JPEG files in a binary column, and features read back from such a column.

A null text counts as empty. A row whose media is null or can't be decoded stays, with null features and the reason in
`error`. Rows are worked on in slices of about half a megabyte, so memory doesn't grow with a partition;
a longer text is a slice by itself. Rows that repeat an id, or have none, stay; equal texts have equal media and features. An
empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import jpeg
from .common import raw, record, slices

SLICE = 1 << 19
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_sha256 string, feature string, error string"


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, media: the text as a JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in slices(batches, most=SLICE):
            texts = raw(batch)
            yield record(schema, doc_id=batch.column(0), n_bytes=[len(t) for t in texts], media=jpeg.encode([jpeg.padded(t) for t in texts]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features_of(media: list[bytes]) -> dict[str, list]:
    """The features of JPEG files, from their bytes alone; payload ones are of what encode() stored."""
    images = jpeg.decode(media)
    payloads, thumbs = [im.payload_bytes() for im in images], [im.thumbnail() for im in images]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {
        "payload_bytes": [len(p) for p in payloads], "payload_sha256": [sha(p) for p in payloads], "tail_crc32": [zlib.crc32(p[-64:]) for p in payloads],
        "media_bytes": [len(m) for m in media], "media_sha256": [sha(m) for m in media], "width": [im.width for im in images], "height": [im.height for im in images],
        "thumbnail_sha256": [sha(t.tobytes()) for t in thumbs], "feature": [f"{im.width}x{im.height}:{jpeg.thumbnail_hash(t)}" for im, t in zip(images, thumbs, strict=True)],
    }


def features_or_errors(media: list[bytes | None]) -> dict[str, list]:
    """features_of() with `error`; files are decoded together, and one by one only where that fails."""
    names = FEATURES.names[2:-1]
    whole = [m for m in media if m is not None]
    try:
        found = features_of(whole) if whole else {}
        each = iter(zip(*(found[n] for n in names), strict=True)) if whole else iter(())
        rows = [(*next(each), None) if m is not None else (*[None] * len(names), "no media") for m in media]
    except jpeg.JpegError:
        rows = []
        for m in media:
            try:
                rows.append((*(x[0] for x in features_of([m]).values()), None) if m is not None else (*[None] * len(names), "no media"))
            except jpeg.JpegError as e:
                rows.append((*[None] * len(names), str(e)))
    return {n: [r[k] for r in rows] for k, n in enumerate([*names, "error"])}


def features(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads a column of JPEG files (with doc_id and n_bytes) back into features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE):
            yield record(FEATURES, doc_id=batch.column(0), n_bytes=batch.column(1), **features_or_errors(batch.column(2).to_pylist()))

    return rows.select("doc_id", "n_bytes", F.col(media_col).alias("media")).mapInArrow(run, DDL)
