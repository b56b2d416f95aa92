"""Media columns: texts stored as lossless WebP images, and the images read back into pixel arrays.

A text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, are samples of images of 64 columns; texts over
4,096 pixels take several files that follow each other, so no image, and no step of the decoder, grows with the longest
text. A null text counts as empty (one row of blanks). Repeated rows and ties are kept, other columns pass through (one
with the name of an added column gives way to it, in any case), an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from mediaframe.llm import _text as T

RUN_BYTES = 2 << 20


def _appended(b: pa.RecordBatch, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *columns.values()], [*b.schema.names, *columns])


def _without(df: DataFrame, kept: str, *added: str) -> DataFrame:
    taken = {a.lower() for a in added}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c == kept or c.lower() not in taken])


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds media (binary, the WebP files) and n_bytes (long, of the text) and drops text."""
    df = _without(df, text, media, "n_bytes")
    at = df.columns.index(text)
    fields = [f for f in df.schema.fields if f.name != text] + [StructField(media, BinaryType()), StructField("n_bytes", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mediaframe.llm.webp import encode_samples

        for b in batches:
            data, offsets = T.text_buffer(b.column(at))
            for i, j in T.runs(offsets, RUN_BYTES):
                payloads = []
                for x, y in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True):
                    n = max(192, y - x + -(y - x) % 192)
                    p = np.full(n, 32, np.uint8)
                    p[: y - x] = data[x:y]
                    payloads.append(p)
                kept = [c.slice(i, j - i) for k, c in enumerate(b.columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(encode_samples(payloads), pa.binary()), pa.array(np.diff(offsets[i : j + 1]))], [f.name for f in fields])

    return df.mapInArrow(run, StructType(fields))


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds pixels (binary: red, green and blue of every pixel, file after file, row by row) and feature (string: rows x columns, mean and standard deviation of the samples, and a histogram of 8 bins)."""
    df = _without(df, media, "pixels", "feature")
    at = df.columns.index(media)
    schema = StructType([*df.schema.fields, StructField("pixels", BinaryType()), StructField("feature", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mediaframe.llm.webp import Decoder, split_files

        decoder = Decoder()
        for b in batches:
            raw = b.column(at)
            size = np.array([len(x) if x is not None else 0 for x in raw.to_pylist()], np.int64)
            offsets = np.concatenate(([0], np.cumsum(size)))
            for i, j in T.runs(offsets, RUN_BYTES):
                part = b.slice(i, j - i)
                files, owner = [], []
                for k, m in enumerate(part.column(at).to_pylist()):
                    found = split_files(m or b"")
                    files += found
                    owner += [k] * len(found)
                arrays: list[list] = [[] for _ in range(j - i)]
                for k, p in zip(owner, decoder.decode(files), strict=True):
                    arrays[k].append(p)
                pixels, feature = [], []
                for ps in arrays:
                    samples = np.concatenate([np.ascontiguousarray(p.reshape(-1)).view(np.uint8).reshape(-1, 4)[:, 2::-1].reshape(-1) for p in ps]) if ps else np.zeros(0, np.uint8)
                    pixels.append(samples.tobytes())
                    bins = np.bincount(samples, minlength=256)
                    n, v = max(1, len(samples)), np.arange(256)
                    mean = float(bins @ v) / n
                    spread = max(0.0, float(bins @ (v * v)) / n - mean * mean) ** 0.5
                    feature.append(f"{sum(p.shape[0] for p in ps)}x{ps[0].shape[1] if ps else 0} {mean:.4f} {spread:.4f} " + ",".join(map(str, bins.reshape(8, 32).sum(1).tolist())))
                yield _appended(part, {"pixels": pa.array(pixels, pa.binary()), "feature": pa.array(feature)})

    return df.mapInArrow(run, schema)
