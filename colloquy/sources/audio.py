"""WAV files as a source and as a form of stored samples."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.signal import RATE

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
DECODED = "samples array<float>, duration_ms double"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder that end in .wav: path, length, content. Only what is decoded is loaded."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "length", "content")


def _chunks(data: bytes) -> tuple[bytes, bytes, bool] | None:
    """Format and samples of a RIFF file, and whether the samples are all there; null for another file or without either."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = body
        elif name == b"data":
            return None if form is None or len(form) < 16 else (form, body, len(body) == size)
        at += 8 + size + size % 2
    return None


def _samples(body: bytes, tag: int, bits: int) -> np.ndarray | None:
    """Samples between -1 and 1 of whole values; null for a form that is not known."""
    width = bits // 8
    body = body[: len(body) // width * width] if width else b""
    if tag == FLOAT and bits == 32:
        return np.frombuffer(body, "<f4")
    if tag != PCM or bits not in (8, 16, 24, 32):
        return None
    if bits == 8:  # the only width without a sign
        values = np.frombuffer(body, np.uint8).astype(np.int32) - 128
    elif bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        values = wide.view("<i4").ravel() >> 8
    else:
        values = np.frombuffer(body, f"<i{width}")
    return (values / 2.0 ** (bits - 1)).astype(np.float32)


def linear(samples: np.ndarray, source: int, target: int, round_up: bool = False) -> np.ndarray:
    """Linear interpolation at a new rate; the number of samples is rounded down, or up as a live capture does."""
    if source == target or not len(samples):
        return samples
    step = source / target
    n = int(np.ceil(len(samples) / step) if round_up else np.floor(len(samples) / step))
    place = np.arange(n) * step
    low = np.minimum(place.astype(np.int64), len(samples) - 1)
    first, second = samples[low], samples[np.minimum(low + 1, len(samples) - 1)]
    return first + (second - first) * (place - low).astype(np.float32)


def decode(data: bytes | None, strict: bool = False) -> tuple[np.ndarray, float] | None:
    """Samples of one channel at 16 kHz and their length in ms; null for a file that cannot be read.

    Whole numbers of 8, 16, 24 and 32 bits and floats of 32; channels are averaged, a rest of less than a frame is left out, other
    rates are interpolated. Without strict, samples that break off make the file unreadable. With it, the file must have 16 kHz and one
    channel, and of samples that break off the whole ones are taken.
    """
    parts = _chunks(bytes(data)) if data is not None else None
    if parts is None:
        return None
    form, body, whole = parts
    tag, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == EXTENSIBLE:
        if len(form) < 26:
            return None
        tag = int.from_bytes(form[24:26], "little")
    if not channels or not rate or frame != channels * bits // 8 or (not whole or len(body) % frame) and not strict or strict and (rate != RATE or channels != 1):
        return None
    found = _samples(body, tag, bits)
    if found is None:
        return None
    if channels > 1:
        found = found[: len(found) // channels * channels].reshape(-1, channels).mean(axis=1, dtype=np.float32)
    found = linear(found, rate, RATE)
    return found, len(found) / RATE * 1000


def decoded(content: Column, strict: bool = False) -> Column:
    """decode for a column of files: a struct of samples and duration_ms."""

    @F.pandas_udf(DECODED)
    def files(contents: pd.Series) -> pd.DataFrame:
        rows = [decode(c, strict) or (None, None) for c in contents]
        return pd.DataFrame({"samples": [r[0] for r in rows], "duration_ms": pd.array([r[1] for r in rows], "Float64")})

    found = files(content)
    return F.when(found["samples"].isNotNull(), found)


def encode(samples: np.ndarray, rate: int = RATE, channels: int = 1, bits: int = 32, floating: bool = True) -> bytes:
    """A WAV file of interleaved samples between -1 and 1; whole numbers are rounded and stay within their range."""
    samples = np.asarray(samples, np.float64)
    if floating:
        body = samples.astype("<f4").tobytes()
    else:
        top = 2 ** (bits - 1)
        values = np.clip(np.floor(samples * top + 0.5), -top, top - 1).astype(np.int64)
        if bits == 8:
            body = (values + 128).astype(np.uint8).tobytes()
        elif bits == 24:
            body = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
        else:
            body = values.astype(f"<i{bits // 8}").tobytes()
    frame = channels * bits // 8
    form = struct.pack("<HHIIHH", FLOAT if floating else PCM, channels, rate, rate * frame, frame, bits)
    parts = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", len(parts)) + parts


def encoded(samples: Column, rate: Column, channels: Column, bits: Column, floating: Column) -> Column:
    """encode for columns; null samples give null."""

    @F.pandas_udf("binary")
    def files(s: pd.Series, r: pd.Series, c: pd.Series, b: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else encode(x, *form) for x, *form in zip(s, r, c, b, f, strict=True)], dtype=object)

    return files(samples, rate, channels, bits, floating)
