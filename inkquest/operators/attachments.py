"""Checks on binary content: entropy, magic bytes and hidden data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy in bits of a binary column (0 when empty)."""

    def one(b):
        if not b:
            return 0.0
        n = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
        p = n[n > 0] / len(b)
        return float(-(p * np.log2(p)).sum())

    return data.map(one)


# Leading bytes (hex) of a file type and the extensions that go with it.
MAGIC = [("FFD8FF", "jpeg", ["jpg", "jpeg"]), ("89504E47", "png", ["png"]), ("474946", "gif", ["gif"]),
         ("25504446", "pdf", ["pdf"]), ("504B0304", "zip", ["zip", "docx", "xlsx", "pptx"])]


def attachment_findings(files, trailing_over: int = 10, entropy_over: float = 7.5, per_finding: float = 0.6):
    """Anomalies of each file (file_id, name, content BINARY).

    Checks: leading bytes against the extension, data after the end marker of a
    picture, location or camera marks near the start, a size that is a whole number
    of kilobytes, and high byte entropy.  Hidden data is suspected above 0.5.
    """
    c, size = F.col("content"), F.length("content")
    head = F.hex(F.substring(c, 1, 8))
    ext = F.lower(F.element_at(F.split("name", r"\."), -1))
    kind = None
    for magic, label, _ in MAGIC:
        hit = F.startswith(head, F.lit(magic))
        kind = F.when(hit, label) if kind is None else kind.when(hit, label)
    good_ext = None
    for _, label, exts in MAGIC:
        val = ext.isin(exts)
        good_ext = F.when(F.col("kind") == label, val) if good_ext is None else good_ext.when(F.col("kind") == label, val)
    # ISO-8859-1 maps every byte to one character, so markers are matched byte-aligned
    chars = F.decode(c, "ISO-8859-1")

    def after_last(marker):
        return F.when(F.contains(chars, F.lit(marker)), F.length(F.element_at(F.split(chars, marker), -1))).otherwise(0)

    trailing = (F.when(F.col("kind") == "jpeg", after_last("\u00ff\u00d9"))
                .when(F.col("kind") == "png", after_last("IEND\u00ae\u0042\u0060\u0082")).otherwise(0))
    start = F.substring(chars, 1, 1000)
    marks = F.contains(start, F.lit("Exif")) | F.contains(start, F.lit("GPS"))
    found = files.withColumn("kind", kind).select(
        "file_id", "kind", size.cast("bigint").alias("size"), trailing.alias("trailing_bytes"),
        F.round(byte_entropy(c), 6).alias("entropy"), marks.alias("location_marks"), good_ext.alias("ext_ok"))
    flags = F.array_compact(F.array(
        F.when(~F.col("ext_ok"), "extension_mismatch"),
        F.when(F.col("trailing_bytes") > trailing_over, "trailing_data"),
        F.when(F.col("location_marks"), "location_marks"),
        F.when(F.col("size") % 1024 == 0, "whole_kilobytes"),
        F.when(F.col("entropy") > entropy_over, "high_entropy")))
    out = found.withColumn("findings", flags)
    conf = F.least(F.size("findings") * F.lit(per_finding), F.lit(1.0))
    return out.select("file_id", "kind", "size", "trailing_bytes", "entropy", F.array_join("findings", ",").alias("findings"),
                      conf.alias("confidence"), (conf > 0.5).alias("hidden"))
