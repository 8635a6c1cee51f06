"""Removal of lines that many documents share.

A line's key is the line without white space at its ends, with A-Z in lower case; keys are counted
by 64-bit hash, once for each document. Nulls: a null text counts as empty (one empty line). Empty
keys are never common. Every row is a document of its own, repeated rows too, whatever its doc_id
is. An empty table gives an empty result. All columns are carried along in the struct row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key128, materialise, packed, text_or_empty


def line_hashes(text: str | None) -> list[int | None]:
    """The signed 64-bit hash of each line's key; None for an empty key. Bytes lose the same white space and have the same A-Z."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(b" \t\n\x0b\f\r").lower()
        out.append(int.from_bytes(xxhash.xxh3_64_digest(key), "big", signed=True) if key else None)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def hashed(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in text:
        yield s.map(line_hashes)


def drop_common_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """row (the document), n_lines, n_dropped, kept (the text that is left).

    Texts are hashed once and not shuffled for the count: hashes are. The positions of the common
    lines are joined back by a 128-bit key of the text, so equal texts need their positions once,
    and repeated or null ids do no harm.
    """
    text = text_or_empty("row.text")
    base = packed(docs)
    k1, k2 = key128(text)
    hashes = materialise(base.select(k1.alias("k1"), k2.alias("k2"), hashed("row.text").alias("h")), "line-hashes")
    common = (hashes.select(F.explode(F.array_distinct("h")).alias("h")).filter("h is not null")
              .groupBy("h").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs).select("h"))
    common = materialise(common, "common-lines")
    found = (hashes.select("k1", "k2", F.posexplode("h").alias("pos", "h"))
             .filter("h is not null").join(common, "h", "left_semi")
             .groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")))
    found = materialise(found, "common-line-positions")
    lines = F.split(text, "\n")
    joined = base.select("row", k1.alias("k1"), k2.alias("k2")).join(found, ["k1", "k2"], "left")
    # positions that stay, in order; both steps take time in proportion to the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return (joined.select("row", "gone", lines.alias("lines"))
            .select("row", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("gone").isNull(), text).otherwise(left).alias("kept")))


def with_lines_dropped(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """The documents with the common lines gone; text and, where there is one, n_chars follow.

    A null text stays null.
    """
    out = drop_common_lines(docs, min_docs)
    new = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept"))
    columns = {"text": new, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[columns[c].alias(c) if columns.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])
