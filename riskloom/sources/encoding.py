"""Bytes to text: binary test, UTF-16 detection and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


def _zeros(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(NUL), F.lit("")))


def utf16_kind(data: Column) -> Column:
    """'le-bom', 'be-bom', 'le', 'be' or null, by byte order mark or by where zero bytes stand in all of the data.

    The four figures are computed once, inside a one-element array.
    """
    sample = F.decode(data, "ISO-8859-1")
    figures = F.array(F.struct(
        F.hex(F.substring(data, 1, 2)).alias("head"),
        F.length(sample).alias("size"),
        _zeros(F.regexp_replace(sample, r"(?s)(.).?", "$1")).alias("even"),
        _zeros(F.regexp_replace(sample, r"(?s).(.?)", "$1")).alias("odd"),
    ))

    def kind(f: Column) -> Column:
        even_share = f["even"] / F.greatest(F.ceil(f["size"] / 2), F.lit(1))
        odd_share = f["odd"] / F.greatest(F.floor(f["size"] / 2), F.lit(1))
        enough = (f["size"] >= 4) & ((f["even"] + f["odd"]) / F.greatest(f["size"], F.lit(1)) >= 0.1)
        return (
            F.when(f["head"] == "FFFE", "le-bom").when(f["head"] == "FEFF", "be-bom")
            .when(enough & (odd_share > 0.6) & (even_share < 0.2), "le")
            .when(enough & (even_share > 0.6) & (odd_share < 0.2), "be")
        )

    return F.transform(figures, kind)[0]


def _paired(units: Column, little: bool) -> Column:
    """UTF-16 units with U+FFFD for each surrogate without its other half, which no decoder takes."""
    text = F.decode(units, "ISO-8859-1")
    if little:
        lone, mark = r"(?s)\G((?:.[^\xD8-\xDF]|.[\xD8-\xDB].[\xDC-\xDF])*+).[\xD8-\xDF]", "$1\u00fd\u00ff"
    else:
        lone, mark = r"(?s)\G((?:[^\xD8-\xDF].|[\xD8-\xDB].[\xDC-\xDF].)*+)[\xD8-\xDF].", "$1\u00ff\u00fd"
    return F.encode(F.regexp_replace(text, lone, mark), "ISO-8859-1")


def with_text(rows: DataFrame, data: str) -> DataFrame:
    """Add `kind`, `is_binary` and `text` for a column of bytes.

    A NUL byte anywhere and no UTF-16 text means binary; such rows get no text. Without a byte order mark, UTF-16
    must read like text. Only whole UTF-16 units are decoded, as a stray last byte carries no character. Bytes that are
    no text in their encoding become U+FFFD.
    """
    raw, kind = F.col(data), F.col("kind")
    body = F.when(kind.endswith("bom"), F.substring(raw, 3, 2147483647)).otherwise(raw)
    even = F.substr(body, F.lit(1), (F.length(body) - F.length(body) % 2).cast("int"))
    wide = F.when(kind.startswith("le"), F.decode(_paired(even, True), "UTF-16LE")).when(
        kind.startswith("be"), F.decode(_paired(even, False), "UTF-16BE")
    )
    decoded = rows.withColumn("kind", utf16_kind(raw)).withColumn("text", wide)
    unlikely = kind.isin("le", "be") & ~is_likely_text(F.col("text"))
    return (
        decoded.withColumn("kind", F.when(~F.coalesce(unlikely, F.lit(False)), kind))
        .withColumn("is_binary", F.contains(F.decode(raw, "ISO-8859-1"), F.lit(NUL)) & kind.isNull())
        .withColumn(
            "text",
            F.when(kind.isNull() & ~F.col("is_binary"), F.make_valid_utf8(raw.cast("string"))).when(kind.isNotNull(), F.col("text")),
        )
    )


def is_likely_text(text: Column) -> Column:
    """Few control characters and few that could not be decoded, in the whole text."""
    size = F.greatest(F.length(text), F.lit(1))
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{80}-\x{9F}]"))
    broken = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    return (F.length(text) > 0) & (broken / size < 0.05) & (control / size < 0.02)
