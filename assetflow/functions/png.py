"""PNG files as Column expressions: stored deflate blocks, CRC-32 and Adler-32 on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.functions.arrays import let

# Fixed values of the format.
SIGNATURE = "89504E470D0A1A0A"
STORED_MAX = 65535        # bytes of a stored deflate block
ADLER = 65521
GRAY, RGB = 0, 2


def _hex(x: Column, width: int) -> Column:
    return F.lpad(F.hex(x.cast("long")), width, "0")


def _little(x: Column) -> Column:
    h = _hex(x, 4)
    return F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))


def _chunk(kind: str, data: Column) -> Column:
    """Hexadecimal chunk: length, type, data, CRC-32 of type and data; ``data`` is hexadecimal."""
    tag = F.lit(kind.encode().hex().upper())
    return let(data, lambda d: F.concat(_hex(F.length(d) / 2, 8), tag, d, _hex(F.crc32(F.unhex(F.concat(tag, d))), 8)))


def adler32(values: Column) -> Column:
    """Adler-32 of an array of byte values, from two plain sums."""
    n = F.size(values).cast("long")
    one = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    two = F.aggregate(F.transform(values, lambda x, i: (n - i) * x), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    return ((n + two) % ADLER).cast("long") * 65536 + (1 + one) % ADLER


def _stored(values: Column) -> Column:
    """Hexadecimal zlib stream of byte values, in stored blocks."""
    text = F.array_join(F.transform(values, lambda x: _hex(x, 2)), "")
    def blocks(t: Column) -> Column:
        last = F.floor((F.length(t) / 2 - 1) / STORED_MAX).cast("int")
        def block(i: Column) -> Column:
            size = F.least(F.lit(STORED_MAX).cast("long"), (F.length(t) / 2).cast("long") - i * STORED_MAX)
            return F.concat(F.when(i == last, "01").otherwise("00"), _little(size), _little(65535 - size),
                            F.substr(t, (i * STORED_MAX * 2 + 1).cast("int"), (size * 2).cast("int")))
        return F.array_join(F.transform(F.sequence(F.lit(0), last), block), "")
    return F.concat(F.lit("7801"), let(text, blocks), _hex(adler32(values), 8))


def encode(samples: Column, height: Column, width: Column, rgb: bool = False) -> Column:
    """PNG bytes of an image: 8-bit ``samples`` row by row, gray or R, G, B per pixel; null for an image without pixels."""
    per = 3 if rgb else 1

    def rows(s: Column) -> Column:      # a filter byte 0 before every row
        return F.flatten(F.transform(F.sequence(F.lit(0), s["h"] - 1),
                                     lambda r: F.concat(F.array(F.lit(0)), F.slice(s["px"], r * s["w"] * per + 1, s["w"] * per))))

    image = F.struct(samples.cast("array<int>").alias("px"), height.cast("int").alias("h"), width.cast("int").alias("w"))
    def whole(s: Column) -> Column:
        header = F.concat(_hex(s["w"], 8), _hex(s["h"], 8), F.lit(f"080{RGB if rgb else GRAY}000000"))
        return F.unhex(F.concat(F.lit(SIGNATURE), _chunk("IHDR", header), _chunk("IDAT", let(rows(s), _stored)), _chunk("IEND", F.lit(""))))
    return F.when((height > 0) & (width > 0), let(image, whole))
