"""Exact and perceptual hashes as native Column expressions.

Everything here compiles to JVM expressions (higher-order array functions),
so hashing stays inside whole-stage code generation: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetflow.functions.arrays import let

# Perceptual hash configurations as (thumbnail side, gray bits).
PHASH_CONFIGS = ((4, 2), (5, 2), (6, 2), (7, 2), (8, 2),
                 (4, 1), (5, 1), (6, 1), (7, 1), (8, 1))


def phash_name(side: int, bits: int) -> str:
    return f"simhash{side * side}x{2 ** bits}"


def content_md5(content: Column) -> Column:
    """md5 hex digest of the bytes (strings hash as their UTF-8 bytes)."""
    return F.md5(content)


HEX_CHUNK_BITS = 60  # 15 hex digits: well inside conv's unsigned 64-bit range


def bits_to_hex(bits: Column) -> Column:
    """Bit string -> ``0x`` hex without leading zeros, any length.

    ``conv`` overflows past 64 bits, so the string is left-padded to a
    multiple of 60 bits and converted in 60-bit chunks of 15 hex digits.  An
    all-zero string gives ``0x0``.
    """
    digits = HEX_CHUNK_BITS // 4

    def body(b):
        n_chunks = F.floor((F.length(b) + HEX_CHUNK_BITS - 1) / HEX_CHUNK_BITS).cast("int")
        return let(F.lpad(b, n_chunks * HEX_CHUNK_BITS, "0"), lambda padded: F.array_join(F.transform(
            F.sequence(F.lit(0), n_chunks - 1),
            lambda i: F.lpad(F.lower(F.conv(F.substring(padded, i * HEX_CHUNK_BITS + 1, HEX_CHUNK_BITS), 2, 16)),
                             digits, "0")), ""))

    return let(F.regexp_replace(let(bits, body), "^0+", ""),
               lambda h: F.when(h == "", F.lit("0x0")).otherwise(F.concat(F.lit("0x"), h)))


def gray_levels(px: Column, bits: int) -> Column:
    """Quantise pixels: ``(v - min) // ((max - min) // 2**bits)``.

    A range below ``2**bits`` makes the divisor zero; like unsigned 8-bit
    arithmetic in the original this yields level 0 (flat images hash to
    ``0x0``).  Levels may reach ``2**bits`` or more; that is kept.
    """
    def body(p):
        mn, mx = F.array_min(p), F.array_max(p)
        return let(F.struct(mn.alias("mn"), F.floor((mx - mn) / (2 ** bits)).alias("step")),
                   lambda s: F.transform(p, lambda v: F.coalesce(
                       F.floor((v - s["mn"]) / F.nullif(s["step"], F.lit(0))), F.lit(0)).cast("long")))
    return let(px, body)


def levels_to_bits(levels: Column, bits: int) -> Column:
    """Concatenate each level in binary, zero-padded to at least ``bits``."""
    return F.array_join(
        F.transform(
            levels,
            lambda l: F.when(F.length(F.bin(l)) < bits, F.lpad(F.bin(l), bits, "0")).otherwise(F.bin(l)),
        ),
        "",
    )


def _block(i: int, size: int, out: int):
    lo = i * size // out
    return lo, max(lo + 1, (i + 1) * size // out)


def resize_box_static(px: Column, in_h: int, in_w: int, out_h: int, out_w: int) -> Column:
    """``resize_box`` for dimensions known when the plan is built.

    Every output cell is a fixed sum of array elements, so the expression is
    plain arithmetic that whole-stage code generation compiles (no lambdas).
    """
    cells = []
    for i in range(out_h):
        r0, r1 = _block(i, in_h, out_h)
        for j in range(out_w):
            c0, c1 = _block(j, in_w, out_w)
            idx = [r * in_w + c for r in range(r0, r1) for c in range(c0, c1)]
            total = sum((px.getItem(k).cast("long") for k in idx[1:]), px.getItem(idx[0]).cast("long"))
            cells.append(F.floor(total / len(idx)).cast("int"))
    return F.array(*cells)


def resize_box(px: Column, in_h, in_w, out_h: int, out_w: int) -> Column:
    """Resize a row-major gray image by block means (floored).

    Output cell (i, j) averages source rows ``[i*H/oh, max(that+1, (i+1)*H/oh))``
    and the matching columns; upsampling degenerates to nearest neighbour.
    Python ints for ``in_h``/``in_w`` select the compiled static form.
    """
    if isinstance(in_h, int) and isinstance(in_w, int):
        return resize_box_static(px, in_h, in_w, out_h, out_w)
    def lo(i, size, out):
        return F.floor(i * size / out).cast("int")

    def hi(i, size, out):
        return F.greatest(lo(i, size, out) + 1, F.floor((i + 1) * size / out).cast("int"))

    def body(s):
        p, hh, ww = s["p"], s["h"], s["w"]

        def cell(k):
            i = F.floor(k / out_w).cast("int")
            j = (k % out_w).cast("int")
            rows = F.sequence(lo(i, hh, out_h), hi(i, hh, out_h) - 1)
            cols = F.sequence(lo(j, ww, out_w), hi(j, ww, out_w) - 1)
            total = F.aggregate(
                rows, F.lit(0).cast("long"),
                lambda acc, r: acc + F.aggregate(
                    cols, F.lit(0).cast("long"),
                    lambda a2, c: a2 + F.element_at(p, r * ww + c + 1).cast("long")))
            return F.floor(total / (F.size(rows) * F.size(cols))).cast("int")

        return F.transform(F.sequence(F.lit(0), F.lit(out_h * out_w - 1)), cell)

    return let(F.struct(px.alias("p"), in_h.cast("int").alias("h"), in_w.cast("int").alias("w")), body)


def phash(px: Column, in_h, in_w, side: int, bits: int) -> Column:
    """Perceptual hash of a gray image: resize, quantise, bits -> hex."""
    small = resize_box(px, in_h, in_w, side, side)
    return bits_to_hex(levels_to_bits(gray_levels(small, bits), bits))


def phash_map(px, in_h, in_w, configs=PHASH_CONFIGS) -> Column:
    """All configured perceptual hashes of one image as ``MAP<type, hash>``.

    The decoded pixels are bound once and shared by every configuration.
    Python ints for ``in_h``/``in_w`` (a fixed-size image set) use the
    compiled static resize.
    """
    static = isinstance(in_h, int) and isinstance(in_w, int)
    if static and isinstance(px, str):
        return phash_map_static(px, in_h, in_w, configs)

    def body(s):
        kv = []
        for side, bits in configs:
            h, w = (in_h, in_w) if static else (s["h"], s["w"])
            kv += [F.lit(phash_name(side, bits)), phash(s["p"], h, w, side, bits)]
        return F.create_map(*kv)
    hh = F.lit(in_h) if static else in_h
    ww = F.lit(in_w) if static else in_w
    return let(F.struct(px.alias("p"), hh.cast("int").alias("h"), ww.cast("int").alias("w")), body)


def grayscale_bgr(data: Column, n_channels: Column) -> Column:
    """Gray levels from the ``image`` source's interleaved BGR(A) bytes.

    Luma ``0.299 R + 0.587 G + 0.114 B`` rounded; one-channel data is kept.
    """
    n_px = F.floor(F.length(data) / n_channels).cast("int")

    def byte_at(i):
        return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")

    def gray(k):
        base = k * n_channels
        b, g, r = byte_at(base), byte_at(base + 1), byte_at(base + 2)
        luma = F.round(r * 0.299 + g * 0.587 + b * 0.114).cast("int")
        return F.when(n_channels == 1, byte_at(base)).otherwise(luma)

    return F.when(n_px > 0, F.transform(F.sequence(F.lit(0), n_px - 1), gray)) \
        .otherwise(F.array().cast("array<int>"))


# Character ramp from dark to light, indexed by gray // 25.
ASCII_RAMP = ("@", "#", "S", "%", "?", "*", "+", ";", ":", ",", ".")


def ascii_art(px: Column, in_h: Column, in_w: Column, new_width: int, new_height: int) -> Column:
    """Gray image -> text art: resize, map ``v // 25`` on the ramp, rows of ``new_width``."""
    small = resize_box(px, in_h, in_w, new_height, new_width)
    ramp = F.array(*[F.lit(c) for c in ASCII_RAMP])
    chars = F.array_join(
        F.transform(small, lambda v: F.element_at(ramp, F.floor(v / 25).cast("int") + 1)), "")
    return split_fixed_width(chars, new_width)


def split_fixed_width(s: Column, width: int) -> Column:
    """Cut a string into rows of ``width`` characters joined by newlines."""
    def body(v):
        n = F.length(v)
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(
            F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")),
                        lambda i: F.substring(v, i * width + 1, width)),
            "\n"))
    return let(s, body)


# --- static-size images: the same hash as one SQL expression -----------------
#
# For a fixed image size every index is known when the plan is built.  The
# expression is generated as SQL text and parsed once: building it from
# thousands of Column objects costs one JVM round trip per node, which for
# ten configurations dominated the query time.

def _let_sql(value: str, var: str, body: str) -> str:
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def resize_static_sql(px: str, in_h: int, in_w: int, out_h: int, out_w: int) -> str:
    cells = []
    for i in range(out_h):
        r0, r1 = _block(i, in_h, out_h)
        for j in range(out_w):
            c0, c1 = _block(j, in_w, out_w)
            idx = [r * in_w + c for r in range(r0, r1) for c in range(c0, c1)]
            total = " + ".join(f"CAST({px}[{k}] AS BIGINT)" for k in idx)
            cells.append(f"CAST(floor(({total}) / {len(idx)}) AS INT)")
    return f"array({', '.join(cells)})"


def phash_static_sql(small: str, tag: str, bits: int) -> str:
    """SQL text quantising and hashing the resized image bound to ``small``."""
    levels = _let_sql(
        f"named_struct('s', {small}, 'mn', array_min({small}), "
        f"'step', floor((array_max({small}) - array_min({small})) / {2 ** bits}))",
        f"q{tag}",
        f"transform(q{tag}.s, v{tag} -> CAST(coalesce(floor((v{tag} - q{tag}.mn) / nullif(q{tag}.step, 0)), 0) AS BIGINT))")
    bitstr = (f"array_join(transform({levels}, l{tag} -> CASE WHEN length(bin(l{tag})) < {bits} "
              f"THEN lpad(bin(l{tag}), {bits}, '0') ELSE bin(l{tag}) END), '')")
    n = f"CAST(floor((length(b{tag}) + {HEX_CHUNK_BITS - 1}) / {HEX_CHUNK_BITS}) AS INT)"
    chunks = (f"array_join(transform(sequence(0, {n} - 1), i{tag} -> lpad(lower(conv(substring("
              f"lpad(b{tag}, {n} * {HEX_CHUNK_BITS}, '0'), i{tag} * {HEX_CHUNK_BITS} + 1, {HEX_CHUNK_BITS}), 2, 16)), "
              f"{HEX_CHUNK_BITS // 4}, '0')), '')")
    stripped = f"regexp_replace({_let_sql(bitstr, f'b{tag}', chunks)}, '^0+', '')"
    return _let_sql(stripped, f"h{tag}", f"CASE WHEN h{tag} = '' THEN '0x0' ELSE concat('0x', h{tag}) END")


def phash_map_static(px_col: str, in_h: int, in_w: int, configs=PHASH_CONFIGS) -> Column:
    """``phash_map`` for fixed-size images as one parsed SQL expression.

    ``px_col`` is a column name; the pixels are bound once for all configs,
    and each resized thumbnail once for its quantisation.
    """
    parts = []
    for side, bits in configs:
        tag = f"{side}_{bits}"
        body = _let_sql(resize_static_sql("p", in_h, in_w, side, side), f"s{tag}",
                        phash_static_sql(f"s{tag}", tag, bits))
        parts += [f"'{phash_name(side, bits)}'", body]
    return F.expr(_let_sql(f"`{px_col}`", "p", f"map({', '.join(parts)})"))
