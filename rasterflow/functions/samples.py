"""Sample arithmetic of audio and video: PCM, companding, luma and chroma, shared exponents, tone maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import channel


def pcm_s16(low: Column, high: Column) -> Column:
    """Two bytes, low one first, as a sample in [-1, 1)."""
    v = low + high * 256
    return F.when(v >= 32768, v - 65536).otherwise(v).cast("double") / 32768


def mulaw(byte: Column) -> Column:
    """A byte of G.711 mu-law as a 16-bit sample; / 32768 gives it in [-1, 1)."""
    u = 255 - byte
    exponent, mantissa = F.floor(u % 128 / 16), u % 16
    magnitude = (mantissa * 8 + 132) * F.pow(F.lit(2.0), exponent) - 132
    return F.when(u >= 128, -magnitude).otherwise(magnitude).cast("int")


def alaw(byte: Column) -> Column:
    """A byte of A-law as a 16-bit sample; / 32768 gives it in [-1, 1).

    A set sign bit means negative here, as AU files are read by the library whose results these match; G.711 itself has it the
    other way round (negate the result for that).
    """
    v = byte.bitwiseXOR(F.lit(85))
    exponent, mantissa = F.floor(v % 128 / 16), v % 16
    magnitude = F.when(exponent == 0, mantissa * 16 + 8).otherwise((mantissa * 16 + 264) * F.pow(F.lit(2.0), exponent - 1))
    return F.when(v >= 128, -magnitude).otherwise(magnitude).cast("int")


# BT.601 in limited range, as raw video has it, and in full range, as JPEG has it.


def yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """BT.601 in limited range."""
    c, d, e = y - 16, u - 128, v - 128
    return channel(1.164 * c + 1.596 * e), channel(1.164 * c - 0.392 * d - 0.813 * e), channel(1.164 * c + 2.017 * d)


def rgb_to_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 in limited range."""
    return channel(0.257 * r + 0.504 * g + 0.098 * b + 16), channel(-0.148 * r - 0.291 * g + 0.439 * b + 128), channel(0.439 * r - 0.368 * g - 0.071 * b + 128)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """BT.601 in full range."""
    d, e = cb - 128, cr - 128
    return channel(y + 1.402 * e), channel(y - 0.344136 * d - 0.714136 * e), channel(y + 1.772 * d)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 in full range."""
    return channel(0.299 * r + 0.587 * g + 0.114 * b), channel(-0.168736 * r - 0.331264 * g + 0.5 * b + 128), channel(0.5 * r - 0.418688 * g - 0.081312 * b + 128)


def rgbe(c: Column, exponent: Column) -> Column:
    """A channel with a shared exponent, as a linear value."""
    return F.when(exponent == 0, F.lit(0.0)).otherwise(c * F.pow(F.lit(2.0), exponent - 136))


def reinhard(c: Column) -> Column:
    """A linear value of an EXR file as a channel: c / (1 + c), without a curve."""
    return channel(255 * (c / (1 + c)))


def hdr_tone(c: Column) -> Column:
    """A linear value of an HDR file as a channel: c / (1 + c) on the sRGB curve."""
    mapped = c / (1 + c)
    return channel(255 * F.when(mapped <= 0.0031308, mapped * 12.92).otherwise(1.055 * F.pow(mapped, F.lit(1 / 2.4)) - 0.055))
