"""Media types from the first bytes and from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic bytes in hex, in the order of the tests.
MAGIC = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"), ("webm", "1A45DFA3"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("ico", "00000100"), ("qoi", "716F6966"))
# Names of formats and their extensions.
IMAGES = ("png", "jpeg", "webp", "gif", "bmp", "tiff", "avif", "svg", "ico", "qoi", "pcx", "hdr", "pnm", "ppm", "pgm", "pbm", "tga", "heic", "psd")
VIDEOS = ("mp4", "webm", "gif", "avi", "mov")
EXTENSIONS = {"jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "png": "png", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "webp": "webp", "ico": "ico", "qoi": "qoi", "svg": "svg", "avif": "avif", "mp4": "mp4", "m4v": "mp4", "mov": "mov", "webm": "mkv", "mkv": "mkv", "avi": "avi", "mpg": "ps", "vob": "ps", "ts": "ts", "mts": "ts"}


def sniff(head_hex: Column) -> Column:
    """The format by the first 1,000 bytes in upper-case hex; null if none fits. Later tests are weaker: TGA has no magic at all."""
    at = lambda first, n: F.substring(head_hex, 2 * first + 1, 2 * n)
    byte = lambda i: F.conv(at(i, 1), 16, 10).cast("int")
    text = lambda s: s.encode().hex().upper()
    length = F.length(head_hex) / 2
    riff, box = at(0, 4) == text("RIFF"), (at(4, 4) == text("ftyp")) & (length >= 12)
    out = F.when(riff & (at(8, 4) == text("WEBP")), "webp").when(riff & (at(8, 4) == text("AVI ")), "avi")
    out = out.when(box & at(8, 4).isin(text("avif"), text("avis")), "avif").when(box & at(8, 2).isin(text("qt")), "mov").when(box, "mp4")
    words = F.lower(F.regexp_replace(F.decode(F.unhex(at(0, 1000)), "ISO-8859-1"), r"^\s+", ""))
    svg = words.startswith("<svg") | (words.startswith("<?xml") & words.contains("<svg")) | words.contains("<!doctype svg")
    out = out.when((length >= 5) & (F.length(head_hex) % 2 == 0) & svg, "svg")
    for name, magic in MAGIC:
        out = out.when(head_hex.startswith(magic), name)
    out = out.when((length >= 128) & (at(0, 1) == "0A") & byte(1).isin(0, 2, 3, 4, 5) & byte(2).isin(0, 1), "pcx")
    out = out.when(head_hex.startswith(text("#?RADIANCE")) | (head_hex.startswith(text("#?RGBE")) & (length >= 10)), "hdr")
    for name, kinds in (("pbm", "14"), ("pgm", "25"), ("ppm", "36")):
        out = out.when(at(0, 2).isin(*[text(f"P{k}") for k in kinds]), name)
    sides = (at(12, 2) != "0000") & (at(14, 2) != "0000")
    return out.when((length >= 18) & byte(1).isin(0, 1) & byte(2).isin(0, 1, 2, 3, 9, 10, 11) & byte(16).isin(8, 15, 16, 24, 32) & sides, "tga")


def is_image(fmt: Column) -> Column:
    return fmt.isin(*IMAGES)


def is_video(fmt: Column) -> Column:
    return fmt.isin(*VIDEOS)


def mime_type(fmt: Column) -> Column:
    """image/ for images, video/ for all else, as the compatible behaviour."""
    return F.when(fmt == "svg", "image/svg+xml").otherwise(F.concat(F.when(is_image(fmt), "image/").otherwise("video/"), fmt))


def extension(fmt: Column) -> Column:
    return F.when(fmt == "jpeg", "jpg").otherwise(fmt)


def format_of_name(path: Column) -> Column:
    """By the extension; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.when(ext.isin(*EXTENSIONS), ext).otherwise(F.lit(None)))


def glob_regex(pattern: str) -> str:
    """** spans folders, * and ? don't; other characters stand for themselves."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += {"*": "[^/]*", "?": "."}.get(pattern[i]) or ("\\" + pattern[i] if pattern[i] in ".+()[]{}^$|\\" else pattern[i])
        i += 1
    return f"^{out}$"


def human_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))
