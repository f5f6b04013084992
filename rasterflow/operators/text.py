"""Text with a bitmap font of fixed width, as projections of the text: lines, their sizes, and the pixels that are set.

A font is a dictionary from code points to the bits of a glyph's rows (8 columns, the highest bit first); it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Font = dict[int, list[int]]


def _width(line: Column, advance: int, spacing: int) -> Column:
    return F.greatest(F.length(line) * (advance + spacing) - spacing, F.lit(0))


def text_lines(text: Column, wrap: int | None = None, advance: int = 8, spacing: int = 0) -> Column:
    """The lines of text; with wrap, words go to a new line where the line would be wider. A word never breaks."""
    raw = F.split(text, "\n")
    if not wrap:
        return raw
    none = F.array().cast("array<string>")

    def add(s: Column, word: Column) -> Column:
        longer = F.when(s["line"] != "", F.concat(s["line"], F.lit(" "), word)).otherwise(word)
        full = (_width(longer, advance, spacing) > wrap) & (s["line"] != "")
        return F.struct(F.when(full, F.array_append(s["done"], s["line"])).otherwise(s["done"]).alias("done"), F.when(full, word).otherwise(longer).alias("line"))

    def wrapped(line: Column) -> Column:
        end = F.aggregate(F.split(line, " "), F.struct(none.alias("done"), F.lit("").alias("line")), add)
        return F.when(line == "", F.array(F.lit(""))).otherwise(F.concat(end["done"], F.when(end["line"] != "", F.array(end["line"])).otherwise(none)))

    return F.flatten(F.transform(raw, wrapped))


def measure_text(text: Column, line_height: int = 8, wrap: int | None = None, advance: int = 8, spacing: int = 0) -> Column:
    """A struct of width, height, lines and line_widths."""
    lines = text_lines(text, wrap, advance, spacing)
    widths = F.transform(lines, lambda x: _width(x, advance, spacing))
    return F.struct(F.coalesce(F.array_max(widths), F.lit(0)).alias("width"), (F.size(lines) * line_height).alias("height"), F.size(lines).alias("lines"), widths.alias("line_widths"))


def render_text(texts: DataFrame, font: Font, default: int, align: str = "left", line_height: int = 8, wrap: int | None = None, advance: int = 8, spacing: int = 0) -> DataFrame:
    """media_id, y, x of the pixels that the glyphs of texts (media_id, text) set; characters without a glyph show default's.

    The image is as wide as wrap, or else as the widest line; what lies outside is left out. Null texts give no rows.
    """
    sized = texts.where("text IS NOT NULL").withColumn("size", measure_text(F.col("text"), line_height, wrap, advance, spacing))
    width = F.lit(wrap) if wrap else F.col("size.width")
    rows = sized.select("media_id", F.posexplode(text_lines(F.col("text"), wrap, advance, spacing)).alias("line_no", "line"), width.alias("width"))
    free = F.col("width") - _width(F.col("line"), advance, spacing)
    start = {"left": F.lit(0), "center": F.floor(free / 2), "right": free}[align]
    glyphs = F.create_map(*[F.lit(v) if isinstance(v, int) else F.array(*map(F.lit, v)) for kv in font.items() for v in kv])
    chars = rows.where("line <> ''").select("media_id", "width", "line_no", start.alias("start"), F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("i", "c"))
    bits = chars.select("media_id", "width", "line_no", (F.col("start") + F.col("i") * (advance + spacing)).alias("left"), F.posexplode(F.coalesce(F.try_element_at(glyphs, F.ascii("c")), F.lit(font[default]))).alias("row", "bits"))
    cells = bits.select("media_id", "width", "left", (F.col("line_no") * line_height + F.col("row")).alias("y"), "bits", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("col"))
    x = F.col("left") + F.col("col")
    return cells.where((F.expr("shiftright(bits, 7 - col)").bitwiseAND(1) == 1) & (x >= 0) & (x < F.col("width"))).select("media_id", "y", x.cast("int").alias("x"))
