"""Times of subtitles, cue sheets, scripts and notes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import half_up

SRT_TIME = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"
VTT_TIME = r"^\s*(?:(\d+):)?(\d+):(\d+)\.(\d+)\s*$"


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group as a number; 0 where the pattern or the group doesn't match."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.try_cast("double")).otherwise(F.lit(0.0))


def parse_clock(text: Column, pattern: str = SRT_TIME) -> Column:
    """h:m:s.ms in seconds; 0 for what is no time."""
    h, m, s, ms = (_part(text, pattern, i) for i in (1, 2, 3, 4))
    return h * 3600 + m * 60 + s + ms / 1000


def format_clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm; the milliseconds are rounded alone and can read 1000, as the compatible behaviour."""
    whole = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    ms = half_up((seconds - whole) * 1000).cast("string")
    return F.concat(two(F.floor(whole / 3600)), F.lit(":"), two(F.floor(whole % 3600 / 60)), F.lit(":"), two(whole % 60), F.lit(mark), F.when(F.length(ms) < 3, F.lpad(ms, 3, "0")).otherwise(ms))


def parse_ass_time(text: Column) -> Column:
    """h:mm:ss.cc; three digits are milliseconds, rounded to centiseconds."""
    pattern = r"^\s*(\d+):(\d+):(\d+)[.:](\d+)\s*$"
    h, m, s, part = (_part(text, pattern, i) for i in (1, 2, 3, 4))
    cs = F.when(F.length(F.regexp_extract(text, pattern, 4)) == 3, half_up(part / 10)).otherwise(part)
    return h * 3600 + m * 60 + s + cs / 100


def format_ass_time(seconds: Column) -> Column:
    whole = F.floor(seconds)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    cs = half_up((seconds - whole) * 100).cast("string")
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), two(F.floor(whole % 3600 / 60)), F.lit(":"), two(whole % 60), F.lit("."), F.when(F.length(cs) < 2, F.lpad(cs, 2, "0")).otherwise(cs))


def cue_frames(seconds: Column) -> Column:
    """Seconds in frames of 1/75 s, rounded."""
    return half_up(seconds * 75).cast("long")


def format_cue(frames: Column) -> Column:
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(two(frames / 4500), F.lit(":"), two(frames % 4500 / 75), F.lit(":"), two(frames % 75))


def parse_cue(text: Column) -> Column:
    """m:ss:ff in frames; 0 for what is no time."""
    m, s, f = (_part(text, r"^(\d+):(\d+):(\d+)$", i) for i in (1, 2, 3))
    return (m * 4500 + s * 75 + f).cast("long")


NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def note_name(note: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, NOTES)), (note % 12 + 1).cast("int")), (F.floor(note / 12) - 1).cast("string"))


def note_number(name: Column) -> Column:
    """-1 for what is no name; sharps only."""
    letter, octave = F.regexp_extract(name, r"^([A-G]#?)(-?\d+)$", 1), F.regexp_extract(name, r"^([A-G]#?)(-?\d+)$", 2)
    at = F.array_position(F.array(*map(F.lit, NOTES)), letter)
    return F.when(at > 0, (F.when(octave != "", octave.try_cast("int")) + 1) * 12 + at - 1).otherwise(-1).cast("int")
