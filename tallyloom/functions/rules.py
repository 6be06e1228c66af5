"""What is accepted of users' entries, as Column expressions: a reason, or null where all is well; rules of frames and telemetry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: least and greatest lengths
NAME_CHARS, PASSWORD_CHARS, PREFERENCE_CHARS = (3, 255), (8, 128), 64


def _length(value: Column, bounds: tuple[int, int]) -> Column:
    return ~F.length(value).between(*bounds)


def user_name(name: Column) -> Column:
    """`length` or `characters` (other than ASCII letters, digits, _ and -)."""
    return F.when(_length(name, NAME_CHARS), "length").when(~name.rlike(r"\A[a-zA-Z0-9_-]+\z"), "characters")


def password(value: Column) -> Column:
    """`length`, or the first of `upper`, `lower` and `digit` that it lacks."""
    return F.when(_length(value, PASSWORD_CHARS), "length").when(~value.rlike("[A-Z]"), "upper").when(~value.rlike("[a-z]"), "lower").when(~value.rlike(r"\p{Nd}"), "digit")


def language_code(code: Column) -> Column:
    """Whether a code is two or three letters, or those, a hyphen and two to eight letters or digits, ten characters at most; null is fine."""
    return code.isNull() | (F.length(code).between(2, 10) & code.rlike(r"\A[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})?\z"))


def preference(value: Column) -> tuple[Column, Column]:
    """The registered id that is preferred (null: none), and whether the entry is refused."""
    bare = F.regexp_replace(value, r"\A\s+|\s+\z", "")
    none = value.isNull() | F.lower(bare).isin("", "auto")
    refused = ~none & ((F.length(value) > PREFERENCE_CHARS) | ~bare.rlike(r"\A[\p{L}\p{N}_-]+\z"))
    return F.when(~none & ~refused, bare), refused


def fast_path(label: Column, ssim: Column, threshold: float = 0.95) -> Column:
    """Frames as alike as the threshold are incremental whatever their label; an unknown likeness counts as 0."""
    return F.when(F.coalesce(ssim, F.lit(0.0)) >= threshold, "incremental").otherwise(label)


def duration(frames: Column, rate: Column, end_ms: Column) -> Column:
    """Seconds of frames at a rate (0 or null: 1 a second); where that is not above 0, those of the last position."""
    seconds = frames / F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(1.0))
    return F.when(seconds > 0, seconds).otherwise(end_ms / 1000.0)


def fresh(observed_at: Column, now: Column, seconds: int = 30) -> Column:
    """Whether an observation is not older than that; an unknown one is not fresh."""
    return F.coalesce(observed_at >= now - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))
