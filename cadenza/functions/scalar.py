"""Scalar expressions: rounding, levels, durations, rates and parsers of short specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_INFINITY = float("-inf")


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity, as a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def snap_to_frame(ms: Column, fps: Column | float) -> Column:
    """The middle of the frame nearest to ms; whole milliseconds if fps is not positive."""
    fps = F.lit(float(fps)) if not isinstance(fps, Column) else fps.cast("double")
    frame = F.try_divide(F.lit(1000.0), fps)
    number = round_half_up(F.try_divide(ms, frame))
    return F.when(fps <= 0, round_half_up(ms.cast("double"))).otherwise(round_half_up(number * frame + frame / 2))


def db_to_linear(db: Column) -> Column:
    """Amplitude of a level; minus infinity is silence."""
    return F.when(db == F.lit(MINUS_INFINITY), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), db / 20))


def linear_to_db(x: Column, floor: float = -90.0) -> Column:
    return F.when(x > 0, F.greatest(F.lit(floor), 20 * F.log10(x))).when(x.isNotNull(), F.lit(floor))


def duration_text(ms: Column) -> Column:
    """Like `6m 22s`, or `22s` below a minute."""
    seconds = round_half_up(ms / 1000.0)
    minutes = F.floor(seconds / 60)
    rest = seconds % 60
    return F.when(minutes > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%ds", rest))


def bar(share: Column, width: int = 20) -> Column:
    """A bar of `#` and `.`; share is held to 0..1."""
    full = round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def timestamp_ms(text: Column) -> Column:
    """Milliseconds of `H:M:S,mmm`; hours are unbounded, the fraction is padded or cut to three digits; 0 if it doesn't parse."""
    pattern = r"(\d+):(\d+):(\d+)[,.](\d+)"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("long")
    fraction = F.rpad(F.substring(F.regexp_extract(text, pattern, 4), 1, 3), 3, "0").try_cast("long")
    return F.when(text.rlike(pattern), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + fraction).otherwise(F.lit(0))


def parse_rate(text: Column) -> Column:
    """`30000/1001` or `25` as a double; 0 if the divisor is 0 or nothing parses."""
    n, d = (F.try_element_at(F.split(text, "/"), F.lit(i)).try_cast("double") for i in (1, 2))
    return F.coalesce(F.when(text.contains("/"), F.try_divide(n, d)).otherwise(n), F.lit(0.0))


def parse_crop(spec: Column) -> Column:
    """A struct (x, y, width, height) of shares from `edge:share` or `x,y,width,height`; null if out of range."""
    edge, share = F.split(spec, ":")[0], F.try_element_at(F.split(spec, ":"), F.lit(2)).try_cast("double")
    numbers = F.transform(F.split(spec, ","), lambda x: F.trim(x).try_cast("double"))
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    zero, one = F.lit(0.0), F.lit(1.0)
    ok = (share > 0) & (share < 1)
    by_edge = (
        F.when(ok & (edge == "left"), box(share, zero, one - share, one))
        .when(ok & (edge == "right"), box(zero, zero, one - share, one))
        .when(ok & (edge == "top"), box(zero, share, one, one - share))
        .when(ok & (edge == "bottom"), box(zero, zero, one, one - share))
    )
    n = [F.try_element_at(numbers, F.lit(i)) for i in (1, 2, 3, 4)]
    inside = (F.size(numbers) == 4) & (n[0] >= 0) & (n[1] >= 0) & (n[2] > 0) & (n[3] > 0) & (n[0] + n[2] <= 1) & (n[1] + n[3] <= 1)
    return F.when(spec.contains(":"), by_edge).when(inside, box(*n))


def parse_positions(text: Column) -> Column:
    """`1,2,3` as an array of longs; null if any part is no whole number."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("long"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)


def expected_frames(in_ms: Column, out_ms: Column, fps: Column) -> Column:
    """Frames that a concatenation gives a segment: frames that begin before its end less those before its start."""
    edge = lambda ms: F.ceil(ms / 1000.0 * fps - F.lit(1e-6))
    return (edge(out_ms) - edge(in_ms)).cast("long")


def expected_frames_plain(total_ms: Column, fps: Column) -> Column:
    """Frames of a length in milliseconds at the source's own rate."""
    return round_half_up(total_ms / 1000.0 * fps)


def at_centre(at_ms: Column, width_ms: int) -> tuple[Column, Column]:
    """A span of the given width about a point, moved to begin at 0 or later."""
    start = F.greatest(F.lit(0), at_ms - width_ms // 2)
    return start, start + width_ms


def next_generation(gens: Column, preset: Column) -> Column:
    """The generation of a preset in a map, or one more than the map's size."""
    return F.coalesce(F.try_element_at(gens, preset), F.size(gens) + 1)


def age_days(then: Column, now: Column) -> Column:
    return F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 86400).cast("long")


def content_key(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a binary column."""
    return F.substring(F.sha2(content, 256), 1, 16)
