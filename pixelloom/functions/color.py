"""Colour projections as Column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# CSS Color 4 matrices between linear sRGB and Oklab.
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# The opt-in night palette by role.
NIGHT_PALETTE = {"sky": (21, 25, 24), "luminous-outer": (109, 93, 99), "luminous-inner": (150, 128, 135), "foreground": (112, 72, 50), "shadow": (59, 37, 31), "light": (183, 125, 80), "star": (232, 215, 207)}
CHROMA_TRIES, CHROMA_STEP, CHROMA_LIMIT = 32, 0.94, 0.18
LIGHT_LOW, LIGHT_HIGH = 0.055, 0.94


def _dot(row: tuple[float, ...], cols: list[Column]) -> Column:
    out = F.lit(row[0]) * cols[0]
    for w, c in zip(row[1:], cols[1:], strict=True):
        out = out + F.lit(w) * c
    return out


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of clamped channels, fractions cut off."""
    return F.format_string("#%02X%02X%02X", *(clamp(c, 0, 255).cast("int") for c in (r, g, b)))


def weighted_distance(one: list[Column], two: list[Column]) -> Column:
    """Distance of two RGB colours, channels weighted .30, .59 and .11, black to white near 0.67."""
    parts = [F.pow((a - b) * w, F.lit(2)) for a, b, w in zip(one, two, (0.30, 0.59, 0.11), strict=True)]
    return F.sqrt(parts[0] + parts[1] + parts[2]) / 255.0


def linear(channel: Column) -> Column:
    """A byte channel in linear light."""
    s = channel / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    rgb = [linear(c) for c in (r, g, b)]
    roots = [F.cbrt(_dot(row, rgb)) for row in RGB_TO_LMS]
    return [_dot(row, roots) for row in LMS_TO_LAB]


def from_oklab(lab: list[Column]) -> Column:
    """struct<r, g, b> of bytes, rounded half to even; null outside the gamut."""
    cubes = [F.pow(_dot(row, lab), F.lit(3)) for row in LAB_TO_LMS]
    light = [_dot(row, cubes) for row in LMS_TO_RGB]
    inside = [(c >= -1e-5) & (c <= 1.00001) for c in light]
    bytes_ = []
    for c in light:
        c = clamp(c, 0.0, 1.0)
        s = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)
        bytes_.append(F.rint(s * 255.0).cast("int"))
    return F.when(inside[0] & inside[1] & inside[2], F.struct(*(v.alias(n) for v, n in zip(bytes_, "rgb", strict=True))))


def balanced(r: Column, g: Column, b: Column, light_shift: float = 0.0) -> Column:
    """Lightness and chroma kept in bounds at the same hue; chroma shrinks until the colour is in gamut."""

    def in_gamut(lab: Column) -> Column:
        most, angle = F.least(F.hypot(lab[1], lab[2]), F.lit(CHROMA_LIMIT)), F.atan2(lab[2], lab[1])
        seed = F.array(clamp(lab[0] + light_shift, LIGHT_LOW, LIGHT_HIGH), most * F.cos(angle), most * F.sin(angle))
        return _bound(seed, lambda s: F.aggregate(tries, none, lambda found, i: F.coalesce(found, from_oklab([s[0], *(s[k] * F.pow(F.lit(CHROMA_STEP), i) for k in (1, 2))]))))

    tries, none = F.sequence(F.lit(0), F.lit(CHROMA_TRIES - 1)), F.lit(None).cast("struct<r:int,g:int,b:int>")
    own = F.struct(*(clamp(c, 0, 255).cast("int").alias(n) for c, n in zip((r, g, b), "rgb", strict=True)))
    return F.coalesce(_bound(F.array(*oklab(r, g, b)), in_gamut), own)


def _bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def output_color(r: Column, g: Column, b: Column, mode: str, role: Column | None = None, light_shift: float = 0.0) -> Column:
    """The source colour, unless the balanced or the curated night mode is asked for."""
    own = F.struct(*(c.cast("int").alias(n) for c, n in zip((r, g, b), "rgb", strict=True)))
    if mode == "balanced" or abs(light_shift) > 1e-9:
        own = balanced(r, g, b, light_shift)
    if mode == "curated-night" and role is not None:
        for name, rgb in NIGHT_PALETTE.items():
            own = F.when(role == name, F.struct(*(F.lit(v).alias(n) for v, n in zip(rgb, "rgb", strict=True)))).otherwise(own)
    return own


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).cast("int")


def warmth(r: Column, b: Column) -> Column:
    return r - b


def atmospheric_chroma(r: Column, g: Column, b: Column) -> Column:
    return (r + b) / 2.0 - g


def chroma(lab: list[Column]) -> Column:
    return F.sqrt(lab[1] * lab[1] + lab[2] * lab[2])


def hue_cosine(one: list[Column], two: list[Column]) -> Column:
    """Cosine of the hue angle between two Oklab colours; lists of L, a, b."""
    return (one[1] * two[1] + one[2] * two[2]) / F.greatest(F.lit(1e-8), chroma(one) * chroma(two))


def oklab_distance(one: list[Column], two: list[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(one[1:], two[1:], strict=True)), (one[0] - two[0]) * (one[0] - two[0])))


def star_color(c: Column) -> Column:
    return F.floor(c * 0.72 + 0.28 * 255).cast("int")
