"""Box geometry and small scalar rules, as column expressions.

Boxes are four columns x1, y1, x2, y2.  Nulls give nulls unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the heuristic crop filter.
LEAST_AREA, MOST_FRAME_SHARE, MOST_ASPECT = 500, 0.5, 4.0
#: The least side of a crop, of a model input, and of an OCR input before it is tripled.
LEAST_CROP, LEAST_INPUT, LEAST_OCR = 16, 28, 80
#: Fixed value: frames a second that the annotation tool assumes.
ANNOTATION_FPS = 30.0


def percent_area(w: Column, h: Column, frame_area: Column) -> Column:
    """Share of the frame in percent."""
    return w * h / frame_area * 100.0


def enlarge(x1: Column, y1: Column, x2: Column, y2: Column, factor: float, width: Column, height: Column) -> dict[str, Column]:
    """The box grown about its middle by `factor`, within the frame."""
    px, py = (x2 - x1) * (factor - 1.0) / 2.0, (y2 - y1) * (factor - 1.0) / 2.0
    zero = F.lit(0.0)
    return {"x1": F.greatest(zero, x1 - px), "y1": F.greatest(zero, y1 - py), "x2": F.least(width, x2 + px), "y2": F.least(height, y2 + py)}


def crop(x1: Column, y1: Column, x2: Column, y2: Column, least: int = LEAST_CROP) -> dict[str, Column]:
    """Corners rounded half to even and put in order, and whether both sides reach `least`."""
    a, b, c, d = (F.bround(v, 0).cast("int") for v in (x1, y1, x2, y2))
    out = {"x1": F.least(a, c), "y1": F.least(b, d), "x2": F.greatest(a, c), "y2": F.greatest(b, d)}
    return out | {"usable": (out["x2"] - out["x1"] >= least) & (out["y2"] - out["y1"] >= least)}


def crop_pair(x1: Column, y1: Column, x2: Column, y2: Column, factor: float, width: Column, height: Column, least: int = LEAST_CROP) -> dict[str, Column]:
    """The tight crop, and the enlarged one, which is the tight one where it is too small: two structs, and whether the tight one is usable."""
    tight = crop(x1, y1, x2, y2, least)
    large = crop(*enlarge(x1, y1, x2, y2, factor, width, height).values(), least)
    box = lambda c: F.struct(*(c[n].alias(n) for n in ("x1", "y1", "x2", "y2")))
    return {"tight": box(tight), "enlarged": F.when(large["usable"], box(large)).otherwise(box(tight)), "usable": tight["usable"]}


def clamp(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box within the image: the first corner on a pixel, the second up to the edge."""
    zero = F.lit(0)
    return {"x1": F.greatest(zero, F.least(x1, width - 1)), "y1": F.greatest(zero, F.least(y1, height - 1)), "x2": F.greatest(zero, F.least(x2, width)), "y2": F.greatest(zero, F.least(y2, height))}


def touches_edge(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, tolerance: int = 2) -> Column:
    """Whether a side lies at the frame's edge; false if anything is null."""
    t = F.lit(tolerance)
    hit = (x1 <= t) | (y1 <= t) | (x2 >= width - t) | (y2 >= height - t)
    known = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull() & width.isNotNull() & height.isNotNull()
    return F.coalesce(known & hit, F.lit(False))


def from_percent(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Percent units to pixels, cut to whole numbers."""
    return {"x1": (x / 100.0 * width).cast("int"), "y1": (y / 100.0 * height).cast("int"), "x2": ((x + w) / 100.0 * width).cast("int"), "y2": ((y + h) / 100.0 * height).cast("int")}


def annotation_frame(frame: Column, fps: Column) -> Column:
    """A frame of the annotation tool as a frame of the video."""
    return (frame / F.lit(ANNOTATION_FPS) * fps).cast("int")


def model_input_size(w: Column, h: Column, least: int = LEAST_INPUT) -> tuple[Column, Column]:
    """Size grown until both sides reach `least`."""
    scale = F.greatest(F.lit(float(least)) / w, F.lit(float(least)) / h)
    small = (w < least) | (h < least)
    return F.when(small, F.ceil(w * scale)).otherwise(w.cast("long")), F.when(small, F.ceil(h * scale)).otherwise(h.cast("long"))


def ocr_size(w: Column, h: Column) -> tuple[Column, Column]:
    """Size tripled where the shorter side is small."""
    times = F.when(F.least(w, h) < LEAST_OCR, 3).otherwise(1)
    return w * times, h * times


def clamp_score(raw: Column) -> Column:
    """A score text as 0 to 100, cut to a whole number; null for what is no finite number."""
    v = F.expr("1D") * raw.try_cast("double")
    fine = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(fine, F.least(F.lit(100), F.greatest(F.lit(0), F.greatest(F.lit(-1.0), F.least(F.lit(101.0), v)).cast("int"))))


def score_band(score: Column) -> Column:
    """Colour of a score: green from 75, amber from 45, else red; grey without one."""
    return F.when(score.isNull(), "grey").when(score >= 75, "green").when(score >= 45, "amber").otherwise("red")


def dark_text(r: Column, g: Column, b: Column) -> Column:
    """Whether text on this colour should be dark."""
    return 0.299 * r + 0.587 * g + 0.114 * b > 128


def passes_area(w: Column, h: Column, frame_area: Column | None = None) -> Column:
    """The area, frame share and aspect filter; without a frame area the share is not tested."""
    ok = (w * h >= LEAST_AREA) & (F.greatest(w, h) / (F.least(w, h) + 1e-6) <= MOST_ASPECT)
    if frame_area is not None:
        ok = ok & (frame_area.isNull() | (w * h / frame_area <= MOST_FRAME_SHARE))
    return F.coalesce(ok, F.lit(False))


def all_pass(*conditions: Column) -> Column:
    """Whether every filter passes; one that fails to decide rejects."""
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out
