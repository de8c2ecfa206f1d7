"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The evidence signals in their order, and for each the words that model answers use for it.
SIGNALS = ["tight_crop", "enlarged_crop", "full_frame", "temporal_context", "audio_brands", "faiss_matches", "ocr_text"]
SIGNAL_WORDS = {
    "tight_crop": ["crop", "crop_visual", "crop_image", "signal_1", "signal1", "detected_region"],
    "enlarged_crop": ["context_crop", "surrounding_context", "signal_2", "signal2", "zoomed_out_crop"],
    "full_frame": ["frame", "video_frame", "scene", "signal_3", "signal3", "full_video_frame"],
    "temporal_context": ["temporal", "temporal_frames", "nearby_frames", "signal_4", "signal4", "context_frames"],
    "audio_brands": ["audio", "audio_track", "audio_mentions", "transcript", "signal_5", "signal5"],
    "faiss_matches": ["faiss", "database", "brand_database", "visual_matches", "db_matches", "signal_6", "signal6"],
    "ocr_text": ["ocr", "detected_text", "text", "crop_text", "signal_7", "signal7"],
}


def safe_name(c: Column) -> Column:
    """A file name: anything but ASCII letters, digits, underscore and hyphen becomes an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "_")


def normalize(c: Column) -> Column:
    """Lower case, line breaks and tabs as spaces, only a-z, 0-9 and single spaces, trimmed."""
    x = F.regexp_replace(F.lower(c), r"[\r\n\t]", " ")
    x = F.regexp_replace(x, r"[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(x, " +", " "))


def split_digits(c: Column) -> Column:
    """A space wherever a digit and an ASCII letter meet."""
    return F.regexp_replace(c, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", " ")


def clean_ocr(c: Column, letters_only: bool = False) -> Column:
    """Lower case with single spaces; optionally only a-z and spaces."""
    x = F.lower(c)
    if letters_only:
        x = F.regexp_replace(x, r"[^a-z\s]", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def reading_order(lines: Column) -> Column:
    """OCR lines (structs y, x, text) joined from top to bottom and left to right, lower case, trimmed."""
    return F.trim(F.lower(F.array_join(F.transform(F.array_sort(F.transform(lines, lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x"), s["text"].alias("text")))), lambda s: s["text"]), " ")))


def outer_json(c: Column) -> Column:
    """From the first { to the last }, or null if that is no JSON."""
    x = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    one = F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1  # a parser alone would pass by what follows the first value
    return F.when(one, x)


def fenced_json(c: Column) -> Column:
    """Content of the first ```json fence, or null."""
    x = F.regexp_extract(c, r"(?s)```json\s*(.*?)```", 1)
    return F.when(x != "", F.trim(F.regexp_replace(x, r"\s+$", "")))


def signal_key(c: Column) -> Column:
    """Lower case with single underscores for anything but a-z and 0-9."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def canonical_signals(signals: Column, compat: bool = False) -> Column:
    """Signals in canonical form, each once, in order of first appearance.

    A key is taken by name, by the word list, else by the first canonical
    signal that holds it or is held by it.  An empty key is dropped; `compat`
    maps it to the first signal.
    """
    pairs = [(w, name) for name, also in SIGNAL_WORDS.items() for w in (name, *also)]
    words = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    names = F.array(*map(F.lit, SIGNALS))

    def one(item: Column) -> Column:
        key = signal_key(item)
        near = F.filter(names, lambda n: n.contains(key) | key.contains(n))
        named = F.coalesce(F.try_element_at(words, key), F.try_element_at(near, F.lit(1)))
        return named if compat else F.when(key != "", named)

    return F.array_distinct(F.filter(F.transform(signals, one), lambda s: s.isNotNull()))


def verdict(c: Column) -> Column:
    """A model's verdict text as Other, Incorrect or Correct; anything else is Incorrect."""
    x = F.lower(F.coalesce(c, F.lit("")))
    return F.when(x.contains("other"), "Other").when(x.contains("incorrect"), "Incorrect").when(x.contains("correct"), "Correct").otherwise("Incorrect")


def brand_lines(c: Column) -> Column:
    """A newline list as trimmed lower-case names, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def after_last(c: Column, mark: str) -> Column:
    """What follows the last `mark`, trimmed; the whole text without one."""
    return F.regexp_replace(F.element_at(F.split(c, mark), -1), r"^\s+|\s+$", "")


def after_first(c: Column, mark: str, blank: str = r"\s") -> Column:
    """What lies between the first and the second `mark`, without the `blank` characters around it; null without one."""
    return F.regexp_replace(F.get(F.split(c, mark), F.lit(1)), rf"^{blank}+|{blank}+\z", "")


def header_line(c: Column, header: str) -> Column:
    """The rest of the line after a quoted header and a colon, trimmed; null without one."""
    x = F.regexp_extract(c, rf'"{header}":\s*([^\n]*)', 1)
    return F.when(c.rlike(rf'"{header}":'), F.trim(x))


def detection_label(is_logo: Column, brand: Column, confidence: Column, truncated: Column) -> Column:
    """Caption of a detection."""
    none = F.lit("")
    name = F.when(F.coalesce(brand, none) == "", "UNKNOWN").otherwise(brand)
    score = F.when(confidence.isNotNull(), F.concat(F.lit(" "), confidence.cast("int").cast("string"))).otherwise(none)
    part = F.when(is_logo == "partial_logo", " (partial)").otherwise(none)
    cut = F.when(truncated, " [cut off]").otherwise(none)
    return F.when(is_logo.isin("logo", "partial_logo"), F.concat(name, score, part, cut)).when(is_logo == "not_logo", "not a logo").otherwise("unparsed")


def interval_info(brand: Column, start: Column, stop: Column, source: Column) -> Column:
    """One-line description of a brand's interval; line breaks in the brand become ' or '."""
    return F.concat(F.regexp_replace(brand, "\n", " or "), F.lit(" from "), start.cast("string"), F.lit(" to "), stop.cast("string"), F.lit(" via "), source)


def first_existing(name: Column, known: Column, folders: list[str]) -> Column:
    """The name itself, or within the first folder, that is in the array `known`; else null."""
    tries = [name, *(F.concat(F.lit(f.rstrip("/") + "/"), name) for f in folders)]
    return F.coalesce(*(F.when(F.array_contains(known, t), t) for t in tries))


def remap(path: Column, old: str, new: str) -> Column:
    """A path with one literal prefix or part put in place of another; unchanged where either is empty."""
    return F.replace(path, F.lit(old), F.lit(new)) if old and new else path


def file_numbers(name: Column) -> dict[str, Column]:
    """Sort key of names like frame12_logo3: those that don't match come last, by lower-case name."""
    hit = name.rlike(r"^frame\d+_logo\d+")
    number = lambda k: F.when(hit, F.regexp_extract(name, r"^frame(\d+)_logo(\d+)", k).cast("long"))
    return {"unmatched": ~hit, "frame": number(1), "logo": number(2), "lower_name": F.lower(name)}


def parse_list(c: Column) -> Column:
    """A JSON list of texts; an empty list where it is none."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def affirms(c: Column, word: str = "yes") -> Column:
    """Whether a verifier's answer holds the word; false without an answer."""
    return F.coalesce(F.lower(c).contains(word), F.lit(False))


def content_id(data: Column, *other: Column) -> Column:
    """An id by content; by the other columns where there is none, so that it is the same on every run."""
    return F.coalesce(F.md5(data), F.sha2(F.concat_ws("\x1f", *(o.cast("string") for o in other)), 256))
