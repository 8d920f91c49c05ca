"""Column functions on captions and answers: parsing, cutting and formatting. Null text gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number has digits before its point; blanks may stand on both sides of a comma.
NUMBER = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
DECIMAL = r"([-+]?[0-9]+\.[0-9]+)"
COMMA = r"\s*,\s*"
BASE = rf"(?U)are:\s*{NUMBER}{COMMA}{NUMBER}{COMMA}{NUMBER}[.\s]*$"
ANSWER = rf"(?U)<answer>\s*{NUMBER}{COMMA}{NUMBER}{COMMA}{NUMBER}\s*</answer>"
LENIENT = rf"(?U){DECIMAL}{COMMA}{DECIMAL}{COMMA}{DECIMAL}"
#: roll, pitch and vertical field of view where no triple is found (fixed values).
DEFAULTS = (0.0, 0.0, 0.9163)


def triple(text: Column, pattern: str, defaults: tuple | None = None, strict: bool = False) -> list[Column]:
    """The three numbers of the first match; else the defaults, an error if strict, or null."""
    hit = F.regexp_extract(text, pattern, 0) != ""
    out = []
    for i in range(3):
        value = F.regexp_extract(text, pattern, i + 1).try_cast("double")
        if defaults is not None:
            out.append(F.when(hit, value).otherwise(F.lit(defaults[i])))
        elif strict:
            out.append(F.when(hit, value).otherwise(F.raise_error(F.lit("no camera parameters in text")).cast("double")))
        else:
            out.append(F.when(hit, value))
    return out


def think(text: Column) -> Column:
    """The text between think tags, stripped; the whole text where there is none."""
    return strip(F.when(text.rlike(r"(?s)<think>.*?</think>"), F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)).otherwise(text))


def strip(text: Column) -> Column:
    """Without white space at both ends, that of Unicode and the ASCII separators included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def camera_sentence(text: Column) -> Column:
    """From the words that introduce the parameters to the end of the line; the whole text without them."""
    got = F.regexp_extract(text, r"(The camera parameters[^\n]*)$", 1)
    return F.when(got != "", got).otherwise(text)


def stem(path: Column, suffix: str | None = None) -> Column:
    """The file name without its last extension, or with another one."""
    name = F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
    return name if suffix is None else F.concat(name, F.lit(f".{suffix.lstrip('.')}"))


def json_text(document: Column, field: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(document, f"$.{field}"), F.lit(default))


def fixed(x: Column, digits: int) -> Column:
    """A double with 1 to 7 decimals, rounded by its exact binary value, ties to even, as C and Python do; `format_string` rounds its shortest decimal form, ties up.

    The rest of the scaled value is exact: what the product loses comes from the two halves of the factor.
    """
    scale, a = 10.0**digits, F.abs(x)
    product, high = a * scale, a * 134217729.0 - (a * 134217729.0 - a)
    lost = (high * scale - product) + (a - high) * scale
    whole = F.floor(product)
    rest = product - whole
    n = whole + F.when((rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1)))), 1).otherwise(0)
    sign = F.when((x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-"))), "-").otherwise("")
    text = F.concat(sign, F.floor(n / int(scale)).cast("string"), F.lit("."), F.lpad((n % int(scale)).cast("string"), digits, "0"))
    return F.when(a * scale < 2.0**52, text).otherwise(F.format_string(f"%.{digits}f", x))


def formatted(template: str, digits: int, *numbers: Column) -> Column:
    """A template whose `{}` places take numbers with so many decimals."""
    parts = template.split("{}")
    return F.concat(*[c for part, x in zip(parts, numbers) for c in (F.lit(part), fixed(x, digits))], F.lit(parts[-1]))


def sentence(roll: Column, pitch: Column, vfov: Column, yaw: Column | None = None) -> Column:
    """The sentence that states camera parameters with four decimals."""
    text = formatted("The camera parameters (roll, pitch, and field-of-view) are: {}, {}, {}.", 4, roll, pitch, vfov)
    return text if yaw is None else F.concat(text, formatted(" The deviation of the camera yaw angle is {}.", 4, yaw))


def merged(base: Column, thinking: Column) -> Column:
    """The base caption followed by the thinking one's thoughts."""
    return F.concat(base, F.lit(" "), think(thinking))


#: Parts of the chat format (fixed values).
CHAT = {
    "instruction": ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"),
    "generation": ("Generate an image: ", ""),
    "cross_view": ("Generate a target image given an initial view: ", ""),
    "image": ("<|vision_start|>", "<|image_pad|>", "<|vision_end|>"),
}


def chat(kind: str, text: Column) -> Column:
    before, after = CHAT[kind]
    return F.concat(F.lit(before), text, F.lit(after))


def image_run(length: Column | int) -> Column:
    """The place of an image of so many tokens."""
    start, pad, end = CHAT["image"]
    return F.concat(F.lit(start), F.repeat(F.lit(pad), length if isinstance(length, Column) else F.lit(length)), F.lit(end))


def image_prompt(kind: str, text: Column, length: Column | int) -> Column:
    """An instruction with an image before the text, as for generation with one or more reference images."""
    return chat("instruction", F.concat(image_run(length), F.lit("\n"), chat(kind, text)))


#: Yaw in radians of named places around the viewer, as text (fixed values).
PLACES = {"left": "1.5710", "behind": "3.1416", "right": "4.7120"}


def place_yaw(name: Column, places: dict[str, str] = PLACES) -> Column:
    """The yaw of a place as text; null for a name that isn't listed."""
    out = F.lit(None).cast("string")
    for k, v in places.items():
        out = F.when(F.lower(name) == k, F.lit(v)).otherwise(out)
    return out


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template whose `{key}` places take the row's values; a key without a value is an error."""
    out = []
    for piece in re.split(r"(\{\w+\})", template):
        out.append(values[piece[1:-1]].cast("string") if piece.startswith("{") and piece.endswith("}") else F.lit(piece))
    return F.concat(*out)


def category(label: Column) -> Column:
    """A label of digits as a number, any other as null."""
    return F.when(label.rlike("^[0-9]+$"), label.try_cast("long"))


def is_json(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".json"))
