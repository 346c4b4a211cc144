"""Text expressions: model output to JSON, names, and values from the environment."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields that a checked cell's answer has.
ANSWER = "corrected string, confidence string, reasoning string"
#: The mark of a fenced block, the name its opening may carry, and what counts as blank.
FENCE, LANGUAGE, BLANK = "```", "json", " \t\n\r\f\x0b"
#: Fixed value: how a reference to the environment begins.
REFERENCE = "${env:"


def fix_json(text: Column) -> Column:
    """The inside of the first closed fence, without blanks around it, or else the whole text as it is; and without each comma that is
    followed by nothing but blanks before a closing bracket. The blanks themselves stay. Null stays null."""
    parts = F.split(text, FENCE)
    inside = F.get(parts, F.lit(1))
    inside = F.when(F.startswith(inside, F.lit(LANGUAGE)), F.substr(inside, F.lit(len(LANGUAGE) + 1))).otherwise(inside)
    pieces = F.split(F.when(F.size(parts) > 2, F.btrim(inside, F.lit(BLANK))).otherwise(text), ",")

    def rejoined(piece: Column, place: Column) -> Column:
        closes = F.left(F.ltrim(piece, F.lit(BLANK)), F.lit(1)).isin("}", "]")
        return F.when((place == 0) | closes, piece).otherwise(F.concat(F.lit(","), piece))

    return F.when(text.isNotNull(), F.array_join(F.transform(pieces, rejoined), ""))


def parse_answer(text: Column) -> Column:
    """The answer as a struct; null where the text holds none."""
    return F.from_json(fix_json(text), ANSWER)


def short_name(model: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(model, "/", -1)


def from_environment(setting: object) -> object:
    """The setting with each string that begins with a reference, ``${env:NAME}`` or ``${env:NAME:default}``, replaced by the variable's
    value, the default, or None. What follows the reference is dropped; strings without a name or a closing brace stay."""
    match setting:
        case dict():
            return dict(zip(setting, map(from_environment, setting.values())))
        case list():
            return [*map(from_environment, setting)]
        case str() if setting.startswith(REFERENCE):
            body, closed, _ = setting.removeprefix(REFERENCE).partition("}")
            name, given, default = body.partition(":")
            return os.environ.get(name, default if given else None) if closed and name else setting
    return setting
