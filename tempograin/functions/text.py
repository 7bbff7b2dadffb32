"""Text clean-up rules of the session metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "absent", of "no injury", and diagnosis synonyms.
NULL_TOKENS = ["", "nan", "null", "n/a", "none"]
NO_INJURY_TOKENS = [*NULL_TOKENS, "no injury"]
SYNONYMS = {
    "oa": "osteoarthritis",
    "hip oa": "osteoarthritis",
    "knee oa": "osteoarthritis",
    "osteroarthritis": "osteoarthritis",
    "itbs": "itb syndrome",
    "pfps": "patellofemoral pain syndrome",
}
# Plausible inclusive range of each numeric column.
PLAUSIBLE = {
    "age": (10.0, 100.0),
    "height": (120.0, 250.0),
    "weight": (30.0, 200.0),
    "speed": (0.5, 8.0),
    "years": (0.0, 80.0),
}
SEVERITY = ["no injury", "minor", "moderate", "severe"]


def normalise(value: Column) -> Column:
    """Lower case, whitespace collapsed, ends trimmed; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


def is_blank(value: Column) -> Column:
    """Whether the text is any spelling of absent; NULL counts."""
    return normalise(value).isin(NULL_TOKENS)


def is_no_injury(value: Column) -> Column:
    """Whether the whole text, or every comma part of it, says no injury."""
    parts = F.split(normalise(value), ",")
    return F.forall(parts, lambda p: F.trim(p).isin(NO_INJURY_TOKENS))


def merge_synonyms(value: Column, table: dict[str, str] | None = None) -> Column:
    """Normalised text with known synonyms replaced."""
    text = normalise(value)
    pairs = F.create_map(*[F.lit(x) for kv in (table or SYNONYMS).items() for x in kv])
    return F.coalesce(F.element_at(pairs, text), text)


def to_number(value: Column) -> Column:
    """Lenient cast: anything that is not a finite-or-signed number becomes NULL."""
    number = F.trim(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def in_range(value: Column, bounds: tuple[float, float]) -> Column:
    """The value if inside the inclusive range, else NULL."""
    return F.when(value.between(*bounds), value)


def injury_status(definition: Column, joint: Column, diagnosis: Column) -> Column:
    """uninjured / injured / unknown; a recorded diagnosis outranks a blank severity."""
    text = normalise(definition)
    diagnosed = ~is_no_injury(diagnosis)
    return (F.when((text == "no injury") & is_no_injury(joint) & ~diagnosed, "uninjured")
            .when(diagnosed | ~text.isin(NO_INJURY_TOKENS), "injured")
            .otherwise("unknown"))


def mixed_timestamp(value: Column) -> Column:
    """A timestamp from any of the layouts the metadata mixes."""
    text = F.trim(value)
    return F.coalesce(*[
        F.try_to_timestamp(text, F.lit(layout))
        for layout in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")])


def severity_rank(value: Column) -> Column:
    """Position on the severity ladder, NULL off it."""
    ladder = F.create_map(*[x for i, s in enumerate(SEVERITY) for x in (F.lit(s), F.lit(i))])
    return F.element_at(ladder, normalise(value))
