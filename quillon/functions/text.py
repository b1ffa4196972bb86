"""Text functions of the alignment pipeline, as Column expressions.

Columns or names of columns may be given. Nulls count as empty strings unless a function says otherwise. White space is
Unicode white space, at the ends as in the middle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " | "
DEFAULT_TOKEN = r"[\p{L}\p{N}]+"

# Annotation properties that describe a class, the first with a text wins.
DESCRIPTION_PROPERTIES = ("IAO_0000115", "definition", "description", "hasDefinition", "comment", "note", "IAO_0000116")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_of(c: Column | str) -> Column:
    """The value as a string, empty for null."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Lower case, with one space for each run of white space and none at the ends."""
    return strip(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def normalize_label(c: Column | str) -> Column:
    return collapse(text_of(c))


def camelcase_split(c: Column | str) -> Column:
    """A space between a small letter and a capital."""
    return F.regexp_replace(col(c), "([a-z])([A-Z])", "$1 $2")


def humanize_name(c: Column | str) -> Column:
    """Words of an identifier: '_' and '-' and each capital but the first start one."""
    return strip(F.lower(F.regexp_replace(F.translate(text_of(c), "_-", "  "), "(?<!^)(?=[A-Z])", " ")))


def miner_normalize(c: Column | str) -> Column:
    """Words of a label in ASCII letters and digits only."""
    split = F.regexp_replace(text_of(c), "(?<!^)(?=[A-Z])", " ")
    return collapse(F.regexp_replace(split, "[^a-zA-Z0-9]", " "))


def split_multi(c: Column | str) -> Column:
    """The values of a '|'-separated string, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text_of(c), r"\|"), strip), lambda x: x != "")


def miner_synonyms(c: Column | str) -> Column:
    return F.transform(split_multi(c), miner_normalize)


def first_text(*columns: Column | str) -> Column:
    """The first value that isn't blank, stripped; null if all are."""
    return F.coalesce(*[F.nullif(strip(text_of(c)), F.lit("")) for c in columns])


def scoring_text(scoring: Column | str, retrieval: Column | str) -> Column:
    """The stripped scoring text, or else the stripped retrieval text."""
    return F.coalesce(first_text(scoring), strip(text_of(retrieval)))


def tokens(c: Column | str, pattern: str = DEFAULT_TOKEN) -> Column:
    """The tokens of a normalised form, in order, repeats too."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(pattern), F.lit(0))


def class_forms(label: Column | str, synonyms: Column | str) -> Column:
    """The normalised label, then synonyms, each once."""
    return F.array_distinct(
        F.filter(F.transform(F.concat(F.array(text_of(label)), split_multi(synonyms)), normalize_label), lambda x: x != "")
    )


@dataclass(frozen=True)
class SourceTextConfig:
    """Which fields go into a source text."""

    use_label: bool = True
    use_description: bool = True
    use_synonyms: bool = False
    use_parents: bool = False
    use_equivalent: bool = False
    use_disjoint: bool = False


# Field names in texts; sources have them in lower case, targets capitalise the last four.
_FIELDS = (
    ("label", "label"),
    ("description", "description"),
    ("synonyms", "synonyms"),
    ("parents_label", "parents"),
    ("equivalent_to", "equivalent to"),
    ("disjoint_with", "disjoint with"),
)


def _text(names: dict[str, str], used: set[str]) -> Column:
    parts = []
    for field, name in names.items():
        if field not in used:
            continue
        value = strip(text_of(field))
        part = F.when(value != "", F.concat(F.lit(f"{name}: "), value))
        if field == "label":
            local = strip(text_of("local_name"))
            part = part.otherwise(F.when(local != "", F.concat(F.lit("local name: "), local)))
        parts.append(part)
    return F.concat_ws("; ", *parts) if parts else F.lit("")


def source_text(config: SourceTextConfig = SourceTextConfig()) -> Column:
    """The text of a unified concept as a source."""
    used = {field for (field, _), use in zip(_FIELDS, (config.use_label, config.use_description, config.use_synonyms, config.use_parents, config.use_equivalent, config.use_disjoint), strict=True) if use}
    return _text(dict(_FIELDS), used)


def target_text() -> Column:
    """The text of a unified concept as a target, of all its fields."""
    names = {field: name if field in ("label", "description") else name.capitalize() for field, name in _FIELDS}
    return _text(names, set(names))
