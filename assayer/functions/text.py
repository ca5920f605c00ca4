"""Text normalisation as Catalyst expressions.

Everything stays in the JVM except Unicode compatibility forms (NFKC/NFKD),
which Spark has no expression for. Those go through one Arrow UDF that is fed
only the values holding non-ASCII characters; other rows pass a null to it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.numbers import SPACES
from assayer.spec import (
    DURATION_UNITS,
    MISSING_TOKENS,
    NOT_APPLICABLE_LABEL,
    NOT_APPLICABLE_TOKENS,
    NOT_YET_TOKENS,
    SCORING_PLACEHOLDER,
    UNKNOWN_TOKENS,
    UNKNOWN_UNIT_LABEL,
)

# White space as Unicode defines it, plus the four ASCII separators.
# Single characters rather than ranges: the regex engine tests those with one table look-up.
_ASCII_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
_SPACE = rf"{_ASCII_SPACE} \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}"
SPACE_RUN = rf"[{_SPACE}]+"
NOT_SPACE = rf"[^{_SPACE}]"
# What makes an ASCII text uneven: any white space but the plain space, or two spaces in a row.
UNEVEN_ASCII = rf"[{_ASCII_SPACE}]|  "
NON_ASCII = r"[^\x00-\x7F]"


def _latin_folding() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from the Unicode tables."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if ord(ch) < 128)
        if len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _latin_folding()


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    def fold(value: str) -> str:
        return unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode("ascii")

    return values.map(fold, na_action="ignore")


def _only_non_ascii(function, column: Column) -> Column:
    return F.coalesce(function(F.when(~is_ascii(column), column)), column)


def is_ascii(column: Column) -> Column:
    """As many bytes as characters: no pattern matching needed."""
    return F.octet_length(column) == F.length(column)


def _tidy(text: Column) -> Column:
    """Even ASCII text, the usual case, is only looked at, and once; the rest is rewritten."""
    ends = (text == "") | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    even = is_ascii(text) & ~ends & ~text.rlike(UNEVEN_ASCII)
    return F.when(even, text).when(text.rlike(NOT_SPACE), F.trim(F.regexp_replace(text, SPACE_RUN, " ")))


def normalize_text(column: Column, nfkc: bool = False) -> Column:
    """Collapse white space, trim, and turn the empty string into null."""
    text = column.cast("string")
    return _tidy(_only_non_ascii(_nfkc, text) if nfkc else text)


def token_of(text: Column, nfkc: bool = False) -> Column:
    """Token of an already normalised text. Only non-ASCII texts are folded and tidied again."""
    lower = F.lower(text)
    if nfkc:
        folded = _ascii_fold(F.when(~is_ascii(lower), lower))
    else:
        folded = F.regexp_replace(F.translate(lower, _ACCENTED, _PLAIN), NON_ASCII, "")
    return F.when(is_ascii(text), lower).otherwise(_tidy(folded))


def with_tokens(df: DataFrame, tokens: dict[str, Column]) -> DataFrame:
    """Add ``normalize_token`` columns step by step, so that no step repeats the one before it inside its expression."""
    out = df.withColumns({f"__t_{n}": normalize_text(c) for n, c in tokens.items()})
    folded = {
        f"__f_{n}": F.when(~is_ascii(F.col(f"__t_{n}")), F.regexp_replace(F.translate(F.lower(F.col(f"__t_{n}")), _ACCENTED, _PLAIN), NON_ASCII, "")) for n in tokens
    }
    out = out.withColumns(folded).withColumns({
        n: F.when(is_ascii(F.col(f"__t_{n}")), F.lower(F.col(f"__t_{n}"))).otherwise(_tidy(F.col(f"__f_{n}"))) for n in tokens
    })
    return out.drop(*[f"__{k}_{n}" for n in tokens for k in "tf"])


def normalize_token(column: Column, nfkc: bool = False) -> Column:
    """Lower case, no accents, ASCII only: the form placeholder lists are compared in."""
    return token_of(normalize_text(column, nfkc), nfkc)


def canonicalize_text(
    column: Column,
    preserve_not_applicable: bool = False,
    preserve_unknown: bool = False,
    missing_label: str | None = None,
    nfkc: bool = False,
    normalized: bool = False,
) -> Column:
    """Replace placeholder texts by null (or a label); keep everything else normalised.

    ``normalized`` says the column already went through ``normalize_text`` in an
    earlier projection, so that work is not repeated inside this expression.
    """
    text = column if normalized else normalize_text(column, nfkc)
    labels = {
        **dict.fromkeys(MISSING_TOKENS + NOT_YET_TOKENS, missing_label),
        **dict.fromkeys(NOT_APPLICABLE_TOKENS, NOT_APPLICABLE_LABEL if preserve_not_applicable else missing_label),
        **dict.fromkeys(UNKNOWN_TOKENS, UNKNOWN_UNIT_LABEL if preserve_unknown else missing_label),
    }
    # One branch per distinct label, so the token is computed once in the usual case.
    token, chain = token_of(text, nfkc), F
    for label in dict.fromkeys(labels.values()):
        tokens = [t for t, target in labels.items() if target == label]
        chain = chain.when(token.isin(*tokens), F.lit(label).cast("string"))
    return chain.otherwise(text)


def missing_state(column: Column) -> Column:
    """Why a value is absent: ``missing``, ``not_applicable``, ``not_yet_available`` or ``present``."""
    token = normalize_token(column)
    return (
        F.when(token.isNull() | token.isin(*MISSING_TOKENS, *UNKNOWN_TOKENS), "missing")
        .when(token.isin(*NOT_APPLICABLE_TOKENS), "not_applicable")
        .when(token.isin(*NOT_YET_TOKENS), "not_yet_available")
        .otherwise("present")
    )


def stripped(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(column.cast("string"), F.lit(SPACES))


def trimmed(column: Column) -> Column:
    return stripped(F.coalesce(column.cast("string"), F.lit("")))


def non_placeholder(column: Column) -> Column:
    """True when the text is not blank and not one of the phrases scoring rejects."""
    return ~F.lower(trimmed(column)).rlike(SCORING_PLACEHOLDER)


def text_length(column: Column) -> Column:
    return F.length(trimmed(column))


def multivalue_text(column: Column, normalized: bool = False) -> Column:
    """``"[a, b, a]"`` to ``"a, b"``: brackets off, blanks out, first occurrence kept."""
    text = column if normalized else normalize_text(column)
    inner = F.when(F.startswith(text, F.lit("[")) & F.endswith(text, F.lit("]")) & (F.length(text) >= 2), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    pieces = F.transform(F.split(inner, ","), lambda piece: F.trim(piece))
    listed = F.nullif(
        F.array_join(F.array_distinct(F.filter(pieces, lambda piece: piece != "")), ", "), F.lit("")
    )
    # A normalised text of one piece is its own list.
    single = ~F.contains(text, F.lit(",")) & ~F.startswith(text, F.lit("["))
    return F.when(single, text).otherwise(listed)


def flatten_url(df: DataFrame, name: str, field: str = "url") -> Column:
    """The url inside a struct, a JSON text, or the plain text itself."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StructType):
        return normalize_text(F.col(name).getField(field))
    text = F.col(name).cast("string")
    return normalize_text(F.when(text.rlike(r"^\s*\{"), F.get_json_object(text, f"$.{field}")).otherwise(text))


def hashable(df: DataFrame, name: str) -> Column:
    """A groupable form of any column: maps get sorted keys, nested values become JSON."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(column)
    return column


def sorted_json(column: Column) -> Column:
    """JSON object text rewritten with its keys in order, so equal objects compare equal."""
    entries = F.map_entries(F.from_json(column, T.MapType(T.StringType(), T.StringType())))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def _lookup(pairs: dict[str, object], token: Column) -> Column:
    literals = [F.lit(x) for pair in pairs.items() for x in pair]
    return F.try_element_at(F.create_map(*literals), token)


def duration_unit(column: Column, nfkc: bool = False, normalized: bool = False) -> Column:
    """Canonical unit name; anything not recognised is the unknown-unit label. ``normalized`` as in ``canonicalize_text``."""
    return unit_of_token(token_of(column, nfkc) if normalized else normalize_token(column, nfkc))


def unit_of_token(token: Column) -> Column:
    """``duration_unit`` of a token from an earlier projection."""
    names = dict.fromkeys((*NOT_APPLICABLE_TOKENS, NOT_APPLICABLE_LABEL.lower()), NOT_APPLICABLE_LABEL)
    for name, (spellings, _) in DURATION_UNITS.items():
        names.update(dict.fromkeys(spellings, name))
    return F.coalesce(_lookup(names, token), F.when(token.isNotNull(), UNKNOWN_UNIT_LABEL))


def unit_days(column: Column) -> Column:
    """Days in one unit, raw or canonical; null for unknown or not-applicable units."""
    return days_of_token(normalize_token(column))


def days_of_token(token: Column) -> Column:
    days = {s: value for spellings, value in DURATION_UNITS.values() for s in spellings}
    return _lookup(days, token)


def days_of_unit(unit: Column) -> Column:
    """``unit_days`` of a canonical unit name: a look-up, no text work."""
    return _lookup({name: value for name, (_, value) in DURATION_UNITS.items()}, unit)


def normalize_column_name(name: str) -> str:
    """ASCII, lower case, runs of other characters to one underscore."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode("ascii").lower()
    cleaned = "".join(ch if ch.isalnum() else "_" for ch in plain)
    return "_".join(part for part in cleaned.split("_") if part)


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive pattern test on the trimmed text; null does not match."""
    return trimmed(column).rlike(f"(?i){pattern}")
