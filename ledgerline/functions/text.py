"""Text functions as Spark expressions; similarity as an Arrow-batched function over distinct keys."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Characters that may stand in a leading house number, and delimiters that are tokens of their own.
NUMBER_MARKS = " .,;—-"
TOKEN_MARKS = ".,&"

LEADING_NUMBER = r"^(?:[ .,;—-]|[\p{Nd}²³¹]\p{L}?)+"
STRIPPED = r"^\s+|\s+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def leading_number(content: Column | str) -> Column:
    """The number at a line's start with its delimiters and a letter directly after a digit; NULL without a digit."""
    found = F.regexp_extract(col(content), LEADING_NUMBER, 0)
    return F.when(found.rlike(r"[\p{Nd}²³¹]"), found)


def without(content: Column | str, part: Column | str) -> Column:
    """The content without any occurrence of part, wherever it stands; unchanged where part is NULL."""
    return F.when(col(part).isNull(), col(content)).otherwise(F.replace(col(content), col(part), F.lit("")))


def sanitize(text: Column | str) -> Column:
    """Trailing full stops off, then white space at both ends, in this order: ``'1. '`` keeps its stop."""
    return F.regexp_replace(F.regexp_replace(col(text), r"\.+$", ""), STRIPPED, "")


def tokenize(text: Column | str, ends: bool = False) -> Column:
    """Words and the marks ``. , &``; blanks separate. With ``ends`` between START and END tokens."""
    tokens = F.regexp_extract_all(col(text), F.lit("[.,&]|[^ .,&]+"), F.lit(0))
    return F.concat(F.array(F.lit("START")), tokens, F.array(F.lit("END"))) if ends else tokens


def truth_tokens(text: Column | str) -> Column:
    """The ground-truth splitter: as tokenize, but ``&`` separates nothing."""
    return F.regexp_extract_all(col(text), F.lit("[.,]|[^ .,]+"), F.lit(0))


def pad_code(code: Column | str, width: int = 5) -> Column:
    """Leading zeros up to ``width``; longer codes stay whole."""
    return F.lpad(col(code), F.greatest(F.lit(width), F.length(col(code))), F.lit("0"))


def strip_code(code: Column | str) -> Column:
    """A code without its ``*``; NULL and empty codes pass through."""
    return F.replace(col(code), F.lit("*"), F.lit(""))


def address(street: Column | str, number: Column | str, lead: str = "", trail: str = "") -> Column:
    """``street number``, between lead and trail."""
    return F.concat(F.lit(lead), F.concat_ws(" ", col(street), col(number)), F.lit(trail))


#: Escapes of a Latin-1 web form, in this order.
LATIN_ESCAPES = (("ü", "%FC"), ("ö", "%F6"), ("ä", "%E4"), ("ß", "%DF"), (" ", "+"))


def latin_escape(text: Column | str) -> Column:
    out = col(text)
    for a, b in LATIN_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_codes(html: Column | str) -> Column:
    """All five-digit cells of a page, in order."""
    return F.regexp_extract_all(col(html), F.lit(">([0-9]{5})<"), F.lit(1))


def json_value(text: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a path of a JSON text as ``kind``; NULL where the text, the path or the kind doesn't fit."""
    return F.get_json_object(col(text), path).try_cast(kind)


def is_lower(c: Column) -> Column:
    return c.rlike(r"\p{L}") & (c == F.lower(c)) & (c != F.upper(c))


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{L}") & (c == F.upper(c)) & (c != F.lower(c))


def is_title(c: Column) -> Column:
    """Each run of letters starts with an upper-case letter and goes on in lower case."""
    return c.rlike(r"\p{Lu}|\p{Lt}") & ~c.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})[\p{Lu}\p{Lt}]")


def colored(tokens: Column | str, labels: Column | str) -> Column:
    """Tokens in terminal colours by label, blank between."""
    codes = {"N": 92, "O": 94, "A": 93, "P": 95, "PA": 95, "S": 96, "D": 90, "START": 90, "END": 90}
    table = F.create_map(*(F.lit(x) for k, v in codes.items() for x in (k, f"\x1b[{v}m")))
    one = F.transform(F.arrays_zip(col(tokens).alias("t"), col(labels).alias("l")), lambda x: F.concat(F.coalesce(table[x["l"]], F.lit("\x1b[0m")), x["t"], F.lit("\x1b[0m")))
    return F.array_join(one, " ")


def best_match(query: str, keys: Sequence[str], cutoff: float) -> tuple[str, float] | None:
    """The key most similar to the query by matching blocks, at least cutoff; of equal ones the largest string."""
    matcher, best = difflib.SequenceMatcher(), None
    matcher.set_seq2(query)
    for key in keys:
        matcher.set_seq1(key)
        floor = max(cutoff, best[0] if best else 0.0)
        if matcher.real_quick_ratio() >= floor and matcher.quick_ratio() >= floor and (r := matcher.ratio()) >= floor and (best is None or (r, key) > best):
            best = (r, key)
    return (best[1], best[0]) if best else None


@F.pandas_udf(DoubleType())
def similarity(key: pd.Series, query: pd.Series) -> pd.Series:
    """The matching-block ratio of (key, query); not symmetric."""
    matcher, out, last = difflib.SequenceMatcher(), [], None
    for k, q in zip(key, query, strict=True):
        if k is None or q is None:
            out.append(None)
            continue
        if q != last:
            matcher.set_seq2(q)
            last = q
        matcher.set_seq1(k)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")
