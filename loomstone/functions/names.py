"""Names: normal forms that need Unicode tables, and similarity; pandas UDFs, since Spark has neither."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

_other = re.compile(r"[^a-z0-9]+")


def plain(text: str) -> str:
    """Without accents, case folded, runs of other than a-z and 0-9 as one space, none at the ends."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _other.sub(" ", bare.casefold()).strip()


@F.udf(StringType(), useArrow=False)
def plain_text(text: str | None) -> str | None:
    """Row by row: texts may be long, and an Arrow batch of ten thousand of them is held in several copies, one of a hundred rows is small."""
    return None if text is None else plain(text)


#: Words that mean the same, and words at a name's end that say nothing of the place.
SAME = {"centre": "center", "centres": "center", "centro": "center", "intl": "international", "int": "international", "aeroport": "airport", "stade": "stadium"}
GENERIC = frozenset(
    ("annual", "capacity", "details", "official", "passenger", "passengers", "profile", "public", "report", "reports", "seats", "source", "statistics", "stats", "traffic")
)


def identity(text: str) -> str:
    """plain, but with "and" for &, quotes taken out and not replaced, and one word for each of SAME."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    for sign in "'’`":
        bare = bare.replace(sign, "")
    return " ".join(SAME.get(w, w) for w in _other.sub(" ", bare.replace("&", " and ")).split())


def entity(text: str) -> str:
    """identity without GENERIC words at its end."""
    words = identity(text).split()
    last = next((i for i in range(len(words), 0, -1) if words[i - 1] not in GENERIC), 0)
    return " ".join(words[:last])


#: A Latin letter (of the blocks that have any) and the combining marks behind it.
_marked = re.compile("([A-Za-z\u00aa\u00ba\u00c0-\u024f\u0250-\u02af\u1e00-\u1eff\u2c60-\u2c7f\ua722-\uab64\uff21-\uff5a])[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_loose, _quality, _search, _gap = re.compile(r"[_/|,;:()\[\]{}]+"), re.compile(r"[^a-z0-9\s.-]+"), re.compile(r"[\W_]+"), re.compile(r"\s+")


def quality(text: str) -> str:
    """plain, but dots and hyphens stay."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return _gap.sub(" ", _quality.sub(" ", _loose.sub(" ", bare))).strip()


def search_form(text: str) -> str:
    """Case folded, marks taken off Latin letters only, so that other scripts keep theirs; other signs are one space."""
    apart = unicodedata.normalize("NFKD", text.casefold())
    return _search.sub(" ", unicodedata.normalize("NFC", _marked.sub(r"\1", apart))).strip()


def search_forms(text: str) -> str:
    """search_form of each line, each once, none empty."""
    return "\n".join(dict.fromkeys(f for f in map(search_form, text.split("\n")) if f))


def flat(text: str) -> str:
    """Compatibility forms composed, white space collapsed; letters keep their case and marks."""
    return _gap.sub(" ", unicodedata.normalize("NFKC", text)).strip()


def _udf(f):
    @F.pandas_udf(StringType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return of


@F.pandas_udf(ArrayType(StringType()))
def quality_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: [quality(x or "") for x in xs], na_action="ignore")


identity_text, entity_name, quality_text, search_text, search_lines = map(_udf, (identity, entity, quality, search_form, search_forms))


@F.udf(StringType(), useArrow=False)
def flat_text(text: str | None) -> str | None:
    """Row by row, as plain_text."""
    return None if text is None else flat(text)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks; null where a side is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer one; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def hash_vector(words: Column, dims: int = 64) -> Column:
    """Signed counts of words, normalised: of a word's SHA-256 the first four bytes modulo dims are its place, the fifth its sign.

    An array without words, or a null one, gives zeros.
    """
    one = lambda h: F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dims)) * 2 + F.pmod(F.conv(F.substring(h, 9, 2), 16, 10).cast("long"), F.lit(2))
    # an array of one and a transform name a value, which would be made anew wherever it is used
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    codes = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: bound(F.sha2(w, 256), one))

    def count(code: Column, which: Column) -> Column:
        return F.size(F.filter(code, lambda x: x == which))

    signed = lambda code: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (count(code, i * 2) - count(code, i * 2 + 1)).cast("double"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda v: bound(length(v), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0)))
    return bound(bound(codes, signed), scaled)
