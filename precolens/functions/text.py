"""Column helpers for text, codes, dates and prices."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\r\f\v"


def first_element(codes: Column | str) -> Column:
    """First array element; NULL for a NULL or empty array."""
    return F.get(codes, F.lit(0))


def supplier_code(rows: DataFrame) -> Column:
    """Supplier code of fact or enriched rows: the first element of an array, or the scalar itself."""
    code = F.col("cod_informante")
    return first_element(code) if isinstance(rows.schema["cod_informante"].dataType, T.ArrayType) else code


def blank_to_null(text: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(text, F.lit(BLANKS)), F.lit(""))


def or_dash(text: Column) -> Column:
    """Placeholder dash for NULL or empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("—"))


def capitalised(text: Column) -> Column:
    """First letter upper case, all the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def zero_padded(number: Column, width: int) -> Column:
    """Decimal text padded with zeros to ``width``; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


def labelled(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code; codes without a label are shown capitalised."""
    pairs = F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])
    return F.coalesce(F.try_element_at(pairs, code), capitalised(code))


def contains_ignoring_case(text: Column, term: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the term stay wildcards, a backslash is ordinary."""
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return F.like(F.lower(text), F.lower(F.lit(pattern)))


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    base_of = {}
    for code in range(0x00C0, 0x0250):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)[0]
        if len(letter) == 1 and base != letter and base.isascii():
            base_of[letter] = base
    return "".join(base_of), "".join(base_of.values())


_ACCENTED, _PLAIN = _accents()


def folded(text: Column) -> Column:
    """Lower case without accents, composed or combining."""
    bare = F.regexp_replace(F.lower(text), r"\p{M}+", "")
    return F.translate(bare, _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    """Array of folded words: maximal runs of letters and digits, repeats kept."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_terms(spark: SparkSession, phrase: str) -> list[str]:
    """Distinct words of a search phrase, by the same rule as the texts."""
    row = spark.createDataFrame([(phrase,)], "frase string")
    return row.select(F.array_sort(F.array_distinct(tokens(F.col("frase"))))).first()[0]


def lenient_date(text: Column) -> Column:
    """Date of an ISO text; NULL when it is not one."""
    return F.try_to_date(text)


def price_text(value: Column) -> Column:
    """``R$ 1,234.50``; empty stays NULL and what is no number is shown as it is."""
    number = value.try_cast("double")
    shown = F.format_string("R$ %,.2f", F.abs(number))
    return (
        F.when(number.isNull(), value.cast("string"))
        .when(F.isnan(number), F.lit(None).cast("string"))
        .when(number < 0, F.concat(F.lit("-"), shown))
        .otherwise(shown)
    )
