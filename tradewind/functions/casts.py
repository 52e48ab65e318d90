"""Text to typed columns, with unreadable values turned into nulls."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.schemas import RAW_COLUMNS

# Texts that mean "no value" in a CSV file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_NUMBER = r"(?i)^\s*[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?\s*\z"
_INFINITY = r"(?i)^[+-]?inf(inity)?\z"
# A date, alone or with a time of day to the second or finer. The type holds microseconds.
_TIME = r"^\d{4}-\d{1,2}-\d{1,2}((T|\s+)\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,9})?)?\z"
_LONG_LIMIT = float(2**63)


def cast_columns(df: DataFrame, table: str) -> DataFrame:
    """Give the columns of ``table`` their declared types.

    Declared columns that are absent are skipped, other columns and tables pass unchanged.
    """
    declared, present = RAW_COLUMNS.get(table, {}), dict(df.dtypes)
    kinds = {
        name: kind
        for name, kind in declared.items()
        if name in present and (kind == "string" or kind != present[name])
    }
    return cast_text(df, kinds) if kinds else df


def cast_text(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns read as text and cast to the given types.

    Three projections in a row, so that each reads what the one before has computed instead
    of computing it again: the text, the value as parsed, the value if it is acceptable. Null
    tokens are looked for in texts alone: none of them reads as a time or an acceptable number.
    """
    names = df.columns
    texts = df.select(*[_text(n, kinds[n]) if n in kinds else F.col(n) for n in names])
    parsed = texts.select("*", *[_PARSE[kinds[n]](n).alias(_parsed(n)) for n in _typed(kinds)])
    return parsed.select(
        *[_ACCEPT[kinds[n]](n).alias(n) if n in _typed(kinds) else F.col(n) for n in names]
    )


def _typed(kinds: dict[str, str]) -> list[str]:
    return [name for name, kind in kinds.items() if kind != "string"]


def _parsed(name: str) -> str:
    return f"_parsed_{name}"


def _text(name: str, kind: str) -> Column:
    c = F.col(name).cast("string")
    return (F.when(~c.isin(*NULL_TOKENS), c) if kind == "string" else c).alias(name)


def _parse_real(name: str) -> Column:
    return F.col(name).try_cast("double")


def _accept_real(name: str) -> Column:
    # Spark alone reads 3d and hexadecimal numbers; infinity has to be spelled out, and a
    # number beyond the double range is unreadable. Most texts end in a digit, and then the
    # pattern need not be tried.
    c, number = F.col(name), F.col(_parsed(name))
    usual = F.substring(c, -1, 1).between(".", "9") & ~c.contains("x") & ~c.contains("X")
    finite = F.abs(number) < F.lit(float("inf"))
    return F.when((finite & (usual | c.rlike(_NUMBER))) | c.rlike(_INFINITY), number)


def _parse_whole(name: str) -> Column:
    return F.when(F.col(name).try_cast("bigint").isNull(), _parse_real(name))


def _accept_whole(name: str) -> Column:
    # 4.0 is 4, and text is null, but a fraction or an infinity fails the job.
    c, number = F.col(name), F.col(_parsed(name))
    fails = F.raise_error(F.concat(F.lit("not a whole number: "), c)).cast("bigint")
    real = _accept_real(name)
    whole = (F.rint(number) == number) & (F.abs(number) < _LONG_LIMIT) & real.isNotNull()
    return F.coalesce(
        c.try_cast("bigint"), F.when(whole, number.cast("bigint")).when(real.isNotNull(), fails)
    )


def _parse_time(name: str) -> Column:
    # Never by way of the session zone. Wider gaps before the time of day are read too.
    c = F.col(name)
    gap = F.when(c.rlike(_TIME), F.regexp_replace(c, r"\s+", " ").try_cast("timestamp_ntz"))
    return F.coalesce(c.try_cast("timestamp_ntz"), gap)


def _accept_time(name: str) -> Column:
    # Spark alone reads years, months, times without seconds and zones. Of 19 bytes with these
    # two separators it reads the usual form, with a sign before it or a zone for the last digit,
    # so that the pattern need not be tried.
    c, at = F.col(name), lambda place: F.substring(F.col(name), place, 1)
    usual = (F.octet_length(c) == 19) & (at(14) == ":") & (at(17) == ":")
    plain = (c >= "0") & ~c.endswith("Z") & ~c.endswith("z")
    return F.when((usual & plain) | c.rlike(_TIME), F.col(_parsed(name)))


_PARSE = {"bigint": _parse_whole, "double": _parse_real, "timestamp_ntz": _parse_time}
_ACCEPT = {"bigint": _accept_whole, "double": _accept_real, "timestamp_ntz": _accept_time}
