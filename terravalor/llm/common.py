"""What the operators share: words of a text, and rows carried beside working columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """A text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def spaced(text: Column, turned: str = "\t\n\x0b\x0c\r") -> Column:
    """The text with each of some characters turned into a space; plain replacing is far cheaper than a pattern."""
    for c in turned:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    """The words of a text in order; none for an empty one."""
    return F.array_remove(F.split(spaced(text), " "), "")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Each row as one struct ``row`` beside working columns, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """The columns of ``row``, then the added ones; an input column of an added name gives way."""
    names = [c for c in df.schema["row"].dataType.names if c not in added]
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *added)


def bits_of(digest: Column, start: int, digits: int) -> Column:
    """Hex digits of a digest as a number."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")
