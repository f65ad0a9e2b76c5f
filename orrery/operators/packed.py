"""Several values packed in one field (problem 4).

The grammar, with ordered alternatives as in a parsing expression grammar:

    list   <- item (sep item)*
    item   <- blank* (quoted / squoted / bracketed / bare) blank*
    quoted <- '"' (!'"' . / '""')* '"' &(blank* (sep / end))

A quoted, single-quoted or bracketed item holds only if a separator or the end follows its closing mark; otherwise the
parser goes back and reads the item as bare, with its marks kept and the error flag set where a quote or bracket opens it. Brackets
belong to the value and stay; quotes enclose it and go. The alternatives are one regular expression with possessive repeats: it runs inside the JVM, needs no recursion, and takes time
in proportion to the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between values while a field is cut, and before what stands for these two characters where a text has them itself.
MARK, ESCAPE = "\x01", "\x02"


@dataclass(frozen=True)
class Packing:
    """How a field packs its values.

    strong: characters that always part two values. weak: a regular expression of what parts them only in a list
    without strong separators outside its quotes (a comma between authors belongs to a name where other marks part
    the list). Either may be empty.
    """

    strong: str
    weak: str = ""


#: Codes hold no blanks, so white space parts them like any other mark.
CATEGORIES = Packing(strong=r",;|/\s")
#: Names hold blanks, and commas where a stronger mark or quotes part the list.
AUTHORS = Packing(strong=r";|/\t\n\r", weak=r"\s*+,\s*+(?:(?:and|&)\s++)?+|\s++(?:and|&)\s++")
#: A plain comma list.
COMMAS = Packing(strong=",")


def _enclosed(packing: Packing) -> str:
    """The alternatives that may hold separators: quoted, single-quoted, bracketed; at an item's start, up to its end."""
    seps = f"[{packing.strong}]" + (f"|{packing.weak}" if packing.weak else "")
    before = rf"(?:^|(?<=[{packing.strong}])" + (r"|(?<=,)|(?<=\s(?:and|&)\s)" if packing.weak else "") + r")\s*+"
    body = r""""[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+'|\[[^\]]*+\]"""
    return rf"{before}(?:{body})(?=\s*(?:{seps}|$))"



def unpacked(text: Column, packing: Packing) -> Column:
    """An array of structs (val, err), one for each non-empty value in order; null for a null text.

    val is trimmed and without enclosing quotes (inside them a doubled quote stands for one), with its brackets; err marks a value
    that opens with a quote or bracket which nothing closes in the right place. Any character may stand in a value, also those that
    part the values while the field is cut. Blank items are left out, as are those of commas alone where
    commas may part, so an empty or blank
    text gives an empty array.
    """
    enclosed, strongly = _enclosed(packing), _enclosed(Packing(packing.strong))
    held = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(MARK), F.lit(ESCAPE + "1"))
    text = F.when(text.rlike(f"[{MARK}{ESCAPE}]"), held).otherwise(text)

    def whole(x: Column) -> Column:
        return F.when(F.contains(x, F.lit(ESCAPE)), F.replace(F.replace(x, F.lit(ESCAPE + "1"), F.lit(MARK)), F.lit(ESCAPE + "2"), F.lit(ESCAPE))).otherwise(x)

    def cut(kept: str, sep: str) -> Column:
        return F.split(F.regexp_replace(text, F.lit(f"({kept})|(?:{sep})"), F.lit(f"$1{MARK}")), MARK)

    strong = f"[{packing.strong}]"
    parts = cut(strongly, strong)
    if packing.weak:
        has_strong = F.regexp_replace(text, F.lit(enclosed), F.lit("")).rlike(strong)
        parts = F.when(has_strong, parts).otherwise(cut(enclosed, packing.weak))

    def trimmed(x: Column) -> Column:
        return F.regexp_replace(x, F.lit(r"^\s++|(?<!\s)\s++$"), F.lit(""))

    def item(x: Column) -> Column:
        body = F.substr(x, F.lit(2), F.length(x) - 2)
        double = x.rlike(r'^"[^"]*+(?:""[^"]*+)*+"$')
        single = x.rlike(r"^'[^']*+(?:''[^']*+)*+'$")
        val = F.when(double, F.replace(body, F.lit('""'), F.lit('"'))).when(single, F.replace(body, F.lit("''"), F.lit("'"))).otherwise(x)
        bracketed = x.rlike(r"^\[[^\]]*+\]$")
        return F.struct(whole(trimmed(val)).alias("val"), (x.rlike("^[\"'\\[]") & ~double & ~single & ~bracketed).alias("err"))

    empty = r"^[\s,]*$" if packing.weak else r"^$"
    return F.filter(F.transform(F.transform(parts, trimmed), item), lambda x: ~x["val"].rlike(empty))


def unpack_rows(df: DataFrame, keys: list[str], column: str, packing: Packing, fieldname: str | None = None) -> DataFrame:
    """One row per value: keys, fieldname, slot (from 1 over the non-empty values), val, err.

    A null, empty or blank field gives no row; repeated values keep their slots. ``keys`` may have any names but
    the four made here.
    """
    out = df.select(*keys, F.posexplode(unpacked(F.col(column), packing)).alias("__pos", "__item"))
    return out.select(
        *keys, F.lit(fieldname or column).alias("fieldname"), (F.col("__pos") + 1).cast("bigint").alias("slot"), F.col("__item.val").alias("val"), F.col("__item.err").alias("err")
    )
