"""Texts that label papers, abstracts, and the checks of what users type."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters kept in labels; fixed value.
NOT_IN_LABEL = r"[^A-Za-z0-9 \-/.,<>()=]"
#: Longest title in a label.
TITLE = 32
#: Keyword slots that are read.
SLOTS = 5


def clean(text: Column) -> Column:
    """Only the characters that labels may hold."""
    return F.regexp_replace(text, NOT_IN_LABEL, "")


def author_label(authors: Column) -> Column:
    """Up to two names, each from after its last full stop; of more the first and ``et al.``; null as empty."""
    names = F.transform(F.split(F.coalesce(authors, F.lit("")), ",", 3), lambda a: F.substring_index(a, ".", -1))
    return F.when(F.size(names) <= 1, F.concat(names[0], F.lit(","))).when(F.size(names) == 2, F.concat(names[0], F.lit(","), F.get(names, F.lit(1)))).otherwise(F.concat(names[0], F.lit(",et al.")))


def keyword_label(keywords: Column, title: Column) -> Column:
    """Up to two keywords; without any the title, cut to 32 characters and back to its last blank; else empty."""
    slots = F.split(keywords, ",", 3)
    plain = F.replace(title, F.lit(","), F.lit(";"))
    head = F.substring(plain, 1, TITLE)
    back = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    short = F.when(F.length(plain) > TITLE, back).otherwise(plain)
    of_keywords = F.when(F.size(slots) <= 1, F.concat(keywords, F.lit(","))).when(F.size(slots) == 2, keywords).otherwise(F.concat_ws(",", slots[0], F.get(slots, F.lit(1))))
    return F.when(keywords != "", of_keywords).when(title != "", F.concat(short, F.lit("...,"))).otherwise(F.lit(""))


def paper_label(authors: Column, keywords: Column, title: Column) -> Column:
    return clean(F.concat(keyword_label(keywords, title), F.lit(","), author_label(authors)))


def keyword_slots(keywords: Column, most: int = SLOTS) -> Column:
    """The keywords of the first slots; an empty slot takes its place but gives nothing."""
    return F.filter(F.slice(F.split(keywords, ","), 1, most), lambda k: k != "")


def abstract_path(key: Column) -> Column:
    """Where the abstract of a paper's public code lies, by year and month; null for a code too short to have one.

    A code of 9 or 10 characters with a full stop after four digits is of the new kind, any other of 10 and more of the old kind,
    whose last seven characters begin with year and month.
    """
    n = F.length(key)
    new = n.isin(9, 10) & (F.substring(key, 5, 1) == ".")
    tail = F.right(key, F.lit(7))
    new_path = F.concat(F.substring(key, 1, 2), F.lit("xx/"), F.substring(key, 1, 4), F.lit("/"), key, F.lit(".xml"))
    old_path = F.concat(F.substring(tail, 1, 2), F.lit("xx/"), F.substring(tail, 1, 4), F.lit("/"), F.substr(key, F.lit(1), n - 8), tail, F.lit(".xml"))
    return F.when(new, new_path).when(n >= 10, old_path)


def abstract_text(xml: Column) -> Column:
    """The text of the first <abstract> up to the next tag, white space made single blanks; a fixed text if there is none."""
    body = F.regexp_extract(xml, r"(?s)<abstract>\s*([^<]*)", 1)
    text = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("(no abstract)")).otherwise(text)


def fnv32(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's bytes (UTF-8), with the public algorithm's offset and prime; null for null."""
    code = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(code) > 0, F.sequence(F.lit(1), F.length(code) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(F.conv(F.substr(code, i, F.lit(2)), 16, 10).cast("bigint")) * 16777619) % 4294967296
    return F.when(text.isNotNull(), F.aggregate(places, F.lit(2166136261).cast("bigint"), step))


def search_terms(typed: Column) -> Column:
    """The words of a typed query: parted by white space, apostrophes, plus signs and backslashes."""
    return F.filter(F.split(typed, r"[\s'+\\]+"), lambda t: t != "")


def required_terms(typed: Column, quoted: bool) -> Column:
    """The query in which every word is required, words quoted or not."""
    return F.array_join(F.transform(search_terms(typed), lambda t: F.concat(F.lit(' +"' if quoted else " +"), t, F.lit('"' if quoted else ""))), "")


def valid_categories(typed: str) -> list[str] | None:
    """The categories of a comma list; None unless each has two or more of small letters and hyphens."""
    parts = typed.split(",")
    return parts if all(len(p) >= 2 and all(c == "-" or (c.isalpha() and c.islower()) for c in p) for p in parts) else None


#: What identifiers and public codes may look like.
_ID, _CODE = "0|[0-9]{10}", r"[A-Za-z0-9./\-]+"


def valid_id_column(typed: Column) -> Column:
    """``valid_id`` of a column."""
    return typed.rlike(f"^(?:{_ID})$")


def valid_code_column(typed: Column) -> Column:
    """``valid_code`` of a column."""
    return typed.rlike(f"^(?:{_CODE})$")


def valid_id(typed: str) -> bool:
    """``0`` or ten digits."""
    return re.fullmatch(_ID, typed) is not None


def valid_code(typed: str) -> bool:
    """Characters that a paper's public code may hold."""
    return re.fullmatch(_CODE, typed) is not None


def valid_suffix(typed: str) -> bool:
    """Suffix of a table's name."""
    return re.fullmatch(r"[A-Za-z0-9_]{1,32}", typed) is not None
