"""Variant spellings of names typed by people (problem 6).

The q-grams of every spelling's rare token, in whatever place it stands, are its set; two spellings meet only by a set-similarity join with a
prefix filter over these sets. What meets is verified by a soft similarity of all tokens: each counts by its rarity, agreeing given names, initials and
middle initials speak for it, contradicting ones against. Spellings that nothing met are linked to nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import written

#: English short forms and the names they stand for, the likelier first. Fixed values.
NICKNAMES = {
    "abby": "abigail", "al": "albert", "alec": "alexander", "alex": "alexander", "andy": "andrew", "annie": "anne", "art": "arthur",
    "barb": "barbara", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "benny": "benjamin", "bernie": "bernard", "bert": "albert",
    "beth": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles",
    "chris": "christopher christine", "chrissy": "christine", "chuck": "charles", "connie": "constance", "cindy": "cynthia", "dan": "daniel",
    "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dick": "richard", "don": "donald", "dot": "dorothy", "doug": "douglas",
    "ed": "edward", "eddie": "edward", "ellie": "eleanor", "fran": "francesca frances", "frank": "francis", "fred": "frederick", "gabe": "gabriel",
    "gene": "eugene", "gerry": "gerald", "greg": "gregory", "hal": "henry harold", "hank": "henry", "harry": "henry harold", "jack": "john", "jake": "jacob",
    "jeff": "jeffrey", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan",
    "josh": "joshua", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "len": "leonard",
    "lenny": "leonard", "leo": "leonard", "lexi": "alexandra", "libby": "elizabeth", "liz": "elizabeth", "lou": "louis", "maggie": "margaret", "mandy": "amanda",
    "matt": "matthew", "meg": "margaret", "mick": "michael", "mike": "michael", "mitch": "mitchell", "nat": "nathaniel", "natasha": "natalia", "ned": "edward",
    "nick": "nicholas", "ollie": "oliver", "pam": "pamela", "pat": "patricia patrick", "patty": "patricia", "peg": "margaret", "peggy": "margaret",
    "pete": "peter", "phil": "philip", "pippa": "philippa", "ray": "raymond", "rich": "richard", "rick": "richard", "rob": "robert", "ron": "ronald",
    "ronnie": "ronald", "sam": "samuel samantha", "sandy": "alexander sandra", "sally": "sarah", "steve": "stephen", "stu": "stuart", "sue": "susanna susan",
    "ted": "edward theodore", "terry": "terence theresa", "theo": "theodore", "tim": "timothy", "tom": "thomas", "tony": "anthony", "tori": "victoria",
    "val": "valentina valerie", "vicky": "victoria", "vince": "vincent", "walt": "walter", "will": "william", "winnie": "winifred", "zach": "zachary", "zack": "zachary",
}
#: What stands for a collaboration, and what may be left out of names.
COLLABORATION, ARTICLES, SUFFIXES = re.compile(r"col+ab(?:ora?tion)?|coll"), {"the"}, {"jr", "sr", "ii", "iii", "iv"}
#: Small words that belong to a surname and are left out of its token. Fixed values.
PARTICLES = {"de", "la", "del", "della", "den", "der", "di", "da", "do", "dos", "du", "le", "van", "von", "ter", "ten", "el", "al", "bin", "ibn"}
#: Tokens of at least this share of all spellings are sent to all tasks, at most (tokens of a spelling) / SHARE; others are joined.
SHARE = 1 / 2000
#: Tokens of a q-gram, initial and length that are compared in one piece.
CELL = 2048
#: Characters of a q-gram. Longer ones are rarer, so fewer tokens meet; none that belong together are lost at any length.
Q = 5
#: Least soft similarity of two spellings of one name.
ALIKE = 0.8
#: Weight of a middle initial: the logarithm of the letters that it may be.
MIDDLE_WEIGHT = 3.25


def folded(text: str) -> str:
    """Without marks on letters and in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


_TOKEN = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_FULL_NAMES = {n for full in NICKNAMES.values() for n in full.split()} | set(NICKNAMES)


def _plain(text: str) -> str:
    """Without nicknames in quotes or brackets, unless nothing else is there."""
    plain = re.sub(r'"[^"]*"|\([^)]*\)', " ", text)
    return plain if re.search(r"[^\W\d_]", plain) else text


def places(text: str) -> list[tuple[str, int]]:
    """(token, whether it stands where given names do) of a spelling's full tokens, for spellings whose order says so: two full tokens, or one and
    initials."""
    plain = _plain(text)
    t = [folded(x) for x in re.findall(r"[^\W_]{3,}", plain)]
    if len(t) == 2:
        return [(t[1], 1), (t[0], 0)] if "," in plain else [(t[0], 1), (t[1], 0)]
    return [(t[0], 0)] if len(t) == 1 and len(_TOKEN.findall(plain)) > 1 else []


def given_score(token: str, n: int, first: int) -> float:
    """How likely a token is a given name: the share of its uses in that place, moved towards a half by few uses; the names that short forms stand
    for count a little more. The share doesn't depend on the size of the collection."""
    known = 2 if token in _FULL_NAMES else 0
    return (first + 0.5 + known) / (n + 1 + known)


def parse_name(text: str, scores: dict[str, float] | None = None) -> tuple[str, str, str, str, str] | None:
    """(kind, rare token, given name, middle initial, other reading of the given name) of a spelling; None if it has no letters.

    kind is ``c`` for a collaboration, else ``p``. The given name is in full form if it is a known short one, or one initial, or
    empty. ``scores`` tell how likely a token is a given name, and so "Jones Mary" from "Mary Jones"; of tokens equally likely the later one in the
    alphabet is the surname, in whatever order they stand. A single token in capitals or one before a comma is the surname; particles aren't part of it.
    """
    plain = _plain(text)
    before, comma, after = plain.partition(",")
    raw = _TOKEN.findall(plain)
    if not raw:
        return None
    low = [folded(t) for t in raw]
    if len(low) > 1 and any(COLLABORATION.fullmatch(t) for t in low):
        rest = [t for t in low if not COLLABORATION.fullmatch(t) and t not in ARTICLES]
        return ("c", " ".join(rest), "", "", "") if rest else None
    score = lambda t: (scores or {}).get(t, given_score(t, 0, 0))

    def given(tokens: list[str]) -> tuple[str, str, str]:
        parts: list[str] = []
        for t in tokens:
            f = folded(t)
            parts += list(f) if len(t) <= 3 and t.isupper() and score(f) <= 0.5 else [f]
        if not parts:
            return "", "", ""
        names = NICKNAMES.get(parts[0], parts[0]).split()
        middle = parts[1][:1] if len(parts) > 1 else ""
        if len(names) > 1 and names[0][0] == names[1][0]:  # either will do; only the initial is sure
            return names[0][0], middle, ""
        return names[0], middle, (names[1] if len(names) > 1 else "")

    if comma and re.search(r"[^\W\d_]", before):
        own = [folded(t) for t in _TOKEN.findall(before)]
        surname = " ".join([t for t in own if t not in PARTICLES] or own)
        rest = _TOKEN.findall(after)
        return ("p", surname, *given(rest[:1] + [t for t in rest[1:] if folded(t) not in SUFFIXES | PARTICLES]))
    # A suffix stands last, after two or more tokens; elsewhere its letters are initials.
    if len(raw) > 2 and low[-1] in SUFFIXES:
        raw, low = raw[:-1], low[:-1]
    if len(raw) > 2:  # a particle stands between two others
        kept = [k for k in range(len(raw)) if k in (0, len(raw) - 1) or low[k] not in PARTICLES or raw[k].isupper()]
        raw, low = [raw[k] for k in kept], [low[k] for k in kept]
    long = [k for k, t in enumerate(raw) if len(t) > 2 or (len(t) == 2 and not t.isupper())]
    if not long:
        return ("p", low[-1], *given(raw[:-1]))
    capitals = [k for k in long if raw[k].isupper() and len(raw[k]) > 2]
    if len(capitals) == 1 and len(long) > 1:
        at = capitals[0]
    elif len(long) > 1:
        # The least likely given name; of more than two only the first and the last may be the surname.
        ends = [long[0], long[-1]]
        at = min(ends, key=lambda k: (round(score(low[k]), 9), [-ord(c) for c in low[k]]))
    else:
        at = long[-1]
    return ("p", low[at], *given(raw[:at] + raw[at + 1 :]))


def spellings(values: DataFrame, value: str) -> DataFrame:
    """(val, uses) of each distinct non-empty value."""
    return values.where(F.col(value) != "").groupBy(F.col(value).alias("val")).agg(F.count(F.lit(1)).alias("uses"))


def token_places(names: DataFrame) -> DataFrame:
    """(token, n, first): in how many spellings a token has a known place, and in how many that of a given name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [p for text in batch.column(0).to_pylist() for p in places(text)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([g for _, g in out], pa.int64())], ["token", "first"])

    return names.select("val").mapInArrow(run, "token string, first bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("first"))


def parsed(names: DataFrame, share: float = SHARE) -> DataFrame:
    """(val, uses, kind, rare, given, middle, other); spellings without letters are left out.

    Where a spelling has several full tokens, what is known of these comes with it: of the few common ones from a broadcast, of others by a join.
    """
    stats = written(token_places(names), "tokens")
    common = F.col("n") >= max(1.0, names.count() * share)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in batch.column(0).to_pylist():
                plain = _plain(v)
                found = [t for t in _TOKEN.findall(plain) if len(t) > 1]
                # Where a comma tells the surname, only short tokens in capitals may be initials or names.
                if len(found) > 1 and "," not in plain or any(len(t) <= 3 and t.isupper() for t in found):
                    rows += [(v, t) for t in sorted({folded(t) for t in found})]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["val", "token"])

    each = names.select("val").mapInArrow(tokens, "val string, token string")
    often = each.join(F.broadcast(stats.where(common).select("token", "n", "first")), "token", "left")
    rest = often.where("n is null").select("val", "token").join(stats.where(~common), "token")
    known = often.where("n is not null").select("val", "token", "n", "first").unionByName(rest.select("val", "token", "n", "first"))
    known = known.groupBy("val").agg(F.collect_list(F.struct("token", "n", "first")).alias("known"))
    fields = ("kind", "rare", "given", "middle", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v, u, k in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if p := parse_name(v, {x["token"]: given_score(x["token"], x["n"], x["first"]) for x in k or []}):
                    rows.append((v, u, *p))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(cols)], ["val", "uses", *fields])

    return names.select("val", "uses").join(known, "val", "left").mapInArrow(run, "val string, uses bigint, " + ", ".join(f"{f} string" for f in fields))


def _grams(token: Column, q: int) -> Column:
    """The set of a token's q-grams, its ends marked."""
    pad = F.concat(F.lit("\x02" * (q - 1)), token, F.lit("\x03" * (q - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) + q - 1), lambda i: F.substr(pad, i, F.lit(q))))


def similar_tokens(tokens: DataFrame, token: str, block: list[str], q: int = Q, errors: int = 1, cell: int | None = None) -> DataFrame:
    """(block..., t1, t2), t1 <= t2: tokens of one block whose q-gram sets differ by no more than ``errors`` typing errors can make them;
    each token with itself, too.

    tokens: distinct rows (block..., token). Tokens of three letters and more lose no partner, of fewer those that share a q-gram are found. A wrong, missing, added or swapped letter changes at most q + 1 of the padded q-grams of
    the longer token, so the overlap of two such sets is at least n - errors * (q + 1) of its n; by the prefix filter they share one of
    their errors * (q + 1) + 1 rarest q-grams. Only these are joined, with tokens of a length that fits, and their overlap is checked. Where very many
    tokens share a q-gram, each of them meets the others in pieces of ``cell`` tokens.
    """
    cell, changed = cell or CELL, errors * (q + 1)
    rows = tokens.where(F.col(token) != "").select(*block, F.col(token).alias("t"))
    each = rows.select(*block, "t", F.explode(_grams(F.col("t"), q)).alias("gram"))
    frequency = each.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy(*block, "t").orderBy("df", "gram"))
    # The number of distinct q-grams of a language is bounded by its letters, whatever the number of tokens.
    prefix = each.join(frequency, "gram").withColumn("rank", rank).where(F.col("rank") <= changed + 1)
    pieces = F.ceil(F.col("df") / cell).cast("int")
    prefix = prefix.select(*block, "gram", "t", F.length("t").alias("len"), "rank", pieces.alias("pieces"))
    # The shorter of two, or the first of two equally long ones, meets the other in one of its pieces, and itself once.
    short = prefix.select(*block, "gram", F.col("t").alias("t1"), F.col("len").alias("l1"), F.col("rank").alias("r1"), "pieces")
    short = short.withColumn("len", F.explode(F.sequence(F.col("l1"), F.col("l1") + errors))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    other = prefix.withColumnsRenamed({"t": "t2", "rank": "r2"}).withColumn("piece", F.pmod(F.xxhash64("t2"), F.col("pieces")).cast("int")).drop("pieces")
    fits = (F.col("l1") < F.col("len")) | (F.col("t1") < F.col("t2")) | ((F.col("t1") == F.col("t2")) & (F.col("r1") == 1) & (F.col("r2") == 1))
    met = short.join(other, [*block, "gram", "len", "piece"]).where(fits).select(*block, F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2")).distinct()
    g1, g2 = _grams(F.col("t1"), q), _grams(F.col("t2"), q)
    return met.where((F.col("t1") == F.col("t2")) | (F.size(F.array_intersect(g1, g2)) >= F.greatest(F.size(g1), F.size(g2)) - changed))


def one_error(a: Column, b: Column) -> Column:
    """Whether one letter typed wrong, left out, added, or swapped with the next makes a of b."""
    lev = F.levenshtein(a, b, 2)
    same_letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    # Two substitutions of the same letters are one swap if they stand side by side: then all but two letters agree in place.
    gap = F.aggregate(
        F.sequence(F.lit(1), F.length(a)),
        F.struct(F.lit(0).alias("first"), F.lit(0).alias("last")),
        lambda s, i: F.when(F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)), s).otherwise(F.struct(F.when(s["first"] == 0, i).otherwise(s["first"]).alias("first"), i.alias("last"))),
    )
    swap = F.when((lev == 2) & (F.length(a) == F.length(b)), same_letters).otherwise(False)
    return F.when(lev == 1, True).when(swap, (gap["last"] - gap["first"]) == 1).otherwise(False)


def _near(a: Column, b: Column) -> Column:
    """Given names that may be one: an initial or nothing against any of that initial, or two that differ by typing."""
    return (F.length(a) <= 1) | (F.length(b) <= 1) | (F.levenshtein(a, b) <= 2)


def _people(forms: Column) -> Column:
    """The people of a surname and initial by their spellings (given, middle; null for none): what only one of them has is all's, and a
    spelling that says less than another is that one's, so that an initial alone doesn't agree with everybody."""
    for c in ("given", "middle"):
        some = F.array_distinct(F.filter(F.transform(forms, lambda f: f[c]), lambda v: v.isNotNull()))  # noqa: B023
        only = F.when(F.size(some) == 1, F.get(some, F.lit(0)))
        given, middle = (lambda f, n=n: F.coalesce(f[n], only) if n == c else f[n] for n in ("given", "middle"))  # noqa: B023
        forms = F.array_distinct(F.transform(forms, lambda f: F.struct(given(f).alias("given"), middle(f).alias("middle"))))  # noqa: B023
    says = lambda a, b: (a["given"].isNull() | F.coalesce(a["given"] == b["given"], F.lit(False))) & (a["middle"].isNull() | F.coalesce(a["middle"] == b["middle"], F.lit(False)))
    return F.filter(forms, lambda a: ~F.exists(forms, lambda b: says(a, b) & ~says(b, a)))


def _stars(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., token, head): each token with the most used of those it is linked to, two steps away at most.

    nodes(key..., token, uses), edges(key..., t1, t2). A token attaches to its most used neighbour if that is used more (ties:
    the smaller token is the greater); so links don't chain on from typing error to typing error.
    """
    both = edges.select(*key, "t1", "t2").unionByName(edges.select(*key, F.col("t2").alias("t1"), F.col("t1").alias("t2")))
    uses = nodes.select(*key, "token", "uses")
    near = both.join(uses.withColumnsRenamed({"token": "t1", "uses": "u1"}), [*key, "t1"]).join(uses.withColumnsRenamed({"token": "t2", "uses": "u2"}), [*key, "t2"])
    up = near.where((F.col("u2") > F.col("u1")) | ((F.col("u2") == F.col("u1")) & (F.col("t2") < F.col("t1"))))
    best = up.groupBy(*key, "t1").agg(F.min(F.struct((-F.col("u2")).alias("u"), "t2"))["t2"].alias("t2"))
    best = written(best, "attached")
    for _ in range(2):
        onward = best.select(*key, F.col("t1").alias("t2"), F.col("t2").alias("t3"))
        best = best.join(onward, [*key, "t2"], "left").select(*key, "t1", F.coalesce("t3", "t2").alias("t2"))
    return best.select(*key, F.col("t1").alias("token"), F.col("t2").alias("head"))


def name_clusters(values: DataFrame, value: str, alike: float = ALIKE) -> DataFrame:
    """(val, kind, root, initial, given, middle): each spelling that met another token's or its own with the name it means; equal keys mean the same.

    Rare tokens meet by the similarity join, within one initial, and are verified by ``alike``; a token's root is the most used one that it goes with, or
    itself. Spellings of one kind, root and initial mean one person unless their given names or middle initials contradict: then they are
    told apart by those, and a spelling without them stays by itself. Null and empty values are left out; a value without letters
    means itself only.
    """
    names = written(spellings(values, value), "spellings")
    rows = written(parsed(names), "parsed")

    # A short form of two names is read as the likelier one, unless the surname has only the other.
    known = rows.where("other = '' and given <> ''").groupBy("kind", "rare", F.substring("given", 1, 1).alias("i")).agg(F.sum("uses").alias("there"))
    doubtful = rows.where("other <> ''")
    for name in ("given", "other"):
        doubtful = doubtful.withColumn("i", F.substring(name, 1, 1)).join(known.withColumnRenamed("there", f"has_{name}"), ["kind", "rare", "i"], "left").drop("i")
    turned = F.col("has_given").isNull() & F.col("has_other").isNotNull()
    doubtful = doubtful.withColumn("given", F.when(turned, F.col("other")).otherwise(F.col("given")))
    rows = rows.where("other = ''").unionByName(doubtful.select(*rows.columns)).drop("other").withColumn("initial", F.substring("given", 1, 1))

    full = F.when(F.length("given") > 1, F.col("given"))
    # A node's people: each distinct full given name and middle initial, null where a spelling has none. Any of them may agree.
    person_ = F.struct(full.alias("given"), F.when(F.col("middle") != "", F.col("middle")).alias("middle"))
    nodes = rows.groupBy("kind", "initial", F.col("rare").alias("token")).agg(F.sum("uses").alias("uses"), F.collect_set(person_).alias("people"))
    nodes = written(nodes.withColumn("people", _people(F.col("people"))), "nodes")
    met = written(similar_tokens(nodes, "token", ["kind", "initial"]), "met")
    pairs = met.where("t1 <> t2")
    for k in ("1", "2"):
        side = nodes.select("kind", "initial", F.col("token").alias(f"t{k}"), F.col("uses").alias(f"u{k}"), F.col("people").alias(f"p{k}"))
        pairs = pairs.join(side, ["kind", "initial", f"t{k}"])
    total = nodes.agg(F.sum("uses").alias("all_uses"))
    initials = nodes.groupBy("kind", "initial").agg(F.sum("uses").alias("initial_uses"))
    rarity = lambda n: F.log(F.lit(1.0) + F.col("all_uses") / n)
    w_rare, w_given, w_middle = rarity(F.greatest("u1", "u2")), rarity(F.col("initial_uses")), F.lit(MIDDLE_WEIGHT)
    s_rare = F.when(one_error(F.col("t1"), F.col("t2")), 1 - 1 / F.greatest(F.length("t1"), F.length("t2"))).otherwise(0.0)

    def likeness(a: Column, b: Column) -> Column:
        """The soft similarity of two people: what their tokens' likeness, from -1 for contradiction to 1, comes to by weight; a middle initial counts where
        both have one."""
        s_given = F.when(a["given"] == b["given"], 1.0).when(a["given"].isNull() | b["given"].isNull(), 0.9).when(_near(a["given"], b["given"]), 0.8).otherwise(-1.0)
        s_middle = F.when(a["middle"] == b["middle"], 1.0).otherwise(-1.0)
        both = (a["middle"].isNotNull() & b["middle"].isNotNull()).cast("double")
        return (w_rare * s_rare + w_given * s_given + both * w_middle * s_middle) / (w_rare + w_given + both * w_middle)

    best = F.array_max(F.transform("p1", lambda a: F.array_max(F.transform("p2", lambda b: likeness(a, b)))))
    verified = written(pairs.join(F.broadcast(total)).join(initials, ["kind", "initial"]).where(best >= alike).select("kind", "initial", "t1", "t2"), "verified")
    roots = _stars(nodes, verified, ["kind", "initial"])
    # A token that met itself is the same in all its spellings, whoever the people are: these are told apart below.
    own = met.where("t1 = t2").select("kind", "initial", F.col("t1").alias("rare"))
    roots = own.join(roots.withColumnsRenamed({"token": "rare", "head": "root"}), ["kind", "initial", "rare"], "left").withColumn("root", F.coalesce("root", "rare"))
    rows = written(rows.join(roots, ["kind", "initial", "rare"]).drop("rare"), "rooted")

    # Contradicting given names within a surname and initial.
    person = ["kind", "root", "initial"]
    givens = rows.where(F.length("given") > 1).groupBy(*person, F.col("given").alias("token")).agg(F.sum("uses").alias("uses"))
    several = givens.groupBy(*person).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    typed = similar_tokens(givens.join(several, person, "left_semi"), "token", person, errors=2).where((F.col("t1") < F.col("t2")) & (F.levenshtein("t1", "t2") <= 2))
    forms = _stars(givens, typed, person).withColumnsRenamed({"token": "given", "head": "form"})
    rows = rows.join(forms, [*person, "given"], "left").withColumn("given", F.when(F.length("given") > 1, F.coalesce("form", "given")).otherwise("")).drop("form")

    def split_by(df: DataFrame, key: list[str], column: str) -> DataFrame:
        several = df.where(F.col(column) != "").groupBy(*key).agg(F.count_distinct(column).alias("__c"))
        return df.join(several.where("__c > 1"), key, "left").withColumn(column, F.when(F.col("__c") > 1, F.col(column)).otherwise("*")).drop("__c")

    rows = split_by(rows, person, "given")
    rows = split_by(rows, [*person, "given"], "middle")
    return rows.select("val", *person, "given", "middle")


def same_names(values: DataFrame, value: str, alike: float = ALIKE) -> DataFrame:
    """Distinct (namea, nameb), namea < nameb by code point: every two spellings of one name."""
    clusters = written(name_clusters(values, value, alike), "names")
    key = ["kind", "root", "initial", "given", "middle"]
    a, b = clusters.withColumnRenamed("val", "namea"), clusters.withColumnRenamed("val", "nameb")
    return a.join(b, key).where(F.col("namea") < F.col("nameb")).select("namea", "nameb")
