"""Benchmark decontamination (operator 4): template canonicalisation, native functions only.

A text becomes one canonical string: lower-case tokens parted by single blanks, in which numbers,
names and units are typed placeholders with their value, ``#12``, ``@anna``, ``~km``.  Windows of
``WINDOW`` tokens are hash-joined with those of the benchmark items; in a window with at least
``LITERAL`` literal tokens the placeholders stand for any value, in others the values must be equal,
so an item poor in literals has windows too.

The windows of one text and one item on up to ``SHIFT`` + 1 neighbouring diagonals (place in the text
less place in the item: inserted, dropped and changed words) are put together.  They count only if
the placeholders' values map one to one: the same value of the item always stands for the same value
of the text and no two for the same one, as in a question with new parameters.  The item is found if
the tokens they cover

* hold ``LEAST_LITERALS`` literals and are half of the item's (rounded down, less the first token, whose
  type depends on what stands before it), or hold ``RUN`` literals; or
* for items that have no more than ``LEAST_LITERALS`` literals, are all of the item's but for the
  first, and five of eight are literal or all values are equal.

A name is a run of capitalised tokens that does not open a sentence or line, known by its first: a
name of two words shifts nothing where one of one word stood.  A unit is a token of ``UNITS`` after a
number.

Everything per token is done by regular expressions over whole strings, and per window by expressions
over exploded rows; texts are exploded ``CHUNK`` tokens at a time, so a row never holds all windows of
a long text.  Slots are read from the few windows that match.

Benchmark windows are broadcast only where their number is below ``BROADCAST_WINDOWS``, counted
first; beyond it the join shuffles.  Defined results: null or empty texts and items match nothing;
items shorter than a window are matched whole by windows of their own length; rows that repeat an
id are judged each on its own and reported once; extra columns are ignored; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, shared_dir, unused

WINDOW = 5
LITERAL = 3
COVERAGE = 0.5
BROADCAST_WINDOWS = 1_000_000
#: neighbouring diagonals put together, and the matched literals that any find of a longer item
#: needs and that are enough whatever the item's length
SHIFT = 4
LEAST_LITERALS = 7
RUN = 13
#: tokens that are exploded at a time
CHUNK = 256

# Fixed word list: units that follow a number
UNITS = "% $ € £ ° km m cm mm mi ft in kg g mg lb oz l ml s sec min h hr hour hours day days week weeks month months year years mph kmh usd eur dollar dollars euro euros cent cents percent degrees meters metres miles feet inches grams litres liters minutes seconds".split()
# possessive: Java matches other loops over groups by recursion, which a line of numbers would exhaust
TOKEN = r"(\p{N}++(?:[.,]\p{N}++)*+|[\p{L}\p{M}]++|[%$€£°]|[.!?:\n])"
#: first characters of placeholders; no token holds them
NUM, NAME, UNIT = "#", "@", "~"
SLOT = f"[{NUM}{NAME}{UNIT}]"

# each opens with the blank before a token, which is quickly looked for
_UNIT = r" (?<=\p{N} )((?i:" + "|".join(re.escape(u) for u in UNITS) + "))(?= )"
_CAPITAL = r"\p{Lu}\p{Ll}[^ ]*+"
_NAMES = rf" (?<=[^ .!?:\n] )({_CAPITAL})(?: {_CAPITAL})*+"


def canonical(text: Column) -> Column:
    """The canonical string, a blank before the first token and after each."""
    s = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(TOKEN), F.lit(1)), " "), F.lit(" "))
    s = F.regexp_replace(s, _UNIT, f" {UNIT}$1")
    s = F.regexp_replace(s, _NAMES, f" {NAME}$1")
    s = F.lower(F.regexp_replace(s, r" (?=\p{N})", f" {NUM}"))
    return F.regexp_replace(s, r" [.!?:\n](?= )", "")


def exploded(df: DataFrame, size: int) -> DataFrame:
    """``df`` (with the canonical string ``__s``) exploded to place and w, the windows of ``size`` tokens.

    Rows without any go after they are exploded: a test before would find all windows twice.  A match
    is tried where a token begins and nowhere else: a token may be as long as a text.
    """
    keep = [c for c in df.columns if c != "__s"]
    chunks = F.regexp_extract_all("__s", F.lit(rf"(?<![^ ])(?=((?:[^ ]++ ){{1,{CHUNK + size - 1}}}+))(?:[^ ]++ ){{1,{CHUNK}}}+"), F.lit(1))
    df = df.select(*keep, F.posexplode_outer(chunks).alias("__c", "__chunk"))
    tokens = " ".join(["[^ ]++"] * size)
    found = F.regexp_extract_all("__chunk", F.lit(rf"(?<![^ ])(?=({tokens}) )[^ ]++ "), F.lit(1))
    df = df.select(*keep, "__c", F.posexplode_outer(found).alias("__p", "w")).where("w is not null")
    return df.select(*keep, (F.col("__c") * CHUNK + F.col("__p")).alias("place"), "w")


def template(w: Column, size: int) -> Column:
    """What a window is compared by: its types, or its values where literals are few."""
    slots = size - -(-LITERAL * size // WINDOW)  # the most that a template has
    typed = F.regexp_replace(w, f"({SLOT})[^ ]+", "$1")
    poor = w.rlike(".*".join([SLOT] * (slots + 1)))
    plain = ~(w.contains(NUM) | w.contains(NAME) | w.contains(UNIT))
    return F.when(plain, w).when(poor, F.concat(F.lit("="), w)).otherwise(typed)


def windows(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``df`` (with ``__s``) exploded to place, w, form and its hash h."""
    parts = [exploded(df, s).withColumn("form", template(F.col("w"), s)) for s in sizes]
    return functools.reduce(DataFrame.unionByName, parts).withColumn("h", F.xxhash64("form"))


def slots(w: Column) -> Column:
    return F.regexp_extract_all(w, F.lit(f"{SLOT}([^ ]+)"), F.lit(1))


def one_to_one(pairs: str) -> Column:
    return (F.size(F.array_distinct(F.transform(pairs, lambda x: x["a"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda x: x["b"]))) == F.size(pairs))


def find_items(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, n_windows, coverage, n_slots: items found."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.withColumn("item_key", F.xxhash64("item_id", "text")).dropDuplicates(["item_id", "item_key"])
    items = items.withColumn("__s", canonical(F.col("text"))).withColumn("tokens", F.filter(F.split("__s", " "), lambda x: x != "")).where("size(tokens) > 0")
    items = items.select("item_id", "item_key", "__s", F.size("tokens").alias("size"), F.least(F.size("tokens"), F.lit(WINDOW)).alias("own"), F.transform("tokens", lambda x: ~x.rlike(SLOT)).alias("literal"))
    items = materialize(items, f"{shared_dir(documents.sparkSession)}/items")
    sizes = sorted({WINDOW, *(r[0] for r in items.select("own").distinct().collect())})  # at most WINDOW rows
    wanted = [windows(items.where(F.col("own") == s).select("item_id", "item_key", "__s"), [s]) for s in sizes]
    wanted = functools.reduce(DataFrame.unionByName, wanted)
    wanted = wanted.select("item_id", "item_key", F.col("place").alias("item_place"), F.col("w").alias("item_w"), F.col("form").alias("item_form"), F.col("h").alias("item_h"))
    n = wanted.count()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), canonical(F.col("text")).alias("__s"))
    side = F.broadcast(wanted) if n <= broadcast_windows else wanted
    hits = windows(docs, sizes).join(side, (F.col("h") == F.col("item_h")) & (F.col("form") == F.col("item_form")))
    pairs = F.transform(F.arrays_zip(slots(F.col("item_w")).alias("a"), slots(F.col("w")).alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    key = ["doc_id", "text_key", "item_id", "item_key"]
    diagonals = (
        hits.withColumn("pairs", pairs)
        .groupBy(*key, (F.col("place") - F.col("item_place")).alias("diagonal"))
        .agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    )
    near = [F.struct((F.col("diagonal") - k).alias("lo"), F.lit(w).alias("w")) for w in range(SHIFT + 1) for k in range(w + 1)]
    spread = diagonals.withColumn("span", F.explode(F.array(*near)))
    spread = spread.groupBy(*key, "span").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    facts = items.select(F.col("item_key").alias("of"), "size", "own", "literal")
    facts = F.broadcast(facts) if n <= broadcast_windows else facts  # an item has a window at least
    spread = spread.where(one_to_one("pairs")).join(facts, F.col("item_key") == F.col("of"))
    spread = spread.withColumn("covered", F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("own") - 1)))))
    spread = spread.withColumn("literals", F.size(F.filter("covered", lambda p: F.get(F.col("literal"), p))))
    n_literals, n_covered = F.size(F.filter("literal", lambda x: x)), F.size("covered")
    enough = (F.col("literals") >= LEAST_LITERALS) & ((n_covered + 1 >= F.floor(coverage * F.col("size"))) | (F.col("literals") >= RUN))
    whole = (F.size(F.array_union("covered", F.array(F.lit(0)))) == F.col("size")) & ((8 * F.col("literals") >= 5 * n_covered) | F.forall("pairs", lambda x: x["a"] == x["b"]))
    found = spread.where(F.when(n_literals > LEAST_LITERALS, enough).otherwise(whole))
    found = found.select(*key[:3], F.size("places").cast("long").alias("n_windows"), (n_covered / F.col("size")).alias("coverage"), F.size("pairs").cast("long").alias("n_slots"))
    best = found.groupBy(*key[:3]).agg(F.max(F.struct("n_windows", "coverage", "n_slots")).alias("best"))
    return best.select(*key[:3], "best.*")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_texts: int = BROADCAST_WINDOWS, **options) -> DataFrame:
    """The rows of ``documents`` whose text holds no item, all columns.

    The texts found are broadcast, eight bytes each, only where they are at most ``broadcast_texts``.
    """
    name = unused(documents, "__bad")
    bad = find_items(documents, benchmark, **options).select(F.col("text_key").alias(name)).distinct()
    bad = materialize(bad, f"{shared_dir(documents.sparkSession)}/found")
    side = F.broadcast(bad) if bad.count() <= broadcast_texts else bad
    return documents.join(side, F.xxhash64(F.col("text").cast("string")) == F.col(name), "left_anti")
