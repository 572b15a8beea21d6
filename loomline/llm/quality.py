"""Quality rules (operator 6): a threshold table compiled into one Spark projection.

Statistics are native column expressions over the whole text; each row of ``RULES`` names one of
them with its bounds, and ``verdict`` folds the table into a single Boolean expression.  No user
function, no shuffle.

Words are runs of anything but blank, tab, LF, VT, FF and CR.  Repeated three-word windows are
found by sorting a document's window hashes with their places and looking at neighbours.

Defined results: a null text has no words and fails the base; rows that repeat a ``doc_id`` are
judged each on its own; extra columns pass through ``judge`` untouched unless they bear the name of
one of its results, which then replaces them.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

# Fixed word list: the commonest function words of English, German, French and Spanish
STOP_WORDS = """
the of and to in that is for it with as on be at by this are or from
der die das und in zu den mit von ist nicht auf für ein eine im dem
de la le les et des en un une du que dans pour qui sur au par
el los las y del se por con una para es al lo como
""".split()

# Fixed threshold table: (statistic, least, most); None is no bound
RULES = (
    ("mean_word_length", 2.0, 16.0),
    ("symbol_ratio", None, 0.2),
    ("stop_words", 2, None),
    ("dup_line_ratio", None, 0.5),
)



def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_window_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more; ``hashes``: sorted array of (hash, place)."""
    n = F.size(hashes)

    def again(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(hashes, i - 1)["h"] == x["h"])
        after = F.when(i < n - 1, F.get(hashes, i + 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.array_sort(F.transform(F.filter(hashes, again), lambda x: x["i"]))


def covered(places: Column, width: int) -> Column:
    """Size of the union of [p, p + width) over the sorted ``places``."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).cast("int").alias("last"))
    step = lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda s: s["n"])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once.  Wherever the optimizer moves the expression
    (below a filter, into a lambda), it carries its own binding."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_repeat_words(words: Column) -> Column:
    """Hashes of the words once, then of each window's three, sorted with their places."""

    def windows(h: Column) -> Column:
        one = lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))
        return F.array_sort(F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), one))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda s: covered(repeated_window_words(s), 3).cast("long")))


def base_statistics(documents: DataFrame) -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed
    and the ratios that RULES use."""
    own = {k: unused(documents, f"__{k}") for k in ("text", "words", "lines")}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.withColumn(own["text"], text).withColumn(own["words"], words_of(F.col(own["text"])))
    df = df.withColumn(own["lines"], F.filter(F.split(own["text"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(own["words"]).cast("long")
    df = df.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.regexp_replace(own["text"], r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(own["text"], r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(own["lines"]) - F.size(F.array_distinct(own["lines"]))).cast("long"),
            "n_repeat_words": n_repeat_words(F.col(own["words"])),
        }
    )
    at_least_one = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mean_word_length": F.col("word_chars") / at_least_one,
            "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
            "stop_words": F.size(F.array_intersect(F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))), own["words"])).cast("long"),
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size(own["lines"]), F.lit(1)).cast("double"),
        }
    )
    return df.drop(*own.values())


def verdict(rules=RULES) -> Column:
    """All rules of the table as one expression."""
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & (F.col(name) >= least)
        if most is not None:
            out = out & (F.col(name) <= most)
    return out


def judge(documents: DataFrame, rules=RULES) -> DataFrame:
    """``documents`` with the statistics and ``kept``."""
    df = base_statistics(documents)
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(documents: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``documents`` that are kept, all columns as they were.

    The row number in the predicate keeps the optimizer from moving it below the projections, which
    would copy the statistics into each other's lambdas.
    """
    names = documents.columns
    judged = judge(documents.select(F.col("text"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row")), rules)
    judged = judged.withColumn("__place", F.monotonically_increasing_id())
    return judged.where((F.col("__place") >= 0) & F.col("kept")).select("__row.*")
