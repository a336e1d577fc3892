"""Quality rules: base counts, and divergence of a document from its language.

Every document gets two histograms: its characters by class, and its words by the common words of
its language (all others in one bin). A language's reference is the mean histogram of its documents that
pass the base rules, each document counting once. A document whose Jensen-Shannon distance
from the reference exceeds a limit is rejected; documents too short for a histogram to mean anything
are exempt. Everything is built-in column functions.

Word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.enrich import small_side
from seriesloom.storage import written_table

# Limits of the base rules.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

# Common words per language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "with", "on", "it"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "ist", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "dans"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"),
}
N_COMMON = 12
CLASSES = ("lower", "space", "upper", "digit", "mark", "symbol", "other")

# A document is rejected if one distance exceeds its limit, or both exceed the lower limits;
# distances lie between 0 and 1.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.4
JOINT_CLASS_DISTANCE, JOINT_WORD_DISTANCE = 0.13, 0.26
# Shortest documents that are compared, in characters and in words.
MIN_CLASS_CHARS = 200
MIN_COMPARED_WORDS = 60

_SPACE = r"[ \t\n\x0B\f\r]+"
# Characters other than small letters and spaces, by class.
_REST = {"breaks": r"\t\n\x0B\f\r", "upper": "A-Z", "digit": "0-9", "mark": r".,;:!?'\"()\-", "symbol": "#*$%&|<>"}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _removed(text: str, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def _repeated_words(windows: str) -> Column:
    """Words inside windows (hashes by start) that occur at least twice."""
    def covered(starts: Column) -> Column:
        # each window adds the words up to the next one's start
        return F.aggregate(F.transform(starts, lambda p, i: F.least(
            F.lit(REPEAT_WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(REPEAT_WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    def starts(ordered: Column) -> Column:
        again = F.filter(ordered, lambda e, i: (
            F.coalesce(F.get(ordered, i - 1)["h"] == e["h"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["h"] == e["h"], F.lit(False))))
        return F.array_sort(F.transform(again, lambda e: e["p"]))

    w = F.col(windows)
    ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
        bound(bound(ordered, starts), covered)).cast("long")


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang``, the base counts, and the histograms ``classes`` and ``common`` of each document."""
    d = docs.select("doc_id", F.col("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("t"))
    # one pass drops runs of small letters and spaces; what is left is short
    d = d.withColumns({"words": F.array_remove(F.split("t", _SPACE), ""), "rest": _removed("t", "[a-z ]+"),
                       "blanks": F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit("")))})
    d = d.withColumns({name: F.length(_removed("rest", f"[^{chars}]+")) for name, chars in _REST.items()})
    spaces = F.col("blanks") + F.col("breaks")
    small = F.length("t") - F.length("rest") - F.col("blanks")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^ \t\n\x0B\f\r]"))
    lists = [word for words in COMMON_WORDS.values() for word in words]
    d = d.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("t") - spaces).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"),
        bound(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        F.array(small, spaces, "upper", "digit", "mark", "symbol", F.length("rest") - F.col("breaks")
                - F.col("upper") - F.col("digit") - F.col("mark") - F.col("symbol")).alias("classes"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(lists)), "  "), F.lit(" ")).alias("found"))
    windows = F.when(F.col("n_words") < REPEAT_WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - REPEAT_WINDOW), lambda i: F.xxhash64(
            *[F.get("hashes", i + k) for k in range(REPEAT_WINDOW)])))
    table = F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v))
                           for pair in COMMON_WORDS.items() for v in pair])
    mine = F.coalesce(F.element_at(table, F.col("lang")), F.array_repeat(F.lit("").cast("string"), N_COMMON))
    d = d.select("*", windows.alias("windows"), mine.alias("mine"))
    d = d.withColumn("counts", F.transform("mine", lambda k: F.when(k == "", F.lit(0)).otherwise(
        ((F.length("found") - F.length(F.replace("found", F.concat(F.lit(" "), k, F.lit(" ")), F.lit(""))))
         / (F.length(k) + 2)).cast("int"))))
    total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    _repeated_words("windows").alias("n_repeat_words"), "classes",
                    F.concat("counts", F.array(F.col("n_words").cast("int") - total)).alias("common"))


def _shares(histogram: str) -> Column:
    total = F.aggregate(histogram, F.lit(0), lambda a, x: a + x)
    return bound(F.greatest(total, F.lit(1)), lambda n: F.transform(histogram, lambda x: x / n))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) / 2)


def _mean_histogram(shares: str, n: int) -> Column:
    return F.array(*[F.avg(F.when(~F.col("base_failed"), F.get(shares, F.lit(i)))) for i in range(n)])


def quality_verdicts(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE,
                     max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document: base counts, ``base_failed``, ``kept`` and the distances.

    A null text counts as empty and fails the base rules; a null or unlisted language has a
    reference of its own whose word histogram has one bin. Repeated rows are judged alike, one by one.
    Columns besides doc_id, text and lang are ignored; an empty table gives an empty result.
    Documents of a language of which none passes the base rules have no distance and are not
    rejected by it. The table of references has one row per language; it is broadcast only
    after its size is measured.
    """
    d = document_features(docs)
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    d = written_table(d.withColumns({
        "base_failed": failed, "classes": _shares("classes"), "common": _shares("common"),
        "n_chars": F.col("word_chars") + F.get("classes", F.lit(1))}))
    references = d.groupBy("lang").agg(_mean_histogram("classes", len(CLASSES)).alias("ref_classes"),
                                       _mean_histogram("common", N_COMMON + 1).alias("ref_common"))
    references = small_side(written_table(references.withColumnRenamed("lang", "ref_lang")))
    judged = d.join(references, F.col("lang").eqNullSafe(F.col("ref_lang")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("n_chars") >= MIN_CLASS_CHARS,
               js_distance(F.col("classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(F.col("n_words") >= MIN_COMPARED_WORDS,
               js_distance(F.col("common"), F.col("ref_common"))).alias("word_distance"))
    c, w = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = ((c > max_class_distance) | (w > max_word_distance)
           | ((c > JOINT_CLASS_DISTANCE) & (w > JOINT_WORD_DISTANCE)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
                         "class_distance", "word_distance")
