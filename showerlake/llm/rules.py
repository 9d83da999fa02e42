"""Quality rules: counting rules, and divergence from language references by Jensen-Shannon distance.

Everything is DataFrame operations; each text is read once and leaves a row of counts.
The reference of a language is the mean histogram of all its documents that pass the
counting rules, so it is as good as the corpus is mostly clean. A document is compared with the
reference of its own `lang`, by classes of characters and by common words, and only if
it is long enough; in a language without a list of common words (or null) only the classes count.

Null and empty texts have no words and fail the counting rules. Repeated rows are judged each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, text_column, written

# Common words of four languages.
COMMON_WORDS = {
    "de": ["aber", "als", "auf", "das", "der", "die", "ein", "im", "in", "ist", "mit", "nicht", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "for", "in", "is", "it", "of", "on", "that", "the", "to", "was", "with"],
    "es": ["a", "con", "de", "del", "el", "en", "la", "las", "los", "no", "por", "que", "se", "un", "y"],
    "fr": ["dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pour", "que", "qui", "sur", "un"],
}
#: Classes of characters; what is none of them (letters above all) is a class too, and so is white space.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "mark": r"[.,;:!?'\"()\-]"}
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_WORDS_FOR_LIST = 100
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.29


def repeated_window_words(windows: Column) -> tuple[Column, Column]:
    """From the hashes of all 3-word windows: those that occur twice, as sorted (hash, place); see `counted`."""
    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(placed)).otherwise(F.slice(placed, 1, 0)), placed


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each whole text."""
    df = docs.select("doc_id", "lang", text_column().alias("text"))
    df = df.withColumn("_trimmed", F.btrim("text", F.lit(SPACE)))
    df = df.withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", SPACE_CLASS + "+")))
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOLS)).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.withColumn("_lines", F.when(F.instr("text", "\n") > 0, lines).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"_{name}", F.regexp_count("text", F.lit(pattern)).cast("double"))
    df = df.withColumn("_chars", F.length("text").cast("double"))
    space = F.col("_chars") - F.col("word_chars")
    listed = [F.col(f"_{c}") for c in CLASSES] + [F.col("n_symbols").cast("double"), space]
    rest = F.greatest(F.lit(0.0), F.col("_chars") - sum(listed[1:], listed[0]))
    df = df.withColumn("classes", F.array(*listed, rest))
    by_lang = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        by_lang = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in words])).otherwise(by_lang)
    df = df.withColumn("_list", by_lang)
    codes = F.filter(F.transform("_words", lambda w: F.array_position("_list", w)), lambda c: c > 0)
    df = df.withColumn("_codes", codes)
    each = F.transform(F.sequence(F.lit(1), F.size("_list")), lambda k: F.size(F.filter("_codes", lambda c: c == k)).cast("double"))
    df = df.withColumn("common", F.when(F.col("_list").isNotNull(), F.concat(each, F.array((F.col("n_words") - F.size("_codes")).cast("double")))))
    window = lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))
    df = df.withColumn("_windows", F.transform(F.slice("_words", F.lit(1), F.greatest(F.lit(0), F.size("_words") - 2)), window))
    df = df.withColumn("_sorted", repeated_window_words(F.col("_windows"))[0])
    s = F.col("_sorted")
    twin = lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])))
    p = F.col("_places")
    covers = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0), lambda a, x: a + x).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "classes", "common")


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.try_divide(x, total))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2 of two histograms of shares, from 0 to 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def references(counts: DataFrame) -> DataFrame:
    """One row per language: the mean shares of its documents that pass the counting rules."""
    good = counts.filter(~F.col("base_failed"))
    n_classes, n_common = len(CLASSES) + 3, len(next(iter(COMMON_WORDS.values()))) + 1
    sums = [F.avg(F.get(shares(F.col("classes")), F.lit(i))).alias(f"c{i}") for i in range(n_classes)]
    sums += [F.avg(F.get(shares(F.col("common")), F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    ref = good.groupBy("lang").agg(*sums)
    words = F.when(F.col("w0").isNotNull(), F.array(*[F.col(f"w{i}") for i in range(n_common)]))
    return ref.select(F.col("lang").alias("_lang"), F.array(*[F.col(f"c{i}") for i in range(n_classes)]).alias("_ref_classes"), words.alias("_ref_common"))


def judged(docs: DataFrame, class_distance: float = MAX_CLASS_DISTANCE, word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """The counts of each document, its two distances (null: not compared) and the verdict `kept`."""
    counts = written(counted(docs), "rule-counts")
    df = counts.join(references(counts), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    far = F.when(F.col("n_words") >= MIN_WORDS, js_distance(shares(F.col("classes")), F.col("_ref_classes")))
    df = df.withColumn("class_distance", far)
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS_FOR_LIST, js_distance(shares(F.col("common")), F.col("_ref_common"))))
    ok = (F.coalesce("class_distance", F.lit(0.0)) <= class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= word_distance)
    return df.withColumn("kept", ~F.col("base_failed") & ok).drop("_lang", "_ref_classes", "_ref_common", "classes", "common")
