"""Quality rules by distribution divergence, in DataFrame functions only.

A language's reference is what the corpus itself shows: the share of each character class over all its documents, and its
most common words with their shares of all words. A document is compared with the reference of its language by the
Jensen-Shannon distance (base 2, 0 to 1). Texts below a length have too few characters or words for a histogram, and texts
without language or reference have nothing to be compared with; both pass this rule.

Null texts count as empty; repeated rows and ids are judged row by row; an empty table gives no rows; further columns are
ignored. Long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.store import stored
from tapelake.session import prepare

_SPACE = "[ \\t-\\r]"
#: Character classes by what stays when everything else is taken away; lower-case letters, white space and the rest follow by
#: subtraction.
_CLASSES = {"upper": "[^\\p{Lu}]+", "digit": "[^0-9]+", "stop": "[^.,;:!?'\"()-]+", "symbol": "[^#*$%&|<>@^~=+_/{}\\[\\]\\\\`]+"}
#: A window's key holds its place in as many low bits; the hash bits above only choose which windows are compared in full.
_PLACE_BITS = 31
COMMON_WORDS = 16
MIN_CHARS, MIN_WORDS = 100, 50
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.28, 0.38


def _pieces(text: Column) -> Column:
    # One plain character splits without a pattern.
    return F.split(F.regexp_replace(text, "[\\t-\\r]+", " "), " ")


def words_of(text: Column) -> Column:
    return F.array_remove(_pieces(text), "")


def _only(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _held(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that Catalyst does not copy their expressions into every later use."""
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(one)).alias("_held")).select(*keep, *[f"_held.{n}" for n in columns])


def _windows(hashes: Column) -> Column:
    """The hashes of every three consecutive words."""
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
                       lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))


def _keys(windows: Column) -> Column:
    """Of texts that repeat a window, high bits of every hash above its place, in order; plain numbers sort fast."""
    high = F.lit(-(1 << _PLACE_BITS)).cast("long")
    keys = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), keys)


def _alike(keys: Column) -> Column:
    """Places of the windows whose high bits another window shares: all that occur twice, hardly any other."""
    pairs = F.zip_with(keys, F.slice(keys, 2, F.greatest(F.size(keys), F.lit(1))), lambda a, b: F.when(
        F.shiftrightunsigned(a.bitwiseXOR(b), _PLACE_BITS) == 0, F.array(a, b)))
    shared = F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))
    return F.transform(shared, lambda k: k.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1).cast("long")).cast("int"))


def _repeats(trigrams: Column) -> Column:
    """Words covered by three-word windows found twice; ``trigrams`` are (hash, place) sorted by both, places from 1."""
    again = F.zip_with(trigrams, F.slice(trigrams, 2, F.greatest(F.size(trigrams), F.lit(1))),
                       lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    places = F.zip_with(trigrams, again, lambda x, b: F.when(b, x["i"]).otherwise(-x["i"]))
    places = F.zip_with(places, F.concat(F.array(F.lit(False)), again), lambda v, b: F.when(b, F.abs(v)).otherwise(v))
    return F.sort_array(F.filter(places, lambda v: v > 0))


def _covered(places: Column) -> Column:
    steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))),
                       lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def text_counts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The base counts of every text, its character classes, and the hashes of its words in rising and in falling order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # Without lower-case letters and white space little is left of a text, and every other class whole.
    out = _held(df, keep, words=words_of(whole), n_chars_all=F.length(whole).cast("long"),
                _lines=F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
                _marks=F.regexp_replace(whole, "[\\p{Ll} \\t-\\r]+", ""))
    classes = {c: _only(F.col("_marks"), others) for c, others in _CLASSES.items()}
    out = _held(out, [*keep, "n_chars_all"], n_words=F.size("words").cast("long"),
                word_chars=F.length(F.concat_ws("", "words")).cast("long"), n_symbols=_only(F.col("_marks"), "[^#*$%&|<>]+"),
                n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                n_marks=F.length("_marks").cast("long"), hashes=F.transform("words", lambda w: F.xxhash64(w)), **classes)
    kept = [*keep, "n_chars_all", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_marks", "hashes", *classes]
    kept = [c for c in kept if c != "hashes"]
    out = _held(out, kept, _windows=_windows(F.col("hashes")), rising=F.sort_array("hashes"))
    kept.append("rising")
    out = _held(out, [*kept, "_windows"], _keys=_keys(F.col("_windows")), falling=F.reverse("rising"))
    kept.append("falling")
    out = _held(out, kept, _sorted=F.sort_array(F.transform(
        _alike(F.col("_keys")), lambda i: F.struct(F.get("_windows", i).alias("h"), (i + 1).alias("i")))))
    out = _held(out, kept, _places=_repeats(F.col("_sorted")))
    return out.withColumn("lower", F.col("word_chars") - F.col("n_marks")).withColumn(
        "n_repeat_words", F.coalesce(_covered(F.col("_places")), F.lit(0).cast("long"))).drop("n_marks", "_places")


def common_words(df: DataFrame, top: int = COMMON_WORDS, lang: str = "lang", text: str = "text") -> DataFrame:
    """Per language the hashes of its most frequent words, with their numbers."""
    words = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_pieces(F.col(text))).alias("w"))
    counts = words.filter(F.col("w") != "").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    rows = counts.withColumn("r", rank).filter(F.col("r") <= top).groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("r", F.xxhash64("w").alias("h"), "n"))).alias("x"))
    return rows.select("lang", F.col("x.h").alias("ref_hashes"), F.col("x.n").alias("ref_counts"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as arrays of shares."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _with_rest(shares: Column) -> Column:
    return F.concat(shares, F.array(F.greatest(1.0 - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def judged(docs: DataFrame, keep: list[str], max_chars: float = MAX_CHARS_DISTANCE, max_words: float = MAX_WORDS_DISTANCE,
           min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, top: int = COMMON_WORDS) -> DataFrame:
    """Counts and verdicts: the columns ``keep`` of every row, its base counts, both distances, base_failed and kept."""
    prepare(docs.sparkSession)
    words = stored(common_words(docs, top), "common-words")
    listed = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, listed)], F.col("lang").alias("lang"), "text")
    counts = text_counts(rows, [*listed, "lang"]).join(words, "lang", "left")
    # A word's occurrences stand together in order: from its first place to its last, which is its first from the other end.
    first, last = ([F.array_position(c, F.get("ref_hashes", F.lit(k))) for k in range(top)] for c in ("rising", "falling"))
    hits = F.array(*[F.when(a > 0, F.col("n_words") + 2 - a - b).otherwise(0) for a, b in zip(first, last)])
    seen = stored(counts.withColumn("hits", hits).drop("rising", "falling", "ref_hashes"), "text-counts")
    names = ["upper", "lower", "digit", "stop", "symbol", "space", "rest"]
    seen = seen.withColumn("space", F.col("n_chars_all") - F.col("word_chars")).withColumn(
        "rest", F.col("word_chars") - sum((F.col(c) for c in names[:-2]), F.lit(0)))
    reference = seen.filter(F.col("lang").isNotNull()).groupBy("lang").agg(
        *[F.sum(c).alias(f"all_{c}") for c in names], F.sum("n_chars_all").alias("all_chars"), F.sum("n_words").alias("all_words"))
    reference = stored(reference.select("lang", "all_words", F.array(*[F.col(f"all_{c}") / F.col("all_chars") for c in names])
                                        .alias("ref_classes")), "class-shares")
    out = seen.join(reference, "lang", "left")
    chars = divergence(F.array(*[F.col(c) / F.col("n_chars_all") for c in names]), F.col("ref_classes"))
    shares = F.transform(F.slice("hits", 1, F.size("ref_counts")), lambda x: x / F.col("n_words"))
    words_far = divergence(_with_rest(shares), _with_rest(F.transform("ref_counts", lambda n: n / F.col("all_words"))))
    out = out.withColumn("chars_distance", F.when((F.col("n_chars_all") >= min_chars) & F.col("ref_classes").isNotNull(), chars))
    out = out.withColumn("words_distance", F.when((F.col("n_words") >= min_words) & F.col("ref_counts").isNotNull(), words_far))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = F.coalesce(F.col("chars_distance") > max_chars, F.lit(False)) | F.coalesce(F.col("words_distance") > max_words, F.lit(False))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, listed)], "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "chars_distance", "words_distance", failed.alias("base_failed"), (~failed & ~far).alias("kept"))
