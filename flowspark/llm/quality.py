"""Quality rules: distance of a document's character and word histograms from its language's references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bind, broadcast_if_small, materialize, words_of

WINDOW = 8
BLANK = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Character classes that are counted by a pattern; ``other`` (lower-case letters in the main) is what is left.
CLASSES = {"blank": BLANK, "symbol": SYMBOLS, "upper": "\\p{Lu}", "digit": "[0-9]", "punctuation": "[.,;:!?'\"()/=_+@-]"}
#: So many of its most common words stand for each language.
TOP_WORDS = 20
MIN_CHARS = 300
MIN_WORDS = 60
MAX_CHAR_DISTANCE = 0.27
MAX_WORD_DISTANCE = 0.31


def with_base(docs: DataFrame) -> DataFrame:
    """Adds _words, _word_keys and the base counts, row by row.

    Repeated 8-word windows are found by sorting the windows' 64-bit keys with their positions,
    and only in documents where a key occurs twice; so a long text costs n log n.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("_words", words_of(F.col("text")))
    docs = docs.withColumn("_word_keys", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_words").cast("long"))
    key = lambda i: F.xxhash64(*[F.col("_word_keys")[i + j] for j in range(WINDOW)])
    starts = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_word_keys") - WINDOW), key))
    docs = docs.withColumn("_windows", F.coalesce(starts, F.array().cast("array<bigint>")))

    def repeated(found: Column) -> Column:
        same = lambda i, j: (j >= 0) & (j < F.size(found)) & (F.get(found, j)["k"] == F.get(found, i)["k"])
        again = F.filter(F.transform(found, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])), lambda x: x.isNotNull())
        covered = lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"))
        return F.aggregate(F.sort_array(again), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), covered, lambda acc: acc["n"])

    pairs = F.sort_array(F.transform("_windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(bind(pairs, repeated))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counts = {f"_n_{name}": F.regexp_count(text, F.lit(pattern)).cast("long") for name, pattern in CLASSES.items()}
    docs = docs.withColumns(
        {
            "n_repeat_words": repeats.cast("long"),
            "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "_n_chars": F.length(text).cast("long"),
            **counts,
        }
    ).drop("_windows")
    return docs.withColumns(
        {
            "word_chars": F.col("_n_chars") - F.col("_n_blank"),
            "n_symbols": F.col("_n_symbol"),
            "_n_other": F.col("_n_chars") - sum((F.col(f"_n_{c}") for c in CLASSES), F.lit(0)),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def language_references(docs: DataFrame, top: int = TOP_WORDS) -> DataFrame:
    """For each language: chars (shares of the character classes), words (its most common words) and word_shares (theirs and, last, all others').

    Words are runs of letters of any length. Counts cover every document with a language; they are
    combined in each task before they are shuffled.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    text = F.col("text")
    names = [*CLASSES, "other"]
    chars = known.select("lang", F.length(text).alias("all"), F.regexp_count(text, F.lit(WORD)).alias("n_all"), *[F.regexp_count(text, F.lit(p)).alias(c) for c, p in CLASSES.items()])
    chars = chars.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ["all", "n_all", *CLASSES]])
    chars = chars.withColumn("other", F.col("all") - sum((F.col(c) for c in CLASSES), F.lit(0)))
    chars = chars.select("lang", "n_all", F.array(*[F.col(c) / F.greatest(F.col("all"), F.lit(1)) for c in names]).alias("chars"))
    words = known.select("lang", F.explode(words_of(text)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = words.where(F.col("word").rlike("^\\p{L}+$"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = words.withColumn("_at", order).where(F.col("_at") <= top).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_at", "word", "n"))).alias("_best"))
    best = chars.select("lang", "n_all").join(best, "lang").withColumn("_n", F.greatest(F.col("n_all"), F.lit(1)))
    shares = F.transform("_best", lambda b: b["n"] / F.col("_n"))
    rest = F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    best = best.select("lang", F.transform("_best", lambda b: b["word"]).alias("words"), F.concat(shares, F.array(rest)).alias("word_shares"))
    return chars.drop("n_all").join(best, "lang", "left")


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge_quality(docs: DataFrame, references: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, max_languages: int = 1000) -> DataFrame:
    """All columns of ``docs`` plus base counts, base_failed, char_distance, word_distance and kept.

    A document fails if its base rules fail, or if it has at least 300 characters and its
    character-class histogram is farther than ``max_char`` from its language's, or at least 60
    words and its common-word histogram farther than ``max_word``. Shorter texts and unknown or
    null languages are judged by the base rules alone, with null distances. Null text has no
    words and fails. Repeated rows are judged alike, an empty table gives none. Input columns
    with the added names are replaced; others stay, whatever they are called.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    keep = [c for c in docs.columns if c not in added]
    refs = references.select(F.col("lang").alias("_lang"), F.col("chars").alias("_chars"), F.col("words").alias("_common"), F.col("word_shares").alias("_shares"))
    refs = broadcast_if_small(refs, max_languages)
    found = with_base(docs.select("text", "lang", F.struct(*keep).alias("_row"))).join(refs, F.col("lang") == F.col("_lang"), "left")
    mine = F.array(*[F.col(f"_n_{c}") / F.col("_n_chars") for c in [*CLASSES, "other"]])
    counted = F.transform("_common", lambda w: bind(F.xxhash64(w), lambda k: F.size("_word_keys") - F.size(F.array_remove("_word_keys", k))) / F.col("n_words"))
    others = lambda c: F.concat(c, F.array(F.lit(1.0) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))
    char = F.when(F.col("_chars").isNotNull() & (F.col("_n_chars") >= MIN_CHARS), js_distance(mine, F.col("_chars")))
    word = F.when(F.col("_common").isNotNull() & (F.col("n_words") >= MIN_WORDS), bind(counted, lambda c: js_distance(others(c), F.col("_shares"))))
    found = found.withColumns({"char_distance": F.round(char, 6), "word_distance": F.round(word, 6)})
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word)
    found = found.withColumn("kept", ~F.col("base_failed") & ~far)
    # Not deterministic to the optimizer: else a filter on an added column would be moved below and every array computed anew at each use.
    fence = F.monotonically_increasing_id() >= 0
    return found.select(*[F.col("_row").getField(c).alias(c) for c in keep], *[F.when(fence, F.col(c)).alias(c) for c in added])


def op2_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = judge_quality(docs, materialize(language_references(docs), "language-references"))
    return judged.drop("text", "lang")
