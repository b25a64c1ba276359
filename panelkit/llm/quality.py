"""Quality rules in DataFrame functions only: counts of words, repeats and symbols, and distribution divergence.

Each document's histograms of character classes and of common words are held
against those of its language by Jensen-Shannon distance. The references are
sums over all documents of a language that are not too short or full of symbols.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.shared import boxed, pinned, unboxed

#: Common function words of English, German, French and Spanish (fixed values).
COMMON_WORDS = (
    "the of and to in is that it for was on are with as at by be this from or "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les et un une du dans que est pour qui sur au avec par ne pas "
    "el los las del y se lo por con una su al es como más o"
).split()
SYMBOLS = "#*$%&|<>"
#: Character classes, as what is taken away when the characters of a class are counted (fixed values); the rest is the last class.
SPACE_CLASS, SYMBOL_CLASS = "[^ \\t-\\r]+", "[^#*$%&|<>]+"
CLASSES = ("[^a-z0-9]+", "[^A-Z]+", SPACE_CLASS, "[^.,;:!?'\"()-]+", SYMBOL_CLASS, "[\\x00-\\x7F]+")

WINDOW = 8
MIN_WORDS = 20
#: Shorter documents are not judged by divergence: their histograms are noise.
MIN_CHARS = 300
MIN_JUDGED_WORDS = 150
#: A language with fewer characters than this over all its documents has no reference.
MIN_REFERENCE_CHARS = 20_000
MAX_CLASS_DISTANCE = 0.19
MAX_WORD_DISTANCE = 0.25
#: Rows of the reference table that may be broadcast; beyond it Spark picks the join.
BROADCAST_ROWS = 10_000


def _removed(text: Column, pieces: str) -> Column:
    """How many characters of ``pieces`` (all of one byte) the text holds."""
    kept = reduce(lambda left, c: F.replace(left, F.lit(c), F.lit("")), pieces, text)
    return (F.octet_length(text) - F.octet_length(kept)).cast("bigint")


def with_features(docs: DataFrame, histograms: bool = True, repeats: bool = True) -> DataFrame:
    """``docs``, one struct column ``q``, and ``_row``, a row number. A null text counts as empty.

    Conditions on ``q`` go along with one on ``_row``: as row numbers are not deterministic, the optimizer then does not
    push the conditions below, which would evaluate the arrays behind ``q`` again for each of their uses.
    """
    rows = docs.drop("q", "_row", "_t", "_w", "_h", "_lines", "_s").withColumn("_t", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_w", F.array_remove(F.split("_t", "[ \\t-\\x0D]+"), ""))
    names = [c for c in docs.columns if c not in ("q", "_row")]
    spaces = _removed(F.col("_t"), " \t\n\x0b\f\r")
    base = [
        F.size("_w").cast("bigint").alias("n_words"),
        (F.length("_t") - spaces).cast("bigint").alias("word_chars"),
        _removed(F.col("_t"), SYMBOLS).alias("n_symbols"),
    ]
    if repeats:
        lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
        rows = rows.withColumn("_lines", F.when(F.contains("_t", F.lit("\n")), lines)).withColumn("_h", _window_hashes())
        rows = rows.withColumn("_s", _repeated_windows())
        dup_lines = F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0))
        base += [dup_lines.cast("bigint").alias("n_dup_lines"), _covered().cast("bigint").alias("n_repeat_words")]
    if histograms:
        kept = lambda c: F.length(F.regexp_replace("_t", c, "")).cast("bigint")
        # White space and symbols are counted already, without a regular expression.
        counts = [spaces if c == SPACE_CLASS else _removed(F.col("_t"), SYMBOLS) if c == SYMBOL_CLASS else kept(c) for c in CLASSES]
        base += [F.array(*counts, F.length("_t").cast("bigint")).alias("chars"), _common_counts().alias("common")]
    return rows.select(*names, F.struct(*base).alias("q"), F.monotonically_increasing_id().alias("_row"))


def _window_hashes() -> Column:
    hashes = F.transform("_w", lambda w: F.xxhash64(w))
    # The word hashes are bound once, as the only element of an array that the window expression is mapped over.
    bound = F.transform(F.array(hashes), lambda k: F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(k, i, WINDOW))))
    return F.when(F.size("_w") >= WINDOW + 1, F.element_at(bound, 1))


def _repeated_windows() -> Column:
    """Sorted (hash, position) pairs, only where some window hash repeats."""
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs)


def _covered() -> Column:
    """Words inside windows that occur twice or more."""

    def again(x: Column, k: Column) -> Column:
        before, after = F.get("_s", k - 1)["h"], F.get("_s", k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    at = F.array_sort(F.transform(F.filter("_s", again), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"))
    return F.when(F.col("_s").isNotNull(), F.aggregate(at, start, step, lambda a: a["total"])).otherwise(0)


def _common_counts() -> Column:
    """How often each common word is a word of the text, case aside; then the number of all words."""
    common = F.filter(F.transform("_w", lambda w: F.lower(w)), lambda w: w.isin(*COMMON_WORDS))
    line = F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" "))
    count = lambda s, w: ((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("bigint")
    counts = F.transform(F.array(line), lambda s: F.array(*(count(s, w) for w in COMMON_WORDS), F.size("_w").cast("bigint")))
    return F.element_at(counts, 1)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def references(features: DataFrame) -> DataFrame:
    """Per language: summed histograms ``ref_chars`` and ``ref_common`` over the documents of ``MIN_WORDS`` words or more and at most one symbol in 20 words.

    A null language is the language ``''``.
    """
    q = F.col("q")
    rows = features.where((F.col("_row") >= 0) & (q["n_words"] >= MIN_WORDS) & (20 * q["n_symbols"] <= q["n_words"]))
    # Sums in exact numbers, so that the order of rows makes no difference.
    sums = [F.sum(q["chars"][k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)] + [F.sum(q["common"][k]).alias(f"w{k}") for k in range(len(COMMON_WORDS) + 1)]
    summed = rows.groupBy(F.coalesce("lang", F.lit("")).alias("ref_lang")).agg(*sums)
    return summed.select(
        "ref_lang",
        F.array(*(f"c{k}" for k in range(len(CLASSES) + 1))).alias("ref_chars"),
        F.array(*(f"w{k}" for k in range(len(COMMON_WORDS) + 1))).alias("ref_common"),
    )


def _shares(counts: Column) -> Column:
    """The listed counts, then the rest of the total in the last place, over the total."""
    n = F.size(counts)
    total = F.element_at(counts, -1)
    listed = F.slice(counts, F.lit(1), n - 1)
    rest = total - F.aggregate(listed, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(F.concat(listed, F.array(rest)), lambda x: F.try_divide(x.cast("double"), total.cast("double")))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms of shares; between 0 and 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda x, y: term(x, (x + y) / 2) + term(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def judged(features: DataFrame, reference: DataFrame) -> DataFrame:
    """``features`` with ``class_distance``, ``word_distance`` (null where a minimum length or a reference is missing) and ``diverges``."""
    small = reference.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    q = F.col("q")
    rows = features.join(F.broadcast(reference) if small else reference, F.coalesce("lang", F.lit("")) == F.col("ref_lang"), "left")
    enough = F.element_at("ref_chars", -1) >= MIN_REFERENCE_CHARS
    return (
        rows.withColumn("class_distance", F.when(enough & (F.element_at(q["chars"], -1) >= MIN_CHARS), jensen_shannon(_shares(q["chars"]), _shares(F.col("ref_chars")))))
        # All other words are one more bin, so that a text without common words is far from any language.
        .withColumn("word_distance", F.when(enough & (q["n_words"] >= MIN_JUDGED_WORDS), jensen_shannon(_shares(q["common"]), _shares(F.col("ref_common")))))
        .withColumn("diverges", F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False)))
        .drop("ref_lang", "ref_chars", "ref_common")
    )


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the base counts, ``base_failed``, ``kept`` and the two distances.

    A null text is empty and fails the base rules; a null ``lang`` is a language of its own; repeated rows are judged
    one by one; documents too short for a histogram, or of a language without a reference, are judged by the base rules.
    """
    features = pinned(with_features(docs.select("doc_id", "text", "lang")).drop("text"))
    q = F.col("q")
    return judged(features, references(features)).select(
        "doc_id",
        *(q[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(q).alias("base_failed"),
        (~base_failed(q) & ~F.col("diverges")).alias("kept"),
        "class_distance",
        "word_distance",
    )


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and don't diverge from their language, columns unchanged.

    The references take one pass over the texts and the verdicts another, so that no text is shuffled.
    """
    reference = pinned(references(with_features(docs.select("text", "lang"), repeats=False)))
    rows = judged(with_features(boxed(docs, "text", "lang")), reference)
    return unboxed(rows.where((F.col("_row") >= 0) & ~base_failed(F.col("q")) & ~F.col("diverges")), docs.columns, "text", "lang")
