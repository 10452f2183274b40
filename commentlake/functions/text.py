"""Text feature and tokenising expressions; all are JVM-side Column functions."""

from functools import reduce
from operator import add

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession, functions as F

# The two keyword lists. "ridiculous" is listed twice and counts twice.
POSITIVE_KEYWORDS = [
    "love", "great", "awesome", "amazing", "perfect", "excellent", "fantastic", "wonderful", "brilliant",
    "outstanding", "superb", "fabulous", "incredible", "thank", "thanks", "grateful", "appreciate", "helpful",
    "useful", "valuable", "agree", "exactly", "correct", "right", "yes", "absolutely", "definitely", "smart",
    "clever", "wise", "insightful", "thoughtful", "good", "nice", "well done", "congrats", "congratulations",
    "proud", "impressed", "respect",
]
NEGATIVE_KEYWORDS = [
    "hate", "terrible", "awful", "horrible", "disgusting", "pathetic", "stupid", "dumb", "idiotic", "moronic",
    "ridiculous", "absurd", "nonsense", "crazy", "wrong", "false", "lie", "lies", "fake", "fraud", "scam",
    "bullshit", "bs", "disagree", "no", "never", "impossible", "ridiculous", "outrageous", "disappointed",
    "angry", "mad", "furious", "upset", "annoyed", "frustrated", "waste", "useless", "pointless", "meaningless",
    "worthless", "fail", "failed",
]

# Stop words of the word-frequency report.
REPORT_STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "in", "on", "at", "to", "for", "of", "from", "by", "with", "is",
    "are", "was", "were", "be", "been", "being", "it", "this", "that", "these", "those", "as", "so", "i", "me",
    "my", "we", "our", "you", "your", "he", "she", "they", "them", "their", "his", "her", "rt", "http", "https",
    "co", "com", "www",
]

# The ranges of characters that count as emoji. They overlap, and include box drawing and CJK.
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2500}-\x{2BEF}\x{2702}-\x{27B0}"
    r"\x{24C2}-\x{1F251}\x{1F926}-\x{1F937}\x{10000}-\x{10FFFF}\x{2640}-\x{2642}\x{2600}-\x{2B55}\x{200D}\x{23CF}"
    r"\x{23E9}\x{231A}\x{FE0F}\x{3030}]+"
)

# Unicode white space, as a regex class body and as characters.
SPACE = (
    r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0           "
    "     　"
)

WORD_RUN = r"[\p{L}\p{N}_]+"
TERM_RUN = r"[\p{L}\p{N}_]{2,}"
# The same white space in Java's own terms, which match faster than the list of ranges.
GAP = r"(?U)[\s\x1C-\x1F]+"
# In space-separated text: a word of three or more characters with an upper-case and no lower- or title-case
# letter. Possessive quantifiers keep the scan linear on long words.
SHOUTED = (
    r"(?:^| )(?=[^ ]{3})[^ \p{Lu}\p{Ll}\p{Lt}]*+\p{Lu}[^ \p{Ll}\p{Lt}]*+(?= |$)"
)


def _col(c):
    return c if isinstance(c, Column) else F.col(c)


def strip(c):
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def clean_input(c):
    """Missing text behaves like blank text."""
    return strip(F.coalesce(_col(c), F.lit("")))


def is_ascii(c):
    """No character takes more than one byte, so none is an emoji."""
    return F.octet_length(_col(c)) == F.length(_col(c))


def emoji_runs(c):
    found = F.regexp_extract_all(_col(c), F.lit(EMOJI), F.lit(0))
    return F.when(is_ascii(c), F.array().cast("array<string>")).otherwise(found)


def count_emoji_runs(c):
    return F.when(is_ascii(c), F.lit(0)).otherwise(F.regexp_count(_col(c), F.lit(EMOJI)))


def extract_emojis(c):
    return F.array_join(emoji_runs(c), "")


def strip_emojis(c):
    return strip(F.when(is_ascii(c), _col(c)).otherwise(F.regexp_replace(_col(c), EMOJI, "")))


def count_keywords(c, keywords, mode="substring"):
    """Number of list entries found in the text: inside words by default, or as whole words."""
    return keywords_in(F.lower(_col(c)), keywords, mode)


def keywords_in(lowered, keywords, mode="substring"):
    """The same for text that is lower-cased already."""
    if mode == "substring":
        found = lowered.contains
    elif mode == "token":
        words = F.regexp_extract_all(lowered, F.lit(WORD_RUN), F.lit(0))

        def found(k):
            return F.array_contains(words, k)
    else:
        raise ValueError(f"unknown keyword mode: {mode}")
    return reduce(add, [found(k).cast("int") for k in keywords])


def has_question(c):
    return _col(c).contains("?")


def has_exclamation(c):
    return _col(c).contains("!")


def single_spaced(c):
    return F.regexp_replace(_col(c), GAP, " ")


def has_caps(c):
    return single_spaced(c).rlike(SHOUTED)


def word_count(c):
    """Words of stripped text: one more than its gaps."""
    flat = single_spaced(c)
    return F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + (flat != "").cast("int")


def char_count(c):
    return F.length(_col(c))


def preprocess_letters(c):
    """Lower-case ASCII letters separated by single spaces."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.trim(F.regexp_replace(text, "[^a-z]+", " "))


def preprocess_social(c):
    """Drop links, mentions and hashtags; keep letters and ! ? . ,"""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    text = F.regexp_replace(text, f"(?:http|www)[^{SPACE}]+", "")
    text = F.regexp_replace(text, f"[@#][^{SPACE}]+", "")
    return F.trim(F.regexp_replace(text, "[^a-z!?.,]+", " "))


def preprocess_punct(c):
    """Keep word characters of any script and ! ? . , @ # $ %"""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_!?.,@#$%]+", " "))


def tokenize_words(c):
    """Words for the frequency report: links dropped, stop words and words under three letters removed."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    text = F.regexp_replace(text, rf"https?://[^{SPACE}]+", " ")
    words = F.regexp_extract_all(text, F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(REPORT_STOP_WORDS))


def english_stop_words():
    """The public English list shipped with Spark."""
    SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return StopWordsRemover.loadDefaultStopWords("english")


def tokenize_terms(c, stop_words=()):
    """Terms of two or more word characters, stop words removed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TERM_RUN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def add_bigrams(terms):
    """Terms followed by their adjacent pairs."""
    following = F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0)))
    firsts = F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0)))
    return F.concat(terms, F.zip_with(firsts, following, lambda a, b: F.concat_ws(" ", a, b)))


def text_features(df, text="text"):
    """All text features without a shuffle; blank text gives the zero row.

    What several features share gets a column of its own first, which keeps the generated code small.
    """
    t, low, cleaned, runs = F.col("_t"), F.col("_low"), F.col("cleaned_text"), F.col("_runs")
    shared = df.withColumn("_t", clean_input(text)).withColumns({"_low": F.lower(t), "_runs": emoji_runs(t)})
    # Text without a run is stripped already.
    shared = shared.withColumn("cleaned_text", F.when(F.size(runs) == 0, t).otherwise(strip(F.regexp_replace(t, EMOJI, ""))))
    return shared.withColumns({
        "emojis": F.array_join(runs, ""),
        "emoji_count": F.size(runs),
        "has_question": has_question(t),
        "has_exclamation": has_exclamation(t),
        "has_caps": has_caps(t),
        "word_count": word_count(cleaned),
        "char_count": char_count(t),
        "positive_keywords": keywords_in(low, POSITIVE_KEYWORDS),
        "negative_keywords": keywords_in(low, NEGATIVE_KEYWORDS),
    }).drop("_t", "_low", "_runs")
