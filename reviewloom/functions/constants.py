"""Fixed values that results depend on."""

# The code points Python's str.strip() removes.
WHITESPACE_CODE_POINTS = (
    "9 A B C D 1C 1D 1E 1F 20 85 A0 1680 "
    "2000 2001 2002 2003 2004 2005 2006 2007 2008 2009 200A "
    "2028 2029 202F 205F 3000"
)
WHITESPACE = "".join(chr(int(p, 16)) for p in WHITESPACE_CODE_POINTS.split())

# Words never reported as keywords.
STOPWORDS = [
    "the", "and", "for", "that", "this", "with", "was", "were", "are", "but",
    "had", "have", "has", "too", "very", "not", "you", "your", "our", "all",
    "from", "they", "them", "their", "would", "could", "should", "there",
    "about", "into", "just", "been", "also", "than", "when", "what", "which",
    "because", "while", "after", "before", "then", "food", "product",
]

# Cells a CSV reader takes as missing.
MISSING_WORDS = (
    "#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|"
    "N/A|NA|NULL|NaN|None|n/a|nan|null"
).split("|")

# Columns of raw reviews and their names in the review sets.
REVIEW_FIELDS = {
    "Text": "text",
    "Summary": "summary",
    "Score": "Score",
    "HelpfulnessNumerator": "HelpfulnessNumerator",
    "HelpfulnessDenominator": "HelpfulnessDenominator",
}

# Classes of the sentiment model with their ids, and the scores that belong to them.
CLASS_IDS = {"NEGATIVE": 0, "POSITIVE": 1}
CLASS_OF_SCORE = {1: "NEGATIVE", 2: "NEGATIVE", 4: "POSITIVE", 5: "POSITIVE"}

# Lengths, sizes and seeds of the stages.
SEED = 42
CLEAN_MIN_CHARS = 20
SEARCH_MIN_CHARS = 30
MIN_TOPIC_SIZE = 20
SUMMARY_KEYWORDS = 6
MAX_TOKENS = 512
HIT_CHARS = 500
EVIDENCE_CHARS = 450
OUTLIER_TOPIC = -1

# Text of the summary sentence.
SUMMARY_SENTENCE = (
    "Top retrieved reviews for '{query}' suggest recurring issues around: {keywords}. "
    "Below are representative supporting reviews."
)
NO_KEYWORDS = "no dominant keywords found"

# Scores are ranked and reported at this many decimals, so that the order in
# which a plan adds up products cannot decide a rank.
SCORE_DIGITS = 9
