"""Text functions: every one maps Columns to a Column and stays inside the JVM.

Letters, digits and white space are Unicode-wide, so the classes are spelled out; the short
forms ``\\w`` and ``\\s`` mean ASCII only in Java regular expressions.  Most characters are
letters, so a class that excludes letters tests for them first (``\\P{L}&&``); that makes the
scans about twice as fast.
"""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from opinionloom.functions import vocab
from opinionloom.functions.phrases import best_group, bind, phrase_hits

# Inside of a character class: word characters, and white space.
WORD = r"\p{L}[\p{N}_]"
SPACE = r"\p{IsWhite_Space}\x{1c}-\x{1f}"

# The same white space, character by character.
SPACE_CHARACTERS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

URL = rf"http[^{SPACE}]+|www\.[^{SPACE}]+"
TAG = r"<[^\n]*?>"
SYMBOLS = rf"[\P{{L}}&&[^\p{{N}}_,.{SPACE}]]+"
SPACES = rf"[\P{{L}}&&[{SPACE}]]+"
DOTS = r"\.{2,}"
PUNCTUATION = rf"[\P{{L}}&&[^\p{{N}}_{SPACE}]]+"
NOT_ALNUM = r"[\P{L}&&\P{N}]+"
CLAUSE_END = rf"[.!?]|(?=[bhtBHT])(?<![{WORD}])(?i:but|however|though)(?![{WORD}])"
SENTENCE_END = rf"([.!?])[{SPACE}]+"

# All that ``clean_text`` leaves besides letters and digits.
CLEAN_SIGNS = " ,._"


def clean_text(text):
    """Drop links, tags and symbols, squeeze white space and runs of dots; NULL becomes ''."""
    no_links = _replace_if(text, ("http", "www."), URL, "")
    no_tags = _replace_if(no_links, ("<",), TAG, "")
    words_only = F.regexp_replace(no_tags, SYMBOLS, "")
    squeezed = F.trim(F.regexp_replace(words_only, SPACES, " "))
    return F.coalesce(_replace_if(squeezed, ("..",), DOTS, "."), F.lit(""))


def _replace_if(text, signs, pattern, replacement):
    """Replace a pattern that cannot match without one of the signs; looking for those is cheap."""

    def replaced(value):
        there = reduce(or_, [value.contains(sign) for sign in signs])
        return F.when(there, F.regexp_replace(value, pattern, replacement)).otherwise(value)

    return bind(text, replaced)


def trim_space(text):
    """Trim white space of any kind from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_meaningless(text, filler=vocab.FILLER_WORDS, min_letters=vocab.MIN_LETTERS,
                   min_alnum_share=vocab.MIN_ALNUM_SHARE, signs=None):
    """True for a missing or blank text, only filler words, too few letters or too many symbols.

    ``signs`` names the ASCII characters besides letters and digits that the text can hold, if no others can be in it; then
    they are counted without a regular expression.
    """
    lowered = F.lower(text)
    # Only a text made of filler letters is worth splitting into tokens.
    filler_letters = "".join(sorted(set("".join(filler))))
    tokens = F.split(lowered, SPACES)
    only_filler = lowered.rlike(rf"^[{filler_letters}{SPACE}]*$") & (
        F.size(F.array_except(tokens, F.array(*[F.lit(w) for w in (*filler, "")]))) == 0
    )
    enough_letters = text.rlike(r"\p{L}[^\p{L}]*+" * min_letters)
    if signs is None:
        alnum = F.length(F.regexp_replace(text, NOT_ALNUM, ""))
    else:
        alnum_only = reduce(lambda value, sign: F.replace(value, F.lit(sign), F.lit("")), signs, text)
        alnum = F.length(text) - (F.octet_length(text) - F.octet_length(alnum_only))
    alnum_share = F.try_divide(alnum, F.length(text))
    return F.coalesce(only_filler | ~enough_letters | (alnum_share < min_alnum_share), F.lit(True))


def normalise_review(text):
    """Comparison key of a review: lower case, trimmed; a missing text reads 'nan'."""
    return F.coalesce(trim_space(F.lower(text)), F.lit("nan"))


def words(text):
    """Lower-case words in reading order, punctuation removed; may hold one leading ''."""
    return F.split(F.regexp_replace(F.lower(text), PUNCTUATION, ""), SPACES)


def split_clauses(text):
    """Clauses between sentence ends and the words but, however and though."""
    return F.array_remove(F.transform(F.split(text, CLAUSE_END), trim_space), "")


def split_sentences(text):
    """Sentences, with their end marks: cut after [.!?] before white space, and at line ends."""
    lines = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n")
    return F.array_remove(F.transform(lines, trim_space), "")


def matching_terms(text, terms=vocab.ASPECT_TERMS):
    """All terms that occur in the text as substrings, in the order of the list, ignoring case."""

    def found(lowered):
        return F.array_compact(F.array(*[F.when(lowered.contains(term), F.lit(term)) for term in terms]))

    return bind(F.lower(text), found)


def detect_aspect(text, keywords=vocab.ASPECT_KEYWORDS, fallback=vocab.FALLBACK_ASPECT):
    """Aspect with most (lower-case) keywords in the text; see ``best_group`` for ties."""
    every_phrase = list(dict.fromkeys(phrase for phrases in keywords.values() for phrase in phrases))
    return best_group(phrase_hits(text, every_phrase), keywords, fallback)
