"""Looking up many phrases in one pass over a text.

Testing a text for 200 phrases one after the other scans it 200 times.  Here one regular
expression, built as a prefix tree of the phrases, finds the longest phrase that starts at
each position; the other phrases starting there are exactly its prefixes.
"""

import os.path
import re
from itertools import chain

from pyspark.sql import functions as F


# Alternatives are tried one by one, so long lists are cut into parts behind a test of the first letter.
ALTERNATIVES = 7


def phrase_pattern(phrases):
    """Regular expression for any of the phrases that prefers the longest at a position."""
    by_first = {}
    for phrase in sorted(set(phrases)):
        by_first.setdefault(phrase[:1], []).append(phrase)
    may_end = by_first.pop("", None)
    if not by_first:
        return ""
    options = {}
    for first, group in by_first.items():
        stem = os.path.commonprefix(group)
        options[first] = re.escape(stem) + phrase_pattern([phrase[len(stem):] for phrase in group])
    parts = [list(options)[i:i + ALTERNATIVES] for i in range(0, len(options), ALTERNATIVES)]
    bodies = ["|".join(options[first] for first in part) for part in parts]
    if len(parts) > 1:
        bodies = [f"(?=[{re.escape(''.join(part))}])(?:{body})" for part, body in zip(parts, bodies)]
    return f"(?:{'|'.join(bodies)})" + ("?" if may_end else "")


def bind(value, body):
    """``body(value)`` with the value computed once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def phrase_hits(text, phrases):
    """Distinct phrases that occur anywhere in the text, as substrings, ignoring case."""
    longest = F.regexp_extract_all(F.lower(text), F.lit(f"(?=({phrase_pattern(phrases)}))"), F.lit(1))

    def with_prefixes(match):
        prefixes = F.transform(F.sequence(F.lit(1), F.length(match)), lambda end: F.substring(match, F.lit(1), end))
        return F.filter(prefixes, lambda prefix: prefix.isin(*phrases))

    return F.array_distinct(F.flatten(F.transform(F.array_distinct(longest), with_prefixes)))


def word_count(text, words, word_class):
    """How often any of the words stands in the (lower-case) text on its own."""
    firsts = re.escape("".join(sorted({word[0] for word in words})))
    alone = f"(?=[{firsts}])(?<![{word_class}]){phrase_pattern(words)}(?![{word_class}])"
    return F.regexp_count(text, F.lit(alone))


def best_group(hits, groups, fallback):
    """Group with most of the hit phrases; the earlier group wins a tie, no hit gives the fallback."""
    ranks = {}
    for rank, phrases in enumerate(groups.values()):
        for phrase in phrases:
            ranks.setdefault(phrase, []).append(rank)

    def best_rank(per_hit):
        scored = F.transform(
            F.array_distinct(per_hit),
            lambda rank: F.struct(F.size(F.filter(per_hit, lambda r: r == rank)).alias("hits"), (-rank).alias("order")),
        )
        return -F.array_max(scored)["order"]

    per_hit = F.flatten(F.transform(hits, lambda p: _literal_map(ranks)[p]))
    names = F.array(*[F.lit(name) for name in groups])
    return F.coalesce(F.get(names, bind(per_hit, best_rank)), F.lit(fallback))


def _literal_map(entries):
    pairs = chain.from_iterable(
        (F.lit(key), F.array(*[F.lit(value) for value in values])) for key, values in entries.items()
    )
    return F.create_map(*pairs)
