"""Which terms of a large vocabulary table occur in which texts, by an index of the terms' rarest grams."""

import pyarrow as pa
from pyspark.sql import functions as F

from opinionloom.functions.phrases import bind
from opinionloom.sources.readers import quoted
from opinionloom.sources.shared import kept

# Code points of a gram; a shorter term is a gram itself.
GRAM = 4
# Bytes of the index that are sent to all tasks; a larger index meets the texts' grams in a shuffle.
INDEX_SENT = 32 << 20
# Words of the texts whose terms a task remembers at a time.
REMEMBERED = 200_000
# Grams found in more texts than this are spread over several tasks.
SLICE = 1_000_000


def text_grams(text, lengths):
    """Distinct grams of the given lengths (at most ``GRAM``) that occur in the text, in linear time."""

    def of_length(longest, n):
        cut = longest if n == GRAM else F.transform(longest, lambda gram: F.substring(gram, 1, n))
        return F.array_distinct(F.filter(cut, lambda gram: F.length(gram) == n))

    def by_length(longest):
        return F.concat(*[of_length(longest, n) for n in lengths])

    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{GRAM}}}))"), F.lit(1))
    return bind(F.array_distinct(found), by_length)


def gram_index(texts, terms, slice_rows=SLICE):
    """The table (gram, term, slices): each term under that of its grams which the fewest texts hold.

    ``texts`` has a column ``text``, ``terms`` a column ``term`` of distinct terms, both in lower case.  A term with a gram that no
    text holds cannot occur and is left out.  ``slices`` grows with the number of texts that hold the gram.
    """
    gram_length = F.least(F.length("term"), F.lit(GRAM))
    lengths = sorted(row[0] for row in terms.select(gram_length).distinct().collect())
    if not lengths:
        return terms.select(F.lit("").alias("gram"), "term", F.lit(1).cast("bigint").alias("slices")).where("false"), []
    held = texts.select(F.explode(text_grams(F.col("text"), lengths)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    starts = F.sequence(F.lit(1), F.length("term") - gram_length + 1)
    grams = terms.select("term", F.explode(F.array_distinct(F.transform(starts, lambda at: F.substring("term", at, gram_length)))).alias("gram"))
    rarest = grams.join(held, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    slices = F.lit(1) + F.floor(F.col("least.n") / slice_rows)
    return rarest.where("least.n > 0").select("least.gram", "term", slices.alias("slices")), lengths


def table_matches(rows, text, terms, sent=INDEX_SENT, slice_rows=SLICE):
    """The rows, once for each distinct term of the table that occurs in their text as a substring, ignoring case.

    Adds the term as column ``term``, in place of one of that name.  Terms that come to at most ``sent`` bytes with their index go to
    all tasks, and each text is looked at once, where it lies.  Otherwise each gram of a text fetches the terms that are indexed
    under it, by a shuffle by gram with grams of many texts in slices, and each of them is looked for in the text.  Null and
    empty texts and terms match nothing, repeated rows match alike, and an empty table on either side gives no rows.
    """
    others = [name for name in rows.columns if name != "term"]
    known = kept(terms.select(F.lower("term").alias("term")).where("term <> ''").distinct(), "terms")
    size = known.agg(F.sum(F.octet_length("term") + 4 * GRAM + 64)).first()[0] or 0
    if size <= sent:
        found = _found_in_place([row[0] for row in known.toLocalIterator()])(F.lower(F.col(text)))
        return rows.select(*[F.col(quoted(name)) for name in others], F.explode(found).alias("term"))
    texts = rows.select(F.struct(*[F.col(quoted(name)) for name in others]).alias("row"), F.lower(F.col(text)).alias("text")).where("text <> ''")
    made, lengths = gram_index(texts, known, slice_rows)
    grams = F.explode(text_grams(F.col("text"), lengths)).alias("gram")
    near = _by_shuffle(texts, grams, kept(made, "grams"))
    return near.where(F.col("text").contains(F.col("term"))).select("row.*", "term")


def _found_in_place(terms):
    """A function from a lower-case text Column to the given terms that occur in it.

    A term without white space lies in one word, so words are looked up, and a task remembers what it found in them; the
    other terms are looked for in the whole text.  A term is indexed under that of its grams which the fewest terms hold.
    """
    longest, remembered = GRAM, REMEMBERED

    def index_of(some):
        def grams(term):
            n = min(longest, len(term))
            return {term[i : i + n] for i in range(len(term) - n + 1)}

        held, under = {}, {}
        for term in some:
            for gram in grams(term):
                held[gram] = held.get(gram, 0) + 1
        for term in some:
            under.setdefault(min((held[gram], gram) for gram in grams(term))[1], []).append(term)
        return under, sorted({len(gram) for gram in under})

    whole = [len(term.split()) == 1 and not term[:1].isspace() and not term[-1:].isspace() for term in terms]
    in_words, across = (index_of([t for t, w in zip(terms, whole) if w == wanted]) for wanted in (True, False))

    def look_up(text, index):
        under, lengths = index
        grams = {text[i : i + n] for n in lengths for i in range(len(text) - n + 1)}
        return [term for gram in grams if gram in under for term in under[gram] if term in text]

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        out, known = [], {}
        for text in texts.to_pylist():
            own = set()
            for word in set((text or "").split()):
                if word not in known:
                    if len(known) >= remembered:
                        known.clear()
                    known[word] = look_up(word, in_words)
                own.update(known[word])
            if across[0] and text:
                own.update(look_up(text, across))
            out.append(list(own))
        return pa.array(out, pa.list_(pa.string()))

    return found


def _by_shuffle(texts, grams, index):
    """Texts with the terms indexed under their grams; a text travels once for the join with its terms, not with its grams."""
    numbered = kept(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    anchors = index.select("gram", "slices").distinct()
    found = numbered.select("id", grams).join(anchors, "gram")
    found = found.select("id", "gram", F.pmod(F.xxhash64("id"), "slices").alias("slice"))
    spread = index.select("gram", "term", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    return numbered.join(found.join(spread, ["gram", "slice"]).select("id", "term"), "id")
