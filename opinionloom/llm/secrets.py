"""Secrets in texts: fixed patterns, and tokens that tests of randomness can't tell from random ones."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Kinds in their order; spans name them by their place here.
KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGNED = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: What may be a token of its own.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Its parts, which are tokens too: between ``/`` and ``+``, and between all signs.
PARTS = (r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9]{20,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order in which they are tried: what a token must match, and the alphabet in order.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", UPPER + LOWER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Least information of a token, if random; where classes of length begin; the share of random tokens among those cleared.
LEAST_BITS, LENGTHS, RATE = 80, (20, 32, 48, 72), 0.05
#: Steps of log10 p in which tokens are counted, and their number.
STEP, STEPS = 0.01, 3000


def _pieces(text, kinds):
    """For each (kind, pattern, group) the matches in a text, as one array<struct<kind, nth, gap, size, value>>.

    ``gap`` is the number of code points between a match and the one before, ``size`` its length; value is of the group.
    """
    found = []
    for kind, pattern, group in kinds:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
        lengths = lambda x, i: F.struct(
            i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("size"), x["value"].alias("value")
        )
        kinded = F.transform(F.transform(zipped, lengths), _of_kind(kind))
        empty = F.expr("cast(array() as array<struct<kind:int,nth:int,gap:int,size:int,value:string>>)")
        found.append(F.when(text.rlike(pattern), kinded).otherwise(empty))
    return F.filter(F.concat(*found), lambda x: x["value"].isNotNull())


def _of_kind(kind):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["nth"].alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value"))


def _placed(rows, ids):
    """(ids, kind, start, end, value) of rows with ids and ``pieces``, in code points; the end is exclusive.

    A match begins where the gaps and matches before it end: one running sum, however many there are in a text.
    """
    rows = rows.select(*ids, F.explode("pieces").alias("x")).select(*ids, "x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*ids, "kind").orderBy("nth")).cast("int")
    return rows.select(*ids, "kind", (end - F.col("size")).alias("start"), end.alias("end"), "value")


BASE = [(0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0)]


def _erfc(x):
    """The complementary error function for x >= 0, with a relative error under 2e-7 (fixed coefficients)."""
    coefficients = (
        0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
    )
    t = 1 / (1 + x / 2)
    series = F.lit(0.0)
    for c in coefficients:
        series = series * t + c
    return t * F.exp(series - x * x)


def _two_sided(z):
    return F.least(F.lit(1.0), _erfc(F.abs(z) / math.sqrt(2)))


def randomness(tokens):
    """Adds ``size``, ``symbols`` (of the inferred alphabet) and ``p`` to rows with a column ``token``.

    ``p`` says how well the token goes with independent, uniform symbols of its alphabet: a chi-squared test of the
    symbol counts, a runs test above and below the middle of the alphabet, and a test of the serial
    correlation, all two-sided, combined by Fisher's method.  Without an encoding (words of one case, say) it is null.
    """
    alphabet = F.coalesce(*[F.when(F.col("token").rlike(pattern), F.lit(letters)) for pattern, letters in ENCODINGS])
    rows = tokens.withColumn("alphabet", alphabet).withColumn("symbols", F.length("alphabet")).withColumn("size", F.length("token"))
    rows = rows.withColumn("places", F.expr("transform(split(token, ''), c -> instr(alphabet, c) - 1)"))
    n, k = F.col("size").cast("double"), F.col("symbols").cast("double")
    squares = F.expr(
        "aggregate(array_distinct(split(token, '')), 0D, (s, c) -> s + power(size - length(replace(token, c, '')), 2))"
    )
    runs = F.expr("1 + size(filter(sequence(1, size - 1), i -> (2 * places[i] >= symbols) <> (2 * places[i - 1] >= symbols)))")
    high = F.expr("size(filter(places, x -> 2 * x >= symbols))").cast("double")
    serial = F.expr(
        "aggregate(sequence(1, size - 1), 0D, (s, i) -> s + (places[i] - (symbols - 1) / 2D) * (places[i - 1] - (symbols - 1) / 2D))"
    )
    rows = rows.withColumns({"chi": k / n * squares - n, "runs": runs.cast("double"), "high": high, "serial": serial})
    # The cube root of chi-squared over its degrees of freedom is about normal.
    df = k - 1
    chi = (F.cbrt(F.col("chi") / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    both = 2 * F.col("high") * (n - F.col("high"))
    spread = both * (both - n) / (n * n * (n - 1))
    run = (F.col("runs") - 1 - both / n) / F.sqrt(F.when(spread > 0, spread))
    along = F.col("serial") / ((k * k - 1) / 12 * F.sqrt(n - 1))
    # Columns in between, for the expressions below name each of them many times.
    rows = rows.withColumns({"z_chi": chi, "z_run": run, "z_along": along})
    rows = rows.withColumns({f"p_{x}": _two_sided(F.col(f"z_{x}")) for x in ("chi", "run", "along")})
    one_sided = F.pow(F.lit(2.0), 1 - n)  # no run but one
    # least skips nulls, so p_run is never null itself.
    logs = [F.log(F.greatest(p, F.lit(1e-30))) for p in (F.col("p_chi"), F.when(F.col("z_run").isNotNull(), F.col("p_run")).otherwise(one_sided), F.col("p_along"))]
    rows = rows.withColumn("half", -(logs[0] + logs[1] + logs[2]))
    p = F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2)
    rows = rows.withColumn("p", F.when(F.col("alphabet").isNotNull(), p))
    return rows.drop("alphabet", "places", "chi", "runs", "high", "serial", "half", *[f"{a}_{x}" for a in "zp" for x in ("chi", "run", "along")])


def cleared_below(tested, rate=RATE):
    """For each class of length, the p at or below which tokens are cleared as not random.

    Benjamini and Hochberg's step-up rule in each class over all tokens of the corpus, so that of the tokens cleared at
    most the share ``rate`` is expected to be random, whatever the length.  Tokens are counted by steps of log p, which
    bounds what is sorted.
    """
    step = F.least(F.lit(STEPS), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) / STEP))
    counts = tested.groupBy("class", step.alias("step")).agg(F.count("*").alias("n"), F.max("p").alias("p"))
    order = Window.partitionBy("class")
    counts = counts.withColumn("upto", F.sum("n").over(order.orderBy(F.desc("step")))).withColumn("all", F.sum("n").over(order))
    found = counts.where(F.col("p") <= rate * F.col("upto") / F.col("all")).groupBy("class").agg(F.max("p").alias("p"))
    return {row["class"]: row["p"] for row in found.collect()}


def find_secrets(docs, text="text", key="doc_id", rate=RATE):
    """(key, base, spans) for each document: arrays of struct<start, kind, end> in code points, the end exclusive.

    ``base`` has the spans of the fixed patterns, ``spans`` these and the tokens that pass as random: tokens of 20 letters,
    digits and ``+/_-`` or more, outside of base spans, of an encoding of two kinds of characters or more, that would
    carry 80 bits or more, and that ``cleared_below`` does not clear.  Letters alone are tested where both cases occur: words of one
    case are too short to tell from random ones.  The parts of a token between its signs are tokens as well, as in a path; of tokens
    in each other that pass, the longest is a span.

    Null and empty texts have no spans, an empty table gives an empty one.  Null and repeated keys are documents of their own;
    equal tokens are tested each.  The work grows with the length of a text and the number of its matches, not faster.  Only
    expressions of Spark are used; what is shuffled are matches, tokens with their p, and the spans.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    pieces = _pieces(value, [*BASE, (KINDS.index("random"), TOKEN, 0)])
    rows = kept(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), pieces.alias("pieces")), "secrets")
    matches = _placed(rows, ["uid"])
    base = matches.where((F.col("kind") == 1) | (F.col("kind") == 2) | ((F.col("kind") == 0) & (F.length("value") >= ASSIGNED)))
    base = kept(base.select("uid", "start", "kind", "end"), "base-spans")
    tokens = kept(_tokens(matches.where(F.col("kind") == KINDS.index("random")), base), "candidates")
    number = sum((F.col("size") >= x).cast("int") for x in LENGTHS)
    tested = randomness(tokens).where("symbols is not null").withColumn("class", number)
    tested = kept(tested.where(F.col("size") * F.log2(F.col("symbols")) >= LEAST_BITS).drop("token"), "tokens")
    limit = F.coalesce(*[F.when(F.col("class") == c, F.lit(p)) for c, p in cleared_below(tested, rate).items()], F.lit(-1.0))
    # Tokens lie in each other or apart: one lies in another if any that begins before it reaches its end.
    before = Window.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = tested.where(F.col("p") > limit).select("uid", "start", "end", F.max("end").over(before).alias("reach"))
    found = found.where("reach is null or reach < end").select("uid", "start", F.lit(KINDS.index("random")).alias("kind"), "end")
    span = F.struct("start", "kind", "end")
    own = base.union(found).groupBy("uid").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < KINDS.index("random"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    joined = rows.select("uid", "key").join(own, "uid", "left")
    return joined.select(F.col("key").alias(key), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def _tokens(runs, base):
    """(uid, start, end, token): runs and the parts between their signs that overlap no base span."""
    whole = runs.select("uid", "start", "end", F.col("value").alias("token"))
    signed = runs.where(F.col("value").rlike("[+/_-]")).select("uid", F.col("start").alias("run"), _pieces(F.col("value"), [(i, x, 0) for i, x in enumerate(PARTS)]).alias("pieces"))
    parts = _placed(signed, ["uid", "run"])
    parts = parts.select("uid", (F.col("run") + F.col("start")).alias("start"), (F.col("run") + F.col("end")).alias("end"), F.col("value").alias("token"))
    tokens = whole.union(parts).distinct()
    # In the order of base starts and token ends, the base spans before a token are those that begin before it ends.
    events = tokens.select("uid", F.col("end").alias("at"), F.lit(0).alias("is_base"), "start", "end", "token")
    events = events.union(base.select("uid", F.col("start").alias("at"), F.lit(1).alias("is_base"), "start", "end", F.lit(None).cast("string").alias("token")))
    before = Window.partitionBy("uid").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(before)
    events = events.withColumn("reach", reach).where("is_base = 0 and (reach is null or reach <= start)")
    return events.select("uid", "start", "end", "token")


def written(spans):
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans, kind):
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
