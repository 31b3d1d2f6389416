"""Review embeddings and exact nearest-neighbour search by cosine similarity."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from opinionloom.functions import text as txt
from opinionloom.operators.ranking import first_n_per_group
from opinionloom.sources.shared import cached

DOCUMENT_COLUMNS = ("review_id", "model", "final_review", "sentiment_label", "sentiment_score")


def batch_embedder(load_model, batch_size=50, on_error="raise"):
    """Embedder around a batch model: a function from a text Column to an ``array<float>`` Column.

    ``load_model()`` runs once per Python worker task and returns a function from a list of
    texts to a list of vectors.  With ``on_error='skip'`` a failing batch yields NULLs, and
    ``embed_reviews`` leaves its reviews out.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error is 'raise' or 'skip'")

    def embed_batch(model, texts):
        try:
            return list(model(texts))
        except Exception:
            if on_error == "raise":
                raise
            return [None] * len(texts)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vectors = []
            for start in range(0, len(texts), batch_size):
                vectors.extend(embed_batch(model, texts.iloc[start:start + batch_size].tolist()))
            yield pd.Series(vectors, index=texts.index, dtype=object)

    return embed


# Steps of the word weights: whole numbers, so that vectors do not depend on the order of sums.
WEIGHT_STEPS = 1000


def word_buckets(text, dimensions):
    """The bucket of each word of a text: the first 32 bits of its md5 digest, modulo the dimensions."""
    words = F.array_remove(txt.words(text), "")
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int"))


def bucket_weights(rows, buckets, dimensions):
    """Weights of the buckets, rarer ones higher: the logarithm of (texts + 1) / (texts with it + 1), in whole steps.

    One number for each dimension comes to the driver.
    """
    found = rows.select(F.explode(F.array_append(F.array_distinct(buckets), F.lit(-1))).alias("bucket")).groupBy("bucket").count()
    texts = dict(tuple(row) for row in found.collect())
    share = (texts.get(-1, 0) + 1) / (np.array([texts.get(i, 0) for i in range(dimensions)]) + 1)
    return np.floor(WEIGHT_STEPS * np.log(share) + 0.5).astype(np.int64)


def weighted_vector(weights):
    """An Arrow function from the buckets of a text's words to its weighted counts, scaled to length 1."""

    @F.arrow_udf("array<float>")
    def vector(buckets: pa.Array) -> pa.Array:
        sizes = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(len(sizes)), sizes) * len(weights) + flat
        counts = np.bincount(place, minlength=len(sizes) * len(weights)).reshape(-1, len(weights)) * weights
        length = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
        scaled = (counts / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)
        return pa.FixedSizeListArray.from_arrays(pa.array(scaled.ravel()), len(weights)).cast(pa.list_(pa.float32()))

    return vector


def embed_reviews(reviews, embedder=None, dimensions=256):
    """One keyed document per review that has a text.

    Without an ``embedder`` the vector is the hashed word count, weighted by how rare the words are and scaled to length 1;
    the reviews are then read twice, to find the weights and to apply them.
    """
    given = reviews.select(*DOCUMENT_COLUMNS).where(txt.trim_space(F.col("final_review")) != "")
    if embedder is None:
        words = cached(given.withColumn("_buckets", word_buckets(F.col("final_review"), dimensions)))
        weights = bucket_weights(words, F.col("_buckets"), dimensions)
        embedded = words.withColumn("embedding", weighted_vector(weights)("_buckets"))
    else:
        embedded = given.withColumn("embedding", embedder(F.col("final_review")))
        embedded = embedded.where(F.col("embedding").isNotNull())
    return embedded.select(
        F.col("final_review").alias("review_text"),
        "embedding",
        F.coalesce("model", F.lit("Unknown")).alias("model"),
        F.coalesce("sentiment_label", F.lit("Neutral")).alias("sentiment_label"),
        F.coalesce(F.col("sentiment_score").cast("double"), F.lit(0.0)).alias("sentiment_score"),
        F.col("review_id").alias("original_index"),
    )


def _dot(a, b):
    """Inner product of two arrays as a native expression."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left, right):
    """Cosine similarity of two arrays as a native expression; NULL when one has length 0."""
    lengths = F.sqrt(_dot(left, left)) * F.sqrt(_dot(right, right))
    return F.when(lengths > 0, _dot(left, right) / lengths)


# Probes that are sent to all tasks; more of them meet the vectors in buckets.
PROBES_SENT = 10_000
BUCKETS = 64


def nearest_in_group(vectors, probes, group, k, vector_id="vec_id", sent=PROBES_SENT):
    """For the probe vector of each group, the ``k`` most similar vectors of that group.

    ``probes`` has one row per group with the columns ``group`` and ``probe``, whose length must not be 0; every vector
    is compared with one probe only.  Few probes are sent to the vectors.  Otherwise a group is met in
    ``BUCKETS`` parts, to each of which its probe goes, so that a large group does not end up in one task.
    """
    probe = F.col("probe")
    length = F.sqrt(_dot(probe, probe))
    checked = F.when(length > 0, length).otherwise(F.raise_error(F.lit("a probe needs a length above 0")))
    asked = probes.select(group, "probe", checked.alias("_length"))
    columns = vectors.select(group, vector_id, "embedding")
    if probes.count() <= sent:
        met = columns.join(F.broadcast(asked), group)
    else:
        part = F.pmod(F.xxhash64(vector_id), F.lit(BUCKETS)).alias("_part")
        parts = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)).cast("array<bigint>")))
        met = columns.select("*", part).join(parts, [group, "_part"])
    own = F.sqrt(_dot(F.col("embedding"), F.col("embedding")))
    similarity = _dot(F.col("embedding"), probe) / F.nullif(own * F.col("_length"), F.lit(0.0))
    compared = met.select(group, vector_id, similarity.alias("similarity"))
    order = [F.desc_nulls_last("similarity"), F.asc(vector_id)]
    nearest = first_n_per_group(compared, [group], order, k, spread_by=vector_id)
    # A test before the cut would compute every similarity twice; NULLs rank last anyway.
    return nearest.where(F.col("similarity").isNotNull())


# Query vectors are sent to every task, so their size is bounded.
MOST_QUERY_BYTES = 64 << 20
# Query vectors compared at a time: bounds the memory of a task.
QUERIES_AT_ONCE = 256


def search_vectors(vectors, queries, k, vector_id="vec_id"):
    """The ``k`` stored vectors most similar to each query vector.

    ``queries`` is a list of vectors given by the caller, like a search request.  Each task
    multiplies its blocks of stored vectors with the queries and keeps only the best ``k`` per
    query; those few rows are then ranked over all tasks.
    """
    asked = np.asarray(queries, dtype=np.float64)
    if asked.nbytes > MOST_QUERY_BYTES:
        raise ValueError("too many query vectors for one search; ask in parts")
    sizes = np.linalg.norm(asked, axis=1, keepdims=True)
    if not (np.isfinite(sizes) & (sizes > 0)).all():
        raise ValueError("a query vector needs a finite length above 0")
    asked = asked / sizes

    def best_of_task(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {}
        for block in blocks:
            block = block[block["embedding"].notna()]
            if block.empty:
                continue
            stored = np.stack(block["embedding"].to_numpy()).astype(np.float64)
            lengths = np.linalg.norm(stored, axis=1)
            ids = block[vector_id].to_numpy()[lengths > 0]
            stored = stored[lengths > 0] / lengths[lengths > 0, None]
            for start in range(0, len(asked), QUERIES_AT_ONCE):
                alike = stored @ asked[start:start + QUERIES_AT_ONCE].T
                for offset in range(alike.shape[1]):
                    before = best.get(start + offset, (ids[:0], alike[:0, 0]))
                    best[start + offset] = _best(
                        np.concatenate([before[0], ids]), np.concatenate([before[1], alike[:, offset]]), k
                    )
        for query, (found, similarity) in best.items():
            yield pd.DataFrame({"query_id": query, vector_id: found, "similarity": similarity})

    id_type = vectors.schema[vector_id].dataType.simpleString()
    partial = vectors.select(vector_id, "embedding").mapInPandas(
        best_of_task, f"query_id int, {vector_id} {id_type}, similarity double"
    )
    order = [F.desc("similarity"), F.asc(vector_id)]
    return first_n_per_group(partial, ["query_id"], order, k, spread_by=vector_id)


def _best(ids, similarity, k):
    """The ``k`` highest similarities, the smaller id first among equals."""
    if len(ids) > k:
        bound = np.partition(similarity, len(ids) - k)[len(ids) - k]
        ids, similarity = ids[similarity >= bound], similarity[similarity >= bound]
    first = np.lexsort((ids, -similarity))[:k]
    return ids[first], similarity[first]
