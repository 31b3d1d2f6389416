"""Every operator as a query over the given tables: ``name → function(spark, folder)``.

Documents stand for reviews (source = model), ``labels`` for known polarities.  The documents
are invented prose, so the word lists that need real words are replaced by frequent ones of the
data; that is a parameter of the operators.
"""

from pyspark.sql import functions as F

from opinionloom.functions import labels as lab
from opinionloom.functions import language, sentences
from opinionloom.functions import text as txt
from opinionloom.functions import vocab
from opinionloom.functions.scorers import batch_scorer, batch_translator, lexicon_scorer
from opinionloom.operators import (
    ann,
    aspects,
    cleaning,
    dashboard,
    evidence,
    report,
    scoring,
    stats,
    training,
    vectors,
)
from opinionloom.operators.upsert import upsert
from opinionloom.plans import job
from opinionloom.sources import keyed, readers, writers
from opinionloom.sources.shared import cached, kept, shared_folder
from opinionloom.streaming import live

QUERIES = {}

# Words of the test data that stand in for real vocabulary.
GOOD_WORDS = ("the", "and", "with", "pour", "und", "los")
BAD_WORDS = ("that", "from", "der", "que", "les", "was")
TERMS = ("thin", "ment", "ung", "tion", "heat", "eau", "ción", "os", "able", "sch", "the and")


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark):
    """In how many parts unsplittable files are dealt out: a setting of the session, by default not at all."""
    number = spark.conf.get("spark.opinionloom.partitions", None)
    return int(number) if number else None


def documents(spark, folder, *columns):
    return readers.spread(table(spark, folder, "documents").select("doc_id", *columns), "doc_id", partitions(spark))


def reviews(spark, folder):
    return documents(spark, folder, "source", "text", "lang").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("model"),
        F.col("text").alias("original_review"), "lang",
    )


def known_labels(spark, folder):
    label = F.when(F.col("toxic") == 1, vocab.NEGATIVE).when(F.col("quality") == 1, vocab.POSITIVE).otherwise(
        vocab.NEUTRAL
    )
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("review_id"),
        lab.stars_of_raw_label(label).alias("sentiment_score"),
        label.alias("sentiment_label"),
    )


def final(spark, folder):
    return job.final_reviews(reviews(spark, folder), with_original=False)


def scored(spark, folder):
    return job.with_known_labels(final(spark, folder), known_labels(spark, folder))


def known_texts(spark, folder):
    """The texts and labels of ``scored``, stored."""
    return kept(job.with_known_labels(job.final_texts(reviews(spark, folder)), known_labels(spark, folder)), "scored")


def word_scorer():
    return lexicon_scorer(GOOD_WORDS, BAD_WORDS)


def absa(spark, folder):
    return aspects.aspect_rows(scored(spark, folder), TERMS)


def clauses(spark, folder):
    return aspects.clause_aspects(documents(spark, folder, "text"), "text", "doc_id", word_scorer())


def model_figures(spark, folder, denominator="labelled"):
    # Read twice, for the counts and for the keywords.
    columns = "review_id", "model", "final_review", "sentiment_score", "sentiment_label"
    return stats.model_stats(cached(scored(spark, folder).select(*columns)), denominator)


# Cleaning


@query
def clean_documents(spark, folder):
    return reviews(spark, folder).select("review_id", txt.clean_text(F.col("original_review")).alias("cleaned"))


@query
def clean_pages(spark, folder):
    pages = readers.spread(table(spark, folder, "pages").select("page_id", "html"), "page_id", partitions(spark))
    return pages.select("page_id", txt.clean_text(F.col("html")).alias("cleaned"))


@query
def reject_meaningless(spark, folder):
    return cleaning.preprocess_reviews(reviews(spark, folder)).select("review_id", "model", "cleaned_review")


@query
def quality_report(spark, folder):
    prepared = cleaning.translate_reviews(cleaning.preprocess_reviews(reviews(spark, folder)))
    return cleaning.quality_report(prepared)


@query
def translate_identity(spark, folder):
    prepared = cleaning.translate_reviews(cleaning.preprocess_reviews(reviews(spark, folder)))
    return prepared.select("review_id", "translated_review", "final_review")


@query
def translate_foreign(spark, folder):
    def load_model():
        return lambda texts: [f"translated!! {text}" for text in texts]

    prepared = cleaning.preprocess_reviews(reviews(spark, folder))
    translated = cleaning.translate_reviews(prepared, batch_translator(load_model))
    return translated.select("review_id", "lang", "translated_review", "final_review")


@query
def dedupe_per_model(spark, folder):
    return final(spark, folder).select("review_id", "model", "norm_review", "final_review")


@query
def dedupe_per_lang(spark, folder):
    prepared = cleaning.translate_reviews(cleaning.preprocess_reviews(reviews(spark, folder)))
    return cleaning.mark_repeats(prepared, ["lang"]).select("review_id", "lang", "final_review")


@query
def dedupe_conversations(spark, folder):
    turns = table(spark, folder, "conversations").select(
        (F.col("conv_id") * 2**20 + F.col("turn")).alias("review_id"), F.col("role").alias("model"),
        F.col("text").alias("original_review"),
    )
    return job.final_reviews(turns, with_original=False).select("review_id", "model", "final_review")


@query
def valid_reviews(spark, folder):
    return cleaning.valid_reviews(final(spark, folder)).select("review_id", "model")


# Polarity


def raw_labels(spark, folder):
    number = F.col("event_id")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "view", F.concat((number % 5 + 1).cast("string"), F.lit(" stars")))
        .when(kind == "click", F.concat(F.lit("LABEL_"), (number % 6).cast("string")))
        .when(kind == "purchase", "Very Positive")
        .when(kind == "error", "NEGATIVE")
        .otherwise("mixed")
    )
    return table(spark, folder, "events").select("event_id", raw.alias("raw"))


@query
def label_map_stars(spark, folder):
    stars = lab.stars_of_raw_label(F.col("raw"))
    return raw_labels(spark, folder).select(
        "event_id", stars.alias("sentiment_score"), lab.label_of_stars(stars).alias("sentiment_label")
    )


@query
def label_map_display(spark, folder):
    return raw_labels(spark, folder).select("event_id", lab.display_label(F.col("raw")).alias("sentiment"))


@query
def score_lexicon(spark, folder):
    rated = scoring.score_reviews(final(spark, folder), word_scorer())
    return rated.select("review_id", "sentiment_score", "sentiment_label")


@query
def score_plugged(spark, folder):
    def load_model():
        return lambda texts: [(f"{len(text) % 5 + 1} stars", 0.5) for text in texts]

    rated = scoring.score_reviews(final(spark, folder), batch_scorer(load_model))
    return rated.select("review_id", "sentiment_score", "sentiment_label")


@query
def overall_scores(spark, folder):
    return scoring.score_overall(documents(spark, folder, "lang", "text"), "text", word_scorer()).drop("text")


@query
def overall_join(spark, folder):
    figures = table(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), "source", "n_chars")
    return scoring.attach_scores(figures, known_labels(spark, folder))


# Aspects


@query
def absa_rows(spark, folder):
    return absa(spark, folder).select("review_id", "sent_pos", "aspect_ord", "aspect", "label", "model_name", "text")


@query
def absa_sentence_labels(spark, folder):
    def stars_by_length(text):
        stars = F.concat((F.length(text) % 5 + 1).cast("string"), F.lit(" stars"))
        raw = F.when(F.length(text) % 7 == 0, "Positive").otherwise(stars)
        return F.struct(raw.alias("raw_label"), F.lit(1.0).alias("confidence"))

    rows = aspects.aspect_rows(scored(spark, folder), TERMS, scorer=stars_by_length)
    return rows.select("review_id", "sent_pos", "aspect", "label")


@query
def vocabulary_matches(spark, folder):
    phrases = [phrase for group in vocab.ASPECT_KEYWORDS.values() for phrase in group]
    return aspects.vocabulary_matches(documents(spark, folder, "text"), "text", phrases).select("doc_id", "term")


@query
def vocabulary_table_matches(spark, folder):
    words = table(spark, folder, "benchmark").select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("term"))
    return aspects.vocabulary_matches(documents(spark, folder, "text"), "text", words).select("doc_id", "term")


@query
def detect_language(spark, folder):
    texts = documents(spark, folder, "text", "lang")
    profile = language.learn_languages(texts)
    return texts.select("doc_id", "lang", profile.detector()(F.col("text")).alias("detected"))


@query
def learned_abbreviations(spark, folder):
    counts = sentences.word_counts(documents(spark, folder, "text"))
    scores = sentences.abbreviation_scores(counts).where(F.col("score") >= sentences.LEAST_SCORE)
    return scores.select("word", "n", "stopped", F.round("score", 6).alias("score"))


@query
def sentences_learned(spark, folder):
    texts = documents(spark, folder, "text")
    split = sentences.sentence_splitter(sentences.learn_abbreviations(texts))
    return texts.select("doc_id", F.posexplode(split(F.col("text"))).alias("sent_pos", "text"))


@query
def clause_split(spark, folder):
    texts = documents(spark, folder, "text")
    return texts.select("doc_id", F.posexplode(txt.split_clauses(F.col("text"))).alias("clause_pos", "clause"))


@query
def clause_aspects(spark, folder):
    return clauses(spark, folder).drop("review_text")


@query
def aspect_pivot(spark, folder):
    return aspects.aspect_pivot(clauses(spark, folder))


@query
def clause_csv(spark, folder):
    path = shared_folder(spark, "clauses") + ".csv"
    writers.write_table(clauses(spark, folder).drop("review_text"), path, "csv")
    return readers.typed(readers.read_table(spark, path), {"review_index": "bigint", "clause_pos": "int", "confidence": "double"})


@query
def clause_preview(spark, folder):
    return aspects.first_clauses(clauses(spark, folder).drop("review_text"))


@query
def insight_lines(spark, folder):
    texts = documents(spark, folder, "text")
    return aspects.insight_lines(aspects.clauses_in_place(texts, "text", "doc_id", word_scorer()))


@query
def insight_lines_gathered(spark, folder):
    return aspects.insight_lines(aspects.clauses_gathered(clauses(spark, folder)))


@query
def aspect_crosstab_top8(spark, folder):
    return dashboard.aspect_crosstab(absa(spark, folder))


@query
def rows_of_top_aspects(spark, folder):
    # Read twice, for the counts and for the rows; the sentences themselves are not asked for.
    rows = cached(absa(spark, folder).select("review_id", "sent_pos", "aspect", "label"))
    return dashboard.rows_of_top_aspects(rows).select("review_id", "sent_pos", "aspect", "label")


# Statistics


@query
def model_stats(spark, folder):
    return model_figures(spark, folder).drop("first_review")


@query
def model_stats_all_rows(spark, folder):
    return model_figures(spark, folder, "all").drop("first_review")


@query
def model_keywords(spark, folder):
    labelled = scored(spark, folder).where(F.col("sentiment_label").isNotNull())
    return stats.top_keywords(labelled, ("model", "sentiment_label")).drop("first_place")


@query
def model_keywords_sketched(spark, folder):
    labelled = scored(spark, folder).where(F.col("sentiment_label").isNotNull())
    return stats.top_keywords_sketched(labelled, ("model", "sentiment_label")).drop("first_place")


@query
def top_keywords_overall(spark, folder):
    return stats.top_keywords_overall(scored(spark, folder))


@query
def kpi_row(spark, folder):
    return dashboard.kpi_row(scored(spark, folder))


@query
def kpi_one_model(spark, folder):
    return dashboard.kpi_row(scored(spark, folder), "src0")


@query
def label_distribution(spark, folder):
    return dashboard.label_distribution(scored(spark, folder))


@query
def star_distribution(spark, folder):
    return dashboard.star_distribution(scored(spark, folder))


@query
def label_by_model(spark, folder):
    return dashboard.label_by_model(scored(spark, folder))


@query
def model_list(spark, folder):
    return dashboard.known_models(
        (table(spark, folder, "documents"), "source"), (table(spark, folder, "conversations"), "role")
    )


@query
def feedback_report(spark, folder):
    return report.feedback_report(model_figures(spark, folder)).drop("first_review")


@query
def stats_preview(spark, folder):
    return model_figures(spark, folder).orderBy("first_review").limit(10)


@query
def report_markdown(spark, folder):
    return report.markdown_full(report.feedback_report(model_figures(spark, folder)))


@query
def report_sections(spark, folder):
    return report.markdown_sections(report.feedback_report(model_figures(spark, folder)))


# Business summaries


@query
def first_records(spark, folder):
    return evidence.payload_records(evidence.first_records(absa(spark, folder)))


@query
def bi_payload(spark, folder):
    return evidence.payloads(absa(spark, folder))


@query
def aspect_shares(spark, folder):
    shares = evidence.aspect_shares(absa(spark, folder))
    return shares.withColumn("priority", evidence.priority(F.col("negative_share")))


@query
def bi_summary(spark, folder):
    summaries = evidence.business_summaries(evidence.aspect_shares(absa(spark, folder)))
    return evidence.summary_lines(evidence.parse_summaries(evidence.summary_json(summaries)))


@query
def published_summaries(spark, folder):
    path = shared_folder(spark, "summaries")
    rows = cached(absa(spark, folder))
    # Models that the second publication does not name keep what the first one said.
    job.publish_summaries(rows.where(F.col("label") == vocab.NEGATIVE), path)
    job.publish_summaries(rows.where(F.col("model_name").startswith("src1")), path)
    return evidence.summary_lines(keyed.read_keyed(spark, path))


@query
def upsert_summary(spark, folder):
    def per_model(rows, *figures):
        return rows.groupBy("model").agg(*figures)

    rated = kept(scored(spark, folder).select("review_id", "model", "lang", "sentiment_score", "sentiment_label"), "scored")
    stored = per_model(
        rated.where(F.col("sentiment_label") == vocab.NEGATIVE).withColumn("model", F.concat("model", F.lit("-"), "lang")),
        F.count("*").alias("reviews"), F.min("review_id").alias("first_review"),
    )
    news = per_model(
        rated.where(F.col("sentiment_label") == vocab.POSITIVE).withColumn("model", F.concat("model", F.lit("-"), "lang")),
        F.count("*").alias("reviews"), F.avg("sentiment_score").alias("average"),
    )
    return upsert(stored, news, ["model"])


@query
def find_summary(spark, folder):
    path = shared_folder(spark, "summaries")
    job.publish_summaries(absa(spark, folder), path)
    return evidence.summary_lines(keyed.find_keyed(spark, path, {"model": "src1"}))


# Training and vectors


@query
def training_split(spark, folder):
    rows = training.training_set(absa(spark, folder))
    return rows.select("review_id", "sent_pos", "aspect", "label", "label_id", "split")


@query
def classifier_metrics(spark, folder):
    rows = training.training_set(absa(spark, folder))
    said = lab.label_id(word_scorer()(F.col("text"))["raw_label"])
    metrics = training.classification_metrics(rows.withColumn("prediction", said))
    return metrics.select(*[F.round(c, 10).alias(c) for c in metrics.columns])


@query
def train_classifier(spark, folder):
    """Rows and predictions by split and label; how good these are is for the metrics to say."""
    rows = training.training_set(aspects.aspect_rows(known_texts(spark, folder), TERMS))
    rows = kept(rows.select("text", "aspect", "label", "label_id", "split"), "training")
    classifier, _ = training.train_classifier(rows)
    path = shared_folder(spark, "classifier")
    classifier.save(path)
    predicted = training.Classifier.load(path).predict(rows)
    return predicted.groupBy("split", "label").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("predicted_label").isin(*vocab.LABEL_IDS)).alias("predicted")
    )


@query
def embed_reviews(spark, folder):
    """The vectors in rows: every component that is not 0."""
    vectors_of = vectors.embed_reviews(scored(spark, folder))
    parts = vectors_of.select("original_index", "model", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return parts.withColumn("value", F.col("value").cast("double"))


@query
def embedded_documents(spark, folder):
    embedded = vectors.embed_reviews(scored(spark, folder))
    return embedded.withColumn("dimensions", F.size("embedding")).drop("embedding")


@query
def vector_topk(spark, folder):
    stored = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    probes = stored.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("probe"))
    return _rounded(vectors.nearest_in_group(stored, probes, "label", 10))


@query
def vector_search(spark, folder):
    asked = [[1.0] * 64, [float(i % 2) for i in range(64)], [float(i) for i in range(64)]]
    return _rounded(vectors.search_vectors(table(spark, folder, "embeddings"), asked, 10))


@query
def vector_search_lists(spark, folder):
    """The search of vector_search, by an index of lists, followed until no list can hold a neighbour."""
    asked = [[1.0] * 64, [float(i % 2) for i in range(64)], [float(i) for i in range(64)]]
    index = ann.ListIndex.build(table(spark, folder, "embeddings"), shared_folder(spark, "vector-lists"))
    return _rounded(index.search(asked, 10, exact=True))


def _rounded(found):
    return found.withColumn("similarity", F.round("similarity", 6))


@query
def upsert_vectors(spark, folder):
    stored = table(spark, folder, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("model"),
        F.col("vec_id").alias("original_index"), F.lit("stored").alias("state"),
    )
    arrived = table(spark, folder, "embeddings").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("model"),
        (F.col("vec_id") * 2).alias("original_index"), F.lit("arrived").alias("state"),
        F.size("embedding").alias("dimensions"),
    )
    return upsert(stored, arrived, ["original_index", "model"])


@query
def keyed_embeddings(spark, folder):
    path = shared_folder(spark, "vectors")
    rows = table(spark, folder, "embeddings").select("vec_id", "label", F.size("embedding").alias("dimensions"))
    keyed.upsert_keyed(rows.withColumn("round", F.lit(1)), path, ["vec_id"])
    keyed.upsert_keyed(rows.select((F.col("vec_id") + 100).alias("vec_id"), F.lit(2).alias("round")), path, ["vec_id"])
    return keyed.read_keyed(spark, path)


# Files


@query
def csv_reviews(spark, folder):
    path = shared_folder(spark, "reviews") + ".csv"
    columns = F.col("source").alias("Product"), F.col("text").alias("Review"), "lang", "doc_id"
    writers.write_table(table(spark, folder, "documents").select(*columns), path, "csv")
    return readers.load_reviews(spark, path, id_column="doc_id")


@query
def csv_numbered(spark, folder):
    path = shared_folder(spark, "reviews") + ".csv"
    columns = F.col("source").alias("Product"), F.col("text").alias("Review")
    in_order = table(spark, folder, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writers.write_table(in_order.select(*columns), path, "csv")
    return readers.load_reviews(spark, path)


@query
def csv_parallel(spark, folder):
    """The same file as of csv_numbered, by the reader that spreads a file over many tasks."""
    path = shared_folder(spark, "reviews") + ".csv"
    columns = F.col("source").alias("Product"), F.col("text").alias("Review")
    in_order = table(spark, folder, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    writers.write_table(in_order.select(*columns), path, "csv")
    return readers.load_reviews(spark, path, parallel=True)


@query
def uploaded_csv(spark, folder):
    path = shared_folder(spark, "uploaded") + ".csv"
    columns = F.col("doc_id").alias("review_id"), F.col("lang").alias("a.b"), "text"
    writers.write_table(table(spark, folder, "documents").select(*columns), path, "csv")
    uploaded = readers.load_uploaded(spark, path, "text")
    analysis = job.UploadedAnalysis(uploaded, readers.UPLOAD_TEXT, readers.UPLOAD_ID, word_scorer())
    return analysis.reviews.drop(readers.UPLOAD_ID)


@query
def run_translated(spark, folder):
    def load_model():
        return lambda texts: [f"translated!! {text}" for text in texts]

    path = shared_folder(spark, "reviews") + ".csv"
    columns = F.col("source").alias("Product"), F.col("text").alias("Review"), "lang", "doc_id"
    writers.write_table(table(spark, folder, "documents").select(*columns), path, "csv")
    loaded = readers.load_reviews(spark, path, id_column="doc_id", extra=["lang"])
    done = job.run(loaded, word_scorer(), batch_translator(load_model), lang="lang")
    return done.scored.select("review_id", "model", "translated_review", "final_review", "sentiment_label")


@query
def run_detected(spark, folder):
    """A job on a file without languages: they are detected by a profile of texts whose language is known."""

    def load_model():
        return lambda texts: [f"translated!! {text}" for text in texts]

    path = shared_folder(spark, "reviews") + ".csv"
    columns = F.col("source").alias("Product"), F.col("text").alias("Review"), "doc_id"
    writers.write_table(table(spark, folder, "documents").select(*columns), path, "csv")
    loaded = readers.load_reviews(spark, path, id_column="doc_id")
    profile = language.learn_languages(documents(spark, folder, "text", "lang"))
    done = job.run(loaded, word_scorer(), batch_translator(load_model), detector=profile.detector())
    return done.scored.select("review_id", "model", "translated_review", "final_review", "sentiment_label")


@query
def reloaded_first_records(spark, folder):
    path = shared_folder(spark, "aspects") + ".csv"
    writers.write_table(absa(spark, folder), path, "csv")
    return evidence.payload_records(evidence.first_records(readers.load_aspects(spark, path), 5))


@query
def reloaded_model_stats(spark, folder):
    path = shared_folder(spark, "scored") + ".csv"
    columns = "review_id", "model", "final_review", "sentiment_score", "sentiment_label"
    writers.write_table(scored(spark, folder).select(*columns), path, "csv")
    again, _ = readers.load_scored(spark, path, path + ".none.csv")
    return stats.model_stats(again)


@query
def plain_aspect_file(spark, folder):
    """Aspect rows of a file with the four plain columns, numbered in its order."""
    path = shared_folder(spark, "aspects") + ".csv"
    rows = table(spark, folder, "documents").select(
        F.col("doc_id"), F.concat(F.lit("text "), F.col("doc_id")).alias("text"), F.lit("price").alias("aspect"),
        F.lit(vocab.POSITIVE).alias("label"), F.col("source").alias("model_name"),
    )
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    writers.write_table(in_order, path, "csv")
    return evidence.payload_records(evidence.first_records(readers.load_aspects(spark, path), 5))


@query
def full_run(spark, folder):
    done = job.run(reviews(spark, folder), word_scorer())
    paths = done.write(shared_folder(spark, "run"))
    return spark.read.parquet(paths["per_model_summary"])


@query
def run_quality(spark, folder):
    """The counts that a run takes while it writes; as a table of one row."""
    done = job.run(reviews(spark, folder), word_scorer())
    done.write(shared_folder(spark, "run"))
    return spark.range(1).select(*[F.lit(count).cast("bigint").alias(name) for name, count in done.quality.items()])


@query
def stored_results(spark, folder):
    done = job.run(reviews(spark, folder), word_scorer())
    paths = done.write(shared_folder(spark, "run"), "csv")
    again, _ = readers.load_scored(spark, paths["sentiment_output"], f"{paths['sentiment_output']}-none.csv")
    return dashboard.label_by_model(again)


@query
def retrained_stats(spark, folder):
    """Every review with a text has a label of the new classifier; the labels are its own."""
    first = known_texts(spark, folder)
    classifier, _ = training.train_classifier(training.training_set(aspects.aspect_rows(first, TERMS)))
    rescored = classifier.score_reviews(first.drop("sentiment_score", "sentiment_label"))
    figures = stats.model_stats(kept(rescored, "rescored"), stored=True)
    whole = F.round(F.col("pct_positive") + F.col("pct_negative") + F.col("pct_neutral")).cast("int")
    return figures.select("model", "total_reviews", "valid_cleaned_reviews", whole.alias("percent"), "first_review")


# Streams


WEEKS = (range(1, 9), range(9, 17), range(17, 25), range(25, 32))


def arrive(spark, folder, drain, weeks=WEEKS):
    """Let the events of some parts of the month arrive as files, part after part, and call ``drain`` with the stream after each.

    Events without a time come with the first part.
    """
    path = shared_folder(spark, "arrivals")
    events = table(spark, folder, "events")
    day = F.coalesce(F.dayofmonth("ts"), F.lit(WEEKS[0][0]))
    stars = F.floor(F.col("value") % 5).cast("double") + 1
    for days in weeks:
        events.where(day.isin(*days)).write.mode("append").parquet(path)
        drain(
            live.read_arrivals(spark, path, events.schema)
            .withColumn("ts", F.col("ts").cast("timestamp"))
            .withColumn("sentiment_score", stars)
            .withColumn("sentiment_label", lab.label_of_stars(stars))
        )


@query
def live_kpi(spark, folder):
    path, checkpoint = shared_folder(spark, "kpi"), shared_folder(spark, "kpi-progress")
    arrive(spark, folder, lambda stream: live.drain_to_parquet(live.live_kpi(stream, ["event_type"]), path, checkpoint))
    return spark.read.parquet(path)


@query
def live_windows(spark, folder):
    """The middle of the month comes last, when its windows are over."""
    path, checkpoint = shared_folder(spark, "figures"), shared_folder(spark, "figures-progress")
    parts = [WEEKS[0], WEEKS[3], WEEKS[2], WEEKS[1]]
    arrive(spark, folder, lambda stream: live.drain_to_figures(stream, path, checkpoint, ["event_type"]), parts)
    return live.window_figures(spark, path, ["event_type"])


@query
def live_corrections(spark, folder):
    path, checkpoint = shared_folder(spark, "figures"), shared_folder(spark, "figures-progress")
    parts = [WEEKS[0], WEEKS[3], WEEKS[2], WEEKS[1]]
    arrive(spark, folder, lambda stream: live.drain_to_figures(stream, path, checkpoint, ["event_type"], window="10 days"), parts)
    return live.window_revisions(spark, path, ["event_type"]).drop("batch")


@query
def stream_dedupe(spark, folder):
    path, checkpoint = shared_folder(spark, "first"), shared_folder(spark, "first-progress")

    def drain(stream):
        first = live.first_arrivals(stream, ["user_id", "event_type"], delay="60 days")
        live.drain_to_parquet(first.select("user_id", "event_type"), path, checkpoint)

    arrive(spark, folder, drain)
    return spark.read.parquet(path)


@query
def stream_upsert(spark, folder):
    """The late half of the month comes first; the early half, from a second checkpoint, changes no stored row."""
    path = shared_folder(spark, "users")
    columns = "user_id", "event_type", "event_id", "sentiment_label"
    for weeks in (WEEKS[2:], WEEKS[:2]):
        progress = shared_folder(spark, "users-progress")

        def drain(stream, progress=progress):
            live.drain_to_keyed_table(stream.select(*columns), path, ["user_id", "event_type"], progress, "event_id")

        arrive(spark, folder, drain, weeks)
    keyed.prune_keyed(spark, path)
    return keyed.read_keyed(spark, path)
