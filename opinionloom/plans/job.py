"""The whole job: reviews in, scored reviews, aspects, statistics and reports out."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

from opinionloom.functions.text import normalise_review
from opinionloom.operators.aspects import aspect_pivot, aspect_rows, clause_aspects
from opinionloom.operators.cleaning import preprocess_reviews, translate_reviews, with_first, with_first_sent
from opinionloom.operators.evidence import aspect_shares, business_summaries
from opinionloom.operators.report import feedback_report, markdown_full, markdown_sections
from opinionloom.operators.scoring import score_overall, score_reviews
from opinionloom.operators.stats import model_stats
from opinionloom.operators.training import train_classifier, training_set
from opinionloom.operators.vectors import embed_reviews
from opinionloom.sources.keyed import upsert_keyed
from opinionloom.sources.readers import quoted
from opinionloom.sources.shared import cached, kept, workspace
from opinionloom.sources.writers import SMALL, write_markdown, write_results, write_table


# True for the first review of each text of a model, in the tables inside of a run.
FIRST = "_first"


def final_reviews(reviews, translator=None, keep=True, with_original=True, lang=None, detector=None, with_mark=False):
    """Clean, reject, translate and mark repeats.

    Finding repeats reads the cleaned texts twice.  Cleaning them costs far more than storing
    and reading them, so they are stored at their first use; ``keep=False`` recomputes instead.
    Without the original texts one text per review is stored and shuffled; the other columns are made
    from it afterwards.  ``lang`` names a column with the language, ``detector`` finds it; without both a
    translator sees every text.  ``with_mark`` keeps the column ``_first``, which is true for the first review of each text.
    """
    stage, text = preprocess_reviews(reviews), _text(translator)
    if translator is not None:
        stage = translate_reviews(stage, translator, lang, detector).drop("final_review")
    if not with_original:
        stage = stage.drop("original_review")
    stage = with_first(cached(stage) if keep else stage, text=text)
    final = stage.withColumns(_made(text))
    return final if with_mark else final.drop(FIRST)


def final_texts(reviews, space=None):
    """The columns ``review_id, model, final_review`` of ``final_reviews``, of which only these texts are made and none are stored.

    The reviews are read now, for their repeats, and again when the result is used.
    """
    prepared = preprocess_reviews(reviews).select("review_id", "model", "cleaned_review")
    marked = with_first_sent(prepared, (space or workspace(reviews.sparkSession)).kept, text="cleaned_review")
    return marked.select("review_id", "model", F.when(F.col(FIRST), F.col("cleaned_review")).alias("final_review"))


def _text(translator):
    """The column that the final texts are made from."""
    return "cleaned_review" if translator is None else "translated_review"


def _made(text):
    """The columns that are made from the text of a review and its mark."""
    return {
        "translated_review": F.col(text), "final_review": F.when(F.col(FIRST), F.col(text)),
        "norm_review": normalise_review(F.col(text)),
    }


def _scored_once(space, final, text, score):
    """The rows of ``score(final)``, stored at their first use without the columns that are made from the text.

    These are made again when they are read, so each text is stored once and not up to four times.
    """
    return _stored_once(score(final), text, space.cached)


def _stored_once(scored, text, store):
    made = {name: column for name, column in _made(text).items() if name != text}
    stored = store(scored.drop(*made))
    return stored.select(*[made[c].alias(c) if c in made else F.col(quoted(c)) for c in scored.columns])


def with_known_labels(reviews, known):
    """Scores from a table of known labels (``review_id, sentiment_score, sentiment_label``).

    As with a scorer, only reviews that still have a text are scored.
    """
    given = F.coalesce(F.col("final_review") != "", F.lit(False))
    return reviews.join(known, "review_id", "left").withColumns(
        {c: F.when(given, F.col(c)) for c in ("sentiment_score", "sentiment_label")}
    )


class Run:
    """Tables of one run of the job.

    What several results start from is stored at its first use; ``close`` forgets it and deletes what was
    written in between.  ``quality`` has the counts of ``cleaning.quality_report`` once ``write`` has run: they are taken
    while the scored reviews are written, without a job of their own.  It stays None if ``scored`` lacks ``_first``.

    ``afresh`` gives the rows of ``scored`` once more, for ``write``, if they need not be stored for that: what is written first is what
    the other tables are made from.
    """

    def __init__(self, scored, denominator="labelled", space=None, afresh=None):
        self.space = space or workspace(scored.sparkSession)
        self.denominator = denominator
        self.afresh = afresh
        self.marked = scored
        self.scored = scored.drop(FIRST)
        self.quality = None
        self.aspects = aspect_rows(self.scored)
        # A small table that the reports and the preview all start from.
        self.stats = self.space.cached(model_stats(self.scored, denominator))
        self.feedback = feedback_report(self.stats)

    def close(self):
        self.space.close()

    def write(self, folder, format="parquet"):
        """Write the tables and both Markdown reports; statistics in order of first appearance."""
        marked = self.afresh() if self.afresh else self.marked
        seen = Observation("quality") if FIRST in marked.columns else None
        observed = marked.observe(seen, *_quality_counts()) if seen else marked
        if self.afresh and format != "parquet":
            # Text files do not give back what was written, nulls and empty texts for example.
            observed = _stored_once(observed, _text(None), lambda rows: self.space.kept(rows, "scored", **SMALL["parquet"]))

        def derived(path):
            if self.afresh:
                scored = observed.drop(FIRST) if format != "parquet" else self.space.spark.read.parquet(path)
                self.stats = self.space.kept(model_stats(scored, self.denominator, stored=True), "stats")
                self.feedback = feedback_report(self.stats)
            in_order = [table.orderBy("first_review").drop("first_review") for table in (self.stats, self.feedback)]
            return *in_order, aspect_rows(scored) if self.afresh else self.aspects

        paths = write_results(folder, observed.drop(FIRST), derived, format)
        for name, report in (
            ("manufacturer_recommendations", markdown_full(self.feedback)),
            ("manufacturer_sections", markdown_sections(self.feedback)),
        ):
            paths[name] = f"{folder.rstrip('/')}/{name}.md"
            write_markdown(report, paths[name])
        self.quality = seen.get if seen else None
        return paths

    def preview(self, n=10):
        """The first rows of statistics and feedback, in order of first appearance."""
        return tuple(table.orderBy("first_review").limit(n) for table in (self.stats, self.feedback))


def _quality_counts():
    repeated = F.col(FIRST).isNull()
    return (
        F.count("*").alias("total_reviews"), F.count_if(F.col("cleaned_review").isNull()).alias("meaningless_reviews"),
        F.count_if(repeated).alias("repeated_reviews"),
    )


def run(reviews, scorer=None, translator=None, denominator="labelled", lang=None, detector=None, space=None):
    """Run the job on loaded reviews; no Spark job starts before a result is used.

    ``lang`` and ``detector`` say which texts a ``translator`` sees, see ``final_reviews``.  The scored reviews feed
    several results, so they are stored once, in the workspace ``space`` (by default the application's).
    """
    space = space or workspace(reviews.sparkSession)

    def score(rows):
        return score_reviews(rows, scorer)

    def afresh():
        return score(with_first_sent(preprocess_reviews(reviews), space.kept, text=_text(None)).withColumns(_made(_text(None))))

    # A translator is too costly to see a text twice, so its texts are stored; others are cleaned again.
    final = final_reviews(reviews, translator, translator is not None, lang=lang, detector=detector, with_mark=True)
    return Run(_scored_once(space, final, _text(translator), score), denominator, space, afresh if translator is None else None)


def run_twice(reviews, scorer=None, translator=None, denominator="labelled", lang=None, detector=None, **training):
    """Run the job, train a classifier on its aspect rows, and run again with that classifier.

    Returns the second run, the classifier and its metrics; without aspect rows the first run.
    """
    first = run(reviews, scorer, translator, denominator, lang, detector)
    if first.aspects.isEmpty():
        return first, None, None
    classifier, metrics = train_classifier(first.space.cached(training_set(first.aspects)), **training)
    unscored = first.marked.drop("sentiment_score", "sentiment_label")
    again = _scored_once(first.space, unscored, _text(translator), classifier.score_reviews)
    return Run(again, denominator, first.space), classifier, metrics


class UploadedAnalysis:
    """Verdicts on whole reviews, on their clauses, and their summary by aspect, for any table of texts."""

    def __init__(self, rows, text="text", review_id="review_id", scorer=None):
        self.reviews = score_overall(rows, text, scorer)
        self.clauses = clause_aspects(rows, text, review_id, scorer)
        self.by_aspect = aspect_pivot(self.clauses)

    def write(self, folder):
        """Write the review and clause tables as CSV; returns their paths."""
        tables = {"review_level_sentiment": self.reviews, "aspect_level_sentiment": self.clauses}
        paths = {name: f"{folder.rstrip('/')}/{name}.csv" for name in tables}
        for name, rows in tables.items():
            write_table(rows, paths[name], "csv")
        return paths


def publish_summaries(aspects, path):
    """Summarise the aspect rows of every model and upsert the summaries into the keyed table.

    An upsert reads its updates more than once, so the summaries (one row per model) are written in between.
    """
    return upsert_keyed(kept(business_summaries(aspect_shares(aspects)), "summaries"), path, ["model"])


def publish_embeddings(scored, path, embedder=None):
    """Embed the scored reviews, once, and upsert the documents into the keyed table."""
    documents = cached(embed_reviews(scored, embedder))
    version = upsert_keyed(documents, path, ["original_index", "model"])
    documents.unpersist()
    return version
