"""Feedback store: scores, summaries, joins, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of each reaction and command, and the reactions that count for and against.
POINTS = {"+1": 15, "-1": -15, "confused": -10, "heart": 10, "hooray": 10, "rocket": 10, "laugh": 5, "eyes": 5}
COMMAND_POINTS = {"helpful": 20, "not_helpful": -20}
POSITIVE, NEGATIVE = ("+1", "heart", "hooray", "rocket"), ("-1", "confused")
SEVERITIES = ("bug", "security", "warning", "suggestion", "informational")
BASELINE, LEAST_REACTIONS, EXAMPLES = 50, 3, 15


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def points() -> Column:
    """What one event adds to a score; other types and contents add nothing."""
    kind = F.col("event_type")
    return F.coalesce(F.when(kind == "command", _lookup(COMMAND_POINTS, F.col("command"))).when(kind == "reaction", _lookup(POINTS, F.col("reaction_content"))), F.lit(0))


def _score(total: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(BASELINE) + F.coalesce(total, F.lit(0)))).cast("long")


def quality(events: DataFrame, *keys: str) -> DataFrame:
    """Clamped score of each key: one partial and one final aggregation."""
    return events.groupBy(*keys).agg(_score(F.sum(points())).alias("score"))


def review_scores(reviews: DataFrame, events: DataFrame) -> DataFrame:
    """Score of every review; one without events has the baseline."""
    return reviews.join(quality(events.where("review_id IS NOT NULL").withColumnRenamed("review_id", "id"), "id"), "id", "left").select("id", "repo", F.coalesce("score", F.lit(BASELINE).cast("long")).alias("score"))


def reviews_under(files: DataFrame, reviews: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct (repo, prefix, id): reviews that touched the prefix or a path below it. prefixes: repo, prefix. The prefix is a
    LIKE pattern, as the store has it. Equal repositories make this a hash join with the pattern as what is left to test."""
    touched = files.join(reviews, files["review_id"] == reviews["id"]).select("repo", "path", "id")
    bare = F.rtrim(F.col("prefix"), F.lit("/"))
    return touched.join(prefixes, "repo").where((F.col("prefix") != "") & ((F.col("path") == bare) | F.expr("path LIKE concat(rtrim('/', prefix), '/%')"))).select("repo", "prefix", "id").distinct()


def avg_quality(files: DataFrame, reviews: DataFrame, events: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Mean of clamped scores over the distinct reviews of each prefix; a prefix without reviews has no row."""
    return reviews_under(files, reviews, prefixes).join(review_scores(reviews, events).select("id", "score"), "id").groupBy("repo", "prefix").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n_reviews"))


def _counts() -> list[Column]:
    c = F.col("reaction_content")
    return [F.count_if(c.isin(*POSITIVE)).alias("positive"), F.count_if(c.isin(*NEGATIVE)).alias("negative")]


def repo_summary(events: DataFrame) -> DataFrame:
    """Six conditional counts of each repository, and their sum."""
    reaction, inline = F.col("event_type") == "reaction", F.coalesce("is_inline", F.lit(False))
    plus, minus = F.col("reaction_content").isin(*POSITIVE), F.col("reaction_content").isin(*NEGATIVE)
    names = {
        "inline_positive": reaction & inline & plus, "inline_negative": reaction & inline & minus, "summary_positive": reaction & ~inline & plus, "summary_negative": reaction & ~inline & minus,
        "helpful_commands": F.col("command") == "helpful", "not_helpful_commands": F.col("command") == "not_helpful",
    }
    out = events.where(F.col("event_type").isin("reaction", "command")).groupBy("repo").agg(*(F.count_if(v).alias(k) for k, v in names.items()))
    return out.withColumn("total_events", sum((F.col(n) for n in names), F.lit(0).cast("long")))


def inline_reactions(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "reaction") & F.col("is_inline") & F.col("comment_id").isNotNull())


def known_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin(*SEVERITIES), low).otherwise("suggestion")


def severity_feedback(events: DataFrame, comments: DataFrame) -> DataFrame:
    """Reactions by repository and severity of the comment, severities of too few left out. Reactions are counted by comment
    before they meet the comments."""
    by_comment = inline_reactions(events).groupBy("repo", "comment_id").agg(*_counts())
    rows = by_comment.join(comments.where("coalesce(severity, '') <> ''").select("comment_id", "severity"), "comment_id")
    out = rows.groupBy("repo", known_severity(F.col("severity")).alias("severity")).agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    return out.where(f"positive + negative >= {LEAST_REACTIONS}").withColumn("net", F.col("positive") - F.col("negative"))


def model_feedback(events: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reactions by the model that made the candidates; models that none counts for are left out."""
    by_review = events.where((F.col("event_type") == "reaction") & F.col("is_inline")).groupBy("review_id").agg(*_counts())
    rows = by_review.join(reviews.where("coalesce(candidate_model, '') <> ''"), by_review["review_id"] == reviews["id"])
    out = rows.groupBy("candidate_model").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    return out.where("positive + negative > 0").withColumn("net", F.col("positive") - F.col("negative"))


def labelled_comments(events: DataFrame, comments: DataFrame) -> DataFrame:
    """repo, comment_id, severity, title, positive, negative, net of comments that reactions count for."""
    by_comment = inline_reactions(events).groupBy("repo", "comment_id").agg(*_counts()).where("positive + negative > 0")
    return by_comment.join(comments.select("repo", "comment_id", F.coalesce("severity", F.lit("suggestion")).alias("severity"), "title"), ["repo", "comment_id"]).withColumn("net", F.col("positive") - F.col("negative"))


def top_examples(labelled: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The comments of most reactions in each repository; ties by the larger net, then by id."""
    w = Window.partitionBy("repo").orderBy((F.col("positive") + F.col("negative")).desc(), F.abs("net").desc(), "comment_id")
    return labelled.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order given: what an upsert of all rows in that order leaves. An aggregation and no
    sort; a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return kept.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Stored rows with the new ones in their place: new rows win over stored ones, later ones over earlier."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, "__new", *order).drop("__new")


def comment_row(severity: Column, title: Column) -> tuple[Column, Column]:
    """Severity and title as the store keeps them: lower case, 32 code points, unknown is suggestion; titles of 256."""
    low = F.substring(F.lower(F.trim(F.coalesce(severity, F.lit("")))), 1, 32)
    return F.when(low.isin(*SEVERITIES), low).otherwise("suggestion"), clipped(title, 256)


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def fresh(cache: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Rows that are not past their time; one exactly at it still counts."""
    return cache.where(F.col("created_at") >= as_of - F.make_interval(hours=F.lit(hours)))


def first_reactions(events: DataFrame) -> DataFrame:
    """The first of equal reactions of an actor to a comment; other events as they are."""
    keys = ["comment_id", "reaction_content", "actor"]
    reactions = events.where("event_type = 'reaction'")
    first = reactions.groupBy(*keys).agg(F.min(F.struct("created_at", "event_id")).alias("m")).select(*keys, F.col("m.event_id").alias("event_id"))
    return first.unionByName(events.where("event_type <> 'reaction'").select(*keys, "event_id"))


def normal_reaction(content: Column) -> Column:
    low = F.lower(F.trim(content))
    return F.when(low.isin(*POINTS), low)


def parsed_command(body: Column) -> Column:
    """The verdict of a /feedback command in a comment, or null."""
    verb = F.lower(F.regexp_extract(body, r"(?i)/feedback\s+([A-Za-z_-]+)", 1))
    return F.when(verb.isin("helpful", "good", "yes"), "helpful").when(verb.isin("not-helpful", "not_helpful", "bad", "no"), "not_helpful")


def own_comments(comments: DataFrame, login: str | None) -> DataFrame:
    return comments if login is None else comments.where(F.col("user_login") == login)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
