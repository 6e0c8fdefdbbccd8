"""The algebra of findings: promotion, filters, dedupe, gates, labels, merging, block policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks, maps and limits.
IMPACTS, CERTAINTIES = ("critical", "high", "medium", "low", "trivial"), ("confirmed", "likely", "speculative")
SEVERITIES = ("bug", "security", "warning", "suggestion", "informational")
LEGACY_IMPACT = {"bug": "high", "security": "high", "warning": "medium", "suggestion": "low", "informational": "trivial"}
LEGACY_CATEGORY = {"bug": "correctness", "security": "security", "warning": "correctness", "suggestion": "maintainability", "informational": "maintainability"}
SECRET_RULES = ("secret", "token", "credential", "api-key", "apikey", "password", "private-key", "gitleaks", "hardcoded")
BADGE = r"!\[(?:BUG|SECURITY|WARNING|SUGGESTION|INFORMATIONAL)\]\(https://[^)]+\)"
UNVERIFIED = "[Unverified — needs human check] "
BADGE_COLORS = {"bug": "d73a4a", "security": "b60205", "warning": "fbca04", "suggestion": "0e8a16", "informational": "0366d6"}


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Place in the order, from 0; unknown values come last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), column)
    return F.when(F.coalesce(at, F.lit(0)) == 0, 9).otherwise(at - 1).cast("int")


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def severity() -> Column:
    impact, certainty = F.col("impact"), F.col("certainty")
    return (
        F.when((F.col("category") == "security") & impact.isin("critical", "high"), "security").when(impact == "critical", "bug")
        .when(impact == "high", F.when(certainty != "speculative", "bug").otherwise("warning")).when(impact == "medium", "warning").when(impact == "low", "suggestion").otherwise("informational")
    )


def gate(findings: DataFrame) -> DataFrame:
    """Drops noise; marks critical findings that nothing verified, once. Exempt findings pass as they are."""
    exempt, unsure = F.col("critic_exempt"), F.col("certainty") == "speculative"
    kept = findings.where(exempt | ~((F.col("impact") == "trivial") | (unsure & (F.col("impact") == "low"))))
    mark = ~exempt & unsure & (F.col("impact") == "critical") & ~F.startswith(F.col("body"), F.lit(UNVERIFIED))
    return kept.withColumn("body", F.when(mark, F.concat(F.lit(UNVERIFIED), "body")).otherwise(F.col("body")))


def badge(key: Column) -> Column:
    return F.concat(F.lit("!["), F.upper(key), F.lit("](https://img.shields.io/badge/"), F.upper(key), F.lit("-"), lookup(BADGE_COLORS, key), F.lit(")"))


def relabel(findings: DataFrame) -> DataFrame:
    """The first badge of a body becomes that of the final severity; a body without one gets it in front. Twice is as once."""
    at = F.regexp_instr("body", F.lit(BADGE))
    old = F.regexp_extract("body", f"({BADGE})", 1)
    swapped = F.concat(F.substring("body", F.lit(1), at - 1), badge(severity()), F.substring("body", at + F.length(old), F.length("body")))
    front = F.concat(badge(severity()), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" "), "title")).otherwise(""), F.when((F.col("body") != "") | (F.coalesce("title", F.lit("")) != ""), F.concat(F.lit("\n\n"), "body")).otherwise(""))
    return findings.withColumn("body", F.when(F.col("critic_exempt"), F.col("body")).when(at > 0, swapped).otherwise(front))


def clamp(findings: DataFrame) -> DataFrame:
    """Security findings are likely at least."""
    return findings.withColumn("certainty", F.when((F.col("certainty") == "speculative") & (F.col("category") == "security"), "likely").otherwise(F.col("certainty")))


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts by (path, idx): drop or rate anew; security and critical findings are never dropped, and those without a
    verdict stay. Exempt findings take no verdict."""
    return judged(findings.join(verdicts.select("path", "idx", *said()), ["path", "idx"], "left"))


def said() -> list[Column]:
    """What a verdict says: v, vi, vc."""
    return [F.lower(F.coalesce("verdict", F.lit("keep"))).alias("v"), F.lower("impact").alias("vi"), F.lower("certainty").alias("vc")]


def judged(rows: DataFrame) -> DataFrame:
    """Findings with what their verdict says beside them, or nulls, as apply_verdicts leaves them."""
    safe = F.col("critic_exempt") | (F.col("category") == "security") | (F.col("impact") == "critical")
    rows = rows.where(safe | (F.coalesce("v", F.lit("keep")) != "drop"))
    rate = lambda new, old, known: F.when(~F.col("critic_exempt") & F.col(new).isin(*known), F.col(new)).otherwise(F.col(old))
    return rows.withColumns({"impact": rate("vi", "impact", IMPACTS), "certainty": rate("vc", "certainty", CERTAINTIES)}).drop("v", "vi", "vc")


def from_confidence(confidence: Column) -> Column:
    """Certainty of a stated confidence; one that is no number counts as 7."""
    n = F.coalesce(confidence.try_cast("int"), F.lit(7))
    return F.when(n >= 8, "confirmed").when(n >= 7, "likely").otherwise("speculative")


def from_legacy(item: DataFrame) -> DataFrame:
    """Findings of older items (severity, confidence, line, title)."""
    old = F.lower(F.when(F.coalesce("severity", F.lit("")) == "", "suggestion").otherwise(F.col("severity")))
    title = F.trim(F.coalesce("title", F.lit("")))
    return item.withColumns({
        "impact": F.coalesce(lookup(LEGACY_IMPACT, old), F.lit("low")), "category": F.coalesce(lookup(LEGACY_CATEGORY, old), F.lit("maintainability")),
        "certainty": F.when(old == "informational", "speculative").otherwise(from_confidence(F.col("confidence"))), "title": F.when(title == "", "Issue").otherwise(title),
    })


def confident(items: DataFrame) -> DataFrame:
    """Items of confidence 5 or more on a positive line."""
    return items.where((F.coalesce(F.col("confidence").try_cast("int"), F.lit(7)) >= 5) & (F.coalesce(F.col("line").try_cast("int"), F.lit(0)) > 0))


def on_diff(tool: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """Tool findings on changed lines that warn or more, and errors elsewhere with critical_bypass."""
    rows = tool.join(diff_lines.select("path", "line", F.lit(True).alias("hit")).distinct(), ["path", "line"], "left")
    level, hit = F.upper("severity"), F.coalesce("hit", F.lit(False))
    return rows.where((hit & level.isin("WARNING", "ERROR")) | (level == "ERROR")).withColumn("critical_bypass", ~hit).drop("hit")


def is_secret_rule(rule: Column) -> Column:
    return F.lower(F.coalesce(rule, F.lit(""))).rlike("|".join(SECRET_RULES))


def promoted(tool: DataFrame) -> DataFrame:
    """Tool findings that need no model: errors and secrets, as confirmed and exempt findings."""
    rule = F.coalesce("check_id", F.lit(""))
    secret, low = is_secret_rule(rule), F.lower(rule)
    rows = tool.where((F.upper("severity") == "ERROR") | secret)
    title = F.substring(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.element_at(F.split(rule, r"\."), -1)), 1, 60)
    return rows.withColumns({
        "impact": F.when(secret, "critical").when(F.upper("severity") == "ERROR", "high").otherwise("medium"), "certainty": F.lit("confirmed"),
        "category": F.when(secret | low.rlike("injection|sqli"), "security").when(F.contains(low, F.lit("perf")), "perf").otherwise("correctness"),
        "title": title, "line": F.coalesce("line", F.lit(1)), "critic_exempt": F.lit(True),
    })


def precedence() -> list[Column]:
    return [(~F.col("critic_exempt")).alias("a"), rank(F.col("impact"), IMPACTS).alias("b"), F.col("seq").alias("c")]


def rule_dedupe(findings: DataFrame, *keys: str) -> DataFrame:
    """One finding of each (path, line): exempt before others, then the higher impact, then the earlier. An aggregation."""
    keys = keys or ("path", "line")
    rest = [c for c in findings.columns if c not in keys]
    best = findings.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*precedence())).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_issue(issues: DataFrame) -> DataFrame:
    """The first of equal (path, line, rule_id) by seq; issues without a line all stay. An aggregation, so a hot key is combined
    before it is shuffled."""
    rest = [c for c in issues.columns if c not in ("path", "line", "rule_id")]
    keyed = issues.where("line IS NOT NULL").groupBy("path", "line", "rule_id").agg(F.min_by(F.struct(*rest), "seq").alias("__first"))
    return keyed.select("path", "line", "rule_id", "__first.*").select(*issues.columns).unionByName(issues.where("line IS NULL"))


def without(extra: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of a further pass that no known one matches in path, line and category."""
    return extra.join(known.select("path", "line", "category").distinct(), ["path", "line", "category"], "left_anti")


def merged(findings: DataFrame) -> DataFrame:
    """One comment of each (path, line): one body as it is, more as a list in input order; blank bodies go."""
    body = F.trim(F.coalesce("body", F.lit("")))
    rows = findings.withColumn("body", body).where("body <> ''").groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("b"), F.bool_or(F.coalesce("post_inline", F.lit(True))).alias("post_inline"))
    listed = F.concat(F.lit("**Issues:**\n"), F.array_join(F.transform("b.body", lambda x: F.concat(F.lit("- "), x)), "\n"))
    return rows.select("path", "line", F.when(F.size("b") == 1, F.col("b.body")[0]).otherwise(listed).alias("body"), "post_inline")


BADGES = r"(?i)!\[(BUG|SECURITY|WARNING|SUGGESTION|INFORMATIONAL)\]\(https://[^)]+\)\s*([^\n]*)"
TEXT_BADGES = r"(?i)\*\*\[(BUG|SECURITY|WARNING|SUGGESTION|INFORMATIONAL)\]\*\*\s*([^\n]*)"
IMAGES = r"""(?i)<img[^>]+alt=["'](BUG|SECURITY|WARNING|SUGGESTION|INFORMATIONAL)["']"""


def is_placeholder(title: Column) -> Column:
    """Whether a title says nothing but that there are issues."""
    bare = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[\x{200b}-\x{200d}\x{feff}*_\s]", "")
    return F.regexp_replace(bare, ":+$", "").isin("", "issue", "issues")


def severity_of(body: Column) -> Column:
    """(severity, title) of a comment: the highest of its badges, their titles joined; else the first line."""
    text = F.regexp_replace(F.trim(F.coalesce(body, F.lit(""))), r"(?i)^(?:-\s*)?\*\*Issues:\*\*\s*", "")

    def pairs(pattern: str) -> tuple[Column, Column]:
        titles = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), r"^[-*]\s+", ""), r"^\*+|\*+$", ""))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lower), F.filter(titles, lambda t: ~is_placeholder(t))

    shields, shield_titles = pairs(BADGES)
    texts, text_titles = pairs(TEXT_BADGES)
    images = F.transform(F.regexp_extract_all(text, F.lit(IMAGES), F.lit(1)), F.lower)
    levels = F.when(F.size(shields) > 0, shields).when(F.size(texts) > 0, texts).otherwise(images)
    titles = F.when(F.size(shields) > 0, shield_titles).when(F.size(texts) > 0, text_titles).otherwise(F.array().cast("array<string>"))
    best = F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.array_min(F.transform(levels, lambda x: rank(x, SEVERITIES))) + 1)
    kinds = F.filter(F.array(*(F.lit(s) for s in SEVERITIES)), lambda s: F.array_contains(levels, s))
    several = F.when(F.size(kinds) > 1, F.concat(F.lit("("), F.size(levels).cast("string"), F.lit(" issue(s): "), F.array_join(kinds, ", "), F.lit(")"))).otherwise(best)
    joined = F.when(F.size(titles) > 0, F.array_join(titles, " · ")).otherwise(several)
    title = F.when(F.length(joined) > 256, F.concat(F.substring(joined, 1, 253), F.lit("..."))).otherwise(joined)
    first = F.trim(F.regexp_extract(text, r"^([^\n]*)", 1))
    plain = F.struct(F.lit("suggestion").alias("severity"), F.when(is_placeholder(first), "").otherwise(first).alias("title"))
    return F.when(F.size(levels) > 0, F.struct(best.alias("severity"), title.alias("title"))).otherwise(plain)


def block_policy(counts: DataFrame, blocking: tuple[str, ...] = ("bug", "security"), least: int = 1, by: str = "Review") -> DataFrame:
    """blocked and description of each review from its counts by severity (review_id, severity, n)."""
    of = {s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)) for s in SEVERITIES}
    rows = counts.groupBy("review_id").agg(*(v.alias(s) for s, v in of.items()))
    total, stop = sum((F.col(s) for s in SEVERITIES), F.lit(0)), sum((F.col(s) for s in blocking), F.lit(0))
    parts = F.array_compact(F.array(*(F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {s}"))) for s in SEVERITIES[:4] if s in blocking)))
    said = F.when(stop >= least, F.concat(F.lit(f"{by} found "), F.array_join(parts, ", "), F.lit(" issue(s) — merge blocked"))).when(total > 0, F.concat(F.lit(f"{by} passed ("), total.cast("string"), F.lit(" non-blocking finding(s))"))).otherwise(F.lit(f"{by} passed — no issues found"))
    return rows.select("review_id", (stop >= least).alias("blocked"), said.alias("description"))


def structured_body(item: DataFrame) -> Column:
    """Badge and title, body, fenced fix of an item."""
    key = F.lower(F.when(F.coalesce("severity", F.lit("")) == "", "suggestion").otherwise(F.col("severity")))
    key = F.when(key.isin(*SEVERITIES), key).otherwise("suggestion")
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.concat(
        badge(key), F.lit(" "), F.when(text("title") == "", "Issue").otherwise(text("title")), F.when(text("body") == "", "").otherwise(F.concat(F.lit("\n\n"), text("body"))),
        F.when(text("fix") == "", "").otherwise(F.concat(F.lit("\n\n**Suggested fix:**\n\n```\n"), text("fix"), F.lit("\n```"))),
    )


def count_badge(key: Column, n: Column) -> Column:
    """A link that shows a severity and a count, encoded for an address."""
    label = F.initcap(key)
    return F.concat(F.lit("!["), label, F.lit(" "), n.cast("string"), F.lit("](https://img.shields.io/badge/"), F.url_encode(label), F.lit("-"), n.cast("string"), F.lit("-"), lookup(BADGE_COLORS, key), F.lit("?style=flat)"))


def summary(comments: DataFrame) -> DataFrame:
    """Counts by severity and path, with lines in order: the relation behind a review's summary."""
    rows = comments.where("trim(body) <> ''").withColumn("s", severity_of(F.col("body"))).select("path", "line", "s.severity", "s.title")
    return rows.groupBy("path").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "severity", "title"))), lambda r: F.concat(r["line"].cast("string"), F.lit(":"), r["severity"])), ",").alias("rows"))
