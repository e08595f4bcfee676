"""Checks of profiles and drafts before they are sent: issues as rows, reports as counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.functions import scalars as S

# Parts of a field's name that tell what it holds.
COMPANY, PERSON, PHONE = ("credit_code", "uscc", "uniscid"), ("id_card", "idcard", "cerno"), ("phone", "mobile")
DRAFT_COMPANY, DRAFT_PERSON = ("uscc", "uniscid", "credit"), ("idcard", "id-card", "cerno")


def _named(key: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.lower(key), p))


def _issue(severity: str, rule: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))


def field_issue(key: Column, value: Column) -> Column:
    """What is wrong with a field: struct (severity, rule), or null. The first kind that the name tells decides; null and blank
    values are empty."""
    bad = lambda valid: ~F.coalesce(valid, F.lit(False))
    empty = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "") == ""
    company, person, phone = _named(key, COMPANY), _named(key, PERSON), _named(key, PHONE)
    out = F.when(empty, _issue("warning", "empty"))
    out = out.when(company, F.when(bad(S.uscc_valid(value)), _issue("error", "organisation code")))
    out = out.when(person, F.when(bad(S.cn_id_valid(value)), _issue("error", "identity number")))
    return out.when(phone, F.when(bad(S.cn_phone(value)), _issue("warning", "phone number")))


def profile_issues(fields: DataFrame, attachments: DataFrame, files: DataFrame, most_kb: int) -> DataFrame:
    """(profile, field, severity, rule) of fields (profile, category, key, value) and attachments (profile, key, path).

    An attachment whose path isn't among ``files`` (path, size) is an error, one of over ``most_kb`` whole KB (0: any size goes) a
    warning. Paths of ``files`` are unique."""
    found = fields.withColumn("issue", field_issue(F.col("key"), F.col("value"))).where("issue is not null")
    out = found.select("profile", F.concat_ws(".", "category", "key").alias("field"), "issue.*")
    held = attachments.join(files.select("path", "size"), "path", "left")
    large = (F.call_function("div", F.col("size"), F.lit(1024)) > most_kb) if most_kb > 0 else F.lit(False)
    issue = F.when(F.col("size").isNull(), _issue("error", "no such file")).when(large, _issue("warning", "large file"))
    lost = held.withColumn("issue", issue).where("issue is not null")
    return out.unionByName(lost.select("profile", F.concat(F.lit("attachments."), "key").alias("field"), "issue.*"))


def draft_issues(args: DataFrame, missing: DataFrame) -> DataFrame:
    """(draft, field, severity, rule) of args (draft, key, value), value being null unless it is text, and of required
    fields that are missing (draft, field). An argument can fail both rules."""
    out = missing.select(F.col("draft"), "field", F.lit("error").alias("severity"), F.lit("missing").alias("rule"))
    for parts, valid, rule in ((DRAFT_COMPANY, S.uscc_valid, "organisation code"), (DRAFT_PERSON, S.cn_id_valid, "identity number")):
        bad = args.where(F.col("value").isNotNull() & _named(F.col("key"), parts) & ~F.coalesce(valid(F.col("value")), F.lit(False)))
        out = out.unionByName(bad.select("draft", F.col("key").alias("field"), F.lit("error").alias("severity"), F.lit(rule).alias("rule")))
    return out


def report(issues: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """(key, passed, checked_count, errors, warnings): what was checked, a row for each thing, and the issues found; what has only
    issues has checked nothing."""
    n = checked.groupBy(key).agg(F.count(F.lit(1)).alias("checked_count"))
    found = issues.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    both = n.join(found, key, "full").na.fill(0, ["checked_count", "errors", "warnings"])
    return both.select(key, (F.col("errors") == 0).alias("passed"), "checked_count", "errors", "warnings")
