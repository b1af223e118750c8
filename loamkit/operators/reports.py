"""Counts, calibration reports and readiness gates (AGG-*, OP-14, OP-15, OP-19, OP-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.functions import rules
from loamkit.functions.text import normalised
from loamkit.operators.filters import stale
from loamkit.schemas import STATUSES


def status_counts(entries: DataFrame) -> DataFrame:
    """AGG-1: per project, total and by status, in one pass."""
    return entries.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def category_counts(entries: DataFrame) -> DataFrame:
    """AGG-2."""
    return entries.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("entries"))


def tag_list(tags: DataFrame) -> DataFrame:
    """AGG-3."""
    return tags.groupBy("project_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))


def tag_text(entry_tags: DataFrame) -> DataFrame:
    """AGG-20: an entry's tags as one text, sorted."""
    return entry_tags.groupBy("entry_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("tag_text"))


def project_listing(projects: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-4: every project with its counts, zero where there is none."""
    e = entries.groupBy("project_id").agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "pending").alias("pending"))
    c = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"))
    out = projects.select(F.col("id").alias("project_id"), "language").join(e, "project_id", "left").join(c, "project_id", "left")
    return out.na.fill(0, ["approved", "pending", "chunks"])


def dashboard_totals(projects: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-5: one row."""
    e = entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "classifying").alias("classifying"))
    p, c = projects.agg(F.count(F.lit(1)).alias("projects")), chunks.agg(F.count(F.lit(1)).alias("chunks"))
    return e.join(p).join(c)


def classifying_counts(entries: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """AGG-6: (classifying, stale) per project."""
    late = stale(F.col("status"), F.col("updated_at"), as_of, minutes)
    return entries.groupBy("project_id").agg(F.count_if(F.col("status") == "classifying").alias("classifying"), F.count_if(late).alias("stale"))


def assessments_by_status(assessments: DataFrame) -> DataFrame:
    """AGG-7."""
    return assessments.groupBy("project_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "failed")])


def entries_without_chunks(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN-8: approved entries with content that have no chunk."""
    wanted = entries.where("status = 'approved' AND content <> ''")
    return wanted.join(chunks.select(F.col("entry_id").alias("id")), "id", "left_anti")


def review_crosstab(decisions: DataFrame) -> DataFrame:
    """AGG-8 to AGG-11: per project, over decisions (status, mode, verdict, would_reject,
    would_approve, auto_approved), flags of three states."""
    shadow = (F.col("mode") == "shadow") & F.col("verdict").isNotNull()
    ok, no = F.col("status") == "approved", F.col("status") == "rejected"
    reject, approve = F.col("would_reject"), F.col("would_approve")
    counts = {
        "classified": shadow,
        "reviewed": shadow & (ok | no),
        "would_reject": shadow & reject,
        "would_keep": shadow & ~reject,
        "approved": shadow & ok,
        "approved_would_reject": shadow & ok & reject,
        "approved_would_approve": shadow & ok & approve,
        "rejected": shadow & no,
        "rejected_would_keep": shadow & no & ~reject,
        "would_approve": shadow & approve,
        "auto_approved": F.col("auto_approved"),
    }
    return decisions.groupBy("project_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def score_distribution(decisions: DataFrame) -> DataFrame:
    """AGG-12: decisions by final score in fifths; the last is closed."""
    low = (F.floor(F.least(F.col("final_score"), F.lit(99)) / 20) * 20).cast("int")
    band = F.concat_ws("-", low.cast("string"), F.when(low == 80, F.lit(100)).otherwise(low + 19).cast("string"))
    return decisions.where("final_score IS NOT NULL").groupBy("project_id", band.alias("band")).agg(F.count(F.lit(1)).alias("entries"))


def false_auto_approvals(decisions: DataFrame, threshold: int | None) -> DataFrame:
    """AGG-13: per project, shadow rejections whose eligibility can be recomputed, and how many the
    current threshold would have approved."""
    rejected = decisions.where("mode = 'shadow' AND verdict IS NOT NULL AND status = 'rejected'")
    known = F.col("final_score").isNotNull() & F.col("rules").isNotNull() & F.coalesce(F.forall("rules", lambda r: r["adjustment"].isNotNull()), F.lit(False))
    false = known & rules.eligible(F.col("final_score"), F.col("rules"), threshold)
    return rejected.groupBy("project_id").agg(F.count_if(known).alias("computable"), F.count_if(false).alias("false_approvals"))


GATES = [
    ("sample", ">= {min_sample}"),
    ("must_keep", "= 0"),
    ("false_rejects", "<= 5.0%"),
    ("reduction", ">= 30.0%"),
    ("stale", "= 0"),
    ("false_auto_approvals", "= 0 (of 10 rejections at least)"),
    ("must_reject", "= 0"),
]


def readiness_gates(metrics: DataFrame, min_sample: int = 50, auto_threshold: int | None = 90) -> DataFrame:
    """AGG-16: rows (project_id, gate, requirement, actual, passes, ready) from one row of metrics per
    project: reviewed, approved, approved_would_reject, would_reject, classified, stale,
    computable, false_approvals, must_keep_rejects, must_reject_eligible. The last two are null for
    an unreadable corpus, which never passes; a rate over nothing passes neither."""
    if min_sample < 1:
        raise ValueError("the least sample is one")
    off = F.lit(auto_threshold is None)
    passes = {
        "sample": F.col("reviewed") >= min_sample,
        "must_keep": F.col("must_keep_rejects") == 0,
        "false_rejects": (F.col("approved") > 0) & (F.try_divide(F.col("approved_would_reject"), F.col("approved")) <= 0.05),
        "reduction": F.try_divide(F.col("would_reject"), F.col("classified")) >= 0.30,
        "stale": F.col("stale") == 0,
        "false_auto_approvals": off | ((F.col("computable") >= 10) & (F.col("false_approvals") == 0)),
        "must_reject": off | (F.col("must_reject_eligible") == 0),
    }
    actual = {
        "sample": F.col("reviewed"),
        "must_keep": F.col("must_keep_rejects"),
        "false_rejects": F.try_divide(F.col("approved_would_reject"), F.col("approved")),
        "reduction": F.try_divide(F.col("would_reject"), F.col("classified")),
        "stale": F.col("stale"),
        "false_auto_approvals": F.col("false_approvals"),
        "must_reject": F.col("must_reject_eligible"),
    }
    rows = [F.struct(F.lit(g).alias("gate"), F.lit(need.format(min_sample=min_sample)).alias("requirement"), F.round(actual[g].cast("double"), 6).alias("actual"), F.coalesce(passes[g], F.lit(False)).alias("passes")) for g, need in GATES]
    listed = metrics.withColumn("gates", F.array(*rows))
    return listed.select("project_id", F.forall("gates", lambda x: x["passes"]).alias("ready"), F.explode("gates").alias("g")).select("project_id", "g.gate", "g.requirement", "g.actual", "g.passes", "ready")


def digest(entries: DataFrame, entry_tags: DataFrame | None = None, n: int = 20) -> DataFrame:
    """OP-19, TOP-3: each project's ``n`` latest approved entries, one line each."""
    newest = Window.partitionBy("project_id").orderBy(F.desc("updated_at"), "id")
    top = entries.where("status = 'approved'").select("id", "project_id", "title", "category", "updated_at").withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)
    if entry_tags is None:
        top = top.withColumn("tags", F.lit(""))
    else:
        tags = entry_tags.groupBy(F.col("entry_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("tags"))
        top = top.join(tags, "id", "left").na.fill("", ["tags"])
    line = F.concat(F.lit("- "), "title", F.lit(" ("), "category", F.lit(")"), F.when(F.col("tags") != "", F.concat(F.lit(" · tags: "), "tags")).otherwise(""))
    return top.select("project_id", "position", "id", line.alias("line"))


def rule_lines(rules_col: Column) -> Column:
    """OP-21: rules as ``id (+n) reason`` lines."""
    return F.array_join(F.transform(rules_col, lambda r: F.concat(r["id"], F.lit(" ("), F.when(r["adjustment"] >= 0, F.concat(F.lit("+"), r["adjustment"].cast("string"))).otherwise(r["adjustment"].cast("string")), F.lit(") "), r["reason"])), "\n")


def audit_view(entries: DataFrame, assessments: DataFrame) -> DataFrame:
    """OP-21: one flat row per entry (importance struct, error struct): its own metadata's value,
    else the error's, else the linked assessment's; verdict and auto_approved only from its own."""
    linked = assessments.select(F.col("id").alias("importance_assessment_id"), *[F.col(c).alias(f"a_{c}") for c in ("semantic_score", "final_score", "model", "prompt_version", "rules_version", "rules")])
    j = entries.join(linked, "importance_assessment_id", "left")
    own = F.col("importance")
    return j.select(
        "id",
        "project_id",
        F.when(own["mode"].isin("off", "shadow", "enforce"), own["mode"]).alias("mode"),
        F.when(own["verdict"].isin("important", "not_important"), own["verdict"]).alias("verdict"),
        own["auto_approved"].alias("auto_approved"),
        *[F.coalesce(own[c], F.col(f"a_{c}")).alias(c) for c in ("semantic_score", "final_score")],
        *[F.coalesce(own[c], F.col("error")[c], F.col(f"a_{c}")).alias(c) for c in ("model", "prompt_version", "rules_version")],
        F.col("error")["code"].alias("error_code"),
        rule_lines(F.coalesce(own["rules"], F.col("a_rules"))).alias("rule_lines"),
    )


def project_status(entries: DataFrame, chunks: DataFrame, decisions: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """OP-15: one row per project of nested structs."""
    c = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"))
    bare = entries_without_chunks(entries, chunks).groupBy("project_id").agg(F.count(F.lit(1)).alias("unindexed"))
    out = status_counts(entries).join(c, "project_id", "left").join(bare, "project_id", "left")
    out = out.join(classifying_counts(entries, as_of, minutes).withColumnRenamed("classifying", "in_progress"), "project_id", "left").join(review_crosstab(decisions).withColumnsRenamed({"approved": "shadow_approved", "rejected": "shadow_rejected"}), "project_id", "left")
    return out.select(
        "project_id",
        F.struct("total", *STATUSES).alias("entries"),
        F.struct(F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("unindexed", F.lit(0)).alias("unindexed")).alias("index"),
        F.struct("in_progress", "stale").alias("queue"),
        F.struct("classified", "reviewed", "would_reject", "would_keep", "would_approve", "auto_approved").alias("shadow"),
    )


def corpus_figures(fixtures: DataFrame | None) -> DataFrame | None:
    """AGG-14, AGG-15: one row (vetoed, eligible): fixtures that a rule vetoes, and those with a
    positive and no negative rule. No corpus gives no figures."""
    if fixtures is None:
        return None
    r = rules.evaluate(normalised(F.col("title")), normalised(F.col("content")), F.col("entities"))
    signs = F.exists("r.rules", lambda x: x["adjustment"] > 0) & ~F.exists("r.rules", lambda x: x["adjustment"] < 0)
    return fixtures.withColumn("r", r).agg(F.count_if("r.vetoed").alias("vetoed"), F.count_if(signs).alias("eligible"))


def importance_report(decisions: DataFrame, entries: DataFrame, as_of: Column, must_keep: DataFrame | None, must_reject: DataFrame | None, threshold: int = 70, auto_threshold: int | None = 90, min_sample: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """OP-14: (metrics, score distribution, gates) of every project; it changes no setting."""
    m = review_crosstab(decisions).join(false_auto_approvals(decisions, auto_threshold), "project_id", "left").na.fill(0, ["computable", "false_approvals"])
    m = m.join(classifying_counts(entries, as_of).drop("classifying"), "project_id", "left").na.fill(0, ["stale"])
    for name, corpus, figure in (("must_keep_rejects", must_keep, "vetoed"), ("must_reject_eligible", must_reject, "eligible")):
        found = corpus_figures(corpus)
        m = m.withColumn(name, F.lit(None).cast("long")) if found is None else m.join(F.broadcast(found.select(F.col(figure).alias(name))))
    return m, score_distribution(decisions), readiness_gates(m, min_sample, auto_threshold)
