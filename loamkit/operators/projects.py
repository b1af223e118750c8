"""Resolving and updating projects (OP-17, OP-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.functions.text import slug, strings_only, technologies, text_config, trimmed


def ancestors(path: str) -> F.Column:
    """All prefixes of a path that end before a slash or at its end."""
    parts = F.split(F.regexp_replace(F.col(path), "/+\\z", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def resolve_projects(requests: DataFrame, paths: DataFrame, projects: DataFrame) -> DataFrame:
    """OP-17: (request_id, project_id, via): explicit id, route id, longest registered path that
    holds cwd, or the cwd's slug if such a project exists; else nulls.

    The prefix join is an equi-join on the cwd's ancestors, longest first."""
    steps = requests.select("request_id", F.explode(ancestors("cwd")).alias("path"))
    plain = paths.select(F.regexp_replace("path", "/+\\z", "").alias("path"), F.col("project_id").alias("by_path"))
    longest = steps.join(plain, "path").groupBy("request_id").agg(F.max_by("by_path", F.struct(F.length("path"), F.col("by_path"))).alias("by_path"))
    known = projects.select(F.col("id").alias("_slug"), F.lit(True).alias("_known"))
    out = requests.join(longest, "request_id", "left").withColumn("_slug", slug(F.col("cwd"))).join(known, "_slug", "left")
    blank = lambda c: F.when(trimmed(F.col(c)) != "", F.col(c))
    ways = [("explicit", blank("explicit_id")), ("route", blank("route_id")), ("path", F.col("by_path")), ("slug", F.when(F.col("_known"), F.col("_slug")))]
    via = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in ways])
    return out.select("request_id", F.coalesce(*[c for _, c in ways]).alias("project_id"), via.alias("via"))


def ensure_projects(resolved: DataFrame, projects: DataFrame) -> DataFrame:
    """OP-17: projects with those created that requests name and that are missing."""
    new = resolved.where("project_id IS NOT NULL").select(F.col("project_id").alias("id")).distinct().join(projects.select("id"), "id", "left_anti")
    return projects.unionByName(new.withColumn("name", F.col("id")), allowMissingColumns=True)


def update_projects(projects: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """OP-18: supplied (non-null) fields replace, others stay."""
    named = patches.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = projects.join(named, "id", "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def patch_projects(projects: DataFrame, patches: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """OP-18, TX-6: (projects, report) after patches (id, technologies, description, language).

    A null field changes nothing, an empty one clears. Technologies replace ``project_type`` as a
    whole, those not in ``known`` as ``other``. The report has (id, changed, unknown, retold): the
    names of the fields supplied, what was taken for ``other``, and whether the project's texts are
    now read in another language, so that their terms are to be made anew (``term_index.retell``).
    Of several patches of a project one, the least, counts; patches of no project fall away."""
    fields = ["technologies", "description", "language"]
    one = patches.groupBy("id").agg(F.min(F.struct(*fields)).alias("p")).select("id", *[F.col(f"p.{f}").alias(f"_{f}") for f in fields])
    t = technologies(strings_only(F.col("_technologies")), known)
    out = projects.join(one.withColumn("_t", F.when(F.col("_technologies").isNotNull(), t)), "id", "left").withColumn("_was", F.col("language"))
    out = out.withColumns({"project_type": F.coalesce("_t.technologies", "project_type"), "description": F.coalesce("_description", "description"), "language": F.coalesce("_language", "language")})
    changed = F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fields]))
    retold = text_config(F.coalesce("_was", F.lit(""))) != text_config(F.coalesce("language", F.lit("")))
    report = out.join(one.select("id"), "id", "left_semi").select("id", changed.alias("changed"), F.coalesce(F.array_distinct("_t.unknown"), F.array().cast("array<string>")).alias("unknown"), retold.alias("retold"))
    return out.drop(*[f"_{f}" for f in fields], "_t", "_was"), report
