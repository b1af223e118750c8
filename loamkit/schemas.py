"""Schemas, enumerations and defaults of the knowledge model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CATEGORIES = ["business-rule", "design-decision", "architecture", "documentation", "insight", "convention", "constraint"]
SOURCES = ["condense", "mcp", "cli", "import", "manual"]
STATUSES = ["classifying", "pending", "approved", "rejected"]
MODES = ["off", "shadow", "enforce"]
LANGUAGES = ["en", "pt", "pt-BR", "pt_PT", "es"]

RULE = "struct<id:string,adjustment:int,reason:string>"

TABLES: dict[str, str] = {
    "projects": "id string, name string, root_path string, description string, project_type array<string>, language string, created_at timestamp, updated_at timestamp",
    "project_paths": "id long, project_id string, path string, created_at timestamp",
    "entries": "id long, project_id string, title string, content string, category string, source string, author string, status string, metadata string, importance_assessment_id long, created_at timestamp, updated_at timestamp",
    "chunks": "id long, entry_id long, project_id string, chunk_index int, content string, embedding array<float>, created_at timestamp",
    "tags": "id long, project_id string, name string",
    "entry_tags": "entry_id long, tag_id long",
    "entities": "id long, project_id string, name string, type string",
    "entry_entities": "entry_id long, entity_id long",
    "relations": "id long, project_id string, subject_id long, predicate string, object_id long, entry_id long, created_at timestamp",
    "entry_links": "from_entry long, to_entry long, relation string",
    "assessments": f"id long, project_id string, candidate_hash string, normalized_candidate string, model string, prompt_version string, rules_version string, status string, semantic_score int, final_score int, verdict string, reasons array<struct<criterion:string,explanation:string>>, rules array<{RULE}>, created_at timestamp, updated_at timestamp",
    "condense_runs": "session_id string, project_id string, status string, entries_created int",
}
DEFAULTS: dict[str, dict[str, object]] = {
    "projects": {"description": "", "language": "en"},
    "entries": {"content": "", "category": "insight", "source": "manual", "status": "pending", "metadata": "{}"},
    "entities": {"type": ""},
    "entry_links": {"relation": "related"},
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


@dataclass(frozen=True)
class Settings:
    """Checked settings of classification and condensing (FLT-17)."""

    mode: str = "shadow"
    threshold: int = 70
    auto_approve_threshold: int | None = 90
    dedup_score: float = 0.85
    max_transcript_chars: int = 24_000

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 0 <= self.threshold <= 100:
            raise ValueError("threshold must be 0 to 100")
        if self.auto_approve_threshold is not None and not self.threshold <= self.auto_approve_threshold <= 100:
            raise ValueError("the auto-approval threshold must be at least the threshold and at most 100")
        if not 0 <= self.dedup_score <= 1:
            raise ValueError("dedup score must be 0 to 1")
        if self.max_transcript_chars < 1000:
            raise ValueError("transcripts keep 1000 characters at least")
