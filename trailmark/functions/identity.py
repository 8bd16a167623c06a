"""Hashes, identities and literal rendering, all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(struct: Column) -> Column:
    """Compact JSON with nulls kept. Declare struct fields in sorted key order."""
    return lower_escapes(plain_json(struct))


def plain_json(struct: Column) -> Column:
    return F.to_json(struct, {"ignoreNullFields": "false"})


def lower_escapes(text: Column) -> Column:
    """JSON by Spark with its escapes in canonical form. Choose between texts inside, so that the one chosen is made once."""
    lowered = text  # control characters have lower-case hex digits; an escaped backslash before "u" is text
    for digit in "ABCDEF":
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.when(F.contains(text, F.lit("\\u00")), lowered).otherwise(text)


def canonical_json_hash(struct: Column) -> Column:
    return sha256_text(canonical_json(struct))


def metadata_hash(level: Column, subject: Column) -> Column:
    return canonical_json_hash(F.struct(level.alias("level"), subject.alias("subject")))


def token_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def token_hash(ids: Column) -> Column:
    return sha256_text(F.concat(F.lit("["), token_text(ids), F.lit("]")))


def rollout_id(manifest_hash: Column, problem_id: Column, seed: Column) -> Column:
    return F.concat(
        F.lit("rollout:"), F.substring(manifest_hash, 1, 16), F.lit(":"), problem_id,
        F.lit(":seed-"), seed.cast("string"),
    )


def checkpoint_id(rollout: Column, position: Column) -> Column:
    return F.concat(F.lit("checkpoint:"), rollout, F.lit(":token-"), position.cast("string"))


def intent_id(identity: Column) -> Column:
    return F.concat(F.lit("intent:"), identity)


def run_id(manifest_hash: Column, config_hash: Column, scope_hash: Column) -> Column:
    scope = F.struct(
        scope_hash.alias("campaign_scope_hash"),
        config_hash.alias("config_hash"),
        manifest_hash.alias("manifest_hash"),
    )
    return F.concat(F.lit("run-"), F.substring(canonical_json_hash(scope), 1, 20))


def selection_rank(seed: int, problem_id: Column, source_index: Column) -> Column:
    nul = F.char(F.lit(0))
    return sha256_text(
        F.concat(F.lit(str(seed)), nul, problem_id, nul, source_index.cast("string"))
    )


def safe_component(value: Column, max_length: int = 72) -> Column:
    dashed = F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-")
    trimmed = F.btrim(dashed, F.lit(".-"))
    return F.substring(F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("item")), 1, max_length)


def safe_name(logical_id: Column, suffix: str = ".json") -> Column:
    digest = F.substring(sha256_text(logical_id), 1, 16)
    return F.concat(safe_component(logical_id), F.lit("--"), digest, F.lit(suffix))


def render_prompt(template: str, problem: Column) -> Column:
    """Literal replacement: LaTeX braces in the text must not act as fields."""
    return F.replace(F.lit(template), F.lit("{problem}"), problem)
