from .columns import (
    json_pointer_escape,
    normalize_subject,
    parse_selector,
    schema_id,
    selector_accepts,
    semver_key,
    semver_valid,
    strip,
    subject_valid,
    topic_matches,
    topic_regex,
    utf16_clamp,
    violation_fingerprint,
)

__all__ = [
    "json_pointer_escape",
    "normalize_subject",
    "parse_selector",
    "schema_id",
    "selector_accepts",
    "semver_key",
    "semver_valid",
    "strip",
    "subject_valid",
    "topic_matches",
    "topic_regex",
    "utf16_clamp",
    "violation_fingerprint",
]
