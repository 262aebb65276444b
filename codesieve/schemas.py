"""Table schemas."""

ISSUE_STRUCT = (
    "struct<category: string, severity: string, line_start: int, line_end: int, "
    "description: string, recommendation: string>"
)

FILE_LISTING = (
    "repo_path string, file_path string, rel_path string, size_bytes long, modified_at timestamp"
)

CODE_FILES = (
    "repo_path string, file_path string, ext string, language string, size_bytes long, "
    "modified_at timestamp, content string, content_hash string"
)

ISSUE_COLUMNS = (
    "repo_path", "file_path", "rule_id", "category", "severity", "line_start", "line_end",
    "description", "recommendation", "code_snippet",
)

SCANS = (
    "scan_id string, save_id string, saved_at timestamp, ts timestamp, repo_path string, "
    "version string, status string, total_files long, languages array<string>, "
    "total_issues long, by_category map<string,long>, by_severity map<string,long>, error string"
)

SCAN_ISSUES = (
    "repo_path string, file_path string, rule_id string, category string, severity string, "
    "line_start int, line_end int, description string, recommendation string, "
    "text_key string, snippet_key string, scan_id string, save_id string, bucket int"
)

TEXTS = "text_key string, code_snippet string, text_bucket string"

#: Files of a stored scan with the hash of the rules they were scanned by.
MANIFEST = (
    "repo_path string, file_path string, folder string, size_bytes long, modified_at timestamp, "
    "content_hash string, scan_id string, save_id string, rules_key string, bucket int"
)

KNOWLEDGE = f"file_hash string, issues array<{ISSUE_STRUCT}>, ts timestamp, source string"
