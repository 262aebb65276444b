"""Names, thresholds and lookup tables that results depend on."""

CATEGORIES = ("bug", "security", "performance", "maintainability", "architecture")
SEVERITIES = ("error", "warning", "info")
STATUSES = ("new", "fixed", "remaining")

# Scan limits.
MAX_FILE_BYTES = 1024 * 1024
LARGE_REPO_FILES = 5000
SECRET_LINE_LIMIT = 500
MAX_FUNCTION_SPAN = 50
MAX_PARAMETERS = 5
MAX_LINE_LENGTH = 120
MIN_COMMENT_RATIO = 0.1
MAX_JSON_CHARS = 1024 * 1024
MAX_JSON_DEPTH = 10


# Reuse, batching and request limits.
CACHE_TTL_SECONDS = 3600
BATCH_FILES = 5
BATCH_TOKENS = 6000
REQUESTS_PER_MINUTE = 10
REQUESTS_PER_HOUR = 100

# Extensions each rule set reads.
ANALYZED_EXTENSIONS = {
    "python": (".py", ".pyw"),
    "javascript": (".js", ".jsx", ".ts", ".tsx", ".mjs"),
    "java": (".java",),
    "go": (".go",),
    "rust": (".rs",),
    "sql": (".sql",),
    "json": (".json",),
}

# Extension -> language, one table per profile. "inventory" names what a
# repository holds, "config" allows one extension to mean several languages, and
# "review" is the name put into review requests.
LANGUAGE_PROFILES = {
    "inventory": (
        (".py", "python"),
        (".js", "javascript"),
        (".jsx", "react"),
        (".ts", "typescript"),
        (".tsx", "react"),
        (".sql", "sql"),
        (".json", "json"),
    ),
    "config": (
        (".py", "python"),
        (".pyw", "python"),
        (".js", "javascript"),
        (".jsx", "javascript"),
        (".mjs", "javascript"),
        (".ts", "typescript"),
        (".tsx", "typescript"),
        (".java", "java"),
        (".go", "go"),
        (".json", "json"),
        (".xml", "xml"),
        (".xsd", "xml"),
        (".dtd", "xml"),
        (".sql", "sql"),
        (".bq", "bigquery"),
        (".bqsql", "bigquery"),
        (".py", "dag"),
    ),
    "review": (
        (".py", "python"),
        (".pyw", "python"),
        (".js", "javascript"),
        (".jsx", "javascript"),
        (".ts", "typescript"),
        (".tsx", "typescript"),
        (".mjs", "javascript"),
        (".sql", "sql"),
        (".json", "json"),
    ),
}

# Directories a scan never enters; language detection skips fewer.
PRUNED_DIRECTORIES = (".git", "node_modules", "__pycache__", "venv", "dist", "build")
INVENTORY_PRUNED_DIRECTORIES = (".git", "node_modules", "__pycache__", "venv")

# Default exclude globs.
DEFAULT_EXCLUDES = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/.git/**",
    "**/venv/**",
    "**/__pycache__/**",
    "**/target/**",
    "**/bin/**",
    "**/obj/**",
    "**/.vscode/**",
    "**/.idea/**",
)

# Display severity of each category.
DISPLAY_SEVERITY = {
    "security": "error",
    "bug": "error",
    "performance": "warning",
    "maintainability": "info",
    "architecture": "info",
}

# Framework -> marker file names; a trailing slash marks a directory.
FRAMEWORK_MARKERS = {
    "react": ("package.json",),
    "vue": ("package.json",),
    "angular": ("package.json", "angular.json"),
    "django": ("manage.py", "settings.py"),
    "flask": ("app.py", "wsgi.py"),
    "spring": ("pom.xml", "build.gradle"),
    "express": ("package.json",),
    "airflow": ("dags/", "airflow.cfg"),
    "astronomer": ("Dockerfile", "packages.txt"),
}

# Columns of the tabular export and the defaults for absent values.
EXPORT_COLUMNS = (
    ("Category", "category", "Unknown"),
    ("Severity", "severity", "Unknown"),
    ("File", "file_path", ""),
    ("Line Start", "line_start", ""),
    ("Line End", "line_end", ""),
    ("Description", "description", ""),
    ("Recommendation", "recommendation", ""),
)
