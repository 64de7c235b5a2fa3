"""Every pattern, table and text the results must reproduce exactly.

Templates use ``{name}`` placeholders. Python code fills them with
``str.format``; Spark code with ``quarry.functions.text.template``, which
turns a template into one ``concat`` of literals and columns.
"""

# Directory and file patterns that are never inventoried.
# A pattern matches when it occurs anywhere in the absolute path; the one
# glob, "*.pyc", also matches any file or directory name ending in ".pyc".
IGNORE_PATTERNS = [
    ".git", "__pycache__", ".ipynb_checkpoints", "venv", ".venv",
    "node_modules", ".pytest_cache", ".mypy_cache", "*.pyc", ".DS_Store",
]

# Lower-cased suffix -> file type; anything else is "other".
FILE_TYPES = {
    ".py": "code", ".csv": "data", ".ipynb": "notebook", ".md": "note",
    ".txt": "note", ".json": "data", ".yaml": "data", ".yml": "data",
}

# Fixed values: (file type, suffix as written) -> dedicated profiler;
# everything else gets the generic text / binary profile.
PARSERS = {"code|.py": "python", "data|.csv": "csv", "notebook|.ipynb": "notebook",
           "note|.md": "markdown"}

# Allowed values of the report's enumerated fields.
ENUMS = {
    "status": ("success", "error"),
    "channel": ("Email", "Slack", "Teams", "API"),
    "urgency": ("Low", "Normal", "High", "Critical"),
    "requested_format": ("summary", "detailed", "list"),
    "impact": ("low", "medium", "high"),
}

# Schema of a report document (draft-07 keywords that constrain it).
_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_COUNT, _NUMBER, _FLAG = {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
_MAYBE_TEXT = {"type": ["string", "null"]}
_REQUESTER = {"type": "object", "properties": {"name": _TEXT, "email": _TEXT, "role": _TEXT, "timezone": _TEXT}}
_REQUEST = {"type": "object", "properties": {
    "original_question": _TEXT, "channel": {"type": "string", "enum": ENUMS["channel"]},
    "thread_id": _TEXT, "urgency": {"type": "string", "enum": ENUMS["urgency"]},
    "requested_at": _TEXT, "requested_format": {"type": "string", "enum": ENUMS["requested_format"]}}}
_SCOPE = {"type": "object", "properties": {
    "time_range": _TEXT, "start_date": _MAYBE_TEXT, "end_date": _MAYBE_TEXT, "workspace": _TEXT,
    "filter_type": _TEXT}}
_STATISTICS = {"type": "object", "properties": {
    "files_scanned": _COUNT, "files_matched": _COUNT, "files_processed": _COUNT, "files_indexed": _COUNT,
    "files_failed": _COUNT, "total_size_bytes": _COUNT, "total_size_mb": _NUMBER}}
_ANALYSIS = {"type": "object", "properties": {
    "summary": _TEXT, "details": {"type": "object"}, "content_preview": _TEXT, "tags": _TEXTS,
    "rag_indexed": _FLAG, "rag_id": _MAYBE_TEXT}}
_FILE = {"type": "object", "required": ["path", "name", "type", "analysis"], "properties": {
    "path": _TEXT, "name": _TEXT, "type": _TEXT, "size_bytes": _COUNT, "modified": _TEXT,
    "created": _MAYBE_TEXT, "author": _TEXT, "analysis": _ANALYSIS}}
_CHANGE = {"type": "object", "properties": {
    "type": _TEXT, "file": _TEXT, "description": _TEXT, "impact": {"type": "string", "enum": ENUMS["impact"]}}}
_WARNING = {"type": "object", "properties": {"level": _TEXT, "message": _TEXT, "affected_files": _TEXTS}}
_ACTION = {"type": "object", "required": ["action", "description", "example"],
           "properties": {"action": _TEXT, "description": _TEXT, "example": _TEXT}}
REPORT_SCHEMA = {
    "type": "object",
    "required": ["task_id", "agent_id", "timestamp", "status", "context", "results", "metadata"],
    "properties": {
        "task_id": _TEXT, "agent_id": _TEXT, "timestamp": _TEXT,
        "status": {"type": "string", "enum": ENUMS["status"]}, "message": _TEXT,
        "context": {"type": "object", "required": ["requester", "request", "scope"],
                    "properties": {"requester": _REQUESTER, "request": _REQUEST, "scope": _SCOPE}},
        "results": {"type": "object", "required": ["summary", "statistics", "breakdown_by_type", "files"],
                    "properties": {
                        "summary": _TEXT, "statistics": _STATISTICS,
                        "breakdown_by_type": {"type": "object", "additionalProperties": {
                            "type": "object", "properties": {"count": _COUNT}}},
                        "files": {"type": "array", "items": _FILE}}},
        "rag_status": {"type": "object", "properties": {
            "enabled": _FLAG, "collection_name": _TEXT, "total_documents": _COUNT, "embedding_model": _TEXT,
            "embedding_dimension": _COUNT, "vector_count": _COUNT, "index_updated": _FLAG, "searchable": _FLAG}},
        "insights": {"type": "object",
                     "required": ["highlights", "activity_summary", "notable_changes", "recommendations"],
                     "properties": {"highlights": _TEXTS, "activity_summary": _TEXT,
                                    "notable_changes": {"type": "array", "items": _CHANGE},
                                    "recommendations": _TEXTS}},
        "performance": {"type": "object", "properties": {
            "processing_time_seconds": _NUMBER, "scan_time_seconds": _NUMBER, "parse_time_seconds": _NUMBER,
            "index_time_seconds": _NUMBER, "started_at": _TEXT, "completed_at": _TEXT}},
        "errors": _TEXTS, "warnings": {"type": "array", "items": _WARNING},
        "suggested_actions": {"type": "array", "items": _ACTION},
        "metadata": {"type": "object", "required": ["agent_version", "schema_version", "reply_agent_compatible"],
                     "properties": {"agent_version": _TEXT, "schema_version": _TEXT,
                                    "reply_agent_compatible": _FLAG, "requires_user_action": _FLAG,
                                    "is_final": _FLAG}}},
}

# Per-file profile texts.
FILE_NOT_FOUND = "File not found"
FILE_DOES_NOT_EXIST = "File does not exist"
FAILED_TO_PARSE = "Failed to parse file: {error}"
PY_SUMMARY = "Python file with {parts}"
PY_CLASSES = "{n} class(es)"
PY_FUNCTIONS = "{n} function(s)"
PY_NO_DEFINITIONS = "no classes or functions"
PY_SYNTAX_SUMMARY = "Python file with syntax errors"
PY_SYNTAX_ERROR = "Syntax error: {error}"
CSV_SUMMARY = "CSV file with {rows} rows and {columns} columns"
CSV_EMPTY = "Empty CSV file"
CSV_PARSE_ERROR = "CSV file (parse error: {error})"
NB_SUMMARY = "Jupyter notebook with {total} cells ({code} code, {markdown} markdown)"
NB_CELL = "[Cell {index} - {kind}]\n{source}"
NB_PARSE_ERROR = "Jupyter notebook (parse error)"
NB_NOT_JSON = "Notebook does not appear to be JSON: {text}"
NB_UNSUPPORTED = "Unsupported nbformat version {major}"
MD_SUMMARY = "Markdown file with {words} words, {lines} lines, {headers} headers"
MD_PARSE_ERROR = "Markdown file (parse error)"
TEXT_SUMMARY = "{kind} file with {lines} lines"
BINARY_SUMMARY = "Binary {kind} file ({size} bytes)"
BINARY_PREVIEW = "[Binary content]"
DETAIL_LINE = "{key}: {value}"
ELLIPSIS = "..."

# List items of the report insights and summary.
HIGHLIGHT = {
    "code": "New code added ({name})",
    "data": "Data file updated ({name})",
    "notebook": "Analysis notebook created ({name})",
    "note": "Documentation updated ({name})",
}
RECOMMENDATION = {
    "code": "Review {name} implementation",
    "notebook": "Execute {name} to generate visualizations",
}
IMPACT = {"code": "high", "data": "medium"}
NOTABLE_CODE_LINE = "  - {name}: {summary}"
LISTING_LINE = "{name} ({kind}, {kb} KB)"

# Activity labels, first matching rule wins.
ACTIVITY_NONE = "No activity found"
ACTIVITY = [
    ("code", "Active development with code changes"),
    ("data", "Data collection and processing activity"),
    ("note", "Documentation updates"),
]
ACTIVITY_OTHER = "General workspace activity"

# Summary text.
SUMMARY_EMPTY = "No files were processed."
SUMMARY_HEAD = "Processed {n} files from workspace.\n\nFile breakdown:\n"
SUMMARY_TYPE_LINE = "  - {kind}: {n} file(s)"
SUMMARY_SIZE = "Total size: {mb} MB"
SUMMARY_CODE_HEAD = "\n\nNotable code files:\n"

# Task messages and warnings.
MSG_SUCCESS = "Successfully processed {n} files"
MSG_NO_FILES = "No files found matching criteria"
MSG_FAILED = "Task failed: {error}"
WARNING_LEVEL = "info"
WARNING_LARGE = "Found {n} large files (>10MB)"
DATES_REQUIRED = "start_date and end_date required when scan_all=False"

# Suggested actions (action, description, example), in order;
# the second and third apply only when code / notebooks are present.
ACTION_SEARCH = ("semantic_search", "Search for specific topics in the workspace",
                 "Find all code related to 'data processing'")
ACTION_DEEP_DIVE = ("deep_dive", "Get detailed analysis of specific code file",
                    "Analyze [filename].py in detail")
ACTION_NOTEBOOK = ("execute_notebook", "Run notebook to see results",
                   "Execute notebook and show outputs")
ACTION_COMPARE = ("compare", "Compare with previous time period", "Show changes from last week")

# Request-context defaults.
CONTEXT_DEFAULTS = {
    "requester": "Unknown", "requester_email": "unknown@example.com",
    "requester_role": "User", "timezone": "UTC", "original_question": "",
    "channel": "API", "thread_id": "", "urgency": "Normal",
    "requested_format": "summary",
}

# Report metadata and vector-store description.
AGENT_ID = "local-agent-001"
AGENT_VERSION = "0.1.0"
SCHEMA_VERSION = "1.0"
COLLECTION = "local_rag"

# Tags per file type, in order. A rule is None (always),
# ("name", words...) for a substring of the lower-cased file name,
# ("import", module) for a parsed import, ("column", word) for a substring
# of a lower-cased CSV column name.
TAGS = {
    "code": [("code", None), ("test", ("name", "test")),
             ("analysis", ("name", "analysis", "analyze")),
             ("pandas", ("import", "pandas")), ("numpy", ("import", "numpy"))],
    "data": [("data", None), ("sensor-data", ("name", "sensor", "temperature")),
             ("timeseries", ("column", "timestamp"))],
    "notebook": [("notebook", None), ("jupyter", None), ("analysis", ("name", "analysis")),
                 ("visualization", ("name", "visualization", "viz"))],
    "note": [("documentation", None), ("research", ("name", "research")),
             ("readme", ("name", "readme"))],
}

# Sizes and limits.
LARGE_FILE_BYTES = 10 * 1024 * 1024     # strictly larger is "large"
COMPLEXITY_LOW_LINES = 50               # fewer lines, or no definitions: low
COMPLEXITY_MEDIUM_ITEMS = 5             # fewer definitions ...
COMPLEXITY_MEDIUM_LINES = 200           # ... and fewer lines: medium
PREVIEW_CHARS = 500
RECORD_PREVIEW_CHARS = 200
PY_PREVIEW_LINES = 20
PY_MAX_IMPORTS = 10
NB_PREVIEW_CELLS = 3
NB_CELL_PREVIEW_CHARS = 200
LIST_LIMITS = {"highlights": 10, "notable_changes": 5, "recommendations": 5,
               "notable_code": 5, "file_listing": 10}
