"""File selection and language names.

These lists decide which rows a result holds, so they are stated as they are.
"""

# Extensions taken as code, compared case-sensitively.
CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".cpp", ".go", ".java", ".lua", ".jsx", ".tsx", ".html", ".css", ".php", ".rb", ".rs",
    ".cs", ".swift", ".kt",
)

# Directory names that are skipped at any depth.
SKIPPED_DIRS = (".git", "node_modules", "venv", "__pycache__", "dist", "build", ".idea", ".vscode")

# Language of an extension.
LANGUAGES = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".go": "Go",
    ".java": "Java",
    ".cpp": "C++",
    ".c": "C",
    ".rb": "Ruby",
    ".php": "PHP",
    ".html": "HTML",
    ".css": "CSS",
    ".rs": "Rust",
    ".swift": "Swift",
    ".kt": "Kotlin",
    ".cs": "C#",
    ".jsx": "React JSX",
    ".tsx": "React TSX",
    ".lua": "Lua",
    ".yml": "YAML",
    ".yaml": "YAML",
    ".json": "JSON",
    ".md": "Markdown",
    ".sql": "SQL",
    ".sh": "Shell",
    ".bat": "Batch",
    ".ps1": "PowerShell",
}
UNKNOWN_LANGUAGE = "Unknown"

# Sizes in bytes (or items) that decide results.
CHUNK_BYTES = 8000
CHUNK_BYTES_IF_UNSET = 1000
EMBED_BATCH = 20
EMBED_MAX_TOKENS = 8192
BYTES_PER_TOKEN = 4
EXCERPT_BYTES = 4000
EXCERPT_LINES = 100
EXCERPT_HALF = 50
EXCERPT_MARK = "...[middle section omitted]..."
TOP_FILES = {"brief": 3, "standard": 5, "comprehensive": 10}
TOP_FILES_OTHERWISE = 5
TOP_LANGUAGES = 3
ERRORS_SHOWN = 10
