"""How languages are told and how their declarations look."""

from __future__ import annotations

#: File endings.
EXTENSIONS = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".scala": "scala",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".sql": "sql", ".md": "markdown", ".markdown": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".tf": "terraform",
}
#: Files that a corpus walk takes, and folders that it leaves out.
SOURCE_EXTENSIONS = (
    ".py .pyi .ts .tsx .js .jsx .mjs .cjs .go .rs .java .kt .cs .rb .php .swift .scala .c .h .cc .cpp .hpp .sh .bash .sql .md .yml .yaml .json .toml .tf"
).split()
EXCLUDED_DIRS = (
    ".git node_modules __pycache__ .venv venv dist build .mypy_cache .pytest_cache .ruff_cache target vendor .next .nuxt coverage .tox site-packages"
).split()
MAX_FILE_BYTES = 1_500_000
#: What the first line of a script names, in this order.
SHEBANGS = (("python", "python"), ("node", "javascript"), ("bash", "bash"), ("sh", "bash"))
#: What gives a language away in a text without a telling name.
SNIFFS = (
    ("python", r"^\s*(?:def\s+\w+\s*\(|class\s+\w+[\s(:]|from\s+[\w.]+\s+import\s|import\s+\w)"),
    ("typescript", r"^\s*(?:export\s+(?:interface|type|class|const|function)\b|interface\s+\w+\s*\{)"),
    ("javascript", r"^\s*(?:function\s+\w+\s*\(|const\s+\w+\s*=\s*(?:async\s*)?\(|module\.exports\b)"),
    ("go", r"^\s*(?:package\s+\w+|func\s+(?:\(\w)?)"),
    ("rust", r"^\s*(?:pub\s+)?(?:fn\s+\w+|struct\s+\w+|impl\s+)"),
    ("markdown", r"^#{1,6}\s+[^\s]"),
)
#: Declarations by language, the first that fits a line counts.
DECLARATIONS = {
    "typescript": [
        ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"),
        ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"),
        ("type", r"^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*="),
        ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"),
        ("const", r"^\s*export\s+(?:const|let|var)\s+(?P<name>\w+)\s*[:=]"),
        ("method", r"^\s{2,}(?:public|private|protected|static|readonly|async|get|set|\s)*\s*(?P<name>\w+)\s*\([^;]*\)\s*(?::\s*[^;{]+)?\{"),
    ],
    "go": [
        ("function", r"^func\s+(?P<name>\w+)\s*\("),
        ("method", r"^func\s+\([^)]*\)\s+(?P<name>\w+)\s*\("),
        ("type", r"^type\s+(?P<name>\w+)\s+"),
        ("const", r"^(?:const|var)\s+(?P<name>\w+)\s"),
    ],
    "rust": [
        ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)"),
        ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
        ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"),
        ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"),
        ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?P<name>[\w:<>, ]+?)\s*\{"),
    ],
    "java": [
        ("class", r"^\s*(?:public|private|protected|abstract|final|static|\s)*class\s+(?P<name>\w+)"),
        ("interface", r"^\s*(?:public|private|protected|\s)*interface\s+(?P<name>\w+)"),
        ("enum", r"^\s*(?:public|private|protected|\s)*enum\s+(?P<name>\w+)"),
        ("method", r"^\s+(?:public|private|protected|static|final|synchronized|abstract|native|\s)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{"),
    ],
    "csharp": [
        ("class", r"^\s*(?:public|private|protected|internal|abstract|sealed|static|partial|\s)*class\s+(?P<name>\w+)"),
        ("interface", r"^\s*(?:public|private|protected|internal|\s)*interface\s+(?P<name>\w+)"),
        ("record", r"^\s*(?:public|private|protected|internal|\s)*record\s+(?P<name>\w+)"),
        ("method", r"^\s+(?:public|private|protected|internal|static|async|override|virtual|sealed|\s)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^;]*\)\s*\{?"),
    ],
    "ruby": [
        ("class", r"^\s*class\s+(?P<name>[\w:]+)"),
        ("module", r"^\s*module\s+(?P<name>[\w:]+)"),
        ("method", r"^\s*def\s+(?P<name>[\w.?!=]+)"),
    ],
    "php": [
        ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(?P<name>\w+)"),
        ("interface", r"^\s*interface\s+(?P<name>\w+)"),
        ("trait", r"^\s*trait\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:public|private|protected|static|abstract|final|\s)*function\s+(?P<name>\w+)\s*\("),
    ],
    "bash": [
        ("function", r"^\s*(?:function\s+)?(?P<name>[\w.-]+)\s*\(\s*\)\s*\{"),
    ],
    "sql": [
        ("table", r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<name>[\w.\"`]+)"),
        ("view", r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?P<name>[\w.\"`]+)"),
        ("function", r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+(?P<name>[\w.\"`]+)"),
    ],
    "terraform": [
        ("resource", r"^\s*resource\s+\"(?P<name>[\w.-]+)\"\s+\"(?P<label>[\w.-]+)\""),
        ("module", r"^\s*module\s+\"(?P<name>[\w.-]+)\""),
        ("variable", r"^\s*variable\s+\"(?P<name>[\w.-]+)\""),
    ],
    "kotlin": [
        ("class", r"^\s*(?:public|private|internal|open|abstract|sealed|data|\s)*class\s+(?P<name>\w+)"),
        ("interface", r"^\s*(?:public|private|internal|\s)*interface\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:public|private|internal|suspend|override|inline|\s)*fun\s+(?:<[^>]+>\s*)?(?P<name>[\w.]+)\s*\("),
    ],
    "swift": [
        ("class", r"^\s*(?:public|private|internal|open|final|\s)*class\s+(?P<name>\w+)"),
        ("struct", r"^\s*(?:public|private|internal|\s)*struct\s+(?P<name>\w+)"),
        ("protocol", r"^\s*(?:public|private|internal|\s)*protocol\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:public|private|internal|static|override|\s)*func\s+(?P<name>\w+)"),
    ],
    "c": [
        ("function", r"^[\w][\w \t*]*\s\**(?P<name>\w+)\s*\([^;]*\)\s*\{"),
        ("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)"),
    ],
    "scala": [
        ("class", r"^\s*(?:case\s+)?class\s+(?P<name>\w+)"),
        ("object", r"^\s*(?:case\s+)?object\s+(?P<name>\w+)"),
        ("trait", r"^\s*trait\s+(?P<name>\w+)"),
        ("function", r"^\s*(?:private|protected|override|implicit|\s)*def\s+(?P<name>\w+)"),
    ],
}
DECLARATIONS["javascript"] = DECLARATIONS["typescript"]
DECLARATIONS["cpp"] = [*DECLARATIONS["c"], ("class", r"^\s*class\s+(?P<name>\w+)"), ("namespace", r"^\s*namespace\s+(?P<name>\w+)")]
#: Languages with braces, what begins a comment, words that are no names, kinds that hold others.
BRACES = frozenset("typescript javascript go rust java csharp php kotlin swift c cpp scala bash terraform".split())
COMMENTS = ("//", "#", "--", "/*", "*")
RESERVED = frozenset(
    "if else for while switch case catch try finally do return with using lock when match loop unless elif except foreach select where yield await new".split()
)
CONTAINERS = frozenset("class interface struct trait impl module object record namespace enum".split())
#: How far a body may begin after its declaration, how long it may be, how many comment lines above count, how many lines a header may have.
BODY_WITHIN, BODY_LINES, DOC_LINES, HEADER_LINES, DOC_CHARS = 8, 4000, 20, 12, 110
