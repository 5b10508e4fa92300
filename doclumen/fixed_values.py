"""Fixed values of the documentation-coverage data model.

Everything in this module is a constant that results depend on: recognised
patterns, word lists, thresholds, labels and message texts.  The values are
stated here in one place, as plain text, and hold no logic.  Patterns are
written without dialect flags; ``functions.matching.pattern`` adds the ones
Spark's regex engine needs.
"""

# -- fixed values: path fragments that exclude a file from each kind of scan --

CLI_SKIP_FRAGMENTS = [
    "__pycache__", ".venv", "venv", "node_modules",
    ".git", ".tox", ".eggs", "build", "dist",
    "test_", "_test.py", "tests/", "conftest.py",
]
API_SKIP_FRAGMENTS = [
    "__pycache__", ".venv", "venv", "test_", "_test.py",
    "tests/", "migrations/", "node_modules",
]
CONFIG_SKIP_FRAGMENTS = [
    "__pycache__", ".venv", "venv", "test_",
    "tests/", "migrations/", "node_modules",
]
SYMBOL_SKIP_PARTS = ["__pycache__", ".venv", "venv", "tests", "migrations"]
NON_PACKAGE_DIRS = ["tests", "test", "docs", "examples"]

# -- fixed values: recognised source patterns --

ARGPARSE_SUBCOMMAND = r"""add_parser\s*\(\s*['"]([^'"]+)['"]"""
ARGPARSE_PROG = r"""ArgumentParser\s*\([^)]*prog\s*=\s*['"]([^'"]+)['"]"""
CLICK_COMMAND = r"""@(\w+)\.command\s*\("""
CLICK_NAME_ARGUMENT = r"""name\s*=\s*['"]([^'"]+)['"]"""
CLICK_FUNCTION = r"""\)\s*\n\s*(?:async\s+)?def\s+(\w+)\s*\("""
CLICK_GROUP = r"""@click\.group\s*\("""
TYPER_APP = r"""(\w+)\s*=\s*typer\.Typer\s*\("""
TYPER_COMMAND_AFTER_APP = r"""\.command\s*\(\s*(?:['"]([^'"]+)['"])?\s*\)"""
FIRE_CALL = r"""fire\.Fire\s*\(\s*(\w+)\s*\)"""
FIRE_CLASS_BEFORE_TARGET = r"""class\s+"""
FIRE_CLASS_AFTER_TARGET = r"""\s*.*?:"""
FIRE_METHOD = r"""def\s+(\w+)\s*\(self"""
FASTAPI_ROUTE_BEFORE_VERB = r"""@\w+\."""
FASTAPI_ROUTE_AFTER_VERB = r"""\s*\(\s*['"]([^'"]+)['"]"""
FLASK_ROUTE = (
    r"""@\w+\.route\s*\(\s*['"]([^'"]+)['"](?:[^)]*methods\s*=\s*\[([^\]]+)\])?"""
)
DJANGO_PATH = r"""path\s*\(\s*['"]([^'"]+)['"]"""
DJANGO_VIEW = r""",\s*(\w+\.?\w*)"""
FUNCTION_NAME = r"""def\s+(\w+)\s*\("""
ASYNC_FUNCTION_NAME = r"""(?:async\s+)?def\s+(\w+)\s*\("""
GETENV = r"""os\.getenv\s*\(\s*['"]([A-Z_][A-Z0-9_]*)['"](?:\s*,\s*([^)]+))?\)"""
ENVIRON = r"""os\.environ(?:\.get)?\s*\[\s*['"]([A-Z_][A-Z0-9_]*)['"]"""
SETTINGS_CLASS = r"""class\s+\w+\s*\([^)]*BaseSettings[^)]*\):"""
SETTINGS_FIELD_ENV = (
    r"""(\w+)\s*:\s*\w+\s*=\s*Field\s*\([^)]*env\s*=\s*['"]([^'"]+)['"]"""
)
SETTINGS_BARE_FIELD = r"""^\s{4}([A-Z_][A-Z0-9_]*)\s*:\s*(\w+)"""
SETTINGS_ASSIGNMENT = r"""^([A-Z][A-Z0-9_]*)\s*=\s*(.+)$"""
EXPORT_LIST = r"""__all__\s*=\s*\[([^\]]+)\]"""
QUOTED_WORD = r"""['"](\w+)['"]"""
PROJECT_NAME = r"""name\s*=\s*["']([^"']+)["']"""

# -- fixed values: vocabulary around the patterns --

HTTP_VERBS = ["get", "post", "put", "delete", "patch", "options", "head"]
DEFAULT_FLASK_METHOD = "GET"
ANY_METHOD = "*"
DEFAULT_CLICK_GROUP = "cli"
UNKNOWN_TYPER_COMMAND = "unknown"
NOT_SETTINGS = ["TRUE", "FALSE", "NONE"]
SETTING_VALUE_LIMIT = 50
SETTING_VALUE_KEPT = 47
SETTING_VALUE_ELLIPSIS = "..."

CLICK_LOOKAHEAD = 200
CLICK_GROUP_LOOKAHEAD = 100
TYPER_LOOKAHEAD = 100
ROUTE_LOOKAHEAD = 200
DJANGO_LOOKAHEAD = 100

# -- fixed values: categories, in report order --

CATEGORIES = [
    "CLI Commands",
    "Classes",
    "Public Functions",
    "API Endpoints",
    "Configuration",
]
DEFAULT_SYMBOL_CATEGORY = "Core Modules"
DISCOVERY_COUNTS = [
    "cli_commands",
    "classes",
    "public_functions",
    "api_endpoints",
    "config_options",
]

# -- fixed values: scoring thresholds and their labels, highest first --

MOONS = [(0.85, "🌕"), (0.70, "🌔"), (0.50, "🌓"), (0.30, "🌒")]
LOWEST_MOON = "🌑"
ASSESSMENTS = [
    (0.80, "Documentation is comprehensive"),
    (0.60, "Documentation has notable gaps"),
    (0.40, "Significant features undocumented"),
    (0.20, "Major documentation debt"),
]
LOWEST_ASSESSMENT = "Critical: Most features undocumented"
EMPTY_ASSESSMENT = "No features discovered"
EMPTY_RECOMMENDATION = "Add discoverable features to your project"
KNOW_BOOST = 1.1
KNOW_CEILING = 0.95
UNCERTAINTY_FLOOR = 0.05
RECOMMEND_BELOW = 0.70
RECOMMENDED_CATEGORIES = 5
RECOMMENDED_LABELS = 3
PREVIEW_BY_DEPTH = {1: 20, 2: 50, 3: 100}
DEFAULT_PREVIEW = 20
KEY_CLASSES = 20
IMPACT_COVERAGE = 70
IMPACT_WELL_COVERED = 0.5
IMPACT_POORLY_COVERED = 0.7
FINDING_UNKNOWNS = 3

# -- fixed values: topic vocabulary, aliases in the order they are applied --

TOPIC_ALIASES = {
    "auth": ["authentication", "auth", "login", "oauth", "jwt", "token"],
    "api": ["api", "endpoint", "route", "rest", "graphql"],
    "config": ["config", "configuration", "settings", "environment", "env"],
    "install": ["install", "installation", "setup", "getting started", "quickstart"],
    "test": ["test", "testing", "pytest", "unittest", "coverage"],
    "deploy": ["deploy", "deployment", "docker", "kubernetes", "ci/cd"],
    "database": ["database", "db", "sql", "postgres", "mysql", "migration"],
    "logging": ["logging", "log", "debug", "error", "trace"],
}
STOP_WORDS = [
    "how", "do", "i", "can", "what", "is", "the", "a", "an", "to",
    "where", "when", "why", "should", "could", "would", "does",
    "are", "in", "for", "of", "my", "your", "this", "that", "it",
]
WORD_PUNCTUATION = "?.,!"
SHORT_WORD = 2

# -- fixed values: relevance scores, in tenths, and result sizes --

COUNT_CAP = 10
HEADING_TENTHS = 5
DOC_MIN_TENTHS = 2
SECTION_MIN_TENTHS = 1
TOP_DOCS = 5
TOP_SECTIONS_PER_DOC = 3
TOP_SECTIONS = 5
SECTION_BODY_CHARS = 500
RELATED_TOPICS = 5

# -- fixed values: report texts --

SECTION_SEPARATOR = "\n\n---\n\n"
ANSWER_HEADER = "**Answering:** "
TOPIC_HEADER = "**Topic:** "
NO_QUERY_ERROR = "Please provide a topic or a question"
NO_DOCS_ERROR = "No documentation found in project"
NO_DOCS_HINT = "Ensure project has docs/, README.md, or similar"
FINDING_PREFIX = "Documentation assessment: "
