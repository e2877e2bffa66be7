"""Words, tables and weights that results depend on. All of this is fixed values."""

from __future__ import annotations

SOURCE_SUFFIXES = ["c", "cc", "cpp", "h", "hpp"]
BUILD_FILES = ["Makefile", "CMakeLists.txt", "compile_commands.json"]
SKIPPED_FOLDERS = [".git", ".hg", ".svn", "__pycache__", ".mypy_cache", ".pytest_cache"]

CONTROL_KEYWORDS = ["if", "else", "for", "while", "switch", "catch", "sizeof", "return", "do"]
NOT_LABELS = ["case", "default", "public", "private", "protected"]
NOT_CALLS = [*CONTROL_KEYWORDS, "alignof", "decltype", "delete", "new", "static_assert"]
C_KEYWORDS = [
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if", "inline", "int", "long", "register", "return",
    "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
]

#: Call -> event kind, as detectors and validators read lines.
EVENT_CALLS = {
    "malloc": "alloc", "calloc": "alloc", "realloc": "alloc",
    "fopen": "open", "open": "open",
    "lock_acquire": "lock", "lock": "lock", "mutex_lock": "lock", "pthread_mutex_lock": "lock",
    "free": "free",
    "fclose": "close", "close": "close",
    "lock_release": "unlock", "unlock": "unlock", "mutex_unlock": "unlock", "pthread_mutex_unlock": "unlock",
}
#: The same as data flow reads them: other names, no casts.
FLOW_ASSIGNED = {"malloc": "alloc", "calloc": "alloc", "realloc": "alloc", "new": "alloc", "strdup": "alloc", "open": "open", "fopen": "open", "socket": "open", "accept": "open", "opendir": "open"}
FLOW_CALLED = {
    "free": "free", "delete": "free", "close": "close", "fclose": "close", "closedir": "close",
    "pthread_mutex_lock": "lock", "mutex_lock": "lock", "lock": "lock", "pthread_mutex_unlock": "unlock", "mutex_unlock": "unlock", "unlock": "unlock",
}
RELEASE_OF = {"alloc": "free", "open": "close", "lock": "unlock"}
MUST_CHECK = ["malloc", "calloc", "realloc", "fopen", "open"]
UNSAFE_CALLS = ["strcpy", "strcat", "sprintf", "vsprintf", "gets"]
SAFE_CALLS = ["strncpy", "strlcpy", "snprintf", "vsnprintf", "fgets"]
VISIBLE_CALLS = [
    "printf", "fprintf", "sprintf", "snprintf", "puts", "putchar", "scanf", "fscanf", "read", "write", "open", "close", "fopen", "fclose", "perror", "syslog", "log",
    "free", "delete", "unlock", "mutex_unlock", "pthread_mutex_unlock",
]
CLEANUP_CALLS = ["free", "fclose", "close", "lock_release", "unlock", "mutex_unlock", "pthread_mutex_unlock"]
STATUS_NAMES = ["ret", "rc", "err", "error", "status", "result"]
ERROR_LABELS = ["cleanup", "out", "error", "err", "fail", "failed"]
BOUNDS_NAMES = ["len", "size", "idx", "index", "count", "bound", "capacity", "n"]
SANITY_NAMES = ["valid", "magic", "version", "type", "sanity"]
RELEASE_HINTS = ["free", "destroy", "dispose", "cleanup", "close", "release", "unref", "decref"]
TRANSFER_HINTS = ["take", "adopt", "steal", "own", "append", "push", "insert", "add", "register", "store", "put", "set"]
BORROW_HINTS = ["get", "peek", "find", "lookup", "borrow"]

SEVERITIES = ["info", "low", "medium", "high", "critical"]
EVIDENCE = ["low", "medium", "high"]
#: Patterns by event kind.
MISSING = {"alloc": "missing free", "open": "missing close", "lock": "missing unlock"}
DOUBLE = {"free": "double free", "close": "double close", "unlock": "double unlock"}
EARLY = {"alloc": "allocation followed by early return", "open": "open followed by early return", "lock": "lock followed by early return"}
#: (pattern, severity, confidence) of smells.
SMELLS = {
    "unsafe_function": ("unsafe API usage", "high", 0.9),
    "unchecked_return_value": ("unchecked return value", "high", 0.82),
    "inconsistent_error_propagation": ("inconsistent error handling", "medium", 0.65),
    "repeated_cleanup_blocks": ("repeated manual cleanup", "medium", 0.78),
    "missing_cleanup_on_error_path": ("missing cleanup on error path", "high", 0.84),
    "unreachable_cleanup": ("unreachable cleanup", "high", 0.8),
    "repeated_null_checks": ("repeated_null_checks", "medium", 0.58),
    "repeated_bounds_checks": ("repeated_bounds_checks", "medium", 0.58),
    "repeated_status_checks": ("repeated_status_checks", "medium", 0.58),
    "duplicated_sanity_checks": ("duplicated_sanity_checks", "medium", 0.58),
}

LOW_RELEVANCE = ["test", "tests", "testing", "example", "examples", "sample", "samples", "demo", "demos", "benchmark", "benchmarks", "bench", "fuzz", "fuzzing", "fuzzer"]
VENDORED = ["third_party", "3rdparty", "external", "vendor", "vendors", "deps", "dependencies"]
GENERATED = ["generated", "autogen", "autom4te", "configure", "config.h"]
HARNESS_FOLDERS = ["sources", "srcs", "projects"]

CHECKERS = ["resource_consistency", "semantic_equivalence", "security_regression"]
VARIANTS = [
    ("Full validator", []),
    ("No resource checker", ["resource_consistency"]),
    ("No semantic checker", ["semantic_equivalence"]),
    ("No security checker", ["security_regression"]),
    ("No resource/semantic/security checkers", ["resource_consistency", "semantic_equivalence", "security_regression"]),
]

#: What names an error path, and what a return of failure holds.
PATH_TOKENS = ["error", "err", "fail", "cleanup", "out"]
FAILURE_TOKENS = ["null", "-1", "false", "err", "error"]
#: A release in a function's body, and what each ownership hint is called.
RELEASE_PRIMITIVE = r"\b(free|fclose|close|unlock|mutex_unlock|pthread_mutex_unlock)\s*\("
OWNERSHIP_EVIDENCE = {"releases": "named like a release", "transfers": "named like a hand-over", "borrows": "named like a borrower", "body": "frees or closes something itself"}

#: Categories of failed patches in reviews; stages, and words in counterexamples, that make a failure a regression.
FAILURE_CATEGORIES = [
    "apply_failure", "compile_or_test_failure", "resource_lifecycle_still_unsafe", "semantic_change", "security_regression", "overbroad_or_unrelated_patch",
    "detector_false_positive", "llm_api_or_empty_patch", "validator_infrastructure_failure", "unclear",
]
REGRESSION_MARKERS = ["double free", "double close", "double unlock", "missing cleanup", "null_checks decreased", "bounds_checks decreased"]

#: Families of refinement rules by the key that is asked for; other keys get the general rules.
RULE_FAMILIES = ["general", "resource_management", "error_handling", "validation", "security_smells"]
RULE_ALIASES = {
    "malloc_free": "resource_management", "calloc_free": "resource_management", "realloc_free": "resource_management", "fopen_fclose": "resource_management", "open_close": "resource_management",
    "lock_unlock": "resource_management", "mutex_lock_mutex_unlock": "resource_management", "goto_cleanup": "error_handling", "goto_out": "error_handling",
    "duplicate_check": "validation", "duplicate_checks": "validation", "repeated_null_checks": "validation", "repeated_bounds_checks": "validation", "repeated_status_checks": "validation",
    "duplicated_sanity_checks": "validation", "security_smell": "security_smells", "smell": "security_smells",
}

#: Kinds of nodes in a compiler's syntax tree that are functions.
FUNCTION_NODES = ["FunctionDecl", "CXXMethodDecl", "CXXConstructorDecl", "CXXDestructorDecl", "CXXConversionDecl"]

#: Forms of conditions that count as checks; which findings there are depends on them. STATUS stands for the status names.
NAME = "[A-Za-z_][A-Za-z_0-9]*"
CONDITIONS = {
    "status": rf"^(?i:(STATUS))\s*(==|!=|<|>)\s*(-?\d+|{NAME})$",
    "null": rf"^(?:!\s*({NAME})|({NAME})\s*(?:==|!=)\s*(?:NULL|nullptr|0)|(?:NULL|nullptr|0)\s*(?:==|!=)\s*({NAME}))$",
    "bounds": rf"^({NAME})\s*(<=|>=|<|>)\s*({NAME}|-?\d+)$",
    "sanity": rf"^({NAME})\s*(==|!=)\s*([^&|]+)$",
}
