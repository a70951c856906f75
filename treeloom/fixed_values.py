"""Tables that results must agree on, and record layouts."""

from __future__ import annotations

# Directory or file names pruned at every level of a walk.
PRUNED_NAMES = ["node_modules", ".git", "dist", "__pycache__"]

# The looser prune globs of the packing script.
PRUNED_GLOBS = ["*/node_modules/*", "*.git*"]

# File extension -> language label used in statistics.
LANGUAGE_BY_EXTENSION = {
    ".java": "java",
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c/cpp",
}

# Extensions each engine accepts.
EXTENSIONS_BY_ENGINE = {
    "generic": [".java", ".py", ".ts", ".js", ".cpp", ".h"],
    "native": [".java", ".ts", ".js", ".py", ".c"],
}

# Syntax kind -> outline class, for the generic dialect.
OUTLINE_CLASS_BY_KIND = {
    "class_declaration": "CLASS",
    "class_definition": "CLASS",
    "class_specifier": "CLASS",
    "method_declaration": "METHOD",
    "method_definition": "METHOD",
    "function_definition": "METHOD",
    "function_declaration": "METHOD",
    "interface_declaration": "INTERFACE",
}

# The same idea for the offset dialect; this table is ours.
OUTLINE_CLASS_BY_KIND_OFFSETS = {
    "ClassDeclaration": "CLASS",
    "MethodDeclaration": "METHOD",
    "Constructor": "METHOD",
    "FunctionDeclaration": "METHOD",
    "InterfaceDeclaration": "INTERFACE",
}

# Kinds that can name their parent, the naming slot, and the fallback name.
IDENTIFIER_KINDS = ["identifier", "type_identifier"]
NAME_FIELD = "name"
NO_NAME = "anonymous"

# Kind of a node that could not be read.
ERROR_KIND = "ERROR"

# Per dialect, how many extra nodes a leaf's range object adds (k) and how
# much deeper it reaches (e) when a tree is counted by walking plain objects.
LEAF_RANGE_EXTRA = {
    "generic": (3, 2),
    "java": (3, 2),
    "offsets": (1, 1),
    "named": (0, 0),
}

# Lines to add to reach 1-based lines, per dialect.
LINE_SHIFT = {"generic": 0, "java": 0, "offsets": 0, "named": 1}

# Elements of HTML that never have content.
VOID_ELEMENTS = [
    "area", "base", "br", "col", "embed", "hr", "img",
    "input", "link", "meta", "source", "track", "wbr",
]

# A dump line that opens a constructor, and a line of a `Kind: 'spelling'` dump.
CONSTRUCTOR_LINE = r"[A-Z][a-zA-Z0-9]*\("
KIND_SPELLING_LINE = r"^\s*(.+?): '(.*)'$"

# Columns of the run history and of a run record; the first is the column both
# name an engine by.
ENGINE_COLUMN = "engine"
HISTORY_DDL = (
    f"timestamp STRING, {ENGINE_COLUMN} STRING, repo STRING, language STRING, files BIGINT, loc BIGINT, "
    "nodes BIGINT, max_depth INT, parse_sec DOUBLE, total_sec DOUBLE, "
    "peak_rss_mb DOUBLE, peak_heap_mb DOUBLE"
)
RUN_DDL = (
    f"{ENGINE_COLUMN} STRING, repo STRING, timestamp STRING, files BIGINT, loc BIGINT, totalNodes BIGINT, "
    "maxDepth INT, parseTimeSec DOUBLE, totalTimeSec DOUBLE, peakRssMB DOUBLE, peakHeapMB DOUBLE, "
    "languages MAP<STRING, STRUCT<files: BIGINT, loc: BIGINT, nodes: BIGINT, maxDepth: INT, "
    "parseTimeSec: DOUBLE>>"
)
BINARY_FILE_DDL = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
