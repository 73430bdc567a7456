"""Fixed values of the density protocol: tables, thresholds, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = "0.1.0"
#: Identifiers of results made here.
PROTOCOL = "stratum-stream-density-v2"
RELATION_PROTOCOL = "stratum-cross-stream-relation-v1"
GRANULAR_PROTOCOL = "stratum-granular-density-v1"
FUNCTION_PROTOCOL = "stratum-rust-spans-v1"
REPOSITORY_PROTOCOL = "stratum-repository-snapshot-v1"
COMPARISON_PROTOCOL = "stratum-repository-comparison-v1"
DETECTOR = "stratum-byte-sum-windows-64-xxh3-v1"
ANALYSIS_SCHEMA, LEDGER_SCHEMA = 2, 1
DATABASE_SCHEMA, RELATION_SCHEMA, GRANULAR_SCHEMA, REPOSITORY_SCHEMA, COMPARISON_SCHEMA, CACHE_SCHEMA = 1, 1, 1, 1, 1, 1

#: Languages in canonical order with their file extensions (case matters).
LANGUAGES = [
    ("Rust", ["rs"]),
    ("C", ["c"]),
    ("C Header", ["h"]),
    ("C++", ["cc", "cpp", "cxx"]),
    ("C++ Header", ["hh", "hpp", "hxx"]),
    ("Assembly", ["S", "s", "asm"]),
    ("Python", ["py"]),
    ("Go", ["go"]),
    ("JavaScript", ["js", "mjs", "cjs"]),
    ("JSX", ["jsx"]),
    ("TypeScript", ["ts", "mts", "cts"]),
    ("TSX", ["tsx"]),
    ("Java", ["java"]),
    ("Kotlin", ["kt", "kts"]),
    ("Swift", ["swift"]),
    ("Objective-C", ["m"]),
    ("Objective-C++", ["mm"]),
    ("C#", ["cs"]),
    ("Ruby", ["rb"]),
    ("PHP", ["php"]),
    ("Shell", ["sh", "bash", "zsh"]),
    ("Lua", ["lua"]),
    ("Zig", ["zig"]),
    ("Scala", ["scala", "sc"]),
    ("Haskell", ["hs", "lhs"]),
]

#: zstd-19 ratios of public project streams of 64 KiB and more, by language.
BASELINES = {
    "C": [0.18509529314023038],
    "C Header": [0.13192909089870372, 0.2033323258896179],
    "C#": [0.10536494394875565],
    "C++": [0.10944792844659196],
    "C++ Header": [0.07720846643328437],
    "Go": [0.15818340560424912],
    "Java": [0.10669986745256747],
    "JavaScript": [0.02575180509955966, 0.10708220615159064, 0.14732251722566334],
    "Kotlin": [0.13264540704351538],
    "Lua": [0.13210530404463677],
    "Objective-C": [0.1063997673516867],
    "PHP": [0.10756102683125177],
    "Python": [0.2030775589362074, 0.23752535269663047, 0.25721993634034623],
    "Ruby": [0.13334173786699002],
    "Rust": [0.103526622701175, 0.11259832133731068, 0.15440274554315425],
    "Shell": [0.2090459036991205],
    "Swift": [0.12613122041931873],
    "TSX": [0.16739407988264804, 0.24447747676799497],
    "TypeScript": [0.09553785669457865, 0.16016461836509632],
}

#: Directory for this library's own state inside a project.
MANAGED = ".stratum"
EXCLUDED = [".git", MANAGED, "target", "node_modules", "vendor", "dist", "build", ".next", ".cache"]
MARKERS = ["do not edit", "@generated", "code generated", "automatically generated", "auto-generated"]

WINDOW = 4096
WINDOW_LEAST = 256
WINDOW_BITS = 7.5
FINGERPRINT = 64
SAMPLED = 64
TOKEN_LEAST = 24
TOKEN_BITS = 3.5
MINIFIED_BYTES, MINIFIED_LINE, MINIFIED_MEAN = 1024, 1000, 300
MARKER_BYTES = 8192
SMALL_SAMPLE = 512
CANDIDATES = 1024
EMPTY_FRAME = 9
COHORT_BYTES = 65_536


def language_table(spark: SparkSession) -> DataFrame:
    """(extension, language, lang_ord); one short row per extension."""
    rows = [(x, name, i) for i, (name, some) in enumerate(LANGUAGES) for x in some]
    return spark.createDataFrame(rows, "extension string, language string, lang_ord int")


def baseline_table(spark: SparkSession) -> DataFrame:
    """(language, samples ascending)."""
    return spark.createDataFrame(list(BASELINES.items()), "language string, samples array<double>")
