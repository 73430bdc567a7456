"""Column expressions of the density protocol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dimensions as d


def extension(path: Column) -> Column:
    """The last extension of the last component; null for none, as in ``.rs``."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(?s)^.+\.([^.]*)$", 1)
    return F.when(found != "", found)


def in_excluded_directory(path: Column) -> Column:
    """Whether a directory above the file has an excluded name."""
    names = F.array(*map(F.lit, d.EXCLUDED))
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), names)


def input_label(path: Column) -> Column:
    """The last component of a path, or a point: absolute parents never leave."""
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.lit(-1))
    return F.coalesce(last, F.lit("."))


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole)


def generated_marker(content: Column) -> Column:
    """A marker in the first 8192 bytes, whatever its ASCII case."""
    head = F.translate(
        F.decode(F.substring(content, 1, d.MARKER_BYTES), "ISO-8859-1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    out = F.lit(False)
    for marker in d.MARKERS:
        out = out | head.contains(marker)
    return out


def minified(content: Column) -> Column:
    """Large, with a very long line and a great mean line."""
    lines = F.split(F.decode(content, "ISO-8859-1"), "\n")
    size = F.octet_length(content)
    longest = F.array_max(F.transform(lines, F.length))
    return (size >= d.MINIFIED_BYTES) & (longest >= d.MINIFIED_LINE) & (F.floor(size / F.size(lines)) >= d.MINIFIED_MEAN)


def gain(first: Column, second: Column, combined: Column, empty: Column) -> list[Column]:
    """raw_gain, adjusted_gain, gain_ratio of two streams and their concatenation."""
    raw = first + second - combined
    payload = F.greatest(first + second - 2 * empty, F.lit(0))
    return [raw.alias("raw_gain"), (raw - empty).alias("adjusted_gain"), ratio(raw - empty, payload).alias("gain_ratio")]


def block_fingerprints(content: Column) -> Column:
    """Distinct 64-bit prefixes (hex) of the SHA-256 of whole 64-byte blocks from the start."""
    n = F.octet_length(content)
    size = d.FINGERPRINT
    each = F.transform(
        F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1),
        lambda i: F.substr(F.sha2(F.substr(content, i * size + 1, F.lit(size)), 256), F.lit(1), F.lit(16)),
    )
    return F.when(n >= size, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def bar(x: Column) -> Column:
    """Twelve cells, filled by a share."""
    n = F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 12 + 0.5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), n), F.repeat(F.lit("·"), 12 - n), F.lit("]"))


def score_columns() -> dict[str, Column]:
    """Score parts of columns noise_ratio, norm_compression, entropy_bits, duplicate_ratio, top_10_share, largest_share, gini, original_bytes."""
    c = F.col
    signal = clamp((1 - c("noise_ratio")) * 100)
    compression = c("norm_compression") * signal / 100
    h = c("entropy_bits")
    entropy = F.when(h <= 3.0, clamp(h / 3 * 70)).when(h <= 6.5, 70 + (h - 3) / 3.5 * 30).otherwise(clamp((8 - h) / 1.5 * 100))
    uniqueness = clamp((1 - c("duplicate_ratio")) * 100)
    even = clamp((1 - 0.55 * c("largest_share") - 0.45 * c("gini")) * 100)
    distribution = F.when((c("top_10_share") >= 0.999) & (c("original_bytes") < 65536), 50.0).otherwise(even)
    total = 0.30 * compression + 0.15 * entropy + 0.25 * uniqueness + 0.20 * signal + 0.10 * distribution
    return {
        "signal": signal, "compression": compression, "entropy": entropy, "uniqueness": uniqueness,
        "distribution": distribution, "information_density": total,
    }


def confidence(size: Column, samples: Column) -> Column:
    return (
        F.when((size >= 262144) & (samples >= 5), "high").when((size >= 65536) & (samples >= 2), "medium").otherwise("low")
    )


def template_risk(duplicate: Column, consensus: Column) -> Column:
    return (
        F.when((duplicate >= 0.30) | (consensus < 0.08), "high")
        .when((duplicate >= 0.15) | (consensus < 0.14), "medium")
        .otherwise("low")
    )


#: Grammar of repository addresses.
REPOSITORY_URL = r"^\s*https://github\.com/([A-Za-z0-9._-]+)/([A-Za-z0-9._-]+?)(?:\.git)?(?:/tree/([A-Za-z0-9._-]+)|/commit/([0-9A-Fa-f]{40}))?/*\s*$"
COMMIT = "^[0-9A-Fa-f]{40}$"
DIGEST = "^[0-9A-Fa-f]{64}$"
TAG = "^[A-Za-z0-9._-]+$"
