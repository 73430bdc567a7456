"""Results as short texts for people."""

from __future__ import annotations

import math


def bar(share: float) -> str:
    """Twelve cells; halves round up."""
    n = math.floor(min(max(share, 0.0), 1.0) * 12 + 0.5)
    return f"[{'█' * n}{'·' * (12 - n)}]"


def ratio(value: float | None) -> str:
    return "null" if value is None else f"{value:.6f}"


def _lines(pairs: dict) -> str:
    return "".join(f"{k}: {v}\n" for k, v in pairs.items())


def analysis(r: dict) -> str:
    o = r["overall"]
    saved = o["savings"] or 0.0
    out = (
        f"Stratum summary · {r['input_label']}\n"
        f"compression: {bar(saved)} {saved * 100:.2f}% saved · {o['original_bytes']} → {o['compressed_bytes']} bytes\n"
        f"files: {o['file_count']} recognized · {r['skipped_file_count']} skipped · sha256: {o['sha256']}\n"
    )
    if r.get("profile"):
        s = r["profile"]["score"]
        out += f"information_density: {s['information_density']:.2f}/100 · confidence: {s['confidence']} · template risk: {s['template_repetition_risk']}\n"
    out += "languages:\n"
    for x in r["languages"]:
        if x["file_count"]:
            part = x["savings"] or 0.0
            out += f"  {x['language']:<16} {bar(part)} {part * 100:>6.2f}% · {x['file_count']} files\n"
    return out + _lines(
        {"ratio": f"{o['ratio'] or 0.0:.6f}", "schema": r["schema_version"], "stratum": r["stratum_version"], "zstd": r["zstd_version"], "protocol": r["protocol"]}
    )


def relation(r: dict) -> str:
    side = lambda x: f"{x['path']} ({x['language']}) compressed={x['compressed_bytes']}"
    return _lines(
        {
            "schema": r["schema_version"], "stratum": r["stratum_version"], "zstd": r["zstd_version"], "protocol": r["protocol"],
            "first": side(r["first"]), "second": side(r["second"]), "combined": r["combined"]["compressed_bytes"], **_gains(r),
            "interpretation": r["interpretation"],
        }
    )


def _gains(r: dict) -> dict:
    return {
        "empty_frame": r["empty_frame_bytes"], "raw_cross_stream_gain": r["raw_cross_stream_gain_bytes"],
        "adjusted_cross_stream_gain": r["adjusted_cross_stream_gain_bytes"],
        "adjusted_cross_stream_gain_ratio": ratio(r["adjusted_cross_stream_gain_ratio"]),
    }


def granular(r: dict) -> str:
    size = lambda x: f"original={x['original_bytes']} compressed={x['compressed_bytes']} ratio={ratio(x['ratio'])}"
    out = analysis(r["repository"]) + f"granular_protocol: {r['protocol']}\nfiles:\n"
    out += "".join(f"  {x['path']}: {x['language']} {size(x)} sha256={x['sha256']}\n" for x in r["files"])
    if "function_protocol" in r:
        out += f"function_protocol: {r['function_protocol']}\n"
    out += "functions:\n"
    for x in r["functions"]:
        out += (
            f"  {x['path']}:{x['start_line']}-{x['end_line']} {x['kind']} {x['symbol']} {size(x)} "
            f"small_sample={str(x['small_sample']).lower()} sha256={x['sha256']}\n"
        )
    if r["unsupported_function_languages"]:
        out += f"unsupported_function_languages: {','.join(r['unsupported_function_languages'])}\n"
    return out + f"interpretation: {r['interpretation']}\n"


def repository(r: dict) -> str:
    head = _lines({"schema": r["schema_version"], "protocol": r["protocol"], **r["provenance"]})
    return head + granular(r["analysis"]) + f"snapshot_interpretation: {r['interpretation']}\n"


def comparison(r: dict) -> str:
    side = lambda x: f"{x['repository_url']}@{x['commit']} archive_sha256={x['archive_sha256']}"
    out = _lines(
        {
            "schema": r["schema_version"], "protocol": r["protocol"], "first": side(r["first"]), "second": side(r["second"]),
            "first_compressed": r["first_analysis"]["overall"]["compressed_bytes"],
            "second_compressed": r["second_analysis"]["overall"]["compressed_bytes"], "combined": r["combined"]["compressed_bytes"],
            **_gains(r), "function_candidate_limit": r["function_candidate_limit"],
            "function_similarity_truncated": str(r["function_similarity_truncated"]).lower(),
        }
    )
    out += "function_similarities:\n"
    for x in r["function_similarities"]:
        a, b = (f"{x[k]['path']}:{x[k]['start_line']}:{x[k]['symbol']}" for k in ("first", "second"))
        out += (
            f"  {a} <-> {b} combined={x['combined_bytes']} adjusted_gain={x['adjusted_cross_stream_gain_bytes']} "
            f"ratio={ratio(x['adjusted_cross_stream_gain_ratio'])} high_variance={str(x['high_variance']).lower()}\n"
        )
    return out + f"interpretation: {r['interpretation']}\n"
