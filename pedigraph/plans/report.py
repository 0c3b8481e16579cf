"""Self-contained HTML report of an annotated de novo set."""

from __future__ import annotations

import html

from pedigraph.functions.genome import CHANNELS, SUBSTITUTIONS

# Columns shown, rows shown, bar colours per substitution.
REPORT_COLUMNS = ["priority_rank", "priority_tier", "acmg_class", "acmg_codes", "gene", "hgvsp", "consequence", "track",
                  "dnm_tier", "proband_vaf", "REVEL", "AlphaMissense", "spliceai", "LOEUF", "disease", "flags"]
REPORT_ROWS = 500
COLOURS = ["#03bcee", "#010101", "#e32926", "#cac9c9", "#a1ce63", "#ebc6c4"]

STYLE = """
:root { --ink: #222; --line: #ddd; --warn: #a40; --sbs-cg: #010101 }
@media (prefers-color-scheme: dark) { :root { --ink: #eee; --line: #444; --warn: #f90; --sbs-cg: #9aa3b2 } body { background: #14181d } }
body { color: var(--ink); font: 14px sans-serif; max-width: 1200px; margin: auto; padding: 1em }
td, th { border-bottom: 1px solid var(--line); padding: 3px 6px; text-align: left }
.warn { color: var(--warn) } svg text { fill: var(--ink); font-size: 9px } svg .sbs1 { fill: var(--sbs-cg) }
"""


def esc(value) -> str:
    return html.escape(str(value))


def percent(value) -> str:
    return f"{value:.0%}" if isinstance(value, (int, float)) else str(value)


def spectrum_svg(counts: dict[str, int]) -> str:
    top = max(counts.values(), default=0) or 1
    bars = []
    for i, channel in enumerate(CHANNELS):
        n = counts.get(channel, 0)
        height = 100 * n / top
        bars.append(f'<rect class="sbs{i // 16}" x="{20 + i * 9.6:.1f}" y="{110 - height:.1f}" width="7.5" '
                    f'height="{height:.1f}" fill="{COLOURS[i // 16]}"><title>{esc(channel)}: {esc(n)}</title></rect>')
    names = "".join(f'<text x="{20 + (16 * k + 7) * 9.6:.0f}" y="128">{esc(s)}</text>' for k, s in enumerate(SUBSTITUTIONS))
    return f'<svg viewBox="0 0 960 135" role="img" aria-label="SBS-96 spectrum">{"".join(bars)}{names}</svg>'


def _table(head, rows) -> str:
    body = "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{esc(h)}</th>" for h in head) + f"</tr>{body}</table>"


def render(result: dict, rows: list[dict]) -> str:
    """``rows`` are the leading rows of the ranked table; the page says how many of how many it shows."""
    call, checks = result.get("call_summary") or {}, result.get("sanity") or {}
    out = [f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>De novo report</title>"
           f"<style>{STYLE}</style></head><body><h1>De novo report — {esc(call.get('proband', ''))}</h1>",
           f"<p>father {esc(call.get('father', ''))}, mother {esc(call.get('mother', ''))}, "
           f"proband sex {esc(call.get('proband_sex', ''))}</p>"]
    cards = [("Germline SNV DNMs", "n_germline_snv"), ("Germline indel DNMs", "n_germline_indel"),
             ("Post-zygotic mosaic", "n_mosaic"), ("Parental mosaic", "n_parental_mosaic"), ("Ti/Tv", "titv"),
             ("CpG transition fraction", "cpg_transition_fraction"), ("Paternal fraction", "paternal_fraction"),
             ("Sanity status", "status")]
    out.append(_table(["Metric", "Value"], [(n, "—" if checks.get(k) is None else checks[k]) for n, k in cards]))
    if checks.get("warnings"):
        out.append("<h2>Sanity-check warnings</h2><ul>"
                   + "".join(f"<li class='warn'>{esc(w)}</li>" for w in checks["warnings"]) + "</ul>")
    if call.get("waterfall"):
        out.append("<h2>Filter waterfall</h2>" + _table(["Step", "Remaining"], call["waterfall"].items()))
        if call.get("mendelian_error_gate"):
            out.append(f"<p>Raw Mendelian error gate: {esc(call['mendelian_error_gate'])} "
                       f"(rate {esc(call.get('raw_mendelian_error_rate'))}, "
                       f"{esc(call.get('raw_mendelian_informative_sites'))} informative sites).</p>")
        if call.get("qc_warning"):
            out.append(f"<p class='warn'>{esc(call['qc_warning'])}</p>")
        if call.get("population_af_missing"):
            out.append("<p class='warn'>No population allele frequency was found in the input: the population filter "
                       "(Layer 4) was inactive.</p>")
        if call.get("second_engine_only_candidates"):
            out.append(f"<p>Candidates found only by the second engine: {esc(call['second_engine_only_candidates'])}.</p>")
        leak = call.get("parental_leakage") or {}
        if leak:
            out.append(f"<p>Parental ALT reads at germline DNMs: father {esc(leak.get('father_any_alt_frac', '—'))}, mother "
                       f"{esc(leak.get('mother_any_alt_frac', '—'))} (n={esc(leak.get('n'))}).</p>")
    if checks.get("sbs96"):
        out.append("<h2>Mutational spectrum (SBS-96, germline SNV DNMs)</h2>" + spectrum_svg(checks["sbs96"]))
        fit = checks.get("signatures")
        if fit:
            shares = ", ".join(f"{esc(k)} {esc(percent(v))}" for k, v in fit.get("exposures", {}).items())
            out.append(f"<p>Signature refit (cosine {esc(fit.get('cosine'))}): {shares}</p>")
    shown = f"<p>First {len(rows)} of {result.get('n_annotated', len(rows))}.</p>"
    out.append("<h2>Prioritised variants</h2>" + shown
               + _table(REPORT_COLUMNS, ([r.get(c, "") for c in REPORT_COLUMNS] for r in rows)))
    out.append("<p>Classes are provisional, from annotation only, and need expert review.</p></body></html>")
    return "".join(out)
