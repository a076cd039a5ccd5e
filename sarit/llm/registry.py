"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from sarit.llm import budget, encode, language, leaks, lookalike, mixing, overlap, quality, repeated_lines, residue

QUERIES: dict = {
    "p1_found": quality.found,
    "p1_statistics": quality.statistics,
    "p1_quantiles": quality.quantiles,
    "p2_found": language.found,
    "p2_documents": language.assigned,
    "p2_passages": language.passages,
    "p3_mix": mixing.mixed,
    "p3_shares": mixing.reached,
    "p4_tokens": budget.by_document,
    "p4_budget": budget.by_slice,
    "p4_error": budget.errors,
    "p5_method": repeated_lines.method,
    "p5_found": repeated_lines.found,
    "p5_clusters": repeated_lines.clusters,
    "p5_clean": repeated_lines.cleaned,
    "p5_clean_clusters": repeated_lines.cleaned_of_clusters,
    "p6_found": overlap.found,
    "p6_classes": overlap.classes,
    "p6_members": overlap.members,
    "p6_report": overlap.report,
    "p7_found": lookalike.same_look,
    "p7_classes": lookalike.classes,
    "p7_form": lookalike.one_form,
    "p8_ids": encode.corpus_ids,
    "p9_found": leaks.leaked,
    "p9_near": leaks.nearly_leaked,
    "p9_items": leaks.leaks_by_item,
    "p10_found": residue.found,
    "p10_reasons": residue.reasons,
    "p10_kept": residue.kept,
}
ORACLE: dict = {
    "p5_found": repeated_lines.FOUND_SQL,
    "p5_clean": repeated_lines.CLEAN_SQL,
}
