"""Whether two neighbouring paragraphs are one: what each edge says, and the decision over a pair of edges."""

from __future__ import annotations

from folio.functions import fixed as fx
from folio.functions import text as tx
from folio.functions.core import all_of, any_of, case, first_of, full, has, holds, joined, lower, named, one, size, strip


def edges(text, style, alignment, level, role, kind) -> dict:
    """What one paragraph brings to the decisions on both its sides, by name."""
    s = lower(strip(style))
    return {
        "heading": level.isNotNull(),
        "other_role": role != "body",
        "listed": kind.isNotNull(),
        "marker": tx.list_kind(text).isNotNull(),
        "caption": tx.is_caption(text),
        "attribution": tx.is_attribution(text),
        "toc_heading": tx.is_toc_heading(text),
        "toc_entry": tx.is_toc_entry(text),
        "structural_style": any_of(tx.is_caption_style(style), full(s, r"(?:heading|заголовок)\s*\d*"), has(s, "list"), has(s, "спис")),
        "style": s,
        "body_style": s.isin(*fx.BODY_STYLES),
        "alignment": first_of(alignment, ""),
        "loose": alignment.isNull() | holds(alignment.isin(*fx.COMPATIBLE_ALIGNMENTS)),
        "placed": holds(alignment.isin(*fx.STRUCTURED_ALIGNMENTS)),
        "terminal": tx.ends_terminal(strip(text)),
        "opens": tx.starts_sentence(text),
        "continues": tx.starts_continuation(text),
        "incomplete": tx.ends_incomplete(text),
    }


def decide(a, b) -> dict:
    """decision, confidence and reasons for a pair; a(name) and b(name) are the edges of the left and the right paragraph."""
    same_style = (a("style") == b("style")) | (a("body_style") & b("body_style"))
    same_place = (a("alignment") == b("alignment")) | (a("loose") & b("loose"))
    blocked = named(
        ("heading_boundary", a("heading") | b("heading")),
        ("non_body_role", a("other_role") | b("other_role")),
        ("list_metadata", a("listed") | b("listed")),
        ("right_explicit_list_marker", b("marker")),
        ("caption_like_boundary", a("caption") | b("caption")),
        ("right_attribution_like", b("attribution")),
        ("adjacent_toc_like_entries", a("toc_heading") & b("toc_heading")),
        ("right_toc_like", b("toc_entry")),
        ("style_transition", a("structural_style") | b("structural_style")),
        ("alignment_transition", ~same_place & (a("placed") | b("placed"))),
        ("terminal_punctuation_sentence_reset", a("terminal") & b("opens")),
    )
    both = a("incomplete") & b("continues")
    signals = one(~a("terminal")) + one(b("continues")) + one(a("incomplete")) + one(both)
    positive = named(
        ("same_body_style", same_style),
        ("compatible_alignment", same_place),
        ("left_not_terminal", ~a("terminal")),
        ("right_starts_continuation", b("continues")),
        ("left_incomplete", a("incomplete")),
        ("combined_sentence_plausible", both),
    )
    high = all_of(same_style, ~a("terminal"), b("continues"))
    medium = all_of(same_style, same_place, signals >= 2)
    is_blocked = size(blocked) > 0
    return {
        "decision": case((is_blocked, "keep"), (high | medium, "merge"), other="keep"),
        "confidence": case((is_blocked, "blocked"), (high, "high"), other="medium"),
        "reasons": case((is_blocked, joined(blocked, ",")), (size(positive) > 0, joined(positive, ",")), other="insufficient_merge_signals"),
        "can_lead": all_of(~is_blocked, same_style, same_place, ~a("terminal"), a("incomplete")),
    }


def effective(decision, confidence, can_lead, next_decision) -> dict:
    """In the mode that takes high merges: a medium one stays only where it can lead a chain and the next pair merges too."""
    doubtful = (decision == "merge") & (confidence == "medium")
    led = can_lead & holds(next_decision == "merge")
    return {"decision": case((doubtful & ~led, "keep"), other=decision), "extra": case((doubtful & led, "chain_continuation_supported"), (doubtful, "medium_mode_disabled"), other="")}
