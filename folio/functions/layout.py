"""Layout rules over one paragraph or one group of equal ones."""

from __future__ import annotations

from folio.functions import fixed as fx
from folio.functions import text as tx
from folio.functions.core import W, all_of, any_of, case, has, holds, length, like, lower, matches, strip


def protected(role, structural_role):
    return role.isin(*fx.PROTECTED_ROLES) | structural_role.isin(*fx.PROTECTED_STRUCTURAL)


def short_key(key, limit: int = 80):
    return all_of(key != "", length(key) <= limit, matches(key, f"{W}+") <= 12)


def repeat_candidate(text, key, role, structural_role, list_kind, is_title, limit: int = 80):
    """Whether a paragraph counts towards repetition."""
    return all_of(short_key(key, limit), ~protected(role, structural_role), role == "body", structural_role == "body", list_kind.isNull(), ~tx.is_sentence(text) | holds(is_title))


def cadence_candidate(text, key, role, list_kind, limit: int = 80):
    """Whether a paragraph may be furniture of every page: role and origin don't matter, but tables and images are none."""
    return all_of(short_key(key, limit), ~role.isin("table", "image"), ~like(lower(text), r"\[\[(?:docx_)?image_[a-z0-9_]+\]\]"), list_kind.isNull(), ~tx.is_sentence(text))


def page_cadence(count, rows, first_pos, last_pos, least: int = 6):
    """Repeats of one key at the pace of pages over the whole document, and not too much of it."""
    span = last_pos - first_pos
    return all_of(rows >= least, count >= least, count * 5 <= rows, span * 2 >= rows - 1, (rows > 1) | (span >= 0), span <= (count - 1) * 40)


def repeat_reason(text, key, layout_origin, count, is_title):
    words = matches(key, f"{W}+")
    return case(
        (like(lower(text), fx.URL_OR_EMAIL), "repeated_url_footer"),
        (key.isin(*fx.BOILERPLATE), "repeated_boilerplate_token"),
        (holds(is_title), "repeated_title_header"),
        (all_of(layout_origin == "textbox", words >= 1, words <= 6, count >= 3), "repeated_running_header"),
    )


def cleanup_reason(text, key, role, structural_role, list_kind, layout_origin, count, is_title, is_furniture, is_candidate, min_repeat: int = 3):
    """Why a paragraph goes or stays, the first that holds."""
    why = repeat_reason(text, key, layout_origin, count, is_title)
    repeated = is_candidate & (count >= min_repeat)
    return case(
        (holds(is_furniture), "repeated_page_furniture"),
        (protected(role, structural_role), "protected_role_keep"),
        (strip(text) == "", "empty_or_whitespace"),
        (tx.is_blank_notice(text), "blank_page_marker"),
        (tx.is_artifact(text), "extraction_artifact"),
        (all_of(tx.is_page_number(text), role == "body", structural_role == "body", list_kind.isNull()), "page_number_pattern"),
        (repeated & why.isNotNull(), why),
        (repeated, "keep"),
        (is_candidate & (count > 1), "uncertain_repeated_artifact"),
        other="keep",
    )


def cleanup_action(reason, remove: bool = False):
    return case((reason == "repeated_page_furniture", "remove"), (reason.isin("keep", "protected_role_keep", "uncertain_repeated_artifact"), "keep"), other="remove" if remove else "flag")


def cleanup_confidence(reason, action):
    return case((reason == "uncertain_repeated_artifact", "low"), (action == "keep", "medium"), (reason.isin("repeated_title_header", "repeated_running_header"), "medium"), other="high")


def risk_flags(text, role, structural_role, alignment, list_kind) -> dict:
    """Flags of one paragraph that a structure report counts."""
    s = strip(text)
    body = structural_role.isin("body", "") & (role != "heading")
    letters = matches(s, r"\p{L}")
    n = matches(s, r"\S+")
    heading = role == "heading"
    return {
        "filled": s != "",
        "heading": heading,
        "short_body": all_of(body, list_kind.isNull(), n >= 1, n <= 8),
        "all_caps": all_of(body, letters >= 3, s == tx.upper(s)),
        "centered": all_of(body, s != "", holds(alignment == "center")),
        "toc_candidate": all_of(s != "", ~heading, ~structural_role.isin("toc_entry", "toc_header"), list_kind.isNull(), n <= 12),
        "isolated": all_of(~like(s, r"^(?:19|20)\d{2}\.\z"), ~heading, structural_role != "list", list_kind.isNull(), s.isin("●", "•", "-", "*") | like(s, r"^\d+[.)]\z")),
        "front": structural_role.isin(*fx.PROTECTED_STRUCTURAL) | ((s != "") & any_of(heading, like(s, r"\.{2,}\s*\d+\s*\z"), lower(s).isin(*fx.TOC_HEADERS))),
        "body_text": all_of(s != "", body),
        "toc_entry": structural_role == "toc_entry",
    }


def escalation(m) -> list:
    """(name, test) of what raises a document's risk; m(name) is one of its metrics."""
    n = case((m("filled") == 0, 1), other=m("filled"))
    return [
        ("low_explicit_heading_density", all_of(m("filled") >= 40, m("headings") * 1000 < n * 3)),
        ("high_suspicious_short_body_ratio", m("short_body") * 100 > n * 5),
        ("high_all_caps_or_centered_body_ratio", m("caps_or_centered") * 100 > n * 3),
        ("toc_like_sequence_detected", m("toc_sequences") > 0),
        ("heading_only_collapse_risk", all_of(m("longest_body") >= 120, m("headings") < 3)),
        ("isolated_list_marker_fragments", m("isolated") > 0),
    ]


def risk_level(reasons):
    """reasons: comma-joined."""
    return case((reasons == "", "low"), ((matches(reasons, "[^,]+") >= 3) | has(reasons, "toc_like_sequence_detected"), "high"), other="medium")


def readiness(m, level):
    unsafe = any_of(
        all_of(m("toc_sequences") > 0, m("toc_regions") == 0),
        m("isolated") > 0,
        all_of(m("front_run") >= 4, m("toc_regions") == 0),
        (m("toc_entries") >= 6) & ((m("headings") < 3) | ((m("headings") + 1) * 3 <= m("toc_entries"))),
    )
    return case((unsafe, "blocked_unsafe_best_effort_only"), (level == "medium", "ready_with_warnings"), other="ready")


def text_layer_reasons(m) -> list:
    return [
        ("low_visible_text_chars", m("visible") < 1500),
        ("low_body_span_count", m("body_spans") < 20),
        ("low_body_text_ratio", m("body_ratio") < 0.70),
        ("high_page_furniture_ratio", m("furniture_ratio") > 0.25),
        ("no_structure_signals", ~m("structured")),
    ]
