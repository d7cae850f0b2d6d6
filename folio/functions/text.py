"""Text functions over a string column, written once for Spark and for SQL text (see core). Null in, null out, unless said otherwise."""

from __future__ import annotations

from folio.functions import fixed as fx
from folio.functions.core import (
    L, S, W, all_of, any_of, behind, case, cut, each, first, floor, found, full, greatest, group, halved, has, holds, joined, keep, last, least, left, length, like, lit, lower, lstrip, matches, member, named, nullif, first_of, part, plus, ratio, reasons, rstrip,
    short_hash, size, squeeze, starts, strip, sub, swapped, unique, upper, whole, words,
)

EDGE = rf"(?:[^\p{{L}}\p{{N}}_]|\z)"  # what follows a whole word
LINK = r"\[([^\]]+)\]\([^\)]+\)"
TAG = r"</?(?:[uU]|[sS][uU][pP]|[sS][uU][bB])>"
LIST_PREFIX = rf"^{S}*(?:[-*+•]{S}+|\d+[.)]{S}+)"
IMAGE = r"\[\[DOCX_IMAGE_[A-Za-z0-9_]+\]\]"


def contents_of(x, pattern: str, n: int = 1):
    """A group of the first match, or the text itself where nothing matches."""
    return case((like(x, pattern), group(x, pattern, n)), other=x)


# ---- normal forms ----


def without_markup(x):
    """Links as their text, no emphasis marks, no inline tags."""
    return sub(sub(sub(x, LINK, r"\1"), TAG, ""), r"\*", "")


def strip_list_prefix(x):
    return strip(sub(without_markup(strip(x)), rf"^(?:{S}*(?:[-*+•]{S}+|\d+[.)]{S}+))+", ""))


def heading_plain(x):
    """What heading rules look at."""
    return strip(without_markup(x))


def layout_key(x):
    """What two copies of a running line have in common: links spelled out, plain quotes and dashes, no wrapping marks, nothing but inner punctuation, lower-case."""
    s = squeeze(swapped(sub(x, r"\[([^\]]+)\]\(([^)]+)\)", r"\1 \2"), "‘’“”–—", "''\"\"--"))
    s = strip(contents_of(s, r"^[*_`~]+(.*?)[*_`~]+\z"))
    return lower(sub(strip(s, " \t\r\n-_*`~|:;,.()[]{}<>"), f"{S}+", " "))


def mapping_key(x):
    """The key by which paragraphs are aligned."""
    s = sub(sub(sub(strip(x), rf"^(?:>{S}*)+", ""), rf"^#{{1,6}}{S}+", ""), rf"^(?:[-*+]{S}+|\d+[.)]{S}+)", "")
    s = sub(sub(without_markup(s), "<br/>", " "), f"{S}+", " ")
    carried = rf"^(.+?){S}+\d+\.\z"
    body = strip(group(strip(s), carried, 1))
    short = like(strip(s), carried) & (size(words(body)) <= 2) & ~like(body, "[A-Za-zА-Яа-яЁё]")
    return lower(strip(case((short, body), other=s)))


def heading_key(x):
    return strip(squeeze(lower(x)), " \t\r\n\"'“”‘’«»()[]{}:;,.!?-–—")


def heading_match_key(x):
    return lower(squeeze(sub(x, r"[^\p{L}\p{N}_]+", " ")))


def outline_key(x):
    """A title without its dotted leader and page, squeezed, lower-case, no dots at the ends."""
    s = strip(x)
    page = rf"^(.+?)(?:[.․‥…‧∙⋅·]|{S})+\d+{S}*\z"
    return lower(strip(squeeze(case((like(s, page), strip(group(s, page, 1), " .\t")), other=s)), " .\t"))


def toc_key(x):
    s = sub(squeeze(lower(strip(x))), rf"{S}*[.·•]{{2,}}{S}*(\d+){S}*\z", r" ... \1")
    return strip(s, " \t\r\n-–—:;,.!?()[]{}\"'«»“”")


def joined_fragments(a):
    """Fragments as one paragraph: a space between, none before punctuation."""
    return squeeze(sub(joined(keep(each(a, strip), lambda x: x != ""), " "), rf"{S}+([,.;:!?…])", r"\1"))


def running_header(x):
    """The lower-cased line if it may be a running header, else null: 40 characters, five words, a letter."""
    s = squeeze(strip(x, " -–—|,;:.\t"))
    return case((all_of(s != "", length(s) <= 40, size(words(s)) <= 5, like(s, L)), lower(s)))


def preview(x, limit: int = 120):
    s = squeeze(x)
    return case((length(s) <= limit, s), other=plus(rstrip(left(s, limit - 1)), "…"))


def rendered(text, role, structural_role, heading_level, list_kind, list_level):
    """A paragraph as Markdown, by what it is."""
    level = least(greatest(heading_level, 1), 6)
    marks = left(lit("######", text), level)
    quoted_lines = joined(each(cut(text, "\n"), lambda w: case((strip(w) == "", ">"), other=plus("> ", w))), "\n")
    indent = left(lit("            ", text), greatest(list_level, 0) * 2)
    marker = case((holds(list_kind == "ordered"), "1."), other="-")
    return case(
        ((role == "heading") & heading_level.isNotNull() & ~like(text, rf"^#{{1,6}}{S}"), plus(marks, " ", text)),
        (structural_role.isin(*fx.QUOTE_ROLES) & ~like(text, rf"^{S}*>"), plus(quoted_lines)),
        (structural_role.isin(*fx.QUOTE_ROLES), text),
        ((role == "list") & ~like(text, rf"^{S}*(?:[-*+]|\d+[.)]){S}+"), plus(indent, marker, " ", text)),
        other=text,
    )


def homoglyphs(x):
    """Words that mix Latin and Cyrillic letters with Latin look-alikes made Cyrillic; not in code or addresses."""
    mixed = lambda w: like(w, "[A-Za-z]") & like(w, "[А-Яа-яЁё]") & ~like(w, r"://|www\.|@|[\p{L}\p{N}_-]+\.[\p{L}\p{N}_-]{2,}")
    repaired = joined(each(cut(x, " "), lambda w: case((mixed(w), swapped(w, *fx.HOMOGLYPHS)), other=w)), " ")
    return case((like(x, "`"), x), other=repaired)


def bullets(x):
    """A leading glyph becomes a list marker, a stray one a space; one welded between word characters stays."""
    s = sub(sub(sub(x, rf"^({S}*)[{fx.GLYPHS}]{S}+(\S)", r"\1- \2"), rf"([,;:]){S}*[{fx.GLYPHS}]{S}*", r"\1 "), rf"{S}*[{fx.GLYPHS}]{S}*;{S}*", "; ")
    for glyph, stand_in in zip(fx.GLYPHS, "\ue000\ue001\ue002\ue003", strict=True):
        for _ in range(2):
            s = sub(s, f"({W}){glyph}({W})", rf"\1{stand_in}\2")
    s = swapped(sub(s, rf"{S}*[{fx.GLYPHS}]{S}*", " "), "\ue000\ue001\ue002\ue003", fx.GLYPHS)
    return case((any_of(strip(x) == "", starts(strip(x), "#", ">")), x), other=rstrip(sub(s, " {2,}", " ")))


def blank_page_split(x):
    """A blank-page notice before a chapter's heading as two paragraphs, the heading's marks with the heading."""
    s = rstrip(x)
    notice = rf"^({S}*(?:#{{1,6}}{S}+)?)([tT]his [pP]age [iI]ntentionally [lL]eft [bB]lank){S}+((?:[cC]hapter|CHAPTER|[гГ]лава)[^\p{{L}}\p{{N}}_].*)\z"
    return case((like(s, notice), plus(group(s, notice, 2), "\n\n", group(s, notice, 1), group(s, notice, 3))), other=s)


def halve_repeated(x):
    """A Markdown heading whose two halves are the same words, four or more in all, once; other text as it is."""
    s = strip(x)
    mark = rf"^(#{{1,6}}){S}+"
    w = words(sub(s, mark, ""))
    half = halved(size(w))
    one, two = part(w, 1, half), part(w, half + 1, half)
    same = (heading_key(joined(one)) == heading_key(joined(two))) & (heading_key(joined(one)) != "")
    return case((all_of(like(s, mark), size(w) >= 4, size(w) % 2 == 0, same), plus(group(s, mark, 1), " ", joined(one))), other=s)


def without_images(x):
    return strip(sub(x, r"\[\[DOCX_IMAGE_img_\d+\]\]", ""))


def tokens(x):
    """Lower-cased words with inner hyphens and apostrophes."""
    return found(lower(x), rf"{W}+(?:[-\x27]{W}+)*")


def visible_text(x):
    """What a reader sees of a block."""
    s = sub(sub(sub(x, r"\[\[DOCX_IMAGE_[^\]]+\]\]", " "), r"^\s{0,3}#{1,6}\s+", ""), r"\*\*|__", "")
    s = sub(sub(s, rf"(^|[^\p{{L}}\p{{N}}_])[*_](\S)", r"\1\2"), rf"(\S)[*_]([^\p{{L}}\p{{N}}_]|\z)", r"\1\2")
    return squeeze(s)


def identity_component(x):
    """Letters, digits, - and _; one _ for anything else, none at the ends."""
    return left(sub(sub(sub(strip(x), r"[^\p{L}\p{N}_-]", "_"), "_+", "_"), r"^_|_\z", ""), 80)


def unwrapped(x):
    """Without up to three layers of emphasis around the whole."""
    s = strip(x)
    for _ in range(3):
        s = case((like(s, r"^\*\*.+\*\*\z"), strip(sub(s, r"^\*\*|\*\*\z", ""))), (like(s, r"^__.+__\z"), strip(sub(s, r"^__|__\z", ""))), (like(s, r"^\*.+\*\z"), strip(sub(s, r"^\*|\*\z", ""))), (like(s, r"^_.+_\z"), strip(sub(s, r"^_|_\z", ""))), other=s)
    return s


# ---- sentence edges, contents and captions ----


def ends_terminal(x):
    return like(x, rf"[.!?…]{S}*\z")


def ends_incomplete(x):
    s = rstrip(x)
    return (s != "") & ~ends_terminal(s) & like(s, r"[\p{L}\p{N},;:\-(\[]\z")


def starts_continuation(x):
    """A lower-case letter or digit behind quotes, brackets and dashes, or a joining word."""
    s = lstrip(x)
    word = lower(strip(group(s, r"^(\S+)", 1), "\"'«»()[]"))
    return like(sub(s, rf"^(?:{S}|[\x22\x27«(\[—–-])+", ""), r"^[\p{Ll}\p{Nd}]") | word.isin(*fx.CONTINUATION_WORDS)


def heading_signal(x):
    """A chapter word, a number in front, or a short line with a colon."""
    s = heading_plain(x)
    return any_of(
        like(lower(s), rf"^(?:глава|раздел|часть|приложение|chapter|section|appendix){EDGE}"),
        like(s, rf"^\d+(?:\.\d+){{0,4}}(?:[).:]|{S})"),
        all_of(has(s, ":"), size(words(s)) <= 12, ~like(s, r"\.\z")),
    )


def starts_sentence(x):
    s = lstrip(x)
    return (s != "") & (like(sub(s, rf"^(?:{S}|[\x22\x27«(\[])+", ""), r"^\p{Lu}") | heading_signal(s))


def is_toc_entry(x):
    """A title of at most 120 characters, a leader of dots or two spaces, a page."""
    return like(strip(x), r"^.{1,120}(?:\.{2,}|\s{2,})\d+\s*\z")


def is_toc_heading(x):
    """A short line in title case, as contents list them."""
    s = squeeze(sub(sub(x, r"</?[^>]+>", " "), "[*_]", " "))
    t = found(s, r"[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9\x27’`.-]*")
    rest = keep(part(t, 2, greatest(size(t) - 1, 0)), lambda w: ~lower(w).isin(*fx.TITLE_STOPWORDS))
    titled = lambda w: like(w, r"^[\p{Nd}\p{Lu}]")
    n = size(rest) + 1
    hits = size(keep(rest, titled)) + case((holds(titled(member(t, 1))), 1), other=0)
    return all_of(s != "", length(s) <= 140, ~like(s, r"[.;:]\z"), size(t) >= 2, size(t) <= 14, hits * 10 >= n * 8)


def is_attribution(x):
    s = strip(x)
    return all_of(s != "", length(s) <= 120, starts(s, "-", "—", "–"))


def is_caption(x):
    s = strip(x)
    return all_of(s != "", length(s) <= 140, like(lower(s), rf"^(?:рис|рисунок|figure|fig|табл|таблица|table){EDGE}"))


def is_image_only(x):
    return like(strip(x), rf"^(?:{S}*\[\[DOCX_IMAGE_img_\d+\]\]{S}*)+\z")


def is_caption_style(style):
    s = lower(strip(style))
    return has(s, "caption") | has(s, "подпись")


def list_kind(x):
    s = lstrip(x)
    return case((starts(s, "- ", "* ", "• "), "unordered"), (like(s, rf"^\d+[.)]{S}+"), "ordered"))


def heading_level(x):
    """Of a Markdown heading, 1 to 6; null for other lines."""
    marks = group(x, r"^(#{1,6})\s+\S", 1)
    return case((length(marks) > 0, length(marks)))


def style_level(style):
    """The heading level that a style's name says."""
    s = lower(strip(style))
    number = rf"^(?:heading|заголовок){S}*(\d+)?\z"
    level = least(greatest(first_of(whole(nullif(group(s, number, 1), "")), 1), 1), 6)
    return case((s == "title", 1), (s == "subtitle", 2), (like(s, number), level))


def likely_level(x):
    """The level that a heading's words say."""
    s = heading_plain(x)
    number = group(s, rf"^(\d+(?:\.\d+){{0,4}})(?:[).:]|{S})", 1)
    return case(
        (like(lower(s), rf"^(?:глава|часть|chapter|part|appendix|приложение){EDGE}"), 1),
        (like(lower(s), rf"^(?:раздел|section){EDGE}"), 2),
        (number != "", least(matches(number, r"\.") + 2, 6)),
        other=2,
    )


def paragraph_role(x, style=None, level=None):
    """image, heading, caption (by style), list or body; the first that holds."""
    style = lit("", x) if style is None else style
    level = heading_level(x) if level is None else level
    s = lower(strip(style))
    return case((is_image_only(x), "image"), (level.isNotNull(), "heading"), (is_caption_style(style), "caption"), (has(s, "list") | has(s, "спис"), "list"), (list_kind(x).isNotNull(), "list"), other="body")


def role_confidence(role, text, style, explicit_level):
    s = lower(strip(style))
    explicit = any_of(role.isin("image", "table"), (role == "heading") & explicit_level.isNotNull(), (role == "caption") & is_caption_style(style), (role == "list") & any_of(has(s, "list"), has(s, "спис"), list_kind(text).isNotNull()))
    return case((explicit, "explicit"), other="heuristic")


def heading_role(title, level):
    """What part of a book a heading opens."""
    s = lower(strip(title))
    return case(
        (like(s, rf"^(?:references|bibliography|works cited|литература|список литературы|bibliographie){EDGE}"), "bibliography"),
        (like(s, rf"^(?:appendix|appendices|приложение){EDGE}"), "appendix"),
        (like(s, rf"^(?:chapter|part|глава|часть){EDGE}"), "chapter"),
        (level <= 1, "chapter"),
        other="section",
    )


# ---- furniture ----


def is_page_number(x):
    s = lower(strip(x))
    return (length(s) <= 20) & full(s, "|".join(f"(?:{p})" for p in fx.PAGE_NUMBERS))


def is_blank_notice(x):
    return lower(squeeze(x)).isin(*fx.BLANK_PHRASES)


def is_artifact(x):
    s = strip(x)
    return (length(s) <= 80) & full(lower(s), fx.ARTIFACT)


def is_sentence(x):
    """Ends like a sentence and is no page number."""
    s = strip(x)
    return all_of(s != "", ~is_page_number(s), like(s, r"[.!?…]\z"))


def furniture_hits(x):
    """Kinds of page furniture that stand in a text, in the order of their phrases, and what it is as a whole."""
    s = lower(squeeze(x))
    return reasons(
        ("blank_page_marker", has(s, fx.BLANK_PHRASES[0])),
        ("intentionally_blank_marker", any_of(*[has(s, p) for p in fx.BLANK_PHRASES[1:]])),
        ("page_number_island", like(s, r"^(?:page\s+)?[0-9ivxlcdm]+\z")),
    )


# ---- blocks of Markdown ----


def doubled(x):
    """Every character between words twice: a match that ends with one leaves another for the next."""
    return sub(x, r"([^\p{L}\p{N}_])", r"\1\1")


def page_references(x):
    return matches(doubled(x), fx.TOC_INDEX_REFERENCE) + matches(doubled(x), fx.TOC_PAGE_RANGE)


def contents_run(x):
    """Three page numbers or more (two beside a roman one), each at the end of its entry: last, or before a number or a capitalised word."""
    entry = lambda v: full(strip(v, fx.ENTRY_TRIM), r"\d+|\p{Lu}\p{L}*")
    roman = lambda v: (length(v) >= 2) & full(v, fx.ROMAN_PAGE)
    codes = joined(each(words(x), lambda v: case((like(v, r"^\d{1,4}\z"), "n"), (entry(v), "e"), (roman(v), "r"), other="x")), "")
    numbers, romans = matches(codes, "n"), matches(codes, r"r(?:[ne]|\z)")
    return all_of(numbers >= 1, ~like(codes, "n[rx]"), (numbers >= 3) | ((romans >= 1) & (numbers + romans >= 2)))


def is_toc_like(x):
    """Contents or index: a leader with a page, page numbers alone, dense page references, or a run of entries. Prose that ends in a number is none."""
    s = strip(x)
    dense = (page_references(s) >= 3) & (page_references(s) * 100 >= size(words(s)) * 15)
    return (s != "") & any_of(like(s, fx.TOC_LEADER), full(s, r"[\d\s.,:;–—−-]+") & (matches(s, r"\d{1,4}") >= 2), dense, contents_run(s))


def block_kind(x):
    s = strip(x)
    return case(
        (s == "", "empty"),
        (starts(s, "#"), "heading"),
        (like(s, IMAGE) & (strip(sub(s, IMAGE, "")) == ""), "docx_image_anchor"),
        (full(s, fx.BLOCK_PAGE_NUMBER), "page_number"),
        (full(lower(s), fx.BLOCK_BLANK_PAGE), "blank_page_marker"),
        (full(s, fx.ORPHAN_FOOTNOTE), "orphan_footnote_marker"),
        (like(s, fx.FOOTNOTE_BODY), "footnote_body"),
        (full(lower(s), fx.ARTIFACT), "extraction_artifact"),
        (is_toc_like(s), "toc_like"),
        (starts(s, ">"), "blockquote"),
        (like(s, r"^(?:[-*]|\d+\.)\s+"), "list"),
        other="paragraph",
    )


def noise_reason(x, kind):
    """Why a repeated block would go."""
    return case((kind.isin("page_number", "blank_page_marker", "orphan_footnote_marker", "extraction_artifact"), kind), (kind == "heading", "page_furniture_heading"), other="repeated_running_header")


# ---- counts ----


def index_density(x):
    """Numbers of one to four digits among the letters' words, as a share."""
    return ratio(matches(doubled(x), r"(?:^|[^\p{L}\p{N}_])\d{1,4}(?:[^\p{L}\p{N}_]|\z)"), greatest(matches(x, "[А-ЯЁA-Za-zа-яё]+"), 1))


def is_index_like(x):
    return (index_density(x) > 0.12) | (matches(doubled(x), rf"[,;]\s*\d{{1,4}}{EDGE}") >= 4)


def script_counts(x, excerpt: int = 2000):
    """Latin, Cyrillic and Chinese or Japanese characters among the first of a text, an excerpt by design."""
    head = left(x, excerpt)
    return tuple(matches(head, p) for p in fx.SCRIPTS.values())


def latin_ratio(x):
    return ratio(matches(x, "[A-Za-z]"), matches(x, L))


def latin_words(x):
    return found(x, r"[A-Za-z][A-Za-z\x27’-]{2,}")


def structural_text(x):
    """A paragraph without the marks in front of it."""
    return strip(sub(strip(x), r"^\s*(?:#{1,6}\s+|>\s+|[-*]\s+|\d+\.\s+)+", ""))


def is_bibliography(x):
    s = structural_text(x)
    lines = keep(each(cut(s, "\n"), strip), lambda w: w != "")
    listed = keep(lines, lambda w: like(w, r"^(?:\[\d+\]|\d+[.)])\s+"))
    return case((s == "", False), (like(lower(s), fx.URL_OR_DOMAIN), size(latin_words(s)) < 40), other=(matches(doubled(lower(s)), fx.BIBLIOGRAPHY) >= 3) | (size(listed) * 2 >= greatest(size(lines), 1)))


def is_untranslated_body(x):
    s = structural_text(x)
    return all_of(length(s) >= 280, ~like(s, "[А-Яа-яЁё]"), ~is_bibliography(s), matches(s, "[A-Za-z]") * 10 >= matches(s, L) * 8, size(latin_words(s)) >= 30)


def is_untranslated_label(x):
    s = structural_text(x)
    w = latin_words(s)
    lone = member(w, 1)
    letters = (matches(s, L) > 0) & (matches(s, "[A-Za-z]") * 10 >= matches(s, L) * 8)
    return all_of(s != "", ~like(s, "[А-Яа-яЁё]"), letters, (size(w) >= 2) | holds((size(w) == 1) & (length(lone) >= 6) & (lone == upper(lone))))


# ---- what a paragraph that found no counterpart is ----


def is_furniture_text(x):
    s = squeeze(x)
    core = sub(s, r"[()\[\].,:;\s]", "")
    rule = r"^[*•·\-–—\s]+\z"
    short = case((core == "", like(s, rule)), other=any_of(like(core, r"^\p{Nd}+\z"), like(lower(core), r"^[ivxlcdm]+\z"), like(s, rule), like(core, r"^\p{L}\z")))
    return (s != "") & (like(lower(s), fx.CHAPTER_MARKER) | ((length(s) <= 16) & short))


def is_caption_form(x, role):
    s = squeeze(x)
    return (role == "caption") | all_of(s != "", length(s) <= 200, like(lower(s), fx.CAPTION_FORM))


def is_part_divider(x):
    s = squeeze(x)
    return all_of(s != "", length(s) <= 48, like(lower(s), fx.PART_DIVIDER))


def is_body_prose(x):
    s = squeeze(x)
    opening = group(s, r"^[^\p{L}]*(\p{L})", 1)
    return all_of(length(s) >= 140, opening != "", opening != lower(opening), like(s, r"[.!?…»\x22”]\z"))


def is_index_row(x):
    s = squeeze(x)
    run = like(s, r"\d+\s*[–—-]\s*\d+") | has(s, ";")
    return all_of(s != "", length(s) <= 400, ~is_body_prose(s), like(lower(s), r";\s*(?:pp?\.?\s*)?\d") | all_of(like(s, L), run, matches(s, r"\d+") >= 3))


def is_attribution_form(x, role, structural_role):
    s = squeeze(x)
    dashed = all_of(s != "", length(s) <= 90, ~is_body_prose(s), ~like(s, r"[.!?]\z"), like(s, r"^[—–\-]\s*\p{L}"))
    return any_of(structural_role.isin(*fx.QUOTE_ROLES), role.isin(*fx.QUOTE_ROLES), dashed)


def passthrough_form(x, role, structural_role):
    """The first form that lets a paragraph pass without a counterpart, by its text alone; null for none."""
    return case((is_furniture_text(x), "page_furniture"), (is_caption_form(x, role), "caption"), (is_part_divider(x), "part"), (is_attribution_form(x, role, structural_role), "attribution"))


# ---- contents lines ----


def is_page_reference(x):
    s = strip(x)
    return full(s, "[0-9ivxlcdmIVXLCDM]+") | full(s, r"[.·•\-–—\s]+")


def is_label_line(x):
    """Short upper-case labels and numbers only, one label at least, and not the contents' own title."""
    w = keep(each(words(x), lambda v: strip(v, ".()[]{}'\"“”‘’,:;!?-–—/")), lambda v: ~like(v, r"^(?:[IVXLCDM]*|\d+)\z") & like(v, L))
    letters = lambda v: sub(v, r"[^\p{L}]", "")
    wrong = keep(w, lambda v: any_of(letters(v) != upper(letters(v)), v == "CONTENTS", length(letters(v)) < 2, length(letters(v)) > 10))
    return (size(w) >= 1) & (size(wrong) == 0)


def is_substantive(x):
    s = strip(x)
    return all_of(s != "", ~is_page_reference(s), like(s, W))


def has_page_suffix(x):
    return like(strip(x), fx.PAGE_SUFFIX)


# ---- hygiene of headings ----


def is_long_title(x):
    w = found(x, "[A-Za-zА-Яа-яЁё]+")
    titled = size(keep(w, lambda v: like(v, r"^\p{Lu}")))
    return any_of(
        like(x, r":\z"),
        like(lower(x), rf"^(?:appendix|index){EDGE}"),
        like(x, r"(?:[1-3]\s*)?[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё]+\s+\d{1,3}:\d{1,3}"),
        all_of(~like(x, "[.!?]"), size(w) > 0, titled >= 3, titled * 10 >= size(w) * 7),
    )


def is_heading_body_concat(x):
    s = strip(x)
    return all_of((size(words(s)) > 18) | (length(s) > 140), ~is_long_title(s), like(s, r"[.!?]\s+[a-zа-яё]") | (matches(s, r"[.!?]\s+[A-ZА-ЯЁa-zа-яё]") >= 2))


def is_epigraph_heading(x, before):
    """A heading that looks like who said something."""
    s = strip(x)
    chapter = like(lower(s), rf"(?:^|[^\p{{L}}\p{{N}}_])(?:chapter|глава|part|section){EDGE}") | like(lower(s), rf"^(?:\d+|[ivxlcdm]+){EDGE}")
    return all_of(s != "", size(words(s)) <= 12, length(s) <= 90, ~chapter, like(s, fx.DASH_ATTRIBUTION) | like(s, fx.NAME_ROLE))


def is_structural_label(x):
    s = strip(x)
    return like(lower(s), fx.NUMBERED_LABEL) | like(s, fx.ORDERED_LABEL)


# ---- output of a block against its source ----


def lines_of(x):
    return keep(each(cut(x, "\n"), strip), lambda w: w != "")


def is_heading_only(x):
    n = size(lines_of(x))
    return (n > 0) & (size(keep(lines_of(x), lambda w: like(w, r"^#{1,6}\s+\S"))) == n)


def has_body(x):
    """Two lines that are no headings, or a long or punctuated one."""
    body = keep(lines_of(x), lambda w: ~like(w, r"^#{1,6}\s+\S"))
    lone = member(body, 1)
    return (size(body) >= 2) | holds((size(body) == 1) & ((length(lone) >= 40) | ((size(words(lone)) >= 5) & like(lone, "[.,;:!?]"))))


def is_source_again(source, output):
    s = strip(source)
    return all_of(source == output, length(s) >= 120, ~like(s, "[А-Яа-яЁё]"), matches(s, "[A-Za-z]{4,}") >= 12)


def has_bullet_heading(x):
    return size(keep(lines_of(x), lambda w: like(w, r"^#{1,6}\s*[●•\-*]\s*\z"))) > 0


def has_english_residue(x):
    """A Cyrillic text with one of the structural words left in English."""
    hits = keep(found(lower(x), "[a-z]{4,}"), lambda w: w.isin(*fx.RESIDUAL_WORDS))
    return like(x, "[А-Яа-яЁё]") & (size(hits) > 0)


def is_toc_concat(source, output):
    marked = has_page_suffix(source) | has(lower(source), "contents") | has(lower(source), "содержание")
    return marked & like(output, fx.TOC_BODY_CONCAT)


def block_verdict(source, output):
    """What is wrong with a block's output, the first that holds, or valid."""
    return case(
        (strip(output) == "", "empty"),
        (is_source_again(source, output), "source_text_fallback"),
        (has_bullet_heading(output), "bullet_heading_output"),
        (is_heading_only(output) & has_body(source), "heading_only_output"),
        (is_toc_concat(source, output), "toc_body_concat"),
        (has_english_residue(output), "english_residual_output"),
        other="valid",
    )


def source_ends_sentence(x):
    """Three-valued: null for a text with nothing left before its closing marks."""
    s = x
    for _ in range(3):
        s = sub(rstrip(s), r"(?:[»”’\x22\x27)\]}*]|</u>|</sup>|</sub>)+\z", "")
    s = rstrip(s)
    return case((s != "", like(s, r"[.!?…]\z")))


def left_incomplete(x):
    s = strip(sub(strip(x), r"^#{1,6}\s+", ""))
    return (s != "") & any_of(like(s, r"[(\[{\-—–:,]\z"), ~like(s, r"[.!?…:](?:[)\]»”’\x27\x22])?\z"), like(lower(s), r"(?:^|[^\p{L}\p{N}_])(?:ли|что|относительно|с|в|на|к|по|для|о|у|при|об|под|над|между|является)\z"))


# ---- spans and soft wraps ----


def continues_wrap(before, x):
    """Whether a line goes on with the sentence of the line before."""
    s = lstrip(x)
    goes_on = any_of(like(s, r"^\p{Ll}"), like(s, r"^[,.;:)\]}»”]"), like(s, "^[-–—]") & ~like(s, r"^[–—-]\s+\S+"))
    return all_of(before != "", x != "", ~like(before, r"[.!?;:»”\x22\x27]\z"), ~like(x, r"^(?:[-*•●]|\d+[.)])\s+.+"), goes_on)


def control_form(x):
    """Form of a paragraph, first match."""
    s = strip(x)
    letters = matches(s, "[A-Za-zЀ-ӿ]")
    w = found(s, "[A-Za-zЀ-ӿ][A-Za-zЀ-ӿ\\x27’]*")
    digits = matches(s, r"\d")
    return case(
        (like(s, r"\[\[DOCX_(?:IMAGE|PARA)_[^\]]*\]\]"), "markup_placeholder"),
        (letters == 0, "no_letters_at_all"),
        (like(lower(s), fx.CONTROL_URL), "url_or_domain"),
        (letters < 20, "under_20_letters"),
        ((digits * 10 >= length(s)) & (like(s, r"\d+\s*[–—-]\s*\d+") | (matches(s, "[,;]") >= 3)), "numeric_reference_row"),
        (all_of(size(w) > 0, size(keep(w, lambda v: v != upper(v))) == 0, size(w) <= 8), "acronym_or_allcaps"),
        (all_of(size(w) > 0, ~like(s, r"[.!?…]\z"), size(w) <= 12, size(keep(w, lambda v: like(v, r"^\p{Lu}"))) * 10 >= size(w) * 6), "titlecase_name_run"),
        other="running_text_shape",
    )


def citation_signals(x):
    s = strip(x)
    return case((matches(doubled(lower(s)), fx.BIBLIOGRAPHY) > 0, 1), other=0) + case((has(s, "«") | has(s, "»"), 1), other=0)


def paragraph_words(count):
    """The Russian word for so many paragraphs."""
    tens, ones = count % 100, count % 10
    return case(((tens >= 11) & (tens <= 14), "абзацев"), (ones == 1, "абзац"), ((ones >= 2) & (ones <= 4), "абзаца"), other="абзацев")


def coerced_flag(x):
    """Words for yes and no as a boolean; null for others."""
    s = lower(strip(x))
    return case((s.isin("1", "true", "yes", "on"), True), (s.isin("0", "false", "no", "off"), False))


def first_letter_case(x):
    return case((like(first(x), r"\p{Lu}"), "upper"), (like(first(x), r"\p{Ll}"), "lower"), other="other")


def token_set(x):
    return unique(found(lower(x), f"{W}+"))


def last_mark(x):
    return last(strip(x))


def after(x, n: int):
    return behind(x, n)


def language_script(code):
    return case(*[(lower(strip(code)) == k, v) for k, v in fx.LANGUAGE_SCRIPTS.items()])
