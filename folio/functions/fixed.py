"""Word lists, patterns and limits that must be these for right results."""

# ---- fixed values, in the order of the rules that use them ----

BODY_STYLES = ("", "normal", "body text", "текст", "обычный")
COMPATIBLE_ALIGNMENTS = ("left", "start", "both")
STRUCTURED_ALIGNMENTS = ("center", "right", "end")
CONTINUATION_WORDS = ("и", "а", "но", "или", "что", "как", "поэтому", "and", "but", "or", "that", "which")
TITLE_STOPWORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "is", "of", "on", "or", "the", "through", "to", "vs", "versus", "with")
TOC_HEADERS = ("contents", "table of contents", "содержание")
BLANK_PHRASES = ("this page intentionally left blank", "эта страница намеренно оставлена пустой", "page intentionally left blank", "intentionally blank", "intentionally left blank")
BOILERPLATE = ("confidential", "draft", "copyright", "all rights reserved", "конфиденциально", "черновик", "все права защищены")
PROTECTED_ROLES = ("heading", "caption", "list", "table", "image")
PROTECTED_STRUCTURAL = ("toc_header", "toc_entry", "epigraph", "attribution", "dedication")
QUOTE_ROLES = ("epigraph", "attribution", "dedication")
TOC_ROLES = ("toc_header", "toc_entry")
BACK_MATTER = ("notes", "endnotes", "footnotes", "references", "bibliography", "index", "sources", "works cited", "further reading", "примечания", "библиография", "указатель", "источники", "литература", "сноски", "список литературы", "именной указатель", "предметный указатель")
RESIDUAL_WORDS = ("chapter", "contents", "introduction", "conclusion", "judgment")
HOMOGLYPHS = ("aeocpxyAEOCPXY", "аеосрхуАЕОСРХУ")
GLYPHS = "●•◦‣"
FATAL_REASONS = ("untranslated_body_text_above_threshold", "caption_heading_conflict")
LANGUAGE_SCRIPTS = {"ru": "cyrillic", "en": "latin", "de": "latin", "fr": "latin", "es": "latin", "it": "latin", "pl": "latin", "zh": "cjk", "ja": "cjk"}
SCRIPTS = {
    "latin": r"[A-Za-z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]",
    "cyrillic": r"[\x{400}-\x{4FF}\x{500}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}\x{1C80}-\x{1C8F}]",
    "cjk": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}]",
}

PAGE_NUMBERS = (r"\d{1,4}", r"[\-–—]\s*\d{1,4}\s*[\-–—]", r"(?:page|p\.)\s+\d{1,4}", r"(?:стр\.|с\.)\s*\d{1,4}", r"\d{1,4}\s*/\s*\d{1,4}", r"\d{1,4}\s+of\s+\d{1,4}")
BLOCK_PAGE_NUMBER = r"\(?\d{1,4}\)?|[Pp]age\s+\d{1,4}|стр\.\s*\d{1,4}"
BLOCK_BLANK_PAGE = r"blank\s+page|this page intentionally left blank"
ORPHAN_FOOTNOTE = r"\[?\d{1,3}\]?|\(\d{1,3}\)"
FOOTNOTE_BODY = r"^(?:\[\d{1,3}\]|\(\d{1,3}\))\s+\S"
ARTIFACT = r"\[\[docx_[a-z0-9_]+\]\]|\[\[image_[a-z0-9_]+\]\]|</?placeholder>|---+|===+"
URL_OR_EMAIL = r"https?://|www\.|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}"
TOC_LEADER = r"(?:\.{3,}|…{2,})\s*\d{1,4}\s*\z"
TOC_INDEX_REFERENCE = r"[,;]\s+\d{1,3}(?:[nн]\d{1,3})?(?:[^\p{L}\p{N}_]|\z)"
TOC_PAGE_RANGE = r"(?:^|[^\p{L}\p{N}_])\d{1,3}\s*[–—−]\s*\d{1,3}(?:[^\p{L}\p{N}_]|\z)"
ROMAN_PAGE = r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
ENTRY_TRIM = "«»\"'“”„‟()[]{}.,;:!?—–-*_"
# Counted in text whose every non-word character stands twice, so that neighbours don't share one.
BIBLIOGRAPHY = r"(?:^|[^\p{L}\p{N}_])(?:(?:doi|isbn|issn|references|bibliography|press|journal|\d{4})(?:[^\p{L}\p{N}_]|\z)|(?:vol|pp)\.\.[\p{L}\p{N}_])"
URL_OR_DOMAIN = r"https?://|www\.|[a-z0-9.-]+\.(?:com|org|net|edu|gov|info|io|co)(?:[^\p{L}\p{N}_]|\z)"
CAPTION_FORM = r"^(?:figure|fig|рисунок|рис|table|табл(?:ица)?|схема|диаграмма|chart|plate|photo|иллюстрация|илл)\.?\s*\d+"
PART_DIVIDER = r"^(?:part|часть)\s+(?:\d+|[ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|первая|вторая|третья|четвёртая|четвертая|пятая|шестая|седьмая|восьмая|девятая|десятая)(?:[^\p{L}\p{N}_]|\z)"
CHAPTER_MARKER = r"^(?:chapter|глава)\s+(?:\d+|[ivxlcdm]+)[ .:\-]*\z"
CHAPTER_BODY = r"^(?:chapter|глава)\s+(?:\d+|[ivxlcdm]+)\s*[—\-–:]\s*\S"
NUMBERED_LABEL = r"^\s*(?:#{1,6}\s+)?(?:chapter|глава|part|section|book|volume|том|часть|раздел)\s+(?:\d{1,3}|[ivxlcdm]{1,8})\.?\s*\z"
ORDERED_LABEL = r"^\s*(?:#{1,6}\s+)?\d{1,2}[.)]\s+\S.{0,80}\z"
TOC_BODY_CONCAT = r"(?:\.{2,}|[․‥…‧∙⋅·]{2,}|\s{2,})\s*[0-9ivxlcdmIVXLCDM]+\s+[А-Яа-яЁёA-Za-z]"
PAGE_SUFFIX = r"(?:\.{2,}|\s{2,})\s*[0-9ivxlcdmIVXLCDM]+\s*\z"
DASH_ATTRIBUTION = r"^(?:--|—)\s*[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё\x27’.\-]*(?:\s+[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё\x27’.\-]*){0,4},\s*[A-Za-zА-Яа-яЁё][^!?\n]{1,80}\z"
NAME_ROLE = r"^[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё\x27’.\-]*(?:\s+[A-ZА-ЯЁ][A-Za-zА-Яа-яЁё\x27’.\-]*){0,4},\s*[A-Za-zА-Яа-яЁё][^.!?0-9\n]{1,80}\z"
CONTROL_URL = r"https?://|www\.[a-z0-9-]+\.|[a-z0-9-]+\.(?:com|net|org|ru)(?:[^\p{L}\p{N}_]|\z)|doi\.org"
