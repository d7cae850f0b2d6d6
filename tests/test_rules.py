"""Rules on small cases with known answers, Cyrillic included."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import align, edits, jobs
from folio.operators import sequences as sq
from folio.operators import statistics as st
from folio.operators import structure as su

PARA = "doc_id long, pos int, text string, style_name string, alignment string, font_size double, is_bold boolean, page int, layout_origin string, list_kind string, heading_level int, role string, structural_role string, asset_id string, paragraph_id string"


def paras(spark, *rows):
    """Rows of (text, and what differs from plain body)."""
    out = []
    for at, row in enumerate(rows):
        text, more = row if isinstance(row, tuple) else (row, {})
        d = {"style_name": "Normal", "font_size": 11.0, "is_bold": False, "page": 0, "layout_origin": "paragraph", "role": "body", "structural_role": "body", "paragraph_id": f"p{at}"} | more
        out.append((1, at, text, d["style_name"], d.get("alignment"), d["font_size"], d["is_bold"], d["page"], d["layout_origin"], d.get("list_kind"), d.get("heading_level"), d["role"], d["structural_role"], d.get("asset_id"), d["paragraph_id"]))
    return spark.createDataFrame(out, PARA)


def value(spark, make, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return [r.v for r in rows.select("k", make(F.col("text")).alias("v")).orderBy("k").collect()]


CASES = [
    (tx.ends_terminal, {"Конец.": True, "Why?  ": True, "open": False, "list:": False, "…": True}),
    (tx.ends_incomplete, {"Он сказал": True, "word,": True, "done.": False, "": False, "quote”": False, "cut-": True}),
    (tx.starts_continuation, {"продолжение": True, "Новая мысль": False, "«в кавычках": True, "И так": True, "and so": True, "Which one": True, "7 days": True, "— тире": True, "The": False}),
    (tx.starts_sentence, {"Второй абзац": True, "второй": False, "«Слово": True, "Chapter 2": True, "2. point": True}),
    (tx.heading_signal, {"Глава 3": True, "Chapters": False, "Chapter 3": True, "1.2 Scope": True, "Note: read this": True, "a: b.": False, "plain words": False}),
    (tx.is_toc_entry, {"Введение .....7": True, "Введение ..... 7": False, "Title  12": True, "ends in 12": False, "x" * 121 + "....3": False}),
    (tx.is_attribution, {"— Эпиктет": True, "- name": True, "name": False, "—" + "x" * 130: False}),
    (tx.is_caption, {"Рис. 3 схема": True, "Figure 1": True, "fig.2": True, "Figures of speech": False, "Табличка": False, "Таблица 2": True}),
    (tx.is_page_number, {"12": True, "- 12 -": True, "Page 4": True, "стр. 5": True, "12 / 40": True, "3 of 9": True, "Chapter 12": False, "12345": False}),
    (tx.is_blank_notice, {"This page  intentionally left blank": True, "blank": False}),
    (tx.list_kind, {"- a": "unordered", "• b": "unordered", "+ c": None, "3) d": "ordered", "3.d": None}),
    (tx.layout_key, {"[a](b) x.y": "a b x.y", "**Wrapped**": "wrapped", "  - Title - ": "title", "“Q” — it’s": "\"q\" - it's", "Глава: ": "глава"}),
    (tx.mapping_key, {"## 1. **Bold** [t](u)": "bold t", "> - Слово": "слово", "*** 12.": "12.", "● 3.": "●", "one two 3.": "one two 3."}),
    (tx.strip_list_prefix, {"- 1. * text": "text", "12) **a** [b](c)": "a b"}),
    (tx.outline_key, {"Введение ..... 7": "введение", " Part One. ": "part one", "Title 12": "title"}),
    (tx.toc_key, {"Intro ....  12": "intro ... 12", "«Глава»": "глава"}),
    (tx.running_header, {"The Common Header": "the common header", "12": None, "a b c d e f": None, "| Книга |": "книга"}),
    (tx.halve_repeated, {"## Red Fox red fox": "## Red Fox", "red fox red fox": "red fox red fox", "# a b c": "# a b c"}),
    (tx.homoglyphs, {"домoв": "домов", "`кoд`": "`кoд`", "сайт https://a.bв": "сайт https://a.bв", "plain": "plain"}),
    (tx.bullets, {"● item": "- item", "a ● b": "a b", "4●5": "4●5", "# ● h": "# ● h", "one, ● two": "one, two"}),
    (tx.blank_page_split, {"this page intentionally left blank Chapter 3 Go": "this page intentionally left blank\n\nChapter 3 Go", "## This page intentionally left blank Глава 2": "This page intentionally left blank\n\n## Глава 2", "other": "other"}),
    (tx.identity_component, {"Книга №1 / том": "Книга_1_том", "__a--b__": "a--b", "!!!": ""}),
    (tx.visible_text, {"## **Bold** [[DOCX_IMAGE_img_1]] _it_": "Bold it", "snake_case": "snake_case"}),
    (tx.unwrapped, {"***x***": "x", "**a**": "a", "plain": "plain"}),
    (tx.is_toc_like, {"Preface ...... 3": True, "1, 5-9, 12": True, "Alpha, 12, 15; 19": True, "5–9 12–15 20–21": True, "In 1990 value was 5 and in 2000 rose to 10": False, "He paid  12": False, "Крах денег 11 Миф 23 Итог 40": True, "Предисловие ix Введение 1": True}),
    (tx.block_kind, {"": "empty", "# h": "heading", "[[DOCX_IMAGE_img_1]]": "docx_image_anchor", "(12)": "page_number", "This page intentionally left blank": "blank_page_marker", "[12]": "orphan_footnote_marker", "[12] note": "footnote_body", "---": "extraction_artifact", "> q": "blockquote", "- l": "list", "2. l": "list", "+ x": "paragraph", "prose ends in  12": "paragraph"}),
    (tx.is_untranslated_label, {"Two Words": True, "ABSTRACT": True, "Word": False, "Слово here now": False}),
    (tx.is_furniture_text, {"12": True, "xiv": True, "* * *": True, "Глава 3": True, "A": True, "Ok": False}),
    (tx.is_part_divider, {"Part One": True, "Часть вторая: начало": True, "Partial": False}),
    (tx.is_index_row, {"Alpha, 12; 15": True, "Beta 3-5, 9": True, "plain": False}),
    (tx.is_page_reference, {"xii": True, "···": True, "page": False}),
    (tx.is_label_line, {"NATO": True, "CONTENTS": False, "Nato": False, "12": False, "API IV": True}),
    (tx.source_ends_sentence, {"Да.»": True, "так": False, "**end.**": True, "»": None, "<u>Да.</u>": True}),
    (tx.left_incomplete, {"Он сказал, что": True, "Done.": False, "open (": True}),
    (tx.control_form, {"12": "no_letters_at_all", "short": "under_20_letters", "see www.site-name.org for the whole list": "url_or_domain", "UNITED NATIONS GENERAL ASSEMBLY": "acronym_or_allcaps", "This is plain running text of a book.": "running_text_shape"}),
    (tx.is_structural_label, {"Chapter 12": True, "3. A label": True, "Chapter and verse": False}),
    (tx.is_long_title, {"Title ends with colon:": True, "Appendix A": True, "words only here": False}),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_rule(spark, at):
    make, want = CASES[at]
    assert dict(zip(want, value(spark, make, *want), strict=True)) == want


def test_merging_joins_what_a_page_broke(spark):
    rows = paras(spark, "повторяющимися моделями", "поведения во времени .", "Новая мысль закончена.", "Ещё одна начата", ("Первый пункт", {"style_name": "List Number", "list_kind": "ordered", "role": "list"}))
    got = sorted(tuple(r) for r in sq.merge_chains(rows).select("first_pos", "n_rows", "text").collect())
    assert got[0] == (0, 2, "повторяющимися моделями поведения во времени.") and [x[0] for x in got] == [0, 2, 3, 4]
    why = {r.pos: (r.decision, r.confidence, r.reasons) for r in sq.boundary_decisions(rows).collect()}
    assert why[0][:2] == ("merge", "high") and why[1] == ("keep", "blocked", "terminal_punctuation_sentence_reset") and "list_metadata" in why[3][2]
    heading = paras(spark, ("Глава 1", {"style_name": "Heading 1", "heading_level": 1, "role": "heading"}), "основной текст")
    assert sq.boundary_decisions(heading).first().reasons == "heading_boundary,non_body_role,style_transition"


def test_a_medium_merge_stays_only_as_the_lead_of_a_chain(spark):
    # Upper-case starts: no continuation signal, so the pairs are medium at best.
    rows = paras(spark, "Это особенно важно для", "Устойчивой модели и", "развития в целом.")
    raw = [r.decision + r.confidence for r in sq.boundary_decisions(rows).orderBy("pos").collect()]
    assert raw == ["mergemedium", "mergehigh"]
    assert [r.decision for r in sq.effective_decisions(rows).orderBy("pos").collect()] == ["merge", "merge"]
    alone = paras(spark, "Это особенно важно для", "Устойчивой модели.", "Развития нет.")
    assert [r.decision for r in sq.effective_decisions(alone).orderBy("pos").collect()] == ["keep", "keep"]
    assert sq.effective_decisions(alone, "high_and_medium").orderBy("pos").first().decision == "merge"
    assert {r.decision for r in sq.effective_decisions(rows, "off").collect()} == {"keep"}


def test_layout_cleanup_reasons(spark):
    title = ("The Very Title", {"role": "heading", "heading_level": 1})
    rows = paras(spark, title, "Real body one.", *["www.example.com"] * 3, *["Confidential"] * 3, *["The Very Title"] * 3, *["To be or not."] * 3, "Intro", "Intro", "12", "", "---")
    got = {r.pos: (r.action, r.reason) for r in su.layout_cleanup(rows).collect()}
    assert got[0] == ("keep", "protected_role_keep") and got[2] == ("flag", "repeated_url_footer") and got[5] == ("flag", "repeated_boilerplate_token") and got[8] == ("flag", "repeated_title_header")
    assert got[11] == ("keep", "keep") and got[14] == ("keep", "uncertain_repeated_artifact") and got[16] == ("flag", "page_number_pattern") and got[17] == ("flag", "empty_or_whitespace") and got[18] == ("flag", "extraction_artifact")
    assert su.layout_cleanup(rows, remove=True).where("action = 'remove'").count() == 12


def test_page_furniture_needs_a_scanned_source(spark):
    rows = paras(spark, *[f"Body sentence number {k}." if k % 10 else "STAMP" for k in range(100)])
    assert su.layout_cleanup(rows).where("reason = 'repeated_page_furniture'").count() == 0
    assert su.layout_cleanup(rows, scanned=True).where("reason = 'repeated_page_furniture' AND action = 'remove'").count() == 10
    assert [r.n for r in su.page_furniture(rows).collect()] == [10]


def test_layout_tiers(spark):
    rows = paras(spark, ("Title", {"font_size": 20.0}), ("Sparse", {"font_size": 16.0}), *[(f"Body {k}", {"font_size": 12.0, "page": k // 4}) for k in range(8)])
    got = {r.pos: (r.tier, r.is_heading_tier, r.first_on_page) for r in su.layout_tiers(rows).collect()}
    assert got[0] == (1, True, False) and got[1] == (-1, False, False) and got[2][0] == 0 and got[6][2]
    few = paras(spark, *[("x", {"font_size": 12.0})] * 7)
    assert {r.tier for r in su.layout_tiers(few).collect()} == {-1}


def test_blocks_keep_headings_with_what_follows(spark):
    h = lambda t, n: (t, {"role": "heading", "heading_level": n})
    blocks = lambda rows, most: [r.block for r in jobs.semantic_blocks(rows, su.relations(rows), most).orderBy("unit").collect()]
    short = paras(spark, h("Глава 1", 1), "Короткий абзац.", "x" * 80)
    assert blocks(short, 70) == [0, 0, 1]
    chain = paras(spark, h("Глава 1", 1), h("Раздел 1.1", 2), "y" * 50, "z" * 70)
    assert blocks(chain, 90) == [0, 0, 0, 1]
    quote = paras(spark, h("Глава 1", 1), ("q" * 70, {"structural_role": "epigraph"}), ("— Эпиктет", {"structural_role": "attribution"}), "w" * 30)
    assert blocks(quote, 65) == [0, 0, 1]
    toc = paras(spark, ("Содержание", {"structural_role": "toc_header"}), ("Глава 1 ...... 12", {"structural_role": "toc_entry"}), ("Глава 2 ...... 18", {"structural_role": "toc_entry"}), "Первый абзац.")
    assert blocks(toc, 60) == [0, 1]
    image = paras(spark, "Вступление", ("[[DOCX_IMAGE_img_001]]", {"role": "image", "asset_id": "a"}), "Текст")
    made = jobs.editing_jobs(image, su.relations(image), 6000).orderBy("block").collect()
    assert [r.job_kind for r in made] == ["llm", "passthrough", "llm"] and made[1].before_chars == len("Вступление") and made[1].after_chars == len("Текст")


def test_relations(spark):
    rows = paras(spark, ("[[DOCX_IMAGE_img_1]]", {"role": "image", "asset_id": "a"}), "Рис. 1 схема", ("loose", {"role": "caption"}), ("q", {"structural_role": "epigraph"}), ("— кто", {"structural_role": "attribution"}), ("Contents", {"structural_role": "toc_header"}), ("A .... 1", {"structural_role": "toc_entry"}), "x", ("B .... 2", {"structural_role": "toc_entry"}))
    got = {(r.kind, r.first_pos): (r.decision, r.reason, r.relation_id) for r in su.relations(rows).collect()}
    assert got["image_caption", 0] == ("accept", "adjacent_asset_caption", "rel_0001") and got["caption_attachment", 2][1] == "caption_not_adjacent_to_asset"
    assert got["epigraph_attribution", 3][2] == "rel_0002" and got["toc_region", 5] == ("accept", "toc_header_with_entries", "rel_0003") and got["toc_region", 8][1] == "isolated_toc_entry"


def test_structure_report(spark):
    rows = paras(spark, *["four words stand here"] * 4, "•", "A long line of body text that has more than twelve words in it, so no entry.", ("ALL CAPS LINE", {}))
    got = su.structure_report(rows).first()
    assert got.toc_sequences == 1 and got.isolated == 1 and got.risk == "high" and got.readiness == "blocked_unsafe_best_effort_only" and "toc_like_sequence_detected" in got.reasons


def test_segments_and_parents(spark):
    h = lambda t, n: (t, {"role": "heading", "heading_level": n})
    rows = paras(spark, "Preface", h("Chapter 1", 1), "a", h("1.1 Part", 2), "b" * 30_000, "c", h("References", 1), "d")
    got = jobs.segments(rows, 10).orderBy("ordinal").collect()
    assert [(r.first_pos, r.last_pos, r.level, r.role, r.confidence) for r in got] == [(0, 0, 1, "front_matter", "medium"), (1, 2, 1, "chapter", "high"), (3, 3, 2, "section", "high"), (4, 4, 3, "section", "low"), (5, 5, 3, "section", "low"), (6, 7, 1, "bibliography", "high")]
    assert {r.ordinal: r.parent for r in jobs.parents(jobs.segments(rows, 10)).collect()} == {1: None, 2: None, 3: 2, 4: 3, 5: 3, 6: None}


def test_edit_rules(spark):
    from folio.sources.tables import blocks

    texts = ["# Start", "12", "The Header", "Body text that is long enough to stay.", "The Header", "[3] a footnote", "The Header", "77", "End of it all"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, pos int, text string")
    made = blocks(rows).join(rows, ["doc_id", "pos"])
    log = made.select("doc_id", "pos", F.col("pos").alias("seq"), F.lit("delete_block").alias("operation"), F.when(F.col("kind") == "page_number", "page_number").otherwise("repeated_running_header").alias("reason"), F.lit("high").alias("confidence"), F.when(F.col("pos") == 3, "bad").otherwise(F.col("text_hash")).alias("text_hash"))
    got = {r.pos: r.refused for r in edits.validated(made, log).collect()}
    assert got == {0: "missing_repetition_evidence", 1: None, 2: None, 3: "text_hash_mismatch", 4: None, 5: "footnote_body_protected", 6: None, 7: None, 8: "missing_repetition_evidence"}
    cost = edits.safety(made, log.where("pos IN (1, 2, 4, 6, 7)")).first()
    assert cost.n_deleted == 5 and cost.longest_run == 2 and cost.violates
    ops = spark.createDataFrame([(1, 3, "split_block", ["Body text that is long", "enough to stay."], None, None), (1, 0, "delete_block", None, None, None), (1, 8, "remove_inline_noise", None, "all", None)], "doc_id long, pos int, operation string, parts array<string>, noise string, next_hash string")
    out = {r.pos: (r.outcome, r.text) for r in edits.applied(made, ops).collect()}
    assert out[3] == ("split", "Body text that is long\n\nenough to stay.") and out[0] == ("deleted", None) and out[8][0] == "not_applicable" and out[1] == ("none", "12")


def test_alignment_passes_see_only_what_is_left(spark):
    source = spark.createDataFrame([(1, 0, "First text", "body", "body"), (1, 1, "[[DOCX_IMAGE_img_1]]", "image", "body"), (1, 2, "Figure 1 here", "body", "body"), (1, 3, "Same", "body", "body"), (1, 4, "Same", "body", "body"), (1, 5, "Toc .... 1", "body", "toc_entry")], "doc_id long, pos int, text string, role string, structural_role string")
    target = spark.createDataFrame([(1, 0, "FIRST text"), (1, 1, "[[DOCX_IMAGE_img_1]]"), (1, 2, "Figure 1 there"), (1, 3, "same"), (1, 4, "same"), (1, 5, "Оглавление .... 1")], "doc_id long, target int, text string")
    declared = spark.createDataFrame([(1, 0, 0)], "doc_id long, pos int, target int")
    got = {r.pos: (r.target, r.strategy) for r in align.aligned(source, target, declared).collect()}
    assert got == {0: (0, "paragraph_id_rebuild_key"), 1: (1, "exact_text"), 3: (3, "positional_exact"), 4: (4, "positional_exact"), 5: (5, "positional_toc_fallback")}


def test_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 1, 2, 9, 10, 10)] + [("b", 1.0), ("b", 5.0), ("c", None)], "g string, v double")
    assert {r.g: r.threshold for r in st.otsu(rows, "g", "v").collect()} == {"a": 5.5, "b": 5.0}
    got = {r.g: (r.n, r.low, r.mid) for r in st.nearest_rank(rows, "g", "v", {"low": 0.0, "mid": 0.5}).collect()}
    assert got == {"a": (6, 1.0, 2.0), "b": (2, 1.0, 1.0)}
