"""Small cases worked out by hand."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import expressions as X
from foliant.functions import rules
from foliant.functions.packing import word_count
from foliant.operators import answers, catalog, compare, search, structure
from foliant.sources import files


def test_fusion_keeps_the_vector_order_on_ties(spark):
    v = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "id string, rank int")
    k = spark.createDataFrame([("B", 1), ("D", 2), ("A", 3)], "id string, rank int")
    assert [r["id"] for r in search.fuse(v, k, key="id").collect()] == ["B", "A", "D", "C"]


def test_budget_skips_what_does_not_fit(spark):
    rows = [(1, i, i, c) for i, c in enumerate([40, 50, 30, 20, 5])]
    got = answers.pack_budget(spark.createDataFrame(rows, "q int, rank int, source_id int, cost int"), "q", 100).first()
    assert (got["used"], got["chosen"]) == (95, [0, 1, 4])


def test_contained_sources_go(spark):
    rows = [(1, 1, 3.0, "The cat  sat"), (1, 2, 2.0, "cat"), (1, 3, 1.0, "a dog"), (1, 4, 0.5, " ")]
    assert answers.drop_contained(spark.createDataFrame(rows, "q int, source_id int, score double, text string"), "q").first()["kept"] == [1, 3]


def test_every_source_of_a_group_comes_in_question(spark):
    rows = [(1, i, float(-i), f"text number {i:03d} " * 3) for i in range(50)] + [(1, 50, -50.0, "TEXT  number 049"), (2, 0, 1.0, None)]
    got = {r["q"]: r["kept"] for r in answers.drop_contained(spark.createDataFrame(rows, "q int, source_id int, score double, text string"), "q").collect()}
    assert got == {1: list(range(50)), 2: []}
    costs = spark.createDataFrame([(1, i, i, 1) for i in range(50)], "q int, rank int, source_id int, cost int")
    assert answers.pack_budget(costs, "q", 100).first()["chosen"] == list(range(50))


def test_upserts_take_one_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "x", 3), (2, "y", 5), (2, "z", 4), (3, "p", 1), (3, "q", 1)], "k int, v string, at int")
    assert {tuple(r) for r in catalog.upsert(old, new, ["k"], ["at"]).collect()} == {(1, "a", 0), (2, "y", 5), (3, "q", 1)}
    assert {tuple(r) for r in catalog.insert_ignore(old, new, ["k"], ["at"]).collect()} == {(1, "a", 0), (2, "b", 0), (3, "p", 1)}


@pytest.mark.parametrize("most", [1 << 14, 5])
def test_greedy_match_agrees_with_one_ordered_pass(spark, monkeypatch, most):
    monkeypatch.setattr(compare, "ONE_PASS", most)
    random.seed(4)
    rows = [(p, i, j, random.randint(80, 99) / 100) for p in range(6) for i in range(9) for j in range(8) if random.random() < 0.7]
    rows += rows[:20] + [(7, i, i + d, 0.9 + (2 * i + d) / 1000) for i in range(12) for d in (0, 1)] + [(8, None, 1, 0.9), (8, 1, 1, None), (9, 1, 1, 0.5)]
    want = set()
    for p in range(10):
        used_a, used_b = set(), set()
        for s, i, j in sorted({(s, i, j) for q, i, j, s in rows if q == p and None not in (i, s) and s >= 0.86}, reverse=True):
            if i not in used_a and j not in used_b:
                want.add((p, i, j, s))
                used_a.add(i)
                used_b.add(j)
    got = [tuple(r) for r in compare.greedy_match(spark.createDataFrame(rows, "pair long, a_order int, b_order int, score double")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert compare.greedy_match(spark.createDataFrame([], "pair long, a_order int, b_order int, score double")).count() == 0


def test_sections_align_in_passes_and_fall_back_to_whole_documents(spark):
    ddl = "pair long, sort_order int, number string, title string, text string"
    a = [(1, 1, "1", "Purpose", "same"), (1, 2, "3.1", "Leave", "five days of leave"), (1, 3, None, "Data Use!", "x"), (1, 4, "9", "Old", "gone"), (1, 5, "7", "Near", "near one"), (2, 1, "1", "A", "all of it"), (3, 1, "1", "Same", None)]
    b = [(1, 1, "1", "Aim", "same"), (1, 2, "3.1", "Leave", "Six days of leave"), (1, 3, None, "data use", "y"), (1, 4, "5", "Security", "new"), (1, 5, "8", "Close", "near two")]
    b += [(2, i, str(i + 1), f"B{i}", f"part {i}") for i in (2, 1, 3)] + [(3, 1, "1", "Same", None)]
    a, b = spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)
    scores = spark.createDataFrame([(1, 5, 5, 0.9), (1, 4, 5, 0.88), (1, 1, 4, 0.99), (1, 4, 4, 0.5)], "pair long, a_order int, b_order int, score double")
    aligned = compare.align(a, b, scores)
    methods = {(r["pair"], r["a_order"], r["b_order"]): r["method"] for r in aligned.collect()}
    assert methods == {(1, 1, 1): "number", (1, 2, 2): "number", (1, 3, 3): "title", (1, 5, 5): "similarity", (1, 4, None): "removed", (1, None, 4): "added", (2, None, None): "whole_document", (3, 1, 1): "number"}
    got = {(r["pair"], r["a_order"], r["b_order"]): (r["change"], r["proportion"], r["severity"]) for r in compare.section_changes(aligned, a, b, ["security"]).collect()}
    assert got == {
        (1, 2, 2): ("MODIFIED", 0.5, "MODERATE"), (1, 3, 3): ("MODIFIED", 1.0, "MODERATE"), (1, 5, 5): ("MODIFIED", 1.0, "MODERATE"), (1, 4, None): ("REMOVED", 1.0, "MODERATE"),
        (1, None, 4): ("ADDED", 1.0, "MAJOR"), (2, None, None): ("MODIFIED", 1.0, "MODERATE"),
    }
    assert compare.word_change_share("", None) == 1.0 and compare.word_change_share("A b", "a B") == 0


def test_nearest_of_a_query_set(spark):
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)], i % 4) for i in range(120)] + [(200, [0.0] * 6, 1), (None, [1.0] * 6, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v, _ in rows[:120]}
    want = {(i, j) for i in range(0, 120, 10) for j in sorted((j for j in unit if j % 4 != i % 4), key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:3]}
    for block in (7, 500):
        got = search.nearest_of_others(vectors.filter("vec_id % 10 = 0"), vectors, 3, block=block).collect()
        assert {(r["vec_id"], r["other_id"]) for r in got if r["vec_id"] != 200} == want and not any(r["vec_id"] == 200 for r in got)


def test_markers_titles_and_controls(spark):
    df = spark.createDataFrame([("x [1] y [SOURCE 12] z [123]\nSOURCE 3: no",)], "t string")
    row = df.select(X.citation_markers(F.col("t")).alias("m"), X.redact_controls(F.col("t")).alias("r"), X.first_line_title(F.col("t")).alias("f")).first()
    assert row["m"] == [1, 12] and row["r"].endswith("\nWARNING[REDACTED CONTROL TOKEN] SOURCE 3: no") and row["f"] == "x [1] y [SOURCE 12] z [123]"


def reference_difference(old, new):
    """Spans, changed words and share by the standard library's matcher."""
    import difflib
    import re

    def normal(t):
        lines = [" ".join(x.split()) for x in (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()

    old, new = normal(old), normal(new)
    if old == new:
        return [], 0, 0.0
    a, b = ([s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()] for t in (old, new))
    spans, changed = [], 0
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        x, y = " ".join(a[i:j]), " ".join(b[k:m])
        spans.append((tag, x, y))
        if tag == "replace":
            changed += sum(q - p + s - r for t, p, q, r, s in difflib.SequenceMatcher(None, x.split(), y.split(), autojunk=False).get_opcodes() if t != "equal")
        elif tag != "equal":
            changed += len(x.split()) + len(y.split())
    most = max(len(old.split()), len(new.split()))
    return spans, changed, round(min(1.0, changed / most), 6) if most else 1.0


def test_matching_blocks_are_the_standard_librarys():
    import difflib

    from foliant.functions import difference as D

    random.seed(8)
    for most in (1 << 20, 30, 0):
        for _ in range(150):
            k = random.choice([1, 2, 3, 12, 200])
            a, b = ([random.randrange(k) for _ in range(random.randint(0, 60))] for _ in range(2))
            if random.random() < 0.4:
                b = a[: random.randint(0, 60)] + b[:5] + a[random.randint(0, 60) :]
            want = [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()][:-1]
            assert D.matching_blocks(np.array(a, np.int64), np.array(b, np.int64), most) == want


def test_differences_are_the_standard_librarys(spark):
    random.seed(9)
    pool = [" ".join(random.choice("one two three four five six".split()) for _ in range(random.randint(1, 9))) + random.choice(".!?") for _ in range(40)]
    rows = []
    for i in range(120):
        a = [random.choice(pool) for _ in range(random.randint(0, 12))]
        b = [s if random.random() < 0.7 else random.choice(pool) for s in a]
        rows.append((i, random.choice([" ", "\n", " \t\r\n\r\n\n"]).join(a), " ".join(b[: random.randint(0, 14)])))
    rows += [(900, None, None), (901, None, "x y"), (902, "A b.  C", "A b. C "), (903, "", " \n"), (904, "same", "same"), (905, "Five days of leave.", "Seven days of leave."), (906, "\u00a0a\u2003b", "a b")]
    got = compare.text_changes(spark.createDataFrame(rows, "doc_id long, old_text string, new_text string")).collect()
    for r in got:
        spans, changed, proportion = reference_difference(r["old_text"], r["new_text"])
        assert ([tuple(s) for s in r["spans"]], r["changed_words"], r["proportion"], r["unchanged"]) == (spans, changed, proportion, not spans), r
    shares = {r["doc_id"]: r["proportion"] for r in got}
    assert shares[905] == 0.5 and shares[901] == 1 and shares[902] == shares[903] == shares[906] == 0


def test_long_texts_that_share_little_take_seconds():
    import time

    from foliant.functions.difference import difference

    random.seed(2)
    words = [f"w{k}" for k in range(3000)] + ["the", "of"] * 200
    a, b = (" ".join(random.choice(words) for _ in range(20000)) for _ in range(2))
    began = time.time()
    spans, changed, most = difference(a, b)
    assert time.time() - began < 20 and len(spans) == 1 and most == 20000
    began = time.time()
    assert difference("a " * 6000 + "b", "a " * 6500)[1] == 501 and time.time() - began < 20


def test_all_documents_are_compared(spark, tmp_path):
    from foliant.plans import texts

    long = [" ".join(f"Sentence {k} of {n}." for k in range(400)) for n in "ab"]
    rows = [(0, long[0]), (5, long[0] + " One more."), (10, long[1]), (15, None), (20, None), (25, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["unchanged"], r["proportion"]) for r in texts.text_difference(spark, str(tmp_path)).collect()}
    want = {i: reference_difference(x, y) for (i, x), (_, y) in zip(rows, [*rows[1:], (30, None)])}
    assert got == {i: (not spans, proportion) for i, (spans, _, proportion) in want.items()}


def test_comparison_rows_and_summary(spark):
    ddl = "pair long, sort_order int, number string, title string, text string"
    a = spark.createDataFrame([(1, 1, "1", "Scope", "a  b."), (1, 2, None, "Pay", "ten days"), (1, 3, "9", None, "gone"), (2, 1, "1", "One", "x")], ddl)
    b = spark.createDataFrame([(1, 1, "1", "Scope", "a b."), (1, 2, None, "Pay", "two days"), (1, 4, None, "", "new"), (2, 1, "1", "One", "x")], ddl)
    aligned = compare.align(a, b)
    verdicts = spark.createDataFrame([(1, "Pay", "MATERIAL")], "pair long, section string, materiality string")
    changes = compare.section_changes(aligned, a, b, ["scope", "9"], verdicts)
    got = {(r["pair"], r["section"]): (r["change"], r["proportion"], r["severity"]) for r in changes.collect()}
    assert got.keys() == {(1, "Pay"), (1, "9"), (1, "section_4")} and got[1, "Pay"][1] == 1.0 and got[1, "9"][2] == "MAJOR" and got[1, "section_4"] == ("ADDED", 1.0, "MODERATE")
    again = compare.section_changes(aligned, a, b, ["scope"], done=spark.createDataFrame([(1, "Pay"), (1, "9")], "pair long, section string"))
    assert {r["section"] for r in again.collect()} == {"section_4"}
    totals = {r["pair"]: r.asDict() for r in compare.comparison_summary(aligned, changes).collect()}
    assert totals[2] == {"pair": 2, "alignment_degraded": False, "total": 0, "major": 0, "moderate": 0, "minor": 0} and totals[1]["total"] == 3


SEGMENTS = "doc_id long, segment int, kind string, section long, page int, end_page int, text string"


def chunked(spark, rows, **limits):
    rows = [(1, i, kind, section, page, page, text) for i, (kind, section, page, text) in enumerate(rows)]
    limits = {"target": 14, "least": 4, "most": 20, "overlap": 2, "count": word_count} | limits
    return structure.chunk(spark.createDataFrame(rows, SEGMENTS), **limits).orderBy("chunk_index").collect()


def test_chunks_stop_at_sections_and_stay_under_the_limit(spark):
    rows = [("heading", 1, 1, "One"), ("paragraph", 1, 1, "alpha beta. " * 5), ("heading", 2, 1, "Two"), ("paragraph", 2, 2, "gamma. " * 30), ("paragraph", None, 3, "delta " * 50)]
    got = chunked(spark, rows)
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and all(r["token_count"] <= 20 for r in got)
    assert got[0]["content"] == "One\n\n" + ("alpha beta. " * 5) and got[1]["section"] == 2 and got[-1]["section"] is None
    assert all(not ("alpha" in r["content"] and "gamma" in r["content"]) for r in got)
    assert {r["forced_split"] for r in got if r["section"] is None} == {True} and sum(r["content"].count("delta") for r in got) >= 50


def test_overlap_is_last_paragraphs_or_whole_sentences(spark):
    rows = [("paragraph", 1, 1, "a b c d e f g. h i."), ("paragraph", 1, 2, "j k."), ("paragraph", 1, 2, "l m n o p q.")]
    got = chunked(spark, rows, target=16, least=0)
    assert [r["content"] for r in got] == ["a b c d e f g. h i.\n\nj k.", "j k.\n\nl m n o p q."] and (got[1]["page"], got[1]["token_count"]) == (2, 8)
    got = chunked(spark, [rows[0], rows[2]], target=12, least=0, overlap=3)
    assert [r["content"] for r in got] == ["a b c d e f g. h i.", "h i.\n\nl m n o p q."]
    assert [r["content"] for r in chunked(spark, [rows[0], ("paragraph", 1, 1, "x " * 19)], least=0)][1] == "x " * 19  # no room for what is carried
    assert [r["content"] for r in chunked(spark, [("table", 1, 1, "a | b | c"), ("paragraph", 1, 1, "x " * 10)], target=10, least=0, overlap=9)][1] == "x " * 10


def test_tables_and_lists_are_cut_between_rows(spark):
    table = "\n".join(f"item {i} | weekly | team {i % 3}" for i in range(12))
    got = chunked(spark, [("heading", 1, 1, "Matrix"), ("table", 1, 1, table), ("list", 1, 2, "- one - two")])
    rows = [line for r in got for line in r["content"].split("\n") if "|" in line]
    assert rows == table.split("\n") and all(r["contains_table"] == ("|" in r["content"]) for r in got)
    assert any(r["forced_split"] for r in got) and [r["contains_list"] for r in got][-1]


def test_small_chunks_take_in_the_next_of_their_section(spark):
    rows = [("paragraph", 1, 1, "a b"), ("paragraph", 1, 1, "c " * 13), ("paragraph", 2, 2, "d"), ("paragraph", 3, 3, "e")]
    got = chunked(spark, rows, target=14, least=4, overlap=0)
    assert [(r["section"], word_count(r["content"])) for r in got] == [(1, 2), (1, 13), (2, 1), (3, 1)]
    assert [word_count(r["content"]) for r in chunked(spark, rows, target=15, least=4, overlap=0)] == [15, 1, 1]


def test_known_tables_mark_chunks_of_their_pages(spark):
    rows = spark.createDataFrame([(1, 0, "paragraph", 1, 1, 3, "a"), (1, 1, "paragraph", 2, 4, 4, "b"), (2, 0, "paragraph", None, 1, 1, None)], SEGMENTS)
    pages = spark.createDataFrame([(1, 2), (2, 9)], "doc_id long, page int")
    got = structure.chunk(rows, table_pages=pages).orderBy("chunk_index").collect()
    assert [(r["section"], r["contains_table"], r["token_count"]) for r in got] == [(1, True, 2), (2, False, 2)]
    assert structure.chunk(rows.limit(0)).count() == 0


def test_one_long_word_list_is_cut_in_linear_time(spark):
    import time

    began = time.time()
    got = chunked(spark, [("paragraph", 1, 1, "word " * 200_000)], target=800, least=500, most=1000, overlap=78)
    assert time.time() - began < 20 and sum(r["content"].count("word") for r in got) == 200_000


def test_headings_by_numbers_fonts_and_capitals(spark):
    rows = [
        (1, 1, 1, "Running text", None, None, None), (1, 1, 2, "OVERVIEW OF RULES", None, None, None), (1, 1, 3, "RECEIVED", None, None, None), (1, 1, 4, "Big Title", 20.0, 10.0, False),
        (1, 1, 5, "Bold Title", 11.6, 10.0, True), (1, 1, 6, "Not so big.", 20.0, 10.0, True), (1, 2, 1, "STAMPED TWICE"), (1, 3, 1, "Running text"), (1, 3, 2, "STAMPED TWICE"), (1, 3, 3, "1. Install the appliance before anything else is done here"),
        (1, 3, 4, "2. Install the appliance before anything else is done here", None, None, True), (1, 3, 5, "NOW IN CAPITALS"), (1, 3, 6, "Appendix b.2: Forms"), (1, 3, 7, "Section 4"), (1, 3, 8, "Section 4 - Pay?"), (1, 3, 9, "Running text"),
    ]
    df = spark.createDataFrame([(*r, None, None, None)[:7] for r in rows], "doc_id long, page int, line_no int, line string, size double, body double, bold boolean")
    marked = structure.marked_lines(df)
    assert {r["line"] for r in marked.filter("running").collect()} == {"Running text"} and {r["line"] for r in marked.filter("solo").collect()} == {"STAMPED TWICE"}
    got = {r["line"]: (r["number"], r["title"], r["level"]) for r in structure.headings(marked).collect()}
    assert got == {
        "OVERVIEW OF RULES": (None, "OVERVIEW OF RULES", 2), "Big Title": (None, "Big Title", 1), "Bold Title": (None, "Bold Title", 3),
        "2. Install the appliance before anything else is done here": ("2", "Install the appliance before anything else is done here", 1),
        "Appendix b.2: Forms": ("Appendix b.2", "Forms", 2), "Section 4 - Pay?": ("4", "Pay?", 1),
    }


def test_many_headings_of_one_document_take_seconds(spark):
    import time

    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("page"), F.col("id").alias("line_no"), (F.col("id") * 7919 % 6 + 1).cast("int").alias("level"), F.concat(F.lit("t"), "id").alias("title"))
    began = time.time()
    tree = structure.section_tree(rows, spark.createDataFrame([(1, n)], "doc_id long, last_page int")).cache()
    got = tree.orderBy("sort_order").collect()
    paths = {r["sort_order"]: r["path"] for r in structure.heading_paths(tree).collect()}
    assert time.time() - began < 90
    stack, open_, parents, ends = [], [], {}, {}
    for i, r in enumerate(got):
        while stack and got[stack[-1]]["level"] >= r["level"]:
            ends[stack.pop()] = r["page"]
        parents[i] = stack[-1] + 1 if stack else None
        stack.append(i)
    assert [r["parent_order"] for r in got] == [parents[i] for i in range(n)] and [r["end_page"] for r in got] == [ends.get(i, n) for i in range(n)]
    assert all(len(paths[i + 1]) == (len(paths[p]) if (p := parents[i]) else 0) + 1 for i in range(n))


def test_segments_are_runs_of_a_kind(spark):
    lines = ["a | b | c", "d | e | f", "- item", "- item two", "text", "more"]
    df = spark.createDataFrame([(1, 1, i, x, None) for i, x in enumerate(lines)], "doc_id long, page int, line_no int, line string, section long")
    got = structure.segments(df).orderBy("segment").collect()
    assert [(r["kind"], r["text"]) for r in got] == [("table", "a | b | c\nd | e | f"), ("list", "- item - item two"), ("paragraph", "text more")]


def test_keyset_pages_meet(spark):
    df = spark.range(10).select(F.lit(1).alias("t"), "id")
    first = [r["id"] for r in catalog.keyset_page(df, time="t", key="id", limit=4).collect()]
    second = [r["id"] for r in catalog.keyset_page(df, time="t", key="id", limit=4, after=(1, first[3])).collect()]
    assert first == [9, 8, 7, 6, 5] and second == [5, 4, 3, 2, 1]


def docx(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{xml}</w:body></w:document>')
    return out.getvalue()


def test_docx_and_upload_checks(spark):
    content = docx("<w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    assert files.docx_text(content) == "Title\na | b" and files.docx_text(b"no") is None
    kind = files.ACCEPTED["docx"][0]
    rows = [("a.docx", kind, content), ("a.pdf", "application/pdf", content), ("a.exe", kind, content)]
    df = spark.createDataFrame(rows, "name string, declared string, content binary").withColumn("detected", X.sniff_type(F.col("content"))).withColumn("length", F.length("content"))
    assert [r["reason"] for r in files.check_uploads(df).orderBy("name").collect()] == [None, "extension", "content"]


def test_recognised_words_make_lines(spark):
    rows = [(1, 1, 1, 1, 2, "world", 80.0, 50, 10, 40, 10), (1, 1, 1, 1, 1, "hello", 90.0, 0, 12, 40, 10), (1, 1, 1, 1, 3, "x", -1.0, 0, 0, 1, 1)]
    got = files.ocr_lines(spark.createDataFrame(rows, "page int, block int, par int, line int, word_no int, text string, conf double, left int, top int, width int, height int")).first()
    assert (got["text"], got["x0"], got["y0"], got["x1"], got["y1"], got["conf"]) == ("hello world", 0, 10, 90, 22, 85.0)


def test_outline_of_a_policy(spark):
    heads = ["1. Purpose", "2. Scope", "3) Roles", "4. Leave", "4.1 Annual leave", "4.2 Sick leave", "4.2.1 Certificates", "Appendix A.2 Forms", "4 Leave days"]
    rows = spark.createDataFrame([(1, 1 + i // 3, i + 1, h) for i, h in enumerate(heads)], "doc_id long, page int, line_no int, line string")
    tree = structure.section_tree(structure.headings(rows), spark.createDataFrame([(1, 3)], "doc_id long, last_page int"))
    got = {r["sort_order"]: (r["parent_order"], r["end_page"]) for r in tree.collect()}
    assert got == {1: (None, 1), 2: (None, 1), 3: (None, 2), 4: (None, 3), 5: (4, 2), 6: (4, 3), 7: (6, 3), 8: (4, 3)}
    paths = {r["sort_order"]: r["path"] for r in structure.heading_paths(tree).collect()}
    assert paths[7] == ["Leave", "Sick leave", "Certificates"] and paths[8] == ["Leave", "Forms"]


def test_paths_have_no_depth_limit(spark):
    rows = spark.createDataFrame([(1, i, i - 1 or None, f"t{i}") for i in range(1, 31)], "doc_id long, sort_order int, parent_order int, title string")
    assert max(len(r["path"]) for r in structure.heading_paths(rows).collect()) == 30
    assert structure.descendants(rows).count() == 30 * 31 // 2


def test_sentences_have_offsets(spark):
    text = " One is here [1]. next stays. Two. [2] (Three)  "
    spans = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(rules.sentence_spans(F.col("t")).alias("s")).collect()
    assert [(s["sentence"], text[s["begin"] : s["end"]].strip()) for s in spans[0]["s"]] == [(x, x) for x in ["One is here [1]. next stays.", "Two. [2]", "(Three)"]]
    assert spans[1]["s"] is None and spans[2]["s"] == []


def test_text_rules(spark):
    row = spark.createDataFrame([("a [1] b [9] c [01]", "2024-02-30", "Good. Bad §CANARY-1 x. Fine.")], "m string, d string, c string").select(
        rules.strip_markers(F.col("m"), F.array(F.lit(1))).alias("m"), rules.coerced_date(F.col("d")).alias("d"), rules.strip_canary(F.col("c")).alias("c"),
        rules.clip_to_tokens(F.lit("w " * 100), 3).alias("cut"), rules.version_step_allowed(F.lit("FAILED"), F.lit("READY")).alias("step"),
    ).first()
    assert tuple(row)[:3] == ("a [1] b c [01]", None, "Good. Fine.") and row["cut"].endswith(" [...]") and not row["step"]


def test_a_tree_is_one_pass_over_batches_and_starts_no_job(spark):
    import random

    draw = random.Random(5)
    rows = [(d, i // 4, i, draw.choice([1, 2, 3, 4, None]) if d else 1, f"t{i}") for d in range(7) for i in range(draw.randint(1, 40))] + [(None, 1, 1, 1, "lost")]
    heads = spark.createDataFrame(rows, "doc_id long, page int, line_no long, level int, title string")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        spark.sparkContext.setJobGroup("tree", "tree")
        tree = structure.section_tree(heads, None, chains=True)
        paths = structure.heading_paths(tree)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("tree")
        got = {(r["doc_id"], r["sort_order"]): r for r in tree.collect()}
        told = {(r["doc_id"], r["sort_order"]): r["path"] for r in paths.collect()}
    finally:
        spark.conf.set(size, before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == len(rows) - 1
    for d in range(7):
        own = [r for r in rows if r[0] == d]
        for n, (_, page, _, level, title) in enumerate(own, 1):
            above = [m for m, r in enumerate(own[: n - 1], 1) if level is not None and r[3] is not None and r[3] < level]
            after = [r[1] for r in own[n:] if level is not None and r[3] is not None and r[3] <= level]
            r = got[d, n]
            assert (r["parent_order"], r["end_page"]) == (max(above, default=None), None if level is None else after[0] if after else own[-1][1])
            assert told[d, n] == (told[d, r["parent_order"]] if r["parent_order"] else []) + [title]


def test_shared_conflicts_count_repeated_rows_once_without_a_table_of_chunks(spark):
    from foliant.operators import assembly

    asked = spark.createDataFrame([(1, 10), (1, 10), (1, 11), (2, 10), (2, None)], "query long, chunk_id long")
    held = spark.createDataFrame([(10, 7), (10, 7), (11, 7), (10, 8), (None, 7)], "chunk_id long, conflict_id long")
    found = assembly.shared_conflicts(asked, held)
    assert [tuple(r) for r in found.collect()] == [(1, 7, 2)]
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_reply_is_parsed_once(spark):
    from foliant.functions import replies

    rows = spark.createDataFrame([('{"executive_summary": " x ", "roles": ["a", 1]}',)], "raw string").withColumn("r", replies.summary_reply(F.col("raw")))
    found = rows.select(F.col("r").isNotNull().alias("valid"), "r.*")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") + found._jdf.queryExecution().optimizedPlan().toString().count("parse_json(") == 1
    assert (found.first()["executive_summary"], found.first()["roles"]) == ("x", ["a"])


def test_texts_are_compared_by_slices_and_normal_forms_made_once(spark):
    rows = [(i, f"One {i}. Two two.", f"One {i}. Two  two." if i % 3 == 0 else f"One {i}. Two three." if i % 3 == 1 else None) for i in range(300)] + [(300, None, None)]
    found = compare.text_changes(spark.createDataFrame(rows, "id int, old_text string, new_text string").coalesce(1))
    got = {r["id"]: (r["unchanged"], r["changed_words"], len(r["spans"])) for r in found.collect()}
    assert all(got[i] == [(True, 0, 0), (False, 2, 2), (False, 4, 1)][i % 3] for i in range(300)) and got[300] == (True, 0, 0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{3,}") == 2 and "sha2" not in plan


def test_short_sequences_have_the_blocks_of_long_ones():
    from foliant.functions import difference as D

    draw = random.Random(8)
    for _ in range(3000):
        old, new = ([draw.choice("abcd"[: draw.randint(1, 4)]) for _ in range(draw.randint(0, 8))] for _ in range(2))
        assert D.short_blocks(old, new) == D.matching_blocks(*D.numbers(old, new)), (old, new)
