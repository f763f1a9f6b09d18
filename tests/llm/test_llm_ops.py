"""The training-data operators against brute force, round trips and held-out labels, with odd inputs."""

import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import op1_mixing, op2_embedding_dedup, op3_html_extraction, op4_quality_rules, op5_toxicity, op6_packing, op7_language_id, op8_ngram_jaccard, op9_line_dedup, op10_quality_classifier

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, size string, held_out string, block string, part string, mark string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_docs(spark, extra=()):
    """Nulls anywhere, empty and repeated rows, and columns whose names operators use inside."""
    texts = [None, "", " \n\t", "one", "one", "Ünïcode wörds 123 and, more.\nsecond line\nsecond line", "a b c d e f g " * 300, *extra]
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s" if i % 3 else None, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing_meets_targets_and_limits(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(0, 60), random.choice(["a", "b", "c", "d", None])) for i in range(900)] + [(1000 + i, "v " * 5, "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in op1_mixing.mix_plan(docs, shards=8).collect()}
    again = {r["doc_id"]: r for r in op1_mixing.mix_plan(docs.repartition(3), shards=8).collect()}
    assert got == again and len(got) == len(rows)
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    target |= share
    for s in names:
        own = [got[i] for i, _, x in rows if x == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
        assert all(sum(d["words"] for d in r["draws"]) == r["taken"] for r in own)


def test_mix_repeats_documents(spark):
    docs = odd_docs(spark)
    got = op1_mixing.mix(docs, shards=4)
    assert got.columns == docs.columns and got.count() > 0
    assert op1_mixing.mix(empty(spark)).count() == 0 and op1_mixing.mix_plan(empty(spark)).count() == 0


def test_tree_splits_exact_quotas(spark):
    quotas = spark.createDataFrame([(i, 50 * i) for i in range(6)], "number int, quota long")
    rows = op1_mixing.split_quotas(quotas, 8, 5).collect()
    for i in range(6):
        assert sum(r["quota"] for r in rows if r["number"] == i) == 50 * i
    per = [sum(r["quota"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(per) - min(per) <= 3 and all(r["quota"] >= 0 for r in rows)


def brute_links(ids, x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.9
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return {ids[i]: (int(near[i].sum()) - 1, ids[label[i]]) for i in range(len(ids))}
        label = new


def test_embeddings_find_all_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.0, 0.15, 0.3], 400)[:, None], rng.normal(size=(200, 16))])
    rows = [(i * 2, [float(v) for v in x[i]], "clash") for i in range(len(x))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op2_embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, mark string")).collect()}
    want = brute_links([r[0] for r in rows], x)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 2


def test_embeddings_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [None, 1.0]), (9, []), (10, [float("inf"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op2_embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 6: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 7, 8, 9, 10)}


PAGE = "<html><body><nav class=x><ul><li>Home</ul></nav><div class='{0}'>Box {1}</div><article><header>by me</header><h1>T &amp; {1}</h1><p>A  b<br>c<p>same line</article><footer>f</footer></body></html>"


def test_pages_lose_templates_only(spark):
    rows = [(i, "http://h.example/%d" % i, PAGE.format("k", i)) for i in range(8)]
    rows += [(20 + i, "http://g.example/%d" % i, f"<body><div><ul><li>menu<li>list</ul></div><div><p>page {i} has a long text of its own</p></div>") for i in range(8)]
    rows += [(50, None, "<p>x"), (51, "bad", None), (52, "http://h.example/", "<div><p>open <b>x</div>y < z"), (53, "", "")]
    got = {r["page_id"]: r for r in op3_html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "T & 3\nA b\nc\nsame line" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[22]["text"] == "page 2 has a long text of its own"
    assert [got[i]["text"] for i in (50, 51, 52, 53)] == ["x", "", "open x\ny < z", ""]


def brute_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_suffix_array_counts(spark):
    random.seed(5)
    texts = ["\n".join(" ".join(random.choice("ab#é") for _ in range(random.randint(0, 9))) for _ in range(4)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    for r in op4_quality_rules.suffix_array_rules(docs, min_repeat=4).collect():
        t = texts[r["doc_id"]] if r["doc_id"] < len(texts) else ""
        words = WORD.findall(t)
        longest, marked, covered = brute_repeats(words), set(), set()
        for i, k in enumerate(longest):
            marked |= set(range(i, i + 3)) if k >= 3 else set()
            covered |= set(range(i, i + k)) if k >= 4 else set()
        lines = [x for x in t.split("\n") if x.strip()]
        want = (len(words), sum(map(len, words)), t.count("#"), len(lines) - len(set(lines)), len(marked), max(longest, default=0), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "covered_words")) == want


def test_toxicity_finds_held_out_labels(spark):
    large = DATA.replace("0.01", "0.1")  # sf0.01 has some 30 toxic rows to learn from
    found = op5_toxicity.op5_toxicity(spark, large)
    labels = spark.read.parquet(f"{large}/labels.parquet").filter("toxic IS NOT NULL")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    clean, toxic = [r for r in rows if not r["toxic"]], [r for r in rows if r["toxic"]]
    assert sum(r["toxic_pred"] for r in clean) <= 0.01 * len(clean)
    assert sum(r["toxic_pred"] for r in toxic) >= 0.8 * len(toxic)


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {rows[i][0]: (len(sets[i]), rows[label[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("cutoff", [3, 16])
def test_jaccard_components_are_exact(spark, cutoff):
    random.seed(cutoff)
    words = [f"w{i}" for i in range(300)]
    base = [[random.choice(words) for _ in range(random.randint(3, 50))] for _ in range(25)]
    passage = [random.choice(words) for _ in range(30)]
    rows = []
    for i in range(250):
        b = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            b[random.randrange(len(b))] = random.choice(words)
        if random.random() < 0.5:
            b[1:1] = passage
        rows.append((3 * i, " ".join(b)))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "\n", "one", "ONE", "a b c d e", "A  b\tc d e"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), longest=cutoff, most_levels=cutoff * 20).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_links_hold_beyond_the_list_of_long_shingles(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for f in range(400):  # similarity 60 / 78: bands miss a few of the pairs, which only their lists of two parts can give
        shared = [random.choice(words) for _ in range(64)]
        rows += [(10 * f + i, " ".join([*shared, *(random.choice(words) for _ in range(9))])) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_ngram_jaccard.jaccard_components(docs, longest=1, most_levels=2).collect()}
    assert got == brute_jaccard(rows)


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["It's  a test!\n\n x y <|endoftext|> ²", None, "word " * 3000, "", *[f"doc number {i} " * (i % 90) for i in range(200)]]
    rows = op6_packing.karmarkar_karp_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, group=100).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1]) and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(windows) * 1024 - total < 0.06 * total


def test_encoder_agrees_with_the_tokenizer():
    import public_tokenizers

    e, random.state = op6_packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.seed(9)
    parts = ["a", "B", "can't", "--", " ", "  ", "\n", "\t", "é", "1", "'s", "!", "<|endoftext|>", "　", "x y", "\r\n", "²", "_", "$$"]
    for _ in range(3000):
        t = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        assert e.encode([t])[0] == e.whole(t)


def test_languages_of_held_out_documents(spark):
    rows = op7_language_id.op7_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_recurring_lines_go(spark):
    own = [" ".join(f"{chr(97 + i)}{k}q" for k in "abcdefg") for i in range(12)]
    rows = [(i, f"{own[i]} unique text of {chr(97 + i)}{chr(99 + i)} goes on and on for a while\nOrder {i} was shipped by our team on day {i}\n\nlast words {own[i]}") for i in range(12)]
    rows += [(100 + i, "this whole text is a copy of another text\nand has two lines") for i in range(9)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in op9_line_dedup.line_dedup(docs).collect()}
    for i in range(12):
        assert "shipped" not in got[i]["text"] and got[i]["n_dropped"] == 1 and "last words" in got[i]["text"]
    assert got[103]["n_dropped"] == 0 and got[200]["text"] is None and got[201]["text"] == ""


def test_recurring_lines_go_whatever_their_share(spark):
    random.seed(9)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def line(n):
        return " ".join("".join(random.choices(letters, k=8)) for _ in range(n))

    box, copied = "\n".join(line(20) for _ in range(3)), "\n".join(line(15) for _ in range(6))
    rows = [(i, f"{box}\n{line(30)}") for i in range(8)]  # two thirds of the words recur in texts that are no copies
    rows += [(100 + i, f"{copied} {line(1)}") for i in range(8)]  # near copies, whose lines nothing else holds
    got = {r["doc_id"]: r for r in op9_line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:8]:
        assert got[i]["text"] == text.split("\n")[-1] and got[i]["n_dropped"] == 3
    for i, text in rows[8:]:
        assert got[i]["text"] == text and got[i]["n_dropped"] == 0


def test_drain_templates_generalise():
    lines = np.array([[1, 2, 3, 4], [1, 2, 9, 4], [7, 8, 9, 9], [1, 2, 5, 4]])
    assert op9_line_dedup.templates(lines, 0.7).tolist() == [0, 0, 1, 0]


def test_quality_of_held_out_documents(spark):
    found = op10_quality_classifier.op10_quality_classifier(spark, DATA)
    rows = found.filter("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.88


def test_odd_rows_never_fail(spark):
    docs, none = odd_docs(spark), empty(spark)
    labels = spark.createDataFrame([(0, 1), (5, 0), (6, None), (5, 1)], "doc_id long, quality int")
    n = docs.count()
    assert op4_quality_rules.suffix_array_rules(docs).count() == n
    assert op10_quality_classifier.quality_scores(docs, labels).count() == n
    assert op10_quality_classifier.quality_scores(none, labels.limit(0)).count() == 0
    found = op7_language_id.language_id(docs, docs)
    assert found.count() == n and found.filter("text IS NULL AND lang_pred <> 'und'").count() == 0
    assert op7_language_id.language_id(none, none).count() == 0
    assert op9_line_dedup.line_dedup(docs).count() == n and op9_line_dedup.line_dedup(none).count() == 0
    assert op8_ngram_jaccard.jaccard_components(docs).count() == n and op8_ngram_jaccard.jaccard_components(none).count() == 0
    toxic = docs.withColumn("toxic", F.when(F.col("doc_id") > 2, 1))
    assert op5_toxicity.classifier_chain(docs, toxic, ["toxic"]).count() == n
    assert op5_toxicity.classifier_chain(none, none.withColumn("toxic", F.lit(1)), ["toxic"]).count() == 0
    import public_tokenizers

    assert op6_packing.karmarkar_karp_packing(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
    groups = op8_ngram_jaccard.jaccard_components(docs)
    assert kept.count() >= 0.9 * groups.select("component_id").distinct().count()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


CLASH = "rejected n_lines n_dropped lang_pred score size order_key verdict _key _masks _n row left _words _draw _shard"


def test_stages_take_odd_tables(spark):
    """Nulls, empties, long texts, ties, repeats and columns named like those that operators use inside, for every stage."""
    import corpus_pipeline

    texts = [None, "", " \n", "one", "a long line of words that goes on and on " * 30_000, *[f"the quick brown fox number {i} jumps over the lazy dog near the river" for i in range(6)]]
    rows = [(None if i == 3 else i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), *("x" for _ in CLASH.split())) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], rows[5], rows[2]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH.split()))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, None)
        assert got.count() > 0 and (name == "packing" or got.columns == docs.columns), name
        assert name == "packing" or {r["rejected"] for r in got.collect()} == {"x"}, name
        assert stage(spark, docs.limit(0), None).count() == 0, name


def test_equal_rows_are_mixed_one_by_one(spark):
    rows = [(7, "a b c d", "big")] * 40 + [(100 + i, "u v w " * 10, "small") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: r["target"] for r in op1_mixing.mix_plan(docs.withColumn("doc_id", F.monotonically_increasing_id())).join(docs.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id").collect()}
    words = {s: sum(len(r["text"].split()) for r in op1_mixing.mix(docs).collect() if r["source"] == s) for s in want}
    assert all(abs(words[s] - want[s]) <= 30 for s in want), (words, want)


def brute_templates(lines, similarity=0.7):
    known = []
    out = []
    for words in lines:
        scores = [sum(a == b or w for a, b, w in zip(k, words, wild)) for k, wild in known]
        best = max(range(len(known)), key=lambda i: (scores[i], -i), default=None)
        if best is not None and scores[best] >= similarity * len(words):
            grown = [w or a != b for a, b, w in zip(known[best][0], words, known[best][1])]
            if sum(grown) <= (1 - similarity) * len(words):
                known[best] = (known[best][0], grown)
            out.append(best)
        else:
            known.append((words, [False] * len(words)))
            out.append(len(known) - 1)
    return out


def test_templates_agree_with_brute_force():
    rng = np.random.default_rng(3)
    for width in (1, 3, 8):
        lines = rng.integers(0, 3, (200, width))
        assert op9_line_dedup.templates(lines, 0.7).tolist() == brute_templates(lines.tolist())


def test_large_leaves_merge_their_cells(spark, monkeypatch):
    monkeypatch.setattr(op9_line_dedup, "CELL", 4)
    rows = [(i, f"own{chr(97 + i // 26)}{chr(97 + i % 26)} text\nour shop sells only good things like {chr(97 + i // 26)}{chr(97 + i % 26)} today") for i in range(60)]
    got = op9_line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_dropped"] == 1 and "shop" not in r["text"] for r in got)


def test_pages_keep_names_that_only_contain_a_listed_word(spark):
    inner = '<h2 id="market-share">Head</h2><section id="related-work"><p class="widget-count">one</p></section><div class="comments">reader</div>'
    deep = "<div>" * 3000 + "<nav>menu</nav><p>low</p>"
    rows = [(1, None, f"<body><article>{inner}</article></body>"), (2, None, deep), (3, None, "a<b"), (4, None, "<p>x</p><script>1<2"), (5, None, "<li>a<li>b")]
    docs = spark.createDataFrame([(*r, "x", "x") for r in [*rows, rows[0]]], "page_id long, url string, html string, subtree string, host string")
    got = {r["page_id"]: r["text"] for r in op3_html_extraction.extract_pages(docs).collect()}
    assert got == {1: "Head\none", 2: "low", 3: "a", 4: "x", 5: "a\nb"}
    assert op3_html_extraction.extract_pages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<script ", '<script "', "<!", "<div>", "</x><div>", "<li>", "<p><b>", "<", "'<a\"", "<a '\"<"])
def test_odd_pages_are_read_once(unit):
    import time

    began = time.process_time()
    root = op3_html_extraction.parse(unit * (400_000 // len(unit)))
    op3_html_extraction.hash_subtrees(root)
    op3_html_extraction.text_of(op3_html_extraction.contents(root), set())
    assert time.process_time() - began < 20
