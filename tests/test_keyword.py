"""Stems, postings, web-search syntax and ranks against known values and brute force."""

import math
import random

import pytest

from foliant.functions import english as E
from foliant.operators import keyword as K

STEMS = """consigned consign consigning consign consignment consign consistency consist kneeling kneel generate generat generic generic generously generous communication communic arsenal arsenal happy happi
hopping hop hoping hope ties tie cries cri gas gas gaps gap kiwis kiwi relational relat conditional condit rational ration organization organ differently differ hopefulness hope controlling control probate probat
rate rate cease ceas say say cry cri luxuriated luxuri proceeds proceed herrings herring dying die skies sky singly singl news news adjustable adjust replacement replac adoption adopt electricity electr
sensibility sensibl troubled troubl sized size falling fall filing file agreed agre feed feed knightly knight kindness kind youth youth yellow yellow playing play enjoyed enjoy conditionally condit
formative format analogies analog vocation vocat beautifully beauti restlessly restless bed bed bled bled""".split()


def test_stems_are_the_published_ones(spark):
    words, want = STEMS[::2], STEMS[1::2]
    rows = E.with_stems(spark.createDataFrame(list(enumerate(words)), "i int, word string"), "word").orderBy("i").collect()
    assert [(r["word"], r["stem"]) for r in rows] == list(zip(words, want))
    odd = E.with_stems(spark.createDataFrame([(None,), ("",), ("a",), ("é",), ("123",), ("yyy",)], "word string"), "word").collect()
    assert [r["stem"] for r in odd] == [None, "", "a", "é", "123", "yyy"]


def test_stems_of_texts_are_those_of_columns(spark):
    rnd, ends = random.Random(3), "s ss sses ies ied us ed ing edly ingly eed eedly y ly ational ization ogi logi li fulness ative ative ment ion sion tion e ll al 7".split()
    made = ["".join(rnd.choice("aeiouybcdgklmnprstwxzé") for _ in range(rnd.randint(0, 6))) + rnd.choice(ends) + rnd.choice(["", *ends]) for _ in range(20_000)]
    words = sorted({*made, *STEMS, *E.OWN_STEMS, *E.KEPT, *E.KEPT_LATER, *E.STOP_WORDS, "", "a", "é", "yyy"})
    got = E.with_stems(spark.createDataFrame([(w,) for w in words], "word string"), "word").collect()
    assert [(r["word"], r["stem"]) for r in got if r["stem"] != E.stem_of(r["word"])] == [] and len(got) == len(words)
    assert E.term_of("the") is None and E.term_of("running") == "run"


def test_web_syntax(spark):
    def plain(query):
        return [[(p.stems, p.offsets, p.excluded) for p in branch] for branch in K.parse(spark, query)]

    assert plain('cats "running of dogs" -birds') == [[(("cat",), (0,), False), (("run", "dog"), (0, 2), False), (("bird",), (0,), True)]]
    assert plain('one or -"two three" OR the') == [[(("one",), (0,), False)], [(("two", "three"), (0, 1), True)]]
    assert plain("e-mail's \"unclosed quote") == [[(("e", "mail"), (0, 1), False), (("unclos", "quot"), (0, 1), False)]]
    assert plain("") == plain(None) == plain('the of "" OR - !!') == []


WORDS = "alpha beta gamma delta the of running".split()


def texts(n):
    rnd = random.Random(n)
    return [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 3, 8, 30]))).title()) for i in range(n)] + [(n, None), (n + 1, "Alpha  beta.gamma\nALPHA")]


def places(text):
    stems = {"running": "run", "alpha": "alpha", "beta": "beta", "gamma": "gamma", "delta": "delta"}
    out = {}
    for at, w in enumerate((text or "").replace(".", " ").lower().split(), 1):
        if w in stems:
            out.setdefault(stems[w], []).append(at)
    return out


def rank_all(found, terms):
    res = -1.0
    for i, a in enumerate(terms):
        for b in terms[:i]:
            for p in found.get(a, []):
                for q in found.get(b, []):
                    gap = abs(p - q)
                    if gap:
                        w = math.sqrt(0.01 * (1e-30 if gap > 100 else 1 / (1.005 + 0.05 * math.exp(gap / 1.5 - 2))))
                        res = w if res < 0 else 1 - (1 - res) * (1 - w)
    return max(res, 1e-20)


def rank_any(found, terms):
    return sum(sum(0.1 / (n + 1) ** 2 for n in range(len(found.get(t, [])))) / 1.64493406685 for t in terms) / len(terms)


def phrase(found, stems, offsets):
    return any(all(p + o in found.get(s, []) for s, o in zip(stems, offsets)) for p in found.get(stems[0], []))


@pytest.mark.parametrize(
    "query,meets,joint",
    [
        ("alpha running", lambda f: "alpha" in f and "run" in f, True),
        ('"alpha of beta"', lambda f: phrase(f, ["alpha", "beta"], [0, 2]), True),
        ('gamma -"beta beta" delta', lambda f: "gamma" in f and "delta" in f and not phrase(f, ["beta", "beta"], [0, 1]), True),
        ("alpha beta OR delta -gamma", lambda f: ("alpha" in f and "beta" in f) or ("delta" in f and "gamma" not in f), False),
        ("gamma", lambda f: "gamma" in f, False),
        ("-gamma", lambda f: "gamma" not in f, False),
        ("the", lambda f: False, False),
    ],
)
def test_matches_are_brute_force(spark, tmp_path, query, meets, joint):
    rows = texts(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parsed = K.parse(spark, query)
    terms = K.query_terms(parsed)
    K.write_postings(K.postings(docs), str(tmp_path / "index"))
    index = K.stored_postings(spark, str(tmp_path / "index"), terms)
    got = {r["doc_id"]: r["rank"] for r in K.matches(index, parsed, docs=docs).collect()}
    want = {i: (rank_all if joint else rank_any)(places(t), terms) for i, t in rows if meets(places(t))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-7 for i in want)
    top = [r["doc_id"] for r in K.keyword_topk(index, parsed, 5, docs=docs).collect()]
    assert top == sorted(got, key=lambda i: (-got[i], i))[:5]


def test_exclusions_alone_need_the_documents(spark):
    index = K.postings(spark.createDataFrame(texts(5), "doc_id long, text string"))
    with pytest.raises(ValueError):
        K.matches(index, K.parse(spark, "-alpha"))


def test_positions_are_bounded(spark):
    docs = spark.createDataFrame([(1, "alpha " * 400), (2, "beta " * 16500 + "alpha alpha")], "doc_id long, text string")
    got = {(r["term"], r["doc_id"]): r["positions"] for r in K.postings(docs).collect()}
    assert got["alpha", 1] == list(range(1, 257)) and got["alpha", 2] == [16383] and got["beta", 2] == list(range(1, 257))


def test_postings_are_grouped_where_texts_are_read_and_shuffled_once(spark, tmp_path, monkeypatch):
    rows = [*texts(60), (90, "the of"), (91, ""), (92, "beta " * 16500 + "alpha alpha"), (93, "running run " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plan = K.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = {}
    for i, text in rows:
        for term, at in places(text).items():
            want[term, i] = sorted({min(p, 16383) for p in at})[:256]
    want |= {("run", 93): list(range(1, 257))}
    for listed in (1, 40, K.LISTED):  # a stretch may be one text
        monkeypatch.setattr(K, "LISTED", listed)
        assert {(r["term"], r["doc_id"]): r["positions"] for r in K.postings(docs).collect() if r["term"] != "the"} == want
        K.write_postings(K.listed_postings(docs), str(tmp_path / f"i{listed}"))
        index = K.stored_postings(spark, str(tmp_path / f"i{listed}"), ["alpha", "run"])
        assert {(r["term"], r["doc_id"]): r["positions"] for r in index.collect()} == {k: v for k, v in want.items() if k[0] in ("alpha", "run")}


def test_search_reads_the_folders_of_its_terms(spark, tmp_path):
    K.write_postings(K.postings(spark.createDataFrame(texts(20), "doc_id long, text string")), str(tmp_path / "index"))
    plan = K.stored_postings(spark, str(tmp_path / "index"), ["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
