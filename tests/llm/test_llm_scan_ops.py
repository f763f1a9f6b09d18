"""Fill-in-middle, suffix dedup and periodic runs against brute force, with odd inputs."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import op11_fill_in_middle, op12_suffix_dedup, op13_periodic_runs

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, k string, pos string, h1 string, form string, spans string, _words string, copy string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "x", "x", "x", "x", "x") for r in rows], DOCS)


def odd_rows():
    """Nulls, empty and repeated rows, markers, wide characters and a long text."""
    texts = [None, "", " \n\t", "one", "one", "Ünïcode wörds\n 漢字 and, more. ", "a <P> b c", "é " * 4000 + "end", "ab " * 100]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[7], rows[7], (None, "ab " * 100), (2**63 - 1, "ab " * 100)]


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_cuts_are_those_of_the_unit_list():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "é", "漢", " ", "\n", "\t", "zz"]) for _ in range(rnd.choice([0, 1, 3, 50, 400])))
        units = UNIT.findall(text)
        index = op11_fill_in_middle.Checkpoints(text.encode(), rnd.choice([1, 2, 7, 64]), rnd.choice([3, 16, 1 << 20]))
        assert index.n == len(units)
        for u in range(len(units) + 1):
            before = "".join(units[:u])
            assert index.cut(u) == (len(before.encode()), len(before))


def test_fill_in_middle_is_brute_force(spark):
    rnd = random.Random(1)
    rows = odd_rows() + [(100 + i, "".join(rnd.choice(["word", "ü", " ", "\n", "<", ">", "S", "P"]) for _ in range(rnd.randint(0, 300)))) for i in range(300)]
    docs = table_of(spark, rows)
    cut = op11_fill_in_middle.fill_in_middle(docs).withColumn("back", op11_fill_in_middle.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in cut.collect()]
    same(got, [(*brute_fim(i, t), t or "") for i, t in rows])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert op11_fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


def brute_dedup(rows, width):
    """The kept bytes of rows in table order (ids ascending, null last)."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - width + 1):
            if data[s : s + width] in seen:
                gone[s : s + width] = True
            seen.add(data[s : s + width])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        out.append((doc_id, len(data), list(zip(edges[::2].tolist(), edges[1::2].tolist())), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return out


def dedup(docs, **options):
    return [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in op12_suffix_dedup.suffix_dedup(docs, **options).collect()]


def test_owners_are_those_of_each_window():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcde ") for _ in range(900)) + "ab" * 200 + "x" * 150
    data, ends = np.frombuffer(text.encode(), np.uint8), np.array([400, 400, 1000, len(text)])
    for block in (40, 333, 1 << 18):
        pos, low, high, k, c = op12_suffix_dedup.owners(data, ends, 30, 8, block)
        windows = [s for a, b in zip(low, high) for s in range(a, b + 1)]
        assert windows == [s for s in range(len(text) - 29) if any(b <= s and s + 30 <= e for b, e in zip([0, 400, 400, 1000], ends))]
        assert all(a <= p <= a + 22 and b <= p for p, a, b in zip(pos, low, high))
        whole = op12_suffix_dedup.owners(data, ends, 30, 8)
        assert all((x == y).all() for x, y in zip(whole, (pos, low, high, k, c)))


@pytest.mark.parametrize("options", [{"width": 20, "gram": 6}, {"width": 20, "gram": 3, "most": 4, "bucket": 8}, {"width": 20, "gram": 20}])
def test_suffix_dedup_is_brute_force(spark, options):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    shared = " ".join(rnd.choice(words) for _ in range(30))
    rows = []
    for i in range(120):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
        if rnd.random() < 0.4:
            a = rnd.randrange(len(shared))
            text += rnd.choice(["", " ", "-"]) + shared[a : a + rnd.randint(10, 90)] + text[: rnd.randint(0, 40)]
        if i % 10 == 9:
            text = rnd.choice(rows)[1]
        if i % 17 == 0:
            text = rnd.choice("xy") * rnd.randint(0, 60) + text
        rows.append((i * 3 - 50, text))
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    same(dedup(table_of(spark, shuffled).repartition(5), **options), brute_dedup(rows, 20))


def test_suffix_dedup_takes_odd_tables(spark):
    rows = odd_rows()
    got = dedup(table_of(spark, rows).coalesce(1))
    want = brute_dedup(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), 100)
    same(got, want)
    assert dedup(table_of(spark, rows).limit(0)) == []


def test_sort_is_mended_when_a_hash_lies():
    rnd = random.Random(9)
    data = np.array([rnd.randrange(3) for _ in range(4000)], np.uint8)
    starts = np.array([rnd.randrange(3900) for _ in range(500)] * 2)
    begin, end = np.repeat([0, 300], [300, 700]), np.repeat([300, 1000], [300, 700])
    order, equal = op12_suffix_dedup.sorted_windows(data, starts, begin, end, 50, [1, op12_suffix_dedup.BASES[0]])
    for a, b in ((0, 300), (300, 1000)):
        want = sorted(range(a, b), key=lambda i: (bytes(data[starts[i] : starts[i] + 50]), i))
        assert order[a:b].tolist() == want
    with pytest.raises(RuntimeError):
        op12_suffix_dedup.sorted_windows(data, starts, begin, end, 50, [1])


def brute_runs(words, least, exponent):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] == words[i + q]:
                j = i
                while j + q < len(words) and words[j] == words[j + q]:
                    j += 1
                part = words[i : j + q]
                if len(part) >= max(least, exponent * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, len(part), q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {t for s, n, q in runs for t in range(s + q, s + n)}
    return " ".join(w for t, w in enumerate(words) if t not in gone)


@pytest.mark.parametrize("least,exponent", [(2, 2), (6, 4), (3, 2), (1, 3)])
def test_runs_are_brute_force(least, exponent):
    rnd = random.Random(least)
    for _ in range(40):
        docs = []
        for _ in range(rnd.randint(1, 10)):
            n, k = rnd.choice([0, 1, 2, 5, 40, 120]), rnd.choice([1, 2, 3, 8])
            words = [rnd.choice("abcdefgh"[:k]) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
                words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
            docs.append(words)
        got = op13_periodic_runs.collapse([" ".join(d).encode() for d in docs], least, exponent)
        for words, runs, text in zip(docs, got["runs"].to_pylist(), got["collapsed"].to_pylist()):
            want = brute_runs(words, least, exponent)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == want
            assert text.decode() == brute_collapse(words, want)


def test_long_stretches_of_one_word_take_no_square():
    for words in (["a"] * 200_000, ["x", "y"] * 100_000):
        got = op13_periodic_runs.collapse([" ".join(words).encode()], 6, 4)
        assert got["runs"].to_pylist() == [[{"start": 0, "length": 200_000, "period": len(set(words))}]]


def test_periodic_runs_query_is_brute_force(spark):
    def planted(doc_id, text):
        words = WORD.findall(text or "")
        h, n = crc32(str(doc_id).encode()), len(words)
        if doc_id is None or h % 10 or not n:
            return words
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        words = planted(*r)
        runs = brute_runs(words, 6, 4)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapse(words, runs))]
        want.append((r["doc_id"], len(runs), *best, None if best[1] is None else 1000 * best[1] // best[2], *digest))
    got = [tuple(r) for r in op13_periodic_runs.op13_periodic_runs(spark, DATA).collect()]
    same(got, want)
    assert sum(r[1] > 0 for r in got) > 5


def test_periodic_runs_take_odd_tables(spark):
    rows = odd_rows()
    docs = table_of(spark, rows)
    got = [(r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in op13_periodic_runs.periodic_runs(op13_periodic_runs.plant_runs(docs.filter("doc_id IS NULL").unionByName(docs.filter("doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 10 <> 0")))).collect()]
    want = []
    for i, t in rows:
        if i is None or crc32(str(i).encode()) % 10:
            words = WORD.findall(t or "")
            runs = brute_runs(words, 6, 4)
            want.append((i, len(words), runs, brute_collapse(words, runs)))
    same(got, want)
    assert op13_periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_sets_of_a_long_list_that_share_a_passage_leave_no_pairs(spark):
    import numpy as np

    from foliant.llm import op8_ngram_jaccard as op8

    draw = np.random.default_rng(3)
    passage = draw.integers(-(2**62), 2**62, 30)
    sets = [np.unique(np.concatenate((passage, draw.integers(-(2**62), 2**62, 70)))) for _ in range(200)]
    sets.append(np.unique(np.concatenate((sets[0][:95], draw.integers(-(2**62), 2**62, 5)))))  # similar to the first
    rows = [(1, i, int(op8.LOW), len(s), bytearray(op8.parity(s))) for i, s in enumerate(sets)] + [(1, 900, int(op8.LOW), None, None)]
    entries = spark.createDataFrame(rows, "token long, part long, left long, n long, bits binary")
    got = {tuple(r) for r in op8.long_list_pairs(entries).collect()}
    assert (0, 200) in got and {(i, 900) for i in range(201)} <= got  # what is like or not known stays
    assert len(got) == 202
