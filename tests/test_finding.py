"""Find in text and frames against brute force."""

import json
import random

import pytest

from foliant.operators import finding
from foliant.sources import frames
from pyspark.sql import functions as F


def brute_find(text, term):
    """Hits of a term in the lower-case text, taken one after the other."""
    low, at, out = text.lower(), 0, []
    while (at := low.find(term, at)) >= 0:
        out.append((at, at + len(term)))
        at += len(term)
    return out


def test_hits_are_brute_force_on_long_texts(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice(["ab", "A", "b", " ", "É", "é", "x\n"]) for _ in range(rnd.choice([0, 5, 3000])))) for i in range(30)] + [(98, None), (99, "")]
    terms = ["ab", "aba", " É", "a b", "zz", "", "bb ", "aa", "x\nx"]
    wanted = sorted({t.strip().lower() for t in terms if t.strip()})
    got = finding.find_terms(spark.createDataFrame(texts, "doc_id long, text string"), terms).collect()
    want = {(i, t, a, b) for i, text in texts for t in wanted for a, b in brute_find(text or "", t)}
    assert {(r["doc_id"], r["term"], r["begin"], r["end"]) for r in got} == want and len(got) == len(want)
    source = dict(texts)
    assert all(r["context"] == source[r["doc_id"]][max(0, r["begin"] - 30) : r["end"] + 30] for r in got)


def test_offsets_hold_where_lower_case_is_longer(spark):
    rows = finding.find_terms(spark.createDataFrame([(1, "İİ word İ")], "doc_id long, text string"), ["WORD"]).collect()
    assert [(r["begin"], r["end"]) for r in rows] == [(3, 7)]
    assert finding.find_terms(spark.createDataFrame([(1, "a")], "doc_id long, text string"), ["", "  "]).count() == 0
    with pytest.raises(ValueError):
        finding.find_terms(spark.range(1).select("id", F.lit("a").alias("text")), [str(i) for i in range(finding.MOST_TERMS + 1)], key="id")


FRAMES = ': keep-alive\n\nevent: status\ndata: {"n": 1, "s": "é漢"}\n\nevent:done\ndata: {"a":\ndata: 2}\n\ndata: {"n": 3}\n\nevent: bad\ndata: {n}\n\nevent: bare\n\n\n\nevent: last\ndata: {"n": 9}'
WANT = [("status", {"n": 1, "s": "é漢"}), ("done", {"a": 2}), ("bare", {}), ("last", {"n": 9})]


def test_frames_cut_at_every_byte_are_read_alike(spark):
    whole = FRAMES.encode()
    rows = []
    for size in (1, 2, 3, 7, 50, len(whole)):
        rows += [(size, i, bytes(whole[i * size : (i + 1) * size])) for i in range(-(-len(whole) // size))]
    rows += [(1000 + at, i, part) for at in range(1, len(whole)) for i, part in enumerate((whole[:at], whole[at:]))]
    random.Random(1).shuffle(rows)
    found = frames.frames_of_chunks(spark.createDataFrame([(s, i, bytearray(b)) for s, i, b in rows], "stream int, chunk_no int, data binary"))
    got = {}
    for r in found.select("stream", "place", "event", F.to_json("data").alias("data")).orderBy("stream", "place").collect():
        got.setdefault(r["stream"], []).append((r["event"], json.loads(r["data"])))
    assert len(got) == 6 + len(whole) - 1 and all(v == WANT for v in got.values())


def test_stored_streams_are_read_over_splits(spark, tmp_path):
    body = "".join(f'event: e{i % 3}\ndata: {{"i": {i}}}\n\n' for i in range(5000))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.txt").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        df = frames.read_frames(spark, str(tmp_path / "s"))
        assert df.rdd.getNumPartitions() > 2
        got = sorted((json.loads(r["data"])["i"], r["event"]) for r in df.select("event", F.to_json("data").alias("data")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"e{i % 3}") for i in range(5000)]
