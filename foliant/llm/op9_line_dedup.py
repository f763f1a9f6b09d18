"""Line dedup: a log-template tree finds recurring lines whatever their variable fields hold.

A line is its words, those with a digit replaced by a wildcard. The tree has a fixed depth: number of words, then the first
LEAD words; that path is the leaf. Leaves met in fewer than `min_texts` different texts hold no recurring template and are
left out early. In a leaf, a line joins the most similar template if at least `similarity` of the words agree, and
positions that differ become wildcards; otherwise it starts a template. A leaf with more than CELL different lines grows its templates in
cells, dealt by a hash, and the cells' templates are then merged by the same rule. Templates met in at least `min_texts` different
texts are recurring and their lines are dropped, whatever share of a text they hold. Equal texts count once, and with `copies_once` so do near
copies: texts that share a minhash band key and whose sketches of the SKETCH lowest shingle hashes show a Jaccard similarity of at
least 0.75 are one class, so that copies of a text do not take each other's lines and the document-level operators can judge them.

Defined cases: a null text stays null with no lines; blank lines are kept and counted as no line; a repeated line of one
document counts once for its template and is dropped wherever it stands; repeated rows are cleaned alike; ties between templates go to the
older one; texts of any length are read whole; other columns pass through, but columns named n_lines or n_dropped are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, at_most, discard, each_batch, join_counted, joined, list_array, mix, pieces, span_hashes, stash, table, texts_as_bytes, unused, word_spans
from foliant.llm.components import components
from foliant.llm.op8_ngram_jaccard import PERCENT, SKETCH, band_keys, packed, shingles

LEAD = 3
CELL = 2000  # different lines of a leaf that grow templates together
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
WILD = np.uint64(0x57494C44)


class Lines:
    """The lines with words of many texts: text number, words, path in the tree, and a hash of the masked line."""

    def __init__(self, texts: list[bytes]):
        data, starts = joined(texts)
        begin, end = word_spans(data)
        words = span_hashes(data, begin, end)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        words[digits[end] > digits[begin]] = WILD
        breaks = np.flatnonzero(data == 10)
        text = np.searchsorted(starts, begin, side="right") - 1
        line = np.searchsorted(breaks, begin) + text  # a text ends a line as well
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.words, self.first = words, first
        self.size = np.diff(np.concatenate((first, [len(words)])))
        self.text = text[first]
        self.number = line[first] - self.text - np.searchsorted(breaks, starts[self.text])  # of the line in its text
        at = np.arange(len(words)) - np.repeat(first, self.size)
        with np.errstate(over="ignore"):
            placed = mix(words + mix(at.astype(np.uint64) + np.uint64(1)))
            lead = np.where(at < LEAD, placed, np.uint64(0))
            size = mix(self.size.astype(np.uint64))
            self.mask = (mix(np.add.reduceat(placed, first)) ^ size).view(np.int64) if len(first) else np.zeros(0, np.int64)
            self.leaf = (mix(np.add.reduceat(lead, first)) + size).view(np.int64) if len(first) else np.zeros(0, np.int64)


def templates(lines: np.ndarray, similarity: float) -> np.ndarray:
    """The template number of each line of one leaf; lines: a row of word hashes each, in a fixed order."""
    n, width = lines.shape
    known, wild, many = np.empty((16, width), lines.dtype), np.zeros((16, width), bool), 0
    out = np.zeros(n, np.int64)
    for i, words in enumerate(lines):
        same = known[:many] == words
        agree = (same | wild[:many]).sum(axis=1)
        best = int(agree.argmax()) if many else -1
        if best >= 0 and agree[best] >= similarity * width:
            grown = wild[best] | ~same[best]
            if grown.sum() <= (1 - similarity) * width:
                wild[best] = grown
            out[i] = best
        else:
            if many == len(known):
                known, wild = np.concatenate((known, np.empty_like(known))), np.concatenate((wild, np.zeros_like(wild)))
            known[many] = words
            out[i], many = many, many + 1
    return out


def near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are similar, by their SKETCH lowest hashes; exact where these are the whole sets."""
    both = np.union1d(x, y)[:SKETCH]
    shared = np.intersect1d(x, y, assume_unique=True)
    return 100 * int(np.isin(both, shared, assume_unique=True).sum()) >= PERCENT * len(both)


def copy_classes(known: DataFrame) -> DataFrame:
    """(key, class) of the texts that have near copies. known: key, bands, low."""
    keys = known.select("key", F.posexplode("bands").alias("band", "at")).distinct()
    hubs = keys.groupBy("band", "at").agg(F.min("key").alias("hub"), F.count("*").alias("size")).filter("size > 1")
    stars = stash(keys.join(hubs, ["band", "at"]).filter("key != hub").select("key", "hub").distinct())
    wanted = stars.select("key").unionByName(stars.select(F.col("hub").alias("key"))).distinct()
    low = stash(join_counted(known.select("key", "low"), wanted, "key", "left_semi").dropDuplicates(["key"]))
    pairs = stars.join(low, "key").join(low.select(F.col("key").alias("hub"), F.col("low").alias("hub_low")), "hub").select("key", "hub", "low", "hub_low")

    def confirmed(batches):
        for batch in batches:
            keep = [near(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = stash(pairs.mapInArrow(confirmed, "key long, hub long").select(F.col("key").alias("a"), F.col("hub").alias("b")))
    return stash(components(links).select(F.col("id").alias("key"), F.col("component").alias("class")))


def recurring_masks(docs: DataFrame, min_texts: int, similarity: float, copies_once: bool) -> DataFrame:
    """mask of every masked line that belongs to a recurring template. docs: key, text."""
    many = pa.list_(pa.int64())
    arrow = pa.schema([("key", pa.int64()), ("leaf", many), ("mask", many), ("bands", many), ("low", pa.binary())])

    def met(cols: dict) -> dict:
        texts = texts_as_bytes(cols["text"])
        got = Lines(texts)
        rows = np.unique(np.stack((got.text, got.leaf, got.mask), axis=1), axis=0)
        counts = np.bincount(rows[:, 0], minlength=len(texts))
        sets = shingles(texts) if copies_once else [rows[:0, 0]] * len(texts)
        bands = [band_keys(s) if len(s) else s for s in sets]
        return {"key": cols["key"], "leaf": list_array(rows[:, 1], counts, pa.int64()), "mask": list_array(rows[:, 2], counts, pa.int64()), "bands": list_array(np.concatenate([*bands, rows[:0, 0]]), [len(x) for x in bands], pa.int64()), "low": packed([s[:SKETCH] for s in sets])}

    known = stash(docs.mapInArrow(each_batch(met, arrow), "key long, leaf array<long>, mask array<long>, bands array<long>, low binary"))
    lines = known.select("key", F.explode(F.arrays_zip("leaf", "mask")).alias("x")).select("key", "x.leaf", "x.mask")
    live = lines.select("leaf", "key").distinct().groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_texts).select("leaf")
    live = stash(live)
    words = pa.schema([("leaf", pa.int64()), ("mask", pa.int64()), ("words", pa.list_(pa.int64()))])

    def spelled(cols: dict) -> dict:
        got = Lines(texts_as_bytes(cols["text"]))
        return {"leaf": got.leaf, "mask": got.mask, "words": list_array(got.words.view(np.int64), got.size, pa.int64())}

    full = join_counted(docs.mapInArrow(each_batch(spelled, words), "leaf long, mask long, words array<long>"), live, "leaf", "left_semi")
    full = stash(full.groupBy("leaf", "mask").agg(F.any_value("words").alias("words")))
    large = stash(full.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > CELL))
    cell = F.when(F.col("n").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", F.pmod(F.xxhash64("mask"), F.ceil(F.col("n") / CELL))))
    dealt = join_counted(full, large, "leaf", "left").select(cell.alias("cell"), "mask", "words").repartition("cell").sortWithinPartitions("cell", "mask")

    def grow(batches):
        """Templates leaf by leaf; a leaf may go on in the next batch."""
        kept: pa.Table | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            leaf, out = t.column("cell").to_numpy(), np.zeros(t.num_rows, np.int64)
            lists = t.column("words").combine_chunks()
            at = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
            for i, j in zip(at, [*at[1:], len(leaf)]):
                part = lists.slice(i, j - i)
                width = part.value_lengths().to_numpy(zero_copy_only=False)
                for w in np.unique(width):  # one width, but for a hash collision
                    rows = np.flatnonzero(width == w)
                    words = part.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), w)
                    with np.errstate(over="ignore"):
                        out[i + rows] = mix((leaf[i : i + 1].view(np.uint64) + templates(words, similarity).astype(np.uint64) * np.uint64(7919) + np.uint64(w))).view(np.int64)
            return pa.RecordBatch.from_arrays([t.column("mask").combine_chunks(), pa.array(out)], names=["mask", "template"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            leaf = t.column("cell").to_numpy()
            last = int(np.searchsorted(leaf, leaf[-1]))
            if last:
                yield done(t.slice(0, last))
            kept = t.slice(last)
        if kept is not None:
            yield done(kept)

    grown = stash(dealt.mapInArrow(grow, "mask long, template long"))
    if large.stashed_rows:
        whole = join_counted(full, large.select("leaf"), "leaf", "left_semi").join(grown, "mask")
        first = whole.groupBy("leaf", "template").agg(F.min_by("words", "mask").alias("words"))

        def merge(got: pa.Table) -> pa.Table:
            got = got.sort_by("template")
            words = got.column("words").combine_chunks()
            number, out = got.column("template").to_numpy(), np.zeros(got.num_rows, np.int64)
            width = words.value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                at = templates(words.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), w), similarity)
                out[rows] = number[rows[np.unique(at, return_index=True)[1]]][at]
            return pa.Table.from_arrays([got.column("template"), pa.array(out)], schema=pa.schema([("template", pa.int64()), ("merged", pa.int64())]))

        merged = stash(first.groupBy("leaf").applyInArrow(merge, "template long, merged long"))
        grown = join_counted(grown, merged, "template", "left").select("mask", F.coalesce("merged", "template").alias("template"))
    live_lines = join_counted(lines, live, "leaf", "left_semi").select("mask", "key")
    if copies_once:
        live_lines = join_counted(live_lines, copy_classes(known.select("key", "bands", "low")), "key", "left").select("mask", F.coalesce("class", "key").alias("key"))
    texts = live_lines.join(grown, "mask").select("template", "key").distinct().groupBy("template").agg(F.count("*").alias("n"))
    often = stash(texts.filter(F.col("n") >= min_texts).select("template"))
    found = stash(join_counted(grown, often, "template", "left_semi").select("mask").distinct())
    discard(known, live, full, grown)
    return found


def line_dedup(docs: DataFrame, *, min_texts: int = 5, similarity: float = 0.7, copies_once: bool = True) -> DataFrame:
    """docs with its text less the recurring lines, and n_lines, n_dropped (lines with a word) after its columns."""
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    texts = docs.filter(F.col("text").isNotNull()).select(key.alias("key"), "text")
    masks = recurring_masks(texts, min_texts, similarity, copies_once)
    own, hits, got = (unused(docs.columns, name) for name in ("_key", "_masks", "_left"))
    few = at_most(masks, BROADCAST_ROWS)
    if few:
        found = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["mask"] for r in masks.collect()], np.int64)))
        full = docs.withColumn(hits, F.lit(None).cast("array<long>"))
    else:  # each text's own recurring lines come by a join
        arrow = pa.schema([("key", pa.int64()), ("mask", pa.int64())])

        def met(cols: dict) -> dict:
            lines = Lines(texts_as_bytes(cols["text"]))
            return {"key": cols["key"].to_numpy()[lines.text], "mask": lines.mask}

        lines = texts.mapInArrow(each_batch(met, arrow), "key long, mask long").distinct().join(masks, "mask", "left_semi")
        lists = lines.groupBy("key").agg(F.collect_set("mask").alias(hits)).withColumnRenamed("key", own)
        full = docs.withColumn(own, key).join(lists, own, "left")
        found = None

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def drop(column: pa.Array, listed: pa.Array) -> pa.Array:
        """The new text, null where it is the old one, and the counts."""
        texts, counts, gone_counts, at = [], [], [], 0
        for part in pieces(column):
            old = part.to_pylist()
            lines = Lines([(t or "").encode() for t in old])
            masks = found.value if found is not None else np.unique(listed.slice(at, len(old)).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            at += len(old)
            hit = masks[np.minimum(np.searchsorted(masks, lines.mask), len(masks) - 1)] == lines.mask if len(masks) else np.zeros(len(lines.mask), bool)
            gone: dict[int, set[int]] = {}
            for t, number in zip(lines.text[hit].tolist(), lines.number[hit].tolist()):
                gone.setdefault(t, set()).add(number)
            texts += ["\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone[k]]) if k in gone else None for k, t in enumerate(old)]
            counts.append(np.bincount(lines.text, minlength=len(old)))
            gone_counts.append(np.bincount(lines.text[hit], minlength=len(old)))
        none = [np.zeros(0, np.int64)]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), *(pa.array(np.concatenate(x + none).astype(np.int64)) for x in (counts, gone_counts))], names=["text", "n_lines", "n_dropped"])

    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    full = full.withColumn(got, drop("text", hits))
    text = F.when(F.col(got)["n_dropped"] > 0, F.col(got)["text"]).otherwise(F.col("text"))
    return full.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in columns], F.col(got)["n_lines"].alias("n_lines"), F.col(got)["n_dropped"].alias("n_dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: lines met and dropped, code points and CRC-32 of the new text."""
    left = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32"))
