"""Fill-in-middle transformation: a sparse checkpoint index over units.

A unit is a word with the white space before it, or the white space at the end of the text. While a text's units are counted, the byte and
code-point offset after every `step` units is kept. A cut after some number of units is found by binary search among these checkpoints and a
rescan of fewer than `step` units. Draws come from a hash of seed and doc_id, so reruns agree and rows need no shuffle.

Defined cases: a null text counts as empty; an empty text, or one that holds a marker, stays plain; a text of white space alone is one unit; a null
doc_id draws as an empty one does; rows that share an id draw alike and are cut one by one; a very long text is scanned in blocks, so that only the
text, its checkpoints and its new form are held; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import _SPACE, each_batch, table, texts_as_bytes

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def unit_ends(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Byte offsets in data, after begin and up to end, where a word ends."""
    space = _SPACE[data[begin : end + 1]]
    if end >= len(data):
        space = np.append(space, True)
    return np.flatnonzero(~space[:-1] & space[1:]) + begin + 1


def characters(data: np.ndarray, begin: int, end: int) -> int:
    """Code points that begin in data[begin:end]."""
    return int(np.count_nonzero((data[begin:end] & 0xC0) != 0x80))


class Checkpoints:
    """The number of units of a text, and where every `step`-th of them ends, in bytes and code points."""

    def __init__(self, text: bytes, step: int, block: int = 1 << 20):
        self.data, self.block = np.frombuffer(text, np.uint8), block
        units, offsets, points, words, chars = [0], [0], [0], 0, 0
        for begin in range(0, len(text), block):
            end = min(begin + block, len(text))
            ends = unit_ends(self.data, begin, end)
            at = begin
            for k in range(step - words % step - 1, len(ends), step):
                chars += characters(self.data, at, int(ends[k]))
                at = int(ends[k])
                units.append(words + k + 1)
                offsets.append(at)
                points.append(chars)
            chars += characters(self.data, at, end)
            words += len(ends)
        self.units, self.offsets, self.points = (np.array(x, np.int64) for x in (units, offsets, points))
        self.n, self.chars = words + (len(text) > 0 and bool(_SPACE[text[-1]])), chars

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset where the first `unit` units end."""
        if unit >= self.n:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        left, start = unit - int(self.units[k]), int(self.offsets[k])
        at, size = start, 4096
        while left:
            ends = unit_ends(self.data, at, min(at + size, len(self.data)))
            if len(ends) >= left:
                at, left = int(ends[left - 1]), 0
            else:
                at, left, size = min(at + size, len(self.data)), left - len(ends), min(2 * size, self.block)
        return at, int(self.points[k]) + characters(self.data, start, at)


def rearrange(text: bytes, form: str, h1: int, h2: int, step: int) -> tuple[int, int | None, int | None, bytes]:
    """Number of units, code points of prefix and middle, and the text in its new form."""
    index = Checkpoints(text, step)
    if form == "plain":
        return index.n, None, None, text
    (a, a_chars), (b, b_chars) = (index.cut(f(h1 % (index.n + 1), h2 % (index.n + 1))) for f in (min, max))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return index.n, a_chars, b_chars - a_chars, b"".join(parts)


def fill_in_middle(docs: DataFrame, *, seed: int = 42, percent: int = 50, spm_percent: int = 80, step: int = 64) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output (the new text) of every row of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")

    def run(cols: dict) -> dict:
        texts, forms = texts_as_bytes(cols["text"]), cols["form"].to_pylist()
        rows = [rearrange(t, f, a, b, step) for t, f, a, b in zip(texts, forms, cols["h1"].to_pylist(), cols["h2"].to_pylist())]
        n, prefix, middle, output = zip(*rows)
        return {"doc_id": pc.cast(cols["doc_id"], pa.int64()), "n": n, "form": forms, "prefix_chars": prefix, "middle_chars": middle, "output": pa.array(output, pa.binary())}

    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    return rows.mapInArrow(each_batch(run, ARROW), OUT)


def restored(output: Column, form: Column) -> Column:
    """The text before fill_in_middle, from its output and form."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(x, 256).alias(n) for x, n in ((F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256"))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: Texts are cut into lists of units here.
SQL = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
 u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
   CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM h),
 c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
 p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p"""
