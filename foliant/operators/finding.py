"""Find in text: where many terms stand in many texts, whatever their case."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The terms travel to every task: at most so many, and characters shown on both sides of a hit.
MOST_TERMS, AROUND = 100_000, 30


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and which character each of its own came from, where some became several."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def find_terms(texts: DataFrame, terms: list[str], *, key: str = "doc_id") -> DataFrame:
    """key, term, begin, end and context of every hit in texts (key, text), counted in characters; hits of one term do not overlap, the first counts.

    Terms are compared in lower case, without white space around them. One automaton of all terms reads each text once. A null text has no hits, nor
    has an empty term.
    """
    wanted = sorted({t.strip().lower() for t in terms if t and t.strip()})
    if len(wanted) > MOST_TERMS:
        raise ValueError(f"at most {MOST_TERMS} terms at once")
    schema = pa.schema([(key, pa.int64()), ("term", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, term in enumerate(wanted):
            machine.add_word(term, i)
        machine.make_automaton()
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, origin = lowered(text or "")
                free = [0] * len(wanted)
                for last, i in machine.iter(low):
                    begin = last + 1 - len(wanted[i])
                    if begin >= free[i]:
                        free[i] = last + 1
                        a, b = (begin, last + 1) if origin is None else (origin[begin], origin[last] + 1)
                        rows.append((name, wanted[i], a, b, text[max(0, a - AROUND) : b + AROUND]))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = f"{key} long, term string, begin long, end long, context string"
    if not wanted:
        return texts.select(F.col(key).cast("long"), "text").mapInArrow(lambda batches: iter(()), out)
    return texts.select(F.col(key).cast("long"), "text").mapInArrow(run, out)
