"""Packing the segments of one section into chunks; helpers of structure.chunk."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Fixed value: tokens allowed for what joins a segment to the next.
JOINT = 2


class Limits(NamedTuple):
    target: int
    least: int
    most: int
    overlap: int


class Piece(NamedTuple):
    kind: str
    text: str
    page: int
    end_page: int
    tokens: int
    forced: bool = False


def token_estimate(text: str) -> int:
    """The larger of words / 0.75 and characters / 4, rounded up; at least 1, but 0 for an empty text."""
    return max(1, math.ceil(max(len(text.split()) / 0.75, len(text) / 4))) if text else 0


def word_count(text: str) -> int:
    return len(text.split())


def gathered(units: list[tuple[str, int]], most: int, glue: str) -> Iterator[str]:
    """Units (text, tokens) joined in order as long as their tokens fit."""
    held: list[str] = []
    room = most
    for text, tokens in units:
        if held and tokens > room:
            yield glue.join(held)
            held, room = [], most
        held.append(text)
        room -= tokens
    if held:
        yield glue.join(held)


def fitted(piece: Piece, most: int, count: Callable[[str], int]) -> list[Piece]:
    """The piece, or parts of it that fit: rows of a table, else sentences, and words of a unit that alone is too long. Each unit is counted once."""
    if piece.tokens <= most:
        return [piece]
    rows = piece.kind in ("table", "list")
    units = [(u, count(u)) for u in map(str.strip, piece.text.split("\n") if rows else SENTENCE.split(piece.text)) if u]
    out: list[str] = []
    run: list[tuple[str, int]] = []
    for unit, tokens in units:
        if tokens > most:
            out += gathered(run, most, "\n" if rows else " ")
            run = []
            out += gathered([(w, count(w)) for w in unit.split()], most, " ")
        else:
            run.append((unit, tokens))
    out += gathered(run, most, "\n" if rows else " ")
    return [piece._replace(text=t, tokens=count(t), forced=True) for t in out]


def carried(pieces: list[Piece], budget: int, count: Callable[[str], int]) -> list[Piece]:
    """The last paragraphs that fit the budget; of the first that does not, its last whole sentences."""
    tail: list[Piece] = []
    for piece in reversed([p for p in pieces if p.kind == "paragraph"]):
        if piece.tokens <= budget:
            tail.append(piece)
            budget -= piece.tokens
            continue
        taken: list[str] = []
        used = 0
        for sentence in reversed([s for s in map(str.strip, SENTENCE.split(piece.text)) if s]):
            tokens = count(sentence)
            if used + tokens > budget:
                break
            taken.append(sentence)
            used += tokens
        if taken:
            tail.append(piece._replace(text=" ".join(reversed(taken)), tokens=used, forced=False))
        break
    return tail[::-1]


@dataclass
class Open:
    """The chunk being filled: what it carries over and what is its own."""

    over: list[Piece] = field(default_factory=list)
    own: list[Piece] = field(default_factory=list)

    @property
    def tokens(self) -> int:
        return sum(p.tokens for p in self.over) + sum(p.tokens + JOINT for p in self.own)

    def closed(self, count: Callable[[str], int]) -> dict:
        every = self.over + self.own
        content = "\n\n".join(p.text for p in every)
        return {
            "content": content, "token_count": count(content), "page": every[0].page, "end_page": every[-1].end_page, "contains_table": any(p.kind == "table" for p in every),
            "contains_list": any(p.kind == "list" for p in every), "forced_split": any(p.forced for p in every),
        }


def pack_section(segments: list[tuple[str, str, int, int]], limits: Limits, count: Callable[[str], int]) -> list[dict]:
    """The chunks of a section's segments (kind, text, page, end_page); those without text are passed over."""
    chunks: list[dict] = []
    held, size = Open(), 0
    for kind, text, page, end_page in [s for s in segments if s[1]]:
        for piece in fitted(Piece(kind, text, page, end_page, count(text)), limits.most, count):
            if held.own and size + piece.tokens > limits.target:
                chunks.append(held.closed(count))
                over = carried(held.own, min(limits.overlap, limits.most // 2), count)
                held = Open(over if sum(p.tokens for p in over) + piece.tokens <= limits.most else [])
                size = held.tokens
            held.own.append(piece)
            size += piece.tokens + JOINT
    if held.own:
        chunks.append(held.closed(count))
    return joined(chunks, limits, count)


def joined(chunks: list[dict], limits: Limits, count: Callable[[str], int]) -> list[dict]:
    """Chunks that are too small take in the one after them while both fit the target."""
    out: list[dict] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and last["token_count"] < limits.least and last["token_count"] + c["token_count"] <= limits.target:
            content = f"{last['content']}\n\n{c['content']}"
            flags = {x: last[x] or c[x] for x in ("contains_table", "contains_list", "forced_split")}
            out[-1] = {"content": content, "token_count": count(content), "page": last["page"], "end_page": max(last["end_page"], c["end_page"])} | flags
        else:
            out.append(c)
    return out
