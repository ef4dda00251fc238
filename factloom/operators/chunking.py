"""Content blocks under their headings, and chunks of documents with overlap, each in one pass over a text.

Both are folds: what a line or paragraph becomes depends on all before it in the same document (the open headings, the
open chunk, the tail of the last one). Documents are independent, so Spark deals them out and each task reads one text at a
time, once; what is kept beside the text is three headings, or one chunk.

Defined cases: a null text is empty; an empty one has no blocks and no chunks; lengths are in characters; texts of any length
are read whole; rows that repeat a key give their blocks or chunks again; other columns of the input are not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Small words of titles, and words that make a line a sentence.
SMALL_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
SENTENCE_WORDS = [
    "is", "are", "was", "were", "will", "shall", "should", "must", "has", "have", "had", "targets", "supports", "seeks", "aims", "includes", "requires", "provides",
]
#: List marks of bullets.
BULLETS = "•●▪◦‣⁃*-"
_MARKED = [("number", re.compile(r"([0-9]+)[.)] (.+)")), ("bullet", re.compile(rf"([{re.escape(BULLETS)}]) (.+)")), ("letter", re.compile(r"([a-zA-Z])[.)] (.+)"))]
_SENTENCE_WORD = re.compile(r"\b(?:" + "|".join(SENTENCE_WORDS) + r")\b", re.I | re.A)
_TITLE_WORD = re.compile(r"[A-Z0-9][A-Za-z0-9'-]*")
_SIGNS = re.compile(r"[^a-zA-Z0-9'-]+")
_BLANKS = re.compile(r"[ \t]+")
#: Fixed value: second characters of marked lines.
_SECOND = frozenset(".) 0123456789")
#: Fixed value: how a page is marked.
_PAGE = re.compile(r"(?:^|\n)\s*--\s*(\d+)\s+of\s+(\d+)\s*--\s*(?:\n|$)", re.I | re.A)


def tidy(line: str) -> str:
    """A line with single spaces and none around it."""
    line = line.replace("\xa0", " ")
    return (_BLANKS.sub(" ", line) if "\t" in line or "  " in line else line).strip()


def bare(heading: str) -> str:
    return tidy(heading).rstrip(":;,.!?").strip()


def is_title(words: list[str]) -> bool:
    """Whether four of five words look as in a title: a capital or digit first, or a small word."""
    if not 0 < len(words) <= 12:
        return False
    kept = [w for w in (_SIGNS.sub("", w) for w in words) if w]
    return bool(kept) and 5 * sum(w.lower() in SMALL_WORDS or bool(_TITLE_WORD.fullmatch(w)) for w in kept) >= 4 * len(kept)


def is_sentence(line: str) -> bool:
    return line.endswith((".", "!", "?")) or len(line.split()) > 14 or bool(_SENTENCE_WORD.search(line))


def marked(line: str) -> tuple[str | None, str | None, str]:
    """Kind of list mark, mark and the rest of a tidy line."""
    if line[1:2] not in _SECOND:
        return None, None, line
    for kind, pattern in _MARKED:
        found = pattern.fullmatch(line)
        if found:
            return kind, found[1], found[2].strip()
    return None, None, line


def is_heading(line: str, before: str, after: str) -> bool:
    """Whether a line without list mark is a heading, given the tidy line before it and the next one that is not blank."""
    own = bare(line)
    words = own.split()
    listed = len(words) <= 6 and marked(after)[0] is not None
    # most lines are none by where they stand, so their words are looked at last
    if not listed and before and after and len(words) > 4:
        return False
    return is_title(words) and (listed or not is_sentence(own))


def blocks(text: str) -> Iterator[tuple[int, str, str, list[str], str | None, str | None]]:
    """(line number, type, content, headings above, kind of mark, mark) of the paragraphs and list items of a text.

    The first heading stays the title; a numbered one opens a section below it; others go one deeper, three levels at most.
    """
    lines = [tidy(x) for x in text.replace("\r\n", "\n").split("\n")]
    following = [""] * len(lines)
    for k in range(len(lines) - 2, -1, -1):
        following[k] = lines[k + 1] or following[k + 1]
    above: list[str] = []
    for k, line in enumerate(lines):
        if not line:
            continue
        kind, mark, content = marked(line)
        if kind == "number" and len(words := bare(content).split()) <= 8 and is_title(words) and not is_sentence(bare(content)):
            above = [*above[:1], bare(content)]
        elif kind is None and is_heading(line, lines[k - 1] if k else "", following[k]):
            above = [*above[:2], bare(line)]
        else:
            yield k + 1, "listItem" if kind else "paragraph", content, list(above), kind, mark


@dataclass(frozen=True)
class Sizes:
    """Lengths of chunks in characters: where one is closed, what it may reach, what is too short, and the tail taken over."""

    target: int = 3200
    most: int = 4500
    least: int = 300
    overlap: int = 350

    def __post_init__(self):
        if self.target < 500 or self.most < self.target or self.least < 50 or not 0 <= self.overlap < self.target:
            raise ValueError("sizes of chunks that can't be met")


def plain(text: str) -> str:
    """A text without NULs, trailing and repeated blanks, and with at most one empty line in a row."""
    text = text.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")
    # a pattern reads a text only if something in it can match
    if "\t" in text or " \n" in text:
        text = re.sub(r"[ \t]+\n", "\n", text)
    if "\t" in text or "  " in text:
        text = re.sub(r"[ \t]{2,}", " ", text)
    return (re.sub(r"\n{3,}", "\n\n", text) if "\n\n\n" in text else text).strip()


def pages(text: str, least: int) -> list[tuple[int | None, int | None, str]]:
    """(first page, last page, text) of the page groups of a text; a page under `least` characters goes with the next, the last with the one before."""
    text = plain(text)
    marks = list(_PAGE.finditer(text)) if "--" in text else []
    if marks:
        stops = [m.start() for m in marks[1:]] + [len(text)]
        single = [(int(m[1]) or None, text[m.end() : stop].strip()) for m, stop in zip(marks, stops, strict=True)]
        single[0] = (single[0][0], f"{text[: marks[0].start()].strip()}\n\n{single[0][1]}")
    else:
        single = [(None, text)]
    groups: list[tuple[int | None, int | None, str]] = []
    waiting = False  # whether the last group is still too short
    for number, body in single:
        body = plain(body)
        if not body:
            continue
        if waiting:
            first, _, held = groups.pop()
            groups.append((first, number, f"{held}\n\n{body}"))
        else:
            groups.append((number, number, body))
        waiting = len(groups[-1][2]) < least
    if waiting and len(groups) > 1:
        _, last, body = groups.pop()
        first, _, held = groups.pop()
        groups.append((first, last, f"{held}\n\n{body}"))
    return groups


def is_section(paragraph: str) -> bool:
    """Whether a paragraph of one line names a section: by number, capitals, or title words without end mark."""
    if len(paragraph) > 180 or "\n" in paragraph:
        return False
    words = paragraph.split()
    if len(words) > 18:
        return False
    numbered = re.match(r"(?:(?:chapter|section|part|article|appendix|annex)\s+[0-9ivxlcdm.-]+|[0-9]+(?:\.[0-9]+){0,4}[\s.)-]+\S)", paragraph, re.I)
    loud = len(paragraph) >= 4 and paragraph == paragraph.upper() and re.search("[A-Z]", paragraph)
    titled = sum(bool(re.fullmatch(r"[A-Z][A-Za-z0-9/&(),'-]*", w)) for w in words)
    return bool(numbered or loud or (len(words) >= 2 and 10 * titled >= 7 * len(words) and not paragraph.endswith((".", "!", "?"))))


def pieces(paragraph: str, most: int) -> Iterator[str]:
    """A paragraph, or its sentences packed into pieces of up to `most` characters; a longer sentence is cut."""
    if len(paragraph) <= most:
        yield paragraph
        return
    # a line without end mark inside a paragraph is no sentence, unless there is none at all
    found = [m[0].strip() for m in re.finditer(r"[^.!?\n]+([.!?]*)", paragraph) if m[1] or m.end() == len(paragraph)] or [paragraph]
    held = ""
    for sentence in found:
        if held and len(held) + len(sentence) + 1 > most or len(sentence) > most:
            if held:
                yield held
            held = ""
        if len(sentence) > most:
            yield from filter(None, (sentence[at : at + most].strip() for at in range(0, len(sentence), most)))
        elif sentence:
            held = f"{held} {sentence}" if held else sentence
    if held:
        yield held


def tail(content: str, size: int) -> str:
    """The last `size` characters, from after their first end of a sentence."""
    end = content[-size:] if size else ""
    found = re.search(r"[.!?]\s", end)
    return (end[found.end() :] if found else end).strip()


def chunks(text: str, sizes: Sizes) -> Iterator[tuple[str, str, int | None, int | None]]:
    """(content, section, first page, last page) of the chunks of a text, in order."""
    for first, last, body in pages(text, sizes.least):
        if len(body) < sizes.least:
            continue
        held = section = before = ""

        def closed():
            nonlocal held, before
            own, over = held.strip(), tail(before, sizes.overlap)
            held = ""
            if own:
                before = own if not over or own.startswith(over) else f"{over}\n\n{own}"
                yield before, section, first, last

        for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", body))):
            for block in pieces(paragraph, sizes.most):
                if is_section(block):
                    if len(held) >= sizes.least:
                        yield from closed()
                    section = " ".join(block.split())[:500]
                    held = f"{held}\n\n{block}" if held else block
                    continue
                if held and len(held) + 2 + len(block) > sizes.most and len(held) >= sizes.least:
                    yield from closed()
                    held = section
                held = f"{held}\n\n{block}" if held else block
                if len(held) >= sizes.target:
                    yield from closed()
                    held = section
        yield from closed()


def _rows(make, names: list[str], types: list[pa.DataType], most: int = 1024, keep: bool = False):
    """A mapInArrow function: rows of make(text) after the key, at most `most` at once, of one text or several. With keep a text that makes none gives a row of nulls."""

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                none = True
                for row in make(text.as_py() or ""):
                    none = False
                    rows.append((key, *row))
                    if len(rows) == most:
                        yield batch_of(rows)
                        rows = []
                if none and keep:
                    rows.append((key, *[None] * (len(names) - 1)))
            if rows:
                yield batch_of(rows)

    return run


def context_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line, type, content, path (headings above, outermost first), mark_type, mark of each paragraph and list item of docs(key, text)."""
    names = [key, "line", "type", "content", "path", "mark_type", "mark"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    fields = f"{key} long, line long, type string, content string, path array<string>, mark_type string, mark string"
    return docs.select(docs[key].cast("long"), "text").mapInArrow(_rows(blocks, names, types), fields)


def chunked(docs: DataFrame, sizes: Sizes = Sizes(), key: str = "doc_id", keep: bool = False) -> DataFrame:
    """key, chunk (from 0), content, section, page_start, page_end, n_tokens (characters by four, rounded up), n_chars of docs(key, text). With keep a text without chunks gives a row of nulls."""

    def make(text: str):
        for at, (content, section, first, last) in enumerate(chunks(text, sizes)):
            yield at, content, section, first, last, -(-len(content) // 4), len(content)

    names = [key, "chunk", "content", "section", "page_start", "page_end", "n_tokens", "n_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    fields = f"{key} long, chunk long, content string, section string, page_start long, page_end long, n_tokens long, n_chars long"
    return docs.select(docs[key].cast("long"), "text").mapInArrow(_rows(make, names, types, keep=keep), fields)
