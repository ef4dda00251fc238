"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens; its language are the token sequences that BPE makes. It is compiled by applying one merge
gadget after another to the automaton of single letters, which has one state with an arc to itself for each letter. The
gadget of merge u v -> w takes the state q that u's arcs lead to: u's arcs lead from now on to a copy of q without its arc
for v, and whatever state has an arc for u gets one for w, to where v's arcs lead. Two things keep this small. All arcs
of one token lead to one state, so the automaton is a table from tokens to states; and a state only lacks arcs, so it is
the list of what it lacks. A state that lacks u never gets w, so what one gadget takes away is v and all tokens that
later grow from v on the right: a span, if tokens are numbered in preorder of "begins with", latest first. States that
lack the same are one state. The result is deterministic: state and token give the next state, or none.

Words are read arc by arc, the longest token first that has an arc and spells what comes next; where none has, the token
before gives way to a shorter one. Every prefix of a word has exactly one accepted sequence, so no place in a word is reached
twice; the work is the letters times the longest token at most, and mostly about two looks a letter. Decoding emits the labels of the arcs.

Pieces between white space repeat, and so do the words that the tokenizer's pattern cuts from them when normalised; the
encodings of both are kept in tables of bounded size.

Defined cases: a null text is empty; an empty text has no ids; special tokens inside a text become their ids, as the
tokenizers library does by default; equal texts give equal rows, also rows that repeat; null doc_ids pass through; texts
of any length are read in one pass; a table without rows gives none; other columns of the input are not returned.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_right

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factloom.llm.shared import SPACE

PIECES_KEPT, WORDS_KEPT, LONGEST_KEPT = 120_000, 100_000, 100  # two tables each
#: A letter that no vocabulary has, for the end of a word.
END = "\uffff"
_CHUNK = re.compile(f"[^{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def preorder(tokens: list[str], merges: list[tuple[str, str]]) -> dict[str, int]:
    """A number for each token: letters, and after each token those that merges grow from it on the right, the latest first."""
    grown: dict[str, list[str]] = {}
    for u, v in merges:
        grown.setdefault(u, []).append(u + v)
    made, number = {u + v for u, v in merges}, {}
    ahead = [t for t in tokens if t not in made]
    while ahead:
        token = ahead.pop()
        number[token] = len(number)
        ahead += grown.get(token, ())
    return number


class Automaton:
    """The tokenization automaton of a vocabulary and its merges in order; end is the mark of a word's last letter.

    number: the place of each token in preorder; state: the state that its arcs lead to; lacks: for each state the bounds
    of the spans of places that it has no arc for, ascending (so a place is lacking if an odd number of bounds is at or
    below it).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.label, self.end = {i: t for t, i in vocab.items()}, end
        made = {u + v for u, v in merges}
        if len(made) != len(merges):
            raise ValueError("two merges make one token")
        self.number = preorder([t for t in vocab if t in made or len(t.removesuffix(end)) == 1 or len(t) == 1], merges)
        self._compile(merges)
        # every beginning of a token (spelled with one letter for the end) and the longest token that begins it
        spelled = {t.removesuffix(end) + END if end and t.endswith(end) else t: t for t in self.state}
        self.heads: dict[str, str | None] = {t[:k]: None for t in spelled for k in range(1, len(t) + 1)}
        for head in sorted(self.heads, key=len):
            self.heads[head] = head if head in spelled else self.heads.get(head[:-1])
        self.arcs = {t: (self.number[name], self.lacks[self.state[name]], self.heads.get(t[:-1]), name) for t, name in spelled.items()}

    def _compile(self, merges: list[tuple[str, str]]) -> None:
        size = dict.fromkeys(self.number, 1)
        for u, v in reversed(merges):
            size[u] += size[u + v]
        # what a state lacks, as a chain of spans: a copy of a state shares the chain of the state it is made from
        chain: dict[str, tuple] = dict.fromkeys(self.number, ())
        for u, v in merges:
            if u not in chain or v not in chain or self._lacking(chain[u], self.number[v]):
                chain.pop(u + v)  # no path for the gadget to act on, so the token never comes up
            else:
                chain[u + v] = chain[v]  # before the next line: of two equal letters a third one may follow the pair
                chain[u] = (chain[u], self.number[v], self.number[v] + size[v])
            size[u] -= size[u + v]  # what has grown from u so far; only what grows later goes with it
        found: dict[tuple[int, ...], int] = {}
        known: dict[int, int] = {}
        self.state: dict[str, int] = {}
        for token, links in chain.items():
            if id(links) not in known:
                known[id(links)] = found.setdefault(self._bounds(links), len(found))
            self.state[token] = known[id(links)]
        self.lacks = [array("I", bounds) for bounds in found]

    @staticmethod
    def _lacking(links: tuple, place: int) -> bool:
        while links:
            links, first, stop = links
            if first <= place < stop:
                return True
        return False

    @staticmethod
    def _bounds(links: tuple) -> tuple[int, ...]:
        spans, bounds = [], []
        while links:
            links, first, stop = links
            spans.append((first, stop))
        for first, stop in sorted(spans):
            if bounds and first <= bounds[-1]:
                bounds[-1] = max(bounds[-1], stop)
            else:
                bounds += first, stop
        return tuple(bounds)

    def step(self, state: int | None, token: str) -> int | None:
        """The state that a token's arc leads to, or None where the state has no such arc. None is the start, which has all."""
        if state is not None and bisect_right(self.lacks[state], self.number[token]) % 2:
            return None
        return self.state.get(token)

    def encode(self, word: str) -> list[str]:
        """Tokens of one word, given as its letters."""
        if not word:
            return []
        heads, arcs, text = self.heads, self.arcs, word + END if self.end else word
        stop, at, lacks, out = len(text), 0, (), []
        path: list[tuple[int, tuple | array, str | None]] = []  # where each token began, what the state lacked there, and the next shorter token
        far = 1
        while text[:far] in heads and far <= stop:
            far += 1
        token = heads.get(text[: far - 1])
        while True:
            while token is not None:
                place, after, shorter, name = arcs[token]
                if not bisect_right(lacks, place) & 1:
                    break
                token = shorter
            if token is None:  # the prefix read so far is not how the word goes on
                if not path:
                    raise ValueError(f"no tokens for {word!r}")
                out.pop()
                at, lacks, token = path.pop()
                continue
            path.append((at, lacks, shorter))
            out.append(name)
            at += len(token)
            if at == stop:
                return out
            lacks, far = after, at + 1
            while text[at:far] in heads and far <= stop:
                far += 1
            token = heads.get(text[at : far - 1])


class WordCodec:
    """Encoder and decoder of a word-end BPE tokenizer file: NFC, one space, lower case, words by pattern, byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in self.special))
        self.letters = dict(enumerate(byte_letters()))
        self.labels = {**self.automaton.label, **{i: t for t, i in self.special.items()}}
        self.path, self.library = path, None
        self.digits = {t: str(i) for t, i in model["vocab"].items()}
        # two tables each, the newer one filled anew when it is full: what is asked for again passes into it, the rest goes
        self.kept: dict[str, tuple[str, str]] = {}
        self.kept_before: dict[str, tuple[str, str]] = {}
        self.coded: dict[str, tuple[str, str]] = {}
        self.coded_before: dict[str, tuple[str, str]] = {}

    def words(self, piece: str) -> list[str]:
        """The letters of each word of a piece.

        Unicode tables differ between Python and the tokenizers library in characters that Python holds for unassigned;
        a piece with one is normalised and split by the library, so its words are the library's.
        """
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
                return [piece[:-1].lower(), piece[-1]]
            return [w.translate(self.letters) for w in self.pattern.findall(piece.lower())]
        if max(piece) < "\u0100":  # Latin letters, which normalising leaves as they are
            word, mark = (piece[:-1], piece[-1:]) if piece[-1] in ".,;:!?" else (piece, "")
            if word.isalpha():
                return [word.lower().encode().decode("latin-1").translate(self.letters), *mark]
        if any(unicodedata.category(c) == "Cn" for c in piece):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]
        clean = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        return [w.encode().decode("latin-1").translate(self.letters) for w in self.pattern.findall(clean)]

    def word(self, word: str) -> tuple[str, str]:
        """Decimal ids of a word and their decoding, each joined by a space, kept for next time."""
        found = self.coded_before.get(word)
        if found is None:
            tokens = self.automaton.encode(word)
            found = (" ".join(map(self.digits.__getitem__, tokens)), " ".join(tokens))
        if len(self.coded) >= WORDS_KEPT:
            self.coded_before = self.coded.copy()
            self.coded.clear()
        if len(word) <= LONGEST_KEPT:
            self.coded[word] = found
        return found

    def chunk(self, piece: str) -> tuple[str, str]:
        """Decimal ids of a piece of text without white space and their decoding, each joined by a space, kept for next time."""
        found = self.kept_before.get(piece)
        if found is None:
            made = [self.coded.get(w) or self.word(w) for w in self.words(piece)]
            found = made[0] if len(made) == 1 else (" ".join([x[0] for x in made]), " ".join([x[1] for x in made]))
        if len(self.kept) >= PIECES_KEPT:
            self.kept_before = self.kept.copy()
            self.kept.clear()
        if len(piece) <= LONGEST_KEPT:
            self.kept[piece] = found
        return found

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the decimal ids joined by a space, and their decoding."""
        text, kept, found = text or "", self.kept, []
        sections = [s for s in self.split.split(text) if s] if "<|" in text else [text]
        for section in sections:
            if section in self.special:
                found.append((str(self.special[section]), section))
            else:
                pieces = _CHUNK.findall(section) if _ODD.search(section) else section.split()
                found += [kept.get(piece) or self.chunk(piece) for piece in pieces]
        ids, labels = zip(*found, strict=True) if found else ((), ())
        if "" in ids:  # pieces that normalising leaves nothing of
            ids, labels = filter(None, ids), filter(None, labels)
        joined = " ".join(ids)
        return joined.count(" ") + 1 if joined else 0, joined, " ".join(labels)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by a space (the file names no decoder)."""
        return " ".join(map(self.labels.__getitem__, ids))


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """The codec of a file, made once in each process."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str, texts: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of docs(doc_id, text); with texts also ids (array) and decoded."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches):
        own = codec(path)
        for batch in batches:
            counts, digests, ids, decoded = [], ([], []), [], []
            for x in batch.column("text"):
                n, *joined = own.encode(x.as_py())
                counts.append(n)
                for found, made in zip(joined, digests, strict=True):
                    made.append(hashlib.sha256(found.encode()).hexdigest())
                if texts:
                    ids.append([int(i) for i in joined[0].split()])
                    decoded.append(own.decode(ids[-1]))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(d, pa.string()) for d in digests]]
            if texts:
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in fields.split(",")])

    return docs.select("doc_id", "text").select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, fields)
