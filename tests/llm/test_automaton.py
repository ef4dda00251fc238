"""The compiled tokenization automaton against gadgets applied arc by arc, and its encoding against merging by rank."""

from __future__ import annotations

import sys

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe
from factloom.llm.bpe import Automaton


def literal(letters, merges):
    """arcs[state][token] = state, by merge gadgets on an explicit table: each u-arc to a state with a v-arc gets a copy of that state."""
    arcs = {0: {a: 0 for a in letters}}
    for u, v in merges:
        copies = {}
        before = {p: dict(out) for p, out in arcs.items()}
        for p, out in before.items():
            q = out.get(u)
            if q is None or v not in before[q]:
                continue
            if q not in copies:
                copies[q] = len(arcs) + len(copies)
            arcs[p][u + v] = before[q][v]
        for p in before:
            if arcs[p].get(u) in copies:
                arcs[p][u] = copies[arcs[p][u]]
        for q, copy in copies.items():
            arcs[copy] = {t: r for t, r in arcs[q].items() if t != v and not (u == v and t == u + v)}
    return arcs


def by_rank(word, merges):
    parts, rank = list(word), {m: k for k, m in enumerate(merges)}
    while True:
        found = [rank[p] for p in zip(parts, parts[1:], strict=False) if p in rank]
        if not found:
            return parts
        u, v = merges[min(found)]
        out, k = [], 0
        while k < len(parts):
            if parts[k : k + 2] == [u, v]:
                out.append(u + v)
                k += 2
            else:
                out.append(parts[k])
                k += 1
        parts = out


@st.composite
def merge_lists(draw):
    tokens, merges = list("abc"), []
    for _ in range(draw(st.integers(0, 12))):
        u, v = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        if u + v not in tokens:
            tokens.append(u + v)
            merges.append((u, v))
    return tokens, merges


@settings(max_examples=300, deadline=None)
@given(merge_lists(), st.text("abc", max_size=14))
def test_compiled_states(made, word):
    tokens, merges = made
    own, arcs = Automaton({t: k for k, t in enumerate(tokens)}, merges), literal("abc", merges)
    assert own.encode(word) == by_rank(word, merges)
    reached = {}  # the states of both after each token, wherever it stands
    ahead, seen = [(0, None)], set()
    while ahead:
        p, mine = ahead.pop()
        if (p, mine) in seen:
            continue
        seen.add((p, mine))
        assert {t for t in tokens if own.step(mine, t) is not None} == set(arcs[p])
        for t, q in arcs[p].items():
            assert reached.setdefault(t, own.step(mine, t)) == own.step(mine, t)
            ahead.append((q, own.step(mine, t)))


def test_end_of_word():
    vocab = {t: k for k, t in enumerate(["a", "b", "a</w>", "b</w>", "ab</w>", "aa", "aab</w>"])}
    own = Automaton(vocab, [("a", "b</w>"), ("a", "a"), ("aa", "b</w>")], "</w>")
    assert own.encode("ab") == ["ab</w>"] and own.encode("aab") == ["a", "ab</w>"] and own.encode("") == []
    assert own.encode("aaab") == ["aa", "ab</w>"]


def test_a_word_takes_few_looks_a_letter():
    merges = [("a", "b"), ("c", "ab"), ("ab", "cab"), ("abcab", "cab"), ("b", "c"), ("bc", "abcabcab"), ("c", "b</w>")]
    own, steps = Automaton({t: k for k, t in enumerate(["a", "b", "c", "a</w>", "b</w>", "c</w>", *(u + v for u, v in merges)])}, merges, "</w>"), 0
    word = "abcabcab" * 200 + "cb"

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        found = own.encode(word)
    finally:
        sys.settrace(before)
    assert "".join(found) == word + "</w>"
    assert steps < 8 * len(word)


def test_tables_of_words_stay_bounded_and_right(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.WordCodec(path)
    text = " ".join(f"word{k % 37}x, thing{k % 11}" for k in range(400)) + " <|endoftext|> \u0301 Été"
    expected = own.encode(text)
    for most in (1, 5):
        monkeypatch.setattr(bpe, "PIECES_KEPT", most)
        monkeypatch.setattr(bpe, "WORDS_KEPT", most)
        small = bpe.WordCodec(path)
        assert small.encode(text) == expected
        assert max(map(len, (small.kept, small.kept_before, small.coded, small.coded_before))) <= most
