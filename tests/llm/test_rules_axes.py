"""Each repetition axis of the rules can reject a document by itself, within the range that the base rule leaves."""

from __future__ import annotations

import random

from factloom.llm import rules


def test_repetition_outliers_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(10))
    texts = [chr(10).join(line() for _ in range(12)) for _ in range(400)]
    texts.append(chr(10).join(f"{line()}\nread more" for _ in range(30)))  # half its lines a banner between unique lines
    again = " ".join(word() for _ in range(8))
    texts.append(" ".join(f"{line()} {word()} {again}" for _ in range(8)))  # repeated words in one line, under the base limit
    texts.append(chr(10).join([line() for _ in range(30)] + ["read more"] * 3))  # a few duplicate lines are no outlier
    docs = spark.createDataFrame([(k, t, "en", "web") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in rules.verdicts(docs).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert rows[400]["n_repeat_words"] == 0 and rows[401]["n_dup_lines"] == 0
    assert [k for k, r in sorted(rows.items()) if not r["kept"]] == [400, 401]
