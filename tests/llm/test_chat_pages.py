"""Reply trees against enumerated paths; pages whose boilerplate markup names or the host's repetition gives away."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, pages
from factloom.llm.shared import write_shared

TREE = "tree long, node long, parent long, score double, role string, text string"


def leaf_paths(spark, rows, per_tree=99):
    """{(tree, leaf): (path, score, rank)} of the ranked leaves."""
    tables = chat.climbs(write_shared(spark.createDataFrame(rows, TREE), "t"))
    leaves = write_shared(chat.ranked_leaves(tables, per_tree), "t")
    found = {(r["tree"], r["leaf"]): ([], r["score"], r["rank"]) for r in leaves.collect()}
    for r in chat.paths(tables, leaves).orderBy("pos").collect():
        path = found[r["tree"], r["leaf"]][0]
        assert r["pos"] == len(path)
        path.append(r["node"])
    return found


def test_paths_of_a_branching_tree(spark):
    parents = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 5, 7: 99, 8: 9, 9: 8}  # 7's parent is missing; 8 and 9 form a cycle
    rows = [(t, n, p, float(n), "user", f"m{n}") for t in (1, None) for n, p in parents.items()]
    found = {k: v[:2] for k, v in leaf_paths(spark, rows).items()}
    expected = {3: [1, 3], 4: [1, 2, 4], 6: [1, 2, 5, 6], 7: [7]}
    assert found == {(t, leaf): (p, float(sum(p))) for t in (1, None) for leaf, p in expected.items()}
    best = leaf_paths(spark, rows, 2)
    assert sorted((v[2], leaf) for (t, leaf), v in best.items() if t == 1) == [(1, 6), (2, 4)]  # leaf 7 ties with 4


def test_random_trees(spark):
    rng, rows, expected = random.Random(2), [], {}
    for t in range(12):
        parents = {n: rng.choice([None, *range(n)]) if n else None for n in range(rng.randrange(1, 40))}
        rows += [(t, n, p, rng.randrange(9) / 4, "user", "x") for n, p in parents.items()]
        score = {n: s for tree, n, _, s, *_ in rows if tree == t}
        for leaf in set(parents) - set(parents.values()):
            path = [leaf]
            while parents[path[0]] is not None:
                path.insert(0, parents[path[0]])
            expected[t, leaf] = (path, sum(score[n] for n in path))
    assert {k: v[:2] for k, v in leaf_paths(spark, rows).items()} == expected


def test_one_conversation_of_50_000_turns(spark):
    rows = spark.range(50_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    done = chat.format_conversations(rows).select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), F.size("mask").alias("spans"), F.md5("formatted").alias("digest")).collect()
    text = "<s>\n" + "".join(f"[{'OUT' if k % 2 else 'INST'}]\nt{k}\n[/{'OUT' if k % 2 else 'INST'}]\n" for k in range(50_000)) + "</s>"
    assert [tuple(r) for r in done] == [(50_000, 25_000, hashlib.md5(text.encode()).hexdigest())]


TEXTS = [None, "", "</s>[INST] ok [/INST]", "\\</s>", "\\\\[OUT]\n[/OUT]\n", "[MSG]\n[/SYS]", "a\nb\n", "<s>", "$1 \\1", "[/MSG]\\"]


def test_round_trip(spark):
    rows = [(c, k, role, t) for c, role in enumerate(["user", "assistant", "system", "tool [/MSG]\n", None]) for k, t in enumerate(TEXTS)]
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, None, "assistant", "z")]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["tree"]: r for r in done.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    for c, role in enumerate(["user", "assistant", "system", "tool [/MSG]\n", ""]):
        assert [(t["role"], t["text"]) for t in found[c]["turns"]] == [(role, t or "") for t in TEXTS]
        assert found[c]["loss"] == ("".join(t or "" for t in TEXTS) if role == "assistant" else "")
    assert len(found[7]["turns"]) == 2 and found[None]["loss"] == "z"


def test_no_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


PAGE = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, PAGE)).collect()}


def test_markup_names_boilerplate(spark):
    html = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li>menu</li></ul></nav><div class='cookie-notice'>ok?</div><article><h1>Head &amp; line</h1>"
        "<p>One <b>two</b>\n three&nbsp;four</p><script>var x='<p>no</p>'</script><p>Tail &lt;p&gt; &#233;<form><input>send</form></article><aside>side</aside><section class=comments><p>me too</p></section><footer>end</footer></body></html>"
    )
    assert texts(spark, [(1, "http://a.b/x", html)])[1] == "Head & line One two three four Tail <p> é"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='layout with-sidebar'><article><p>One</p></article><div class='sidebar left'>no</div></div>", "One"),
        ("<div class='content no-comments'><p>Two</p><div class='ad-slot-2'>no</div></div>", "Two"),
        ("<main><div class='article-share-wrap'><p>Three</p></div><div class='share-buttons'>no</div></main>", "Three"),
        ("<div class='banner'>no<article><p>Four</p></article></div>", "Four"),
        ("<div class='modal'><main><p>Five</p></main></div>", "Five"),
        ("<article><p>Six</p></article><section class='comments'><article><p>no</p></article></section>", "Six"),
        ("<div><p>Seven</p></div><div class='related'><article>no</article></div>", "Seven"),
        ("<header>no<nav>no</nav></header><article><header><h1>Eight</h1></header><p>and <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p></article>", "Eight and x+1"),
        ("<article class='post no-sidebar' id='main-content'><p>Nine</p></article>", "Nine"),
    ],
)
def test_wrappers_that_name_boilerplate_in_passing(spark, html, text):
    assert texts(spark, [(1, "http://a.b/x", f"<html><body>{html}</body></html>")])[1] == text


def test_what_a_host_repeats_goes(spark):
    rows = [(k, f"http://host.org/{k}", f"<body><div class=top>Welcome to us</div><div class=text><p>Page {k} says a thing of its own</p></div><div class=bottom>All rights</div></body>") for k in range(8)]
    rows += [(100, "http://other.org/", "<body><div class=top>Welcome to us</div></body>")]
    found = texts(spark, rows)
    assert all(found[k] == f"Page {k} says a thing of its own" for k in range(8))
    assert found[100] == "Welcome to us"  # one page decides nothing


def test_unnamed_boilerplate_inside_articles(spark):
    """The tree removes what a host repeats inside its articles under a name that says nothing; copies of one page count once."""
    rows = [(k, f"http://host.org/{k}", f"<body><article><p>Story {k} of the day</p><div class=x7><p>Get our mail</p></div><p>More of story {k}</p></article></body>") for k in range(60)]
    rows += [(100 + k, "http://copies.org/", "<body><article><p>The one story</p></article></body>") for k in range(60)]
    rows += [(200 + k, f"http://few.org/{k}", f"<body><article><p>Story {k}</p><div class=x7><p>Get our mail</p></div></article></body>") for k in range(5)]
    done = {r["page_id"]: r for r in pages.main_texts(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(done[k]["text"] == f"Story {k} of the day More of story {k}" and done[k]["n_removed"] == 1 for k in range(60))
    assert all(done[100 + k]["text"] == "The one story" for k in range(60))
    assert all(done[200 + k]["text"] == f"Story {k} Get our mail" for k in range(5))  # few pages decide nothing inside an article


def test_style_tree_by_brute_force(spark, sf_dir):
    """Importance of every branch, from the showings of each host's distinct pages counted in Python."""
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", pages.host_of(F.col("url")))
    shows, sure = defaultdict(Counter), defaultdict(bool)
    parents = {}
    for host, html in {(r["host"], r["html"]) for r in given.select("host", "html").collect()}:
        blocks, elements = pages.parse(html)
        for path, parent, text, place in {b for b in blocks if b[3] >= 0}:
            shows[host, path, False][text] += 1
            sure[host, path] |= place >= 2
            parents[host, path] = parent
        for path, kids in set(elements):
            shows[host, path, True][kids] += 1

    def importance(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n) if n > 1 else 1.0

    expected = {}
    for (host, path), parent in parents.items():
        counts, prior = shows[host, path, False], pages.INSIDE if sure[host, path] else pages.OUTSIDE
        look = importance(shows[host, parent, True]) if (host, parent, True) in shows else 1.0
        n = sum(counts.values())
        expected[host, path] = (n * ((1 - pages.GAMMA) * look + pages.GAMMA * importance(counts)) + prior) / (n + prior)
    found = {(r["host"], r["path"]): r["importance"] for r in pages.branches(write_shared(pages.style_tree(given), "t")).collect()}
    assert found == pytest.approx(expected)


def test_deep_nesting_is_linear():
    html = "".join(f"<div>{k % 7} " for k in range(100_000))
    tracemalloc.start()
    assert len(pages.parse(html)[0]) == 100_000
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


@pytest.mark.parametrize(("url", "host"), [("http://my_host.com/a", "my_host.com"), ("http://a.b/x y", "a.b"), ("HTTP://u:p@A.b:80/q?x={1}|2", "a.b"), ("http://münchen.de/", "münchen.de"), ("http://[bad", ""), ("//x/y", ""), (None, "")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(pages.host_of(F.col("u"))).first()[0] == host


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>open", "open"), ("<p>a<p>b", "a b"), ("<!-- x", ""), ("a < b", "a < b"), ("<div>" * 3000 + "deep", "deep")])
def test_odd_pages(spark, html, text):
    assert texts(spark, [(1, None, html)])[1] == text


def test_clashing_columns_and_nulls(spark):
    rows = [(None, None, None, "x", "y"), (1, "http://a.b/", "<p>t</p>", "x", "y")]
    found = pages.main_texts(spark.createDataFrame(rows, PAGE + ", text string, host string"))
    assert sorted(map(repr, (tuple(r) for r in found.select("page_id", "text", "n_chars").collect()))) == ["(1, 't', 1)", "(None, '', 0)"]


def test_no_pages_and_repeated_pages(spark):
    assert texts(spark, []) == {}
    assert pages.main_texts(spark.createDataFrame([(1, "http://[bad", "<p>x</p>")] * 3, PAGE)).count() == 3
