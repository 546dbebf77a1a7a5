"""Mixing, top-k, packing, URL rules, chats, page text: against brute force and on edge rows."""

import itertools
import math
import random
import time
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import chat, html, mixing, packing, topk, urls
from gatehouse.llm import queries as q


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    got = q.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", ["op2_topk", "op7_urls", "op8_chat"])
def test_equals_sql(spark, sf, name):
    same_as_sql(spark, sf, name)


# -- mixing -------------------------------------------------------------------


def test_op1(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.op1_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, q.op1_mixing(spark, sf).collect()))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in q.table(spark, sf, "documents").select("doc_id", "source").collect()}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in rows)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    below = {s for s in sizes if target[s] < 2 * sizes[s] - 1e-6}
    assert len({round(target[s] / weights[s], 3) for s in below}) <= 1
    for s in sizes:
        assert target[s] <= 2 * sizes[s] + 1e-6
        assert abs(taken[s] - target[s]) <= max(5, 0.01 * target[s])


def test_fill_targets_and_flow():
    assert mixing.fill_targets([10, 10], [1, 1], 30, 2) == [15, 15]
    assert mixing.fill_targets([1, 100], [5, 1], 50, 2) == [2, 48]
    assert mixing.fill_targets([0, 10], [5, 1], 15, 2) == [0, 15]
    sent = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 2}, {"a": 15, "b": 9}, 2)
    assert sum(x.get("a", 0) for x in sent.values()) == 15 and sum(x.get("b", 0) for x in sent.values()) == 9
    # 22 words exist and 24 are wanted: no pattern is used twice but for those two words.
    assert sum(max(0, sum(x.values()) - s) for x, s in zip(sent.values(), (10, 10, 2), strict=True)) == 2


def test_overlapping_sources_and_edge_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([["a"], ["b"], ["a", "b"], ["b", "a", "a"], [], None, [None]]), rng.choice([0, None, 1, 5, 50])) for i in range(400)] + [(None, ["a"], 3), (1, ["a"], 5), (1, ["a"], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>, size long").withColumns({"taken": F.lit("x"), **{c: F.lit("mine") for c in ("_x", "_size", "_pattern", "_id", "row", "_more", "_bucket")}})
    out = mixing.mix_sources(docs, "s", {"a": 2000, "b": 1500, None: 10})
    got = out.collect()
    assert all(r["_size"] == r["_pattern"] == r["row"] == r["_bucket"] == "mine" for r in got)
    assert len(got) == len(rows)
    assert all(r["taken"] == r["copies"] * (r["size"] or 0) and 0 <= r["copies"] <= 2 for r in got)
    assert abs(sum(r["taken"] for r in got) - 3510) < 60
    assert mixing.mix_sources(docs.where("false"), "s", {"a": 1}).collect() == []
    one = spark.createDataFrame([(1, None, 7), (2, None, 5), (3, "x", 0)], "doc_id long, source string, size long")
    assert sum(r["taken"] for r in mixing.mix_to_weights(one).collect()) in (17, 19)
    assert mixing.mix_to_weights(one.where("false")).collect() == []


def test_flow_is_cheapest_and_fast():
    rng = random.Random(1)
    for _ in range(60):
        keys = rng.sample([("a",), ("b",), ("a", "b")], rng.randint(1, 3))
        patterns, quotas = {p: rng.randint(1, 3) for p in keys}, {"a": rng.randint(0, 6), "b": rng.randint(0, 6)}
        choices = [[(x if "a" in p else 0, y if "b" in p else 0) for x in range(7 if "a" in p else 1) for y in range(7 if "b" in p else 1) if x + y <= 2 * n] for p, n in patterns.items()]
        cost = lambda used: sum(max(0, sum(u) - n) for u, n in zip(used, patterns.values(), strict=True))
        fits = [c for c in itertools.product(*choices) if sum(x for x, _ in c) <= quotas["a"] and sum(y for _, y in c) <= quotas["b"]]
        best = min((-sum(map(sum, c)), cost(c)) for c in fits)
        sent = mixing.route(patterns, quotas, 2)
        got = [(x.get("a", 0), x.get("b", 0)) for x in sent.values()]
        assert (-sum(map(sum, got)), cost(got)) == best
    start = time.perf_counter()
    sent = mixing.route({(i,): 100 + i % 7 for i in range(20_000)}, {i: 150 for i in range(20_000)}, 2)
    assert all(x == {i: 150} for i, x in zip(range(20_000), sent.values(), strict=True))
    assert time.perf_counter() - start < 20


def test_mix_takes_the_nearest_sum_and_counts_equal_rows(spark):
    kind = "doc_id long, s array<string>, size long, text string, m map<string, int>"
    lone = mixing.mix_sources(spark.createDataFrame([(1, ["a"], 1000, "x", {"k": 1})], kind), "s", {"a": 1900}).collect()
    assert [(r["copies"], r["taken"]) for r in lone] == [(2, 2000)]
    # Equal rows, and rows of one id and size with other texts: exactly as many words as wanted, and the same in a rerun.
    rows = [(None, ["a"], 10, "same", None)] * 300 + [(7, ["a"], 10, f"t{i}", None) for i in range(300)]
    docs = spark.createDataFrame(rows, kind)
    for quota in (10, 2990, 3010, 7770, 12000):
        first, again = (sorted((r["doc_id"] or 0, r["text"], r["copies"]) for r in mixing.mix_sources(docs.repartition(n), "s", {"a": quota}).collect()) for n in (3, 5))
        assert first == again and len(first) == 600
        assert sum(10 * c for _, _, c in first) == quota


# -- top-k --------------------------------------------------------------------


def best_of(rows, asked, k):
    """Brute force with whole numbers of any size; rows: (id, vector)."""
    top = (1 << 63) - 1
    x = [(i, [math.floor(Fraction(v) * 256) for v in w]) for i, w in rows if i is not None and w and all(v is not None and math.isfinite(v) and math.isfinite(v * 256) for v in w)]
    out = []
    for i, v in x:
        if i in asked:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in x if j != i and len(w) == len(v))[:k]
            out += [(i, n, j, max(-top - 1, min(top, -s))) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "BATCH", 5)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[100:150] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[8].tolist()), (900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, x[0].tolist()), (904, [])]
    # The same id several times, also as a query; other lengths; numbers beyond an int and beyond a long.
    rows += [(50, x[1].tolist()), (50, x[0].tolist()), (50, x[0].tolist()), (905, [1.0, 2.0]), (950, [1.0, 3.0]), (951, [1e8] * 3), (952, [-1e8] * 3), (953, [3e18, 1.0, -1e-9]), (954, [1e307] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "score": F.lit(2), "number": F.lit(3)})
    asked = {i for i, _ in rows if i is not None and (i % 50 == 0 or i > 904)}
    vectors = topk.usable(frame)
    got = topk.top_k(vectors, vectors.where(F.col("vec_id").isin(*asked)), k=5)
    assert sorted(map(tuple, got.collect())) == best_of(rows, asked, 5)
    few = vectors.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(few.where("false"), few.where("false")).collect() == []


def test_topk_stops_on_proof():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    index = topk.ImpactIndex(np.arange(4000), x)
    for q in range(20):
        scores = x @ x[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        assert index.best(x[q], q, 5) == want
    assert index.stopped == 20


# -- packing ------------------------------------------------------------------


def test_op4_equals_tokenizers(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r["doc_id"]: r["text"] or "" for r in q.table(spark, sf, "documents").select("doc_id", "text").collect()}
    pieces, used = defaultdict(list), defaultdict(list)
    for r in q.op4_packing(spark, sf).collect():
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for d, text in docs.items():
        ids = np.array(encode.encode(text, add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(pieces[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or n == 0
            at += r["length"]
        assert at == len(ids)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) <= 1.01 * total / 1024 + 2


def test_local_search_keeps_items_and_helps():
    rng = random.Random(0)
    for low, high, n in ((1, 1023, 800), (200, 700, 1500), (600, 600, 300), (1, 5, 4000), (400, 520, 900)):
        sizes = [rng.randint(low, high) for _ in range(n)]
        first = packing.best_fit(sizes, 1024)
        count = len(first)
        bins = packing.improve(first, sizes, 1024)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
        assert len(bins) <= count


def test_packing_edge_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "a  b"), (3, "wörd " * 5000), (4, "x" * 9000), ((1 << 60) + 1, "big id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit(1), "piece": F.lit("z")})
    got = packing.pack_documents(docs, q.load_tokenizer, room=64).collect()
    assert sum(r["piece"] == 0 for r in got) == len(rows)
    assert all(1 <= r["length"] <= 64 for r in got)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert packing.pack_documents(docs.where("false"), q.load_tokenizer).collect() == []


def test_packing_holds_little_of_a_large_input(spark):
    """A worker holds a few MB of texts at once, and a packing task no pieces that fill a sequence, however many there are."""

    class Tells:
        """Its first token is the number of texts that came with this one; then come zeros, as many as the text says."""

        def ids(self, text):
            import sys

            return np.array([len(sys._getframe(1).f_locals["batch"]), *[0] * int(text[:5])], "<u4").tobytes()

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("00639"), F.repeat(F.lit("x"), 10_000)).alias("text"))
    packed = packing.pack_documents(docs, Tells, room=64, keep_ids=True)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    got = packed.orderBy("doc_id", "piece").collect()
    held = [int.from_bytes(r["ids"][:4], "little") for r in got if r["piece"] == 0]
    assert len(held) == 3000 and max(held) * 10_000 < 6 << 20
    # 641 tokens are one piece of 1 and ten of 64, each of which is a sequence.
    assert [(r["piece"], r["start"], r["length"]) for r in got] == [(k, k and 64 * k - 63, 64 if k else 1) for _ in range(3000) for k in range(11)]
    fills = defaultdict(list)
    for r in got:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(map(len, fills.values())) == [1] * 30_000 + [56] + [64] * 46
    assert all(sorted(f) == [(0, 64)] or sorted(f) == [(i, 1) for i in range(len(f))] for f in fills.values())


# -- urls, chats, pages -------------------------------------------------------


def test_url_edge_rows(spark):
    cases = {
        "http://a.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/10": ("example.org", "/en/10", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/de": ("x.com", "/de", None, "allow"),
        "http://x.com?u=/de/": ("x.com", "", None, "allow"),
        "http://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "no-scheme.org/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    frame = spark.createDataFrame([(u,) for u in cases] * 2, "url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "found": F.lit(3), "row": F.lit(4), "_found": F.lit(5)})
    assert {"found", "row", "_found"} <= set(urls.judge_urls(frame, q.URL_RULES).columns)
    for r in urls.judge_urls(frame, q.URL_RULES).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["url"]]
    trie = urls.UrlTrie([("block", "b.c", "/x"), ("allow", "b.c", "/x"), ("allow", "c", "/x/long/path"), ("block", "c", "")])
    assert trie.lookup("a.b.c", "/xyz") == ("block", "b.c/x")
    assert trie.lookup("c", "") == ("block", "c")
    assert trie.lookup("d", "/x") is None
    assert urls.judge_urls(frame.where("false"), []).collect() == []


def test_many_rules_that_end_in_one_segment():
    rng = random.Random(3)
    rules = [(rng.choice(["allow", "block"]), "a.b", "/x/" + "".join(rng.choices("pqr", k=rng.randint(1, 6)))) for _ in range(300)]
    trie = urls.UrlTrie(rules)
    for _ in range(300):
        path = "/x/" + "".join(rng.choices("pqr", k=rng.randint(0, 9))) + rng.choice(["", "/y"])
        fit = [(len(p), v == "block", v, f"a.b{p}") for v, _, p in rules if path.startswith(p)]
        assert trie.lookup("www.a.b", path) == (max(fit)[2:] if fit else None)
    start = time.perf_counter()
    large = urls.UrlTrie([("block", "a.b", f"/x/{i}") for i in range(100_000)])
    assert all(large.lookup("a.b", f"/x/{i}z") == ("block", f"a.b/x/{i}") for i in range(20_000))
    assert time.perf_counter() - start < 20


def test_chats(spark):
    def turns(conv, *texts):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]

    rows = [*turns(1, "a"), *turns(2, "a", "b"), *turns(3, "a", "b", "c"), *turns(4, "a", "b", "c"), *turns(5, "a", "x"), *turns(6, None), *turns(7, None, "q"), *turns(8, ""), *turns(8, ""), (9, None, None, None), (None, 0, "user", "n"), (None, 0, "user", "n"), (None, 0, "user", "a"), (None, 3, "user", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "n_turns": F.lit("x")})
    got = {r["conv_id"]: r for r in chat.render_chats(frame).collect()}
    assert set(got) == {3, 5, 7, 8, 9, None} and got[None]["n_copies"] == 1
    assert got[3]["n_copies"] == 2 and got[3]["n_turns"] == 3
    assert got[5]["text"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert chat.render_chats(frame.where("false")).collect() == []


def test_equal_turns_are_ordered_by_text(spark):
    """Turns of the same number and role, in pairs of conversations of which one starts with the other, if ordered by text."""
    rng, rows = random.Random(9), []
    for i in range(40):
        texts = sorted(f"{rng.random():.12f}" for _ in range(3))
        rows += [(2 * i, 0, "user", t) for t in texts[:2]] + [(2 * i + 1, 0, "user", t) for t in texts]
    got = chat.render_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["conv_id"] for r in got) == list(range(1, 80, 2))


def expected(page):
    """The article's text by plain cutting, for the well-formed part of the generated pages."""
    import re
    from html import unescape

    body = page[page.index("<article>") + 9 :].split("</article>")[0]
    parts = re.split(r"</?(?:h1|p)>", body)
    out = (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts)
    return "\n\n".join(x for x in out if x)


def test_op10_equals_plain_cutting(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in q.table(spark, sf, "pages").collect()}
    rows = q.op10_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == expected(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


def test_templates_alone_give_the_text(spark):
    """Without what tags and marks say, the counted templates clean every page; without templates none is clean."""
    pages = q.table(spark, "/root/testdata/sf0.1", "pages")
    want = {r["page_id"]: expected(r["html"]) for r in pages.collect()}
    right = lambda **how: sum(r["text"] == want[r["page_id"]] for r in html.extract_text(pages, landmarks=False, **how).collect())
    assert right() >= 0.99 * len(want)
    assert right(least_pages=len(want) + 1) == 0


def test_page_edge_rows(spark):
    cases = [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>one<p>two<br>lines<div class='ad'>buy</div><nav>menu</nav>", "one\n\ntwo lines"),
        ("<article><h1>T</h1><p>a <b>b</b>&nbsp;c</p><section class=comments><p>first!</p></section><form><p>f</p></form></article><footer>x</footer>", "T\n\na b c"),
        ("<main>x <script>var a='<p>no</p>';</script>y</main><aside>z</aside>", "x y"),
        ("<div class='has-sidebar'><article>kept</article></div>", "kept"),
        ("a < b and <c", "a < b and"),
        ("<p title='a>b'>t</p><!-- c --><p>&lt;p&gt; &#233;</p>", "t\n\n<p> é"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<div>" * 5000 + "text<nav>menu</nav><div class=comments><p>first!</p></div>" + "</div></b>" * 5000 + "after", "text\n\nafter"),
        ("<article>" + "<p>long words</p>" * 20000 + "</article>", "\n\n".join(["long words"] * 20000)),
    ]
    frame = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit(2), "template": F.lit(3)})
    got = {r["page_id"]: r["text"] for r in html.extract_text(frame).collect()}
    assert {i: got[i] for i in got} == {i: t for i, (_, t) in enumerate(cases)}
    assert html.extract_text(frame.where("false")).collect() == []


def test_marks_take_no_main_text(spark):
    """Pages without an article, and marks that mislead."""
    cases = [
        ('<div class="layout no-sidebar"><p>Main text.</p></div>', "Main text."),
        ('<div class="blog-post social-sciences"><p>Essay</p></div>', "Essay"),
        ('<article><h2 id="related-work">Related work</h2><p class="market-share">Shares</p><p class="share">Mine</p></article>', "Related work\n\nShares\n\nMine"),
        ('<article><p>Law</p><section id="comments-on-the-law"><p>On it</p></section></article>', "Law\n\nOn it"),
        ("<article><header><h1>Title</h1></header><p>Text</p><footer>by me</footer></article><header>Site</header>", "Title\n\nText"),
        ('<div class="sidebar"><p>All there is on this page</p></div><p>more</p>', "All there is on this page\n\nmore"),
        ('<form id="all"><p>A page in a form, as some servers make them</p><div class="menu">m</div></form>', "A page in a form, as some servers make them"),
        ("<form><article><p>In a form</p></article></form>", "In a form"),
        ('<article><p>Short</p></article><div class="comments"><p>Long words of readers, far longer than the page</p></div>', "Short"),
        ('<div role="navigation">Home</div><p>The text of a page without an article</p><div class="left sidebar">side</div>', "The text of a page without an article"),
        ('<div class="header-image"><p>Below a picture</p></div>', "Below a picture"),
    ]
    frame = spark.createDataFrame([(i, f"http://m{i}.org/", h) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(frame).collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}


def test_templates_decide_at_every_scale(spark):
    """Pages from which the templates alone take something: all at sf0.1, most hosts' at sf0.01; on hosts of few pages too."""
    for sf, least in (("/root/testdata/sf0.1", 1.0), ("/root/testdata/sf0.01", 0.5)):
        pages = q.table(spark, sf, "pages")
        cleaned = {r["page_id"]: r["text"] for r in html.extract_text(pages, landmarks=False).collect()}
        whole = {r["page_id"]: "\n\n".join(html.blocks(html.parse(r["html"]), (), False)) for r in pages.collect()}
        assert sum(cleaned[i] != whole[i] for i in whole) >= least * len(whole)


def test_site_template_goes_and_prose_stays(spark):
    bar = "<div><span>Welcome to the site</span><ul><li>one</li><li>two</li></ul></div>"
    own_bar = "<div><span>Wylcomy to thy sity</span><ul><li>ony</li><li>other</li></ul></div>"
    rows = [(i, "http://a.org/x" if i % 2 else None, f"<body>{bar}<div><p>Story {i} of this page</p><p>Same words</p></div></body>") for i in range(40)]
    rows += [(100 + i, "http://b.org/x", f"<article><div><p>Read also</p></div><p>Body {i}</p><p>Same line</p></article>") for i in range(30)]
    rows += [(200 + i, "http://c.org/x", f"{own_bar}<div><p>Copied page</p></div>") for i in range(30)]
    # Few pages of many hosts with one bar, which names each host; and a text of one host's pages that is another's template.
    rows += [(300 + i, f"http://h{i}.net/", f"<body><div>On <b>h{i}.net</b></div><div><p>Story {i} alone</p></div></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of this page" and got[4] == "Story 4 of this page"
    assert got[103] == "Body 3\n\nSame line"
    assert got[203] == "Wylcomy to thy sity\n\nony\n\nother\n\nCopied page"
    assert got[305] == "Story 5 alone"


def test_templates_of_hosts_with_copies_and_of_sections(spark):
    bar = "<div><span>Welcome to the site</span><ul><li>one</li><li>two</li></ul></div>"
    page = lambda i, top: f"<body>{top}<div><p>Story {i} of this page</p></div></body>"
    # 10 different pages, 30 copies of each; and 24 sections with a bar of their own on 10 pages each, at both depths.
    rows = [(i, "http://copies.org/x", page(i % 10, bar)) for i in range(300)]
    rows += [(1000 + i, f"http://big.org/s{i % 24}/{i}", page(i, f"<div>Part {i % 24}</div>")) for i in range(240)]
    rows += [(2000 + i, f"http://deep.org/en/s{i % 24}/{i}?a=/b/", page(i, f"<div>Part {i % 24}</div>")) for i in range(240)]
    got = {r["page_id"]: r["text"] for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Story {i % 10 if i < 1000 else i % 1000} of this page" for i in got)


def test_added_tokens_keep_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = q.load_tokenizer()
    end = "<|endoftext|>"
    for text in (f"a {end} b", end, f"{end}{end}", f" {end}\n  x {end}y  ", f"<|end{end}oftext|>", "<|endoftext|", f"tab\t{end}\t b", ""):
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == encode.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(ours.ids(f"a {end} b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_long_runs_keep_their_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours = q.load_tokenizer()
    for text in (" " * 1_000_000, "a" + " " * 200_000 + "b  c", "a\n" + "\t" * 5_000 + " b" + "\n" * 3_000, "x" * 50_000, "\u3000" * 4_000 + "y", " \x1c" * 3_000, "字" * 30_000 + " z"):
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == encode.encode(text, add_special_tokens=False).ids, text[:20]
    # A memory that is always full gives the same ids.
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    again = q.load_tokenizer()
    text = "some words and some more words " * 50
    assert again.ids(text) == ours.ids(text) and len(again.later) < 5
