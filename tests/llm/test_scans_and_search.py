"""Secret ledger, fill-in-middle and ranked search: brute force, edge rows, what is scanned again."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import fim, lexical, secrets
from gatehouse.llm import queries as registered
from gatehouse.plans.shape import executed_plan

DOCS = "doc_id long, text string, source string, row string, key string, blob string"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "s", "r", "k", "b") for i, t in rows], DOCS).repartition(3)


# Secrets

ODD = [
    (1, "Token = 'abcdefgh1' and AKIAABCDEFGHIJKL, " + "0123456789abcdef" * 3 + " end"),
    (2, None), (None, "password:short password=long-enough="), (3, ""), (4, "x" * 300_000 + " api_key: 'é' apikey=\"12345678\""),
    (4, "x" * 300_000 + " api_key: 'é' apikey=\"12345678\""), (5, "token=secret=abcdefghij \U0001f600 toKen \t: abcdefghi"), (6, "ſecret=abcdefghij AKIA123 " + "f" * 31),
]


def brute_spans(text):
    kinds = [("assign", re.compile(secrets.ASSIGNED), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, least) in enumerate(kinds) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return ",".join(x for *_, x in sorted(found))


def test_spans_equal_brute_force(spark):
    found = secrets.scan_secrets(frame(spark, ODD)).select("row.doc_id", "row.blob", secrets.span_text(F.col("spans")).alias("s"))
    assert sorted(map(str, found.select("doc_id", "s").collect())) == sorted(str(r) for r in spark.createDataFrame([(i, brute_spans(t)) for i, t in ODD], found.select("doc_id", "s").schema).collect())
    assert {r["blob"] for r in found.collect()} == {"b"}
    assert brute_spans(ODD[0][1]).count(":") == 6
    assert secrets.scan_secrets(frame(spark, [])).count() == 0
    plan = executed_plan(found)
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    rules = secrets.RULES[:2]
    secrets.scan_secrets(frame(spark, ODD), rules=rules, ledger=ledger)
    contents = len({t or "" for _, t in ODD})
    assert ledger.read().count() == contents * 2
    # A second history: one new content, one new path of an old content, one new version of a rule, one new rule.
    more = [*ODD, (9, "AKIAZZZZZZZZZZZZZZ"), (10, ODD[0][1])]
    secrets.scan_secrets(frame(spark, more), rules=rules, ledger=ledger)
    assert ledger.read().count() == (contents + 1) * 2
    newer = (secrets.Rule("assign", secrets.ASSIGNED, 2, 4, version=2), rules[1], secrets.RULES[2])
    again = secrets.scan_secrets(frame(spark, more), rules=newer, ledger=secrets.Ledger(spark, ledger.path))
    assert ledger.read().groupBy("blob", "kind", "version").count().where("count > 1").count() == 0
    assert ledger.read().count() == (contents + 1) * 4
    got = {r["doc_id"]: r["s"] for r in again.select("row.doc_id", secrets.span_text(F.col("spans")).alias("s")).collect()}
    assert got[1] == got[10] == brute_spans(ODD[0][1]) and got[9] == "access:0:18"
    assert got[None] == "assign:0:14,assign:15:36"  # the new version takes shorter ones
    # What a dead run left: some pairs are there, the others are scanned.
    half = secrets.Ledger(spark, f"file://{tmp_path}/half")
    ledger.read().where("kind = 'access'").limit(3).write.mode("append").parquet(half.path)
    secrets.scan_secrets(frame(spark, ODD), rules=rules, ledger=half)
    assert half.read().count() == contents * 2 + half.read().join(spark.createDataFrame([(hashlib.sha256(b"AKIAZZZZZZZZZZZZZZ").hexdigest(),)], "blob string"), "blob", "left_semi").where("kind = 'access'").count()


# Fill-in-middle


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(seed, n, longest):
    rng = random.Random(seed)
    letters = ["a", "é", " ", "\n", "<", "P", ">", "S", "M", "  ", "\U0001f600", "bc", "\x0b", "\x1c", " "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("giant, chunk", [(1 << 16, 1 << 15), (20, 7), (0, 1)])
def test_fim_equals_brute_force(spark, giant, chunk):
    rows = [*enumerate(texts(3, 60, 90)), (7, None), (None, "one two three "), (None, None), (8, "   "), (9, "w " * 200), (9, "w " * 200), (10, "<" * 30 + "P>" + " x" * 20)]
    got = fim.fim_documents(frame(spark, rows), giant=giant, chunk=chunk)
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == r["text"] for r in back)
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back))) == sorted(str(brute_fim(*r)) for r in rows)


def test_fim_of_a_giant_and_of_nothing(spark):
    text = ("wort und " * 9 + "\n\n ") * 30_000
    got = fim.fim_documents(frame(spark, [(i, text) for i in (1, 2, 3, 4)])).collect()
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == [brute_fim(i, text) for i in (1, 2, 3, 4)]
    assert fim.fim_documents(frame(spark, [])).count() == 0


def test_scans_compose_in_any_order():
    for text in texts(5, 200, 60):
        data = np.frombuffer(text.encode(), np.uint8)
        to, ends = fim.Scan(data).whole()
        for at in (0, len(data) // 3, len(data)):
            (f, c), (g, d) = fim.Scan(data[:at]).whole(), fim.Scan(data[at:]).whole()
            assert (g[f] == to).all() and (c + d[f] == ends).all()


# Ranked search


def brute_search(docs, items, k):
    lower = lambda t: TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := lower(t))]
    total, df = sum(n for *_, n in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 50 + 50 * n * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(lower(text)) if df[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings, batch", [(1_000_000, 200_000), (40, 5)])
def test_search_equals_brute_force(spark, postings, batch):
    rng = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "été", "42", "x-ray", "delta", "中文", "İ", "word", "a_b", "the"]
    docs = [(rng.choice([None, *range(30)]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(150)] + [(500, None), (501, ""), (502, " .,; "), (503, "alpha " * 9_000), (504, "alpha beta"), (504, "alpha beta")]
    items = [(1, "alpha BETA"), (2, "the the the x"), (3, None), (4, "nothing here"), (5, "中文 été İ"), (None, "gamma 42"), (6, "alpha")]
    asked = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.ranked_search(frame(spark, docs), asked, 7, shard_postings=postings, batch_terms=batch).collect()
    assert sorted(map(tuple, got), key=str) == brute_search(docs, items, 7)


def test_search_of_nothing_and_of_repeated_items(spark):
    items = spark.createDataFrame([(1, "alpha"), (1, "alpha")], "item_id long, text string")
    assert lexical.ranked_search(frame(spark, []), items).count() == 0
    docs = frame(spark, [(1, "alpha"), (2, "beta"), (3, "beta")])
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.ranked_search(docs, items).collect()] == [(1, 1, 1)] * 2


def test_bounds_skip_most_of_a_shard():
    rng = np.random.default_rng(4)
    docs, n = 4096, 60_000
    pairs = np.unique(np.stack([rng.integers(0, docs, n), (rng.random(n) ** 3 * 300).astype(int)]), axis=1)
    shard = lexical.Shard(pairs[0], pairs[1], rng.integers(1, 1 << 20, pairs.shape[1]), docs, 300)
    looked = []
    bounds = shard.bounds
    shard.bounds = lambda level, *a: (looked.append(len(level)), bounds(level, *a))[1]
    best = shard.best(np.array([250, 270, 299]), np.array([900, 5000, 9000]), 10)
    assert len(best) == 10 and sum(looked) < docs / 3


def test_registered(spark, sf):
    for name in ("op11_secrets", "op12_fim", "op13_lexical"):
        assert registered.queries()[name](spark, sf).count() > 0
