"""Language ID, toxicity: held-out accuracy, edge rows, the parse against brute force."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from gatehouse.llm import langid, toxicity
from gatehouse.llm import queries as q


def auc(labels, scores):
    order = np.argsort(scores)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(labels, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_cross_parsing_equals_brute_force():
    rng = np.random.default_rng(2)
    many = "".join(map(chr, rng.choice(np.arange(0x4E00, 0x4E00 + 300), 900)))
    samples = {"a": "abracadabra simsalabim hokus pokus", "b": "lorem ipsum dolor sit amet, consectetur", "c": many + " lorem"}
    parser = langid.CrossParser(samples)
    assert parser.automata[0].keys is None and parser.automata[2].keys is not None
    texts = ["abra hokus dolor zz", "Lorem  42 ipsum", "x", "xyzabra" * 200, many[100:180] + "abra" + many[::-1]]
    for text, rates in zip(texts, parser.parse([langid.fold(t) for t in texts]), strict=True):
        symbols = langid.fold(text)
        for k, lang in enumerate(parser.languages):
            known = "".join(map(chr, langid.fold(samples[lang])))
            n = 0
            for at in range(0, len(symbols), langid.WINDOW):
                piece = "".join(map(chr, symbols[at : at + langid.WINDOW]))
                while piece:
                    n += 1
                    end = 1
                    while end < len(piece) and piece[: end + 1] in known:
                        end += 1
                    piece = piece[end:]
            assert np.isclose(rates[k], n * parser.weights[k] / len(symbols))


def test_languages_of_many_scripts():
    """Two languages a script, told apart by their words; each sample's characters all count."""
    rng = np.random.default_rng(5)
    scripts = {"latin": range(97, 123), "cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "han": range(0x4E00, 0x5200), "kana": range(0x3041, 0x3097), "hangul": range(0xAC00, 0xAF00)}
    words = {f"{k}{i}": ["".join(map(chr, rng.choice(list(c), rng.integers(1, 4 if k in ("han", "hangul") else 8)))) for _ in range(400)] for k, c in scripts.items() for i in range(2)}
    say = lambda k, n: " ".join(rng.choice(words[k], n))
    parser = langid.CrossParser({k: say(k, 3000) for k in words})
    wanted = [k for k in words for _ in range(10)]
    assert parser.predict([say(k, 30) for k in wanted])[0] == wanted


def test_op6_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = q.op6_langid(spark, sf).join(q.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edge_rows(spark):
    rows = [(1, "the and of that with this", "en"), (2, "und der die das nicht", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "de"), (6, "日本語", None), (None, "the the", None), (1, "the and of that with this", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "found": F.lit(1), "_found": F.lit(2), "row": F.lit(3), "u": F.lit(4)})
    parser = langid.learn_languages(docs)
    got = langid.identify_languages(docs, parser).orderBy("doc_id").collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows)
    assert by[1][0] == "en" and by[2][0] == "de" and by[None][0] == "en"
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    assert by[6][0] in ("de", "en")
    none = langid.learn_languages(docs.where("false"))
    assert {r["lang_pred"] for r in langid.identify_languages(docs, none).collect()} == {"und"}
    assert langid.identify_languages(docs.where("false"), parser).collect() == []


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.1"
    out = q.op5_toxicity(spark, sf).join(q.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    labels = [r["toxic"] for r in out]
    assert sum(labels) >= 50
    assert auc(labels, [r["score"] for r in out]) > 0.9
    assert np.mean([r["predicted"] for r in out if not r["toxic"]]) < 0.03
    assert np.mean([r["toxic"] == r["predicted"] for r in out]) > 0.9


def test_scores_equal_brute_force():
    """A text's score by the definition: the mean over its distinct words of the means of their subwords' numbers, through the logistic function."""
    rng = np.random.default_rng(1)
    model = toxicity.Softmax()
    model.numbers, model.offset = rng.normal(size=toxicity.BUCKETS) * 9, 0.3
    texts = ["One two, TWO three!", "", None, "...", "thrée " * 9, "a b c d"]
    for text in texts:
        total, seen = 0.0, []
        for word in (text or "").lower().split():
            word = word.strip("!,.")
            if word and word not in seen:
                seen.append(word)
                marked = "<" + word + ">"
                grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked)) if i + n <= len(marked)}
                total += sum(model.numbers[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams) / len(grams)
        want = 1 / (1 + np.exp(-(total / max(1, len(seen)) + 0.3)))
        assert np.isclose(model.score(text), want)
    known = toxicity._Words([t or "" for t in texts])
    assert np.allclose(1 / (1 + np.exp(-(known.scores(model.numbers, np.arange(6)) + 0.3))), [model.score(t) for t in texts])


def test_toxicity_shares_subwords_and_edge_rows(spark):
    rng = np.random.default_rng(0)
    calm = [f"word{i}" for i in range(200)]
    rude = ["horrible", "dreadful", "nastiest"]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(calm, 40))
        if i % 3 == 0:
            words[5:7] = rng.choice(rude, 2)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    model = toxicity.Softmax().fit(texts, labels)
    plain = " ".join(calm[:40])
    assert model.score(plain + " horrible dreadful") > 0.5 > model.score(plain)
    assert model.score(plain + " h0rrible dreadfull nastyest") > model.score(plain) + 0.1
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (3, "..."), (4, "horrible " * 3000)], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] < 4} == {0}
    assert {r["predicted"] for r in got if r["doc_id"] == 4} == {1}
    nothing = toxicity.learn_toxicity(docs, docs.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, nothing).collect()} == {0}
    assert toxicity.score_toxicity(docs.where("false"), model).collect() == []
