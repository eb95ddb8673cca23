import random
import re

from pyspark.sql import functions as F

from logfold.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    out = []
    for i, text in docs:
        w, hit, which = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for s in range(max(1, len(v) - size + 1) if v else 0):
                g = v[s : s + size]
                for at in range(len(w) - len(g) + 1):
                    if w[at : at + len(g)] == g:
                        hit.update(range(at, at + len(g)))
                        which |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(which), ",".join(sorted(which))))
    return out


def found(df, items, size):
    return [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in D.contamination(df, items, size).collect()]


def test_random(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "d1", "x-y"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(60)]
    items = [(i, text(rng.randint(0, 7))) for i in range(12)] + [(3, None), (11, "a b"), (11, "a b"), (None, "b c d1 a")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(found(a, b, 4)) == sorted(brute(docs, items, 4))
    rows, matches, _ = D.matches(a, b, size=4, slop=1)  # the phrases are among the proximity matches
    phrases = {(r.doc_id, r.win, r.start) for r in matches.where("kind = 'phrase'").collect()}
    assert phrases == {(r.doc_id, r.win, r.start) for r in D.matches(a, b, size=4)[1].collect()}


def test_odd_rows(spark, odd, odd_rows, empty):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (2, ""), (3, None), (4, "one")], "item_id long, text string")
    want = brute([r[:2] for r in odd_rows], [(1, odd_rows[0][1]), (4, "one")], 10)
    got = found(odd, items, 10)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert D.contamination(odd, items).count() == len(odd_rows)
    assert D.contamination(empty, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.contamination(odd, none).collect()} == {0}
    kept = D.clean(odd, items)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "4", "5", "6", "8", "9", "None", "None"])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (2, "one x two three four"), (3, "four three two one"), (4, "one far a b c two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    rows, matches, _ = D.matches(docs, items, size=4, slop=1)
    kinds = {(r.doc_id, r.kind) for r in matches.select("doc_id", "kind").collect()}
    assert (1, "phrase") in kinds and (2, "near") in kinds and not any(i in (3, 4) for i, _ in kinds)


def test_index_holds_rare_terms_only(spark):
    docs = spark.createDataFrame([(i, f"the of and rare{i} to in the of") for i in range(50)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the of and rare7 to in the of")], "item_id long, text string")
    terms = spark.createDataFrame([("rare7", 1), ("and", 2)], "term string, term_id long")
    assert sorted(r.n for r in D.index(docs, terms).groupBy("term_id").agg(F.count("*").alias("n")).collect()) == [1, 50, 50]
    assert [(r.doc_id, r.n_hit) for r in D.contamination(docs, items).where("n_hit > 0").collect()] == [(7, 8)]


def test_long_items_and_texts(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    long = [rng.choice(vocabulary) for _ in range(30_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[500:600])), (3, "x" * 200_000 + " " + " ".join(long[9:19])), (4, " ".join(long[9:18]))]
    items = [(1, " ".join(long[:3000])), (2, " ".join(long[-12:]))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in D.contamination(a, b).collect()}
    assert got == {1: (30_000, 3012, "1,2"), 2: (100, 100, "1"), 3: (11, 10, "1"), 4: (9, 0, "")}
