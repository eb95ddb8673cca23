import random

from pyspark.sql import functions as F

from logfold.llm import linededup as L


def brute(rows, least):
    """Quadratic: a line goes if a run of worded lines around it, of ``least`` bytes or more, occurred before."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "", r[1] is None) for r in rows})
    docs = [[x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] for _, _, t, _ in order]
    gone = [set() for _ in docs]
    for b, later in enumerate(docs):
        for a in range(b + 1):
            first = docs[a]
            for i in range(len(later)):
                for j in range(len(first)):
                    if (a == b and j >= i) or later[i] != first[j]:
                        continue
                    if i and j and later[i - 1] == first[j - 1]:
                        continue  # starts further left
                    k = 0
                    while i + k < len(later) and j + k < len(first) and later[i + k] == first[j + k]:
                        k += 1
                    if sum(len(x.encode()) for x in later[i : i + k]) >= least:
                        gone[b].update(range(i, i + k))
    out = {}
    for (has, i, t, null), g in zip(order, gone, strict=True):
        kept, n = [], 0
        for x in t.split("\n"):
            worded = bool(x.strip(" \t\n\x0b\x0c\r"))
            if not (worded and n in g):
                kept.append(x)
            n += worded
        out[(i if has else None, None if null else t)] = (None if null else "\n".join(kept) if g else t, n, len(g))
    return [(r[0], *out[(r[0], r[1])]) for r in rows]


def check(df, rows, least):
    got = sorted(map(str, ((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in L.dedup_lines(df, least).collect())))
    assert got == sorted(map(str, brute(rows, least)))


def test_random_documents(spark):
    for seed in range(4):
        rng = random.Random(seed)
        lines = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 12))) for _ in range(7)] + ["x" * 30]
        rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for i in range(25)]
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows, (1, 10, 25, 60)[seed])


def test_odd_rows(spark, odd, odd_rows, empty):
    check(odd, [r[:2] for r in odd_rows], 200)
    out, counts = L.dedup_lines(odd), ("n_lines", "n_deleted")
    assert out.columns == [*(c for c in odd.columns if c not in counts), *counts] and out.count() == len(odd_rows)
    others = [c for c in odd.columns if c not in ("text", *counts)]
    assert same(out, others) == same(odd, others)
    stay = L.keep(odd)
    assert stay.columns == odd.columns
    assert same(stay, counts) == same(odd, counts)[: stay.count()]
    assert L.dedup_lines(empty).count() == 0 and L.keep(empty).columns == empty.columns


def same(df, names):
    return sorted(str([r[c] for c in names]) for r in df.collect())


def test_long_texts(spark):
    """Thousands of lines, lines of many thousand bytes, and runs between them."""
    lines = [f"line {i % 1500} of a long text" for i in range(3000)]
    rows = [(1, "\n".join(lines)), (2, "x" * 100_000 + "\n" + "y" * 300), (3, "y" * 300 + "\n" + "\n".join(lines[700:720])), (4, "x" * 100_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 200)


def test_fingerprints_decide(spark, monkeypatch):
    """A document has fewer fingerprints than lines, equal runs share one, and without shared ones nothing is deleted."""
    rng = random.Random(5)
    passage = [f"line {rng.random()} of a passage" for _ in range(12)]
    rows = [(i, "\n".join([*(f"own {i} {rng.random()}" for _ in range(40)), *passage, f"end {i}"])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    per = [(len(r.H), {(m.fp, m.at) for m in r.M if m}) for r in L.fingerprints(docs).collect()]
    assert all(0 < len(places) < lines / 2 for lines, places in per)
    assert set.intersection(*({fp for fp, _ in places} for _, places in per))
    assert {r.n_deleted for r in L.dedup_lines(docs).collect()} == {0, len(passage)}
    monkeypatch.setattr(L, "shared_places", lambda lines: lines.select("rid", F.array(F.lit(1)).alias("shared")).where("false"))
    assert {r.n_deleted for r in L.dedup_lines(docs).collect()} == {0}


def test_passage_inside_documents(spark):
    passage = "\n".join(f"shared sentence number {i} of a passage that repeats" for i in range(8))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}") for i in range(40)]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own start {i}\nown end {i}" for i in range(1, 40))
