import math
import re
from collections import Counter

import pytest

from logfold.llm import quality as Q

from .conftest import prose


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_of_odd_rows(odd, odd_rows, empty):
    got = sorted(map(str, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.judge(odd).collect())))
    assert got == sorted(map(str, ((r[0], *brute_counts(r[1])) for r in odd_rows)))
    kept = sorted(str((r.doc_id, r.n_words)) for r in Q.judge(odd).where("kept").collect())
    stay = Q.keep(odd)
    assert stay.columns == odd.columns and sorted(str((r.doc_id, brute_counts(r.text)[0])) for r in stay.collect()) == kept
    assert Q.judge(empty).count() == 0 and Q.keep(empty).columns == empty.columns


def test_many_repeated_windows(spark):
    text = " ".join(f"w{i % 150}" for i in range(700)) + " tail of its own"
    r = Q.judge(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text) and r.base_failed and not r.kept


def test_noise_goes_and_prose_stays(spark):
    good = [(i, prose(i), "en") for i in range(99)]
    noise = [(100, "%%% ".join(prose(200).split()), "en"), (101, prose(201).upper().replace(" ", "!! "), "en"), (102, " | ".join(f"cell{i}x{i}" for i in range(120)), "en")]
    other = [(103, "%%% ".join(prose(203).split()), "xx"), (104, prose(204), None), (105, "%%% ".join(prose(205).split()), None)]
    good += [(200 + i, prose(300 + i), "en") for i in range(60)]  # one document is no reference
    docs = spark.createDataFrame(good + noise + other, "doc_id long, text string, lang string")
    assert {r.doc_id for r in Q.keep(docs).collect()} == {*range(99), *range(200, 260), 103, 104}


def test_without_any_reference_counts_decide(spark):
    docs = spark.createDataFrame([(1, prose(1), None), (2, "few words", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in Q.keep(docs).collect()] == [1]


def test_distance_by_definition(spark):
    from pyspark.sql import functions as F

    p, q = [3, 0, 5, 2], [0.25, 0.25, 0.5, 0.0]
    shares = [x / 10 for x in p]
    mean = [(a + b) / 2 for a, b in zip(shares, q, strict=True)]
    want = sum(a * math.log2(a / m) for a, m in zip(shares, mean, strict=True) if a) / 2 + sum(b * math.log2(b / m) for b, m in zip(q, mean, strict=True) if b) / 2
    got = spark.range(1).select(Q.distance(F.array(*map(F.lit, p)), q)).first()[0]
    assert got == pytest.approx(math.sqrt(want))
