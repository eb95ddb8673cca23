"""Quality rules: distribution divergence from language references. DataFrame operations only.

A document has two histograms: its characters by class, and its words by common word (of any language below), as a
lone symbol, or neither. The references of a language are the histograms of all documents that state it, summed over the
whole corpus; every language that holds ``MIN_SHARE`` of the corpus' characters has one for characters, those with a word
list one for words. A document's distance is the least Jensen-Shannon distance (the root of the divergence in bits) to
any reference, for either histogram. Documents mixed from known languages thus stay near one of them; symbol noise,
shouting, tables and word lists do not.

Guards on length: under ``MIN_WORDS`` words the rules on counts decide alone, and the limit for common words
widens by ``WORD_SLACK / n_words`` in the divergence, since few words give rough histograms.

Defined results: a null text has no words, an empty one neither; both fail by their count. A document whose language
is null is judged by the counts and its characters, one of a language without a word list below too; the counts decide
alone where a stated language is too rare in the corpus for a reference, as another script would look like noise. Rows that repeat count each. Other columns of the input are ignored. An empty table returns no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, row_key, without

#: Frequent function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "en": "the of and to in a is that it for was on are as with be at by this from or an not",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ne",
}
VOCABULARY = sorted({w for words in COMMON.values() for w in words.split()})
#: Words of a symbol only, which are a bin of their own.
SYMBOLS = ["|", "||", "-", "--", "*", "**", "#", "##", "=", "/", "+", "&", "%", "$", "~", "^", "_", "<", ">", "@", "•", "·", "—", "–"]
#: Character classes, each as a Java regular expression class; white space is a class, and all other characters are.
CLASSES = (r"\p{Lu}", r"0-9", r".,;:?'\"()\-", r"#*$%&|<>!@^~=+_{}\[\]\\/`")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Limits of the divergence, the square of the distance.
MAX_CHAR_DIVERGENCE = 0.07
MAX_WORD_DIVERGENCE = 0.16
WORD_SLACK = 2.0
#: Languages with less of the corpus' characters give no reference, so there are at most a hundred.
MIN_SHARE = 0.01

#: Words in 3-word windows that occur twice or more. Windows are compared by 64-bit hash. Few repeated hashes are
#: looked up; many are found by sorting (hash, position).
_REPEATS = """
if(size(w) < 4, 0, transform(array(transform(array(transform(w, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])))[0]), g ->
  if(size(array_distinct(g)) = size(g), 0, transform(array(sort_array(g)), s -> transform(array(array_distinct(filter(transform(s, (x, i) -> if(i > 0 and s[i - 1] = x, x, null)), x -> x is not null))), d ->
    size(array_distinct(flatten(transform(
      if(size(d) <= 64, filter(sequence(0, size(g) - 1), i -> array_contains(d, g[i])),
        transform(array(sort_array(transform(g, (x, i) -> named_struct('x', x, 'i', i)))), p ->
          transform(filter(p, (e, i) -> (i > 0 and p[i - 1].x = e.x) or (i + 1 < size(p) and p[i + 1].x = e.x)), e -> e.i))[0]),
      i -> array(i, i + 1, i + 2))))))[0])[0]))[0])
"""


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, row (a hash of id, text and lang), lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the histograms chars and common."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        row_key(F.col(id_col), F.col(text_col), F.col(lang_col)).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        text.alias("text"),
        F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"{SPACE}+", "") != "").alias("l"),
    )
    words_only = F.length(F.array_join("w", ""))
    # All but the class is cut out: the classes are rare, so that takes few and long cuts.
    of_class = [F.length(F.regexp_replace("text", f"[^{c}]+", "")) for c in CLASSES]
    chars = F.array(*of_class, F.length("text") - words_only)
    vocabulary = F.array(*map(F.lit, VOCABULARY))
    bare = F.transform("w", lambda x: F.rtrim(F.lower(x), F.lit(".,;:?!")))
    hits = F.filter(bare, lambda x: x.isin(VOCABULARY + SYMBOLS))
    symbols = lambda h: F.array(F.size(F.filter(h, lambda x: x.isin(SYMBOLS))))
    common = F.transform(F.array(hits), lambda h: F.concat(F.transform(vocabulary, lambda c: F.size(h) - F.size(F.array_remove(h, c))), symbols(h)))[0]
    return split.select(
        "doc_id",
        "row",
        "lang",
        F.size("w").alias("n_words"),
        words_only.alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.expr(_REPEATS).alias("n_repeat_words"),
        F.transform(F.array(chars), lambda c: F.concat(c, F.array(F.length("text") - F.aggregate(c, F.lit(0), lambda a, x: a + x))))[0].alias("chars"),
        F.transform(F.array(common), lambda c: F.concat(c, F.array(F.size("w") - F.aggregate(c, F.lit(0), lambda a, x: a + x))))[0].alias("common"),
    )


def references(counted: DataFrame) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Shares of each language's histograms over the whole corpus, of characters and of common words.

    Sums of the bins of ``1 / MIN_SHARE`` languages at most reach the driver.
    """
    stated = counted.where("lang is not null")
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    of = stated.groupBy("lang").agg(F.sum(size(F.col("chars"))).alias("n"))
    large = of.join(F.broadcast(of.agg(F.sum("n").alias("all"))), F.col("n") >= F.col("all") * MIN_SHARE).where("n > 0").select("lang")
    known = [r.lang for r in large.collect()]
    both = stated.where(F.col("lang").isin(known)).select("lang", F.posexplode(F.concat("chars", "common")).alias("bin", "n"))
    sums: dict[str, dict[int, int]] = {}
    for lang, at, n in both.groupBy("lang", "bin").agg(F.sum("n")).collect() if known else []:
        sums.setdefault(lang, {})[at] = n
    edge, end = len(CLASSES) + 2, len(CLASSES) + len(VOCABULARY) + 4

    def shares(part: range, langs: Iterable[str]) -> dict[str, list[float]]:
        bins = {x: [sums[x].get(i, 0) for i in part] for x in sorted(langs)}
        return {x: [n / sum(b) for n in b] for x, b in bins.items() if sum(b)}

    return shares(range(edge), sums), shares(range(edge, end), sums.keys() & COMMON.keys())


def distance(histogram: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) between a histogram of counts (not all zero) and shares."""
    total = F.aggregate(histogram, F.lit(0.0), lambda a, n: a + n)

    def term(n: Column, q: Column) -> Column:
        p = n  # a share by now
        mean = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / mean)).otherwise(F.lit(0.0)) / 2 + F.when(q > 0, q * F.log2(q / mean)).otherwise(F.lit(0.0)) / 2

    shares = F.transform(F.array(total), lambda t: F.transform(histogram, lambda n: n / t))[0]
    divergence = F.aggregate(F.zip_with(shares, F.array(*map(F.lit, reference)), term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))  # rounding can bring it below 0


def _verdicts(counted: DataFrame) -> DataFrame:
    of_chars, of_words = references(counted)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)

    def least(column: str, known: dict[str, list[float]], judged: Column) -> Column:
        each = [distance(F.col(column), r) for r in known.values()]
        return F.when(judged, F.array_min(F.array(*each))) if each else F.lit(None).cast("double")

    out = counted.withColumn("base_failed", failed)
    out = out.withColumn("char_distance", least("chars", of_chars, ~failed & (F.col("lang").isNull() | F.col("lang").isin(sorted(of_chars))))).withColumn("word_distance", least("common", of_words, ~failed & F.col("lang").isin(sorted(of_words))))
    near = lambda c, limit: F.coalesce(F.col(c) <= limit, F.lit(True))
    limits = {"char_distance": F.lit(MAX_CHAR_DIVERGENCE**0.5), "word_distance": F.sqrt(F.lit(MAX_WORD_DIVERGENCE) + WORD_SLACK / n)}
    return out.withColumn("kept", ~failed & near("char_distance", limits["char_distance"]) & near("word_distance", limits["word_distance"]))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, the counts, char_distance, word_distance (null where not judged), base_failed and kept."""
    out = _verdicts(cut(counts(docs, id_col, text_col, lang_col), "counts"))
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *longs, "char_distance", "word_distance", "base_failed", "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rejected = _verdicts(cut(counts(docs, id_col, text_col, lang_col), "counts")).where("not kept")
    return without(docs, rejected, id_col, text_col, lang_col)
