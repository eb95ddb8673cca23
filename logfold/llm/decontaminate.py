"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

1. The words that benchmark items hold are counted over all training rows. Each window of an item thus knows its terms
   from the rarest to the commonest.
2. Postings: (term, row, position) of every term that is one of the two rarest of some window, in a table of the shared
   folder whose files are in order of term, with one posting per row that states its number of words.
3. The lists of the two rarest terms of a window, shifted by their offsets in it, are intersected.
4. What is left is checked word by word in the rows that are still candidates.

A phrase match has every term at its place. With ``slop`` over 0 a proximity match has every term within that many
words of its place.

Defined results: null texts have no words; an item without words has no window; items and training rows that repeat
count each; rows that share an id are judged each for themselves; the windows of an item without an id hit, but it is
not counted or named among the items; an empty table on either side matches nothing. Other columns of the inputs are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, NOT_WORD, cut, lower_ascii, row_key, without


def words(text):
    """The words of a text: runs of ASCII letters and digits and all non-ASCII characters; A-Z in lower case."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"{NOT_WORD}+"), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``win, n, words`` of the distinct windows, and ``win, item_id``."""
    split = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = split.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("words"))
    each = cut(each.withColumn("win", F.sha2(F.array_join("words", " "), 256)).distinct(), "windows")
    return each.groupBy("win").agg(F.first("words").alias("words")).withColumn("n", F.size("words")), each.select("win", "item_id").distinct()


def frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """``term_id, f``: how often each of ``terms`` (term, term_id) stands in the texts of ``docs``."""
    each = docs.select(F.explode(words(F.col(text_col))).alias("term"))
    return each.join(terms, "term").groupBy("term_id").agg(F.count("*").alias("f"))


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``term_id, row, pos`` of ``terms`` (term, term_id), row being a hash of id and text; for each row one more with term_id -1, its word count as pos, and doc_id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), words(F.col(text_col)).alias("w"))
    # The word count goes in front as an entry of its own, in a form that no word has.
    entries = rows.select("doc_id", "row", F.posexplode(F.concat(F.array(F.concat(F.lit(" "), F.size("w"))), "w")).alias("at", "term"))
    found = entries.join(terms.select("term", "term_id"), "term", "left")
    head = F.col("at") == 0
    found = found.where(head | F.col("term_id").isNotNull())
    postings = found.select(
        F.when(head, F.lit(-1)).otherwise(F.col("term_id")).alias("term_id"),
        "row",
        F.when(head, F.substring("term", 2, 20).cast("int")).otherwise(F.col("at") - 1).alias("pos"),
        F.when(head, F.col("doc_id")).alias("doc_id"),
    )
    return cut(postings.sortWithinPartitions("term_id"), "postings")


def matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"):
    """``(rows, found, of)``: ``row, doc_id, n_words`` of every row; ``row, doc_id, win, start, n, kind`` of every match; ``win, item_id``."""
    wins, of = windows(items, size, item_col, item_text)
    wins = cut(wins, "distinct-windows")
    terms = wins.select(F.explode("words").alias("term")).distinct()
    terms = cut(terms.withColumn("term_id", F.monotonically_increasing_id()), "terms")
    often = cut(frequencies(docs, _small(terms), text_col), "often")
    places = wins.select("win", "n", F.posexplode("words").alias("off", "term")).join(_small(terms), "term").join(_small(often), "term_id", "left")
    # The two rarest terms of each window; a term without postings rules its window out.
    ranked = places.groupBy("win", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "off", "term_id"))), 1, 2).alias("r"))
    ranked = cut(ranked.where("r[0].f > 0"), "ranked")
    rare = terms.join(_small(ranked.select(F.explode("r.term_id").alias("term_id")).distinct()), "term_id", "left_semi")
    postings = index(docs, _small(cut(rare, "rare")), id_col, text_col)
    lists = postings.where("term_id >= 0")

    def shifted(k: int) -> DataFrame:
        """Starts that the k-th rarest term allows; windows of fewer terms take their last."""
        which = F.least(F.size("r"), F.lit(k)) - 1
        picked = ranked.select("win", F.col("r")[which]["term_id"].alias("term_id"), F.col("r")[which]["off"].alias("off"))
        return lists.join(_small(picked), "term_id").select("row", "win", (F.col("pos") - F.col("off")).alias("start"))

    first, second = shifted(1), shifted(2)
    if slop:
        second = second.select("row", "win", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)).alias("start"))
    both = first.join(second, ["row", "win", "start"], "left_semi").distinct().where("start >= 0" if not slop else f"start >= {-slop}")
    both = both.join(_small(wins), "win").groupBy("row").agg(F.collect_list(F.struct("win", "start", "n", "words")).alias("some"))
    found = cut(_verified(docs, cut(both, "candidates"), slop, id_col, text_col), "matches")
    return postings.where("term_id = -1").select("row", "doc_id", F.col("pos").alias("n_words")), found, of


def _verified(docs: DataFrame, candidates: DataFrame, slop: int, id_col: str, text_col: str) -> DataFrame:
    """The candidates (row, some: windows and starts) whose words all stand in the row's text."""
    own = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    texts = own.join(_small(candidates.select("row")), "row", "left_semi")
    both = texts.join(candidates, "row").select("doc_id", "row", "some", words(F.col("text")).alias("w"))
    exact = "x.start >= 0 and slice(w, x.start + 1, x.n) = x.words"
    near = f"forall(sequence(0, x.n - 1), j -> array_contains(slice(w, greatest(1, x.start + j + 1 - {slop}), least({2 * slop + 1}, greatest(0, x.start + j + 1 + {slop}))), x.words[j]))"
    kind = f"if({exact}, 'phrase', if({near if slop else 'false'}, 'near', null))"
    kept = F.expr(f"filter(transform(some, x -> named_struct('win', x.win, 'start', x.start, 'n', x.n, 'kind', {kind})), x -> x.kind is not null)")
    return both.select("doc_id", "row", F.inline(kept)).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, row, n_words, n_hit, n_items, item_ids`` (sorted as strings, with commas) from its phrase matches."""
    rows, found, of = matches(docs, items, size, 0, id_col, text_col, item_col, item_text)
    spots = found.select("row", "doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct()
    hit = spots.groupBy("row", "doc_id").agg(F.count("*").alias("n_hit"))
    named = of.where("item_id is not null")
    which = found.select("row", "doc_id", "win").distinct().join(named, "win").select("row", "doc_id", F.col("item_id").cast("string").alias("item")).distinct()
    which = which.groupBy("row", "doc_id").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("item_ids"))
    same = lambda a, b: (a["row"] == b["row"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    marks = hit.join(which, same(hit, which), "left").select(hit["row"], hit["doc_id"], "n_hit", "n_items", "item_ids")
    out = rows.join(marks, same(rows, marks), "left")
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(rows["doc_id"], rows["row"], F.col("n_words").cast("long").alias("n_words"), some("n_hit"), some("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    found = contamination(docs, items, size, id_col, text_col, item_col, item_text)
    return without(docs, found.where("n_hit > 0"), id_col, text_col)
