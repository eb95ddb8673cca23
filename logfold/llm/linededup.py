"""Line deduplication by winnowing. DataFrame operations only.

A run is a sequence of a document's worded lines (blank lines are passed over). A run of ``min_bytes`` UTF-8 bytes or
more that occurred before (in an earlier document by doc_id, or earlier in its own) is deleted, line by line.

1. Lines are hashed. From each line a window reaches forward until it holds ``min_bytes``. The least line hash of a
   window (of equal ones the first) is its fingerprint; neighbouring windows mostly share theirs, so a document has far
   fewer fingerprints than lines. Any two equal runs of ``min_bytes`` hold equal windows and so share a fingerprint at
   the same place.
2. Positions are joined on fingerprints. Only fingerprints that stand at two positions or more go on.
3. From each such position the match is extended both ways over the line hashes: every window around the fingerprint,
   reaching forward from its first line or back from its last one, is a key of all its hashes. Each key meets its first
   occurrence only, so frequent lines give no pairs. The windows of both directions cover the whole of a maximal equal
   run.
4. Lines that a later occurrence covers go. The first occurrence of a line's content always stays.

Defined results: a null text stays null; an empty text stays empty; blank lines stay; a document whose lines all go
has an empty text; rows that repeat doc_id and text count as one document and get the same result; other columns pass
through, whatever their names, but for ``n_lines`` and ``n_deleted``, which the counts of ``dedup_lines`` replace (``keep``
leaves them as they are). An empty table returns no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, drop, record, row_key

_LINES = "split(coalesce({text}, ''), '\\n')"
_BLANK = "rlike({x}, '^[\\\\x20\\\\x09-\\\\x0D]*$')"

#: The worded lines of a document: a hash, another one, bytes.
_HASHES = "transform(filter({lines}, x -> not {blank}), x -> named_struct('h', xxhash64(x), 'm', hash(x), 'n', octet_length(x)))"
#: Per line the number of lines of the window that reaches forward from it, 0 where the document ends before.
_FORWARD = """
transform(sequence(1, size(H)), s -> if(H[s - 1].n >= {t}, 1, aggregate(slice(H, s, {t}), named_struct('w', 0L, 'c', 0),
  (a, e) -> if(a.w >= {t}, a, named_struct('w', a.w + e.n, 'c', a.c + 1)), a -> if(a.w >= {t}, a.c, 0))))
"""
#: Per line the fingerprint of its forward window (null without one): hash and place, from 1.
_MINIMA = """
transform(C, (c, i) -> if(c = 0, null, if(c = 1, named_struct('fp', H[i].h, 'at', i + 1),
  transform(array(transform(slice(H, i + 1, c), e -> e.h)), v -> transform(array(array_min(v)), f -> named_struct('fp', f, 'at', i + cast(array_position(v, f) as int)))[0])[0])))
"""
#: Per line the number of lines of the window that reaches back from it where it takes two or more, else 0.
_BACKWARD = """
transform(sequence(1, size(H)), e -> if(H[e - 1].n >= {t}, 0, aggregate(reverse(slice(H, greatest(1, e - {t} + 1), least(e, {t}))), named_struct('w', 0L, 'c', 0),
  (a, y) -> if(a.w >= {t}, a, named_struct('w', a.w + y.n, 'c', a.c + 1)), a -> if(a.w >= {t}, a.c, 0))))
"""
#: The windows whose fingerprint stands at a place of ``shared``; a backward window has that of the forward one from its first line.
_AROUND = """
transform(filter(array_distinct(concat(
    transform(sequence(1, size(H)), s -> named_struct('lo', s, 'c', C[s - 1])),
    transform(sequence(1, size(H)), e -> named_struct('lo', e - B[e - 1] + 1, 'c', B[e - 1])))),
  x -> x.c > 0 and array_contains(shared, M[x.lo - 1].at)),
  x -> transform(array(slice(H, x.lo, x.c)), v -> named_struct('lo', x.lo, 'c', x.c, 'key', xxhash64(v), 'chk', hash(v)))[0])
"""


def fingerprints(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rid, H, C, M``: per document with a window (rid: hash of id and text) its line hashes, the sizes of its
    forward windows and their fingerprints, one a line."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hashed = named.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rid"), F.expr(_HASHES.format(lines=_LINES.format(text="text"), blank=_BLANK.format(x="x"))).alias("H"))
    large = hashed.where(F.aggregate("H", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= min_bytes)
    return large.withColumn("C", F.expr(_FORWARD.format(t=min_bytes))).withColumn("M", F.expr(_MINIMA))


def shared_places(lines: DataFrame) -> DataFrame:
    """``rid, shared``: per document the places of its fingerprints that stand somewhere else too."""
    # A line's fingerprint counts once, however many windows have it.
    places = cut(lines.select("rid", F.inline(F.array_distinct(F.filter("M", lambda m: m.isNotNull())))), "places")
    spread = places.groupBy("fp").agg(F.min(F.struct("rid", "at")).alias("a"), F.max(F.struct("rid", "at")).alias("b"))
    common = cut(spread.where("a <> b").select("fp"), "shared")
    return places.join(common, "fp", "left_semi").groupBy("rid").agg(F.collect_set("at").alias("shared"))


def deleted_lines(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rid, gone``: per document with deletions, the indexes from 0 among its worded lines."""
    lines = cut(fingerprints(docs, min_bytes, id_col, text_col), "lines")
    matched = lines.join(cut(shared_places(lines), "matched"), "rid").withColumn("B", F.expr(_BACKWARD.format(t=min_bytes)))
    met = cut(matched.select("doc_id", "rid", F.inline(F.expr(_AROUND))), "windows")
    drop(lines)
    first = met.groupBy("key", "chk").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "rid", "lo")).alias("first")).where("times > 1")
    # A table of its own, so that the join reads both sides from exchanges and Spark can split a frequent run.
    later = met.join(cut(first, "first"), ["key", "chk"]).where(F.struct("doc_id", "rid", "lo") > F.col("first"))
    runs = later.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("lo", "c")).alias("runs"))
    return runs.select("doc_id", "rid", F.expr("array_distinct(flatten(transform(runs, r -> sequence(r.lo - 1, r.lo + r.c - 2))))").alias("gone"))


def _without_runs(docs: DataFrame, min_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """``record`` (the row as it came), ``text`` (what stays of it), ``n_lines`` (worded) and ``n_deleted``, for every row."""
    gone = cut(deleted_lines(docs, min_bytes, id_col, text_col), "deleted").select(F.col("doc_id").alias("of"), "rid", "gone")
    own = docs.select(record(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    # Always a merge join: the deletions grow with the corpus, and the plan stays the same at every size.
    both = own.join(gone.hint("merge"), (own["key"] == gone["rid"]) & own["id"].eqNullSafe(gone["of"]), "left")
    lines = _LINES.format(text="text")
    worded = F.expr(f"transform(filter(transform({lines}, (x, i) -> named_struct('i', i, 'b', {_BLANK.format(x='x')})), e -> not e.b), e -> e.i)")
    both = both.withColumn("worded", worded)
    kept = F.expr(f"transform(array({lines}), l -> array_join(transform(array_except(sequence(0, size(l) - 1), transform(gone, g -> worded[g])), i -> l[i]), '\\n'))[0]")
    return both.select(
        "record",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.size("worded").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_deleted"),
    )


def _updated(docs: DataFrame, text_col: str) -> list[Column]:
    return [F.col("text").alias(text_col) if c == text_col else v for c, v in columns(docs)]


def dedup_lines(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeated runs deleted from its text, and two more columns: n_lines (worded) and n_deleted."""
    own = [v for c, v in zip(docs.columns, _updated(docs, text_col), strict=True) if c not in ("n_lines", "n_deleted")]
    return _without_runs(docs, min_bytes, id_col, text_col).select(*own, "n_lines", "n_deleted")


def keep(docs: DataFrame, min_bytes: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with later repeated runs deleted, without the rows whose worded lines all went."""
    return _without_runs(docs, min_bytes, id_col, text_col).where("n_deleted = 0 or n_deleted < n_lines").select(*_updated(docs, text_col))
