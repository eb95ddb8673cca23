"""URL filters on a sorted digest array.

The rules' keys (host and the beginning of a path) are hashed to 64 bits and stored sorted in a file, with the full
strings behind them. Each Python worker memory-maps the file, hashes the keys under which a url could be listed (its
host and its parent domains with as many labels as a rule's host, with its path cut at each length among the rules), probes them all with one
vectorised binary search, and confirms every hit against the stored string. The longest confirmed rule decides.

Defined results: null urls and those without ``://`` have an empty host and path and fit no rule; rows that repeat are
judged each; without a fitting rule the default verdict holds; an empty rule list fits nothing. Other columns are
ignored. An empty table returns no rows. A url's keys are as many as the rules have lengths and numbers of labels, so
long hosts and paths take no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, schema_with, shared_dir


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def build(rules: list[tuple[str, str]]) -> bytes:
    """A file of ``rules`` (verdict, ``host/path``): counts, lengths of path beginnings, numbers of labels, digests, offsets, verdicts, strings."""
    import xxhash

    keyed = sorted({(xxhash.xxh64_intdigest(rule.encode()), rule.encode(), verdict == "block") for verdict, rule in rules})
    lengths = sorted({len(rule) - rule.index(b"/") for _, rule, _ in keyed})
    ends = np.cumsum([0, *(len(rule) for _, rule, _ in keyed)])
    depths = sorted({rule.split(b"/")[0].count(b".") + 1 for _, rule, _ in keyed})
    numbers = [[len(keyed), len(lengths), len(depths)], lengths, depths, [k for k, _, _ in keyed], ends, [b for _, _, b in keyed]]
    return b"".join([*(np.array(x, np.uint64).tobytes() for x in numbers), *(rule for _, rule, _ in keyed)])


class Digests:
    """A memory-mapped file of ``build``."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n, k, d = map(int, whole[:24].view(np.uint64))
        cuts = np.cumsum([24, 8 * k, 8 * d, 8 * n, 8 * (n + 1), 8 * n])
        self.lengths, self.depths, self.keys, self.ends, self.blocks = (whole[a:b].view(np.uint64) for a, b in zip(cuts, cuts[1:], strict=False))
        self.strings = whole[cuts[-1] :]

    def rule(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The entry of each key, or -1."""
        import xxhash

        found = np.full(len(keys), -1)
        if not len(self.keys) or not keys:
            return found
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.keys, digests)
        for i in np.nonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)[0]:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # digests can collide, strings decide
                if self.rule(j) == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def suffixes(host: str, depths: list[int]) -> list[str]:
    """The ends of a host that have one of these numbers of labels. Its other ends are never built."""
    found, at, labels = [], len(host), 0
    for depth in sorted(depths):
        while labels < depth and at >= 0:
            at = host.rfind(".", 0, at)
            labels += 1
        if labels == depth:
            found.append(host[at + 1 :])
        if at < 0:
            break
    return found


def candidates(host: str, path: str, lengths: list[int], depths: list[int]) -> list[bytes]:
    """The keys under which a url can be listed. ``lengths``: UTF-8 bytes of path beginnings; ``depths``: labels of hosts."""
    if not host:
        return []
    tail = path[: max(lengths, default=0)].encode()
    heads = [h.encode() for h in suffixes(host, depths)]
    return [h + tail[:n] for h in heads for n in lengths if n <= len(tail)]


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``. ``rules``: (allow or block, host with the beginning of a path)."""
    spark = pages.sparkSession
    name = _ship(spark, rules)
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        listed = Digests(SparkFiles.get(name))
        lengths, depths = ([int(x) for x in some] for some in (listed.lengths, listed.depths))
        for batch in batches:
            keys, owner = [], []
            for i, (h, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                some = candidates(h, p, lengths, depths)
                keys += some
                owner += [i] * len(some)
            best: dict[int, tuple[int, int, int, bytes]] = {}
            entries = listed.probe(keys)
            for k in np.nonzero(entries >= 0)[0]:
                # Of equally long rules the one with the longer host wins.
                this = (len(keys[k]), keys[k].index(b"/"), int(entries[k]), keys[k])
                best[owner[k]] = max(best.get(owner[k], this), this)
            rule = [best[i][3].decode("utf-8", "replace") if i in best else None for i in range(batch.num_rows)]
            verdict = [default if i not in best else "block" if listed.blocks[best[i][2]] else "allow" for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, schema_with(parts, "rule string, verdict string"))


def _ship(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Put the file into the shared folder, named by its content, and give every executor a copy as Spark ships files."""
    import xxhash

    content = build(rules)
    name = f"digests-{xxhash.xxh3_128_hexdigest(content)}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/logfold/{name}")
    files = path.getFileSystem(conf)
    if not files.exists(path):
        out = files.create(path)
        out.write(bytearray(content))
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name
