"""Divergence of text sources: every pair of a language's sources, and the terms each source has too much of.

A group (lang, source) or a whole language gives each kept term t the share p = 1 + floor(10^9 (count + 2) /
(N + 2 V)), with V kept terms and N their occurrences there. Two shares differ by f = floor((p - q)^2 / (p + q)).

1. Terms are counted inside tasks per group; only (group, term) sums are exchanged. Terms with ``min_docs``
   documents in their language are kept and numbered in order.
2. A group's counts become sorted arrays of (term number, count), cut into shards of ``SHARD`` numbers, so an
   array stays small however large the vocabulary is.
3. Groups are dealt into blocks of about ``BLOCK``. One task per shard and unordered pair of blocks co-groups
   the arrays and merges each unordered pair of groups in it: a galloping intersection finds the shared terms; those
   are priced with both counts, terms of one side with the other's share of an absent term. Terms that both lack are
   a number times one price, added at the end. f is symmetric, so a pair is priced once and told both ways.
4. A group's own terms are compared with the language's shares; the best ``top`` are a window over (lang, source).

Cases: NULL text, lang and source read as empty; a group without kept terms has N = 0 and is paired like any
other; with V = 0 every value is 0; repeated rows count as often as they come; equal values go by item in UTF-8
order; an empty table gives an empty result; counts up to 9 * 10^15 are exact; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdant.llm._rank import numbered
from verdant.session import cut_lineage

SHARD = 1 << 15
BLOCK = 32
#: Different (group, term) a task counts before it hands them on; bounds its memory, changes no result.
HELD = 400_000
UNIT = 1_000_000_000

#: Letters and everything beyond ASCII stay, A-Z become lower case, the rest parts terms.
_LETTERS = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LETTERS).split() if text else []


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per group and term, and a row with a NULL term per group; written once."""
    fields = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), defaultdict(lambda: (Counter(), Counter()))

        def sums() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, docs) in held.items():
                terms = [t.decode() for t in n]
                arrays = [[a] * len(n), [b] * len(n), terms, list(n.values()), [docs[t] for t in n]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(arrays, kinds, strict=True)], fields)
            held.clear()

        for batch in rows:
            size = 0
            for a, b, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) not in seen:
                    seen.add((a, b))
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(([a], [b], [None], [0], [1]), kinds, strict=True)], fields)
                terms = terms_of(x)
                n, docs = held[a, b]
                size -= len(n)
                n.update(terms)
                docs.update(set(terms))
                size += len(n)
                if size > HELD:
                    yield from sums()
                    size = 0
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from sums()
            if len(seen) > HELD:
                seen.clear()
        yield from sums()

    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    each = given.mapInArrow(batches, "lang string, source string, term string, n long, docs long")
    return cut_lineage(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counted: DataFrame, min_docs: int = 10) -> DataFrame:
    """(lang, term, total, tid): terms of enough documents of their language, numbered in order."""
    per_term = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    return numbered(cut_lineage(per_term.filter(F.col("docs") >= min_docs).drop("docs")), F.asc("lang"), F.asc("term"), name="tid")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in whole numbers; 10^9 times a count is beyond a long, hence three digits at a time."""
    out, rest, base = F.lit(1).cast("long"), count + 2, total + 2 * kept
    for unit in (1_000_000, 1_000, 1):
        out, rest = out + _div(rest * 1000, base) * unit, rest * 1000 % base
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    out, rest, base = np.ones(len(count), np.int64), count.astype(np.int64) + 2, np.int64(total + 2 * kept)
    for unit in (1_000_000, 1_000, 1):
        rest = rest * 1000
        out += unit * (rest // base)
        rest %= base
    return out


def price(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // (p + q)).sum())


def galloping(short: np.ndarray, long: np.ndarray, stride: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places of the shared values in two sorted arrays of different values each.

    The shorter array is taken in strides. For each the search in the longer one goes on from where the last one
    ended, in doubled steps until the stride's last value is passed; the stride is then looked up in that stretch.
    """
    places, at = [], 0
    for low in range(0, len(short), stride):
        part = short[low : low + stride]
        step, end = 1, at
        while end < len(long) and long[end] < part[-1]:
            end, step = end + step, 2 * step
        found = at + np.searchsorted(long[at : end + 1], part)
        places.append(found)
        at = int(found[-1])
    there = np.concatenate(places) if places else np.zeros(0, np.int64)
    here = np.flatnonzero(there < len(long))
    here = here[long[there[here]] == short[here]]
    return here, there[here]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], none_a: int, none_b: int) -> tuple[int, int]:
    """(price of all terms that either has, their number) for two (numbers, shares); ``none_*`` is the share of an absent term."""
    if len(a[0]) > len(b[0]):
        a, b, none_a, none_b = b, a, none_b, none_a
    here, there = galloping(a[0], b[0])
    only_a, only_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
    only_a[here] = only_b[there] = False
    value = price(a[1][here], b[1][there]) + price(a[1][only_a], np.int64(none_b)) + price(np.int64(none_a), b[1][only_b])
    return value, len(a[0]) + len(b[0]) - len(here)


_PAIR = "lang string, a string, b string, value long, terms long"


def _pair_task(table: pa.Table) -> pa.Table:
    """All unordered pairs of one pair of blocks in one shard."""
    rows = []
    for r in table.sort_by("source").to_pylist():
        ids, n = (np.array(r[c] or (), np.int64) for c in ("tids", "counts"))
        absent = int(shares(np.zeros(1, np.int64), r["total"], r["kept"])[0]) if r["kept"] else 1
        rows.append((r["source"], r["block"], (ids, shares(n, r["total"], r["kept"]) if len(n) else n), absent))
    first, second = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    out = []
    for i, (a, block, this, none_a) in enumerate(rows):
        for b, other, that, none_b in rows[i + 1 :]:
            if first == second or block != other:
                out.append((a, b, *merge(this, that, none_a, none_b)))
    names = [pa.array([table.column("lang")[0].as_py()] * len(out), pa.string())]
    columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
    return pa.Table.from_arrays(names + columns, ["lang", "a", "b", "value", "terms"])


def pairs(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value) for every unordered pair a < b of a language's sources."""
    shard = F.call_function("div", F.col("tid"), F.lit(SHARD).cast("long")).alias("shard")
    terms = F.array_sort(F.collect_list(F.struct("tid", "n")))
    arrays = held.groupBy("lang", "source", shard).agg(terms.alias("terms"))
    arrays = arrays.select("lang", "source", "shard", F.col("terms.tid").alias("tids"), F.col("terms.n").alias("counts"))
    shards = held.select("lang", shard).distinct()
    blocks = sizes.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # A group stands in each shard of its language, in shard 0 where there is none, with or without terms in it.
    grid = sizes.join(blocks, "lang").join(shards, "lang", "left").withColumn("shard", F.coalesce("shard", F.lit(0).cast("long")))
    grid = grid.join(arrays, ["lang", "source", "shard"], "left").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = grid.select("*", other).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    tasks = dealt.select("lang", "source", "shard", "block", "bi", "bj", "total", "kept", "tids", "counts")
    found = tasks.groupBy("lang", "shard", "bi", "bj").applyInArrow(_pair_task, _PAIR)
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    for side in ("a", "b"):
        none = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.greatest(F.col("kept"), F.lit(1)))).otherwise(1)
        summed = summed.join(sizes.select("lang", F.col("source").alias(side), none.alias(f"none_{side}"), F.col("kept").alias(f"kept_{side}")), ["lang", side])
    p, q = F.col("none_a"), F.col("none_b")
    return summed.select("lang", "a", "b", (F.col("value") + (F.col("kept_a") - F.col("terms")) * _div((p - q) * (p - q), p + q)).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for each other source, part ``term`` for a source's ``top`` terms above the language."""
    counted = counts(docs, text, lang, source)
    terms = kept_terms(counted, min_docs)
    held = cut_lineage(counted.filter("term IS NOT NULL").join(terms, ["lang", "term"]).select("lang", "source", "term", "tid", "n", "total"))
    groups = counted.filter("term IS NULL").select("lang", "source")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    sizes = groups.join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = cut_lineage(sizes.fillna(0, ["total", "kept", "lang_total"]))

    both = cut_lineage(pairs(held, sizes))
    told = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(both.select("lang", "b", "a", "value"))
    own = held.join(sizes.withColumnRenamed("total", "group_total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("group_total"), F.col("kept")), share(F.col("total"), F.col("lang_total"), F.col("kept"))
    own = own.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    own = own.select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [
        told.withColumn("part", F.lit("pair")).withColumn("rank", place),
        own.withColumn("rank", place).filter(F.col("rank") <= top).withColumn("part", F.lit("term")),
    ]
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(columns).unionAll(ranked[1].select(columns))
