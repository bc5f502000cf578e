"""Source divergence audit: how far the term distributions of a language's sources lie apart, by joint count histograms.

Terms are runs of letters (A-Z in lower case) and of characters beyond ASCII. A language keeps the V terms that occur in at least
MIN_DOCS of its documents. With N occurrences of kept terms in a group, a term that occurs ``count`` times there has the mass
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and two masses differ by f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

A mass depends on the count alone, so two sources of a language are compared by their joint histogram: how many terms have the
counts (a, b). Cells with two counts above zero come from one join of the counted terms and are summed up in the map tasks; cells
with a zero are implied: a source's own histogram less what it shares with the other, and V less all of these. f is evaluated
once for each cell and multiplied by its terms. No term without an occurrence is ever written down for a source.

Counting: a task counts its documents' terms by language and source in dictionaries of at most HELD entries before anything is
shuffled. Counts are summed by (language, source, term) first and only then by (language, term), so a term that every document
has is dealt over its sources. Pairs are joined by (language, term); a term has no more rows there than its language has sources.

Edge cases: null text, language and source count as ''; every group that occurs is reported, also one without terms; a language
that keeps no term has pairs of value 0 and no terms; repeated rows count as often as they come in; long texts are counted in
pieces; an empty table gives an empty one. The id and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces_at_blanks, stage, utf8

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Entries in a task's dictionaries before they are sent on.
HELD = 400_000

#: Bytes of terms as they are, capitals in lower case, and blanks for all others.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SCHEMA = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes at a time."""
    for piece in pieces_at_blanks(text.translate(_TERM_BYTES)):
        yield piece.split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term, and documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [t.decode() for t in n]
                columns = [[lang] * len(terms), [source] * len(terms), terms, list(n.values()), [docs[t] for t in n]]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*map(pa.Array.to_pylist, batch.columns[:2]), batch.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col)], utf8(F.col(text_col)))
    parts = rows.toDF("lang", "source", "bytes").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def mass(count: Column, total: Column, terms: Column) -> Column:
    """p of a count in a group with ``total`` occurrences, of a language that keeps ``terms`` terms; by whole numbers of 38 digits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(2)).cast("decimal(20,0)")
    below = (total + F.lit(2) * terms).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, below)


def apart(p: Column, q: Column) -> Column:
    """f of two masses: at most 2 * 10^9 + 2 each, so its square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def joint_histograms(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, n_a, n_b, terms): for sources a < b of a language, how many of its kept terms have the counts (n_a, n_b).

    kept: (lang, source, term, n). pairs: (lang, a, b, v), v the number of terms that the language keeps. Cells of no terms are left out.
    """
    one, two = (kept.select("lang", "term", F.col("source").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    both = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("terms"))
    both = stage(both, "divergence-both")
    own = stage(kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "divergence-own")
    zero, key = F.lit(0).cast("long"), ["lang", "a", "b"]
    seen = both
    for s, other in ("ab", "ba"):
        # the other source does not have the term: a source's own histogram, less the terms that both have
        mine = pairs.select(*key).join(own.select("lang", F.col("source").alias(s), F.col("n").alias(f"n_{s}"), "terms"), ["lang", s])
        met = both.groupBy(*key, f"n_{s}").agg(F.sum("terms").alias("met"))
        alone = mine.join(met, [*key, f"n_{s}"], "left").withColumn("terms", F.expr("terms - coalesce(met, 0)"))
        seen = seen.unionByName(alone.withColumn(f"n_{other}", zero).where("terms > 0").select(*both.columns))
    seen = stage(seen, "divergence-seen")
    some = seen.groupBy(*key).agg(F.sum("terms").alias("some"))
    none = pairs.join(some, key, "left").withColumn("terms", F.expr("v - coalesce(some, 0)")).where("terms > 0")
    return seen.unionByName(none.withColumn("n_a", zero).withColumn("n_b", zero).select(*both.columns))


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: the other sources of the language, by the sum of f over all kept terms. Part ``term``: the kept terms that the source has
    more of than its language as a whole, by f, the first ``top_terms``. Ranks go by value, largest first, then by item.
    """
    counts = stage(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"))]
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = stage(terms.drop("docs"), "divergence-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    kept = stage(counts.drop("docs").join(terms, ["lang", "term"]), "divergence-kept")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.fillna(0, ["total", "v", "total_lang"]), "divergence-groups")

    sides = [groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *more) for s, more in (("a", ["v"]), ("b", []))]
    pairs = stage(sides[0].join(sides[1], "lang").where("a < b"), "divergence-pairs")
    cells = joint_histograms(kept.select("lang", "source", "term", "n"), pairs.select("lang", "a", "b", "v")).join(pairs, ["lang", "a", "b"])
    f = apart(*[mass(F.col(f"n_{s}"), F.col(f"total_{s}"), F.col("v")) for s in "ab"])
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(f * F.col("terms")).alias("value"))
    # the pairs of a language that keeps no term have no cell
    sums = stage(pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left").fillna(0, ["value"]), "divergence-sums")
    ways = [sums.select("lang", F.col(s).alias("source"), F.col(o).alias("item"), "value") for s, o in ("ab", "ba")]
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart_by = ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(best))

    masses = kept.join(groups.select("lang", "source", "total", "v", "total_lang"), ["lang", "source"])
    masses = masses.withColumn("p", mass(F.col("n"), F.col("total"), F.col("v"))).withColumn("q", mass(F.col("n_lang"), F.col("total_lang"), F.col("v")))
    more = masses.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", apart_by), ("term", more))]
    return parts[0].unionByName(parts[1])
