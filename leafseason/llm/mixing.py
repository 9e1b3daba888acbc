"""Mixing of sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the text divided by its actual share, times `epochs`. Each document
gets a uniform number from a seeded hash of its id; the inverse of the Poisson distribution with its source's rate turns
the number into a count; the document is exploded by its count; and all copies are dealt out globally in the order of
another seeded hash. Counts are unbiased, independent of partitioning, and the same in every run with the same seed.

Rates above `STEP` are split into equal parts, each drawn with a hash of its own, since a sum of Poisson numbers is a
Poisson number; nothing is capped. Sources are told apart with null as one of them. A source without any text keeps each
of its documents `epochs` times on average. Null ids hash as the empty string, so rows that share an id share a count. Rows
keep all their columns; a column of the input named like an added one is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 32.0
SMALL = 10_000  # sources that may be broadcast, with a distribution of about 1 kB each
BYTES = 10 << 20  # of their names together


def uniform(seed: str, *keys: Column) -> Column:
    """A number of [0, 1) from 52 bits of a hash."""
    said = F.concat_ws(":", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / float(2**52)


def distribution(mean: Column) -> Column:
    """Probabilities of at most 0, 1, 2, ... under a Poisson distribution, up to where nothing is left of it."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 25).cast("int"))
    empty = F.array(F.exp(-mean))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), empty.alias("all"))

    def grow(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(steps, start, grow, lambda acc: acc["all"])


def repetition_rates(docs: DataFrame, weights: Mapping[str, float] | None, epochs: float, source: str, text: str) -> DataFrame:
    """(__source, __parts, __below): number of draws and distribution of one draw for each source.

    weights: target share of each source, scaled to a sum of 1; sources it lacks get 0; None gives all the same share.
    """
    mass = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("own"))
    if weights is None:
        wanted = mass.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        wanted = mass.withColumn("w", F.coalesce(F.element_at(F.create_map(*pairs), F.col("__source")), F.lit(0.0)) if pairs else F.lit(0.0))
    total = mass.agg(F.sum("own").alias("total")).crossJoin(wanted.agg(F.sum("w").alias("all")))  # one row by one row
    rated = wanted.join(F.broadcast(total), F.lit(True))
    rate = F.when(F.col("own") == 0, F.lit(float(epochs))).when(F.col("all") == 0, 0.0).otherwise(F.col("w") / F.col("all") * epochs * F.col("total") / F.col("own"))
    parts = F.greatest(F.lit(1), F.ceil(rate / STEP).cast("int"))
    return rated.select("__source", parts.alias("__parts"), (rate / parts).alias("mean")).select("__source", "__parts", distribution(F.col("mean")).alias("__below"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs replicated to the target weights and shuffled, with replica (from 1) and mix_key, the order of the shuffle."""
    rates = repetition_rates(docs, weights, epochs, source_col, text_col)
    whole = docs.drop("replica", "mix_key")
    plain = whole.select(F.struct(*whole.columns).alias("__row"))  # apart from the names used here
    of = F.col("__row")[source_col]
    same = of.eqNullSafe(F.col("__source"))
    held = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("__rows"))
    n, size, rows = held.agg(F.count("*"), F.sum(F.octet_length(F.col("__source").cast("string"))), F.sum("__rows")).first()
    if n <= SMALL and (size or 0) <= BYTES:
        rated = plain.join(F.broadcast(rates), same)
    else:
        # Sources with at least 1 / SMALL of the rows, of which there are SMALL at most, don't take part in the shuffle by source.
        large = held.where((F.col("__rows") * SMALL >= rows) & (F.coalesce(F.octet_length(F.col("__source").cast("string")), F.lit(0)) <= BYTES // SMALL)).select(F.col("__source").alias("__large"))
        is_large = F.col("__source").eqNullSafe(F.col("__large"))
        mine = of.eqNullSafe(F.col("__large"))
        rated = plain.join(F.broadcast(rates.join(F.broadcast(large), is_large, "left_semi")), same)
        rated = rated.unionByName(plain.join(F.broadcast(large), mine, "left_anti").join(rates.join(F.broadcast(large), is_large, "left_anti"), same))
    ident = F.col("__row")[id_col]
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda k: uniform(seed, ident, k))
    count = F.aggregate(draws, F.lit(0), lambda s, u: s + F.size(F.filter(F.col("__below"), lambda c: c <= u)))
    copies = rated.withColumn("__n", count).where("__n > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(ident.cast("string"), F.lit("")), F.col("replica"))))
    return keyed.select("__row.*", "replica", "mix_key").orderBy("mix_key")


def mix_sql(seed: str = "mix", epochs: float = 1.0) -> str:
    """mix() with equal weights over documents, in SQL."""
    return f"""
with recursive mass as (select source, sum(coalesce(strlen(text), 0)) own from documents group by source),
rated as (select source, case when own = 0 then {epochs!r}::double else 1.0 / (select count(*) from mass) * {epochs!r}::double * (select sum(own) from mass) / own end rate from mass),
parted as (select source, greatest(1, ceil(rate / {STEP}))::int parts, rate / greatest(1, ceil(rate / {STEP}))::int mean from rated),
below(source, mean, k, p, c) as (
  select source, mean, 0, exp(-mean), exp(-mean) from parted
  union all select source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) from below where k < ceil(mean + 12 * sqrt(mean) + 25)),
lists as (select source, list(c order by k) cs from below group by source),
drawn as (select d.*, (list_sum([len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::varchar, '') || ':' || j), 1, 13))::bigint::double / 4503599627370496.0)) for j in range(1, parts + 1)]))::int n
  from documents d join parted p on d.source is not distinct from p.source join lists l on d.source is not distinct from l.source)
select doc_id, text, lang, source, n_chars, replica, md5('{seed}:order:' || coalesce(doc_id::varchar, '') || ':' || replica) mix_key
from (select * exclude (n), unnest(range(1, n + 1))::int replica from drawn where n > 0)
"""
