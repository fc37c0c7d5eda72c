"""Mixing sources to target weights, with DataFrame functions alone.

Method: sizes are summed per source; target / size is the source's repetition
rate; each document is emitted floor(rate) times plus one more time with
probability equal to the fraction, drawn from a hash of the document.

Sixteen independent draws are hashed per document, and per source the draw
whose total lies nearest to the target is used, so that small sources too end
near it. All draws are functions of id and text: reruns agree.

Defined cases: a null or empty text has size 0 and is never repeated; a null
source is a source, ordered last; rows that repeat are documents like others,
and those with the same id and text share their draw; an empty table gives an
empty mix; columns other than those named are carried along untouched.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.resolve import sequenced
from tidelog.sources.shared import SharedTables, checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
_SEEDS = 2  # sha-256 digests per document, 8 draws of 32 bits each
_DRAWS = 8 * _SEEDS


def n_words(text: Column) -> Column:
    """Runs of anything but space and \\t-\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _before(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with sums of columns over all rows before each, in order: summed within range partitions, with one row of totals per partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    ahead = (Window.unboundedPreceding, -1)
    totals = placed.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    across = Window.orderBy("_p").rowsBetween(*ahead)  # a row per shuffle partition
    carried = totals.select("_p", *[F.coalesce(F.sum(f"_t_{name}").over(across), F.lit(0.0)).alias(f"_c_{name}") for name in sums])
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(*ahead)
    summed = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0.0)).alias(f"_i_{name}") for name, c in sums.items()])
    joined = summed.join(F.broadcast(carried), "_p")
    return joined.select(*rows.columns, *[(F.col(f"_c_{name}") + F.col(f"_i_{name}")).alias(name) for name in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with its ``target``: by weight, at most ``cap`` times its size.

    Resharing the excess until no source is above its cap ends where every
    uncapped source gets the same amount per weight, and the capped ones are
    those with the least size per weight. So sources are sorted by that ratio
    and the first level at which the next source stays below its cap is taken.
    Sources are ranked and summed in range partitions, as there may be many.
    """
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % n + 1).cast("int"))
    ranked = sequenced(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], 0).withColumnRenamed("seq", "_rank").withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = [F.col("_ratio").asc(), F.col("_rank").asc()]
    summed = checkpointed(_before(ranked, order, {"_capped": "_cap", "_passed": "_w"}))
    whole, weight = summed.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (F.lit(share) * F.lit(float(whole or 0)) - F.col("_capped")) / (F.lit(float(weight or 0)) - F.col("_passed"))
    found = summed.withColumn("_level", level).where(F.col("_level") <= F.col("_ratio")).agg(F.min(F.struct("_ratio", "_rank", "_level"))["_level"]).first()[0]
    target = F.col("_cap") if found is None else F.least(F.col("_cap"), F.lit(found) * F.col("_w"))
    return summed.select("source", "source_size", target.alias("target"))


def _draws(doc_id: Column, text: Column) -> Column:
    """Hex digits of all draws of a document."""
    seed = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), seed), 256) for i in range(_SEEDS)])


def _draw(digits: Column, k: Column | int) -> Column:
    """Draw ``k``, uniform in [0, 1)."""
    at = k if isinstance(k, Column) else F.lit(k)
    return F.conv(F.substr(digits, at * 8 + 1, F.lit(8)), 16, 10).cast("bigint") / F.lit(4294967296.0)


def _n_copies(size: Column, digits: Column) -> Column:
    extra = F.when(_draw(digits, F.col("_k")) < F.col("_part"), 1).otherwise(0)
    return F.when(size > 0, F.col("_floor") + extra).otherwise(0).cast("int")


def plan_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, cap=CAP) -> tuple[DataFrame, DataFrame]:
    """(documents, sources). Documents: id, source, size and draws, without text.
    Sources: _source, source_size, target, _floor and _part of the rate, _k the draw to use.

    The text is read once, for the first table; both are written to the shared
    folder, so that their sizes are known where they are joined: a table of
    sources under the session's broadcast threshold is broadcast, a larger one
    sort-merged with hot sources split.
    """
    shared = SharedTables(docs.sparkSession)
    small = shared.put(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _draws(F.col(id_col), F.col(text_col)).alias("_digits")))
    goal = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = shared.put(goal.select(F.col("source").alias("_source"), "source_size", "target", F.floor(rate).cast("bigint").alias("_floor"), (rate - F.floor(rate)).alias("_part")))
    held = small.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    # partial sums per source leave each map task, not documents
    added = [F.sum(F.when(_draw(F.col("_digits"), k) < F.col("_part"), F.col("size")).otherwise(0)).alias(f"_a{k}") for k in range(_DRAWS)]
    short = F.col("target") - F.col("_floor") * F.col("source_size")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_a{k}") - F.col("_short")).alias("off"), F.lit(k).alias("k")) for k in range(_DRAWS)]))["k"]
    drawn = held.groupBy("_source").agg(F.first(short).alias("_short"), *added).select(F.col("_source").alias("_s"), nearest.alias("_k"))
    sources = shared.put(goal.join(drawn, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))
    return small, sources


def mixed_counts(docs: DataFrame, **names) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and n_copies."""
    small, sources = plan_mix(docs, **names)
    held = small.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    return held.select("doc_id", "source", "size", "source_size", "target", _n_copies(F.col("size"), F.col("_digits")).alias("n_copies"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed corpus: each document's row as often as the mix takes it, with the columns of ``docs``."""
    _, sources = plan_mix(docs, id_col, text_col, source_col, **options)
    sources = sources.select([F.col(c).alias(f"_mix{c}") for c in ("_source", "_floor", "_part", "_k")])
    held = docs.join(sources, docs[source_col].eqNullSafe(F.col("_mix_source")))
    digits = _draws(docs[id_col], docs[text_col])
    extra = F.when(_draw(digits, F.col("_mix_k")) < F.col("_mix_part"), 1).otherwise(0)
    n = F.when(n_words(docs[text_col]) > 0, F.col("_mix_floor") + extra).otherwise(0).cast("int")
    times = F.explode(F.sequence(F.lit(1), F.col("_mix_n")))
    return held.select(*[docs[c] for c in docs.columns], n.alias("_mix_n")).where("_mix_n > 0").withColumn("_mix_i", times).drop("_mix_n", "_mix_i")


#: The same mix in DuckDB.
ORACLE = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as seed from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from d group by source),
w as (select *, case (r - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 2.0::double * source_size as cap from s),
v as (select *, cap / w as ratio, sum(source_size) over () as whole from w),
l as (select *, (1.5::double * whole - coalesce(sum(cap) over (order by ratio, r rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by ratio, r rows between current row and unbounded following) as level from v),
c as (select level as chosen from l where level <= ratio order by ratio, r limit 1),
t as (select source, source_size, coalesce(least(cap, (select chosen from c) * w), cap) as target from l),
g as (select *, case when source_size > 0 then target / source_size else 0.0::double end as rate from t),
x as (select d.*, g.source_size, g.target, floor(rate)::bigint as fl, rate - floor(rate) as part,
    sha256('0:' || seed) || sha256('1:' || seed) as digits from d join g on d.source is not distinct from g.source),
u as (select *, list_transform(range(0, 16), lambda k: (('0x' || substr(digits, (8 * k + 1)::bigint, 8))::bigint / 4294967296.0::double < part)::int) as takes from x),
e as (select source, k, abs(sum(takes[k + 1] * size) - (any_value(target) - any_value(fl * source_size))) as off from u, range(0, 16) q(k) group by source, k),
b as (select source, k from (select *, row_number() over (partition by source order by off, k) as n from e) where n = 1)
select doc_id, size, source_size, target, (size * (fl + takes[b.k + 1]))::bigint as taken from u join b on u.source is not distinct from b.source
"""
