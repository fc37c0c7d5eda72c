"""URL filters as a sort-merge range join, with DataFrame functions alone.

Method: a host's labels are reversed and joined with its path into a canonical
key, under which "this host and path prefix" is one interval of keys. Rules and
keys are sorted together and swept once; the open rules form a stack of nested
intervals, and the innermost that still holds a key is the longest rule at that
host level.

A url has one key per host level that rules use (its host, and each suffix of
it), since a rule also holds for subdomains. The longest of the levels' answers
wins: the most code points of host and path together, then the longer host.

The sweep is spread over range partitions of the keys. What a partition needs
from those before it is only the last rule that starts in them, one row per
partition, so that neither a hot host nor a hot url collects in one task.

Defined cases: a null url, or one without ``://``, has empty host and path; no
rule fits an empty host; an empty path does not start with ``/``; rules with
equal host and path: block goes before allow; no rules or pages: nothing
matches; repeated pages are judged each. Where no rule fits, ``default`` holds.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.sources.shared import checkpointed

#: The contract's rules: (host, path, action).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends a label and a host in a key; below every character that a host may hold.
_LABEL_END, _HOST_END = "\x01", "\x02"


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(h)}, {quoted(p)}, {quoted(a)})" for h, p, a in rules)
    return spark.sql(f"select * from values {rows} as r(host, path, action)") if rules else spark.sql("select '' host, '' path, '' action where false")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """``labels`` are reversed already."""
    return F.concat(F.array_join(labels, _LABEL_END), F.lit(_LABEL_END + _HOST_END), path)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]"))


def _chains(rules: DataFrame) -> DataFrame:
    """Each rule key with the stack of rules that are open at it, innermost first.

    A rule's ancestors are rules of the same host with a shorter path. They are
    found by joining on the key's prefixes, one per path length that rules use.
    """
    deduped = rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # "block" > "allow"
    keyed = deduped.select(
        _key(_reversed(F.col("host")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "action",
        F.length("host").alias("host_length"), F.length("path").alias("path_length"), F.size(F.split("host", "[.]")).alias("level"),
    )
    lengths = keyed.select("level", "path_length").distinct().groupBy("level").agg(F.collect_set("path_length").alias("lengths"))
    parts = keyed.join(lengths, "level").withColumn("_cut", F.explode("lengths")).where("_cut <= path_length")
    parts = parts.select("key", F.expr("left(key, length(key) - path_length + _cut)").alias("_anc"))
    held = keyed.select(F.col("key").alias("_anc"), F.struct(F.length("key").alias("n"), F.col("key").alias("prefix"), "rule", "action", "host_length").alias("_r"))
    return parts.join(held, "_anc").groupBy("key").agg(F.sort_array(F.collect_list("_r"), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    spark = pages.sparkSession
    # a page's number among the rows it is swept with; the url itself is the only other thing that moves
    urls = pages.select(F.col(url).alias("url")).distinct().where(F.col("url").isNotNull())
    parsed = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    most = rules.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 1  # one number
    keys = parsed.withColumn("_l", _reversed(F.col("host"))).withColumn("_level", F.explode(F.sequence(F.lit(1), F.least(F.size("_l"), F.lit(most)))))
    keys = keys.select("url", _key(F.slice("_l", F.lit(1), F.col("_level")), F.col("path")).alias("key"), F.lit(1).alias("kind"))
    stacks = _chains(rules)
    both = keys.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType)).unionByName(stacks.select(F.lit(None).cast("string").alias("url"), "key", F.lit(0).alias("kind"), "stack"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(both.repartitionByRange(n, "key", "kind", "url").withColumn("_p", F.spark_partition_id()))
    edges = placed.groupBy("_p").agg(F.max(F.when(F.col("kind") == 0, F.struct("key", "stack"))).alias("_last"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carry = edges.select("_p", F.last("_last", ignorenulls=True).over(before)["stack"].alias("_carry"))
    sweep = Window.partitionBy("_p").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumn("_open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(carry, "_p")
    fits = F.filter(F.coalesce("_open", "_carry"), lambda r: F.col("key").startswith(r["prefix"]))
    top = F.try_element_at(fits, F.lit(1))
    best = F.max(F.when(top.isNotNull(), F.struct(F.length(top["rule"]).alias("n"), top["host_length"].alias("h"), top["rule"].alias("rule"), top["action"].alias("action")))).alias("_best")
    verdicts = swept.groupBy("url").agg(best).select(F.col("url").alias("_url"), F.col("_best.rule").alias("rule"), F.col("_best.action").alias("_action"))
    kept = [pages[c] for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    out = pages.join(verdicts, pages[url] == verdicts["_url"], "left")
    return out.select(*kept, host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), verdicts["rule"].alias("rule"), F.coalesce(verdicts["_action"], F.lit(default)).alias("verdict"))


#: The contract's verdicts in DuckDB.
ORACLE = """
with r(host, path, action) as (values {rules}),
p as (select page_id, coalesce(url, '') as url from pages),
q as (select page_id, translate(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1) as path from p),
m as (select q.page_id, r.host || r.path as rule, r.action, row_number() over (partition by q.page_id order by length(r.host || r.path) desc) as n
    from q join r on (q.host = r.host or suffix(q.host, '.' || r.host)) and starts_with(q.path, r.path))
select q.page_id, q.host, q.path, m.rule, coalesce(m.action, 'allow') as verdict from q left join m on q.page_id = m.page_id and m.n = 1
""".format(rules=", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES))
