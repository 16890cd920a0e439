"""URL filters: rules, and a Bloom filter cascade for the hosts that no rule decides.

Level 1 of the cascade is a Bloom filter of the listed keys; level 2 of the other keys of
the corpus that level 1 lets pass by mistake; level 3 of the listed keys that level 2 lets
pass; and so on, until no mistake is left. Over the whole universe of the corpus's keys the
answer is exact: a key is listed if the number of levels it passes, before the first that
stops it, is odd. Pages are judged by these filters alone, without a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import write_shared

# The rules as (verdict, host, path), and the listed domains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LISTED = tuple(f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))

BITS_PER_KEY, HASHES = 10, 5
#: A level with more bits is not sent to the tasks: the list is then joined instead.
MOST_BITS = 1 << 26

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path columns of the column ``url``; both empty if it is null or has no ``://``."""
    rest = F.expr(f"coalesce(if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), ''), '')")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, the first of equally long ones; nulls
    if none does."""
    rule = verdict = None
    for says, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("long")) for i in range(HASHES)]


def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the filter's words as an array of longs."""
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at"))
    words = place.select((F.col("at") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    all_words = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    row = F.struct("word", F.coalesce("bit", F.lit(0).cast("long")).alias("bit"))
    return write_shared(all_words.agg(F.array_sort(F.collect_list(row)).alias("rows")).select(F.col("rows.bit").alias("words")))


class Cascade:
    """Exact membership in a list for every key of ``universe`` (columns key, listed)."""

    def __init__(self, universe: DataFrame):
        self.levels: list[tuple[int, DataFrame]] = []
        inside = universe.where("listed").select("key")
        outside = universe.where("not listed").select("key")
        while (n := inside.count()) > 0:
            bits = -(-n * BITS_PER_KEY // 64) * 64
            if bits > MOST_BITS:
                raise OverflowError(f"a filter of {n} keys is too large to send to the tasks")
            level = len(self.levels) + 1
            self.levels.append((bits, _filter(inside, level, bits)))
            inside, outside = outside.where(self.passes(F.col("key"), level)), inside

    def passes(self, key: Column, level: int) -> Column:
        bits, words = self.levels[level - 1]
        held = words.scalar()
        each = [F.expr("true")] + [F.getbit(F.get(held, (at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in _places(key, level, bits)]
        return reduce(lambda a, b: a & b, each)

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            answer = F.when(self.passes(key, level), answer).otherwise(F.lit(level % 2 == 0))
        return answer


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    Where no rule fits, a page is blocked if its host or a domain above it is in ``listed``
    (column ``domain``, lower case; the constant ``LISTED`` by default), else allowed. The
    keys of a host are its last 1, 2, .. labels, for the label counts that the list has. An
    empty host is a key as any other. Null domains and repeated ones count for nothing;
    null page ids and repeated pages stay; other columns are not looked at. A list whose
    filters are larger than ``MOST_BITS`` is joined to the distinct hosts instead.
    """
    spark = pages.sparkSession
    if listed is None:
        listed = spark.createDataFrame([(d,) for d in LISTED], "domain string")
    host, path = host_and_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = listed.where("domain is not null").select(F.col("domain").alias("key")).distinct()
    labels = F.size(F.split("key", r"\."))
    counts = sorted(r[0] for r in own.select(labels.alias("n")).distinct().collect())
    keys = [F.substring_index("host", ".", -n) for n in counts]
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if not keys:
        return rows.select("*", rule.alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"))
    hosts = rows.select("host").distinct()
    universe = hosts.select(F.explode(F.array(*keys)).alias("key")).distinct()
    universe = write_shared(universe.join(own.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    try:
        cascade = Cascade(universe)
    except OverflowError:
        bad = hosts.select("host", F.explode(F.array(*keys)).alias("key")).join(universe.where("listed"), "key").select("host").distinct()
        rows = rows.join(bad.withColumn("bad", F.lit(True)), "host", "left").select("page_id", "host", "path", "bad")
        blocked = F.coalesce(F.col("bad"), F.lit(False))
    else:
        blocked = reduce(lambda a, b: a | b, [cascade.contains(k) for k in keys])
    other = F.when(blocked, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))


ORACLE = f"""
with split as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from split
), rules(verdict, host, path) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
listed(domain) as (values {", ".join(f"('{d}')" for d in LISTED)}),
judged as (
  select p.*, (
    select max_by(r.host || r.path || ' ' || r.verdict, length(r.host || r.path)) from rules r
    where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  ) as found,
  exists (select 1 from listed l where p.host = l.domain or ends_with(p.host, '.' || l.domain)) as bad
  from parts p
)
select page_id, host, path, case when found is not null then split_part(found, ' ', 1) end as rule,
       case when found is not null then split_part(found, ' ', 2) when bad then 'block' else 'allow' end as verdict
from judged
"""
