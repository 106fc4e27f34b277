"""A rights register made of parts, some made of others: decisions, exclusions and problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed
from ..operators.rights import authorized, own_status, register_problems
from ..sources.views import table
from .registry import query

USES = ("train", "redistribute")


def register(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, per-use entries and components from the parts table, whose columns stand in for what a register holds.

    A part's components are the one before it by its size, and its neighbours
    where its brand says so, so there are chains, a missing part and cycles.
    """
    k, size, brand, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_brand"), F.col("p_type")
    sources = parts.select(
        k.alias("source"),
        F.create_map(F.lit("train"), F.when(kind == "PROMO", "not_permitted").otherwise("cleared"), F.lit("redistribute"), F.when(size < 10, "blocked").otherwise("cleared")).alias("legacy"),
        F.when(brand == "Brand#5", "owner_original").otherwise("third_party").alias("origin"), F.lit("2024-01-01").alias("attested_on"),
        (size == 20).alias("attribution_required"), (size == 21).alias("provider_derived"), (size == 22).alias("disputed"),
    )
    explicit = parts.where(kind.isin("LARGE", "SMALL"))
    entries = explicit.select(
        k.alias("source"), F.when(kind == "LARGE", "train").otherwise("redistribute").alias("use"), F.when(size == 30, "perhaps").when(size == 31, "needs_review").otherwise("cleared").alias("status"),
        F.when(size == 32, None).when(brand == "Brand#5", "owner_original").when(size % 4 == 0, "restricted").otherwise("open_license").alias("path"),
        F.when(size == 33, " ").otherwise("letter").alias("evidence"), F.when(brand == "Brand#5", "owner_authorship").when(size % 4 == 0, "publisher_permission").when(size % 4 == 1, "written_permission").otherwise("open_license").alias("evidence_type"),
        F.when(size == 34, "2023-05-05").when(size == 35, "soon").otherwise("2024-05-05").alias("decided_on"), F.when(size == 36, "someone").otherwise("O01").alias("decided_by"),
        F.when(size % 8 == 0, F.array(F.lit("E02"))).when(size % 8 == 4, F.array(F.lit("O01"))).alias("verified_by"), (size != 37).alias("underlying_rights_checked"),
        F.when(size == 38, "own").when(size % 3 == 0, "CC-BY-NC-4.0").otherwise("CC0-1.0").alias("license"), F.when(size % 3 == 0, "by us").alias("attribution"),
        F.array(F.lit("train")).alias("grant_scope"), F.lit(None).cast("string").alias("provider_terms"),
    )
    before = parts.where((size % 3 == 0) & (k >= size)).select(k.alias("source"), (k - size).alias("component"))
    others = [parts.where(brand == b).select(k.alias("source"), (k + d).alias("component")) for b, d in (("Brand#13", 1), ("Brand#14", -1))]
    gone = parts.where(size == 50).select(k.alias("source"), (-k - 1).alias("component"))
    return sources, entries, before.unionByName(others[0]).unionByName(others[1]).unionByName(gone)


_REGISTER_SQL = r"""p AS (SELECT p_partkey AS source, p_size AS size, p_brand AS brand, p_type AS kind FROM part),
uses(use) AS (VALUES ('train'), ('redistribute')),
comp AS (SELECT DISTINCT * FROM (SELECT source, source - size AS component FROM p WHERE size % 3 = 0 AND source >= size UNION ALL SELECT source, source + 1 FROM p WHERE brand = 'Brand#13'
  UNION ALL SELECT source, source - 1 FROM p WHERE brand = 'Brand#14' UNION ALL SELECT source, -source - 1 FROM p WHERE size = 50)),
ent AS (SELECT source, CASE WHEN kind = 'LARGE' THEN 'train' ELSE 'redistribute' END AS use, CASE size WHEN 30 THEN 'perhaps' WHEN 31 THEN 'needs_review' ELSE 'cleared' END AS explicit,
  CASE WHEN size = 32 THEN NULL WHEN brand = 'Brand#5' THEN 'owner_original' WHEN size % 4 = 0 THEN 'restricted' ELSE 'open_license' END AS path,
  CASE WHEN brand = 'Brand#5' THEN 'owner_authorship' WHEN size % 4 = 0 THEN 'publisher_permission' WHEN size % 4 = 1 THEN 'written_permission' ELSE 'open_license' END AS etype
  FROM p WHERE kind IN ('LARGE', 'SMALL')),
own0 AS (SELECT p.*, u.use, e.path, e.etype, e.use IS NOT NULL AS has, EXISTS (FROM comp WHERE comp.source = p.source) AS made, CASE WHEN u.use = 'train' THEN CASE WHEN kind = 'PROMO' THEN 'not_permitted' ELSE 'cleared' END
  ELSE CASE WHEN size < 10 THEN 'blocked' ELSE 'cleared' END END AS older, e.explicit FROM p CROSS JOIN uses u LEFT JOIN ent e ON e.source = p.source AND e.use = u.use),
own1 AS (SELECT *, CASE WHEN has THEN explicit ELSE older END AS status,
  size IN (21, 22) OR made OR coalesce(etype = 'publisher_permission', false) AS esc, (size % 3 = 0) AS nc FROM own0),
own AS (SELECT *, CASE WHEN status NOT IN ('cleared', 'needs_review', 'blocked', 'not_permitted') THEN ['status'] WHEN has AND status = 'cleared' THEN CASE WHEN path IS NULL THEN ['path'] ELSE list_filter([
  CASE WHEN size = 33 THEN 'no_evidence' END,
  CASE WHEN size = 35 THEN 'decided_on' END, CASE WHEN size = 36 THEN 'decided_by' END,
  CASE WHEN NOT (path = 'restricted' OR (NOT esc AND path = CASE WHEN brand = 'Brand#5' THEN 'owner_original' ELSE 'open_license' END)) THEN 'path_not_open' END,
  CASE WHEN path = 'restricted' AND NOT (size % 8 = 0 OR (size % 8 = 4 AND size = 36)) THEN 'no_independent_verifier' END,
  CASE WHEN path IN ('open_license', 'restricted') AND size = 37 THEN 'underlying_rights' END,
  CASE WHEN path = 'owner_original' AND size = 36 THEN 'owner_decides' END,
  CASE WHEN path = 'owner_original' AND size = 34 THEN 'before_provenance' END,
  CASE WHEN path = 'open_license' AND etype <> 'written_permission' AND size = 38 THEN 'license_unknown' END,
  CASE WHEN path = 'open_license' AND etype <> 'written_permission' AND size <> 38 AND nc AND use = 'redistribute' THEN 'license_use' END,
  CASE WHEN path = 'open_license' AND etype = 'written_permission' AND use <> 'train' THEN 'grant_scope' END,
  CASE WHEN size = 20 THEN 'attribution' END, CASE WHEN size = 21 THEN 'provider_terms' END], lambda x: x IS NOT NULL) END ELSE [] END AS errors FROM own1),
ok AS (SELECT source, use, status = 'cleared' AND len(errors) = 0 AS ok FROM own)"""
_CLOSURE_SQL = """reach AS (SELECT source, component FROM comp UNION SELECT r.source, c.component FROM reach r JOIN comp c ON c.source = r.component),
looped AS (SELECT DISTINCT source AS node FROM reach WHERE source = component),
held AS (SELECT r.source, u.use, bool_or(NOT coalesce(k.ok, false)) AS refused, bool_or(r.component IN (FROM looped) OR r.source IN (FROM looped)) AS circular
  FROM reach r CROSS JOIN uses u LEFT JOIN ok k ON k.source = r.component AND k.use = u.use GROUP BY r.source, u.use),
judged AS (SELECT o.source, o.use, o.status, o.errors, o.has, o.older, k.ok, CASE WHEN NOT k.ok THEN CASE WHEN len(o.errors) > 0 THEN o.errors[1] ELSE o.status END WHEN refused THEN 'component_not_cleared' WHEN circular THEN 'circular_components' ELSE '' END AS reason
  FROM own o JOIN ok k USING (source, use) LEFT JOIN held h ON h.source = o.source AND h.use = o.use)"""


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    sources, entries, components = register(table(spark, sf, "part"))
    own = checkpointed(own_status(sources, spark.createDataFrame([(u,) for u in USES], "use string"), entries, components))
    return own, authorized(own, components), sources, components


@query(
    f"""WITH RECURSIVE {_REGISTER_SQL}, {_CLOSURE_SQL}
SELECT source, use, reason = '' AS allowed, CASE WHEN reason = '' THEN 'cleared' WHEN status = 'cleared' OR len(errors) > 0 THEN 'needs_review' ELSE status END AS status, reason,
  CASE WHEN has THEN 'source' ELSE 'legacy' END AS basis FROM judged"""
)
def rights_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """May each source be used for each purpose, with all it is made of."""
    return _decided(spark, sf)[1]


@query(
    f"""WITH RECURSIVE {_REGISTER_SQL}, {_CLOSURE_SQL}
SELECT source, use, unnest(errors) AS problem FROM judged WHERE has
UNION ALL SELECT source, use, 'older_column_differs' FROM judged WHERE has AND status = 'cleared' AND older <> 'cleared'
UNION ALL SELECT source, use, 'cleared_before_components' FROM judged WHERE has AND reason IN ('component_not_cleared', 'circular_components')
UNION ALL SELECT DISTINCT source, NULL, 'unknown_component' FROM comp WHERE component NOT IN (SELECT source FROM p)"""
)
def rights_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that makes the register inconsistent."""
    own, decided, sources, components = _decided(spark, sf)
    return register_problems(own, decided, sources, components)
