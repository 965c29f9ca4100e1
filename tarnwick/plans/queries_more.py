"""Queries of fragments, row roll-ups, linkage, motif counts and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import scalar
from tarnwick.operators import graph, rollup
from tarnwick.plans.queries_basic import FEATURES, _features
from tarnwick.plans.views import rounded
from tarnwick.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FRAGMENTS = FEATURES + ", fr AS (SELECT unnest(range(0, 64)) AS pos, unnest(list_transform(range(0, 64), lambda k: 'f' || (k % 7))) AS fragment UNION ALL SELECT unnest(range(0, 64, 5)), 'fifth')"


def _fragments(spark):
    one = spark.range(64).select(F.col("id").alias("pos"), F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("fragment"))
    return one.unionByName(spark.range(0, 64, 5).select(F.col("id").alias("pos"), F.lit("fifth").alias("fragment")))


@query(f"WITH {FRAGMENTS} SELECT label, fragment, mean_abs, n, rank FROM (SELECT label, fragment, round(avg(abs(v)), 6) AS mean_abs, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY avg(abs(v)) DESC, fragment) AS rank FROM e JOIN fr USING (pos) GROUP BY 1, 2) WHERE rank <= 3")
def fragment_importance(spark, sf):
    return rounded(rollup.fragment_importance(_features(spark, sf), _fragments(spark), ["pos"], ["label"], "v", 3))


@query(f"WITH {FEATURES}, r AS (SELECT vec_id, sum(abs(v)) AS total, max(abs(v)) / sum(abs(v)) AS largest, count(*) AS n FROM e GROUP BY 1) SELECT vec_id, round(total, 6) AS total, round(largest, 6) AS largest, n, coalesce(quality, -1) AS quality FROM r LEFT JOIN (SELECT doc_id AS vec_id, max(quality) AS quality FROM labels GROUP BY 1) USING (vec_id)")
def row_rollup(spark, sf):
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("quality").alias("quality"))
    return rounded(rollup.row_rollup(_features(spark, sf), ["vec_id"], "v", labels, ["vec_id"]).na.fill(-1, ["quality"]))


@query()
def linkage_clusters(spark, sf):
    means = _features(spark, sf).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    vectors = means.groupBy(F.col("label").cast("string").alias("label")).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("z")).select("label", F.transform("z", lambda x: x["v"]).alias("v"))
    found = rollup.average_linkage(rollup.cosine_similarity(vectors, "label", "v"), 3)
    return spark.createDataFrame(list(found.items()), "label string, cluster int")


@query("""WITH s AS (SELECT DISTINCT c_nationkey AS g, least(c_custkey % 12, o_orderkey % 12) AS x, greatest(c_custkey % 12, o_orderkey % 12) AS y FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 12 <> o_orderkey % 12),
  b AS (SELECT * FROM s UNION ALL SELECT g, y, x FROM s),
  t AS (SELECT p.g, count(*) // 6 AS n_triangles FROM b p JOIN b q ON p.g = q.g AND p.y = q.x JOIN b r ON q.g = r.g AND q.y = r.x AND r.y = p.x GROUP BY 1),
  w AS (SELECT p.g, p.x, q.y AS z, count(*) AS k FROM b p JOIN b q ON p.g = q.g AND p.y = q.x WHERE p.x < q.y GROUP BY ALL), sq AS (SELECT g, cast(sum(k * (k - 1) / 2) / 2 AS bigint) AS n_squares FROM w GROUP BY 1)
  SELECT e.g, n_edges, coalesce(n_triangles, 0) AS n_triangles, coalesce(n_squares, 0) AS n_squares FROM (SELECT g, count(*) AS n_edges FROM s GROUP BY 1) e LEFT JOIN t USING (g) LEFT JOIN sq USING (g)""")
def motif_counts(spark, sf):
    edges = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.closed_walks(edges.select(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 12).alias("a"), (F.col("o_orderkey") % 12).alias("b")), "g", "a", "b")


@query("SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || '.' AS prompt FROM part")
def text_template(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.template("Part {name} of {brand}.", name=F.col("p_name"), brand=F.col("p_brand")).alias("prompt"))
