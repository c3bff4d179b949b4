"""The TPC-H-like test tables in the shapes of a run: detections, truth, phases, tracks, belt map.

CTES says the same in SQL that DuckDB reads; every oracle query starts with it.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERIOD, VELOCITY, HEIGHT, WIDTH = 14723.0, 59.25, 480, 620


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_index"), number.alias("label"),
        F.expr("(l_partkey*7+l_linenumber*131)%460").alias("bbox_top"),
        F.expr("(l_partkey*11+l_suppkey*3)%600").alias("bbox_left"),
        F.expr("(l_partkey*7+l_linenumber*131)%460+2+l_partkey%14").alias("bbox_bottom"),
        F.expr("(l_partkey*11+l_suppkey*3)%600+2+l_suppkey%17").alias("bbox_right"),
        F.expr("l_extendedprice/5e3").alias("peak_signal"), F.expr("l_discount*1e1").alias("overlap"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).where("label % 4 <> 0")
    return d.selectExpr(
        "frame_index", "label as truth_id", "bbox_top+label%3-1 as t_top", "bbox_left+label%2 as t_left",
        "bbox_bottom+label%3-1 as t_bottom", "bbox_right+label%2 as t_right",
    )


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as frame_index", "pmod(-59.25e0*o_orderkey, 14723e0) as predicted_phase_px",
        "(o_custkey%33-16)*0.5e0 as correction_px", "((o_orderkey*37)%100)/1e2 as score",
        "cast(floor(59.25e0*o_orderkey/14723e0) as bigint) as revolution",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as track_id",
        "cast(floor(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)/600) as bigint) as frame_index",
        "value as y", "cast(get_json_object(props,'$.k') as double) as x",
    )


def belt_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return m.selectExpr("vec_id as belt_row", "cast(p as bigint) as x", "cast(v as double) as v")


CTES = """
WITH detections AS (
  SELECT l_orderkey AS frame_index,
    CAST(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS label,
    (l_partkey*7+l_linenumber*131)%460 AS bbox_top, (l_partkey*11+l_suppkey*3)%600 AS bbox_left,
    (l_partkey*7+l_linenumber*131)%460+2+l_partkey%14 AS bbox_bottom,
    (l_partkey*11+l_suppkey*3)%600+2+l_suppkey%17 AS bbox_right,
    l_extendedprice/5e3 AS peak_signal, l_discount*1e1 AS overlap FROM lineitem
), truth AS (
  SELECT frame_index, label AS truth_id, bbox_top+label%3-1 AS t_top, bbox_left+label%2 AS t_left,
    bbox_bottom+label%3-1 AS t_bottom, bbox_right+label%2 AS t_right FROM detections WHERE label % 4 <> 0
), phases AS (
  SELECT o_orderkey AS frame_index, ((-59.25e0*o_orderkey)%14723e0+14723e0)%14723e0 AS predicted_phase_px,
    (o_custkey%33-16)*0.5e0 AS correction_px, ((o_orderkey*37)%100)/1e2 AS score,
    CAST(floor(59.25e0*o_orderkey/14723e0) AS BIGINT) AS revolution FROM orders
), tracks AS (
  SELECT user_id AS track_id,
    CAST(floor(date_diff('second', timestamp '2024-01-01 00:00:00', ts)/600) AS BIGINT) AS frame_index,
    value AS y, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS x FROM events
), belt_map AS (
  SELECT vec_id AS belt_row, unnest(generate_series(0, len(embedding)-1)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings
), pairs AS (
  SELECT *, CASE WHEN u > 0 THEN i / u ELSE 0.0 END AS iou FROM (
    SELECT *, (bbox_bottom-bbox_top)*(bbox_right-bbox_left)+(t_bottom-t_top)*(t_right-t_left)-i AS u FROM (
      SELECT d.*, t.* EXCLUDE (frame_index),
        greatest(least(bbox_bottom,t_bottom)-greatest(bbox_top,t_top),0)
          * greatest(least(bbox_right,t_right)-greatest(bbox_left,t_left),0) AS i
      FROM detections d JOIN truth t USING (frame_index)))
), best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY frame_index, label ORDER BY iou DESC, truth_id) AS a,
      row_number() OVER (PARTITION BY frame_index, truth_id ORDER BY iou DESC, label) AS b
    FROM pairs WHERE iou >= 0.25e0) WHERE a = 1 AND b = 1
)
"""
