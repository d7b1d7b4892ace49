"""The driver's tables seen as a media library. The same SQL runs in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGES_NARROW = """SELECT o_orderkey AS image_id, '/lib/' || o_orderstatus || '/' || CAST(o_custkey % 50 AS STRING) || '/' || CAST(o_orderkey AS STRING) || '.jpg' AS path,
 '/lib/' || o_orderstatus || '/' || CAST(o_custkey % 50 AS STRING) AS folder,
 CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderdate END AS taken_at, o_orderdate AS added_at, o_orderpriority AS camera,
 CAST(floor(o_totalprice) AS BIGINT) AS file_size,
 CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE CAST((o_custkey % 120) - 60 AS DOUBLE) END AS lat,
 CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE CAST((o_orderkey % 360) - 180 AS DOUBLE) END AS lon,
 CASE WHEN o_orderkey % 7 = 0 THEN 'video' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'image' END AS media_type
FROM orders"""
FACES = """SELECT l_orderkey AS image_id, CAST(CASE WHEN l_partkey % 10 = 0 THEN -1 ELSE l_suppkey END AS INT) AS person_id, l_quantity / 50 AS quality,
 l_linestatus = 'F' AS confirmed, l_partkey AS part FROM lineitem"""
PEOPLE = """SELECT CAST(s_suppkey AS INT) AS person_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS name, s_acctbal < 0 AS hidden FROM supplier"""
ALBUMS = "SELECT CAST(c_custkey AS INT) AS album_id, c_name AS name, CAST(-1 AS BIGINT) AS cover_image_id FROM customer"
ALBUM_ITEMS = "SELECT CAST(o_custkey AS INT) AS album_id, o_orderkey AS image_id, o_orderdate AS added_at FROM orders"
OCR = "SELECT doc_id AS image_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS text FROM documents"
VECTORS = "SELECT vec_id AS image_id, embedding AS vector, label FROM embeddings"

#: Common table expressions for the other engine; people lists come from faces.
CTE = f"""faces AS ({FACES}), narrow AS ({IMAGES_NARROW}),
lists AS (SELECT image_id, list_sort(list(DISTINCT person_id) FILTER (WHERE person_id >= 0)) AS people_ids, CAST(count(*) AS INT) AS face_count FROM faces GROUP BY image_id),
images AS (SELECT narrow.*, coalesce(lists.people_ids, CAST([] AS INT[])) AS people_ids, coalesce(lists.face_count, 0) AS face_count FROM narrow LEFT JOIN lists USING (image_id)),
people AS ({PEOPLE}), albums AS ({ALBUMS}), album_items AS ({ALBUM_ITEMS}), ocr AS ({OCR}), vectors AS ({VECTORS})"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bound(spark: SparkSession, sf_dir: str, base: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {base}", "FROM {t}"), t=table(spark, sf_dir, base))


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without people: no join."""
    return _bound(spark, sf_dir, "orders", IMAGES_NARROW)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "lineitem", FACES)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ..operators.identity import people_of_images

    lists = people_of_images(faces(spark, sf_dir))
    out = narrow(spark, sf_dir).join(lists, "image_id", "left")
    return out.withColumns({"people_ids": F.coalesce("people_ids", F.array().cast("array<int>")), "face_count": F.coalesce("face_count", F.lit(0))})


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "supplier", PEOPLE)


def albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "customer", ALBUMS)


def album_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "orders", ALBUM_ITEMS)


def ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "documents", OCR)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, "embeddings", VECTORS)
