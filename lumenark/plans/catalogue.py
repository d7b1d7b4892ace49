"""Registered queries: each applies one operator to the bound tables; each has SQL for the other engine unless SQL cannot say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import library as LB
from ..functions import fingerprints as FP
from ..functions import parsing as P
from ..functions.backends import StubEmbedder
from ..operators import aggregates as A
from ..operators import albums as AL
from ..operators import browse as B
from ..operators import details as DT
from ..operators import duplicates as D
from ..operators import identity as I
from ..operators import online
from ..operators import vectors as V
from ..sources import media as M
from ..storage import saved
from ..streaming import ingest as S
from . import views as W

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a query under its function's name. The SQL may use the views of plans.views."""

    def add(f):
        _Q[f.__name__] = f
        if sql:
            text = sql.strip()
            for lead, made in (("WITH RECURSIVE ", "WITH RECURSIVE"), ("WITH ", "WITH"), ("", "WITH")):
                if text.startswith(lead):
                    _SQL[f.__name__] = f"{made} {W.CTE}{',' if lead else ''} {text[len(lead):]}"
                    break
        return f

    return add


_START, _END = datetime(1996, 1, 1), datetime(1998, 12, 31)
_RANGE = "taken_at >= TIMESTAMP '1996-01-01' AND taken_at <= TIMESTAMP '1998-12-31'"
_ANY = "(list_contains(people_ids, 3) OR list_contains(people_ids, 5) OR list_contains(people_ids, 7))"
_ISO = "strftime(taken_at, '%Y-%m-%d %H:%M:%S')"


def _iso(c: str = "taken_at"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse_page(spark, sf_dir)


# Filters, orders and pages.
@_query(f"SELECT image_id, {_ISO} AS taken_at, folder FROM images WHERE {_RANGE} AND {_ANY} ORDER BY images.taken_at DESC NULLS LAST, image_id DESC LIMIT 60")
def browse_page(spark, d):
    df = B.select(W.narrow(spark, d), B.Filters(start=_START, end=_END, people=(3, 5, 7)), W.faces(spark, d))
    return B.page(df, B.ordering("date_desc")).select("image_id", _iso(), "folder")


@_query(f"SELECT image_id FROM images WHERE {_RANGE}")
def filter_dates(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(start=_START, end=_END)).select("image_id")


@_query(f"SELECT image_id FROM images WHERE {_ANY}")
def filter_people_any(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(people=(3, 5, 7)), W.faces(spark, d)).select("image_id")


@_query("SELECT image_id FROM images WHERE list_contains(people_ids, 3) AND list_contains(people_ids, 5)")
def filter_people_all(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(people=(3, 5), people_mode="all"), W.faces(spark, d)).select("image_id")


@_query("SELECT image_id FROM images WHERE lat IS NOT NULL")
def filter_located(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(has_location=True)).select("image_id")


@_query("SELECT image_id FROM images WHERE ((lat - 10) * 111.32) * ((lat - 10) * 111.32) + ((lon - 20) * 111.32 * cos(radians(10.0))) * ((lon - 20) * 111.32 * cos(radians(10.0))) <= 1500.0 * 1500.0")
def filter_near(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(near=(10.0, 20.0), radius_km=1500.0)).select("image_id")


@_query("SELECT image_id, face_count FROM images WHERE face_count > 0")
def filter_has_faces(spark, d):
    return B.select(W.images(spark, d), B.Filters(has_faces=True)).select("image_id", "face_count")


@_query("SELECT image_id FROM images WHERE coalesce(media_type, 'image') <> 'video'")
def filter_media(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(media="image")).select("image_id")


@_query("SELECT image_id FROM images WHERE face_count > 0 AND len(people_ids) = 0")
def filter_untagged(spark, d):
    return B.select(W.images(spark, d), B.Filters(untagged=True)).select("image_id")


@_query("SELECT image_id FROM images WHERE lower(trim(camera)) = '1-urgent'")
def filter_camera(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(camera=" 1-URGENT ")).select("image_id")


@_query("SELECT image_id FROM images WHERE folder = '/lib/F' OR starts_with(folder, '/lib/F/')")
def filter_folder(spark, d):
    return B.select(W.narrow(spark, d), B.Filters(folder="\\lib\\F\\")).select("image_id")


@_query(f"SELECT image_id, {_ISO} AS taken_at FROM images WHERE {_RANGE} AND {_ANY} AND lat IS NOT NULL ORDER BY images.taken_at ASC NULLS LAST, image_id LIMIT 60 OFFSET 60")
def filter_combined_page2(spark, d):
    df = B.select(W.narrow(spark, d), B.Filters(start=_START, end=_END, people=(3, 5, 7), has_location=True), W.faces(spark, d))
    return B.page(df, B.ordering("date_asc"), 2).select("image_id", _iso())


@_query(f"SELECT image_id, {_ISO} AS taken_at FROM narrow ORDER BY narrow.taken_at DESC NULLS LAST, image_id DESC LIMIT 200 OFFSET 14000")
def sort_date_desc_tail(spark, d):
    return B.page(W.narrow(spark, d), B.ordering("date_desc"), 71, 500).select("image_id", _iso())


@_query("SELECT image_id FROM narrow ORDER BY added_at DESC, image_id DESC LIMIT 60")
def sort_added(spark, d):
    return B.page(W.narrow(spark, d), B.ordering("added_desc")).select("image_id")


@_query()
def sort_random(spark, d):
    return B.page(W.narrow(spark, d), B.ordering("random", 7)).select("image_id")


@_query("SELECT x.pos AS pos, narrow.image_id, folder FROM (VALUES (96, 0), (1, 1), (7, 2), (34, 3)) x(id, pos) JOIN narrow ON narrow.image_id = x.id")
def hydrate(spark, d):
    return B.hydrate(spark, W.narrow(spark, d), [96, 1, 7, 34, -5], ["image_id", "folder"]).select("pos", "image_id", "folder")


@_query("SELECT image_id, path, regexp_extract(path, '([^/]*)$', 1) AS filename, folder, strftime(taken_at, '%Y-%m-%dT%H:%M:%S') AS taken_at, round(lat, 6) AS lat, round(lon, 6) AS lon, camera, people_ids, face_count, coalesce(media_type, 'image') AS media_type FROM images")
def list_cards(spark, d):
    df = W.images(spark, d).withColumns({"filename": F.lit(None).cast("string"), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})
    return B.card(df).drop("width", "height")


# Aggregates.
@_query("SELECT strftime(taken_at, '%Y-%m') AS month, count(*) AS n FROM narrow WHERE taken_at IS NOT NULL GROUP BY 1")
def month_histogram(spark, d):
    return B.month_histogram(W.narrow(spark, d))


@_query("SELECT folder, count(*) AS n FROM narrow GROUP BY folder")
def folder_counts(spark, d):
    return A.folder_counts(W.narrow(spark, d))


@_query("SELECT camera, count(*) AS n FROM narrow WHERE camera <> '' GROUP BY camera")
def camera_counts(spark, d):
    return A.camera_counts(W.narrow(spark, d))


@_query("SELECT person_id, count(*) AS photos FROM (SELECT unnest(people_ids) AS person_id FROM images) GROUP BY person_id")
def photos_per_person(spark, d):
    return A.photos_per_person(W.images(spark, d))


@_query("WITH c AS (SELECT person_id, count(*) AS photos FROM (SELECT unnest(people_ids) AS person_id FROM images) GROUP BY person_id) SELECT people.person_id, name, coalesce(photos, 0) AS photos FROM people LEFT JOIN c USING (person_id) WHERE NOT hidden AND trim(name) <> ''")
def people_listing(spark, d):
    return A.people_listing(W.people(spark, d), A.photos_per_person(W.images(spark, d)), named_only=True).select("person_id", "name", "photos")


@_query("""SELECT count(*) AS total_images, count(*) FILTER (WHERE taken_at IS NULL) AS undated, count(*) FILTER (WHERE lat IS NOT NULL) AS with_location, count(*) FILTER (WHERE face_count > 0) AS with_faces,
 count(*) FILTER (WHERE media_type = 'video') AS videos, CAST(sum(file_size) AS BIGINT) AS bytes, (SELECT count(*) FROM faces) AS total_faces, (SELECT count(*) FROM faces WHERE person_id < 0) AS unassigned_faces,
 (SELECT count(*) FROM faces WHERE confirmed) AS confirmed_faces, (SELECT count(DISTINCT p) FROM (SELECT unnest(people_ids) AS p FROM images) x JOIN people ON p = person_id WHERE NOT hidden) AS total_people FROM images""")
def library_stats(spark, d):
    return A.library_stats(W.images(spark, d), W.faces(spark, d), W.people(spark, d)).drop("first_taken", "last_taken")


@_query("SELECT count(*) AS scanned, count(*) FILTER (WHERE text <> '') AS with_text, (SELECT count(*) FROM narrow) AS total FROM ocr")
def ocr_coverage(spark, d):
    return A.ocr_coverage(W.ocr(spark, d), W.narrow(spark, d))


@_query("SELECT root, count(image_id) AS n FROM (VALUES ('/lib'), ('/lib/F'), ('/lib/O/1'), ('/none')) r(root) LEFT JOIN narrow ON folder = root OR starts_with(folder, root || '/') GROUP BY root")
def root_counts(spark, d):
    return A.root_counts(W.narrow(spark, d), spark.createDataFrame([("/lib",), ("/lib/F",), ("/lib/O/1",), ("/none",)], "root string"))


@_query("SELECT albums.album_id, name, count(image_id) AS n, (array_agg(image_id ORDER BY added_at, image_id))[1] AS cover FROM albums LEFT JOIN album_items USING (album_id) GROUP BY ALL")
def album_listing(spark, d):
    return A.album_listing(W.albums(spark, d), W.album_items(spark, d))


@_query("SELECT substr(sha256(text), 1, 32) AS content_hash, list_sort(list(doc_id)) AS ids, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), P.content_key(F.col("text")).alias("content_hash"))
    return A.exact_duplicates(docs)


@_query("WITH g AS (SELECT list_sort(list(struct_pack(s := -n_chars, i := doc_id))) AS l, min(doc_id) AS group_id, list_sort(list(doc_id)) AS ids FROM documents GROUP BY lang, source HAVING count(*) > 1) SELECT group_id, l[1].i AS keep, list_filter(ids, lambda x: x <> l[1].i) AS losers FROM g")
def keep_largest(spark, d):
    docs = W.table(spark, d, "documents")
    groups = docs.groupBy("lang", "source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids")).where(F.size("ids") > 1)
    return A.keep_largest(groups, docs.select(F.col("doc_id").alias("image_id"), F.col("n_chars").alias("file_size")))


@_query("SELECT DISTINCT p AS person_id FROM (SELECT unnest(people_ids) AS p FROM images)")
def people_in_images(spark, d):
    df = W.images(spark, d)
    return A.people_in_images(df, df.select("image_id"))


@_query("SELECT image_id, people_ids FROM images")
def denormalised_people(spark, d):
    return I.denormalised(W.narrow(spark, d).withColumn("people_ids", F.array().cast("array<int>")), W.faces(spark, d)).select("image_id", "people_ids")


# Joins.
@_query("SELECT narrow.image_id, text FROM narrow LEFT JOIN ocr USING (image_id)")
def attach_text(spark, d):
    return B.attach_text(W.narrow(spark, d), W.ocr(spark, d)).select("image_id", "text")


@_query("SELECT image_id FROM narrow WHERE image_id NOT IN (SELECT image_id FROM ocr)")
def ocr_backfill(spark, d):
    return S.ocr_todo(W.narrow(spark, d), W.ocr(spark, d)).select("image_id")


@_query("SELECT image_id FROM ocr WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')")
def text_match(spark, d):
    return B.text_match(W.ocr(spark, d), "The a AND").select("image_id")


@_query("SELECT i.image_id, strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS taken_at FROM album_items i JOIN narrow USING (image_id) WHERE album_id = 7")
def album_images(spark, d):
    return AL.album_images(W.album_items(spark, d), W.narrow(spark, d), 7).select("image_id", _iso())


@_query("SELECT image_id FROM narrow WHERE image_id % 50 = 0 AND image_id NOT IN (SELECT image_id FROM album_items WHERE album_id = 7)")
def album_add(spark, d):
    wanted = W.narrow(spark, d).where("image_id % 50 = 0").select("image_id")
    return AL.new_items(wanted.unionByName(wanted), W.album_items(spark, d), W.narrow(spark, d), 7)


@_query("""SELECT coalesce(a.url, b.url) AS path, CASE WHEN b.url IS NULL THEN 'new' WHEN a.url IS NULL THEN 'missing' WHEN a.size <> b.size OR abs(a.m - b.m) > 1.0 THEN 'changed' ELSE 'same' END AS status
 FROM (SELECT url, max(length(html)) AS size, CAST(min(page_id) AS DOUBLE) AS m FROM pages WHERE page_id % 7 <> 0 GROUP BY url) a FULL JOIN
 (SELECT url, max(length(html)) + CASE WHEN min(page_id) % 5 = 0 THEN 1 ELSE 0 END AS size, min(page_id) + CASE WHEN min(page_id) % 3 = 0 THEN 2.0 ELSE 0.5 END AS m FROM pages WHERE page_id % 11 <> 0 GROUP BY url) b ON a.url = b.url""")
def file_changes(spark, d):
    pages = W.table(spark, d, "pages").select(F.col("url").alias("path"), "page_id", F.length("html").alias("size"))
    p = F.min("page_id")
    found = pages.where("page_id % 7 <> 0").groupBy("path").agg(F.max("size").alias("file_size"), p.cast("double").alias("mtime"))
    known = pages.where("page_id % 11 <> 0").groupBy("path").agg((F.max("size") + F.when(p % 5 == 0, 1).otherwise(0)).alias("file_size"), (p + F.when(p % 3 == 0, 2.0).otherwise(0.5)).alias("mtime"), p.alias("image_id"))
    return M.changes(found, known).select("path", "status")


@_query("WITH h AS (SELECT image_id, 'h' || CAST(file_size % 4000 AS STRING) AS content_hash, people_ids FROM images), e AS (SELECT content_hash, unnest(people_ids) AS person_id FROM h) SELECT p.person_id, any_value(name) AS name, list_sort(list(DISTINCT content_hash)) AS hashes FROM people p JOIN e USING (person_id) WHERE trim(name) <> '' OR hidden GROUP BY p.person_id")
def curation_export(spark, d):
    df = W.images(spark, d).withColumn("content_hash", F.concat(F.lit("h"), (F.col("file_size") % 4000).cast("string")))
    return AL.export_curation(df, W.people(spark, d), W.albums(spark, d), W.album_items(spark, d))[0].select("person_id", "name", "hashes")


@_query("WITH h AS (SELECT 'h' || CAST(file_size % 4000 AS STRING) AS c, people_ids FROM images), e AS (SELECT DISTINCT c, unnest(people_ids) AS p FROM h) SELECT a.p AS backup_id, b.p AS person_id, count(*) AS shared FROM e a JOIN e b USING (c) WHERE a.p IN (SELECT person_id FROM people WHERE trim(name) <> '' OR hidden) GROUP BY ALL")
def curation_overlap(spark, d):
    df = W.images(spark, d).withColumn("content_hash", F.concat(F.lit("h"), (F.col("file_size") % 4000).cast("string")))
    df = saved(spark, df.select("image_id", "content_hash", "people_ids"), "images")  # read by the backup and by what meets it
    who, _ = AL.export_curation(df, W.people(spark, d), W.albums(spark, d), W.album_items(spark, d))
    return AL.overlap(who, df)


_KEYED = "h AS (SELECT image_id, 'h' || CAST(file_size AS STRING) AS c, people_ids FROM images), e AS (SELECT c, image_id, unnest(people_ids) AS p FROM h)"


def _curation(spark, d):
    df = W.images(spark, d).withColumn("content_hash", F.concat(F.lit("h"), F.col("file_size").cast("string")))
    return df, *AL.export_curation(df, W.people(spark, d), W.albums(spark, d), W.album_items(spark, d))


@_query(f"""WITH {_KEYED}, st AS (SELECT DISTINCT p AS b, c FROM e WHERE p IN (SELECT person_id FROM people WHERE trim(name) <> '' OR hidden)), w AS (SELECT DISTINCT b, image_id FROM st JOIN h USING (c)), t AS (SELECT b, count(*) AS wanted FROM w GROUP BY b)
 SELECT w.b AS backup_id, e.p AS person_id, count(*) AS shared, t.wanted AS wanted FROM w JOIN e ON w.image_id = e.image_id JOIN t ON t.b = w.b GROUP BY ALL HAVING count(*) * 2 >= t.wanted""")
def curation_claims(spark, d):
    df, who, _ = _curation(spark, d)
    return AL.claims(who, df)


@_query(f"WITH {_KEYED}, st AS (SELECT DISTINCT album_id, c FROM album_items JOIN h USING (image_id)) SELECT DISTINCT album_id, image_id FROM st JOIN h USING (c)")
def album_restore(spark, d):
    df, _, what = _curation(spark, d)
    return AL.photos_of(what, df, "album_id")


@_query("SELECT image_id, path, '/out/' || regexp_replace(n, '[.][^.]*$', '') || CASE WHEN r > 1 THEN ' (' || CAST(r AS STRING) || ')' ELSE '' END || '.jpg' AS target FROM (SELECT image_id, path, n, row_number() OVER (PARTITION BY lower(n) ORDER BY image_id) AS r FROM (SELECT image_id, folder || '.jpg' AS path, regexp_extract(folder || '.jpg', '([^/]*)$', 1) AS n FROM narrow))")
def export_names(spark, d):
    return AL.export_names(W.narrow(spark, d).withColumn("path", F.concat("folder", F.lit(".jpg"))), "/out/")


# Faces and people.
@_query("SELECT image_id, part, round(quality, 4) AS quality FROM faces WHERE person_id = -1 AND quality >= 0.3 ORDER BY faces.quality DESC, image_id, part LIMIT 60")
def unassigned_faces(spark, d):
    df = W.faces(spark, d).withColumn("face_id", F.col("image_id") * 100000 + F.col("part"))
    return I.best_faces(df, None, 60, 0.3).select("image_id", "part", F.round("quality", 4).alias("quality"))


@_query("SELECT person_id, image_id, part, rank FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY quality DESC, image_id * 100000 + part) AS rank FROM (SELECT DISTINCT person_id, image_id, part, quality FROM faces WHERE person_id >= 0)) WHERE rank <= 6")
def person_exemplars(spark, d):
    df = W.faces(spark, d).select("person_id", "image_id", "part", "quality").distinct().withColumn("face_id", F.col("image_id") * 100000 + F.col("part"))
    return I.exemplars(df).select("person_id", "image_id", "part", F.col("rank").cast("bigint").alias("rank"))


@_query("SELECT image_id, f.person_id, name, min(part) AS first_face FROM faces f JOIN people p ON f.person_id = p.person_id GROUP BY ALL")
def people_on_images(spark, d):
    return DT.people_on_images(W.faces(spark, d), W.people(spark, d), "part")


_UNIT = "list_transform(CAST(vector AS DOUBLE[]), lambda x: x / greatest(sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 1e-12))"
_Q5 = "(SELECT CAST(vector AS DOUBLE[]) FROM vectors WHERE image_id = 5)"
_SIM = f"round(list_inner_product(CAST(vector AS DOUBLE[]), {_Q5}) / (greatest(sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))), 1e-12) * greatest(sqrt(list_inner_product({_Q5}, {_Q5})), 1e-12)), 12)"


@_query(f"SELECT image_id, round(s, 4) AS score FROM (SELECT image_id, {_SIM} AS s FROM vectors WHERE image_id <> 5) ORDER BY s DESC, image_id LIMIT 24")
def similar_images(spark, d):
    return V.shown(V.similar(W.vectors(spark, d), 5))


@_query(f"SELECT image_id, round(s, 4) AS score FROM (SELECT image_id, {_SIM} AS s FROM vectors WHERE label % 2 = 0) WHERE s >= 0.1 ORDER BY s DESC, image_id LIMIT 40")
def vector_top_k(spark, d):
    df = W.vectors(spark, d)
    q = df.where("image_id = 5").select("vector").head()[0]
    return V.shown(V.top_k(df, list(q), 40, allowed=F.col("label") % 2 == 0, min_score=0.1))


@_query(f"SELECT image_id, list_transform({_UNIT}, lambda x: round(x, 6)) AS v FROM vectors")
def normalised_vectors(spark, d):
    return W.vectors(spark, d).select("image_id", F.transform(V.normalize(F.col("vector")), lambda x: V.rounded(x, 6)).alias("v"))


@_query("WITH e AS (SELECT label, image_id, greatest((image_id % 10) / 10.0, 0.001) AS w, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM vectors), m AS (SELECT label, pos, sum(CAST(v AS DOUBLE) * w) / sum(w) AS v FROM e GROUP BY label, pos), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY label) SELECT label, pos, round(v / n, 4) AS v FROM m JOIN n USING (label)")
def centroids(spark, d):
    df = W.vectors(spark, d).withColumns({"face_id": F.col("image_id"), "quality": (F.col("image_id") % 10) / 10.0})
    got = A.centroids(df, "label")
    return got.select("label", F.posexplode("centroid").alias("p", "x")).select("label", (F.col("p") + 1).cast("bigint").alias("pos"), F.round("x", 4).alias("v"))


_PAIRS = "sims AS (SELECT a.image_id AS a, b.image_id AS b, round(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.vector AS DOUBLE[]), CAST(a.vector AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])))), 12) AS score FROM vectors a JOIN vectors b ON a.image_id <> b.image_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM sims WHERE score >= 0.42), near AS (SELECT a, b, score FROM ranked WHERE r <= 20)"


@_query(f"WITH {_PAIRS} SELECT a, b, round(score, 4) AS score FROM near")
def knn_edges(spark, d):
    return V.shown(V.knn(W.vectors(spark, d)))


@_query(f"WITH {_PAIRS} SELECT x.a, x.b, round(x.score, 4) AS score FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def mutual_knn(spark, d):
    return V.shown(V.mutual(V.knn(W.vectors(spark, d))))


@_query(f"WITH RECURSIVE {_PAIRS}, edge AS (SELECT x.a, x.b FROM near x JOIN near y ON x.a = y.b AND x.b = y.a), reach(n, m) AS (SELECT image_id, image_id FROM vectors UNION SELECT r.n, e.b FROM reach r JOIN edge e ON r.m = e.a) SELECT n AS image_id, min(m) AS label FROM reach GROUP BY n")
def face_clusters(spark, d):
    return I.mutual_knn_clusters(W.vectors(spark, d), id_="image_id")


@_query(f"""WITH {_PAIRS}, named AS (SELECT image_id AS id, image_id % 3 <> 0 AS named, image_id % 4 AS photos FROM vectors),
 sides AS (SELECT 10000 + a AS i, a AS p FROM sims WHERE a < b AND (a + b) % 4 = 1 UNION SELECT 10000 + a, b FROM sims WHERE a < b AND (a + b) % 4 = 1),
 photos AS (SELECT p, count(DISTINCT i) AS n FROM sides GROUP BY p),
 k AS (SELECT id, named, coalesce(n, 0) AS n FROM named LEFT JOIN photos ON p = id),
 p AS (SELECT a, b, score FROM sims WHERE a < b AND score >= 0.42 AND (a + b) % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM sides x JOIN sides y ON x.i = y.i WHERE x.p = sims.a AND y.p = sims.b))
 SELECT CASE WHEN x.named > y.named OR x.named = y.named AND x.n >= y.n THEN b ELSE a END AS source_id, CASE WHEN x.named > y.named OR x.named = y.named AND x.n >= y.n THEN a ELSE b END AS target_id, round(p.score, 4) AS score
 FROM p JOIN k x ON x.id = a JOIN k y ON y.id = b ORDER BY p.score DESC, source_id, target_id LIMIT 20""")
def merge_suggestions(spark, d):
    v = W.vectors(spark, d)
    people = v.select(F.col("image_id").cast("int").alias("person_id"), F.when(F.col("image_id") % 3 != 0, F.lit("x")).otherwise("").alias("name"), F.lit(False).alias("hidden"), F.col("vector").alias("centroid"))
    # Photos that hold a person and all later ones with which the sum of ids leaves 1 when divided by 4; a row a photo and person, as their number grows with the square of the ids.
    ids = v.select(F.col("image_id").cast("int").alias("p"))
    first = ids.withColumn("r", F.pmod(F.lit(1) - F.col("p"), F.lit(4))).repartition(spark.sparkContext.defaultParallelism * 4)
    later = ids.select(F.col("p").alias("b"), F.pmod("p", F.lit(4)).alias("r"))
    photo = (F.col("p") + 10000).cast("bigint").alias("image_id")
    own = first.join(F.broadcast(later.groupBy("r").agg(F.max("b").alias("b"))), "r").where("p < b").select(photo, F.array("p").alias("people_ids"))
    photos = own.unionByName(first.join(F.broadcast(later), "r").where("p < b").select(photo, F.array("b").alias("people_ids")))
    # Dismissed are all pairs with sums of ids divisible by 5, near or not; they are made only where candidates are looked up.
    left = v.select(F.col("image_id").alias("a"), F.pmod(-F.col("image_id"), F.lit(5)).alias("r")).repartition(spark.sparkContext.defaultParallelism * 4)
    right = v.select(F.col("image_id").alias("b"), F.pmod("image_id", F.lit(5)).alias("r"))
    dismissed = left.join(F.broadcast(right), "r").where("a < b").select("a", "b")
    return I.merge_suggestions(people, photos, dismissed=dismissed)


@_query("WITH m AS (SELECT a.image_id AS a, a.vector AS v FROM vectors a WHERE a.image_id < 30), e AS (SELECT unnest(v) AS v, generate_subscripts(v, 1) AS pos FROM m), q AS (SELECT list(x ORDER BY pos) AS q FROM (SELECT pos, avg(CAST(v AS DOUBLE)) AS x FROM e GROUP BY pos)) SELECT image_id, round(s, 4) AS score FROM (SELECT image_id, round(list_inner_product(CAST(vector AS DOUBLE[]), q) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])))), 12) AS s FROM vectors, q WHERE image_id >= 30) ORDER BY s DESC, image_id LIMIT 24")
def album_suggestions(spark, d):
    v = W.vectors(spark, d).withColumn("taken_at", F.lit(None).cast("timestamp_ntz"))
    items = v.where("image_id < 30").select(F.lit(1).alias("album_id"), "image_id", F.lit(None).cast("timestamp_ntz").alias("added_at"))
    return V.shown(AL.album_suggestions(items, v, 1))


@_query(f"WITH t AS (SELECT image_id FROM ocr WHERE contains(lower(text), 'thing')), s AS (SELECT image_id, {_SIM} AS score FROM vectors ORDER BY score DESC, image_id LIMIT 100) SELECT image_id, 0 AS tier, CAST(NULL AS DOUBLE) AS score, TRUE AS text_match FROM t UNION ALL SELECT image_id, 1, round(score, 4), FALSE FROM s WHERE image_id NOT IN (SELECT image_id FROM t)")
def hybrid_search(spark, d):
    v = W.vectors(spark, d)
    q = v.where("image_id = 5").select("vector").head()[0]
    return V.shown(B.hybrid(B.text_match(W.ocr(spark, d), "thing"), V.top_k(v, list(q), 100)))


_HITS = f"""located AS (SELECT * FROM narrow WHERE lat IS NOT NULL), hits AS (SELECT image_id FROM ocr JOIN located USING (image_id) WHERE contains(lower(text), 'thing')),
 s AS (SELECT image_id, {_SIM} AS score FROM vectors JOIN located USING (image_id)), near AS (SELECT * FROM s WHERE score >= -0.05 ORDER BY score DESC, image_id LIMIT 100)"""


def _search(spark, d, sort):
    v = W.vectors(spark, d)
    q = v.where("image_id = 5").select("vector").head()[0]
    return B.search(W.narrow(spark, d), W.ocr(spark, d), "thing", v, list(q), B.Filters(has_location=True), sort, min_score=-0.05, candidates=100)[1]


@_query(f"WITH {_HITS} SELECT image_id, {_ISO} AS taken_at FROM narrow WHERE image_id IN (SELECT image_id FROM hits UNION SELECT image_id FROM near) ORDER BY narrow.taken_at DESC NULLS LAST, image_id DESC LIMIT 60")
def search_by_date(spark, d):
    return _search(spark, d, "date_desc").select("image_id", _iso())


@_query(f"WITH {_HITS}, u AS (SELECT image_id, 0 AS tier, CAST(NULL AS DOUBLE) AS score FROM hits UNION ALL SELECT image_id, 1, score FROM near WHERE image_id NOT IN (SELECT image_id FROM hits)) SELECT image_id, tier, round(score, 4) AS score, tier = 0 AS text_match FROM u JOIN narrow USING (image_id) ORDER BY tier, u.score DESC NULLS LAST, narrow.taken_at DESC NULLS LAST, image_id DESC LIMIT 60")
def search_relevance(spark, d):
    return _search(spark, d, "relevance").select("image_id", "tier", "score", "text_match")


@_query(f"SELECT image_id AS face_id, round(s, 4) AS score FROM (SELECT image_id, {_SIM} AS s FROM vectors WHERE label % 3 <> 0) WHERE s >= 0.3 ORDER BY s DESC, image_id LIMIT 60")
def face_search_unassigned(spark, d):
    v = W.vectors(spark, d)
    q = v.where("image_id = 5").select("vector").head()[0]
    faces = v.select(F.col("image_id").alias("face_id"), "vector", F.when(F.col("label") % 3 == 0, 1).otherwise(-1).alias("person_id"))
    return V.shown(I.face_search(faces, list(q), unassigned_only=True))


@_query(f"SELECT image_id AS face_id, round(s, 4) AS score FROM (SELECT image_id, {_SIM} AS s FROM vectors WHERE image_id <> 5) WHERE s >= 0.1 ORDER BY s DESC, image_id LIMIT 60")
def similar_faces(spark, d):
    faces = W.vectors(spark, d).select(F.col("image_id").alias("face_id"), "vector")
    return V.shown(V.similar(faces, 5, 60, "face_id", min_score=0.1))


@_query()
def text_query(spark, d):
    return V.shown(V.text_top_k(W.vectors(spark, d), StubEmbedder(64), "a word of the thing", 60))


@_query(f"SELECT image_id AS face_id, round(s, 4) AS score FROM (SELECT image_id, {_SIM} AS s FROM vectors WHERE label % 3 <> 0 AND image_id % 4 <> 0) WHERE s >= 0.38 ORDER BY s DESC, image_id LIMIT 60")
def person_face_suggestions(spark, d):
    v = W.vectors(spark, d)
    q = v.where("image_id = 5").select("vector").head()[0]
    faces = v.select(F.col("image_id").alias("face_id"), "vector", F.when(F.col("label") % 3 == 0, 1).otherwise(-1).alias("person_id"), (F.col("image_id") % 4 == 0).alias("confirmed"))
    return V.shown(I.person_suggestions(faces, list(q)))


# Hashes.
def _hashes(spark, d):
    """A 64-bit number per document that repeats and nearly repeats: length and id in bit fields."""
    docs = W.table(spark, d, "documents")
    h = F.shiftleft((F.col("n_chars") % 65536).cast("bigint"), 32).bitwiseOR(F.shiftleft((F.col("doc_id") % 40).cast("bigint"), 16)).bitwiseOR((F.col("doc_id") % 97).cast("bigint"))
    return docs.select(F.col("doc_id").alias("image_id"), h.alias("phash"))


_HASHES = "hashes AS (SELECT doc_id AS image_id, ((n_chars % 65536) << 32) | ((doc_id % 40) << 16) | (doc_id % 97) AS phash FROM documents)"


@_query(f"WITH {_HASHES}, k AS (SELECT image_id, phash, b, (phash >> (16 * b)) & 65535 AS key FROM hashes, (VALUES (0), (1), (2), (3)) x(b) WHERE phash <> 0), ok AS (SELECT b, key FROM k GROUP BY b, key HAVING count(*) BETWEEN 2 AND 512), s AS (SELECT k.* FROM k JOIN ok USING (b, key)) SELECT DISTINCT x.image_id AS a, y.image_id AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS distance FROM s x JOIN s y ON x.b = y.b AND x.key = y.key AND x.image_id < y.image_id WHERE bit_count(xor(x.phash, y.phash)) <= 6")
def near_duplicate_pairs(spark, d):
    return D.near_pairs(_hashes(spark, d))


@_query(f"WITH {_HASHES} SELECT x.image_id AS a, y.image_id AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS distance FROM hashes x JOIN hashes y ON x.image_id < y.image_id WHERE x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 3")
def near_duplicate_pairs_exact(spark, d):
    return D.exact_pairs(_hashes(spark, d), 3)


@_query(f"WITH RECURSIVE {_HASHES}, e AS (SELECT x.image_id AS a, y.image_id AS b FROM hashes x JOIN hashes y ON x.image_id <> y.image_id WHERE x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 2), reach(n, m) AS (SELECT image_id, image_id FROM hashes UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a), g AS (SELECT n, min(m) AS label FROM reach GROUP BY n) SELECT label AS group_id, list_sort(list(n)) AS ids, count(*) AS n FROM g GROUP BY label HAVING count(*) > 1")
def near_duplicate_groups(spark, d):
    return D.hash_groups(_hashes(spark, d), 2)


@_query(f"WITH RECURSIVE {_HASHES}, e AS (SELECT x.image_id AS a, y.image_id AS b FROM hashes x JOIN hashes y ON x.image_id <> y.image_id WHERE x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 2), reach(n, m) AS (SELECT image_id, image_id FROM hashes UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a), g AS (SELECT n, min(m) AS label FROM reach GROUP BY n), ex AS (SELECT list_sort(list(doc_id)) AS ids FROM documents GROUP BY sha256(text) HAVING count(*) > 1), mem AS (SELECT unnest(ids) AS i FROM ex) SELECT 'exact' AS kind, ids FROM ex UNION ALL SELECT 'near', list_sort(list(n)) FROM g WHERE n NOT IN (SELECT i FROM mem) GROUP BY label HAVING count(*) > 1")
def duplicates_listing(spark, d):
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), P.content_key(F.col("text")).alias("content_hash"))
    return D.duplicates(docs.join(_hashes(spark, d), "image_id"), 2, exact=True)


def _prints(spark, d):
    """Fingerprints of the texts of all documents."""
    return saved(spark, FP.text_prints(W.table(spark, d, "documents").withColumnRenamed("doc_id", "image_id"), "image_id", "text"), "prints")


_PRINTS = r"""words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents), bits AS (SELECT doc_id, i, count(*) AS n, count(*) FILTER (WHERE ((strpos('0123456789abcdef', substr(m, 17 + CAST(i // 4 AS INT), 1)) - 1) & (8 >> CAST(i % 4 AS INT))) <> 0) AS ones FROM (SELECT doc_id, md5(w) AS m FROM words), range(64) r(i) GROUP BY doc_id, i),
prints AS (SELECT doc_id AS image_id, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS phash FROM (SELECT doc_id, sum(CASE WHEN 2 * ones > n THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INT) ELSE 0 END)::HUGEINT AS s FROM bits GROUP BY doc_id))"""
_PRINT_EDGES = f"{_PRINTS}, h AS (SELECT DISTINCT phash FROM prints WHERE phash <> 0), e AS MATERIALIZED (SELECT x.phash AS a, y.phash AS b FROM h x JOIN h y ON x.phash <> y.phash AND bit_count(xor(x.phash, y.phash)) <= 6), reach(n, m) AS (SELECT phash, phash FROM h UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a), label AS (SELECT n AS phash, min(m) AS label FROM reach GROUP BY n), g AS (SELECT image_id, label FROM prints JOIN label USING (phash))"


@_query(f"WITH {_PRINTS} SELECT x.image_id AS a, y.image_id AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INT) AS distance FROM prints x JOIN prints y ON x.image_id < y.image_id WHERE x.phash <> 0 AND y.phash <> 0 AND bit_count(xor(x.phash, y.phash)) <= 6")
def near_duplicate_pairs_whole(spark, d):
    """At the operator's own distance, whatever the buckets hold."""
    return D.exact_pairs(_prints(spark, d))


@_query(f"WITH RECURSIVE {_PRINT_EDGES} SELECT min(image_id) AS group_id, list_sort(list(image_id)) AS ids, count(*) AS n FROM g GROUP BY label HAVING count(*) > 1")
def near_duplicate_groups_whole(spark, d):
    return D.hash_groups(_prints(spark, d))


@_query(f"WITH RECURSIVE {_PRINT_EDGES}, ex AS (SELECT list_sort(list(doc_id)) AS ids FROM documents GROUP BY sha256(text) HAVING count(*) > 1), mem AS (SELECT unnest(ids) AS i FROM ex) SELECT 'exact' AS kind, ids FROM ex UNION ALL SELECT 'near', list_sort(list(image_id)) FROM g WHERE image_id NOT IN (SELECT i FROM mem) GROUP BY label HAVING count(*) > 1")
def duplicates_listing_whole(spark, d):
    """Exact groups, then near groups at the operator's own distance."""
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), "text", P.content_key(F.col("text")).alias("content_hash"))
    return D.duplicates(FP.text_prints(docs, "image_id", "text", ["content_hash"]), exact=True)


# Mutations, as the next version of a table.
@_query("SELECT image_id FROM narrow WHERE image_id NOT IN (SELECT image_id FROM narrow WHERE folder = '/lib/F/1' OR starts_with(folder, '/lib/F/1/'))")
def delete_images(spark, d):
    df = W.narrow(spark, d)
    return LB.without(df, B.select(df, B.Filters(folder="/lib/F/1")), "image_id").select("image_id")


@_query("SELECT image_id, part, CAST(CASE WHEN person_id = 3 THEN 5 ELSE person_id END AS INT) AS person_id FROM faces")
def merge_people(spark, d):
    return I.merged(W.faces(spark, d), 3, 5).select("image_id", "part", "person_id")


# Scalar functions.
@_query("SELECT a.image_id, CAST(bit_count(xor(a.phash, -6172840429334713785)) AS INT) AS distance, CAST((a.phash >> 16) & 65535 AS BIGINT) AS band1 FROM hashes a".replace("SELECT", f"WITH {_HASHES} SELECT", 1))
def hash_functions(spark, d):
    return _hashes(spark, d).select("image_id", D.hamming(F.col("phash"), F.lit(-6172840429334713785)).alias("distance"), D.band(F.col("phash"), 1).cast("bigint").alias("band1"))


@_query("SELECT image_id, strftime(o, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(o, '%Y-%m-%d %H:%M:%S') AS named FROM (SELECT image_id, CASE WHEN year(added_at) BETWEEN 1900 AND 2100 THEN added_at END AS o FROM narrow)")
def date_functions(spark, d):
    df = W.narrow(spark, d)
    exif, name = F.date_format("added_at", "yyyy:MM:dd HH:mm:ss"), F.concat(F.lit("IMG_"), F.date_format("added_at", "yyyyMMdd_HHmmss"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return df.select("image_id", show(P.exif_date(exif)).alias("parsed"), show(P.filename_date(name)).alias("named"))


@_query("SELECT image_id, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (abs(lat) < 1e-7 AND abs(lon) < 1e-7), FALSE) AS valid, round(-(image_id % 90 + 30 / 60.0 + 36 / 3600.0), 6) AS south FROM narrow")
def coordinate_functions(spark, d):
    return W.narrow(spark, d).select("image_id", P.valid_coordinates(F.col("lat"), F.col("lon")).alias("valid"), P.dms(F.col("image_id") % 90, F.lit(30.0), F.lit(36.0), F.lit("s")).alias("south"))


@_query("SELECT c_custkey AS id, CASE WHEN contains(lower(c_name), lower(trim(substr(c_name, 1, 8)))) THEN trim(c_name) END AS same, trim(c_mktsegment) || ' ' || trim(c_name) AS joined FROM customer")
def camera_function(spark, d):
    c = W.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), P.camera(F.substring("c_name", 1, 8), F.col("c_name")).alias("same"), P.camera(F.col("c_mktsegment"), F.col("c_name")).alias("joined"))


@_query("SELECT doc_id, list_count(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_words FROM documents")
def word_function(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.size(P.words(F.col("text"))).cast("bigint").alias("n_words"))


@_query("SELECT path, lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) = 'jpg' AS supported, FALSE AS video FROM narrow")
def supported_files(spark, d):
    return W.narrow(spark, d).select("path", M.is_supported(F.col("path")).alias("supported"), M.is_video(F.col("path")).alias("video"))


# Events.
@_query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    df = S.event_windows(W.table(spark, d, "events"))
    return df.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@_query()
def online_people(spark, d):
    v = W.vectors(spark, d).select(F.col("image_id"), F.col("image_id").alias("face_id"), "vector", F.lit(0.8).alias("quality"), F.lit(0.9).alias("det_score"))
    none = spark.range(0).select(F.col("id").cast("int").alias("person_id"), F.array().cast("array<float>").alias("centroid"), F.lit(0).alias("face_count"), F.lit(-1).cast("bigint").alias("cover_face_id"))
    return online.assign_online(v, none)


@_query()
def cell_search(spark, d):
    df = W.vectors(spark, d)
    index, asked = V.CellIndex(spark, df), df.where("image_id % 50 = 0")
    return V.shown(index.search_all(asked, 20, index.probes_for(asked, 20)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
