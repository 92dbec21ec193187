"""Work items of an export: projections, paths, statuses and texts of catalogs and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx

#: Types of documents that can be exported, and defaults of a listing. Fixed values.
SUPPORTED = ("Doc", "Sheet", "Table", "Board")
UNTITLED = "未命名文档"
#: Names of folders that stand for kinds of books. Fixed values.
SPACES = {"personal": "个人空间", "own": "我个人的", "collab": "邀请协作的", "public": "公共区", "team": "团队空间", "group": "团队"}
#: First segments of addresses that are no documents. Fixed values.
RESERVED_PATHS = r"(?i)^/(dashboard|settings|explore|notifications|search|login|register|account|new)"
#: What relative addresses in documents start from. Fixed value of the format.
HOME = "https://www.yuque.com"


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def listed_files(docs: DataFrame) -> DataFrame:
    """Rows of a listing (id, title, type, content_updated_at, updated_at) as files, with defaults, of supported types."""
    kind = F.coalesce(or_else(F.col("type")), F.lit("Doc"))
    return docs.where(kind.isin(*SUPPORTED)).select("id", F.coalesce(or_else(F.col("title")), F.lit(UNTITLED)).alias("title"), kind.alias("type"), or_else(F.col("content_updated_at"), F.col("updated_at")).alias("updated_at"))


def namespace(given: Column, logins: list[Column], slug: Column) -> Column:
    """The given namespace, else ``login/slug`` by the first login there is, else empty."""
    return F.coalesce(or_else(given), F.concat(or_else(*logins), F.lit("/"), or_else(slug)), F.lit(""))


def needs_permission(is_bookmark: Column, book_type: Column) -> Column:
    return F.coalesce(is_bookmark, F.lit(False)) | F.coalesce(book_type.isin("collab", "team", "org-personal", "wiki"), F.lit(False))


def book_folder(kind: Column, name: Column, org: Column, group: Column) -> Column:
    """Folder of a book by its type; names become safe path segments."""
    safe = tx.segment
    inside = safe(F.coalesce(or_else(org), F.lit(SPACES["team"])))
    folder = (
        F.when(kind == "personal", F.lit(f"{SPACES['personal']}/{SPACES['own']}/"))
        .when(kind == "collab", F.lit(f"{SPACES['personal']}/{SPACES['collab']}/"))
        .when(kind == "team", F.concat(inside, F.lit("/"), safe(F.coalesce(or_else(group), F.lit(SPACES["group"]))), F.lit("/")))
        .when(kind == "wiki", F.concat(inside, F.lit(f"/{SPACES['public']}/")))
        .when(kind == "org-personal", F.concat(inside, F.lit(f"/{SPACES['own']}/")))
        .otherwise(F.lit(""))
    )
    return F.concat(folder, safe(name))


def file_path(parts: list[Column], title: Column, extension: Column) -> Column:
    """Relative path of a file: the folders of ``parts`` that there are, and its safe title with the extension."""
    name = F.coalesce(or_else(tx.segment(F.coalesce(title, F.lit("")))), F.lit(UNTITLED))
    return F.concat_ws("/", *(or_else(tx.sanitize_segments(F.coalesce(p, F.lit("")))) for p in parts), F.concat(name, F.lit("."), extension))


def image_path(parts: list[Column], local_name: Column) -> Column:
    """Relative path of an image: its name stays as it is."""
    return F.concat_ws("/", *(or_else(tx.sanitize_segments(F.coalesce(p, F.lit("")))) for p in parts), or_else(local_name))


def display_path(parts: list[Column]) -> Column:
    return F.coalesce(or_else(F.concat_ws("/", *(or_else(p) for p in parts))), F.lit("-"))


def is_document_url(url: Column) -> Column:
    """Whether an address is that of a document: three path segments at least, none of the reserved sections."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return ~path.rlike(RESERVED_PATHS) & ~path.rlike("(?i)^/(api|r)/") & (F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 3)


def absolute_url(url: Column) -> Column:
    return F.when((url == "") | url.startswith("http"), url).otherwise(F.concat(F.lit(HOME), F.when(url.startswith("/"), "").otherwise("/"), url))


def without_watermark(url: Column) -> Column:
    return F.regexp_replace(url, "^(.*?)x-oss-process=image%2Fwatermark%2C[^&]*", "$1")


def url_summary(url: Column) -> Column:
    """Data addresses collapsed, long ones cut to 120 characters."""
    return F.when(url.startswith("data:"), "data:...").when(F.length(url) > 120, F.concat(F.substring(url, 1, 117), F.lit("..."))).otherwise(url)


def duration_text(ms: Column) -> Column:
    """``-``, milliseconds below a second, else seconds with two digits, halves up where the seconds are exact."""
    seconds = F.when(ms % 250 == 125, ms + 5).otherwise(ms) / 1000
    return F.when(F.coalesce(ms, F.lit(0)) <= 0, "-").when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(F.call_function("format_number", seconds, F.lit("0.00")), F.lit(" s")))


def day_text(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def svg_id(value: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` only, 80 characters at most, ``x`` for nothing."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(or_else(value), F.lit("x")), "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(or_else(F.substring(clean, 1, 80)), F.lit("x"))


def with_detail_first(rows: DataFrame, key: str, detail: str, order: str) -> DataFrame:
    """One row a key: the first that has a detail, else the first."""
    bare = F.coalesce(F.col(detail), F.lit("")) == ""
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(bare, F.col(order))).alias("r"))
    return picked.select("r.*")


def running_offsets(rows: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """``start`` of each row: the sizes of those before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def without_repeats(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col(f"_before.{value}").eqNullSafe(F.col(value))).drop("_before")


def view_columns(columns: DataFrame, view: DataFrame, include_hidden: Column) -> DataFrame:
    """Columns of a table as its view shows them: the view's in its order, hidden ones only if forced or
    included; if included, the others follow in their own order. columns: table_id, id, ord; view:
    table_id, id, pos, hidden, forced. A table without view columns shows all of its own."""
    shown = columns.join(view, ["table_id", "id"], "left")
    has_view = columns.select("table_id").distinct().join(view.select("table_id").distinct().withColumn("_has", F.lit(True)), "table_id", "left")
    shown = shown.join(has_view, "table_id").withColumn("_has", F.coalesce("_has", F.lit(False)))
    listed = F.col("pos").isNotNull() & (include_hidden | ~F.col("hidden") | F.col("forced"))
    kept = shown.where(~F.col("_has") | listed | (F.col("pos").isNull() & include_hidden))
    place = F.row_number().over(Window.partitionBy("table_id").orderBy(F.col("pos").isNull(), "pos", "ord"))
    return kept.select("table_id", "id", place.cast("long").alias("place"))


def points_inside(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """``box_id`` and the ``n`` points within each box (borders included). A box is spread over the cells
    of a grid that it touches and met by equality; points: x, y; boxes: box_id, x0, y0, x1, y1."""
    at = lambda c: F.floor(F.col(c) / cell)
    spread = boxes.select("*", F.explode(F.sequence(at("x0"), at("x1"))).alias("_gx")).select("*", F.explode(F.sequence(at("y0"), at("y1"))).alias("_gy"))
    placed = points.groupBy("x", "y").agg(F.count("*").alias("_n")).select("*", at("x").alias("_gx"), at("y").alias("_gy"))
    inside = spread.join(placed, ["_gx", "_gy"]).where("x between x0 and x1 and y between y0 and y1")
    return boxes.select("box_id").join(inside.groupBy("box_id").agg(F.sum("_n").alias("n")), "box_id", "left").select("box_id", F.coalesce("n", F.lit(0)).alias("n"))
