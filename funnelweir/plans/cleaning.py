"""Queries: sources, scalar functions, text and event tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from funnelweir.functions import scalars as S
from funnelweir.functions import text as T
from funnelweir.operators import describe as D
from funnelweir.operators import funnel as FN
from funnelweir.plans import tables as B
from funnelweir.plans.registry import query, sql_rounded
from funnelweir.sources import jsonl as J
from funnelweir.sources import tables as IO
from funnelweir.sources import workbook as WB

W = B.sql_with


def scratch(spark, name: str) -> str:
    """A fresh folder next to the checkpoints (shared on a cluster)."""
    from funnelweir.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    stamp = tempfile.mktemp(prefix="", dir="").strip("/")
    return f"{base}/{name}-{stamp}"


# ---- sources and sinks -------------------------------------------------------


@query(
    "S1_read_table",
    "SELECT p_type, COUNT(*) AS parts, CAST(SUM(p_size) AS BIGINT) AS sizes FROM part GROUP BY p_type",
)
def read_table(spark, d):
    part = IO.read_table(spark, f"{d}/part.csv", ["p_type", "p_size"])
    return part.groupBy("p_type").agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes"))


def exported_lines(df, folder: str, encoding: str) -> None:
    """One delimited file per partition of ``df``, in an encoding that Spark's writer does not offer."""
    names = df.columns

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        content = "\n".join([",".join(names), *(",".join("" if v is None else str(v) for v in r) for r in rows), ""])
        system, path = pafs.FileSystem.from_uri(folder)
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{uuid.uuid4().hex}.csv") as out:
            out.write(content.encode(encoding))
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    df.mapInArrow(run, "n long").collect()


@query(
    "S1_delimited_encodings",
    "SELECT e.encoding, '名称 ' || p_type AS name, COUNT(*) AS parts, CAST(SUM(p_size) AS BIGINT) AS sizes FROM part, (VALUES ('utf-8'), ('utf-8-sig'), ('gb18030')) e(encoding) GROUP BY ALL",
)
def delimited_encodings(spark, d):
    """The parts written as delimited files in each encoding and read back by the count of invalid sequences."""
    part = B.table(spark, d, "part").select("p_partkey", F.concat(F.lit("名称 "), "p_type").alias("name"), "p_size")
    out = None
    for encoding in IO.ENCODINGS:
        folder = scratch(spark, "delimited")
        folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
        exported_lines(part.repartition(4, "p_partkey"), folder, encoding)
        back = IO.read_delimited(spark, folder, "p_partkey bigint, name string, p_size bigint")
        one = back.groupBy("name").agg(F.count("*").alias("parts"), F.sum("p_size").alias("sizes")).withColumn("encoding", F.lit(encoding))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "S2_write_table",
    "SELECT o_orderpriority, COUNT(*) AS orders, MIN(o_orderkey) AS first_key FROM orders GROUP BY ALL",
)
def write_table(spark, d):
    path = scratch(spark, "orders")
    IO.write_table(B.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path)
    twin = spark.read.option("header", "true").schema("o_orderkey long, o_orderpriority string").csv(f"{path}.csv")
    return twin.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.min("o_orderkey").alias("first_key"))


_REVIEW_SQL = """
SELECT CAST(l_orderkey % 500 AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id,
       CAST(epoch_ms(l_shipdate) AS BIGINT) AS "timestamp", 1 + l_linenumber % 5 AS rating
FROM lineitem WHERE l_linenumber % 7 <> 6"""


def review_lines(spark, d):
    """Raw review lines with broken, blank and incomplete ones mixed in."""
    line = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    broken = F.col("l_linenumber") % 7 == 6
    body = F.to_json(
        F.struct(
            (F.col("l_orderkey") % 500).cast("string").alias("user_id"),
            F.col("l_partkey").cast("string").alias("parent_asin"),
            F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
            (1 + F.col("l_linenumber") % 5).cast("double").alias("rating"),
            (F.col("l_linenumber") % 2 == 0).alias("verified_purchase"),
        )
    )
    kinds = F.when(F.col("l_orderkey") % 3 == 0, F.lit("")).otherwise(F.lit("{broken"))
    return line.select(F.when(broken, kinds).otherwise(body).alias("value"))


@query(
    "S3_reviews_jsonl",
    f"""WITH r AS ({_REVIEW_SQL})
    SELECT user_id, COUNT(*) AS records, CAST(SUM(rating) AS BIGINT) AS rating_total
    FROM (SELECT user_id, item_id, "timestamp", MIN(rating) AS rating FROM r GROUP BY ALL) GROUP BY user_id""",
)
def reviews_jsonl(spark, d):
    path = scratch(spark, "reviews")
    review_lines(spark, d).write.text(path)
    records = J.purchase_records(J.read_lines(spark, path, J.REVIEW_SCHEMA))
    return records.groupBy("user_id").agg(
        F.count("*").alias("records"), F.sum("rating").cast("bigint").alias("rating_total")
    )


def meta_lines(spark, d):
    """Item metadata lines; every item appears twice and the later line differs."""
    part = B.table(spark, d, "part")
    copies = part.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    image = lambda v, hi, large: F.struct(F.lit(v).alias("variant"), hi.alias("hi_res"), large.alias("large"))
    key = F.col("p_partkey").cast("string")
    missing = F.lit(None).cast("string")
    images = (
        F.when(F.col("p_partkey") % 4 == 0, F.array(image("PT01", missing, F.concat(F.lit("l"), key)), image("MAIN", F.concat(F.lit("h"), key), missing)))
        .when(F.col("p_partkey") % 4 == 1, F.array(image("PT01", missing, F.concat(F.lit("f"), key))))
        .when(F.col("p_partkey") % 4 == 2, F.array(image("MAIN", missing, missing)))
    )
    body = F.to_json(
        F.struct(
            key.alias("parent_asin"),
            (F.col("p_size") + F.col("copy") * 10).cast("double").alias("rating_number"),
            F.when(F.col("p_partkey") % 2 == 0, F.array("p_type", "p_brand")).alias("categories"),
            F.col("p_type").alias("main_category"),
            F.col("p_brand").alias("store"),
            F.col("p_name").alias("title"),
            F.concat(F.lit("from $"), F.col("p_retailprice").cast("string")).alias("price"),
            F.split("p_name", " ").alias("features"),
            images.alias("images"),
        )
    )
    return copies.select(F.col("copy").alias("line_no"), body.alias("value"))


@query(
    "S4_item_metadata",
    sql_rounded(
        """SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_size + 10 AS popularity,
           CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || p_brand ELSE p_type END AS category FROM part""",
        ["item_id", "category"],
        ["popularity"],
    ),
)
def item_metadata(spark, d):
    return J.item_pool(J.parse_lines(meta_lines(spark, d), J.META_SCHEMA), "line_no")


@query(
    "S5_workbook_headers",
    "SELECT p_type AS cat3_name, COUNT(DISTINCT p_brand) AS brand_names FROM part GROUP BY ALL",
)
def workbook_headers(spark, d):
    raw = B.table(spark, d, "part").select(F.col("p_type").alias(" p_type "), F.col("p_brand").alias("p_brand\t"))
    clean = IO.trimmed_columns(raw, {"p_type": "cat3_name", "p_brand": "brand_name"})
    return clean.groupBy("cat3_name").agg(F.countDistinct("brand_name").alias("brand_names"))


def exported_workbooks(df, folder: str, sheets: int = 2) -> list[str]:
    """One workbook per partition of ``df``, its rows dealt to the sheets, headers padded with blanks."""
    names = df.columns

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if rows:
            header = [f" {n} " for n in names]
            content = WB.workbook_bytes({f"part {k}": [header, *rows[k::sheets]] for k in range(sheets)})
            system, path = pafs.FileSystem.from_uri(folder)
            system.create_dir(path)
            name = f"{path}/{uuid.uuid4().hex}.xlsx"
            with system.open_output_stream(name) as out:
                out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    return [r["path"] for r in df.mapInArrow(run, "path string").collect()]


@query(
    "S5_workbook_scan",
    "SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, c_mktsegment AS tier, CAST(c_nationkey AS VARCHAR) AS city FROM customer",
)
def workbook_scan(spark, d):
    """The customers written as workbooks of two sheets each and read back under trimmed, renamed headers."""
    folder = scratch(spark, "workbooks")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    customers = B.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    # a sheet holds 1,048,576 rows, so a workbook's rows are counted out
    tasks = max(2, -(-customers.count() // 500_000))
    paths = exported_workbooks(customers.repartition(tasks, "c_custkey"), folder)
    listed = "{" + ",".join(p.rsplit("/", 1)[1] for p in paths) + "}"
    return WB.read_workbook(spark, f"{folder}/{listed}", None, {"c_custkey": "user_id", "c_name": "name", "c_mktsegment": "tier", "c_nationkey": "city"})


@query(
    "S7_pruned_scan",
    sql_rounded("SELECT AVG(l_discount) AS avg_discount, AVG(l_tax) AS avg_tax FROM lineitem", [], ["avg_discount", "avg_tax"]),
)
def pruned_scan(spark, d):
    pruned = IO.read_table(spark, f"{d}/lineitem.parquet", ["l_discount", "l_tax"])
    return pruned.agg(F.avg("l_discount").alias("avg_discount"), F.avg("l_tax").alias("avg_tax"))


@query(
    "S8_shard_union",
    sql_rounded(
        "SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_size + 100 END "
        "AS score, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS note FROM part",
        ["item_id", "note"],
        ["score"],
    ),
)
def shard_union(spark, d):
    part = B.table(spark, d, "part")
    item = F.col("p_partkey").cast("string").alias("item_id")
    first = part.filter("p_partkey % 3 = 0").select(item, F.col("p_size").cast("double").alias("score"))
    second = part.select(item, (F.col("p_size") + 100.0).alias("score"), F.col("p_brand").alias("note"))
    return IO.union_shards([first, second], "item_id")


@query(
    "S11_manifest_digest",
    "SELECT (SELECT COUNT(*) FROM orders) AS rows, TRUE AS unchanged, TRUE AS change_detected",
)
def manifest_digest(spark, d):
    orders = B.table(spark, d, "orders")
    path = scratch(spark, "manifest")
    written = IO.write_manifest(orders, path, {"artefact": "orders"})
    again = IO.table_digest(B.table(spark, d, "orders")).first()
    changed = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") == 0, -1).otherwise(F.col("o_custkey")))
    row = IO.table_digest(changed).first()
    return spark.range(1).select(
        F.lit(written["rows"]).cast("bigint").alias("rows"),
        F.lit(again["hash_sum"] == written["hash_sum"]).alias("unchanged"),
        F.lit(row["hash_sum"] != written["hash_sum"]).alias("change_detected"),
    )


@query(
    "S12_media_inventory",
    "SELECT (SELECT COUNT(DISTINCT lang) FROM documents) AS images",
)
def media_inventory(spark, d):
    path = scratch(spark, "media")
    docs = B.table(spark, d, "documents").select("lang", "doc_id").distinct()
    named = docs.groupBy("lang").agg(F.min("doc_id").alias("m"))
    named.select(F.col("m").cast("string").alias("value"), "lang").coalesce(1).write.partitionBy("lang").text(path)
    return IO.count_media(spark, f"{path}/*", "*.txt")


# ---- scalar functions --------------------------------------------------------


@query(
    "P1_normalize_ids",
    r"""WITH t AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN '  00' || l_partkey || '.0' WHEN 1 THEN '0' || l_partkey || ' '
         ELSE CAST(l_partkey AS VARCHAR) END AS raw FROM lineitem)
    SELECT item_id, COUNT(*) AS n FROM (
      SELECT regexp_replace(regexp_replace(trim(raw), '\.0$', ''), '^0+', '') AS item_id FROM t) GROUP BY item_id""",
)
def normalize_ids(spark, d):
    key, n = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3
    raw = F.when(n == 0, F.concat(F.lit("  00"), key, F.lit(".0"))).when(n == 1, F.concat(F.lit("0"), key, F.lit(" "))).otherwise(key)
    df = S.normalize_ids(B.table(spark, d, "lineitem").select(raw.alias("item_id")), ["user_id", "item_id"])
    return df.groupBy("item_id").agg(F.count("*").alias("n"))


@query(
    "P2_normalize_item_id",
    """SELECT CASE WHEN x = '' THEN '0' ELSE x END AS item_id, COUNT(*) AS n
    FROM (SELECT ltrim(CAST(l_partkey AS VARCHAR), '0') AS x FROM lineitem) GROUP BY ALL""",
)
def normalize_item_id(spark, d):
    raw = F.concat(F.lit("000"), F.col("l_partkey").cast("string"), F.lit(".0"))
    df = B.table(spark, d, "lineitem").select(S.clean_item_id_keep_zero(raw).alias("item_id"))
    return df.groupBy("item_id").agg(F.count("*").alias("n"))


_MIXED_TIMES_SQL = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d')
  WHEN 1 THEN CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) WHEN 2 THEN CAST(epoch_ms(o_orderdate) AS VARCHAR)
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END"""


def mixed_times(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 5
    raw = (
        F.when(k == 0, F.date_format(ts, "yyyyMMdd"))
        .when(k == 1, F.unix_timestamp(ts).cast("string"))
        .when(k == 2, F.unix_millis(ts).cast("string"))
        .when(k == 3, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise("unknown")
    )
    return B.table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


@query(
    "P3_numeric_timestamp",
    f"""SELECT o_orderkey, COALESCE(TRY_CAST(raw AS DOUBLE), epoch(TRY_CAST(raw AS TIMESTAMP))) AS ts
    FROM (SELECT o_orderkey, {_MIXED_TIMES_SQL} AS raw FROM orders)""",
)
def numeric_timestamp(spark, d):
    return mixed_times(spark, d).select("o_orderkey", S.numeric_timestamp("raw").alias("ts"))


@query(
    "P4_day_key",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CAST(strftime(o_orderdate, '%Y%m%d') AS DOUBLE) END AS day
    FROM orders""",
)
def day_key(spark, d):
    return mixed_times(spark, d).select("o_orderkey", S.day_key("raw").alias("day"))


@query(
    "P5_epoch_day_text",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) THEN strftime(o_orderdate, '%Y%m%d')
      WHEN o_orderkey % 5 = 0 THEN strftime(make_timestamp(CAST(raw AS BIGINT) * 1000000), '%Y%m%d')
      ELSE '19700101' END AS day FROM (SELECT *, {_MIXED_TIMES_SQL} AS raw FROM orders)""",
)
def epoch_day_text(spark, d):
    return mixed_times(spark, d).select("o_orderkey", S.epoch_day_text("raw").alias("day"))


@query(
    "P6_close_funnel",
    W(
        ["funnel_raw"],
        """SELECT GREATEST(y_click, y_cart, y_purchase) AS y_click, GREATEST(y_cart, y_purchase) AS y_cart, y_purchase,
        COUNT(*) AS n FROM funnel_raw GROUP BY ALL""",
    ),
)
def close_funnel(spark, d):
    return FN.close_funnel(B.funnel_raw(spark, d)).groupBy("y_click", "y_cart", "y_purchase").agg(F.count("*").alias("n"))


@query(
    "P7_quantity_flag",
    """SELECT event_type, COUNT(*) AS n, CAST(SUM(CASE WHEN event_type IN ('click', 'view') OR value > 50 THEN 1 ELSE 0 END)
    AS BIGINT) AS flagged FROM events GROUP BY event_type""",
)
def quantity_flag(spark, d):
    events = B.table(spark, d, "events")
    flag = F.when(F.col("event_type").isin("click", "view"), 1)
    marked = events.select("event_type", S.any_positive(flag, F.col("value") - 50).alias("f"))
    return marked.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("f").alias("flagged"))


@query(
    "P8_position_key",
    """SELECT COALESCE(CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 4 AS VARCHAR) END, 'nan') || '_' ||
    COALESCE(CASE WHEN s_nationkey % 3 > 0 THEN CAST(s_nationkey % 3 AS VARCHAR) END, 'nan') AS position, COUNT(*) AS n
    FROM supplier GROUP BY ALL""",
)
def position_key(spark, d):
    part = lambda c, m: F.when(F.col(c) % m > 0, F.col(c) % m)
    key = S.position_key(part("s_suppkey", 4), part("s_nationkey", 3))
    return B.table(spark, d, "supplier").groupBy(key.alias("position")).agg(F.count("*").alias("n"))


@query(
    "P9_parse_price",
    sql_rounded(
        """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN p_retailprice
        ELSE TRY_CAST(regexp_extract('from $' || CAST(p_retailprice AS VARCHAR) || ' each', '[0-9.]+') AS DOUBLE) END AS price
        FROM part""",
        ["p_partkey"],
        ["price"],
    ),
)
def parse_price(spark, d):
    price = F.col("p_retailprice").cast("string")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "call us").when(k == 1, price).otherwise(F.concat(F.lit("from $"), price, F.lit(" each")))
    return B.table(spark, d, "part").select("p_partkey", S.parse_price(raw).alias("price"))


@query(
    "P10_log_transforms",
    sql_rounded("SELECT p_partkey, ln(1 + p_retailprice) AS x_pri_log, ln(1 + p_size) AS size_log FROM part", ["p_partkey"], ["x_pri_log", "size_log"]),
)
def log_transforms(spark, d):
    return B.table(spark, d, "part").select(
        "p_partkey", F.log1p("p_retailprice").alias("x_pri_log"), F.log1p(F.col("p_size").cast("double")).alias("size_log")
    )


@query(
    "P11_item_text",
    """SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'Brand: ' || COALESCE(CASE WHEN p_partkey % 5 > 0 THEN p_brand END, 'Unknown')
      || ' | Category: ' || p_type || '-Unknown-' || p_type || ' | Product name: ' || p_name AS text_w,
      'Brand: ' || p_brand || ' | Category: ' || p_type || ' | Title: ' || p_name || ' | Product features: '
      || left(repeat(p_name || ' ', 29) || p_name, 300) AS listing FROM part""",
)
def item_text(spark, d):
    brand = F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand"))
    missing = F.lit(None).cast("string")
    words = F.array_repeat(F.col("p_name"), 30)
    return B.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        T.item_text(brand, ["p_type", missing, "p_type"], "p_name").alias("text_w"),
        T.listing_text("p_brand", "p_type", "p_name", words).alias("listing"),
    )


@query(
    "P12_category",
    "SELECT CAST(p_partkey AS VARCHAR) AS item_id, CASE WHEN p_partkey % 6 = 0 THEN 'Unknown' ELSE p_type END AS category FROM part",
)
def category(spark, d):
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 1, F.concat(F.lit("品牌：x | 类目："), "p_type", F.lit(" | y")))
        .when(k > 1, F.concat(F.lit("Brand: x | Category: "), "p_type", F.lit(" | y")))
    )
    items = B.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), text.alias("text_W"))
    return T.category_table(items)


_TEXTS_SQL = """(SELECT doc_id, lang, CASE doc_id % 9 WHEN 0 THEN ' 默认好评 ' WHEN 1 THEN 'Works Great ' WHEN 2 THEN 'x'
  WHEN 3 THEN 'five stars' WHEN 4 THEN NULL ELSE text END AS review_text FROM documents)"""


def review_texts(spark, d):
    k = F.col("doc_id") % 9
    text = (
        F.when(k == 0, " 默认好评 ").when(k == 1, "Works Great ").when(k == 2, "x").when(k == 3, "five stars")
        .when(k == 4, F.lit(None).cast("string")).otherwise(F.col("text"))
    )
    return B.table(spark, d, "documents").select("doc_id", "lang", text.alias("review_text"))


@query(
    "P13_short_review_validity",
    f"""SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE trim(review_text) NOT IN ('此用户没有填写评价内容',
      '该用户没有填写评价内容', '默认好评', '无评价内容', 'nan', 'None') AND length(trim(review_text)) >= 2) AS valid
    FROM {_TEXTS_SQL} GROUP BY lang""",
)
def short_review_validity(spark, d):
    marked = review_texts(spark, d).withColumn("v", T.is_valid_review_short("review_text"))
    return marked.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("v").alias("valid"))


@query(
    "P14_review_validity",
    f"""SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE length(trim(review_text)) >= 10 AND lower(trim(review_text)) NOT IN
      ('none','na','n/a','good','great','ok','okay','nice','love it','works great','five stars','five star','as expected')) AS valid
    FROM {_TEXTS_SQL} GROUP BY lang""",
)
def review_validity(spark, d):
    marked = review_texts(spark, d).withColumn("v", T.is_valid_review("review_text"))
    return marked.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("v").alias("valid"))


@query(
    "P15_truth_text",
    """SELECT truth, COUNT(*) AS n FROM (SELECT CASE l_linenumber % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN TRUE
    ELSE FALSE END AS truth FROM lineitem) GROUP BY truth""",
)
def truth_text(spark, d):
    k = F.col("l_linenumber") % 5
    raw = F.when(k == 0, " TRUE ").when(k == 1, "1.0").when(k == 2, "yes").when(k == 3, "0")
    return B.table(spark, d, "lineitem").groupBy(S.is_true_text(raw).alias("truth")).agg(F.count("*").alias("n"))


@query(
    "P16_safe_numbers",
    sql_rounded(
        """SELECT l_returnflag, COUNT(x) AS known, SUM(x) AS total, SUM(COALESCE(x, 0)) AS filled_total FROM (SELECT l_returnflag,
        CASE WHEN l_linenumber % 4 < 2 THEN l_quantity END AS x FROM lineitem) GROUP BY l_returnflag""",
        ["l_returnflag", "known"],
        ["total", "filled_total"],
    ),
)
def safe_numbers(spark, d):
    k = F.col("l_linenumber") % 4
    raw = F.when(k < 2, F.col("l_quantity").cast("string")).when(k == 2, "Infinity").otherwise("n/a")
    df = B.table(spark, d, "lineitem").select("l_returnflag", S.safe_double(raw).alias("x"), S.safe_double(raw, 0.0).alias("z"))
    return df.groupBy("l_returnflag").agg(F.count("x").alias("known"), F.sum("x").alias("total"), F.sum("z").alias("filled_total"))


@query(
    "P19_component_names",
    r"""SELECT CASE WHEN name = 'mkt_price' THEN 'a_pri' ELSE name END AS component, COUNT(*) AS n FROM (
      SELECT replace(replace(replace(replace(replace(replace(raw, 'res_', ''), '__reverse_gs_pure', ''), '__gs_pure', ''),
      '_calibrated', ''), '_calib', ''), 'atomic_', '') AS name FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN
      'res_atomic_mkt_price_calib' WHEN 1 THEN 'res_T_int_fac_calibrated__gs_pure' WHEN 2 THEN 'res_T_con_soc__reverse_gs_pure'
      ELSE p_brand END AS raw FROM part)) GROUP BY ALL""",
)
def component_names(spark, d):
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, "res_atomic_mkt_price_calib").when(k == 1, "res_T_int_fac_calibrated__gs_pure")
        .when(k == 2, "res_T_con_soc__reverse_gs_pure").otherwise(F.col("p_brand"))
    )
    return B.table(spark, d, "part").groupBy(S.clean_component_name(raw).alias("component")).agg(F.count("*").alias("n"))


@query(
    "P20_rating_treatment",
    sql_rounded(
        """SELECT l_partkey, LEAST(1, GREATEST(0, (COALESCE(AVG(l_quantity) FILTER (WHERE l_quantity < 6), 3) - 1) / 4)) AS t_con_rat
        FROM lineitem GROUP BY l_partkey""",
        ["l_partkey"],
        ["t_con_rat"],
    ),
)
def rating_treatment(spark, d):
    means = B.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_quantity") < 6, F.col("l_quantity"))).alias("m"))
    return means.select("l_partkey", S.rating_treatment("m").alias("t_con_rat"))


@query(
    "P22_history_mask",
    sql_rounded(
        """SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_acctbal END AS masked,
        CASE WHEN c_nationkey % 4 <> 0 THEN 1 ELSE 0 END AS available FROM customer""",
        ["c_custkey", "available"],
        ["masked"],
    ),
)
def history_mask(spark, d):
    masked = S.mask_without_history("c_acctbal", F.col("c_nationkey") % 4)
    return B.table(spark, d, "customer").select("c_custkey", masked.alias("masked"), masked.isNotNull().cast("int").alias("available"))


@query(
    "P23_interventions",
    W(
        ["measures"],
        sql_rounded(
            """SELECT item_id, CASE WHEN T_con_mkt > 0.7 THEN T_con_mkt * 0.5 ELSE T_con_mkt END AS t_con_mkt,
            LEAST(1, GREATEST(0, T_int_fac + 0.1)) AS t_int_fac FROM measures""",
            ["item_id"],
            ["t_con_mkt", "t_int_fac"],
        ),
    ),
)
def interventions(spark, d):
    return B.measures(spark, d).select("item_id", S.dampen_high("T_con_mkt").alias("t_con_mkt"), S.raise_clipped("T_int_fac").alias("t_int_fac"))


_URL_SQL = """CASE p_partkey % 4 WHEN 0 THEN 'h' || p_partkey WHEN 1 THEN 'f' || p_partkey END"""


@query("P24_best_image", f"SELECT CAST(p_partkey AS VARCHAR) AS asin, {_URL_SQL} AS url FROM part")
def best_image(spark, d):
    parsed = J.parse_lines(meta_lines(spark, d).filter("line_no = 0"), J.META_SCHEMA)
    return parsed.select(F.col("parent_asin").alias("asin"), S.best_image("images").alias("url"))


@query(
    "P26_image_tasks",
    f"SELECT COUNT({_URL_SQL}) AS tasks, COUNT(*) FILTER (WHERE {_URL_SQL} IS NULL) AS no_image FROM part",
)
def image_tasks(spark, d):
    tasks = J.image_tasks(J.parse_lines(meta_lines(spark, d), J.META_SCHEMA), "line_no")
    return tasks.agg(F.count("url").alias("tasks"), F.count_if(F.col("url").isNull()).alias("no_image"))


_FIRST_TEXTS = """u AS (SELECT item_id, review_text, MIN(ingest_order) AS ingest_order FROM reviews
  WHERE trim(review_text) <> '' GROUP BY item_id, review_text),
  f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY ingest_order) AS rank FROM u QUALIFY rank <= 5),
  rolled AS (SELECT item_id, left(string_agg(review_text, ' | ' ORDER BY rank), 300) AS all_reviews FROM f GROUP BY item_id)"""


@query("A16_review_rollup", W(["reviews"], f"WITH {_FIRST_TEXTS} SELECT * FROM rolled"))
def review_rollup(spark, d):
    return T.review_rollup(B.reviews(spark, d))


@query(
    "P27_prompt_input",
    W(
        ["reviews", "items"],
        f"""WITH {_FIRST_TEXTS} SELECT i.item_id, '[Core specifications]' || chr(10) || text_W || chr(10) || chr(10) ||
        '[User feedback]' || chr(10) || COALESCE(all_reviews, 'None available') AS aggregated_text
        FROM items i LEFT JOIN rolled r ON i.item_id = r.item_id""",
    ),
)
def prompt_input(spark, d):
    return T.prompt_input(B.items(spark, d), T.review_rollup(B.reviews(spark, d)))


def weighted_replies(spark, d):
    """Two replies per item with score/weight pairs; some broken, some with numbers inside text."""
    m = IO.spread(B.measures(spark, d).withColumn("k", F.col("item_id").cast("bigint")), "item_id")
    pair = lambda c, w: F.struct(
        F.concat(F.lit("about "), F.round(F.col(c) * 10, 1).cast("string")).alias("score"), F.lit(w).alias("weight")
    )
    body = F.to_json(
        F.struct(
            F.struct(*[pair(f"atomic_{c}", w).alias(c) for c, w in (("a_pri", 0.4), ("a_gft", 0.3), ("a_sub", 0.2), ("a_urg", 0.1))]).alias("atomic_marketing"),
            F.struct(pair("atomic_a_spec", 0.5).alias("a_spec"), pair("atomic_a_str", 0.5).alias("a_str"), pair("T_int_fac", 1.0).alias("a_text_fact")).alias("atomic_functional"),
        )
    )
    two = m.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    broken = (F.col("k") % 13 == 0) & (F.col("r") == 1)
    text = F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```"))
    return two.select("item_id", F.when(broken, "no reply").otherwise(text).alias("response"))


@query(
    "P28_weighted_replies",
    W(
        ["measures"],
        sql_rounded(
            """SELECT item_id, ROUND(atomic_a_pri*0.4 + atomic_a_gft*0.3 + atomic_a_sub*0.2 + atomic_a_urg*0.1, 4) AS T_con_mkt,
            ROUND((atomic_a_spec + atomic_a_str) / 2, 4) AS T_int_vis, T_int_fac, atomic_a_pri, atomic_a_gft, atomic_a_sub,
            atomic_a_urg, atomic_a_spec, atomic_a_str FROM measures""",
            ["item_id"],
            ["T_con_mkt", "T_int_vis", "T_int_fac", "atomic_a_pri", "atomic_a_gft", "atomic_a_sub", "atomic_a_urg", "atomic_a_spec", "atomic_a_str"],
            4,
        ),
    ),
)
def weighted_reply_scores(spark, d):
    return T.parse_weighted_replies(weighted_replies(spark, d))


CODES = ["T_con_mkt", "T_int_vis", "T_int_fac"]


@query(
    "P29_score_replies",
    W(
        ["measures"],
        sql_rounded(
            """SELECT item_id, k % 13 NOT IN (0, 1, 3) AS schema_valid,
            CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 2 THEN 10 ELSE T_con_mkt * 10 END AS T_con_mkt_0_10,
            CASE WHEN k % 13 IN (0, 1) THEN NULL ELSE T_int_vis * 10 END AS T_int_vis_0_10,
            CASE WHEN k % 13 IN (0, 3) THEN NULL ELSE T_int_fac * 10 END AS T_int_fac_0_10,
            CASE k % 13 WHEN 0 THEN 'json_parse_error' WHEN 1 THEN 'missing_T_int_vis' WHEN 2 THEN 'clipped_T_con_mkt'
              WHEN 3 THEN 'non_numeric_T_int_fac' ELSE '' END AS notes
            FROM (SELECT *, CAST(item_id AS BIGINT) AS k FROM measures)""",
            ["item_id", "schema_valid", "notes"],
            ["T_con_mkt_0_10", "T_int_vis_0_10", "T_int_fac_0_10"],
        ),
    ),
)
def score_replies(spark, d):
    m = B.measures(spark, d).withColumn("k", F.col("item_id").cast("bigint") % 13)
    number = lambda c: F.round(F.col(c) * 10, 1).cast("string")
    scores = F.struct(
        F.when(F.col("k") == 2, "12.5").otherwise(number("T_con_mkt")).alias("T_con_mkt"),
        F.when(F.col("k") != 1, number("T_int_vis")).alias("T_int_vis"),
        F.when(F.col("k") == 3, "high").otherwise(number("T_int_fac")).alias("T_int_fac"),
    )
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit(True).alias("schema_valid"), scores.alias("scores"))), F.lit("\n```"))
    replies = m.select("item_id", F.when(F.col("k") == 0, "sorry").otherwise(body).alias("response"))
    return T.parse_score_replies(replies, "response", CODES)


@query(
    "P30_audit_prompts",
    """SELECT 'doc ' || doc_id AS item_id, 'Score each cue 0-10.' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source
    || chr(10) || 'Text excerpt: ' || left(text, 1500) AS prompt FROM documents""",
)
def audit_prompts(spark, d):
    docs = B.table(spark, d, "documents")
    prompt = T.audit_prompt(["lang", "source"], "Score each cue 0-10.", F.col("text"))
    return docs.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("item_id"), prompt.alias("prompt"))


# ---- event tables ------------------------------------------------------------

_LOG_SQL = """clicks AS (SELECT CAST(user_id AS VARCHAR) AS user_id, regexp_extract(props, '[0-9]+') AS item_id,
  CAST(strftime(ts, '%Y%m%d') AS DOUBLE) AS "timestamp", CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS y_click,
  'm' || (event_id % 3) || '_s' || (event_id % 2) AS position FROM events WHERE event_type IN ('view', 'click')),
orders_log AS (SELECT CAST(user_id AS VARCHAR) AS user_id, regexp_extract(props, '[0-9]+') AS item_id,
  CAST(strftime(ts, '%Y%m%d') AS DOUBLE) AS "timestamp", CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS y_cart,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_purchase FROM events WHERE event_type IN ('signup', 'purchase'))"""


def click_log(spark, d):
    e = B.table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    item = F.get_json_object("props", "$.k")
    position = S.position_key(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")))
    return e.select(
        F.col("user_id").cast("string").alias("user_id"), item.alias("item_id"),
        S.date_number(F.col("ts")).cast("double").alias("timestamp"),
        S.any_positive((F.col("event_type") == "click").cast("int")).alias("y_click"), position.alias("position"),
    )


def order_log(spark, d):
    e = B.table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase"))
    return e.select(
        F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item_id"),
        S.date_number(F.col("ts")).cast("double").alias("timestamp"),
        S.any_positive((F.col("event_type") == "signup").cast("int")).alias("y_cart"),
        S.any_positive((F.col("event_type") == "purchase").cast("int")).alias("y_purchase"),
    )


@query(
    "J1_merge_logs",
    f"""WITH {_LOG_SQL}, j AS (SELECT COALESCE(c.user_id, o.user_id) AS user_id, ltrim(COALESCE(c.item_id, o.item_id), '0') AS item_id,
      COALESCE(c."timestamp", o."timestamp") AS "timestamp", COALESCE(y_click, 0) AS a, COALESCE(y_cart, 0) AS b,
      COALESCE(y_purchase, 0) AS p, COALESCE(position, 'trans_direct') AS position FROM clicks c FULL OUTER JOIN orders_log o
      ON c.user_id = o.user_id AND c.item_id = o.item_id AND c."timestamp" = o."timestamp")
    SELECT user_id, item_id, "timestamp", MAX(GREATEST(a, b, p)) AS y_click, MAX(GREATEST(b, p)) AS y_cart, MAX(p) AS y_purchase,
      COALESCE(MIN(position) FILTER (WHERE position <> 'trans_direct'), 'trans_direct') AS position
    FROM j GROUP BY user_id, item_id, "timestamp" """,
)
def merge_logs(spark, d):
    return FN.merge_logs(click_log(spark, d), order_log(spark, d))


@query("A1_collapse_duplicates", W(["funnel"], "SELECT * FROM funnel"))
def collapse_duplicates(spark, d):
    return B.funnel(spark, d)


_DIAG_SQL = """SELECT metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'purchase_without_cart' AS metric, COUNT(*) FILTER (WHERE y_purchase = 1 AND y_cart = 0) AS value FROM {t}
  UNION ALL SELECT 'cart_without_click', COUNT(*) FILTER (WHERE y_cart = 1 AND y_click = 0) FROM {t}
  UNION ALL SELECT 'purchase_without_click', COUNT(*) FILTER (WHERE y_purchase = 1 AND y_click = 0) FROM {t}
  UNION ALL SELECT 'n_rows', COUNT(*) FROM {t} UNION ALL SELECT 'n_users', COUNT(DISTINCT user_id) FROM {t}
  UNION ALL SELECT 'n_items', COUNT(DISTINCT item_id) FROM {t} UNION ALL SELECT 'n_click', SUM(y_click) FROM {t}
  UNION ALL SELECT 'n_cart', SUM(y_cart) FROM {t} UNION ALL SELECT 'n_purchase', SUM(y_purchase) FROM {t}
  UNION ALL SELECT 'pattern_click' || y_click || '_cart' || y_cart || '_purchase' || y_purchase, COUNT(*) FROM {t} GROUP BY y_click, y_cart, y_purchase)"""


@query("A2_funnel_diagnostics", W(["funnel_raw"], _DIAG_SQL.format(t="funnel_raw")))
def funnel_diagnostics(spark, d):
    return FN.diagnostics(B.funnel_raw(spark, d))


def purchase_rows(spark, d):
    """Observed purchases of the raw funnel in the purchase-only layout."""
    raw = B.funnel_raw(spark, d).filter("y_purchase = 1").select("user_id", "item_id", "timestamp", "position").groupBy("user_id", "item_id", "timestamp").agg(F.min("position").alias("position"))
    return raw.withColumns(
        {"y_purchase": F.lit(1), "is_sampled_nonpurchase": F.lit(0), "outcome_source": F.lit("observed"), "rating": F.lit(5.0)}
    )


def unsold_rows(spark, d):
    raw = B.funnel_raw(spark, d).filter("y_cart = 1").select("user_id", "item_id", "timestamp", "position").groupBy("user_id", "item_id", "timestamp").agg(F.min("position").alias("position"))
    return raw.withColumns({"y_purchase": F.lit(0), "is_sampled_nonpurchase": F.lit(1), "outcome_source": F.lit("sampled")})


_SOURCES_SQL = """merged AS (SELECT user_id, item_id, "timestamp", MAX(y) AS y_purchase, MAX(s) AS is_sampled_nonpurchase,
  COALESCE(MIN(position) FILTER (WHERE s = 0), MIN(position)) AS position, COALESCE(MIN(src) FILTER (WHERE s = 0), MIN(src)) AS outcome_source,
  MIN(rating) AS rating FROM (
    SELECT user_id, item_id, "timestamp", MIN(position) AS position, 1 AS y, 0 AS s, 'observed' AS src, 5.0 AS rating FROM funnel_raw WHERE y_purchase = 1 GROUP BY ALL
    UNION ALL SELECT user_id, item_id, "timestamp", MIN(position), 0, 1, 'sampled', NULL FROM funnel_raw WHERE y_cart = 1 GROUP BY ALL)
  GROUP BY user_id, item_id, "timestamp")"""


@query(
    "A4_merge_sources",
    W(["funnel_raw"], f'WITH {_SOURCES_SQL} SELECT user_id, item_id, "timestamp", y_purchase, is_sampled_nonpurchase, position, outcome_source, CAST(rating AS DOUBLE) AS rating FROM merged'),
)
def merge_sources(spark, d):
    return FN.merge_sources(purchase_rows(spark, d), unsold_rows(spark, d))


@query(
    "A3_purchase_diagnostics",
    W(
        ["funnel_raw"],
        f"""WITH {_SOURCES_SQL} SELECT metric, CAST(value AS BIGINT) AS value FROM (SELECT 'rows' AS metric, COUNT(*) AS value FROM merged
        UNION ALL SELECT 'users', COUNT(DISTINCT user_id) FROM merged UNION ALL SELECT 'items', COUNT(DISTINCT item_id) FROM merged
        UNION ALL SELECT 'purchase_positive_records', SUM(y_purchase) FROM merged
        UNION ALL SELECT 'sampled_nonpurchase_records', SUM(is_sampled_nonpurchase) FROM merged
        UNION ALL SELECT 'native_click_available', 0 UNION ALL SELECT 'native_cart_available', 0)""",
    ),
)
def purchase_diagnostics(spark, d):
    return FN.purchase_diagnostics(FN.merge_sources(purchase_rows(spark, d), unsold_rows(spark, d)))


@query(
    "A11_label_composition",
    sql_rounded(
        """SELECT COUNT(*) FILTER (WHERE quality = 1) AS positive_rows, COUNT(*) FILTER (WHERE quality = 1 AND doc_id % 3 = 0) AS verified_true_rows,
        COUNT(*) FILTER (WHERE quality = 1 AND doc_id % 3 = 1) AS verified_false_rows, COUNT(*) FILTER (WHERE quality = 1 AND doc_id % 3 = 2) AS verified_missing_rows,
        COUNT(*) FILTER (WHERE quality = 1 AND doc_id % 3 = 0) / COUNT(*) FILTER (WHERE quality = 1 AND doc_id % 3 < 2) AS verified_share_among_known,
        COUNT(*) FILTER (WHERE quality = 0) AS sampled_nonpurchase_rows FROM labels""",
        ["positive_rows", "verified_true_rows", "verified_false_rows", "verified_missing_rows", "sampled_nonpurchase_rows"],
        ["verified_share_among_known"],
    ),
)
def label_composition(spark, d):
    k = F.col("doc_id") % 3
    verified = F.when(k == 0, " True").when(k == 1, "0")
    df = B.table(spark, d, "labels").select(F.col("quality").alias("y_purchase"), verified.alias("verified_purchase"))
    return D.label_composition(df)
