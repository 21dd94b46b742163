"""Queries on files in and out, schema harmonisation, cleaning actions, joins and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hexcadence.operators import clean, relational
from hexcadence.session import scratch_path
from hexcadence.sources import files, tables
from hexcadence.workload.base import BROKEN_EVENTS, PLACED_EVENTS, broken_events, placed_events, query, table


def _returned(spark, d):
    """Per order the value of its returned items."""
    return (
        table(spark, d, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum("l_extendedprice").alias("o_totalprice"), F.lit("new").alias("cell"))
    )


def _years(spark, d) -> list:
    """Years that occur in the orders (a handful), a null date's last."""
    found = [r[0] for r in table(spark, d, "orders").select(F.year("o_orderdate")).distinct().collect()]
    return sorted(found, key=lambda y: (y is None, y))


# --- files --------------------------------------------------------------------------------------


def _price_text(decimal_mark: str):
    return F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(decimal_mark))


def _write_yearly(spark, d) -> dict[str, str]:
    """Orders as yearly text files: delimiters vary, decimal comma, accents, one file in a single column."""
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    out = {}
    years = _years(spark, d)
    for i, y in enumerate(years):
        sep = "\t;,"[i % 3]
        part = o.where(F.col("y").eqNullSafe(F.lit(y))).select(
            "o_orderkey",
            "o_custkey",
            _price_text("." if sep == "," or y == years[-1] else ",").alias("price"),
            F.concat(F.lit("priorité "), F.col("o_orderpriority")).alias("priority"),
        )
        path = scratch_path(spark, f"orders-{y}")
        if y == years[-1]:  # everything in one column, separated by commas
            name = "o_orderkey,o_custkey,price,priority"
            part.select(F.concat_ws(",", *part.columns).alias(name)).write.option("header", True).option(
                "sep", "\t"
            ).option("quote", "").option("encoding", files.ENCODING).csv(path)
        else:
            files.write_csv(part, path, sep)
        out[f"orders-{y}"] = path
    return out


@query(
    "csv_folder_scan",
    "source_file:s o_orderkey:i o_custkey:i price:d2 priority:s",
    """
    SELECT concat('orders_', COALESCE(CAST(year(o_orderdate) AS VARCHAR), 'None')) AS source_file, o_orderkey, o_custkey, o_totalprice AS price,
      concat('priorité ', o_orderpriority) AS priority FROM orders
    """,
)
def csv_folder_scan(spark, d):
    frames = files.read_folder(spark, _write_yearly(spark, d), "csv")
    return files.union_named(frames).withColumn("price", clean.to_number("price"))


@query(
    "csv_round_trip",
    "event_id:i event_type:s value:d",
    "SELECT event_id, event_type, value FROM events",
)
def csv_round_trip(spark, d):
    path = scratch_path(spark, "events-csv")
    files.write_csv(table(spark, d, "events").select("event_id", "event_type", "value"), path, ";")
    return clean.adapt_types(files.read_delimited(spark, path), numeric=["event_id", "value"])


@query(
    "single_column_repair",
    "event_id:i event_type:s value:d",
    "SELECT event_id, event_type, CASE WHEN value > 50 THEN value END AS value FROM events",
)
def single_column_repair(spark, d):
    e = table(spark, d, "events")
    line = F.concat_ws(
        ",", F.col("event_id").cast("string"), "event_type", F.when(F.col("value") > 50, F.col("value").cast("string"))
    )
    return files.split_single_column(e.select(line.alias("event_id,event_type, value")))


@query(
    "partitioned_parquet",
    "o_orderkey:i year:i o_totalprice:d2",
    "SELECT o_orderkey, year(o_orderdate) AS year, o_totalprice FROM orders WHERE year(o_orderdate) >= 1998",
)
def partitioned_parquet(spark, d):
    path = scratch_path(spark, "orders-parquet")
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    files.write_parquet(o, path, partition_by=["year"], max_rows_per_file=100_000)
    return spark.read.parquet(path).where(F.col("year") >= 1998)


@query(
    "processed_files",
    "event_id:i lat:d lon:d ts:t",
    f"SELECT event_id, lat, lon, ts FROM ({PLACED_EVENTS}) AS p",
)
def processed_files(spark, d):
    folder = scratch_path(spark, "processed")
    e = placed_events(spark, d)
    files.write_parquet(e.select("event_id", "lat", "lon", "user_id"), f"{folder}/events_place.parquet")
    files.write_parquet_parts(
        [e.where(F.col("value") > 50).select("event_id", "ts"), e.where(F.col("value") <= 50).select("event_id", "ts")],
        f"{folder}/events_time.parquet",
    )
    loaded = files.load_processed(
        spark, folder, ["events"], {"place": ["event_id", "lat", "lon"], "time": [], "absent": []}
    )
    return relational.natural_join(loaded["events"])


@query(
    "json_findings_round_trip",
    "event_type:s n:i mean:d",
    "SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1",
)
def json_findings_round_trip(spark, d):
    path = scratch_path(spark, "findings-json")
    stats = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    files.write_json(stats, path)
    return files.read_json(spark, path, "event_type string, n bigint, mean double")


@query(
    "table_load_validation",
    "n_rows:i n_keys:i unique:b",
    "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, count(*) = count(DISTINCT o_orderkey) AS \"unique\" FROM orders",
)
def table_load_validation(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz"}
    return tables.save_table(table(spark, d, "orders"), name, dtypes=types, key="o_orderkey", replace=True)


@query(
    "loaded_table",
    "o_orderkey:i o_totalprice:d2 o_orderpriority:s",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
)
def loaded_table(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    for _ in range(2):  # the second load appends
        tables.save_table(table(spark, d, "orders"), name, partition_by=["o_orderpriority"])
    return spark.table(name)


@query(
    "updated_table",
    "o_orderkey:i o_totalprice:d2 cell:s",
    """
    SELECT o_orderkey, coalesce(s, o_totalprice) AS o_totalprice, CASE WHEN s IS NOT NULL THEN 'new' END AS cell FROM orders
    LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) u ON o_orderkey = l_orderkey
    """,
)
def updated_table(spark, d):
    name = f"orders_{uuid.uuid4().hex}"
    tables.save_table(table(spark, d, "orders"), name)
    tables.update_table(spark, name, _returned(spark, d), "o_orderkey", ["o_totalprice", "cell"], into=f"{name}_new")
    return spark.table(f"{name}_new")


@query(
    "place_view",
    "event_id:i event_type:s",
    f"SELECT event_id, event_type FROM ({BROKEN_EVENTS}) AS b WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
)
def place_view(spark, d):
    return tables.place_view(broken_events(spark, d), "placed_base", ["event_id", "event_type"], "latitude", "longitude")


# --- schema and types ---------------------------------------------------------------------------

_RENAME = {"o_orderkey": "order_id", "orderkey": "order_id", "o_custkey": "customer", "prio": "priority", "prio1": "priority"}


def _yearly_variants(spark, d):
    """Yearly frames whose columns were renamed or dropped over time."""
    o = table(spark, d, "orders")
    out = {}
    for y in _years(spark, d):
        if y is None:
            continue  # a file belongs to a year
        f = o.where(F.year("o_orderdate") == y)
        key = "o_orderkey" if y < 1998 else "orderkey"
        prio = "prio" if y < 1999 else "prio1"
        cols = [F.col("o_orderkey").alias(key), F.col("o_custkey"), F.col("o_orderpriority").alias(prio)]
        if y >= 1997:
            cols.append(F.col("o_totalprice").alias("price"))
        out[y] = f.select(*cols, F.lit("x").alias("comment"))
    return out


@query(
    "harmonised_orders",
    "order_id:i customer:i priority:s price:d2 latitude:s source_year:i",
    """
    SELECT o_orderkey AS order_id, o_custkey AS customer, o_orderpriority AS priority,
      CASE WHEN year(o_orderdate) >= 1997 THEN o_totalprice END AS price, CAST(NULL AS VARCHAR) AS latitude,
      year(o_orderdate) AS source_year FROM orders WHERE year(o_orderdate) >= 1996
    """,
)
def harmonised_orders(spark, d):
    return clean.harmonise(
        _yearly_variants(spark, d), _RENAME, drop=["comment"], required=["latitude"], start_year=1996
    )


@query(
    "adapted_types",
    "event_id:i kind_no:d kind:s props_no:d",
    """
    SELECT event_id, CAST(event_id AS DOUBLE) AS kind_no, CAST(user_id AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS props_no FROM events
    """,
)
def adapted_types(spark, d):
    e = table(spark, d, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("kind_no"),
        F.col("user_id").alias("kind"),
        F.col("props").alias("props_no"),
    )
    return clean.adapt_types(e, numeric=["kind_no", "props_no"], categorical=["kind", "absent"])


@query(
    "adapted_types_auto",
    "o_orderkey:i price:d2 prio:s",
    "SELECT o_orderkey, o_totalprice AS price, o_orderpriority AS prio FROM orders",
)
def adapted_types_auto(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("prio")
    )
    out = clean.adapt_types(o)
    assert dict(out.dtypes)["price"] == "double" and dict(out.dtypes)["prio"] == "string"
    return out


@query(
    "normalised_integers",
    "l_orderkey:i l_linenumber:i half:i",
    """
    SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half FROM lineitem
    """,
)
def normalised_integers(spark, d):
    li = table(spark, d, "lineitem").withColumn("half", (F.col("l_quantity") / 2).cast("string"))
    return clean.normalise_integers(li, ["half"])


@query(
    "cleaned_codes",
    "event_id:i commune:s longitude:d",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN NULL ELSE event_type END AS commune,
      value AS longitude FROM events
    """,
)
def cleaned_codes(spark, d):
    kind = F.col("event_type")
    raw = table(spark, d, "events").select(
        "event_id",
        F.when(kind == "error", "nan").when(kind == "click", "  ").otherwise(F.concat(F.lit(" "), kind, F.lit(" "))).alias(
            "commune"
        ),
        F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("longitude"),
    )
    return clean.clean_codes(raw, ["commune", "longitude"], numeric=["longitude"])


@query(
    "parsed_lists",
    "o_orderkey:i n:i first_item:s last_item:s",
    """
    SELECT o_orderkey,
      CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 3 ELSE 0 END AS n,
      CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN 'a' END AS first_item,
      CASE o_orderstatus WHEN 'F' THEN 'x' WHEN 'O' THEN o_orderpriority END AS last_item FROM orders
    """,
)
def parsed_lists(spark, d):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    text = (
        F.when(s == "F", F.concat(F.lit("['"), p, F.lit("', 'x']")))
        .when(s == "O", F.concat(F.lit("a, b ,, "), p))
        .otherwise(p)
    )
    o = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    items = o.select("o_orderkey", clean.parse_list("text").alias("items"))
    return items.select(
        "o_orderkey",
        F.size("items").alias("n"),
        F.get("items", F.lit(0)).alias("first_item"),
        F.get("items", F.size("items") - 1).alias("last_item"),
    )


# --- rows ---------------------------------------------------------------------------------------


@query(
    "first_order_per_customer",
    "o_custkey:i o_orderkey:i o_totalprice:d2",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1
    """,
)
def first_order_per_customer(spark, d):
    return clean.drop_duplicates(table(spark, d, "orders"), ["o_custkey"], order_by="o_orderkey")


# Two of three orders lose their order value, so some customers have none at all.
_GAPPY = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS seen FROM orders"


@query(
    "first_order_null_dates",
    "o_custkey:i seen:i has_row:b",
    f"SELECT o_custkey, min(seen) AS seen, true AS has_row FROM ({_GAPPY}) AS g GROUP BY 1",
)
def first_order_null_dates(spark, d):
    seen = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", seen.alias("seen"))
    first = clean.drop_duplicates(orders, ["o_custkey"], order_by="seen")
    return first.withColumn("has_row", F.col("o_orderkey").isNotNull())


@query(
    "last_order_per_customer",
    "o_custkey:i o_orderkey:i o_totalprice:d2",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
    """,
)
def last_order_per_customer(spark, d):
    return clean.drop_duplicates(table(spark, d, "orders"), ["o_custkey"], keep="last", order_by="o_orderkey")


@query("distinct_rows", "role:s text:s", "SELECT DISTINCT role, text FROM conversations")
def distinct_rows(spark, d):
    return clean.drop_duplicates(table(spark, d, "conversations").select("role", "text"))


@query(
    "parsed_datetimes",
    "o_orderkey:i placed:t",
    "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END AS placed FROM orders",
)
def parsed_datetimes(spark, d):
    day, s = F.col("o_orderdate"), F.col("o_orderstatus")
    text = (
        F.when(s == "F", F.date_format(day, "dd.MM.yyyy")).when(s == "O", F.date_format(day, "yyyy-MM-dd")).otherwise("?")
    )
    o = table(spark, d, "orders").select("o_orderkey", text.alias("placed"))
    return clean.parse_datetimes(o, ["placed"], ["yyyy-MM-dd", "dd.MM.yyyy"])


_HOLES = """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS q,
    CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS p, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS f,
    CASE WHEN l_returnflag <> 'N' THEN l_tax END AS t FROM lineitem
"""


def _holes(spark, d):
    f = F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(f != "A", F.col("l_quantity")).alias("q"),
        F.when(f != "R", F.col("l_extendedprice")).alias("p"),
        F.when(F.col("l_linestatus") == "O", f).alias("f"),
        F.when(f != "N", F.col("l_tax")).alias("t"),
    )


@query(
    "imputed_values",
    "l_orderkey:i l_linenumber:i q:d p:d f:s t:d",
    f"""
    WITH h AS ({_HOLES}), s AS (SELECT quantile_cont(q, 0.5) AS mq, avg(p) AS mp FROM h),
    m AS (SELECT f FROM h WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(q, mq) AS q, coalesce(p, mp) AS p, coalesce(f, (SELECT f FROM m)) AS f,
      coalesce(t, 0) AS t FROM h CROSS JOIN s
    """,
)
def imputed_values(spark, d):
    h = _holes(spark, d)
    h = clean.impute(h, ["q", "f"], "median")
    return clean.impute(clean.impute(h, ["p"], "mean"), ["t"], "zero")


@query(
    "scaled_and_log",
    "l_orderkey:i l_linenumber:i scaled_q:d log_p:d",
    f"""
    WITH h AS ({_HOLES})
    SELECT l_orderkey, l_linenumber, (q - (SELECT avg(q) FROM h)) / (SELECT stddev_samp(q) FROM h) AS scaled_q,
      ln(1 + greatest(p - 20000, 0)) AS log_p FROM (SELECT * FROM h) AS x
    """.replace("ln(1 + greatest(p - 20000, 0))", "CASE WHEN p IS NOT NULL THEN ln(1 + greatest(p - 20000, 0)) END"),
)
def scaled_and_log(spark, d):
    h = _holes(spark, d).withColumn("shifted", F.col("p") - 20000)
    out = clean.add_log(clean.add_scaled(h, ["q"]), ["shifted"])
    return out.withColumnRenamed("log_shifted", "log_p")


@query(
    "cleaning_plan",
    "o_custkey:i o_orderkey:i q:d scaled_q:d",
    """
    WITH f AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS q FROM orders
               QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
    i AS (SELECT o_custkey, o_orderkey, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM f)) AS q FROM f)
    SELECT *, (q - (SELECT avg(q) FROM i)) / (SELECT stddev_samp(q) FROM i) AS scaled_q FROM i
    """,
)
def cleaning_plan(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("q")
    )
    plan = [
        {"action": "drop_duplicates", "params": {"subset": ["o_custkey"], "order_by": "o_orderkey"}},
        {"action": "impute_nan", "target": ["q"], "params": {"strategy": "median"}},
        {"action": "unknown_action", "target": ["q"]},
        {"action": "handle_skewness", "target": ["q"]},
    ]
    return clean.apply_plan(o, plan)


@query(
    "region_filter",
    "s_suppkey:i department:s region_group:s",
    """
    SELECT * FROM (SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN CAST(970 + s_nationkey AS VARCHAR) END AS department,
      CASE WHEN s_nationkey IN (1, 2, 3, 4, 6) THEN 'dom' ELSE 'metropole' END AS region_group FROM supplier) AS s
    WHERE department IS NULL OR department NOT IN ('971', '972', '973', '974', '975', '976', '977', '978', '986', '987', '988')
    """,
)
def region_filter(spark, d):
    k = F.col("s_nationkey")
    s = table(spark, d, "supplier").withColumn("department", F.when(k > 0, (k + 970).cast("string")))
    return clean.exclude_regions(clean.tag_regions(s, "department"), "department")


@query(
    "repaired_years",
    "o_orderkey:i year:i year_valid:b",
    """
    SELECT o_orderkey, year, year BETWEEN 2000 AND 2035 AS year_valid FROM (
      SELECT o_orderkey, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS year FROM (
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) % 100 ELSE year(o_orderdate) END AS y FROM orders) AS a) AS b
    """,
)
def repaired_years(spark, d):
    y = F.year("o_orderdate")
    o = table(spark, d, "orders").withColumn("year", F.when(F.col("o_orderstatus") == "F", y % 100).otherwise(y))
    return clean.repair_year(o, "year")


@query(
    "clipped_rows",
    "l_orderkey:i l_linenumber:i q:d p:d",
    f"SELECT l_orderkey, l_linenumber, least(q, 30) AS q, least(p, 50000) AS p FROM ({_HOLES}) AS h WHERE q IS NOT NULL AND p IS NOT NULL",
)
def clipped_rows(spark, d):
    return clean.clip_upper(_holes(spark, d).dropna(subset=["q", "p"]), {"q": 30, "p": 50000})


@query(
    "normalised_names",
    "order_key:i total_price:d2 o:s",
    "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS o FROM orders",
)
def normalised_names(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias(" Order Key"),
        F.col("o_totalprice").alias("Total Price "),
        F.col("o_orderstatus").alias("O|status"),
    )
    return clean.cut_names(clean.normalise_names(o), "|")


@query(
    "required_columns",
    "role:s column:s",
    """
    SELECT * FROM (VALUES ('primary_key', 'o_orderkey'), ('datetime', 'o_orderdate')) AS v(role, "column")
    WHERE (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) = 0
    """,
)
def required_columns(spark, d):
    o = table(spark, d, "orders")
    keys = tables.key_validation(o, "o_orderkey").where("unique").select(
        F.lit("primary_key").alias("role"), F.lit("o_orderkey").alias("column")
    )
    others = o.agg(F.max("o_orderdate").alias("m")).select(
        F.explode(
            F.array(
                *[
                    F.named_struct(F.lit("role"), F.lit(r), F.lit("column"), F.lit(c))
                    for r, c in [("datetime", "o_orderdate"), ("datetime", "o_orderdate"), ("note", "o_orderstatus")]
                ]
            )
        ).alias("f")
    )
    return clean.required_columns(keys.unionByName(others.select("f.*")))


# --- joins, sets, sorting, sampling -------------------------------------------------------------


@query(
    "feature_inner_join",
    "event_id:i lat:d lon:d ts:t",
    f"SELECT event_id, lat, lon, ts FROM ({PLACED_EVENTS}) AS p",
)
def feature_inner_join(spark, d):
    e = placed_events(spark, d)
    return relational.join_all([e.select("event_id", "lat", "lon"), e.select("event_id", "ts")], ["event_id"])


@query(
    "n_way_join",
    "o_orderkey:i note_0:s note_1:s l_linenumber:i l_quantity:d",
    """
    SELECT o.o_orderkey, o.o_orderstatus AS note_0, l.l_returnflag AS note_1, l.l_linenumber, l.l_quantity
    FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
    """,
)
def n_way_join(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderstatus", "note")
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "o_orderkey", "l_returnflag": "note"})
    orders = relational.Side(o, without=("o_totalprice",), renamed={"note": "note_0"})
    items = relational.Side(li, without=("l_shipdate",), renamed={"note": "note_1"})
    return relational.join_all([orders, items], ["o_orderkey"], how="left")


@query(
    "natural_join",
    "s_suppkey:i n_name:s r_name:s",
    """
    SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    """,
)
def natural_join(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    return relational.natural_join([s, n, r])


@query(
    "left_join_chain",
    "o_orderkey:i n_lines:i max_price:d2 late:i",
    """
    SELECT o_orderkey, n_lines, max_price, late FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey
    LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS max_price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b
      ON o_orderkey = b.l_orderkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS late FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-01-01' GROUP BY 1) c
      ON o_orderkey = c.l_orderkey
    """,
)
def left_join_chain(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    late = li.where(F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp_ntz"))
    parts = [
        li.groupBy("o_orderkey").agg(F.count("*").alias("n_lines")),
        li.where(F.col("l_returnflag") == "R").groupBy("o_orderkey").agg(F.max("l_extendedprice").alias("max_price")),
        late.groupBy("o_orderkey").agg(F.count("*").alias("late")),
    ]
    return relational.left_join_chain(table(spark, d, "orders"), parts, "o_orderkey")


@query(
    "update_from_join",
    "o_orderkey:i o_totalprice:d2 cell:s",
    """
    SELECT o_orderkey, coalesce(s, o_totalprice) AS o_totalprice, CASE WHEN s IS NOT NULL THEN 'new' END AS cell FROM orders
    LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) u ON o_orderkey = l_orderkey
    """,
)
def update_from_join(spark, d):
    return relational.update_from(
        table(spark, d, "orders"), _returned(spark, d), "o_orderkey", ["o_totalprice", "cell"]
    )


@query(
    "value_mapping",
    "o_orderkey:i priority_no:i",
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS priority_no FROM orders
    """,
)
def value_mapping(spark, d):
    return relational.map_values(
        table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": 1, "2-HIGH": 2}, "priority_no"
    )


@query(
    "top_rows",
    "o_orderkey:i o_totalprice:d2",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20",
)
def top_rows(spark, d):
    return relational.top_rows(
        table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"], 20
    )


def hash_sql(*parts: str, seed: int = 42) -> str:
    text = " || '|' || ".join([*[f"CAST({p} AS VARCHAR)" for p in parts], f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


@query(
    "random_sample",
    "l_orderkey:i l_linenumber:i",
    f"""
    SELECT l_orderkey, l_linenumber FROM lineitem
    ORDER BY {hash_sql('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 20000
    """,
)
def random_sample(spark, d):
    return relational.sample_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 20000)


@query(
    "key_sets",
    "common:i only_a:i only_b:i",
    """
    WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'),
    b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '2-HIGH')
    SELECT (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS common, (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS only_a,
      (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS only_b
    """,
)
def key_sets(spark, d):
    o, p = table(spark, d, "orders"), F.col("o_orderpriority")
    return relational.key_overlap(o.where(p == "1-URGENT"), o.where(p == "2-HIGH"), "o_custkey")


@query(
    "outlier_slice",
    "event_type:s n:i",
    """
    SELECT event_type, count(*) AS n FROM events WHERE value NOT BETWEEN 1 AND 200 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3
    """,
)
def outlier_slice(spark, d):
    out = table(spark, d, "events").where(~F.col("value").between(1, 200))
    return out.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("yearly_union", "o_orderkey:i year:i", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def yearly_union(spark, d):
    folder = scratch_path(spark, "orders-by-year")
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    files.write_parquet(o, folder, partition_by=["year"])
    # One scan over all listed folders, whatever years there are.
    return files.read_union(spark, list(files.list_folder(spark, folder).values()), base=folder)
