"""File sources and sinks: payloads, catalogue files, snapshot tables and JSON lines.

All paths go through Spark's readers, so that any store Spark reads will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import epoch_day

LISTING = "uuid string, item_name string, category string, tier string, starting_bid long, highest_bid_amount long, start long, `end` long, claimed boolean, bin boolean, item_lore string, extra string"
PAGE = f"success boolean, page int, totalPages int, totalAuctions int, lastUpdated long, auctions array<struct<{LISTING.replace('`end` long', '`end`: bigint').replace(' string', ': string').replace(' long', ': bigint').replace(' boolean', ': boolean')}>>"
QUICK = "productId string, buyPrice double, sellPrice double, buyVolume long, sellVolume long, buyMovingWeek long, sellMovingWeek long, buyOrders int, sellOrders int"
LEVEL = "struct<amount: bigint, pricePerUnit: double, orders: int>"
PRODUCT = f"struct<quick_status: struct<{', '.join(': '.join(x.strip().split(' ')) for x in QUICK.split(',')).replace(': long', ': bigint')}>, buy_summary: array<{LEVEL}>, sell_summary: array<{LEVEL}>>"
CATALOG = "id string, internalname string, displayname string, itemid string, nbttag string, petInfo string, lore array<string>, info array<string>, recipe map<string,string>, recipes array<map<string,string>>"


def read_listing_pages(spark: SparkSession, path: str) -> DataFrame:
    return listings_of_pages(spark.read.schema(PAGE).json(path))


def parse_listing_pages(df: DataFrame, json: str = "value") -> DataFrame:
    return listings_of_pages(df.select(F.from_json(json, PAGE).alias("p")).select("p.*"))


def listings_of_pages(pages: DataFrame) -> DataFrame:
    """Rows of updates all of whose pages are there; an update with a page missing has none, so that it never looks like an empty market."""
    pages = pages.filter("success")
    seen = pages.groupBy("lastUpdated", "page").agg(F.max("totalPages").alias("total"))
    # numbers alone meet by update; the pages, which are large and many an update, are dealt once, by update and page (nulls included)
    w, key = Window.partitionBy("lastUpdated"), F.struct("lastUpdated", "page").alias("__update_page")
    seen = seen.withColumn("ok", F.count("page").over(w) == F.max("total").over(w)).filter("ok")
    wanted = seen.select(key).repartition("__update_page")
    kept = pages.select(key, "lastUpdated", "auctions").repartition("__update_page").join(wanted, "__update_page", "left_semi").dropDuplicates(["__update_page"])
    e = kept.select(F.col("lastUpdated").alias("snapshot_ts"), F.explode("auctions").alias("a"))
    return e.select("snapshot_ts", F.col("a.uuid").alias("auction_uuid"), "a.item_name", "a.category", "a.tier", "a.starting_bid",
        F.col("a.highest_bid_amount").alias("highest_bid"), F.col("a.start").alias("start_ts"), F.col("a.end").alias("end_ts"), "a.claimed",
        "a.bin", "a.item_lore", "a.extra")


def parse_quote_payload(df: DataFrame, json: str = "value") -> DataFrame:
    """Rows of a product map; a blank product id falls back to the map's key, products without quick status go."""
    j = df.select(F.from_json(json, f"struct<success: boolean, lastUpdated: bigint, products: map<string, {PRODUCT}>>").alias("p"))
    e = j.filter("p.success").select(F.col("p.lastUpdated").alias("snapshot_ts"),
        F.explode("p.products").alias("k", "v")).filter("v.quick_status IS NOT NULL")
    qs = lambda c: F.col(f"v.quick_status.{c}")
    return e.select("snapshot_ts", F.coalesce(F.nullif(F.trim(qs("productId")), F.lit("")), "k").alias("product_id"),
        qs("buyPrice").alias("buy_price"), qs("sellPrice").alias("sell_price"), qs("buyVolume").alias("buy_volume"),
        qs("sellVolume").alias("sell_volume"), qs("buyMovingWeek").alias("buy_moving_week"), qs("sellMovingWeek").alias("sell_moving_week"),
        F.col("v.buy_summary").alias("buy_summary"), F.col("v.sell_summary").alias("sell_summary"))


def read_quote_payload(spark: SparkSession, path: str) -> DataFrame:
    return parse_quote_payload(spark.read.text(path, wholetext=True))


def order_book(payload: DataFrame, product_id: str, depth: int = 10) -> DataFrame:
    """(side, level, price, amount, orders): the payload's buy summary is what sellers ask, and the other way round."""
    p = payload.filter(F.col("product_id") == product_id)
    out = None
    for side, c in (("sell", "buy_summary"), ("buy", "sell_summary")):
        e = p.select("snapshot_ts", F.lit(side).alias("side"), F.posexplode(F.slice(c, 1, depth)).alias("level", "o")).select("snapshot_ts",
            "side", "level", F.col("o.pricePerUnit").alias("price"), F.col("o.amount").alias("amount"), F.col("o.orders").alias("orders"))
        out = e if out is None else out.unionByName(e)
    return out


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file; malformed files are left out."""
    return parse_catalog(spark.read.text(path, wholetext=True))


def parse_catalog(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("value", CATALOG).alias("c")).select("c.*").filter("coalesce(id, internalname) IS NOT NULL")


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files below a path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def catalog_fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest of all files, whatever their order. files: name, content.

    Digests of (name, content) are put in order and digested within 4,096 groups, by their first digits, and the groups' digests again.
    """
    lines = lambda c: F.concat_ws("\n", F.array_sort(F.collect_list(c)))
    each = files.select(F.sha2(F.concat_ws(":", "name", F.sha2("content", 256)), 256).alias("h"))
    groups = each.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sha2(lines("h"), 256).alias("h"), F.count("*").alias("n"))
    return groups.agg(F.sha2(lines(F.concat_ws(":", "g", "h")), 256).alias("fingerprint"), F.sum("n").alias("files"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a local one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="spark-tables-")
    return f"{named}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in a new shared folder, read again: what several parts of a plan read is computed once."""
    to = shared_folder(df.sparkSession)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def write_lines(texts: DataFrame, path: str) -> None:
    """Large texts, such as pages, a line each: they are read again line by line, where a batch of Parquet rows would hold thousands at once."""
    texts.write.option("compression", "snappy").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store that Spark reads has the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in store.listStatus(at)] if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType | None) -> DataFrame | None:
    """A Parquet table that may not have been written yet: then no rows, or None where no schema is given."""
    if exists(spark, path):
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return None if schema is None else spark.createDataFrame([], schema)


def write_snapshots(df: DataFrame, path: str, mode: str = "append") -> None:
    df.withColumn("day", epoch_day("snapshot_ts")).write.mode(mode).partitionBy("day").parquet(path)


def overwrite_buckets(df: DataFrame, path: str) -> None:
    """Replaces the days that df has rows of, and no others: a rollup can be run again."""
    df.withColumn("day", epoch_day("bucket_start")).write.mode("overwrite").option("partitionOverwriteMode",
        "dynamic").partitionBy("granularity", "day").parquet(path)


def parse_snapshot_json(df: DataFrame, json: str = "products_json") -> DataFrame:
    """Raw snapshot rows with their products as JSON text, as rows."""
    j = df.select("snapshot_ts", F.from_json(json, "map<string, struct<buyPrice: double, sellPrice: double>>").alias("m"))
    return j.select("snapshot_ts", F.explode_outer("m").alias("product_id", "v")).select("snapshot_ts", "product_id",
        F.col("v.buyPrice").alias("buy_price"), F.col("v.sellPrice").alias("sell_price"))


def read_history(lines: DataFrame, schema: str, limit: int, ts: str = "ts") -> DataFrame:
    """The newest rows of JSON lines, malformed ones left out; of one time the least by the other columns."""
    j = lines.select(F.from_json("value", schema).alias("r")).select("r.*").filter(F.col(ts).isNotNull())
    return j.orderBy(F.desc(ts), *[c for c in j.columns if c != ts]).limit(limit)


def partition_inventory(df: DataFrame) -> DataFrame:
    """(day, rows, files) of a table partitioned by day."""
    return df.select("day", F.input_file_name().alias("f")).groupBy("day").agg(F.count("*").alias("rows"),
        F.countDistinct("f").alias("files"))


# catalogue: grid cells of a recipe
CELLS = [f"{r}{c}" for r in "ABC" for c in "123"]


def _stack(text: Column) -> Column:
    """`ID:n` as (item, amount), amount 1 by default."""
    parts = F.split(text, ":")
    return F.struct(F.nullif(F.trim(parts[0]), F.lit("")).alias("item_id"),
        F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(1)).alias("amount"))


def catalog_items(catalog: DataFrame) -> DataFrame:
    item = F.upper(F.trim(F.coalesce(F.nullif(F.trim("id"), F.lit("")), "internalname")))
    links = F.filter(F.coalesce("info", F.array().cast("array<string>")), lambda x: x.startswith("http://") | x.startswith("https://"))
    return catalog.select(item.alias("item_id"), F.coalesce("displayname", item).alias("display_name"),
        F.col("itemid").alias("minecraft_id"), F.array_join("lore", "\n").alias("lore"), links.alias("info_links")).filter("item_id <> ''")


def useful_items(catalog: DataFrame) -> DataFrame:
    """Items with a craft, forge or upgrade recipe, pets and shards."""
    item = F.upper(F.trim(F.coalesce("id", "internalname")))
    kind = lambda r: F.lower(F.coalesce(r["type"], F.lit("")))
    made = F.coalesce(F.exists("recipes", lambda r: kind(r).isin("forge", "crafting", "craft", "katgrade") | r["slots"].isNotNull()),
        F.lit(False))
    grid = F.coalesce(F.size(F.array_intersect(F.map_keys("recipe"), F.array(*map(F.lit, CELLS)))) > 0, F.lit(False))
    return catalog.filter(made | grid | item.rlike(";[0-4]$") | F.col("petInfo").isNotNull() | F.contains(item, F.lit("SHARD")))


def catalog_recipes(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipes, ingredients): the grid and listed recipes of each item; cells of an item are summed."""
    item = F.upper(F.trim(F.coalesce("id", "internalname")))
    grid = catalog.filter("recipe IS NOT NULL").select(item.alias("item"), F.lit(-1).alias("pos"),
        F.map_concat("recipe", F.create_map(F.lit("type"), F.lit("crafting"))).alias("r"))
    listed = catalog.select(item.alias("item"), F.posexplode("recipes").alias("pos", "r"))
    both = grid.unionByName(listed)
    kind = F.lower(F.coalesce(F.col("r")["type"], F.lit("")))
    cells = F.array_compact(F.array(*[F.nullif(F.trim(F.col("r")[c]), F.lit("")) for c in CELLS]))
    as_list = lambda k: F.from_json(F.col("r")[k], "array<string>")
    own = F.coalesce(as_list("inputs"), as_list("slots"), as_list("items"))
    upgrade = F.array_compact(F.concat(F.array(F.col("r")["input"]), F.coalesce(as_list("items"), F.array().cast("array<string>"))))
    process = F.when(kind == "forge", "FORGE").when(kind == "katgrade", "KATGRADE").when(F.size(cells) > 0,
        "CRAFT").when(kind.isin("crafting", "craft"), "CRAFT")
    parts = F.when(process == "FORGE", own).when(process == "KATGRADE", upgrade).when(F.size(cells) > 0, cells).otherwise(as_list("slots"))
    seconds = F.greatest(F.lit(0),
        F.coalesce(*[F.col("r")[k].try_cast("long") for k in ("duration", "time", "forgeTime", "craftTime")], F.lit(0)))
    t = both.withColumn("process_type",
        process).filter("process_type IS NOT NULL").withColumns({"parts": parts, "process_duration_seconds": seconds})
    n = F.row_number().over(Window.partitionBy("item", "process_type").orderBy("pos")) - 1
    t = t.withColumn("recipe_id", F.concat_ws(":", "item", "process_type", n.cast("string")))
    out = F.coalesce(F.nullif(F.trim(F.col("r")["overrideOutputId"]), F.lit("")), F.nullif(F.trim(F.col("r")["output"]), F.lit("")), "item")
    recipes = t.select("recipe_id", F.split(out, ":")[0].alias("output_item_id"), "process_type", "process_duration_seconds")
    e = t.select("recipe_id", F.explode("parts").alias("p")).select("recipe_id", _stack(F.col("p")).alias("s")).select("recipe_id",
        "s.*").filter("item_id IS NOT NULL")
    return recipes, e.groupBy("recipe_id", F.upper("item_id").alias("item_id")).agg(F.sum("amount").alias("amount"))


def npc_offers(catalog: DataFrame) -> DataFrame:
    """(item_id, result_id, amount, coin_cost, unit_cost) of shop recipes; coins are the cost entries of SKYBLOCK_COIN."""
    e = catalog.select(F.upper(F.trim(F.coalesce("id", "internalname"))).alias("item_id"),
        F.explode("recipes").alias("r")).filter(F.lower(F.col("r")["type"]) == "npc_shop")
    costs = F.transform(F.from_json(F.col("r")["cost"], "array<string>"), _stack)
    coins = F.aggregate(costs, F.lit(0).cast("long"),
        lambda a, x: a + F.when(F.upper(x["item_id"]) == "SKYBLOCK_COIN", x["amount"]).otherwise(0))
    s = e.select("item_id", _stack(F.col("r")["result"]).alias("o"), F.nullif(coins, F.lit(0).cast("long")).alias("coin_cost"))
    return s.select("item_id", F.upper("o.item_id").alias("result_id"), F.col("o.amount").alias("amount"), "coin_cost",
        (F.col("coin_cost") / F.col("o.amount")).alias("unit_cost"))
