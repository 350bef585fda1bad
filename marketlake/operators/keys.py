"""Normalised keys and attributes of listings, from their text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import col, non_blank

# Patterns and word lists that decide keys and attributes.
ID_IN_EXTRA = r'(?i)"(?:internalname|id|item_id|itemId)"\s*:\s*"([^"]+)"'
ONLY_ID_IN_EXTRA = r'(?i)^\s*\{\s*"(?:internalname|id|item_id|itemId)"\s*:\s*"[^"]+"\s*\}\s*$'
PET_LEVEL = r"^\[Lvl\s*(\d+)\]\s*(.+)$"
ENCHANT = r"\b[A-Z][A-Z'\- ]{2,}\s+[IVXLCDM]{1,6}\b"
STAR_WORD = r"(?i)(\d+)\s*-?\s*STAR"
MODIFIER = r"(?i)\bmodifier\s*:\s*([a-z\- '\\]+)"
GLYPH = "✪"
REFORGES = """WITHERED HEROIC FABLED SPIRITUAL PRECISE SUSPICIOUS GILDED ANCIENT GIANT NECROTIC LOVING RENOWNED BLOODY SHADED
WARPED DIRTY MOIL REFINED BLESSED AUSPICIOUS MITHRAIC JADED FLEET SPICY SHARP LEGENDARY ODD FAST FAIR EPIC GENTLE TOIL
BOUNTIFUL STELLAR HEADSTRONG UNDEAD CANDIED""".split()
GEMS = "RUBY AMETHYST JADE SAPPHIRE AMBER TOPAZ JASPER OPAL ONYX AQUAMARINE CITRINE PERIDOT".split()
SLOTS = "COMBAT DEFENSIVE MINING UNIVERSAL".split()


def identifier(x: Column | str) -> Column:
    """Trimmed, upper case, without a pet level, spaces as underscores; empty where blank."""
    upper = F.upper(F.trim(F.coalesce(col(x), F.lit(""))))
    return F.replace(F.regexp_replace(upper, r"^\[LVL\s*\d+\]\s*", ""), F.lit(" "), F.lit("_"))


def glyphs(x: Column | str) -> Column:
    x = F.coalesce(col(x), F.lit(""))
    return F.length(x) - F.length(F.replace(x, F.lit(GLYPH), F.lit("")))


def _id_in_extra(extra: Column) -> Column:
    """The first id of the text with escaped quotes undone, else of the text as it is."""
    tries = []
    for text in (F.replace(extra, F.lit('\\"'), F.lit('"')), extra):
        tries.append(F.nullif(identifier(F.replace(F.regexp_extract(text, ID_IN_EXTRA, 1), F.lit("\\"), F.lit(""))), F.lit("")))
    return F.coalesce(*tries)


def key_parts(df: DataFrame) -> DataFrame:
    """Adds base_id, key_tier, key_category, pet_level, stars, recombobulated."""
    name = F.trim(F.coalesce("item_name", F.lit("")))
    pet = F.regexp_extract(name, PET_LEVEL, 1)
    base = F.when(name == "", "UNKNOWN").when(pet != "", F.trim(F.regexp_extract(name, PET_LEVEL, 2))).otherwise(name)
    blank = lambda c: F.nullif(c, F.lit(""))
    return df.withColumns({
        "base_id": F.coalesce(_id_in_extra(F.col("extra")), blank(identifier(base)), blank(identifier("item_name")), F.lit("")),
        "key_tier": F.coalesce(blank(identifier("tier")), F.lit("UNKNOWN")),
        "key_category": F.coalesce(blank(identifier("category")), F.lit("UNKNOWN")),
        "pet_level": F.coalesce(blank(F.regexp_replace(pet, r"^0+(?=\d)", "")), F.lit("-")),
        "stars": (glyphs("item_name") + glyphs("item_lore")).cast("int"),
        "recombobulated": F.coalesce(F.contains(F.lower("item_lore"), F.lit("rarity upgraded")),
            F.lit(False)) | F.coalesce(F.contains(F.lower("extra"), F.lit("recombobulated")), F.lit(False)),
    })


def agg_key() -> Column:
    return F.concat("base_id", F.lit("|T:"), "key_tier", F.lit("|C:"), "key_category", F.lit("|P:"), "pet_level")


def full_key() -> Column:
    return F.concat(agg_key(), F.lit("|S:"), F.col("stars").cast("string"), F.lit("|R:"),
        F.col("recombobulated").cast("int").cast("string"))


def has_additionals() -> Column:
    """Stars, recombobulation, an enchantment in the lore, or extra data besides an id; both readings of extra must be a bare id."""
    lore = F.upper(F.regexp_replace(F.coalesce("item_lore", F.lit("")), "§.", " "))
    extra = F.col("extra")
    bare = F.replace(extra, F.lit('\\"'), F.lit('"')).rlike(ONLY_ID_IN_EXTRA) & extra.rlike(ONLY_ID_IN_EXTRA)
    return (F.col("stars") > 0) | F.col("recombobulated") | lore.rlike(ENCHANT) | F.coalesce((F.trim(extra) != "") & ~bare, F.lit(False))


def listing_keys(df: DataFrame) -> DataFrame:
    parts = key_parts(df)
    return parts.withColumns({"listing_key": full_key(), "agg_key": agg_key(), "has_additionals": has_additionals()})


def comparable(df: DataFrame) -> DataFrame:
    """The parts that make listings comparable; low_confidence where extra names no id."""
    return key_parts(df).withColumn("low_confidence", _id_in_extra(F.col("extra")).isNull())


def unique_output_keys(df: DataFrame) -> DataFrame:
    """Adds output_key: the base id for its first key, then `base [tier/category]`, then that with #n. Order: tier, category, pet level, stars, recombobulation."""
    order = ["key_tier", "key_category", "pet_level", "stars", "recombobulated"]
    n = F.row_number().over(Window.partitionBy("base_id").orderBy(*order))
    df = df.withColumn("__n", n)
    # the first of a base takes the bare key and no place among the bracketed ones
    first = (F.col("__n") == 1).cast("int")
    m = F.row_number().over(Window.partitionBy("base_id", "key_tier", "key_category", first).orderBy(*order))
    bracket = F.concat("base_id", F.lit(" ["), "key_tier", F.lit("/"), "key_category", F.lit("]"))
    key = F.when(F.col("__n") == 1, F.col("base_id")).when(m == 1, bracket).otherwise(F.concat(bracket, F.lit(" #"), m.cast("string")))
    return df.withColumn("output_key", key).drop("__n")


def star_count(name: Column | str) -> Column:
    n = glyphs(name)
    word = F.regexp_extract(F.coalesce(col(name), F.lit("")), STAR_WORD, 1)
    return F.least(F.lit(5), F.when(n > 0, n).otherwise(F.coalesce(word.try_cast("int"), F.lit(0)))).cast("int")


def reforge(name: Column | str, lore: Column | str) -> Column:
    """From `modifier:` in the lore, else a listed word that leads the name or stands alone between brackets and commas, else None."""
    plain = F.regexp_replace(F.coalesce(col(lore), F.lit("")), "§.", "")
    raw = F.trim(F.regexp_replace(F.regexp_extract(plain, MODIFIER, 1), r"[^A-Za-z'\- ]", " "))
    words = F.transform(F.filter(F.split(raw, r"\s+"), lambda w: w != ""),
        lambda w: F.array_join(F.transform(F.split(w, "-"), F.initcap), "-"))
    upper = F.upper(F.trim(F.coalesce(col(name), F.lit(""))))
    listed = F.array(*map(F.lit, REFORGES))
    lead = F.regexp_extract(upper, "^(" + "|".join(REFORGES) + ") ", 1)
    alone = F.filter(F.transform(F.split(upper, "[(),]"), lambda s: F.replace(F.trim(s), F.lit("'"), F.lit(""))),
        lambda s: F.array_contains(listed, s))
    return F.coalesce(F.when(raw != "", F.array_join(words, " ")), F.initcap(F.nullif(lead, F.lit(""))),
        F.initcap(F.try_element_at(alone, F.lit(1))), F.lit("None"))


def gem_slots(name: Column | str, lore: Column | str) -> Column:
    """Slot and gem names of the lore, else of the name, in their fixed order."""

    def found(text: Column, gem: str, slot: str) -> Column:
        # one pass over the text; endings are looked at, not taken, as the next name may begin in them
        named = F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(SLOTS)})(?= (?:{slot}))|(?:{'|'.join(GEMS)})(?= (?:{gem}))"), F.lit(0))
        return F.transform(F.array_intersect(F.array(*map(F.lit, SLOTS + GEMS)), named), F.initcap)

    in_lore = found(F.upper(F.regexp_replace(F.coalesce(col(lore), F.lit("")), "§.", "")), "SLOT|GEMSTONE", "SLOT")
    in_name = found(F.upper(F.trim(F.coalesce(col(name), F.lit("")))), "SLOT|GEMSTONE", "SLOT|GEMSTONE SLOT")
    return F.when(F.size(in_lore) > 0, in_lore).otherwise(in_name)


def to_listing(df: DataFrame) -> DataFrame:
    value = F.when(F.col("highest_bid") > 0, F.col("highest_bid")).otherwise(F.col("starting_bid"))
    return df.select("auction_uuid", "item_name", "tier", "category", "bin", "claimed", "starting_bid", "highest_bid", "end_ts",
        star_count("item_name").alias("star_count"), reforge("item_name", "item_lore").alias("reforge"),
        gem_slots("item_name", "item_lore").alias("gem_slots"), value.alias("estimated_value"))


def aliases(items: DataFrame) -> DataFrame:
    """(item_id, alias): id, display name and minecraft id, upper case, with and without separators."""
    names = F.filter(F.transform(F.array("item_id", "display_name", "minecraft_id"), lambda x: F.upper(F.trim(x))),
        lambda x: x.isNotNull() & (x != ""))
    compact = F.transform(names, lambda x: F.regexp_replace(x, "[_ ]", ""))
    return items.select("item_id", F.explode(F.array_distinct(F.concat(names, compact))).alias("alias"))


def _grams(text: Column, q: Column | int) -> Column:
    """The distinct runs of q characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - q + 1)), lambda i: F.substring(text, i, F.lit(q))))


def match_items(listings: DataFrame, alias_table: DataFrame, q: int = 3) -> DataFrame:
    """(item_name, item_id): distinct listing names, as they are or compact, that contain an alias.

    A name is cut into its runs of one to q characters, q rows a character. An alias, being of q characters or more, is looked
    up by one of its q-grams, the one that fewest names have; a shorter one by itself. What meets is then verified. Aliases with
    a gram that no name has are gone before, and no frequent beginning makes a hot key.
    """
    names = listings.select("item_name").distinct().withColumn("__u", F.upper(F.trim("item_name")))
    compact = F.regexp_replace("__u", "[_ ]", "")
    forms = names.select("item_name", F.explode(F.array_distinct(F.array("__u", compact))).alias("__f")).filter("__f <> ''")
    runs = F.array_distinct(F.flatten(F.array(*[F.when(F.length("__f") >= k, _grams(F.col("__f"), k)).otherwise(F.array().cast("array<string>"))
        for k in range(1, q + 1)])))
    cut = forms.select("item_name", "__f", F.explode(runs).alias("__g"))
    seen = cut.groupBy("__g").agg(F.count("*").alias("__n"))
    known = alias_table.filter("alias <> ''").select("alias").distinct().withColumn("__gs", _grams(F.col("alias"), F.least(F.lit(q), F.length("alias"))))
    own = known.select("alias", F.size("__gs").alias("__k"), F.explode("__gs").alias("__g")).join(seen.hint("merge"), "__g")
    rarest = own.groupBy("alias", "__k").agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g"), F.count("*").alias("__have")).filter("__have = __k")
    met = cut.join(rarest.select("alias", "__g").hint("merge"), "__g").filter(F.contains("__f", "alias")).select("item_name", "alias").distinct()
    return met.join(alias_table.select("alias", "item_id").hint("merge"), "alias").select("item_name", "item_id").distinct()
