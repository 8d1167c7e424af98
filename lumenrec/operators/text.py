"""Item text, image references and their alignment with item ids."""

from __future__ import annotations

import html
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "N/A"

#: What HTML reads for low code points: Windows-1252 for most between 128 and 159, nothing for most control characters.
_LOW = {str(n): html.unescape(f"&#{n};") for n in range(160)}
#: Entities that stand in most texts; asked before the map of all.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "#39;")
#: Names that count without a semicolon too, and so as the start of a longer one.
_SHORT = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)
_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _looked_up(entries: dict[str, str], name: Column, buckets: int = 64) -> Column:
    """The entry of a name, or null. Maps are searched one by one, so the entries are many small constant maps, chosen by CRC-32."""
    parts: list[list[str]] = [[] for _ in range(buckets)]
    for k, v in entries.items():
        parts[crc32(k.encode()) % buckets].append(f"{k}\x02{v}")
    maps = F.array(*[F.str_to_map(F.lit("\x01".join(p)), F.lit("\x01"), F.lit("\x02")) for p in parts])
    return F.try_element_at(F.get(maps, F.crc32(name) % buckets), name)


def _character(n: Column) -> Column:
    """The text of a code point, by its UTF-8 bytes; null stands for one beyond any."""
    six = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(63))
    two = F.lit(0xC080) + F.shiftright(n, 6) * 256 + six(0)
    three = F.lit(0xE08080) + F.shiftright(n, 12) * 65536 + six(6) * 256 + six(0)
    four = F.lit(0xF0808080) + F.shiftright(n, 18) * (1 << 24) + six(12) * 65536 + six(6) * 256 + six(0)
    raw = F.when(n < 0x800, F.hex(two)).when(n < 0x10000, F.hex(three)).otherwise(F.hex(four))
    nothing = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    unknown = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(unknown, F.lit("\ufffd")).when(n < 160, _looked_up(_LOW, n.cast("string"))).when(nothing, F.lit("")).otherwise(F.decode(F.unhex(raw), "utf-8"))


def _entity(name: Column) -> Column:
    """What stands for &name: a character reference by number, a name, or the longest start of it that is one."""
    digits = F.regexp_extract(name, "^#[xX]?0*([0-9a-fA-F]*)", 1)  # nine or more are beyond any code point
    number = F.when(F.length(digits) < 9, F.when(name.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10)).otherwise(F.concat(F.lit("0"), digits)).cast("long"))
    starts = [F.when(F.length(name) > n, F.concat(_looked_up(html5, F.left(name, F.lit(n))), F.substring(name, n + 1, 1 << 30))) for n in _SHORT]
    found = F.when(name.startswith("#"), _character(number))
    for n in _COMMON:
        if n in html5:
            found = found.when(name == n, F.lit(html5[n]))
    return found.otherwise(F.coalesce(_looked_up(html5, name), *starts, F.concat(F.lit("&"), name)))


def unescape(text: Column) -> Column:
    """Character references of HTML as characters, as html.unescape reads them; usable inside transform()."""
    pieces = F.split(text, "&", -1)
    # what follows each & begins with an entity's name, or not
    named = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.struct(p.alias("p"), F.regexp_extract(p, _ENTITY, 1).alias("n")))
    read = F.transform(named, lambda x: F.concat(F.when(x["n"] == "", F.lit("&")).otherwise(_entity(x["n"])), F.substring(x["p"], F.length(x["n"]) + 1, F.length(x["p"]))))
    return F.when(text.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(read, ""))).otherwise(text)


def clean_text(text: Column, entities: bool = True) -> Column:
    """HTML entities resolved, tags removed, white space runs as one space, no double quotes, trimmed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    if entities:
        text = unescape(text)
    text = F.regexp_replace(text, "<[^>]+>", "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(text, '"', ""))


def clean_list(parts: Column) -> Column:
    return clean_text(F.array_join(parts, " "))


def clean_map(entries: Column) -> Column:
    return clean_text(F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", "))


def build_item_text(ids: DataFrame, metadata: DataFrame, fields: list[str], entities: bool = True) -> DataFrame:
    """item, idx, text: the cleaned fields joined by spaces, N/A where there is no metadata or nothing in it. A null field of present metadata reads None."""
    rows = ids.join(metadata.withColumn("_has", F.lit(True)), "item", "left")

    def part(c: str) -> Column:
        if isinstance(metadata.schema[c].dataType, T.ArrayType):
            present = F.filter(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), lambda x: x.rlike(r"(?U)\S"))
            return F.array_join(F.transform(present, lambda x: clean_text(x, entities)), ", ")
        return clean_text(F.coalesce(F.col(c).cast("string"), F.lit("None")), entities)

    text = F.concat_ws(" ", *[F.nullif(part(c), F.lit("")) for c in fields])
    return rows.select("item", "idx", F.coalesce(F.when(F.col("_has"), F.nullif(text, F.lit(""))), F.lit(MISSING)).alias("text"))


def select_image_urls(metadata: DataFrame) -> DataFrame:
    """item, urls, files: web addresses of the list, or else of the single one; file names are the last 200 characters of the base name."""
    urls = F.filter(F.when(F.size("images") > 0, F.col("images")).otherwise(F.array("image")), lambda u: u.startswith("http"))
    return metadata.select("item", urls.alias("urls")).withColumn("files", F.transform("urls", lambda u: F.right(F.regexp_extract(u, "([^/]*)$", 1), F.lit(200))))


def reviewed_items(metadata: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The metadata of items with a review; all of it without reviews."""
    return metadata if reviews is None else metadata.join(reviews.select("item").distinct(), "item", "left_semi")


def image_coverage(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: items, items without images, coverage."""
    rows = items.select("item").distinct().join(manifest, "item", "left")
    none = F.count_if(F.coalesce(F.size("files"), F.lit(0)) <= 0)
    return rows.agg(F.count("*").alias("items"), none.alias("without"), (1 - none / F.count("*")).alias("coverage"))


def alignment_rows(ids: DataFrame, metadata: DataFrame, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """item, idx, has_meta, has_image, has_file: whether the first image's file is listed."""
    rows = ids.join(metadata.select("item", F.lit(True).alias("m")), "item", "left").join(manifest.select("item", F.get("files", F.lit(0)).alias("name")), "item", "left")
    rows = rows.join(listing.select("name", F.lit(True).alias("f")).distinct(), "name", "left")
    there = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("item", "idx", there(F.col("m")).alias("has_meta"), F.col("name").isNotNull().alias("has_image"), there(F.col("f")).alias("has_file"))


def alignment_audit(rows: DataFrame) -> DataFrame:
    """One row of totals over alignment_rows."""
    return rows.agg(
        F.count("*").alias("items"), F.count_if(~F.col("has_meta")).alias("meta_missing"), F.count_if("has_image").alias("image_covered"),
        F.count_if(F.col("has_image") & ~F.col("has_file")).alias("file_missing"), (F.count_if("has_file") / F.count("*")).alias("coverage"),
    )


def alignment_sample(rows: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """The n rows with the smallest seeded digests of their item: the same for every partitioning."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item").cast("string"))), "item").limit(n)


def first_existing_image(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """item, file: the first listed file of each item that has a size."""
    each = manifest.select("item", F.posexplode("files").alias("pos", "name")).where("name <> ''")
    found = each.join(listing.where("size > 0").select("name").distinct(), "name", "left_semi")
    return found.groupBy("item").agg(F.min_by("name", "pos").alias("file"))
