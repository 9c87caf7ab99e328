"""Project-shaped sources: project files, contents files, keyword files and the files that they name."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from quire.functions import text

SECTIONS = ("OPTIONS", "WINDOWS", "FILES", "MERGE FILES")


def read_whole(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, value): whole text files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def lines(files: DataFrame) -> DataFrame:
    """(path, pos, section, line): trimmed lines of project files under their sections; blanks and comments dropped."""
    rows = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    rows = rows.where((F.col("line") != "") & ~F.col("line").startswith(";"))
    head = F.when(F.col("line").startswith("[") & F.col("line").endswith("]"), F.upper(F.expr("substring(line, 2, length(line) - 2)")))
    # One window per file: a project file is one document.
    upto = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("section", F.last(head, ignorenulls=True).over(upto)).where(head.isNull())
    return rows.where(F.col("section").isin(list(SECTIONS)))


def options(rows: DataFrame) -> DataFrame:
    """(path, key, value): keys in lower case; the last of equal keys counts."""
    own = rows.where("section = 'OPTIONS' and contains(line, '=')")
    pair = own.select("path", "pos", F.lower(F.trim(F.substring_index("line", "=", 1))).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))
    return pair.groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))


def flag(value):
    """Options that are on are written yes, in any case."""
    return F.lower(value) == "yes"


def language(value, default: int = 0x0409):
    """A number, hexadecimal with 0x; anything else leaves the default."""
    hexadecimal = F.when(value.rlike(r"^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(value, F.lit(3), F.length(value)), 16, 10).cast("int"))
    return F.coalesce(hexadecimal, F.when(value.rlike(r"^\d+$"), value.cast("int")), F.lit(default))


def windows(rows: DataFrame) -> DataFrame:
    """(path, name, fields): window definitions; commas in brackets don't split, quotes don't protect; empty fields are null."""
    own = rows.where("section = 'WINDOWS' and contains(line, '=')")
    fields = F.transform(F.split(F.expr("substring(line, instr(line, '=') + 1)"), r",(?![^\[]*\])"), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    return own.select("path", F.trim(F.substring_index("line", "=", 1)).alias("name"), F.transform(fields, lambda x: F.when(x != "", x)).alias("fields"))


def manifest(rows: DataFrame) -> DataFrame:
    """(path, seq, canon): the files of a project in order; repeated lines stay."""
    return rows.where("section = 'FILES'").select("path", F.col("pos").alias("seq"), F.concat(F.lit("/"), F.replace("line", F.lit("\\"), F.lit("/"))).alias("canon"))


def contents(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Manifest rows whose file is there (canon, content); files that are missing drop out."""
    return wanted.join(available, "canon")


def referenced(content: DataFrame, available: DataFrame) -> DataFrame:
    """(canon): files that contents link to and that are there, but aren't contents yet. One level: what they link to isn't followed."""
    refs = content.select(F.explode(text.links(F.col("content").cast("string"))).alias("ref")).select(F.concat(F.lit("/"), F.regexp_replace("ref", r"^/+", "")).alias("canon")).distinct()
    return refs.join(content.select("canon"), "canon", "left_anti").join(available.select("canon"), "canon", "left_semi")


def contents_entries(files: DataFrame) -> DataFrame:
    """(path, ord, depth, title, url) of contents files: depth counts bare list tags; entries without a link aren't numbered."""
    tags = files.select("path", F.posexplode(F.regexp_extract_all("value", F.lit("(?i:<ul>|</ul>)|(?i:<object)[^>]*>[\\s\\S]*?</OBJECT>"), F.lit(0))).alias("pos", "tag"))
    step = F.when(F.lower("tag") == "<ul>", 1).when(F.lower("tag") == "</ul>", -1).otherwise(0)
    order = Window.partitionBy("path").orderBy("pos")
    rows = tags.withColumn("depth", F.sum(step).over(order)).where(F.lower("tag").startswith("<object"))
    param = lambda name: F.regexp_extract("tag", rf'(?i)<param\s+name="{name}"\s+value="([^"]*)"', 1)
    rows = rows.select("path", "pos", "depth", param("Name").alias("title"), param("Local").alias("url")).where("url <> ''")
    return rows.withColumn("ord", F.row_number().over(order) - 1).select("path", "ord", "depth", "title", "url")


class _Items(HTMLParser):
    """Events of one keyword file: a list hangs under the item closed last, or under the root."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.stack, self.last, self.item = [], [None], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "ul":
            self.stack.append(self.last)
        elif tag == "object" and a.get("type") == "text/sitemap":
            self.item = {"name": "", "local": ""}
        elif tag == "param" and self.item is not None:
            key = (a.get("name") or "").lower()
            if key in self.item:
                self.item[key] = a.get("value") or ""

    def handle_endtag(self, tag):
        if tag == "ul" and len(self.stack) > 1:
            self.stack.pop()
        elif tag == "object" and self.item is not None:
            self.last = len(self.rows)
            self.rows.append((self.last, self.stack[-1], self.item["name"], self.item["local"]))
            self.item = None


_ITEM = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("parent_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("local", T.StringType())])


@udtf(returnType=_ITEM)
class keyword_items:
    """Items of one keyword file; the only reader that needs a stateful parser."""

    def eval(self, value: str):
        parser = _Items()
        parser.feed(value or "")
        yield from parser.rows


def keyword_rows(files: DataFrame) -> DataFrame:
    """(path, item_id, keyword, local): items without children, under the names of all above them joined by ', '."""
    spark = files.sparkSession
    spark.udtf.register("quire_keyword_items", keyword_items)
    files.createOrReplaceTempView("quire_keyword_files")
    items = spark.sql("SELECT path, item_id, parent_id, name, local FROM quire_keyword_files, LATERAL quire_keyword_items(value)")
    parents = items.select("path", F.col("parent_id").alias("item_id")).where("item_id is not null").distinct()
    leaves = items.join(parents, ["path", "item_id"], "left_anti").select("path", "item_id", "local", F.array("name").alias("names"), F.col("parent_id").alias("up"))
    above = items.select("path", F.col("item_id").alias("up"), F.col("parent_id").alias("next"), F.col("name").alias("upper"))
    while not leaves.where("up is not null").isEmpty():  # as many rounds as the file is deep
        leaves = leaves.join(above, ["path", "up"], "left").select("path", "item_id", "local", F.when(F.col("upper").isNotNull(), F.concat(F.array("upper"), "names")).otherwise(F.col("names")).alias("names"), F.col("next").alias("up"))
    out = leaves.select("path", "item_id", text.compound_keyword(F.col("names")).alias("keyword"), "local", F.element_at("names", -1).alias("own"))
    return out.where("own <> '' and local <> ''").drop("own")


def valid_window_fields(fields) -> int:
    """Bit mask of the fields that a definition gives."""
    return F.aggregate(F.transform(fields, lambda x, i: F.when(x.isNotNull(), F.pow(F.lit(2.0), i).cast("bigint")).otherwise(0)), F.lit(0).cast("bigint"), lambda a, b: a + b)


