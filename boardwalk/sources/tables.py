"""Readers and writers."""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardwalk.functions import urls
from boardwalk.functions.fixed import MAX_PAGES
from boardwalk.operators.failures import all_failures, failure_rows
from boardwalk.operators.skew import lookup_join
from boardwalk.schemas import BOARDS, LOCATION, SELECTOR_RULES

_STRINGS = T.ArrayType(T.StringType())
# nested objects stay text here: an empty one and an absent one must remain different
_COMPANY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("job_board_url", T.StringType()),
    T.StructField("keywords", _STRINGS),
    T.StructField("location_filters", T.StringType()),
    T.StructField("use_iframe", T.BooleanType()),
    T.StructField("max_pages", T.IntegerType()),
    T.StructField("scraping_config", T.StringType()),
])
_DOCUMENT = T.StructType([
    T.StructField("universal_keywords", _STRINGS),
    T.StructField("companies", T.ArrayType(_COMPANY)),
])
_SCRAPING = T.StructType([
    T.StructField("use_js_navigation", T.BooleanType()),
    T.StructField("exclude_patterns", T.StructType([
        T.StructField("urls", _STRINGS), T.StructField("titles", _STRINGS),
    ])),
    T.StructField("pagination_selectors", _STRINGS),
])


def parse_configs(texts: DataFrame) -> DataFrame:
    """Configuration documents from their text in ``value``; other columns are kept. Blank text
    gives no document, text that is not JSON is an error."""
    keys = [c for c in texts.columns if c != "value"]
    document = F.from_json("value", _DOCUMENT, {"mode": "FAILFAST"})
    filled = texts.filter(F.trim("value", F.lit(" \t\r\n")) != "")
    return filled.select(*keys, document.alias("d")).select(
        *keys,
        F.coalesce("d.universal_keywords", F.array().cast(_STRINGS)).alias("universal_keywords"),
        F.coalesce("d.companies", F.array().cast(T.ArrayType(_COMPANY))).alias("companies"),
    )


_CONFIGS = "doc_id long, value string"


def write_configs(texts: DataFrame, path: str) -> None:
    """Store many configuration documents (doc_id, value), one a line: the number of files follows the
    partitions, not the documents."""
    texts.select("doc_id", "value").write.json(path)


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """The documents that ``write_configs`` stored, parsed as by ``parse_configs``, with their doc_id."""
    return parse_configs(spark.read.schema(_CONFIGS).json(path))


def read_boards(spark: SparkSession, path: str) -> DataFrame:
    """One row per board of a configuration file; a missing or blank file has no boards."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "value string")
    return boards_from_configs(parse_configs(text))


def boards_from_configs(configs: DataFrame) -> DataFrame:
    """Boards in configuration order, defaults applied, with the universal keywords of their
    document in ``universal_keywords``. An empty scraping configuration counts as none."""
    keys = _keys(configs)
    rows = configs.select(
        *keys, "universal_keywords", F.posexplode("companies").alias("board_id", "c")
    )
    none = F.array().cast(_STRINGS)
    scraping = F.from_json("c.scraping_config", _SCRAPING)
    return rows.select(
        *keys,
        F.col("board_id").cast("long").alias("board_id"),
        F.coalesce("c.name", F.lit("Unknown")).alias("name"),
        F.coalesce("c.job_board_url", F.lit("")).alias("job_board_url"),
        F.coalesce("c.keywords", none).alias("keywords"),
        F.from_json("c.location_filters", LOCATION).alias("location_filters"),
        F.coalesce("c.use_iframe", F.lit(False)).alias("use_iframe"),
        F.coalesce("c.max_pages", F.lit(MAX_PAGES)).alias("max_pages"),
        F.coalesce(F.size(F.json_object_keys("c.scraping_config")) > 0, F.lit(False))
        .alias("has_scraping_config"),
        F.coalesce(scraping["use_js_navigation"], F.lit(False)).alias("use_js_navigation"),
        F.coalesce(scraping["exclude_patterns"]["urls"], none).alias("exclude_urls"),
        F.coalesce(scraping["exclude_patterns"]["titles"], none).alias("exclude_titles"),
        scraping["pagination_selectors"].alias("pagination_selectors"),
        "universal_keywords",
    ).select(*keys, *[f.name for f in BOARDS.fields], "universal_keywords")


_SELECTORS = T.StructType([
    T.StructField("container_selectors", _STRINGS),
    T.StructField("link_selector", T.StringType()),
    T.StructField("title_selector", T.StringType()),
    T.StructField("description_selector", T.StringType()),
    T.StructField("pagination_selectors", _STRINGS),
])
# tag, id, classes, attribute tests, place, text
_COMPOUND = (
    r"([A-Za-z][\w-]*|\*)?(#[\w-]+)?((?:\.[\w-]+)*)((?:\[[^\]]*\])*)(:first-child|:last-child)?"
    r"(?::has-text\([\"']?([^\"')]*)[\"']?\))?"
)
_SELECTOR = rf"^(?:{_COMPOUND}(\s*>\s*|\s+))?{_COMPOUND}$"
_TEST = r"^\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"']*?)[\"']?(\s+i)?)?\s*$"


def _keys(configs: DataFrame) -> list[str]:
    return [c for c in configs.columns if c not in ("universal_keywords", "companies")]


def _selectors(configs: DataFrame) -> DataFrame:
    """(keys of the document, rule_set, board_id, name, rank, one, known): the alternatives of all
    selectors, and whether a rule row can say them."""
    keys = _keys(configs)
    boards = configs.select(*keys, F.posexplode("companies").alias("board_id", "c")).select(
        *keys, F.col("board_id").cast("long").alias("board_id"), F.col("c.name").alias("name"),
        F.from_json("c.scraping_config", _SELECTORS).alias("s"),
    )

    def listed(rule_set: str, field: str) -> Column:
        value = F.col(f"s.{field}")
        several = value if field.endswith("_selectors") else F.when(value.isNotNull(), F.array(value))
        return F.struct(F.lit(rule_set).alias("rule_set"), several.alias("several"))

    # all rule sets of a board at once, so that documents are read and parsed once
    sets = [listed("container", "container_selectors")]
    sets += [listed(rule_set, f"{rule_set}_selector") for rule_set in ("link", "title", "description")]
    sets.append(listed("pagination", "pagination_selectors"))
    rows = boards.select(*keys, "board_id", "name", F.explode(F.array(*sets)).alias("_set")).select(
        *keys, F.col("_set.rule_set").alias("rule_set"), "board_id", "name", F.posexplode("_set.several").alias("rank", "listed"))
    # commas within brackets do not part alternatives
    one = F.explode(F.split("listed", r",(?![^\[(]*[\])])")).alias("one")
    rows = rows.select(*keys, "rule_set", "board_id", "name", "rank", one).withColumn("one", F.trim("one"))
    tests = F.concat(_tests(4), _tests(11))
    # an ancestor is a tag, classes and one test, of which an id is a form
    plain = (_part(5) == "") & (_part(6) == "") & (
        F.size(_tests(4)) + F.when(_part(2) == "", 0).otherwise(1) <= 1)
    some = F.concat(*[_part(k) for k in (1, 2, 3, 4)]) != ""
    known = F.col("one").rlike(_SELECTOR) & (F.col("one") != "") & plain & F.forall(tests, lambda t: t.rlike(_TEST)) & (
        some | (_part(7) == "")) & (F.concat(*[_part(k) for k in range(8, 14)]) != "")
    return rows.withColumn("known", F.coalesce(known, F.lit(False)))


def _part(k: int) -> Column:
    return F.regexp_extract("one", _SELECTOR, k)


def _tests(k: int) -> Column:
    """Contents of the brackets of a part."""
    return F.regexp_extract_all(_part(k), F.lit(r"\[([^\]]*)\]"), F.lit(1))


def _test(text: Column) -> Column:
    """attr, op, value and case flag of one attribute test."""
    def piece(k: int) -> Column:
        return F.nullif(F.regexp_extract(text, _TEST, k), F.lit(""))

    compared = piece(2).isNotNull()
    return F.struct(
        F.lower(piece(1)).alias("attr"), F.coalesce(piece(2), F.lit("exists")).alias("op"),
        F.when(compared, F.regexp_extract(text, _TEST, 3)).alias("value"), piece(4).isNotNull().alias("ci"))


def rules_from_configs(configs: DataFrame, *, strict: bool = False) -> DataFrame:
    """Selector rules of the boards' configurations (``configs`` as of ``parse_configs``), with the
    other columns of their document in front.

    A selector is what a rule row can say: tag, one id, classes, attribute tests, first or last child
    and a text, below an ancestor, or right below it (``>``), with tag, id, classes or one attribute
    test. Alternatives after commas share the rank; lists give ranks in their order. A selector with
    an alternative beyond that is left out as a whole, as one that fails on a page would be, and
    named by ``selector_failures``; with ``strict`` it is an error that names board and selector.
    """
    rows = _selectors(configs)
    if strict:
        unknown = rows.filter(~F.col("known")).first()
        if unknown is not None:
            raise ValueError(f"board {unknown['name']!r}: selector {unknown['one']!r} is not supported")
    # alternatives of one selector, on few rows
    keys = _keys(configs)
    whole = Window.partitionBy(*keys, "board_id", "rule_set", "rank")
    rows = rows.withColumn("known", F.min("known").over(whole)).filter("known")
    tests, above = F.transform(_tests(11), _test), F.get(F.transform(_tests(4), _test), F.lit(0))
    first = F.get(tests, F.lit(0))
    others = F.transform(F.slice(tests, 2, 1 << 20), lambda t: F.struct(t["attr"], t["op"], t["value"]))
    by_id = _part(2) != ""

    def filled(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    def classes(k: int) -> Column:
        return filled(F.trim(F.translate(_part(k), ".", " ")))

    no = F.lit(False)
    named = {
        "rank": F.col("rank"), "tag": F.nullif(filled(F.lower(_part(8))), F.lit("*")), "id_eq": filled(F.substring(_part(9), 2, 1 << 30)),
        "class_eq": classes(10), "attr": first["attr"], "op": first["op"], "value": first["value"],
        "ci": F.exists(tests, lambda t: t["ci"]) | F.coalesce(above["ci"], no),
        "ancestor_tag": F.nullif(filled(F.lower(_part(1))), F.lit("*")), "ancestor_class": classes(3),
        "ancestor_attr": F.when(by_id, "id").otherwise(above["attr"]), "ancestor_op": F.when(by_id, "=").otherwise(above["op"]),
        "ancestor_value": F.when(by_id, F.substring(_part(2), 2, 1 << 30)).otherwise(above["value"]),
        "last_child": _part(12) == ":last-child", "has_text": filled(_part(13)),
        "more": F.when(F.size(others) > 0, others), "child": F.when(F.trim(_part(7)) == ">", F.lit(True)),
        "first_child": F.when(_part(12) == ":first-child", F.lit(True)),
    }
    fields = [f for f in SELECTOR_RULES.fields if f.name not in ("rule_set", "board_id")]
    return rows.select(*keys, "rule_set", "board_id", *[named[f.name].cast(f.dataType).alias(f.name) for f in fields])


def selector_failures(configs: DataFrame) -> DataFrame:
    """Rows (``operators.failures``) for the selectors that ``rules_from_configs`` leaves out."""
    unknown = _selectors(configs).filter(~F.col("known"))
    reason = F.concat(F.col("rule_set"), F.lit(" selector is not supported: "), F.col("one"))
    return failure_rows(unknown, "selector", reason, stops=False, keys=_keys(configs))


def configuration_failures(configs: DataFrame) -> DataFrame:
    """Rows for boards whose nested settings are not objects: they contribute nothing."""
    keys = _keys(configs)
    rows = configs.select(*keys, F.posexplode("companies").alias("board_id", "c")).withColumn("board_id", F.col("board_id").cast("long"))
    out = None
    for field in ("location_filters", "scraping_config"):
        raw = F.col(f"c.{field}")
        bad = rows.filter(raw.isNotNull() & F.json_object_keys(raw).isNull())
        one = failure_rows(bad, "configuration", F.lit(f"{field} is not an object"), stops=True, keys=keys)
        out = one if out is None else out.unionByName(one)
    return out


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """What is wrong with single boards of a configuration file; see ``operators.failures``."""
    configs = parse_configs(spark.read.text(path, wholetext=True))
    return all_failures(
        configuration_failures(configs), selector_failures(configs), place_failures(boards_from_configs(configs)))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The selector rules of a configuration file, for the boards that ``read_boards`` gives. What
    is left out is in ``read_failures``."""
    return rules_from_configs(parse_configs(spark.read.text(path, wholetext=True)))


def _path(url: Column) -> Column:
    """Path of an absolute URL without its last slash."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def _places(boards: DataFrame) -> DataFrame:
    return boards.select(
        "board_id", urls.host(F.col("job_board_url")).alias("_host"), _path(F.col("job_board_url")).alias("_path")
    ).filter(F.col("_host") != "")


def place_failures(boards: DataFrame) -> DataFrame:
    """Rows (``operators.failures``) for boards whose host and path are those of a board with a smaller
    id, which takes their pages."""
    places = _places(boards)
    least = places.groupBy("_host", "_path").agg(F.min("board_id").alias("_least"))
    later = places.join(least, ["_host", "_path"]).filter(F.col("board_id") > F.col("_least"))
    reason = F.concat(F.lit("shares "), "_host", "_path", F.lit(" with board "), F.col("_least").cast("string"))
    return failure_rows(later, "place", reason, stops=True)


def attach_boards_by_host(
    pages: DataFrame, boards: DataFrame, *, small: bool | None = None, strict: bool = False, keep: bool = False
) -> DataFrame:
    """Give every page one board: that whose URL has the same host and the longest path that the
    page's path starts with, whole segments only. A board alone on its host takes all its pages.
    Of several boards with the same host and path the one with the smallest id takes the pages, and
    ``place_failures`` names the others; with ``strict`` they are an error. Pages of no board go away,
    or with ``keep`` stay and have none.
    """
    places = _places(boards)
    if strict:
        twice = place_failures(boards).first()
        if twice is not None:
            raise ValueError(f"board {twice['board_id']}: {twice['reason']}")
    places = places.groupBy("_host", "_path").agg(F.min("board_id").alias("board_id"))
    alone = places.groupBy("_host").agg(F.max("board_id").alias("board_id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    # an empty path stands for the whole host
    places = places.filter("_path <> ''").unionByName(
        places.filter("_path = ''").join(alone.select("_host"), "_host", "left_anti").select("board_id", "_host", "_path")
    ).unionByName(alone.select("board_id", "_host", F.lit("").alias("_path")))
    # a page asks for each of its path's beginnings; only ids and paths are joined, never pages
    parts = F.split(_path(F.col("url")), "/")
    asked = pages.select(
        "page_id", urls.host(F.col("url")).alias("_host"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("_path"),
    )
    found = lookup_join(asked, places, ["_host", "_path"], "inner", spread_by=["page_id"], small=small)
    best = found.groupBy("page_id").agg(F.max_by("board_id", F.length("_path")).alias("board_id"))
    return pages.join(best, "page_id", "left" if keep else "inner")


def read_pages(
    spark: SparkSession, path: str, boards: DataFrame | None = None, *, small: bool | None = None, keep: bool = False
) -> DataFrame:
    """Crawled pages. With boards, pages without a board_id get theirs by host and path; with
    ``keep`` those of no board stay, for the account of a run."""
    pages = spark.read.parquet(path)
    if boards is None or "board_id" in pages.columns:
        return pages
    return attach_boards_by_host(pages, boards, small=small, keep=keep)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """S3: frame documents without the main document of a page."""
    return child_frames(spark.read.parquet(path))


def child_frames(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("frame_no") > 0)


def read_navigations(spark: SparkSession, path: str) -> DataFrame:
    """Log of click outcomes."""
    return spark.read.parquet(path)


_RUNS = "run long, written long, folder string, buckets int"


def _runs(root: str) -> str:
    return f"{root}/runs"


def write_matches(matches: DataFrame, root: str, run: int, *, buckets: int | None = None) -> None:
    """Store the matches of a run, new and seen alike, then record the run. Every attempt has a
    folder of its own, and the record names it: a run that fails half-way, or that is repeated and
    then fails, leaves what was recorded before as it is.

    With ``buckets`` the run's URLs are stored once more, each once, in that many buckets by URL and
    sorted, which is how the next run asks for them without moving them.
    """
    spark = matches.sparkSession
    folder = f"run={run}-{uuid.uuid4().hex}"
    matches.write.parquet(f"{root}/matches/{folder}")
    if buckets is not None:
        urls_of = spark.read.schema(matches.schema).parquet(f"{root}/matches/{folder}").select("url").distinct()
        # a catalogue entry is only the way to write buckets; the files are what counts
        name = f"boardwalk_{uuid.uuid4().hex}"
        urls_of.repartition(buckets, "url").write.bucketBy(buckets, "url").sortBy("url").option(
            "path", f"{root}/history/{folder}").format("parquet").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
    record = spark.createDataFrame([(run, time.time_ns(), folder, buckets)], _RUNS)
    record.coalesce(1).write.mode("append").parquet(_runs(root))


def _last_run(spark: SparkSession, root: str, run: int | None, before: int | None) -> Row | None:
    try:
        runs = spark.read.schema(_RUNS).parquet(_runs(root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if run is not None:
        runs = runs.filter(F.col("run") == run)
    if before is not None:
        runs = runs.filter(F.col("run") < before)
    return runs.orderBy(F.desc("run"), F.desc("written")).first()


def read_matches(spark: SparkSession, root: str, run: int | None = None, before: int | None = None) -> DataFrame | None:
    """The matches of a run as last recorded, of the last run, or of the last one before another;
    None when there is none."""
    last = _last_run(spark, root, run, before)
    return None if last is None else spark.read.parquet(f"{root}/matches/{last['folder']}")


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """URLs stored by ``write_matches``, as a table that knows its buckets. The entry is made anew in any
    session that has none, from what the run's record says."""
    name = "boardwalk_" + hashlib.sha256(path.encode()).hexdigest()[:32]
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (url STRING) USING parquet "
              f"CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def read_history(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """URLs of the last recorded run only; empty when there is none. A run without matches
    leaves an empty history."""
    last = _last_run(spark, root, None, before)
    if last is None:
        return spark.createDataFrame([], "url string")
    if last["buckets"] is not None:
        return _bucketed(spark, f"{root}/history/{last['folder']}", last["buckets"])
    return spark.read.parquet(f"{root}/matches/{last['folder']}").select("url").distinct()
