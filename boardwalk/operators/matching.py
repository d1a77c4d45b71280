"""M1-M6: last-wins deduplication, location filter, keyword matching and the board funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardwalk.functions.binding import let, pinned
from boardwalk.functions.text import anchor_token, hits_any, mark_edges, mark_keyword, word_tokens
from boardwalk.operators.boards import board_keywords, keyword_array
from boardwalk.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join
from boardwalk.operators.substrings import literal_hits

# up to this many keywords of a board are tried one by one; above it, words are looked up
SCAN_KEYWORDS = 64


def posting_text(title: str | Column = "title", description: str | Column = "description") -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))


def dedup_last(postings: DataFrame, key: list[str] | None = None) -> DataFrame:
    """M1: one row per board and exact URL, with the values of the last appearance and the
    position of the first.

    ``page_no`` orders pages, ``page_id``, when there, snapshots of one page; ``first_page_no``,
    when there, is the first visit of a page that was visited several times. Within a page the
    *last* ``seq`` wins. Partial aggregation keeps a
    hot URL from travelling more than once per map task.
    """
    key = key or ["board_id", "url"]
    first_page = "first_page_no" if "first_page_no" in postings.columns else "page_no"
    carried = [c for c in postings.columns if c not in (*key, "first_page_no")]
    snapshot = ["page_id"] if "page_id" in postings.columns else []
    at = F.struct(F.col(first_page).alias("page_no"), F.col("seq").alias("seq"))
    rows = postings.groupBy(*key).agg(
        F.max_by(F.struct(*carried), F.struct("page_no", *snapshot, "seq")).alias("_last"),
        F.min(at).alias("_first"),
    )
    return rows.select(
        *key, *[F.col(f"_last.{c}").alias(c) for c in carried if c not in ("page_no", "seq")],
        F.col("_first.page_no").alias("page_no"), F.col("_first.seq").alias("seq"),
    )


def location_dropped(text: Column, filters: Column) -> Column:
    """Does a location filter drop this text? Include patterns first, then exclude patterns;
    case does not matter, an empty pattern never hits, and an empty list is inactive."""

    def lowered(patterns: Column) -> Column:
        return F.transform(patterns, F.lower)

    def judge(t: Column) -> Column:
        include, exclude = filters["include"], filters["exclude"]
        missed = F.coalesce(F.size(include) > 0, F.lit(False)) & ~hits_any(t, lowered(include))
        return missed | hits_any(t, lowered(exclude))

    return F.when(filters.isNull(), F.lit(False)).otherwise(let(F.lower(text), judge))


def location_patterns(boards: DataFrame) -> DataFrame:
    """(board_id, excludes, pattern) of all location filters, lower-cased, empty ones left out."""
    lists = F.col("location_filters")
    rows = F.concat(*[
        F.coalesce(F.transform(lists[side], lambda p: F.struct(F.lit(side == "exclude").alias("excludes"), F.lower(p).alias("pattern"))),
                   F.array().cast("array<struct<excludes:boolean,pattern:string>>"))
        for side in ("include", "exclude")])
    return boards.select("board_id", F.explode(rows).alias("r")).select("board_id", "r.*").filter(F.col("pattern") != "")


def _location_by_index(postings: DataFrame, boards: DataFrame, text: Column, small: bool | None) -> DataFrame:
    """``dropped`` from an index of all boards' patterns. Only digests of texts come back to the
    postings, so these move at most once."""
    patterns = location_patterns(boards).groupBy("board_id", "pattern").agg(
        F.bool_or("excludes").alias("excludes"), F.bool_or(~F.col("excludes")).alias("includes"))
    keyed = postings.withColumn("_text_key", F.unhex(F.sha2(text.cast("binary"), 256)))
    hits = literal_hits(keyed, F.lower(text), patterns, keys=["_text_key"], by=["board_id"], small=small).groupBy(
        "board_id", "_text_key").agg(F.bool_or("includes").alias("_in"), F.bool_or("excludes").alias("_out"))
    asked = boards.filter(F.size("location_filters.include") > 0).select("board_id", F.lit(True).alias("_asked"))
    rows = lookup_join(keyed, asked, ["board_id"], "left", spread_by=["_text_key"], small=small).join(hits, ["board_id", "_text_key"], "left")
    no = F.lit(False)
    missed = F.coalesce("_asked", no) & ~F.coalesce("_in", no)
    return rows.withColumn("dropped", missed | F.coalesce("_out", no)).select(*postings.columns, "dropped")


def flag_location(
    postings: DataFrame, boards: DataFrame, *, small: bool | None = None, strategy: str = "scan",
    text: Column | None = None,
) -> DataFrame:
    """Add ``dropped``: the board's location filter rejects the posting.

    'scan' gives each posting its board's lists and tries one pattern after the other; 'index' looks
    up short runs of its text, whose cost does not grow with the lists. Both give the same rows.
    """
    if strategy == "index":
        return _location_by_index(postings, boards, posting_text() if text is None else text, small)
    joined = lookup_join(
        postings, boards.select("board_id", "location_filters"), ["board_id"], "left",
        spread_by=["url"], small=small,
    )
    flag = location_dropped(posting_text(), F.col("location_filters"))
    return joined.withColumn("dropped", flag).drop("location_filters")


def location_filter(
    postings: DataFrame, boards: DataFrame, *, small: bool | None = None, strategy: str = "scan"
) -> DataFrame:
    """M2: postings their board's location filter keeps."""
    flagged = flag_location(postings, boards, small=small, strategy=strategy)
    return flagged.filter(~F.col("dropped")).drop("dropped")


def marked_keywords(keywords: Column) -> Column:
    """Keyword array prepared for ``hit_array``; made once per board, not per posting."""
    return F.transform(
        keywords, lambda k: F.struct(k.alias("keyword"), mark_keyword(k).alias("marked"))
    )


def hit_array(text: Column, marked: Column) -> Column:
    """Keywords of a marked array that occur in the text between word edges. The text is marked
    once; each keyword is then one literal substring test."""
    return let(
        mark_edges(F.lower(text)),
        lambda t: F.transform(
            F.filter(marked, lambda k: F.contains(t, k["marked"])), lambda k: k["keyword"]
        ),
    )


def _prepared(board_keywords: DataFrame) -> DataFrame:
    """Keywords with their marked form, their anchor word, and whether that word is all of them."""
    k = F.lower("keyword")
    return board_keywords.select(
        "board_id", "keyword", mark_keyword(k).alias("marked"), anchor_token(k).alias("token")
    ).withColumn("whole", F.coalesce(F.col("token") == F.lower("keyword"), F.lit(False)))


def _measure(keywords: DataFrame) -> dict:
    """One aggregate over the keyword table: its size and the longest lists of a board."""
    row_bytes = F.octet_length("marked") + F.octet_length("keyword") + F.lit(16)
    per_board = keywords.groupBy("board_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("whole")).alias("phrases"),
        F.count_if(F.col("token").isNull()).alias("loose"), F.sum(row_bytes).alias("bytes"),
    )
    row = per_board.agg(
        F.max("n").alias("most"), F.max("phrases").alias("most_phrases"), F.max("loose").alias("most_loose"),
        F.sum("loose").alias("loose"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"),
    ).first()
    return {name: row[name] or 0 for name in row.asDict()}


def keyword_hits(
    postings: DataFrame,
    board_keywords: DataFrame,
    *,
    key: list[str] | None = None,
    strategy: str | None = None,
    small: bool | None = None,
    text: Column | None = None,
) -> DataFrame:
    """M3: one row (key columns, keyword) per posting and keyword that occurs in its text.

    'scan' gives each posting its board's short keyword array and tests one after the other.
    'token' splits the text into its distinct words and joins on (board, word), so the work per
    posting does not grow with the number of keywords. Keywords of several words or with other
    characters are scanned when a board has few of them; otherwise they are looked up by their
    longest word and tested against the text afterwards, and those without a word by a run of their
    characters. All ways give the same rows. ``text`` replaces title and description. Unless told, the measured shape of the keyword table decides, and it is broadcast only within
    bounds. Texts are never multiplied by words or keywords.
    """
    key = key or ["board_id", "url"]
    ids = list(dict.fromkeys(["board_id", *key]))
    keywords = _prepared(board_keywords)
    shape = _measure(keywords)
    if strategy is None:
        strategy = "scan" if shape["most"] <= SCAN_KEYWORDS else "token"
    if small is None:
        small = shape["rows"] <= BROADCAST_ROWS and shape["bytes"] <= BROADCAST_BYTES
    # no text at all matches nothing, not even the empty keyword
    whole_text = posting_text() if text is None else text
    texts = postings.select(*ids, whole_text.alias("_text")).filter(F.col("_text") != " ")

    def scan(some: DataFrame) -> DataFrame:
        packed = some.groupBy("board_id").agg(
            F.collect_list(F.struct("keyword", "marked")).alias("_kw")
        )
        rows = lookup_join(texts, packed, ["board_id"], "inner", spread_by=key, small=small)
        return rows.select(*key, F.explode(hit_array(F.col("_text"), F.col("_kw"))).alias("keyword"))

    if strategy == "scan":
        return scan(keywords)
    texts = texts.withColumn("_hash", F.xxhash64("_text"))
    words = texts.select(*ids, "_hash", F.explode(word_tokens(F.lower("_text"))).alias("token"))

    def by_word(some: DataFrame) -> DataFrame:
        return lookup_join(words, some, ["board_id", "token"], "inner", spread_by=key, small=small)

    found = by_word(keywords.filter("whole").drop("marked")).select(*key, "keyword")
    phrases = keywords.filter(~F.col("whole"))
    if shape["most_phrases"] <= SCAN_KEYWORDS:
        return found.unionByName(scan(phrases)) if shape["most_phrases"] else found
    marked = texts.withColumn("_text", mark_edges(F.lower("_text")))
    likely = by_word(phrases.filter(F.col("token").isNotNull())).drop("token")
    # key columns may repeat: one candidate for each text, then every row of that text tests it
    likely = likely.distinct()
    found = found.unionByName(
        likely.join(marked, [*ids, "_hash"]).filter(F.contains("_text", F.col("marked"))).select(*key, "keyword")
    )
    loose = phrases.filter(F.col("token").isNull())
    if shape["most_loose"] > SCAN_KEYWORDS:
        wanted = loose.select("board_id", "keyword", F.col("marked").alias("pattern"))
        hits = literal_hits(texts, mark_edges(F.lower("_text")), wanted, keys=key, by=["board_id"], small=small)
        found = found.unionByName(hits.select(*key, "keyword"))
    elif shape["loose"]:
        found = found.unionByName(scan(loose))
    return found


def matches(
    postings: DataFrame,
    board_keywords: DataFrame,
    *,
    key: list[str] | None = None,
    strategy: str | None = None,
    small: bool | None = None,
) -> DataFrame:
    """M4: postings with at least one hit and their sorted keywords; the description is dropped.
    A board without keywords gives nothing."""
    key = key or ["board_id", "url"]
    hits = keyword_hits(postings, board_keywords, key=key, strategy=strategy, small=small)
    grouped = hits.groupBy(*key).agg(F.array_sort(F.collect_set("keyword")).alias("matched_keywords"))
    return postings.drop("description").join(grouped, key)


def longest_list(universal: Column) -> Column:
    """Entries of the longest list that judging a posting of the board would go through."""
    sides = [F.size(F.coalesce(F.col(f"location_filters.{s}"), F.array())) for s in ("include", "exclude")]
    return F.greatest(F.size(keyword_array(universal, F.col("keywords"))), *sides)


def board_lists(boards: DataFrame, universal: Column) -> DataFrame:
    """What judging in place looks up: (board_id, location_filters, _kw)."""
    return boards.select(
        "board_id", "location_filters",
        marked_keywords(keyword_array(universal, F.col("keywords"))).alias("_kw"),
    )


def match_in_place(
    postings: DataFrame, boards: DataFrame, universal: Column, *, small: bool | None = None
) -> DataFrame:
    """M2 to M4 for boards with short keyword lists, flags instead of filters and no shuffle:
    adds ``dropped`` and ``matched_keywords`` (sorted, empty when dropped or nothing hits)."""
    rows = lookup_join(postings, board_lists(boards, universal), ["board_id"], "left", spread_by=["url"], small=small)
    none = F.array().cast("array<string>")

    def judged(dropped: Column) -> Column:
        hits = F.when(
            ~dropped & (posting_text() != " ") & (F.size("_kw") > 0),
            F.array_sort(hit_array(posting_text(), F.col("_kw"))),
        )
        return F.struct(dropped.alias("dropped"), F.coalesce(hits, none).alias("matched_keywords"))

    verdict = let(location_dropped(posting_text(), F.col("location_filters")), judged)
    columns = postings.columns
    return pinned(rows, _m=verdict).select(*columns, "_m.dropped", "_m.matched_keywords")


def match_by_index(
    rows: DataFrame, boards: DataFrame, universal: Column, *, key: list[str], text: str, small: bool | None = None
) -> DataFrame:
    """M2 to M4 for boards with long lists: (key columns, dropped, matched_keywords) of the rows that
    are dropped or match. No list is ever an array beside a posting: patterns and keywords are rows,
    met by short runs of the text and by its words. ``key`` tells rows apart."""
    texts = rows.select(*dict.fromkeys(["board_id", *key]), text)
    flagged = flag_location(texts, boards, small=small, strategy="index", text=F.col(text))
    words = board_keywords(boards, universal)
    hits = keyword_hits(
        flagged.filter(~F.col("dropped")), words, key=key, strategy="token", small=small, text=F.col(text))
    matched = hits.groupBy(*key).agg(F.array_sort(F.collect_set("keyword")).alias("matched_keywords"))
    none = F.array().cast("array<string>")
    out = flagged.filter("dropped").select(*key, "dropped", none.alias("matched_keywords"))
    return out.unionByName(matched.select(*key, F.lit(False).alias("dropped"), "matched_keywords"))


def board_funnel(boards: DataFrame, flagged: DataFrame, account: DataFrame | None = None) -> DataFrame:
    """M5: per board the postings after deduplication, those dropped by location and those that
    matched; zeros for boards without postings. ``flagged`` has board_id, dropped, matched. With the
    account of crawled pages (``paging.page_account``) also its pages and those unreached."""
    counts = flagged.groupBy("board_id").agg(
        F.count("*").alias("listings"),
        F.count_if("dropped").alias("dropped"),
        F.count_if("matched").alias("matched"),
    )
    zero = F.lit(0).cast("long")
    rows, columns = boards.select("board_id", "name").join(counts, "board_id", "left"), ["listings", "dropped", "matched"]
    if account is not None:
        pages = account.groupBy("board_id").agg(
            F.count("*").alias("pages"), F.count("unreached").alias("unreached"))
        rows, columns = rows.join(pages, "board_id", "left"), [*columns, "pages", "unreached"]
    return rows.select("board_id", "name", *[F.coalesce(c, zero).alias(c) for c in columns])


def all_matches(*parts: DataFrame) -> DataFrame:
    """M6: matches of all boards; (board_id, page_no, seq) is the order of the configuration."""
    first, *others = parts
    for part in others:
        first = first.unionByName(part)
    return first
