"""Fixed values. They have to equal the published defaults for results to agree, so they
are stated plainly, in their natural order. Order matters wherever a rank is derived from it."""

from __future__ import annotations

# --- fixed values: thresholds ------------------------------------------------------------
MAX_PAGES = 10
MIN_TITLE_LENGTH = 3
MIN_TITLE_WORDS = 2
MIN_ROW_TEXT = 10
MIN_HREF_SLASHES = 4
FALLBACK_TITLE_CHARS = 100

# --- fixed values: tag groups ------------------------------------------------------------
CHROME_TAGS = ["nav", "header", "footer"]
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
CELL_TAGS = ["td", "th"]
NAMED_TITLE_TAGS = ["span", "div", "p"]
NAMED_TITLE_WORDS = ["title", "name"]

# --- fixed values: URL patterns ----------------------------------------------------------
JOB_URL_PATTERNS = [
    "/job/", "/jobs/", "/position/", "/positions/", "/career/", "/careers/",
    "/opening/", "/openings/", "/role/", "/roles/",
]
JOB_LINK_PATTERNS = [
    "/job/", "/jobs/", "/position/", "/positions/",
    "/opening/", "/openings/", "/role/", "/roles/",
]
FRAME_EXCLUDED_URLS = [
    "/embed/", "/careers$", "/careers/$", "/careers#", "#",
    "javascript:", "mailto:", "/search", "/filter",
]
SEARCH_PATTERNS = ["/search", "/filter"]

# --- fixed values: title and text words --------------------------------------------------
FRAME_EXCLUDED_TITLES = ["view all", "see all", "back to", "home", "careers", "about", "apply"]
DEFAULT_EXCLUDED_TITLES = [
    "talent network", "join our", "join the", "talent community", "sign up",
    "career alert", "job alert", "newsletter", "filter", "sort by", "results",
    "open positions", "our values", "company values", "benefits", "perks",
]
FRAME_JOB_WORDS = ["job", "position", "career", "opening", "apply", "role"]
NEXT_PAGE_WORDS = ["next", "more", ">", "→", "»", "load more", "show more"]

# --- fixed values: container selection ---------------------------------------------------
CONTAINER_TAGS = ["article", "li", "div"]
CONTAINER_WORDS = [
    "job", "position", "role", "opening", "listing", "vacancy",
    "post-card", "posting", "opportunity",
]
CONTAINER_ATTRS = ["class", "id", "data-qa", "data-testid"]
RESULT_ITEM_EXCLUDED = ["talent", "community", "event", "tcjoin"]

RULE_FIELDS = [
    "rank", "tag", "id_eq", "class_eq", "attr", "op", "value", "ci",
    "ancestor_tag", "ancestor_class", "ancestor_attr", "ancestor_op", "ancestor_value",
    "last_child", "has_text", "more", "child", "first_child",
]


def rule(rank: int, tag: str | None = None, **fields) -> dict:
    """One selector rule row; fields left out place no condition."""
    unknown = set(fields) - set(RULE_FIELDS)
    if unknown:
        raise ValueError(f"unknown rule fields: {sorted(unknown)}")
    row = dict.fromkeys(RULE_FIELDS)
    row.update(rank=rank, tag=tag, ci=False, last_child=False)
    row.update(fields)
    return row


# fixed values: result items, in rank order
RESULT_ITEM_RULES = [
    rule(0, "li", attr="data-qa", op="*=", value="ResultItem"),
    rule(1, "li", attr="data-qa", op="*=", value="resultItem"),
    rule(2, "div", attr="data-qa", op="*=", value="ResultItem"),
    rule(3, "div", attr="data-qa", op="*=", value="resultItem"),
    rule(4, "li", attr="data-qa", op="=", value="searchResultItem"),
    rule(5, "div", attr="data-qa", op="=", value="searchResultItem"),
]

# fixed values: posting containers inside frames, in rank order
FRAME_CONTAINER_RULES = [
    rule(0, class_eq="opening"),
    rule(1, "div", class_eq="opening"),
    rule(2, "section", class_eq="level-0"),
    rule(3, "div", attr="id", op="*=", value="job"),
]

# fixed values: next-page elements, in rank order
NEXT_PAGE_RULES = [
    rule(0, "a", attr="aria-label", op="=", value="Next"),
    rule(1, "a", attr="aria-label", op="=", value="Next page"),
    rule(2, "button", attr="aria-label", op="=", value="Next"),
    rule(3, "button", attr="aria-label", op="=", value="Next page"),
    rule(4, "a", attr="rel", op="=", value="next"),
    rule(5, "a", class_eq="next-page"),
    rule(6, "a", class_eq="pagination-next"),
    rule(7, "button", class_eq="next-page"),
    rule(8, "button", class_eq="pagination-next"),
    rule(9, "a", ancestor_tag="nav", has_text="Next"),
    rule(10, "button", ancestor_tag="nav", has_text="Next"),
    rule(11, "a", ancestor_tag="div", ancestor_attr="role", ancestor_op="=",
         ancestor_value="navigation", has_text="Next"),
    rule(12, "button", ancestor_tag="div", ancestor_attr="role", ancestor_op="=",
         ancestor_value="navigation", has_text="Next"),
    rule(13, "button", has_text="Show More"),
    rule(14, "button", has_text="Load More"),
    rule(15, "a", has_text="Show More"),
    rule(16, "a", has_text="Load More"),
    rule(17, "a", class_eq="next", ancestor_tag="nav", ancestor_class="pagination"),
    rule(18, "a", class_eq="next", ancestor_tag="ul", ancestor_class="pagination"),
    rule(19, "a", class_eq="next", ancestor_tag="div", ancestor_class="pagination"),
    rule(20, "a", last_child=True, ancestor_tag="nav", ancestor_attr="aria-label",
         ancestor_op="*=", ancestor_value="pagination", ci=True),
]
