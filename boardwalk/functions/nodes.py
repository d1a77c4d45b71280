"""Expressions over one shredded page: its ``nodes`` and ``texts`` arrays.

All of these stay inside the page row, so selecting containers, links and titles needs no
shuffle. ``nodes`` is indexed by ``pre``; ``pre < d.pre <= last`` says d is a descendant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardwalk.functions.binding import let


def attr(node: Column, name: str | Column) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name) if isinstance(name, str) else name)


def subtree_text(texts: Column, node: Column) -> Column:
    """Stripped text nodes under a node, joined by one space."""
    return F.array_join(
        F.slice(texts, node["t_lo"] + 1, node["t_hi"] - node["t_lo"]), " "
    )


def pick(nodes: Column, test: Callable[[Column], Column], *fields: str) -> Column:
    """Nodes passing a test, reduced to the named fields, in document order."""
    return F.transform(
        F.filter(nodes, test), lambda n: F.struct(*[n[f].alias(f) for f in fields])
    )


def lookup(items: Column) -> Column:
    """Items in document order with a dense array ``at``: entry p is the index of the first item
    whose ``pre`` is greater than p.

    The array is built in one linear pass from the gaps between successive items. With it the
    first descendant of a node is one array access, where filtering the items per container
    would compare every container of a page with every item.
    """

    def index(all_items: Column) -> Column:
        return F.flatten(
            F.transform(
                all_items,
                lambda m, i: F.array_repeat(
                    i, m["pre"] - F.coalesce(F.get(all_items, i - 1)["pre"], F.lit(0))
                ),
            )
        )

    return let(items, lambda m: F.struct(m.alias("items"), index(m).alias("at")))


def first_descendant(found: Column, node: Column) -> Column:
    """First item of a ``lookup`` below a node in document order, null when there is none."""
    return let(
        F.get(found["items"], F.get(found["at"], node["pre"])),
        lambda hit: F.when(hit["pre"] <= node["last"], hit),
    )


def _compare(actual: Column, op: Column, value: Column, ci: Column) -> Column:
    left = F.when(ci, F.lower(actual)).otherwise(actual)
    right = F.when(ci, F.lower(value)).otherwise(value)
    return (
        F.when(op == "exists", F.lit(True))
        .when(op == "=", left == right)
        .when(right == "", F.lit(False))
        .when(op == "*=", F.contains(left, right))
        .when(op == "^=", F.startswith(left, right))
        .when(op == "$=", F.endswith(left, right))
        .otherwise(F.lit(False))
    )


def _has_classes(node: Column, names: Column) -> Column:
    padded = F.concat(F.lit(" "), attr(node, "class"), F.lit(" "))
    return F.forall(
        F.split(names, " "), lambda c: F.contains(padded, F.concat(F.lit(" "), c, F.lit(" ")))
    )


def node_matches(node: Column, rule: Column) -> Column:
    """Conditions of a selector rule that concern the node alone."""
    ci = F.coalesce(rule["ci"], F.lit(False))
    return F.coalesce(
        (rule["tag"].isNull() | (node["tag"] == rule["tag"]))
        & (rule["id_eq"].isNull() | (attr(node, "id") == rule["id_eq"]))
        & (rule["class_eq"].isNull() | _has_classes(node, rule["class_eq"]))
        & (
            rule["attr"].isNull()
            | (
                attr(node, rule["attr"]).isNotNull()
                & _compare(attr(node, rule["attr"]), rule["op"], rule["value"], ci)
            )
        )
        & (~F.coalesce(rule["last_child"], F.lit(False)) | node["last_child"])
        # the first child of a node is numbered right after it
        & (~F.coalesce(rule["first_child"], F.lit(False)) | (node["pre"] == node["parent"] + 1))
        & (
            rule["more"].isNull()
            | F.forall(
                rule["more"],
                lambda t: attr(node, t["attr"]).isNotNull()
                & _compare(attr(node, t["attr"]), t["op"], t["value"], ci),
            )
        ),
        F.lit(False),
    )


def _has_ancestor(nodes: Column, node: Column, test: Callable[[Column], Column]) -> Column:
    """Walk the parent pointers: as many steps as the node is deep."""
    walk = F.aggregate(
        F.sequence(F.lit(1), node["depth"]),
        F.struct(node["parent"].alias("at"), F.lit(False).alias("hit")),
        lambda acc, _: F.struct(
            F.get(nodes, acc["at"])["parent"].alias("at"),
            (acc["hit"] | F.coalesce(test(F.get(nodes, acc["at"])), F.lit(False))).alias("hit"),
        ),
    )
    return F.when(node["depth"] > 0, walk["hit"]).otherwise(F.lit(False))


def has_ancestor_tag(nodes: Column, node: Column, tag: str) -> Column:
    return _has_ancestor(nodes, node, lambda a: a["tag"] == tag)


def nearest_ancestor(nodes: Column, node: Column, tags: list[str]) -> Column:
    """``pre`` of the closest ancestor with one of the tags, null when there is none."""
    walk = F.aggregate(
        F.sequence(F.lit(1), node["depth"]),
        F.struct(node["parent"].alias("at"), F.lit(None).cast("int").alias("found")),
        lambda acc, _: F.struct(
            F.get(nodes, acc["at"])["parent"].alias("at"),
            F.coalesce(
                acc["found"],
                F.when(F.get(nodes, acc["at"])["tag"].isin(*tags), acc["at"]),
            ).alias("found"),
        ),
    )
    return F.when(node["depth"] > 0, walk["found"])


def rule_matches(nodes: Column, texts: Column, node: Column, rule: Column) -> Column:
    """All conditions of a selector rule; the cheap ones come first and cut the rest off."""
    wants_ancestor = (
        rule["ancestor_tag"].isNotNull()
        | rule["ancestor_class"].isNotNull()
        | rule["ancestor_attr"].isNotNull()
    )
    ci = F.coalesce(rule["ci"], F.lit(False))

    def is_wanted_ancestor(a: Column) -> Column:
        return (
            (rule["ancestor_tag"].isNull() | (a["tag"] == rule["ancestor_tag"]))
            & (rule["ancestor_class"].isNull() | _has_classes(a, rule["ancestor_class"]))
            & (
                rule["ancestor_attr"].isNull()
                | (
                    attr(a, rule["ancestor_attr"]).isNotNull()
                    & _compare(
                        attr(a, rule["ancestor_attr"]),
                        F.coalesce(rule["ancestor_op"], F.lit("=")),
                        rule["ancestor_value"],
                        ci,
                    )
                )
            )
        )

    return (
        F.when(~node_matches(node, rule), F.lit(False))
        .when(
            rule["has_text"].isNotNull()
            & ~F.contains(F.lower(subtree_text(texts, node)), F.lower(rule["has_text"])),
            F.lit(False),
        )
        .when(
            wants_ancestor & F.coalesce(rule["child"], F.lit(False)),
            (node["parent"] >= 0) & F.coalesce(is_wanted_ancestor(F.get(nodes, node["parent"])), F.lit(False)),
        )
        .when(wants_ancestor, _has_ancestor(nodes, node, is_wanted_ancestor))
        .otherwise(F.lit(True))
    )
