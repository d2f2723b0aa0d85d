"""Pairwise matches consolidated into groups: deterministic Borůvka hooking.

In each round every component picks its smallest outgoing edge, the trees this
makes collapse by pointer doubling, and the edges are relabelled and
deduplicated; it ends when no edge is left.  Nodes get integers in byte order
of their names, so the root of a component is its smallest member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, is_blank, py_strip
from ..session import materialize, materialize_with, release
from . import skew
from .skew import salted_lookup

# The spellings that join two referents and those that part them.
JOINING = ("mirror", "espejo")
PARTING = ("split", "separado")
#: What is left of a graph when so few edges are (a hundred kilobytes) is done in one task: the same rounds, without a job for each.
TASK_EDGES = 4096


def decided_links(asserts: DataFrame) -> DataFrame:
    """(a, b) with a < b: the pairs whose newest countable assertion joins them.

    Sides are compared in canonical form.  Rows with another relation, or a
    null or blank side, do not count; neither does a referent matched to
    itself.  Of several rows with one seq the joining one decides.
    """
    relation = F.lower(py_strip(F.col("relacion")))
    rows = asserts.where(~is_blank(F.col("referente_a")) & ~is_blank(F.col("referente_b"))).select(
        canonical_url(F.col("referente_a")).alias("x"), canonical_url(F.col("referente_b")).alias("y"), relation.alias("r"), "seq"
    )
    rows = rows.where(F.col("r").isin(*JOINING, *PARTING) & (F.col("x") != F.col("y")))
    pairs = rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    newest = F.max(F.col("seq") * 2 + F.col("r").isin(*JOINING).cast("long"))  # one number for both, so the aggregate needs no sort
    return pairs.agg(newest.alias("last")).where("last % 2 = 1").select("a", "b")


def _hook(edges: DataFrame) -> DataFrame:
    """(c, p): every component and the far end of its smallest edge; the smaller end of an edge both picked is a root.

    Edges compare by (smaller end, larger end), so the smallest edge of a
    component leads to its smallest neighbour and a cycle has two members.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o")))).alias("e"))
    picked = both.select("e.c", "e.o").groupBy("c").agg(F.min("o").alias("p"))
    mutual = picked.where(F.col("p") > F.col("c")).join(picked.where(F.col("p") < F.col("c")).select(F.col("c").alias("p"), F.col("p").alias("c")), ["c", "p"], "left_semi")
    return picked.join(mutual.select("c", F.lit(True).alias("root")), "c", "left").select("c", F.when(F.col("root"), F.col("c")).otherwise(F.col("p")).alias("p"))


def _jump(pointers: DataFrame, n: int) -> DataFrame:
    """Every pointer led one further along: to where the component it points at points."""
    return salted_lookup(pointers, pointers.select(F.col("c").alias("p"), F.col("p").alias("g")), ["p"], n).select("c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))


def _collapse(pointers: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Pointer doubling until every component points at its root; two doublings to a stored table while no key can be hot, else one."""
    spark = pointers.sparkSession
    now, path = materialize(pointers, "hook")
    while True:
        ahead = _jump(now, n)
        if n <= skew.HOT_ROWS:
            ahead = _jump(ahead.select("c", "p"), n)
        nxt, new, seen = materialize_with(ahead, "jump", moved=F.count_if("moved"))
        release(spark, path)
        now, path = nxt.select("c", "p"), new
        if not seen["moved"]:
            return now, path


def hook_all(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, root) after all rounds over edges (u, v): the same hooking, doubling and relabelling, in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(u):
        pick = np.full(len(nodes), len(nodes))
        np.minimum.at(pick, u, v)
        np.minimum.at(pick, v, u)
        inside = np.arange(len(nodes))
        point = np.where(pick < len(nodes), pick, inside)
        point = np.where((point[point] == inside) & (point > inside), inside, point)  # of two that picked each other the smaller is a root
        while (point != point[point]).any():
            point = point[point]
        label, u, v = point[label], point[u], point[v]
        apart = u != v
        u, v = np.unique(np.stack([np.minimum(u, v)[apart], np.maximum(u, v)[apart]]), axis=1)
    return nodes, nodes[label]


def _finish(edges: DataFrame) -> DataFrame:
    """(c, p): the root of every component of a graph of at most TASK_EDGES edges, in one task."""

    def run(table: pa.Table) -> pa.Table:
        c, p = hook_all(table["u"].to_numpy(), table["v"].to_numpy())
        return pa.table({"c": pa.array(c), "p": pa.array(p)})

    return edges.withColumn("rest", F.lit(0)).groupBy("rest").applyInArrow(run, "c long, p long")


def _both_ends(edges: DataFrame, ends: tuple[str, str], lookup: DataFrame, names: tuple[str, str], n: int) -> DataFrame:
    """``edges`` (a stored table) with what ``lookup`` (key, value) says of each end, in columns ``names``; rows per key are counted on the stored table."""
    out = edges
    for end, name in zip(ends, names):
        right = lookup.select(F.col("key").alias(end), F.col("value").alias(name))
        out = salted_lookup(out, right, [end], n, counts=edges.groupBy(end).agg(F.count(F.lit(1)).alias("_n")))
    return out


def connected_groups(links: DataFrame) -> DataFrame:
    """(grupo, miembro) for every name in ``links`` (a, b); grupo is the smallest member.

    Links may be reversed, repeated or to oneself (a name with only such a link
    has no group); a null side makes a row count for nothing.  No links give
    no rows.
    """
    spark = links.sparkSession
    rows = F.count(F.lit(1))
    links, links_path, seen = materialize_with(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links", n=rows)
    n = seen["n"]
    names = links.select(F.explode(F.array("a", "b")).alias("nombre")).distinct().orderBy("nombre")
    names, _ = materialize(names.select("nombre", F.monotonically_increasing_id().alias("id")), "names")
    numbered = _both_ends(links, ("a", "b"), names.select(F.col("nombre").alias("key"), F.col("id").alias("value")), ("x", "y"), n)
    edges, path = materialize(numbered.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    release(spark, links_path)
    levels = []
    while n:
        if n <= TASK_EDGES:
            levels.append((materialize(_finish(edges), "hook")[0], 2 * n))
            break
        pointers, _ = _collapse(_hook(edges), 2 * n)
        levels.append((pointers, 2 * n))
        moved = _both_ends(edges, ("u", "v"), pointers.select(F.col("c").alias("key"), F.col("p").alias("value")), ("pu", "pv"), n)
        rest = moved.where(F.col("pu") != F.col("pv")).select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        edges, new, seen = materialize_with(rest, "edges", n=rows)
        release(spark, path)
        path, n = new, seen["n"]
    if not levels:
        return names.select(F.col("nombre").alias("grupo"), F.col("nombre").alias("miembro")).limit(0)
    roots, size = levels.pop()
    while levels:
        lower, size = levels.pop()
        roots = salted_lookup(lower, roots.select(F.col("c").alias("p"), F.col("p").alias("r")), ["p"], size, "left").select("c", F.coalesce("r", "p").alias("p"))
    members = names.join(roots.select(F.col("c").alias("id"), F.col("p").alias("root")), "id")
    heads = names.select(F.col("id").alias("root"), F.col("nombre").alias("grupo"))
    return salted_lookup(members, heads, ["root"], size).select("grupo", F.col("nombre").alias("miembro"))
