"""Graph highlights: spec validation, name resolution, nativity, styles and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_NODES, MOST_EDGES = 400, 800


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def edge_style(strength: Column) -> dict[str, Column]:
    """Weight, opacity and width of an edge by its strength."""
    t = F.pow(clamp(strength, 0.0, 1.0), F.lit(0.8))
    return {"t": t, "alpha": 0.25 + 0.75 * t, "width": 1.6 + 3.4 * t}


def node_radius(weight: Column, factor: float = 1.0) -> Column:
    return clamp(3 * F.sqrt(weight + 1), 8.0, 30.0) * factor


def mix_channel(a: Column, b: Column, t: Column) -> Column:
    return F.round(a + (b - a) * t).cast("int")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("int")


def parse_color(c: Column) -> Column:
    """#rgb, #rrggbb, #rrggbbaa or rgb(r, g, b) as a packed integer; null for anything else."""
    h = F.regexp_replace(F.trim(c), r"(?i)^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    rgb = r"(?i)^rgba?\(\s*([\d.]+)\s*[, ]\s*([\d.]+)\s*[, ]\s*([\d.]+)"
    part = lambda i: F.least(F.round(F.regexp_extract(h, rgb, i).try_cast("double")).cast("int"), F.lit(255))
    return F.when(h.rlike(r"(?i)^#[0-9a-f]{6}(?:[0-9a-f]{2})?$"), F.conv(F.substring(h, 2, 6), 16, 10).cast("int")).when(h.rlike(rgb), pack_rgb(part(1), part(2), part(3)))


def channels(color: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a packed integer, 0 to 1."""
    return tuple(F.shiftright(color, s).bitwiseAND(F.lit(255)) / 255.0 for s in (16, 8, 0))


def hsl(color: Column) -> tuple[Column, Column, Column]:
    """Hue (in turns), saturation and lightness of a packed integer; grey has neither hue nor saturation."""
    r, g, b = channels(color)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, l = top - low, (top + low) / 2  # noqa: E741
    turn = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    grey = d == 0
    return F.when(grey, 0.0).otherwise(F.pmod(turn, F.lit(6.0)) / 6), F.when(grey, 0.0).otherwise(d / (1 - F.abs(2 * l - 1))), l


def from_hsl(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """The packed integer of a hue in turns, a saturation and a lightness; halves go up, whatever the last digits of a double."""
    a = s * F.least(l, 1 - l)

    def channel(n: int) -> Column:
        k = F.pmod(h * 12 + n, F.lit(12.0))
        return F.floor(F.round((l - a * clamp(F.least(k - 3, 9 - k), -1.0, 1.0)) * 255, 9) + 0.5).cast("int")

    return pack_rgb(channel(0), channel(8), channel(4))


def lighten(color: Column, by: float) -> Column:
    """A packed colour moved towards white by a share of what is left."""
    h, s, l = hsl(color)  # noqa: E741
    return from_hsl(h, s, l + (1 - l) * by)


def weak_variant(accent: Column) -> Column:
    """The pale end of the gradient: 0.4 of the saturation, 0.55 nearer to white."""
    h, s, l = hsl(accent)  # noqa: E741
    return from_hsl(h, s * 0.4, l + (1 - l) * 0.55)


def isolation_query(nodes: DataFrame, most: int = 4000) -> DataFrame:
    """query: the search that shows just the nodes (id, type, ord) with a page, in order; null where there is none or it
    would be longer than `most`. Each node takes 11 characters or more, so that a bounded number of them decides."""
    pages = nodes.where("type is null or type not in ('unresolved', 'tag')").orderBy("ord", "id").limit(most // 11 + 2)
    part = F.concat(F.lit('path:"'), "id", F.lit('"'))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", part.alias("p")))), lambda x: x["p"]), " OR ")
    return pages.agg(joined.alias("q")).select(F.when((F.length("q") > 0) & (F.length("q") <= most), F.col("q")).alias("query"))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, clamp(((px - ax) * dx + (py - ay) * dy) / n, 0.0, 1.0)).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def nearest_edge(points: DataFrame, edges: DataFrame, reach: float, cell: float | None = None) -> DataFrame:
    """id, edge, d: the nearest edge within reach of each point; edges (edge, ax, ay, bx, by), points (id, px, py).

    Both are dealt to a grid - an edge to every cell its box grown by the reach touches - and meet by cell.
    """
    size = cell or max(reach * 4, 1.0)
    at = lambda c: F.floor(c / size).cast("long")
    e = edges.withColumn("cx", F.explode(F.sequence(at(F.least("ax", "bx") - reach), at(F.greatest("ax", "bx") + reach))))
    e = e.withColumn("cy", F.explode(F.sequence(at(F.least("ay", "by") - reach), at(F.greatest("ay", "by") + reach))))
    p = points.withColumn("cx", at(F.col("px"))).withColumn("cy", at(F.col("py")))
    d = segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))
    near = p.join(e, ["cx", "cy"]).withColumn("d", d).where(F.col("d") < reach)
    return near.groupBy("id").agg(F.min(F.struct("d", "edge")).alias("m")).select("id", "m.edge", "m.d")


def display_name(node: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(node, "/"), -1), r"(?i)\.md$", "")


def validate_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, strength, label, ord) trimmed, clamped and capped, with warnings."""
    s = F.coalesce(F.col("strength"), F.lit(0.5))
    out = edges.withColumns({"src": F.trim("src"), "dst": F.trim("dst"), "label": F.substring("label", 1, 300), "strength": clamp(s, 0.0, 1.0)})
    out = out.withColumn("warnings", F.array_compact(F.array(F.when(F.coalesce(F.col("src"), F.lit("")) == "", "no start"), F.when(F.coalesce(F.col("dst"), F.lit("")) == "", "no end"))))
    return out.where(F.size("warnings") == 0).orderBy("ord").limit(MOST_EDGES)


def nodes_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, ord: listed nodes, then the ends of edges, in order, once each, capped."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("name"), (F.col("ord") * 2).alias("ord")), F.struct(F.col("dst").alias("name"), (F.col("ord") * 2 + 1).alias("ord")))).alias("e")).select("e.*", F.lit(1).alias("late"))
    each = nodes.select("name", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("late")).unionByName(ends.select("name", F.col("ord").cast("long").alias("ord"), "late"))
    return each.groupBy("name").agg(F.min(F.struct("late", "ord")).alias("o")).orderBy("o").limit(MOST_NODES).select("name", F.row_number().over(Window.orderBy("o")).alias("ord"))


def resolve_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, node: the node a name means - itself, with .md, in lower case, lower with .md, or by its base name; the
    first registered wins (nodes: id, ord)."""

    def dim(key: Column, as_: str) -> DataFrame:
        return nodes.groupBy(key.alias(as_)).agg(F.min_by("id", "ord").alias(f"n_{as_}"))

    out = names.withColumns({"k1": F.col("name"), "k2": F.concat("name", F.lit(".md")), "k3": F.lower("name"), "k4": F.concat(F.lower("name"), F.lit(".md")), "k5": F.lower("name")})
    for k, key in (("k1", F.col("id")), ("k2", F.col("id")), ("k3", F.lower("id")), ("k4", F.lower("id")), ("k5", F.lower(display_name(F.col("id"))))):
        out = out.join(dim(key, k), k, "left")
    return out.select("name", F.coalesce(*(f"n_k{i}" for i in range(1, 6))).alias("node"))


def nativity(edges: DataFrame, links: DataFrame) -> DataFrame:
    """edges with native: whether the two ends are linked either way."""
    pair = lambda df: df.withColumns({"__a": F.least("src", "dst"), "__b": F.greatest("src", "dst")})
    known = pair(links).select("__a", "__b").distinct().withColumn("native", F.lit(True))
    return pair(edges).join(known, ["__a", "__b"], "left").withColumn("native", F.coalesce("native", F.lit(False))).drop("__a", "__b")


def dashes(length: Column, dash: float = 6.0, gap: float = 4.0, most: float = 400.0) -> Column:
    """The dashes of a line, as (from, to); one whole line beyond `most`."""
    n = F.floor(length / (dash + gap)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * (dash + gap)).alias("a"), F.least(i * (dash + gap) + dash, length).alias("z")))
    return F.when(length > most, F.array(F.struct(F.lit(0.0).alias("a"), length.alias("z")))).otherwise(F.filter(each, lambda s: s["a"] < s["z"]))
