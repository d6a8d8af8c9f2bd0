"""Event graphs, centroid maps and score reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.functions import vectors as V
from weir.operators import vectors as N
from weir.operators.profiles import Profile
from weir.session import ensure_checkpoint_dir

MESSAGE_WIDTH = 64


def ip_text(ip: Column) -> Column:
    """Dotted quad of a 32-bit address."""
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def vector_text(vec: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vec, lambda x: x.cast("long").cast("string")), ", "), F.lit("]"))


def build_event_message(df: DataFrame, vec: str = "features", ip: str = "remote_ip", rname: str = "rname",
                        score: str = "score", name: str = "message") -> DataFrame:
    """point#ip;reversed name#score#, padded to 64 characters and never cut."""
    tag = F.concat(F.col(ip).cast("string"), F.lit(";"), F.col(rname))
    text = F.concat(vector_text(F.col(vec)), F.lit("#"), tag, F.lit("#"), F.col(score).cast("string"), F.lit("#"))
    return df.withColumn(name, F.when(F.length(text) < MESSAGE_WIDTH, F.rpad(text, MESSAGE_WIDTH, " ")).otherwise(text))


def parse_event_message(df: DataFrame, message: str = "message") -> DataFrame:
    """Point, name@ip and score of each message of the expected form; other messages are left out."""
    parts = F.split(message, "#")
    tags = F.split(parts.getItem(1), ";")
    return (
        df.withColumn("_p", parts).where(F.size("_p") >= 4)
        .withColumn("_t", F.split(F.col("_p")[1], ";")).where(F.size("_t") >= 2)
        .withColumns({
            "point": F.col("_p")[0],
            "tag": F.concat(F.reverse(F.col("_t")[1]), F.lit("@"), ip_text(F.expr("try_cast(_t[0] AS bigint)"))),
            "score": F.col("_p")[2],
        }).drop("_p", "_t")
    )


def distinct_points(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["point", "tag"])


def score_summary(scored: DataFrame, *by: str, length: str = "len") -> DataFrame:
    """Packets, bytes and dropped packets per key and packet score."""
    return scored.groupBy(*by, "packet_score").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col(length).cast("long")).alias("bytes"),
        F.sum(F.when(F.col("verdict") == "DROP", 1).otherwise(0)).alias("dropped"))


def centroid_map(centroids: DataFrame) -> DataFrame:
    """Plot coordinates and size of each centroid."""
    return centroids.withColumn("_xy", V.project_2d(F.col("vec"))).select(
        "cid", F.col("_xy.x").alias("x"), F.col("_xy.y").alias("y"), "size")


def event_graph(scored: DataFrame, profile: Profile, tag: str = "tag", row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (one per centroid, one per event) and edges (nearest centroid to event).

    `scored` holds cid, score and the tag of each event. Red events have score 0, others are green. A
    centroid's size is one more than its events.
    """
    hits = scored.groupBy("cid").agg(F.count(F.lit(1)).alias("_hits"))
    xy = profile.centroids.withColumn("_xy", V.project_2d(F.col("vec")))
    grown = F.when(F.col("cid") >= profile.init_size, "grown").otherwise("profile")
    centres = xy.join(hits, "cid", "left").select(
        F.concat(F.lit("node"), F.col("cid").cast("string")).alias("id"), "label", grown.alias("color"),
        (1 + F.coalesce("_hits", F.lit(0))).alias("size"),
        (F.col("_xy.x") / 100).alias("x"), (F.col("_xy.y") / 100).alias("y"))
    event_id = F.concat(F.lit("node_c"), F.col(row_id).cast("string"))
    events = scored.select(
        event_id.alias("id"), F.col(tag).alias("label"),
        F.when(F.col("score").cast("string") == "0", "red").otherwise("green").alias("color"),
        F.lit(1).cast("long").alias("size"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    edges = scored.select(
        F.concat(F.lit("e"), F.col(row_id).cast("string")).alias("id"),
        F.concat(F.lit("node"), F.col("cid").cast("string")).alias("source"), event_id.alias("target"))
    return centres.unionByName(events), edges


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: str, degrees: int = 2) -> DataFrame:
    """Nodes within `degrees` undirected steps of a node, with their least number of steps."""
    ensure_checkpoint_dir(nodes.sparkSession)
    pairs = edges.select("source", "target").unionByName(
        edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).checkpoint()
    found = nodes.where(F.col("id") == node_id).select("id", F.lit(0).alias("degree"))
    for d in range(1, degrees + 1):
        last = found.where(F.col("degree") == d - 1).select(F.col("id").alias("source"))
        reached = pairs.join(last, "source", "left_semi")
        # one row per node, so what is found is no larger than the node table; the cut keeps the plan of one step
        frontier = reached.select(F.col("target").alias("id")).distinct().join(found, "id", "left_anti").withColumn("degree", F.lit(d))
        found = found.unionByName(frontier).checkpoint()
    return nodes.join(found, "id")


def feature_map(train: DataFrame, test: DataFrame, new: DataFrame | None = None, vec: str = "features",
                row_id: str = "row_id") -> DataFrame:
    """Mapped points of the training, test and new vectors: series, row_id, pos, x, y.

    Vectors of another width than most training vectors are left out. Points are stretched by the maxima of the
    plain training points.
    """
    dim = N.common_width(train, vec)
    stats = N.column_stats(N.map_points(N.filter_dimension(train, dim, vec), vec=vec), "points")
    out = None
    for series, part in [("train", train), ("test", test), ("new", new)]:
        if part is None:
            continue
        mapped = N.map_points(N.filter_dimension(part, dim, vec), stats, vec=vec)
        pairs = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.struct(
            F.element_at(F.col("points"), (2 * i + 1).cast("int")).alias("x"),
            F.element_at(F.col("points"), (2 * i + 2).cast("int")).alias("y")))
        rows = mapped.select(F.lit(series).alias("series"), row_id, F.posexplode(pairs).alias("pos", "_p")).select(
            "series", row_id, "pos", "_p.x", "_p.y")
        out = rows if out is None else out.unionByName(rows)
    return out
