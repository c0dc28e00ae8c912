"""The network of words around one word of a model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dot, unit
from .vectors import nearest, words_table


def nodes(model: DataFrame, header: str, numwords_header: int = 20, numwords_sec: int = 5, value_scale: float = 1000.0) -> DataFrame:
    """(id, label, value): the words nearest to the header, and the words nearest to each of these.

    value is the scaled cosine with the header; ids count from 1 by falling value.
    The rows are bounded by numwords_header * (numwords_sec + 1).  A header that the model
    lacks, as an empty one does, is a ValueError.
    """
    spark = model.sparkSession
    near = nearest(model, words_table(spark, [header]), numwords_header)
    if not near.limit(1).count():
        raise ValueError(f"the model has no word {header!r}")
    second = nearest(model, near.select("word"), numwords_sec)
    pool = near.select("word").union(second.select("word")).distinct()
    from .vectors import cosines

    valued = cosines(model, words_table(spark, [header])).join(F.broadcast(pool), "word", "left_semi")
    return valued.select(F.row_number().over(Window.orderBy(F.desc("cos"), "word")).alias("id"), F.col("word").alias("label"), (F.lit(float(value_scale)) * F.col("cos")).alias("value"))


def edges(model: DataFrame, nodes: DataFrame, top_k_edges: int = 5) -> DataFrame:
    """(from, to, weight): each node's strongest cosines among the nodes; positive ones in both directions."""
    own = model.join(F.broadcast(nodes), model["word"] == nodes["label"]).select("id", unit(F.col("vec")).alias("u"))
    a, b = own.select(F.col("id").alias("from"), F.col("u").alias("ua")), own.select(F.col("id").alias("to"), F.col("u").alias("ub"))
    # The nodes are a bounded few, so that all their pairs are too.
    pairs = a.join(F.broadcast(b), F.col("from") != F.col("to")).select("from", "to", dot(F.col("ua"), F.col("ub")).alias("cos"))
    best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("from").orderBy(F.desc("cos"), "to"))).filter(F.col("rank") <= top_k_edges)
    mirrored = best.filter("cos > 0").select(F.col("to").alias("from"), F.col("from").alias("to"), "cos")
    return best.select("from", "to", "cos").union(mirrored).filter("cos <> 0").groupBy("from", "to").agg(F.max(F.abs("cos")).alias("weight"))


def to_json(nodes: DataFrame, edges: DataFrame, color: str = "red", shape: str = "dot", shadow: bool = True) -> str:
    """The network for a viewer, with how its nodes are drawn."""
    n = [{"id": r["id"], "label": r["label"], "value": r["value"], "color": color, "shape": shape, "shadow": shadow} for r in nodes.orderBy("id").collect()]
    return json.dumps({"nodes": n, "edges": [{"from": r["from"], "to": r["to"]} for r in edges.orderBy("from", "to").collect()]})
