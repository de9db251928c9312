"""Saved graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT_VERSION = 1  # fixed value: layout version written today
_NODE = "array<struct<id:string,type:string,position:struct<x:double,y:double>,config:variant,bypassed:boolean>>"
_EDGE = "array<struct<id:string,source:string,sourceHandle:string,target:string,targetHandle:string>>"


def read_saved_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) of JSON files, one graph a file; a missing list is empty, the version defaults."""
    schema = f"version int, nodes {_NODE}, edges {_EDGE}"
    g = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    graphs = g.select("file", F.coalesce("version", F.lit(0)).alias("saved_version"), F.lit(CURRENT_VERSION).alias("version"))
    n = g.select("file", F.posexplode("nodes").alias("ord", "n"))
    nodes = n.select("file", "ord", "n.id", "n.type", "n.position.x", "n.position.y", F.to_json("n.config").alias("config"), "n.bypassed")
    e = g.select("file", F.posexplode("edges").alias("ord", "e"))
    edges = e.select("file", "ord", "e.id", "e.source", F.col("e.sourceHandle").alias("source_port"), "e.target", F.col("e.targetHandle").alias("target_port"))
    return graphs, nodes, edges
