"""Connected components over an edge table, and principal components over a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.operators.distribution import standardize
from engagelake.schemas import quoted
from engagelake.session import cut_lineage

def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the smallest node of each component, for edges (a, b).

    In each round every node points at the smallest node around it, pointers are followed to their roots (paths halve
    with each step), and the edges are drawn between the roots: most of them are gone after the first round. All joins
    have stored tables on both sides, so adaptive execution can split a node that many edges share. Nodes without an
    edge never take part.
    """
    links = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    links, labels = cut_lineage(links), None
    while labels is None or not links.isEmpty():
        parent = cut_lineage(links.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("p")))
        while True:
            above = parent.select(F.col("v").alias("__v"), F.col("p").alias("__p"))
            jumped = cut_lineage(parent.join(above, parent["p"] == above["__v"]).select(
                "v", F.col("__p").alias("p"), (F.col("p") > F.col("__p")).alias("moved")))
            parent = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("v", F.col("p").alias("label"))
        else:
            moved = labels.join(parent.withColumnsRenamed({"v": "__v"}), F.col("label") == F.col("__v"), "left")
            labels = cut_lineage(moved.select("v", F.coalesce("p", "label").alias("label")))
        for side in "ab":
            root = parent.withColumnsRenamed({"v": "__v", "p": "__p"})
            links = links.join(root, F.col(side) == F.col("__v")).drop(side, "__v").withColumnRenamed("__p", side)
        links = cut_lineage(links.where("a <> b").select("a", "b").distinct())
    return nodes.join(labels, quoted(node) == labels["v"], "left").select(
        quoted(node), F.coalesce("label", quoted(node)).alias("component"))


def principal_components(df: DataFrame, columns: list[str], k: int = 2):
    """Standardised PCA: (scores, variance, loadings).

    Scores are added to the rows as PC1, PC2, …. Signs are fixed so that the largest loading of each component
    is positive. Rows with a null in a column are left out.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    z = [f"{c}_z" for c in columns]
    scaled = standardize(df.na.drop(subset=columns), columns)
    assembled = VectorAssembler(inputCols=z, outputCol="__x").transform(scaled)
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(assembled)
    matrix = model.pc.toArray()
    signs = [1.0 if max(matrix[:, j], key=abs) >= 0 else -1.0 for j in range(k)]
    spark = df.sparkSession
    ratios = [float(v) for v in model.explainedVariance]
    variance = spark.createDataFrame(
        [(f"PC{i + 1}", ratios[i], sum(ratios[: i + 1])) for i in range(k)],
        "component string, explained double, cumulative double",
    )
    loadings = spark.createDataFrame(
        [(c, *[float(matrix[i, j] * signs[j]) for j in range(k)]) for i, c in enumerate(columns)],
        "variable string, " + ", ".join(f"PC{j + 1} double" for j in range(k)),
    )
    scores = model.transform(assembled).withColumn("__a", vector_to_array("__p"))
    scores = scores.withColumns({f"PC{j + 1}": F.get("__a", F.lit(j)) * signs[j] for j in range(k)})
    return scores.drop("__x", "__p", "__a", *z), variance, loadings
