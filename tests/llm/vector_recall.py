"""Recall of the vector search against brute force: python -m tests.llm.vector_recall FOLDER... (folders with an embeddings table)."""

import sys
import tempfile

import numpy as np
from pyspark.sql import SparkSession

from contestlab.llm import ann


def main(folders: list[str]) -> None:
    base = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.warehouse.dir", base).config("spark.checkpoint.dir", base).getOrCreate()
    for folder in folders:
        rows = spark.read.parquet(f"{folder}/embeddings.parquet")
        found = {}
        for r in ann.search(rows, rows.filter(f"vec_id % {ann.EVERY} = 0")).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        table = rows.filter("embedding is not null").select("vec_id", "embedding").toPandas().drop_duplicates("vec_id")
        ids, x, recall = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64), []
        for i in np.flatnonzero(ids % ann.EVERY == 0):
            near = x @ x[i]
            near[i] = -np.inf
            recall.append(len(set(ids[np.lexsort((ids, -near))[: ann.K]].tolist()) & found.get(ids[i], set())) / ann.K)
        print(folder, len(ids), "rows, recall", round(float(np.mean(recall)), 4), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
