"""Table functions for SQL: FROM t, LATERAL chunk(t.doc_id, t.text, 'sentence', 1000)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Make chunk() known to a session's SQL. Strategies: fixed, sentence, paragraph."""

    @udtf(returnType="chunk_index: bigint, content: string")
    class Chunk:
        def eval(self, text: str, strategy: str, limit: int):
            import re

            if not text:
                return
            if strategy == "fixed":
                pieces, joiner = [text[i : i + limit] for i in range(0, len(text), limit)], ""
            elif strategy == "sentence":
                pieces, joiner = [s.strip() for s in re.split(r"[.!?]+\s+", text) if s.strip()], " "
            else:
                pieces, joiner = [p.strip() for p in text.split("\n\n") if p.strip()], "\n\n"
            held: list[str] = []
            size = number = 0
            for p in pieces:
                if held and size + len(p) + len(joiner) > limit:
                    yield number, joiner.join(held)
                    held, size, number = [], 0, number + 1
                held.append(p)
                size += len(p) + len(joiner)
            if held:
                yield number, joiner.join(held)

    spark.udtf.register("chunk", Chunk)
